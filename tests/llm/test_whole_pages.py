"""Pages that leave end tags out keep their text."""

from __future__ import annotations

import pytest

from lodestone.llm import html_extract


def texts(page: str) -> list[str]:
    return [b.text for b in html_extract.blocks_of(page)]


@pytest.mark.parametrize("start", ["<html><head><title>x</title><body>", "<head><meta charset=utf-8><title>x</title><style>p {}</style>", "<html><head><title>x</title></head><body>"])
def test_head_without_end(start):
    assert texts(start + "<article><h1>One</h1><p>Two three.</p></article>") == ["One", "Two three."]


@pytest.mark.parametrize("tag", sorted(html_extract.HIDDEN))
def test_hidden_elements(tag):
    assert texts(f"<article><p>one</p><div><{tag}>gone</div><p>two</p></article><p>three</p>") == ["one", "two", "three"]
    assert texts(f"<p>one <{tag}>gone</{tag}> two</p><p>three") == ["one two", "three"]
    assert texts(f"<p>one <{tag}>gone</p><p>two") == ["one", "two"]


def test_what_hidden_elements_hold():
    assert texts("<p>a <object><p>gone</p><ul><li>gone</ul></object> b</p><svg><foreignObject><p>gone</p></foreignObject><path/></svg><p>c") == ["a b", "c"]
    assert texts("<p>one</p><svg><path d=x><p>two</p><video><source src=a>gone<p>gone</video><li>three") == ["one", "two", "three"]
