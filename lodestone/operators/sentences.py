"""Sentence splitting, packing into chunks and merging of small ones, as folds over one document's arrays.

No shuffle is needed: all state is that of one row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.functions.text import let, strip

GENERIC = r"""(?md)(?<=[.!?])\s+(?=[A-Z"'(\[])|(?<=[.!?])\s*$"""
PDF = "(?md)(?<=[.!?])\\s+(?=[A-Z\"'(\\[“])|(?<=[.!?])\\s*$"
WEB = "(?<=[.!?;])\\s+(?=[A-Z\"“(])"


def _strings() -> Column:
    return F.array().cast("array<string>")


def split_sentences(text: Column, pattern: str = GENERIC) -> Column:
    """array<string>; a text that is one piece is one sentence, a blank one has none."""
    parts = F.filter(F.transform(F.split(strip(text), pattern), strip), lambda x: x != "")
    return parts


def split_web_sentences(text: Column, short: int = 60) -> Column:
    """As above with semicolons; an unfinished short sentence takes in the next one."""
    parts = split_sentences(text, WEB)

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        open_ = (F.size(done) > 0) & (F.length(last) < short) & ~F.substring(last, -1, 1).isin(".", "!", "?", ";")
        return F.when(open_, F.array_append(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.concat(last, F.lit(" "), x))).otherwise(F.array_append(done, x))

    return F.aggregate(parts, _strings(), step)


def group_sizes(sentences: Column, most: int, chars: int) -> Column:
    """For each sentence, how many a group that starts there holds: at most so many, and so many characters with spaces unless it is one."""

    def body(s: Column) -> Column:
        ends = F.aggregate(s, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + F.length(x)))

        def size(e: Column, i: Column) -> Column:
            fits = [F.when((i + k <= F.size(s)) & (F.get(e, i + k) - F.get(e, i) + (k - 1) <= chars), k).otherwise(1) for k in range(2, most + 1)]
            return F.greatest(F.lit(1), *fits) if fits else F.lit(1)

        return let(ends, lambda e: F.transform(s, lambda x, i: size(e, i)))

    return body(sentences)


def pack(sentences: Column, most: int = rules.MAX_SENTENCES, chars: int = rules.MAX_CHUNK_CHARS, overlap: int = 0, skip_stuck: bool = False) -> Column:
    """array<array<string>>: sentences in groups, each group starting overlap sentences before the last one's end.

    A group too small for the overlap is followed by the next sentence, or with skip_stuck by the next group.
    """
    overlap = max(0, min(overlap, most - 1))

    def starts(sizes: Column) -> Column:
        n = F.size(sizes)
        zero = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("found"))

        def step(s: Column, i: Column) -> Column:
            end = i + F.get(sizes, i)
            back = F.when(end - overlap <= i, end).otherwise(end - overlap) if skip_stuck else F.greatest(i + 1, end - overlap)
            after = F.when(end >= n, F.lit(1 << 30)).otherwise(back)
            return F.when(i == s["next"], F.struct(after.alias("next"), F.array_append(s["found"], i).alias("found"))).otherwise(s)

        return F.aggregate(F.sequence(F.lit(0), n - 1), zero, step, lambda s: s["found"])

    def groups(s: Column) -> Column:
        found = let(group_sizes(s, most, chars), lambda z: F.transform(starts(z), lambda i: F.slice(s, i + 1, F.get(z, i))))
        return F.when(F.size(s) == 0, F.array().cast("array<array<string>>")).otherwise(found)

    return let(sentences, groups)


def pack_rows(rows: Column, chars: int, gap: int = 1) -> Column:
    """array<array<string>>: rows in order, a new group where the next one would exceed the characters; each row counts gap more."""
    zero = F.struct(F.array().cast("array<array<string>>").alias("done"), _strings().alias("open"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        full = (F.size(s["open"]) > 0) & (s["n"] + F.length(x) + (gap if gap == 1 else 0) > chars)
        fresh = F.struct(F.array_append(s["done"], s["open"]).alias("done"), F.array(x).alias("open"), (F.length(x) + gap).alias("n"))
        return F.when(full, fresh).otherwise(F.struct(s["done"].alias("done"), F.array_append(s["open"], x).alias("open"), (s["n"] + F.length(x) + gap).alias("n")))

    return F.aggregate(rows, zero, step, lambda s: F.when(F.size(s["open"]) > 0, F.array_append(s["done"], s["open"])).otherwise(s["done"]))


def joined(groups: Column, by: str = " ") -> Column:
    return F.transform(groups, lambda g: F.array_join(g, by))


def table_chunks(text: Column, chars: int = rules.MAX_CHUNK_CHARS, least: int = 20) -> Column:
    """A table's lines without blanks; larger ones in groups of rows, pieces under so many characters left out."""
    rows = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    whole = F.array_join(rows, "\n")
    return F.when(F.length(whole) > chars, F.filter(joined(pack_rows(rows, chars), "\n"), lambda x: F.length(strip(x)) >= least)).otherwise(F.array(whole))


def slide_groups(slides: Column, chars: int = rules.MAX_CHUNK_CHARS) -> Column:
    """Slides with text in groups; each counts ten characters more."""
    return pack_rows(F.filter(slides, lambda x: strip(x) != ""), chars, gap=10)


CHUNK = "struct<section:string,text:string>"


def _text_grown(a: Column, b: Column) -> Column:
    return F.struct(a["section"].alias("section"), F.concat(a["text"], F.lit(" "), b["text"]).alias("text"))


def _fold(chunks: Column, merges, kind: str, grown) -> Column:
    """Each chunk joins the one before where merges(last, chunk) says so."""

    def step(done: Column, c: Column) -> Column:
        last = F.element_at(done, -1)
        into = F.array_append(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), grown(last, c))
        return F.when(F.coalesce((F.size(done) > 0) & merges(last, c), F.lit(False)), into).otherwise(F.array_append(done, c))

    return F.aggregate(chunks, F.array().cast(f"array<{kind}>"), step)


def merge_small(chunks: Column, small: int, least: int = 200, most: int = rules.MAX_CHUNK_CHARS + 200, base_title: bool = False, forward: bool = True, kind: str = CHUNK, grown=_text_grown, into_next=None) -> Column:
    """array of CHUNK: small chunks join the one before in their section, then those under least any neighbour before if the sum fits, then a tiny first one the next.

    With base_title, sections are compared without their part numbers. One pass of the second step reaches its end: a chunk that was refused only grows.
    Chunks may be of another kind with a section and a text; grown(a, b) then makes one of a and the chunk after it, into_next(a, b) puts a before b.
    """
    title = (lambda x: F.substring_index(x, " (part", 1)) if base_title else (lambda x: x)
    first = _fold(chunks, lambda last, c: (title(last["section"]) == title(c["section"])) & (F.length(c["text"]) < small), kind, grown)
    second = merge_neighbours(first, least, most, kind, grown)
    return merge_first(second, least, into_next) if forward else second


def merge_neighbours(chunks: Column, least: int = 200, most: int = rules.MAX_CHUNK_CHARS + 200, kind: str = CHUNK, grown=_text_grown) -> Column:
    """Chunks under least characters join the one before if both together have at most so many."""
    return _fold(chunks, lambda last, c: (F.length(c["text"]) < least) & (F.length(last["text"]) + F.length(c["text"]) + 1 <= most), kind, grown)


def merge_first(chunks: Column, least: int = 200, into_next=None) -> Column:
    """A first chunk under least characters goes to the head of the next one."""
    into_next = into_next or (lambda a, b: F.struct(b["section"].alias("section"), F.concat(a["text"], F.lit(" "), b["text"]).alias("text")))

    def tiny(s: Column) -> Column:
        a, b = F.get(s, F.lit(0)), F.get(s, F.lit(1))
        moved = F.concat(F.array(into_next(a, b)), F.slice(s, F.lit(3), F.greatest(F.size(s), F.lit(1))))
        return F.when((F.size(s) > 1) & (F.length(a["text"]) < least), moved).otherwise(s)

    return let(chunks, tiny)


def list_pieces(text: Column) -> Column:
    """A segment cut before bullets and numbered items."""
    parts = F.filter(F.transform(F.split(strip(text), r"(?:^|\n\s*\n|\n)(?=\s*(?:[-•*]|\d+\.)\s+\S)"), strip), lambda x: x != "")
    return F.when(F.size(parts) <= 1, F.filter(F.array(strip(text)), lambda x: x != "")).otherwise(parts)
