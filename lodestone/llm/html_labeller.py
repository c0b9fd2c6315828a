"""A recurrent labeller of page blocks: content or not, from tag paths and words of the whole page.

A page is a sequence of leaf blocks. Hashed features of a block's tag path and of its words are summed
into two vectors; with a few measures of its text they go through a bidirectional LSTM and a logistic
output. Written in numpy, trained on pages that this module makes up.
"""

from __future__ import annotations

import os
import random
import zlib
from dataclasses import dataclass

import numpy as np

PATH_BUCKETS, WORD_BUCKETS, PATH_DIM, WORD_DIM, MEASURES, HIDDEN = 1024, 2048, 16, 8, 8, 16
INPUT = PATH_DIM + WORD_DIM + MEASURES
WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "block_labeller.npz")


@dataclass
class Block:
    """text: white space is single spaces; path: a key for each open element and each word of its class, id and role; linked: characters in links."""

    text: str
    path: tuple[str, ...]
    linked: int = 0


def bucket(key: str, buckets: int) -> int:
    return zlib.crc32(key.encode("utf-8", "replace")) % buckets


class Buckets(dict):
    """key -> bucket, remembered up to a bound."""

    def __init__(self, buckets: int, limit: int = 200_000):
        super().__init__()
        self.buckets, self.limit = buckets, limit

    def __missing__(self, key: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        found = self[key] = bucket(key, self.buckets)
        return found


def measures(blocks: list[Block]) -> np.ndarray:
    """MEASURES numbers for each block of a page."""
    n = len(blocks)
    out = np.zeros((n, MEASURES), "f4")
    for i, b in enumerate(blocks):
        t, size = b.text, max(1, len(b.text))
        words = t.count(" ") + 1
        out[i] = (np.log1p(size) / 8, b.linked / size, min(1.0, (t.count(".") + t.count(",")) / words), t[:1].isupper(), t[-1:] in ".!?", i / n, np.log1p(n) / 5, "©" in t or "@" in t)
    return out


def new_weights(seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = {"path": rng.normal(0, 0.1, (PATH_BUCKETS, PATH_DIM)), "word": rng.normal(0, 0.1, (WORD_BUCKETS, WORD_DIM)), "out": rng.normal(0, 0.2, 2 * HIDDEN), "bias": np.zeros(1)}
    for way in ("f", "b"):
        w[f"x{way}"] = rng.normal(0, 1 / np.sqrt(INPUT), (INPUT, 4 * HIDDEN))
        w[f"h{way}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
        w[f"g{way}"] = np.zeros(4 * HIDDEN)
        w[f"g{way}"][HIDDEN : 2 * HIDDEN] = 1
    return {k: v.astype("f4") for k, v in w.items()}


def load_weights(path: str = WEIGHTS) -> dict[str, np.ndarray]:
    with np.load(path) as saved:
        return {k: saved[k].astype("f4") for k in saved.files}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """probabilities() of content for the blocks of many pages at once; pages are padded to the longest of a group of like length."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None):
        self.w = weights or load_weights()
        self.paths, self.words = Buckets(PATH_BUCKETS), Buckets(WORD_BUCKETS)

    def bags(self, blocks: list[Block]) -> tuple[list[list[int]], list[list[int]]]:
        return [[self.paths[k] for k in b.path] or [0] for b in blocks], [list(map(self.words.__getitem__, b.text.lower().split())) or [0] for b in blocks]

    @staticmethod
    def mean(bags: list[list[int]], table: np.ndarray, power: float) -> np.ndarray:
        sizes = np.array([len(b) for b in bags])
        flat = np.fromiter((i for b in bags for i in b), "i4", int(sizes.sum()))
        return np.add.reduceat(table[flat], np.cumsum(sizes) - sizes, axis=0) / (sizes[:, None] ** power).astype("f4")

    def inputs(self, pages: list[list[Block]]) -> np.ndarray:
        """Rows of all blocks of the pages, one after the other."""
        blocks = [b for p in pages for b in p]
        paths, words = self.bags(blocks)
        return np.concatenate([self.mean(paths, self.w["path"], 0.5), self.mean(words, self.w["word"], 1.0), np.concatenate([measures(p) for p in pages])], axis=1)

    def forward(self, x: np.ndarray, mask: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, pages, HIDDEN); padding leaves the state as it was."""
        steps, pages, _ = x.shape
        gates = x @ self.w[f"x{way}"] + self.w[f"g{way}"]
        h = c = np.zeros((pages, HIDDEN), "f4")
        out = np.zeros((steps, pages, HIDDEN), "f4")
        for t in range(steps) if way == "f" else reversed(range(steps)):
            z = gates[t] + h @ self.w[f"h{way}"]
            s = sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            new_c = f * c + i * g
            squashed = np.tanh(new_c)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, squashed, m))
            c = m * new_c + (1 - m) * c
            h = m * (o * squashed) + (1 - m) * h
            out[t] = h
        return out

    def grid(self, rows: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        steps = max(lengths)
        page = np.repeat(np.arange(len(lengths)), lengths)
        time = np.concatenate([np.arange(n) for n in lengths])
        x, mask = np.zeros((steps, len(lengths), rows.shape[1]), "f4"), np.zeros((steps, len(lengths)), "f4")
        x[time, page], mask[time, page] = rows, 1
        return x, mask, time, page

    def probabilities(self, pages: list[list[Block]], cells: int = 60_000) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, "f4")] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while order:
            take, longest = [], 0
            while order and (not take or (len(take) + 1) * max(longest, len(pages[order[-1]])) <= cells):
                longest = max(longest, len(pages[order[-1]]))
                take.append(order.pop())
            lengths = [len(pages[i]) for i in take]
            x, mask, time, page = self.grid(self.inputs([pages[i] for i in take]), lengths)
            states = np.concatenate([self.forward(x, mask, "f"), self.forward(x, mask, "b")], axis=2)
            p = sigmoid(states[time, page] @ self.w["out"] + self.w["bias"])
            for i, own in zip(take, np.split(p, np.cumsum(lengths)[:-1])):
                out[i] = own
        return out

    def gradients(self, pages: list[list[Block]], labels: list[list[int]]) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss and its gradients by backpropagation through time."""
        w = self.w
        blocks = [b for p in pages for b in p]
        paths, words = self.bags(blocks)
        lengths = [len(p) for p in pages]
        x, mask, time, page = self.grid(self.inputs(pages), lengths)
        kept: dict[str, list] = {"f": [], "b": []}
        states = {way: self.forward(x, mask, way, kept[way]) for way in "fb"}
        y = np.concatenate([np.array(v, "f4") for v in labels])
        both = np.concatenate([states["f"], states["b"]], axis=2)[time, page]
        p = sigmoid(both @ w["out"] + w["bias"])
        loss = float(-np.mean(np.log(np.where(y > 0.5, p, 1 - p) + 1e-9)))
        d = (p - y) / len(y)
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        grads["out"], grads["bias"] = both.T @ d, np.array([d.sum()], "f4")
        d_both = d[:, None] * w["out"]
        d_x = np.zeros_like(x)
        for n, way in enumerate("fb"):
            d_states = np.zeros_like(states[way])
            d_states[time, page] = d_both[:, n * HIDDEN : (n + 1) * HIDDEN]
            d_h = d_c = np.zeros(states[way].shape[1:], "f4")
            for t, h, c, i, f, o, g, squashed, m in reversed(kept[way]):
                d_h = d_h + d_states[t]
                inner = d_h * m
                cell = d_c * m + inner * o * (1 - squashed**2)
                z = np.concatenate([cell * g * i * (1 - i), cell * c * f * (1 - f), inner * squashed * o * (1 - o), cell * i * (1 - g**2)], axis=1)
                grads[f"x{way}"] += x[t].T @ z
                grads[f"h{way}"] += h.T @ z
                grads[f"g{way}"] += z.sum(axis=0)
                d_x[t] += z @ w[f"x{way}"].T
                d_h, d_c = z @ w[f"h{way}"].T + d_h * (1 - m), cell * f + d_c * (1 - m)
        rows = d_x[time, page]
        for name, bags, a, power in (("path", paths, 0, 0.5), ("word", words, PATH_DIM, 1.0)):
            sizes = np.array([len(b) for b in bags])
            share = rows[:, a : a + w[name].shape[1]] / (sizes[:, None] ** power)
            np.add.at(grads[name], np.concatenate(bags).astype(int), np.repeat(share, sizes, axis=0))
        return loss, grads


# ---- pages to learn from ----

# Names that pages give to the parts of their layout.
CONTENT_NAMES = "content main article post entry-content post-body story body-text article-body page-content text prose entry single blog-post news-text".split()
NAV_NAMES = "nav menu navbar navigation main-menu breadcrumb breadcrumbs topbar toolbar site-nav pagination pager tabs links skip".split()
SIDE_NAMES = "sidebar aside widget related recommended side rail popular trending more-stories tag-cloud tags share social author-box".split()
NOTICE_NAMES = "cookie cookie-banner cookie-notice consent banner alert notice gdpr popup modal message warning overlay".split()
AD_NAMES = "ad ads advert advertisement sponsored promo sponsor ad-slot adsbox banner-ad commercial".split()
FOOT_NAMES = "footer site-footer bottom copyright legal colophon credits page-footer".split()
HEAD_NAMES = "header site-header masthead top logo branding page-header".split()
FORM_NAMES = "form search newsletter subscribe signup login contact search-form poll".split()
COMMENT_NAMES = "comments comment comment-list commentlist replies responses discussion disqus reader-comments comment-body user-comments feedback".split()
COMMENT_WORDS = "reply said says comment posted ago replied thanks agree".split()
NOTICE_WORDS = "cookies accept privacy policy consent we use this site settings agree subscribe javascript browser".split()
FOOT_WORDS = "copyright rights reserved privacy terms contact imprint about".split()
MENU_WORDS = "home about contact news products services blog login search archive next previous more".split()


class PageMaker:
    """page() makes up (html, label of each leaf block) without repeating any layout often."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def word(self) -> str:
        r = self.rng
        if r.random() < 0.02:
            return str(r.randint(1, 9999))
        return "".join(r.choice("bcdfghjklmnprstvwz") * (r.random() < 0.85) + r.choice("aeiouéäöüñçè" if r.random() < 0.2 else "aeiou") + r.choice("nrstl") * (r.random() < 0.4) for _ in range(r.choice((1, 1, 2, 2, 3, 4))))

    def words(self, n: int) -> str:
        return " ".join(self.word() for _ in range(n))

    def sentence(self, n: int) -> str:
        s = self.words(n).capitalize()
        return s + self.rng.choice(("!!" if self.rng.random() < 0.1 else ".", ".", ".", "?"))

    def prose(self, most: int = 120) -> str:
        r, out = self.rng, []
        for _ in range(1 if r.random() < 0.35 else r.randint(1, 8)):
            out.append(self.sentence(r.choice((1, 2, 3, 6, 10, 15, 25, r.randint(1, most)))))
        text = " ".join(out)
        return text.upper().replace(" ", "!! ") if r.random() < 0.03 else text

    def name(self, names: list[str]) -> str:
        r = self.rng
        chosen = r.choice(names)
        if r.random() < 0.3:
            chosen = r.choice((f"{chosen}-{self.word()}", f"{self.word()} {chosen}", f"{chosen}_{r.randint(1, 9)}"))
        return f' {r.choice(("class", "class", "id"))}="{chosen}"'

    def blank(self) -> str:
        return "" if self.rng.random() < 0.7 else f' class="{self.word()}{self.rng.randint(1, 99)}"'

    def leaf(self, html: str, label: int) -> None:
        self.html.append(html)
        self.labels.append(label)

    def raw(self, html: str) -> None:
        self.html.append(html)

    def paragraphs(self, n: int, label: int, comment: bool = False) -> None:
        r = self.rng
        for _ in range(n):
            text = self.prose(40 if comment else 120)
            if comment and r.random() < 0.5:
                text = f"{self.word().capitalize()} {r.choice(COMMENT_WORDS)} {text}"
            if r.random() < 0.2:
                text = text.replace(" ", f' <{(t := r.choice(("b", "i", "em", "a", "span", "strong")))}{" href=x" * (t == "a")}>{self.word()}</{t}> ', 1)
            if r.random() < 0.1:
                text = text.replace(" ", r.choice(("<br>", "<br/>", " &amp; ", "&nbsp;")), 1)
            kind = r.random()
            if kind < 0.75:
                self.leaf(f"<p{self.blank()}>{text}</p>" if r.random() < 0.8 else f"<p><b>{text}<br>" if r.random() < 0.5 else f"<p>{text}", label)
            elif kind < 0.82:
                self.leaf(f"<h{(k := r.randint(2, 4))}>{self.sentence(r.randint(1, 8))}</h{k}>", label)
            elif kind < 0.88:
                self.raw("<ul>")
                for _ in range(r.randint(1, 5)):
                    self.leaf(f"<li>{self.prose(20)}</li>", label)
                self.raw("</ul>")
            elif kind < 0.92:
                self.leaf(f"<blockquote>{text}</blockquote>", label)
            elif kind < 0.95:
                self.raw("<table>")
                for _ in range(r.randint(1, 3)):
                    self.raw("<tr>")
                    for _ in range(r.randint(1, 3)):
                        self.leaf(f"<td>{self.words(r.randint(1, 4))}</td>", label)
                    self.raw("</tr>")
                self.raw("</table>")
            elif kind < 0.97:
                self.leaf(f"<pre>{text}</pre>", label)
            else:
                self.leaf(f"<div{self.blank()}>{text}</div>", label)

    def menu(self) -> None:
        r = self.rng
        tag, attrs = r.choice((("nav", ""), ("nav", self.name(NAV_NAMES)), ("div", self.name(NAV_NAMES)), ("ul", self.name(NAV_NAMES)), ("div", ' role="navigation"')))
        self.raw(f"<{tag}{attrs}>")
        inner = r.random() < 0.7
        self.raw("<ul>" * inner)
        for _ in range(r.randint(1, 9)):
            text = r.choice(MENU_WORDS).capitalize() if r.random() < 0.4 else self.words(r.randint(1, 3))
            self.leaf(f'<li><a href="/{self.word()}">{text}</a></li>' if inner or tag == "ul" else f'<div><a href="/x">{text}</a></div>', 0)
        self.raw("</ul>" * inner + f"</{tag}>")

    def box(self, tags: tuple[str, ...], names: list[str], words: list[str], roles: tuple[str, ...] = (), most: int = 3) -> None:
        r = self.rng
        tag = r.choice(tags)
        attrs = f' role="{r.choice(roles)}"' if roles and r.random() < 0.2 else "" if tag not in ("div", "section", "ul", "p") and r.random() < 0.6 else self.name(names)
        self.raw(f"<{tag}{attrs}>")
        for _ in range(r.randint(1, most)):
            text = self.prose(30)
            if r.random() < 0.5:
                text += " " + " ".join(r.choices(words, k=r.randint(1, 4)))
            kind = r.random()
            if tag == "p" or kind < 0.35:
                self.leaf(text + ("<hr>" if tag != "p" else ""), 0)
                if tag == "p":
                    break
            elif kind < 0.7:
                self.leaf(f"<p>{text}</p>", 0)
            elif kind < 0.85:
                self.leaf(f"<h{(k := r.randint(2, 4))}>{self.sentence(r.randint(1, 4))}</h{k}>", 0)
            else:
                self.leaf(f'<li><a href="#">{self.words(3)}</a></li>', 0)
        self.raw(f"</{tag}>")

    def footer(self) -> None:
        r = self.rng
        tag, attrs = r.choice((("footer", ""), ("footer", ""), ("footer", self.name(FOOT_NAMES)), ("div", self.name(FOOT_NAMES)), ("div", ' role="contentinfo"')))
        mark = r.choice(("&copy; ", "© ", "Copyright ", ""))
        self.leaf(f"<{tag}{attrs}>{mark}{self.word()}.{r.choice(('com', 'org', 'net'))} &middot; {self.prose(12)} {' '.join(r.choices(FOOT_WORDS, k=r.randint(0, 3)))}</{tag}>", 0)

    def form(self) -> None:
        r = self.rng
        self.raw(f"<form{self.name(FORM_NAMES) if r.random() < 0.5 else ''}>")
        for _ in range(r.randint(1, 3)):
            self.leaf(r.choice((f"<label>{self.words(2)}</label><hr>", f"<p>{self.prose(10)}</p>", f"<div><button>{self.word()}</button></div>", f"<div>{self.words(3)} <input name=q></div>")), 0)
        self.raw("</form>")

    def comments(self) -> None:
        r = self.rng
        tag = r.choice(("div", "section", "ol", "ul", "aside"))
        self.raw(f"<{tag}{self.name(COMMENT_NAMES)}>")
        if r.random() < 0.6:
            self.leaf(f"<h3>{r.choice(('Comments', 'Responses', self.words(2)))}</h3>", 0)
        for _ in range(r.randint(1, 5)):
            inner = r.choice(("li", "div", "article"))
            self.raw(f"<{inner}{self.name(COMMENT_NAMES) if r.random() < 0.6 else ''}>")
            self.paragraphs(r.randint(1, 2), 0, comment=True)
            self.raw(f"</{inner}>")
        self.raw(f"</{tag}>")

    def inset(self) -> None:
        kind = self.rng.random()
        if kind < 0.5:
            self.box(("div", "div", "aside", "p"), AD_NAMES, ["sponsored", "buy", "now"], most=1)
        elif kind < 0.7:
            self.box(("aside", "div"), SIDE_NAMES, MENU_WORDS, most=2)
        elif kind < 0.85:
            self.box(("div",), NOTICE_NAMES, NOTICE_WORDS, ("alert", "dialog"), most=1)
        else:
            self.form()

    def around(self) -> None:
        r = self.rng
        for _ in range(r.choice((0, 1, 1, 2, 3))):
            kind = r.random()
            if kind < 0.3:
                self.box(("div", "div", "aside", "section"), AD_NAMES, ["sponsored", "buy", "now"], most=1)
            elif kind < 0.5:
                self.box(("div", "aside", "aside", "section"), SIDE_NAMES, MENU_WORDS, ("complementary",))
            elif kind < 0.65:
                self.box(("div", "section", "dialog"), NOTICE_NAMES, NOTICE_WORDS, ("alert", "dialog", "banner"), most=2)
            elif kind < 0.75:
                self.box(("header", "div"), HEAD_NAMES, MENU_WORDS, ("banner",), most=2)
            elif kind < 0.88:
                self.form()
            else:
                self.menu()

    def page(self) -> tuple[str, list[int]]:
        r = self.rng
        self.html, self.labels = [], []
        self.raw(f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{self.words(4)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>')
        if r.random() < 0.85:
            self.menu()
        self.around()
        tags = r.choice(([("article", "")], [("article", "")], [("main", ""), ("article", "")], [("main", self.blank())], [("div", self.name(CONTENT_NAMES))], [("section", self.name(CONTENT_NAMES))], [("div", self.blank()), ("div", self.name(CONTENT_NAMES))], [("article", self.name(CONTENT_NAMES))], [("div", self.blank())]))
        for tag, attrs in tags:
            self.raw(f"<{tag}{attrs}>")
        if r.random() < 0.75:
            head = r.random() < 0.1
            self.leaf("<header>" * head + f"<h1>{self.sentence(r.randint(1, 12))}</h1>" + "</header>" * head, 1)
        for _ in range(r.choice((1, 1, 2, 3))):
            self.paragraphs(r.choice((1, 1, 2, 4, 8, 15, 30)), 1)
            if r.random() < 0.2:
                self.inset()
        for tag, _ in reversed(tags):
            self.raw(f"</{tag}>")
        self.around()
        if r.random() < 0.35:
            self.comments()
        if r.random() < 0.85:
            self.footer()
        self.raw("</body></html>")
        return "".join(self.html), self.labels


def train(blocks_of, pages: int = 8000, epochs: int = 7, seed: int = 5, rate: float = 0.01, batch: int = 48) -> dict[str, np.ndarray]:
    """Weights fitted with Adam to made-up pages; blocks_of(html) must give a Block for each label."""
    maker, data = PageMaker(seed), []
    for _ in range(pages):
        html, labels = maker.page()
        blocks = blocks_of(html)
        if len(blocks) == len(labels):
            data.append((blocks, labels))
    model = BlockLabeller(new_weights(seed))
    first, second, step, rng = {}, {}, 0, random.Random(seed)
    for epoch in range(epochs):
        rng.shuffle(data)
        groups = [sorted(data[i : i + 20 * batch], key=lambda d: len(d[0])) for i in range(0, len(data), 20 * batch)]
        parts = [g[i : i + batch] for g in groups for i in range(0, len(g), batch)]
        rng.shuffle(parts)
        for part in parts:
            _, grads = model.gradients([b for b, _ in part], [x for _, x in part])
            step += 1
            now = rate * (0.5 ** (2 * epoch / epochs * 2))
            for k, g in grads.items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first.get(k, 0) + 0.1 * g
                second[k] = 0.99 * second.get(k, 0) + 0.01 * g * g
                model.w[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype("f4")
    return model.w
