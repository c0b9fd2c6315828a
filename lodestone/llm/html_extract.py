"""Main text of web pages: blocks of the page, labelled by a recurrent network, joined.

Run as a module with the name of a file, it trains the labeller and writes its weights there.
"""

from __future__ import annotations

import html
import re
import sys

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.html_labeller import Block, BlockLabeller, PageMaker, load_weights, train

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>"']++|"[^"]*+"|'[^']*+')*+)>?""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
NAME = re.compile(r"[a-z]+")
WHITE = re.compile(r"\s+")
# Names of HTML elements by how they are parsed.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Skipped up to the end tag; markup within them is text.
UNSEEN = set("script style noscript title textarea iframe".split())
#: Elements without seen text that stand on the stack, so that one without an end tag ends with its parent.
HIDDEN = set("template svg math object canvas audio video".split())
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend "
    "li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: An opening of the first kind of element ends an open one of the second, unless one of the third stands between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
CONTENT = 0.5


def keys_of(tag: str, attributes: str) -> tuple[str, ...]:
    out = [tag]
    for m in ATTRIBUTE.finditer(attributes):
        out += [f".{w}" for w in NAME.findall((m[2] or m[3] or m[4] or "").lower())]
    return tuple(out)


def blocks_of(page: str) -> list[Block]:
    """The page's blocks with text, in order. Comments, titles, scripts, styles and other unseen elements have none. The tags of the head, which may be left out, are passed over."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    runs: list[str] = []
    known: dict[tuple[str, str], tuple[str, ...]] = {}
    linked = links = 0
    hidden: int | None = None  # where the outermost open element of HIDDEN stands

    def flush() -> None:
        nonlocal linked
        if runs:
            if text := WHITE.sub(" ", "".join(runs)).strip():
                out.append(Block(text, tuple(dict.fromkeys(k for _, keys in stack for k in keys)), min(linked, len(text))))
            runs.clear()
        linked = 0

    def close(at: int) -> None:
        nonlocal hidden
        if hidden is not None and at <= hidden:
            drop(hidden)
            hidden = None
        if hidden is None and any(t in BLOCK for t, _ in stack[at:]):
            flush()
        drop(at)

    def drop(at: int) -> None:
        nonlocal links
        links -= sum(t == "a" for t, _ in stack[at:])
        del stack[at:]

    def find(names: set[str], unless: set[str]) -> int:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in unless:
                return -1
        return -1

    def say(text: str) -> None:
        nonlocal linked
        if hidden is not None:
            return
        text = html.unescape(text) if "&" in text else text
        runs.append(text)
        if links:
            linked += len(text)

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if (i := find({tag}, set())) >= 0:
                close(i)
            elif tag in BLOCK and hidden is None:
                flush()
            continue
        if tag == "head":
            continue
        if tag in VOID:
            if hidden is not None:
                continue
            if tag == "br":
                runs.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in UNSEEN:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in HIDDEN:
            if m[3].endswith("/") and tag in ("svg", "math"):
                continue
            hidden = len(stack) if hidden is None else hidden
        if tag in BLOCK:
            # HTML within a drawing or a formula ends it; an object or a template holds its own.
            if hidden is not None and (i := find({"svg", "math"}, {"foreignobject", "annotation-xml", "object", "template"})) >= 0:
                close(i)
            if tag in ENDS and (i := find(ENDS[tag][0], ENDS[tag][1] | {"object", "template"})) >= 0:
                close(i)
            if tag != "option" and (i := find({"p"}, {"td", "th", "table", "button", "object", "template", "li"} if tag == "p" else {"td", "th", "table", "button", "object", "template"})) >= 0:
                close(i)
            if hidden is None:
                flush()
        elif tag == "a":
            links += 1
        where = (tag, m[3])
        if where not in known:
            known[where] = keys_of(tag, m[3])
        stack.append((tag, known[where]))
    flush()
    return out


def joined(blocks: list[Block], chances) -> str:
    return "\n\n".join(b.text for b, p in zip(blocks, chances) if p >= CONTENT)


def main_texts(pages: list[str | None], labeller: BlockLabeller) -> list[str]:
    """The main text of each page; empty where page is null or no block is content."""
    blocks = [blocks_of(p or "") for p in pages]
    return [joined(b, c) for b, c in zip(blocks, labeller.probabilities(blocks))]


def extract_main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rows: int = 256) -> DataFrame:
    """page_id, url, text, n_chars for every row, from its whole html.

    Null html counts as empty and has empty text. Ids and urls may be null or repeated; other columns are ignored.
    rows pages are labelled at a time. The weights, of fixed size, go to the workers with the function.
    """
    weights = load_weights()

    def run(batches):
        labeller = BlockLabeller(weights)
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                texts = main_texts(part.column(2).to_pylist(), labeller)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(df.dtypes)
    return df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")


def agreement(labeller: BlockLabeller, pages: int = 500, seed: int = 99) -> float:
    """The share of blocks of newly made pages that are labelled right."""
    maker, right, total = PageMaker(seed), 0, 0
    for _ in range(pages):
        page, labels = maker.page()
        blocks = blocks_of(page)
        if len(blocks) == len(labels):
            chances = labeller.probabilities([blocks])[0]
            right += sum((p >= CONTENT) == bool(y) for p, y in zip(chances, labels))
            total += len(labels)
    return right / max(1, total)


if __name__ == "__main__":
    import numpy as np

    fitted = train(blocks_of)
    np.savez_compressed(sys.argv[1], **{k: v.astype("f2") for k, v in fitted.items()})
    print("agreement", agreement(BlockLabeller(fitted)))
