"""Language ID by cross-parsing entropy.

For each language a suffix automaton is built from a bounded sample of labelled text. A text is
parsed greedily into the longest phrases that occur in the sample; the fewer phrases a language
needs for its length, the closer the text. Parsing from the automaton's root needs no suffix
links, so the automaton becomes a plain table of next states and numpy steps through many blocks of
text at once. Texts are cut into blocks that are parsed on their own and whose phrases add up.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import carried, tidy, worker_cache

#: At most so many documents, and so many characters, are learned for each language.
SAMPLE_DOCS, SAMPLE_CHARS = 64, 20_000
#: Bytes of one block of text, and of the texts that are parsed together.
BLOCK, CHUNK_BYTES = 256, 4 << 20
LETTER = re.compile(r"[^\W\d_]")
#: How sharply the score falls with the difference in bits per byte.
SHARPNESS = 8.0


def byte_symbols() -> np.ndarray:
    """A symbol for each byte: letters without case, one for digits, one for ASCII signs and space; bytes over 127 stay themselves."""
    out = np.arange(256)
    out[:128] = 32
    for b in range(ord("a"), ord("z") + 1):
        out[b] = out[b - 32] = b
    out[ord("0") : ord("9") + 1] = ord("0")
    return out.astype("u1")


FOLD = byte_symbols()


def folded(text: str) -> np.ndarray:
    return FOLD[np.frombuffer(text.encode("utf-8", "replace"), "u1")]


def suffix_automaton(symbols) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root."""
    next_, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        here = len(next_)
        next_.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in next_[p]:
            next_[p][c] = here
            p = link[p]
        if p != -1:
            q = next_[p][c]
            if length[p] + 1 == length[q]:
                link[here] = q
            else:
                copy = len(next_)
                next_.append(dict(next_[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and next_[p].get(c) == q:
                    next_[p][c] = copy
                    p = link[p]
                link[q] = link[here] = copy
        last = here
    return next_


class CrossParser:
    """phrases() counts, for each text and language, the phrases of a greedy parse by the language's sample."""

    def __init__(self, samples: dict[str, str], block: int = BLOCK):
        self.langs, self.block = sorted(samples), block
        coded = [folded(samples[x]) for x in self.langs]
        seen = np.unique(np.concatenate([*coded, np.array([32], "u1")]))
        #: Symbol 0 occurs in no sample and always ends a phrase; the last one pads blocks and changes nothing.
        self.symbol = np.zeros(256, "u1")
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.symbol = self.symbol[FOLD]
        self.pad, self.width = len(seen) + 1, len(seen) + 2
        self.tables = []
        for text in coded:
            own = suffix_automaton((np.searchsorted(seen, text) + 1).tolist())
            table = np.full((len(own), self.width), -1, "i4")
            for state, out in enumerate(own):
                table[state, list(out)] = list(out.values())
            first = np.where(table[0] < 0, 0, table[0])
            # An entry is twice the row's offset, odd where a phrase ends before the step.
            moved = np.where(table < 0, first * self.width * 2 + 1, table * self.width * 2)
            moved[:, self.pad] = np.arange(len(own)) * self.width * 2
            self.tables.append(moved.astype("i8" if moved.max() > 2**31 - 1 else "i4").ravel())
        #: Bits that one phrase costs: a place in the sample.
        self.bits = np.array([np.log2(max(2, len(t))) for t in coded])

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) phrase counts, and the texts' bytes."""
        raw = [t.encode("utf-8", "replace") for t in texts]
        sizes = np.array([len(r) for r in raw])
        blocks = -(-sizes // self.block)
        total = int(blocks.sum())
        counts = np.zeros((len(texts), len(self.langs)), "i8")
        if not total:
            return counts, sizes
        grid = np.full(total * self.block, self.pad, "u1")
        starts = (np.cumsum(blocks) - blocks) * self.block
        for r, at in zip(raw, starts):
            grid[at : at + len(r)] = self.symbol[np.frombuffer(r, "u1")]
        steps = np.ascontiguousarray(grid.reshape(total, self.block).T)
        owner = np.repeat(np.arange(len(texts)), blocks)
        for k, table in enumerate(self.tables):
            state, ended = np.zeros(total, table.dtype), np.ones(total, "i4")
            for row in steps:
                moved = table.take(state + row)
                ended += moved & 1
                state = moved >> 1
            counts[:, k] = np.bincount(owner, ended, len(texts)).astype("i8")
        return counts, sizes

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; und and 0 for null and for texts without a letter."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        known = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
        at = 0
        while at < len(known):
            some, size = [], 0
            while at < len(known) and (not some or size + len(texts[known[at]]) <= CHUNK_BYTES):
                some.append(known[at])
                size += len(texts[known[at]])
                at += 1
            counts, sizes = self.phrases([texts[i] for i in some])
            cost = counts * self.bits / sizes[:, None]
            best = cost.argmin(axis=1)
            score = 1 / np.exp(-SHARPNESS * (cost - cost.min(axis=1, keepdims=True))).sum(axis=1)
            for i, b, s in zip(some, best, score):
                out[i] = (self.langs[b], float(s))
        return out


def remainder(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Sample text of each non-null language, from rows whose remainder() is not 2.

    The sample is the docs rows of least id hash among those with text, each giving an equal share
    of at most chars characters. What reaches the driver is bounded by both for each language.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull() & (remainder("id") != 2) & (F.length("text") > 0))
    share = max(1, 2 * chars // docs)
    first = rows.select("lang", F.xxhash64("id").alias("h"), F.substring("text", 1, share).alias("text"))
    order = Window.partitionBy("lang").orderBy("h", "text")
    found = first.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= docs).select("lang", "rn", "text").collect()
    out: dict[str, str] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["rn"])):
        out[r["lang"]] = (out.get(r["lang"], "") + r["text"] + "\n")[:chars]
    return out


def identify(df: DataFrame, samples: dict[str, str], id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred, score for every row, from its whole text alone; columns named in carry come before them.

    lang_pred is und and score 0 where text is null or has no letter, or no language was learned. Ties go to
    the first language in alphabetical order. Ids may be null or repeated; columns that are not carried are dropped.
    """
    carry = carry or []
    n = len(carry)

    def run(batches):
        parser = worker_cache(f"languages {sorted(samples.items())}", lambda: CrossParser(samples)) if samples else None
        for batch in batches:
            found = parser.predict(batch.column(n + 1).to_pylist()) if parser else [("und", 0.0)] * batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 1], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], [*carry, "doc_id", "lang_pred", "score"])

    ddl = carried(df, carry, ["doc_id", "lang_pred", "score"])
    return df.select(*carry, F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).mapInArrow(tidy(run), f"{ddl}doc_id {dict(df.dtypes)[id_col]}, lang_pred string, score double")
