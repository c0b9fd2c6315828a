"""Harmonic packing of documents into sequences of a fixed capacity.

A piece of length n belongs to class k = capacity // n, and a bin of class k takes k pieces, so
every worker fills its bins knowing nothing but lengths. Pieces that would leave much of their
share of a bin empty are cut to the next class's exact share first. The bins that are not
full at a worker's end are laid end to end, cut at the capacity, and the last of them at powers
of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import tidy
from lodestone.llm.encoding import BYTE_BPE, batches_of, shared_encoder

CAPACITY = 2048
#: The share of its place in a bin that a piece may leave empty.
SLACK = 0.02
#: Chunks that the encoder's cache holds, about 200 bytes each; more save time where memory allows.
CACHE = 120_000
PIECES = "doc_id {}, start long, length long, doc_tokens long, sequence_id long, offset long, ids array<int>, ids_crc32 long"
NAMES = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "ids_crc32"]


def cuts(n: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[int]:
    """Lengths of the pieces of a document of n ids, in order."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        k = capacity // n
        if n * k >= capacity * (1 - slack):
            out.append(n)
            break
        share = capacity // (k + 1)
        out.append(share)
        n -= share
    return out


class HarmonicPacker:
    """add() places the pieces of one document, done() what is left.

    Both yield (tag, start, ids, sequence, offset) of pieces whose place is final; ids are bytes,
    four for each id. Only the ids of open bins are held: at most one bin a class.
    """

    def __init__(self, first: int = 0, capacity: int = CAPACITY, slack: float = SLACK):
        self.next, self.capacity, self.slack, self.open = first, capacity, slack, {}

    def add(self, tag, ids: bytes) -> Iterator[tuple]:
        start = 0
        for length in cuts(len(ids) // 4, self.capacity, self.slack):
            k = self.capacity // length
            bin_ = self.open.setdefault(k, [])
            bin_.append((tag, start, ids[4 * start : 4 * (start + length)]))
            start += length
            if len(bin_) == k:
                offset = 0
                for piece in self.open.pop(k):
                    yield *piece, self.next, offset
                    offset += len(piece[2]) // 4
                self.next += 1

    def done(self) -> Iterator[tuple]:
        rest = [p for k in sorted(self.open) for p in self.open[k]]
        left, room, offset = sum(len(p[2]) // 4 for p in rest), 0, 0
        self.open = {}
        for tag, start, ids in rest:
            while ids:
                if not room:
                    room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                    offset = 0
                take = min(room, len(ids) // 4)
                yield tag, start, ids[: 4 * take], self.next, offset
                ids, start, offset, room, left = ids[4 * take :], start + take, offset + take, room - take, left - take
                if not room:
                    self.next += 1


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str = BYTE_BPE, end_id: int = 1, capacity: int = CAPACITY, slack: float = SLACK, keep_ids: bool = True, cache_chunks: int = CACHE) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids, ids_crc32.

    Null text is empty, so such a document is its end id alone. Ids may be null or repeated; each row
    is a document of its own. Other columns are ignored. There is no shuffle: a worker holds, besides the
    current batch, the pieces of at most one open bin a class. Sequence ids are unique, with
    gaps between workers.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(batches):
        from pyspark import TaskContext

        packer, encoder = HarmonicPacker(TaskContext.get().partitionId() << 36, capacity, slack), shared_encoder(tokenizer_path, cache_chunks)

        def rows(placed):
            out = []
            for (doc, tokens), start, ids, sequence, offset in placed:
                out.append((doc, start, len(ids) // 4, tokens, sequence, offset, np.frombuffer(ids, "<i4") if keep_ids else None, zlib.crc32(ids)))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], NAMES)

        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(0).type, *[pa.int64()] * 5, pa.list_(pa.int32()), pa.int64()]
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, some in batches_of(texts):
                placed = []
                for doc, coded in zip(docs[i : i + len(some)], encoder.encode(some, end_id)):
                    placed += packer.add((doc, len(coded) // 4), coded)
                yield rows(placed)
        if kinds:
            yield rows(packer.done())

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), PIECES.format(kind))
