"""Language-model scoring from a log-frequency Bloom filter.

A count c is kept as its level, 1 + floor(log_1.5 c): an n-gram is put into the filter once for every level up to its own, and
read by probing level after level until one is missing. The filter grows with the distinct n-grams of the training texts, a
few bits each, and comes in buckets of n-grams by hash. Filters within a bound are broadcast; larger ones meet the
n-grams of pieces of the corpus in a join by part of the filter. Probabilities are smoothed by interpolation: an n-gram's count
with `prior` imagined ones spread as the shorter history tells.

Beside the model stands the base score of exact word counts. Frequent words, of which there is a bounded number, are broadcast with
their counts; words that the filter does not know have none; only the others are joined.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import carried, discard, free_shuffles, materialize, settings, tidy

BASE, HASHES, BITS = 1.5, 6, 10
#: The least count of each level, up to counts that no corpus has.
LOWER = np.unique(np.ceil(BASE ** np.arange(100)).astype("i8"))
#: What a level stands for: the middle of its counts; level 0 is none.
EXPECTED = np.concatenate([[0.0], (LOWER[:-1] + LOWER[1:] - 1) / 2])
#: Words with more than one in so many of the tokens are broadcast with their counts.
FREQUENT = 2_000_000
#: Filters of at most so many bytes are broadcast whole; beyond, parts of PART_BYTES are joined.
MAX_FILTER_BYTES, PART_BYTES = 128 << 20, 8 << 20
#: Tokens to a bucket of the filter, bytes of text that are scored together, n-grams counted together.
BUCKET_TOKENS, GROUP_BYTES, COUNTED = 20_000, 2 << 20, 3_000_000
#: Bytes of text whose distinct n-grams are looked up together, where the filter is joined.
PIECE_BYTES = 8 << 20
#: A group looks up about as many n-grams as so many pieces have, so that sending it a part of the filter weighs little.
LOOKED = 8
#: Bytes of texts that go to Python at a time. Where the filter is joined a row is a piece: Spark's usual batches would be hundreds of megabytes.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
SMALL_BATCHES = BATCHES | {"spark.sql.parquet.columnarReaderBatchSize": "8"}
GOLD, M32 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFFFFFFFF)
WINDOW = 1 << 18
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def byte_values(seed: int) -> np.ndarray:
    """A number for each byte; A-Z as a-z."""
    out = mix((np.arange(256, dtype="u8") + np.uint64(seed << 32 | 1)) * GOLD)
    out[65:91] = out[97:123]
    return out


@functools.lru_cache(maxsize=4)
def powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and of its inverse."""
    root = int(GOLD) + (seed << 33)
    return tuple(np.cumprod(np.concatenate([np.ones(1, "u8"), np.full(n, r % (1 << 64), "u8")]), dtype="u8") for r in (root, pow(root, -1, 1 << 64)))


def words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, a, b): where words of bytes begin and 128 bits of hash of each; texts are cut at cuts."""
    space, edge = SPACE[data], np.zeros(len(data) + 1, bool)
    edge[cuts] = True
    start = np.flatnonzero(~space & (edge[:-1] | np.concatenate([[True], space[:-1]])))
    stop = np.flatnonzero(~space & (edge[1:] | np.concatenate([space[1:], [True]]))) + 1
    a, b = np.empty(len(start), "u8"), np.empty(len(start), "u8")
    bounds = np.unique(np.concatenate([np.searchsorted(start, np.arange(0, len(data), WINDOW)), [len(start)]]))
    for lo, hi in zip(bounds, bounds[1:]):
        at, end = start[lo], stop[hi - 1]
        for seed, out in ((1, a), (2, b)):
            up, down = powers(seed, max(WINDOW, 1 << int(end - at).bit_length()))
            sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(byte_values(seed)[data[at:end]] * up[: end - at], dtype="u8")])
            out[lo:hi] = mix((sums[stop[lo:hi] - at] - sums[start[lo:hi] - at]) * down[start[lo:hi] - at] + (stop[lo:hi] - start[lo:hi]).astype("u8"))
    return start, a, b


#: The token that ends every text; no word is a space.
END = tuple(int(mix(byte_values(s)[32:33] + np.uint64(1))[0]) for s in (1, 2))


class Tokens:
    """Tokens of some texts with their ends: hashes a and b, number of the text, place in it."""

    def __init__(self, texts: pa.Array):
        held = pc.fill_null(texts, "").cast(pa.large_binary())
        offsets = np.frombuffer(held.buffers()[1], "i8")[held.offset : held.offset + len(held) + 1]
        data = np.frombuffer(held.buffers()[2] or b"", "u1")[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        start, a, b = words(data, offsets)
        text = np.searchsorted(offsets[1:], start, "right")
        self.size = np.bincount(text, minlength=len(held)) + 1
        ends = np.cumsum(self.size) - 1
        self.a, self.b = (np.full(len(a) + len(held), e, "u8") for e in END)
        at = np.arange(len(a)) + text
        self.a[at], self.b[at] = a, b
        self.text = np.repeat(np.arange(len(held)), self.size)
        self.place = np.arange(len(self.a)) - np.repeat(ends - self.size + 1, self.size)

    def grams(self, order: int) -> list[np.ndarray]:
        """Hashes of the n-grams that end at each token, for n from 1 to order; of no meaning where the place is under n - 1."""
        out = [self.a]
        for _ in range(order - 1):
            out.append(mix(np.concatenate([np.zeros(1, "u8"), out[-1][:-1]]) * GOLD + self.a))
        return out


def groups(texts: pa.Array, size: int | None = None) -> Iterator[tuple[int, int]]:
    """Runs of texts of about so many bytes, by default GROUP_BYTES; a longer text stands alone."""
    size = size or GROUP_BYTES
    sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype="i8")])
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + size, "right")) - 1)
        yield at, end
        at = end


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view("i8"))


def counted(a: np.ndarray, b: np.ndarray | None = None) -> list[np.ndarray]:
    """Distinct keys with their counts, the last column; a key may come twice."""
    order = np.argsort(a)
    keys = [x[order] for x in (a, b) if x is not None]
    first = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in keys], axis=0)])) if len(a) else np.zeros(0, "i8")
    return [*(x[first] for x in keys), np.diff(np.concatenate([first, [len(a)]]))]


def word_counts(texts: DataFrame) -> DataFrame:
    """(a, b, n) of every distinct token of a text column."""

    def run(batches):
        for batch in batches:
            for at, end in groups(batch.column(0)):
                t = Tokens(batch.column(0).slice(at, end - at))
                a, b, n = counted(t.a, t.b)
                yield pa.RecordBatch.from_arrays([signed(a), signed(b), pa.array(n)], ["a", "b", "n"])

    return texts.mapInArrow(tidy(run), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype("i8")


def gram_counts(texts: DataFrame, order: int, buckets: int) -> DataFrame:
    """(bucket, hash, n) of n-grams of two tokens and more, counted by parts of a task."""

    def told(held):
        hashes, n = counted(np.concatenate(held))
        return pa.RecordBatch.from_arrays([pa.array(bucket_of(hashes, buckets)), signed(hashes), pa.array(n)], ["bucket", "hash", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for at, end in groups(batch.column(0)):
                t = Tokens(batch.column(0).slice(at, end - at))
                for n, gram in enumerate(t.grams(order)[1:], 1):
                    held.append(gram[t.place >= n])
                    size += len(held[-1])
                if size >= COUNTED:
                    yield told(held)
                    held, size = [], 0
        if size:
            yield told(held)

    return texts.mapInArrow(tidy(run), "bucket long, hash long, n long")


def spots(hashes: np.ndarray, level: int, size) -> Iterator[np.ndarray]:
    """The bits of n-grams at a level, in buckets of size bits."""
    x = mix(hashes + np.uint64(level * int(GOLD) % (1 << 64)))
    low, step, size = x & M32, (x >> np.uint64(32)) | np.uint64(1), np.asarray(size).astype("u8")
    for i in range(HASHES):
        yield ((low + np.uint64(i) * step) & M32) * size >> np.uint64(32)


def bucket_bits(hashes: np.ndarray, n: np.ndarray) -> bytes:
    """The filter of one bucket; its size follows from what is put in."""
    levels = np.searchsorted(LOWER, n, "right")
    flags = np.zeros(-(-int(levels.sum()) * BITS // 64) * 64, bool)
    for level in range(1, int(levels.max()) + 1):
        for at in spots(hashes[levels >= level], level, len(flags)):
            flags[at] = True
    return np.packbits(flags, bitorder="little").tobytes()


def filter_table(counts: DataFrame) -> DataFrame:
    """(bucket, bits) from (bucket, hash, n): the counts of a bucket meet in one task, sorted by bucket, and leave as bits."""

    def run(batches):
        now, held = None, []
        for batch in batches:
            bucket, hashes, n = batch.column(0).to_numpy(), batch.column(1).to_numpy().view("u8"), batch.column(2).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            ready = []
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if bucket[lo] != now and held:
                    ready.append((now, bucket_bits(*map(np.concatenate, zip(*held)))))
                    held = []
                now = int(bucket[lo])
                held.append((hashes[lo:hi], n[lo:hi]))
            if ready:
                yield pa.RecordBatch.from_pylist([{"bucket": k, "bits": v} for k, v in ready])
        if held:
            yield pa.RecordBatch.from_pylist([{"bucket": now, "bits": bucket_bits(*map(np.concatenate, zip(*held)))}])

    dealt = counts.repartition("bucket").groupBy("bucket", "hash").agg(F.sum("n").alias("n"))
    return dealt.sortWithinPartitions("bucket").mapInArrow(tidy(run), "bucket long, bits binary")


class Filter:
    """Buckets of a filter side by side; buckets is how many there are in all."""

    def __init__(self, ids: np.ndarray, bits: list[bytes], buckets: int, first: int = 0, span: int | None = None):
        self.buckets, self.first = buckets, first
        self.size, self.base = (np.zeros(buckets if span is None else span, "i8") for _ in range(2))
        lengths = np.array([len(x) for x in bits], "i8")
        self.size[ids - first] = lengths * 8
        self.base[ids - first] = np.cumsum(lengths) - lengths
        self.bits = np.frombuffer(b"".join(bits), "u1")

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """The level of each n-gram: probes until one is missing."""
        out, own = np.zeros(len(hashes), "u1"), bucket_of(hashes, self.buckets) - self.first
        left = np.flatnonzero(self.size[own] > 0)
        for level in range(1, len(LOWER)):
            size, base = self.size[own[left]], self.base[own[left]]
            hit = np.ones(len(left), bool)
            for at in spots(hashes[left], level, size):
                hit &= self.bits[base + (at >> np.uint64(3)).astype("i8")] >> (at & np.uint64(7)).astype("u1") & 1 == 1
            left = left[hit]
            if not len(left):
                break
            out[left] = level
        return out


class Looked:
    """Levels that were looked up before, of ascending hashes."""

    def __init__(self, hashes: np.ndarray, levels: np.ndarray):
        self.hashes, self.known = hashes, levels

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        return self.known[np.searchsorted(self.hashes, hashes)]


def ascending(hashes: list[np.ndarray]) -> np.ndarray:
    """The distinct ones in order; np.unique(), which fills a hash table first, takes twenty times as long."""
    x = np.sort(np.concatenate(hashes))
    return x[np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]])]


def distinct_grams(tokens: list[Tokens], order: int) -> np.ndarray:
    """The distinct n-grams of up to order tokens of some texts, ascending."""
    return ascending([g for t in tokens for g in t.grams(order)])


def packed(hashes: np.ndarray) -> bytes:
    """Ascending hashes as differences, byte by byte: the upper bytes, nearly all 0, compress."""
    return np.ascontiguousarray(np.diff(hashes, prepend=np.uint64(0)).view("u1").reshape(-1, 8).T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, "u1").reshape(8, -1).T).view("u8").ravel(), dtype="u8")


class Scorer:
    """Scores of texts, from levels of n-grams and counts of frequent words."""

    NAMES = ["n_tokens", "n_known", "base_score", "score", "rare"]
    DDL = "n_tokens long, n_known long, base_score double, score double, rare array<struct<a: long, b: long, times: long>>"

    def __init__(self, tokens: int, types: int, frequent: tuple[np.ndarray, np.ndarray, np.ndarray], order: int, prior: float):
        self.floor, self.order, self.prior, self.frequent = float(tokens + types + 1), order, prior, frequent

    def score(self, texts: pa.Array, source) -> list[pa.Array]:
        """Columns NAMES. n_known and base_score leave out the rare words, which come as lists with times."""
        return self.of_tokens(Tokens(texts), source)

    def of_piece(self, texts: pa.Array, levels: np.ndarray) -> pa.Table:
        """score() of a piece of any size, from the levels of its distinct_grams() in order; each text is cut and hashed once."""
        tokens = [Tokens(texts.slice(at, end - at)) for at, end in groups(texts)]
        source = Looked(distinct_grams(tokens, self.order), levels)
        return pa.concat_tables([pa.table(self.of_tokens(t, source), self.NAMES) for t in tokens])

    def of_tokens(self, t: Tokens, source) -> list[pa.Array]:
        texts_n = len(t.size)
        distinct, first, inverse = np.unique(t.a, return_index=True, return_inverse=True)
        levels = source.levels(distinct)
        p, held = None, None
        for n, gram in enumerate(t.grams(self.order)):
            if n == 0:
                c = EXPECTED[levels][inverse]
                p = (c + 1) / self.floor
            else:
                u, back = np.unique(gram, return_inverse=True)
                c = np.where(t.place >= n, EXPECTED[source.levels(u)][back], 0.0)
                context = np.where(t.place >= n, np.maximum(np.concatenate([[0.0], held[:-1]]), c), 0.0)
                p = (c + self.prior * p) / (context + self.prior)
            held = c
        a, b, n = self.frequent
        at = np.minimum(np.searchsorted(a, distinct), max(0, len(a) - 1))
        often = (a[at] == distinct) & (b[at] == t.b[first]) if len(a) else np.zeros(len(distinct), bool)
        base = np.log10((np.where(often, n[at] if len(a) else 0, 0) + 1) / self.floor)
        same = t.b == t.b[first][inverse]
        often, unseen = often[inverse] & same, (levels == 0)[inverse]
        rare = np.flatnonzero(~often & ~unseen)
        sums = lambda w: np.bincount(t.text, weights=w, minlength=texts_n)
        known, based = sums(often), sums(np.where(often | unseen, np.where(unseen, -np.log10(self.floor), base[inverse]), 0.0))
        return [pa.array(t.size.astype("i8")), pa.array(known.astype("i8")), pa.array(based), pa.array(sums(np.log10(p))), rare_lists(t, rare, texts_n)]


def rare_lists(t: Tokens, rare: np.ndarray, texts: int) -> pa.ListArray:
    """For each text its rare words, each once with its times."""
    order = rare[np.lexsort((t.a[rare], t.text[rare]))]
    keys = t.text[order], t.a[order], t.b[order]
    first = np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in keys], axis=0)])) if len(order) else np.zeros(0, "i8")
    times = np.diff(np.concatenate([first, [len(order)]])).astype("i8")
    offsets = np.searchsorted(keys[0][first], np.arange(texts + 1)).astype("i4")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([signed(keys[1][first]), signed(keys[2][first]), pa.array(times)], ["a", "b", "times"]))


def in_training(id_col: str, folds: int, out: int) -> Column:
    """Whether crc32 of the id as text leaves another remainder than the one held out; so for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds != out, F.lit(True))


def lm_score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, out: int = 2, order: int = 2, prior: float = 64.0, max_filter_bytes: int = MAX_FILTER_BYTES, carry: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row, with the columns in carry.

    Words are runs of other bytes than space and \\t to \\r, A-Z in lower case; an end follows each text and counts as a token. The model learns
    from all rows but those held out: crc32(id) mod folds is out; a null id is never held out. Null and empty texts are an end
    alone. Rows that repeat count each time. base_score: add-one from exact counts; score: log10 probability by n-grams of up to order tokens,
    interpolated with prior. Where nothing was learned, all probabilities are 1. An empty table has no rows. Other columns are ignored.
    """
    spark, carry = df.sparkSession, carry or []
    kinds = carried(df, carry, ["doc_id", "held_out", "train_tokens", "_text", "_row", *Scorer.NAMES])
    learn = in_training(id_col, folds, out)
    texts = df.where(learn).select(text_col)
    with settings(spark, BATCHES):
        vocabulary = materialize(word_counts(texts), "words")
    tokens, types = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    often = vocabulary.where(F.col("n") * FREQUENT > tokens).toPandas()
    often = often.iloc[np.argsort(often["a"].to_numpy().view("u8"))]
    frequent = often["a"].to_numpy().view("u8"), often["b"].to_numpy().view("u8"), often["n"].to_numpy()
    buckets = max(1, tokens // BUCKET_TOKENS)
    own = vocabulary.select(F.shiftrightunsigned(F.shiftrightunsigned("a", 32) * buckets, 32).alias("bucket"), F.col("a").alias("hash"), "n")
    with settings(spark, BATCHES):
        bits = materialize(filter_table(own if order == 1 else own.unionByName(gram_counts(texts, order, buckets))), "filter")
    free_shuffles(spark)

    asked = df.select(F.col(id_col).alias("doc_id"), (~learn).alias("held_out"), *carry, F.col(text_col).alias("_text"))
    ddl = f"doc_id {dict(df.dtypes)[id_col]}, held_out boolean, {kinds}{Scorer.DDL}"
    scorer = spark.sparkContext.broadcast(Scorer(tokens, types, frequent, order, prior))
    bytes_ = bits.agg(F.coalesce(F.sum(F.octet_length("bits")), F.lit(0)) + F.lit(16 * buckets)).first()[0]
    sent = [scorer]
    if bytes_ <= max_filter_bytes:
        sent.append(spark.sparkContext.broadcast(whole_filter(bits, buckets)))
        scored, dealt = by_broadcast(asked, scorer, sent[1], ddl), []
    else:
        scored, dealt = by_join(asked, bits, buckets, bytes_, scorer, ddl)
    with settings(spark, BATCHES if bytes_ <= max_filter_bytes else SMALL_BATCHES):
        scored = materialize(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    for x in sent:
        x.destroy()
    discard(bits, *dealt)
    free_shuffles(spark)

    rare = scored.select("_row", F.explode("rare").alias("x")).select("_row", "x.a", "x.b", "x.times")
    found = rare.join(vocabulary, ["a", "b"], "left")
    base = F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(tokens + types + 1)))
    sums = found.groupBy("_row").agg(F.sum(F.col("times") * base).alias("_base"), F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("_known"))
    whole = scored.join(sums, "_row", "left")
    n_known, base_score = F.col("n_known") + F.coalesce("_known", F.lit(0)), F.col("base_score") + F.coalesce("_base", F.lit(0.0))
    return whole.select("doc_id", "held_out", *carry, "n_tokens", n_known.alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base_score.alias("base_score"), "score")


def whole_filter(bits: DataFrame, buckets: int) -> Filter:
    """The filter in one piece; the caller has checked its size."""
    held = bits.toArrow()
    return Filter(held["bucket"].to_numpy(), held["bits"].to_pylist(), buckets)


def by_broadcast(asked: DataFrame, scorer, told, ddl: str) -> DataFrame:
    """Scores with the whole filter, a broadcast of it, in every worker."""

    def run(batches):
        for batch in batches:
            *rest, texts = batch.columns
            for at, end in groups(texts):
                columns = scorer.value.score(texts.slice(at, end - at), told.value)
                yield pa.RecordBatch.from_arrays([*(c.slice(at, end - at) for c in rest), *columns], [*batch.schema.names[:-1], *Scorer.NAMES])

    return asked.mapInArrow(tidy(run), ddl)


def by_join(asked: DataFrame, bits: DataFrame, buckets: int, bytes_: int, scorer, ddl: str) -> tuple[DataFrame, list[DataFrame]]:
    """Scores with a filter of any size, and the tables to discard once they are written. Texts are dealt into pieces of about PIECE_BYTES; the distinct n-grams of a piece, in order of hash, go to the parts
    of the filter that they fall in, one row a part, and their levels come back in the same order, a byte each. A part is sent to several groups of
    pieces, so that no group has more than a few million n-grams, however common one is."""
    order, columns = scorer.value.order, asked.columns
    span = max(1, buckets * PART_BYTES // bytes_)

    def pieces(batches):
        task, n = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            rows = pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema))
            for at, end in groups(batch.column(len(columns) - 1), PIECE_BYTES):
                n += 1
                yield pa.RecordBatch.from_arrays([pa.array([task + n]), pa.ListArray.from_arrays(pa.array([0, end - at], pa.int32()), rows.slice(at, end - at))], ["piece", "rows"])

    def distinct(texts: pa.Array) -> np.ndarray:
        return ascending([distinct_grams([Tokens(texts.slice(at, end - at))], order) for at, end in groups(texts)])

    def ask(batches):
        for batch in batches:
            for i, piece in enumerate(batch.column(0).to_pylist()):
                hashes = distinct(batch.column(1)[i].values.field("_text"))
                part = bucket_of(hashes, buckets) // span
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
                asking = [{"piece": piece, "part": int(part[lo]), "hashes": packed(hashes[lo:hi])} for lo, hi in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_pylist(asking, pa.schema([("piece", pa.int64()), ("part", pa.int64()), ("hashes", pa.binary())]))

    def look(asking, parts):
        first = asking["part"][0].as_py() * span if asking.num_rows else 0
        held = parts if asking.num_rows else parts.slice(0, 0)
        part = Filter(held["bucket"].to_numpy(), held["bits"].to_pylist(), buckets, first, span)
        levels = [part.levels(unpacked(h)).tobytes() for h in asking["hashes"].to_pylist()]
        return pa.table({"piece": asking["piece"], "part": asking["part"], "levels": pa.array(levels, pa.binary())})

    def score(piece, known):
        rows = piece["rows"].combine_chunks().flatten()
        # Parts are in order of hash, so their levels are, one after another, those of the piece's distinct n-grams.
        found = scorer.value.of_piece(rows.field("_text"), np.frombuffer(b"".join(known.sort_by("part")["levels"].to_pylist()), "u1"))
        return pa.table([*(rows.field(c) for c in columns[:-1]), *found.columns], [*columns[:-1], *Scorer.NAMES])

    inner = ", ".join(f"`{c}`: {t}" for c, t in asked.dtypes)
    with settings(asked.sparkSession, BATCHES):
        dealt = materialize(asked.mapInArrow(tidy(pieces), f"piece long, rows array<struct<{inner}>>"), "pieces", compression="zstd")
    salts = max(1, dealt.count() * span // (LOOKED * buckets))
    asking = dealt.mapInArrow(tidy(ask), "piece long, part long, hashes binary").withColumn("salt", F.pmod(F.xxhash64("piece"), F.lit(salts)))
    sent = bits.withColumn("part", F.floor(F.col("bucket") / span)).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    # A part without any bucket has no group on the other side; look() then finds no level.
    with settings(asked.sparkSession, SMALL_BATCHES):
        levels = materialize(asking.groupBy("part", "salt").cogroup(sent.groupBy("part", "salt")).applyInArrow(look, "piece long, part long, levels binary"), "levels")
    free_shuffles(asked.sparkSession)
    return dealt.groupBy("piece").cogroup(levels.groupBy("piece")).applyInArrow(score, ddl), [dealt, levels]
