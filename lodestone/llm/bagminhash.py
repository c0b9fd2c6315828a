"""Near-dedup by BagMinHash: weighted Jaccard over multisets of word shingles.

A shingle of weight w owns the points below w of a Poisson process over weight and time that its hash
seeds. The process is made of dyadic pieces of the weight axis, [0,1), [1,2), [2,4), ..., so a
heavy shingle costs the logarithm of its weight; inside a piece, points above w are thinned away. Each
point belongs to one of M components; a component's signature is its earliest point. Two multisets
agree in a component with a chance of their weighted Jaccard similarity. Bands of the signature give
candidates, whose overlap is then computed exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import bloom
from lodestone.llm.common import heavy_join, materialize, tidy, unused, worker_cache
from lodestone.llm.linking import MAX_FILTER_BYTES, Get, Test, link, only

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
M = BANDS * ROWS
#: Bits of 128 (one for each component, the rest zero) in which a pair of similarity 0.8 differs: 12 on average, 27 at over four deviations.
NEAR_BITS = 27
ONE = np.uint64(0x9E3779B97F4A7C15)
STEP = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, on unsigned integers that wrap around."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def times(n: int) -> np.uint64:
    return np.uint64(STEP * n & (1 << 64) - 1)


def unit(x: np.ndarray) -> np.ndarray:
    """(0, 1] of 64-bit hashes."""
    return ((x >> np.uint64(11)).astype("f8") + 1) * 2.0**-53


class Words(dict):
    """word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found



def shingles(texts: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document index, shingle hash, weight) of the distinct shingles of each text, by document and hash, and words of each text.

    Words are lower-cased and split at white space. A text of fewer than k words has one shingle, of all of them.
    """
    known = worker_cache("words", Words)
    words = [t.lower().split() for t in texts]
    counts = np.array([len(w) for w in words], "i8")
    padded = np.maximum(counts, np.where(counts > 0, k, 0))
    starts = np.cumsum(padded) - padded
    flat = np.zeros(int(padded.sum()) + k, "u8")
    for w, at in zip(words, starts.tolist()):
        flat[at : at + len(w)] = np.fromiter(map(known.__getitem__, w), "u8", len(w))
    n = np.maximum(padded - k + 1, 0)
    doc = np.repeat(np.arange(len(texts)), n)
    first = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts, n)
    value = np.zeros(len(first), "u8")
    for j in range(k):
        value = mixed(value * np.uint64(3) + flat[first + j] + ONE)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return doc[at], value[at], np.diff(np.append(at, len(doc))), counts


def signatures(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, documents: int, m: int = M) -> np.ndarray:
    """(documents x m) 64-bit components; a document without shingles has the greatest value everywhere.

    Points are made up to a time by which all components have most likely seen one; documents for which that is too
    early are done again up to a later time.
    """
    earliest = np.full((documents, m), np.inf)
    total = np.bincount(doc, weight, documents)
    todo, factor = np.flatnonzero(total > 0), np.log(m) + 6
    while len(todo):
        until = np.zeros(documents)
        until[todo] = factor * m / total[todo]
        chosen = until[doc] > 0
        d, v, w = doc[chosen], value[chosen], weight[chosen]
        piece, low, width = 0, 0, 1
        while len(d):
            key, time, point, owner, w_left = mixed(v + times(piece + 1)), np.zeros(len(d)), 0, d, w
            while len(owner):
                point += 1
                draw = mixed(key + times(2 * point))
                time = time - np.log(unit(draw)) / width
                alive = time <= until[owner]
                key, time, owner, w_left = key[alive], time[alive], owner[alive], w_left[alive]
                place = mixed(draw[alive] ^ ONE)
                kept = low + np.floor((place >> np.uint64(32)).astype("f8") * 2.0**-32 * width) < w_left
                np.minimum.at(earliest, (owner[kept], ((place[kept] & np.uint64(0xFFFFFFFF)) * np.uint64(m) >> np.uint64(32)).astype("i8")), time[kept])
            low, width, piece = low + width, width * 2 if low else 1, piece + 1
            more = w > low
            d, v, w = d[more], v[more], w[more]
        todo = todo[np.isinf(earliest[todo]).any(axis=1)]
        factor *= 2
    return earliest.view("u8")


def similarity(a: dict, b: dict) -> float:
    """Weighted Jaccard similarity of two multisets, by definition."""
    least = sum(min(n, b.get(k, 0)) for k, n in a.items())
    return least / max(1, sum(a.values()) + sum(b.values()) - least)


SIGNED = "doc_id long, content binary, bands array<bigint>, s0 long, s1 long"


def sign_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, content (hash of the words in order; null where there are none), bands, and a bit of each component in s0 and s1."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                part = batch.slice(at, 400)
                texts = [t or "" for t in part.column(1).to_pylist()]
                doc, value, weight, counts = shingles(texts)
                signed = mixed(signatures(doc, value, weight, len(texts)))
                content = [xxhash.xxh128_digest(" ".join(t.lower().split()).encode("utf-8", "surrogatepass")) if n else None for t, n in zip(texts, counts)]
                bands = np.zeros((len(texts), BANDS), "u8")
                for r in range(ROWS):
                    bands = mixed(bands * np.uint64(3) + signed[:, r::ROWS] + np.arange(BANDS, dtype="u8"))
                bits = np.zeros((len(texts), 128), "u1")
                bits[:, :M] = signed & np.uint64(1)
                packed = np.packbits(bits, axis=1).view(">i8").astype("i8")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype="i4") * BANDS), pa.array(bands.view("i8").ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(content, pa.binary()), lists, pa.array(packed[:, 0]), pa.array(packed[:, 1])], ["doc_id", "content", "bands", "s0", "s1"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), SIGNED)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """item, grams of rows (item, text): the multiset as a set of 32-bit hashes, each further copy of a shingle with one of its own.

    Of n shingles of a text, n * n / 2**33 meet by chance, which moves a similarity by less than n / 2**32.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                part = batch.slice(at, 400)
                doc, value, weight, _ = shingles([t or "" for t in part.column(1).to_pylist()])
                copy = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
                grams = (mixed(np.repeat(value, weight) + copy.astype("u8") * ONE) >> np.uint64(32)).astype("u4").view("i4")
                sizes = np.bincount(doc, weight, part.num_rows).astype("i8")
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype("i4")), pa.array(grams))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["item", "grams"])

    return docs.select("item", "text").mapInArrow(tidy(run), "item long, grams array<int>")


def near(limit: int) -> Test:
    """Whether the sampled bits of two documents differ in at most so many places."""
    return lambda a, b: F.bit_count(a("s0").bitwiseXOR(b("s0"))) + F.bit_count(a("s1").bitwiseXOR(b("s1"))) <= limit


def alike(threshold: float = SIMILARITY) -> Test:
    """Whether two multisets of total members, of which grams may be in both, overlap enough; sizes that rule it out are looked at first."""

    def of(a: Get, b: Get) -> Column:
        n, m = a("total"), b("total")
        least = threshold * (n + m) - 1e-9
        # The least common count at which common / (n + m - common) reaches the threshold.
        enough = lambda common: common * (1 + threshold) >= least
        may = (F.least(n, m) >= threshold * F.greatest(n, m)) & enough(F.least(F.size(a("grams")), F.size(b("grams"))))
        return F.when(may, enough(F.size(F.array_intersect(a("grams"), b("grams"))))).otherwise(F.lit(False))

    return of


def held_by_several(known: DataFrame) -> DataFrame:
    """item, grams, total of rows (item, grams, total): grams without those of one row alone, which are common to no pair."""
    each = known.select("item", F.explode("grams").alias("gram"))
    alone = each.groupBy("gram").agg(F.count("*").alias("n"), F.min("item").alias("item")).where("n = 1").groupBy("item").agg(F.collect_list("gram").alias("alone"))
    return known.join(alone, "item", "left").select("item", F.when(F.col("alone").isNull(), F.col("grams")).otherwise(F.array_except("grams", "alone")).alias("grams"), "total")


def reach(threshold: float) -> tuple[Column, Column, Column]:
    """The total of a multiset, and the least and the greatest total of others that it can be alike to, given grams."""
    n = F.col("total")
    return n, n * threshold - 1e-6, F.size("grams") * (1 + threshold) / threshold - n + 1e-6


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, copy_of, class_id for every row. A threshold below SIMILARITY, for which the bands are made, is refused.

    copy_of is the least id with the same words; class_id is the least id of all documents that links of at least
    the threshold join, so the one document to keep has class_id equal to doc_id. Texts without words and null
    texts are alike to nothing, and null ids have null classes. Rows with one id are one document, whose texts are all
    linked. Other columns are ignored. Copies collapse before the search, so they cost no pairs.
    """
    if threshold < SIMILARITY:
        raise ValueError(f"the bands find pairs of at least {SIMILARITY}")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialize(sign_documents(docs), "signed")
    rows = signed.count()
    groups = materialize(signed.where("content is not null and doc_id is not null").groupBy("content").agg(F.min("doc_id").alias("item"), F.count("*").alias("n")), "groups")
    placed = materialize(heavy_join(signed.select("doc_id", "content"), groups.where("n > 1"), "content", F.col("n"), rows).select("doc_id", "content", F.when(F.col("doc_id").isNotNull(), F.coalesce("item", "doc_id")).alias("item")), "placed")
    own = placed.where("content is not null and doc_id = item").select("doc_id").distinct()
    heads = materialize(signed.where("content is not null").join(own, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("item"), "bands", "s0", "s1"), "heads")
    bands = heads.select("item", F.explode("bands").alias("key"), "s0", "s1")

    def fetch(items: DataFrame) -> DataFrame:
        texts = docs.select(F.col("doc_id").alias("item"), "text")
        return shingle_sets(only(texts, items, items.count()).groupBy("item").agg(F.max("text").alias("text"))).withColumn("total", F.size("grams"))

    labels = link(bands, near(NEAR_BITS), fetch, ["grams", "total"], alike(threshold), ratio=threshold, reach=reach(threshold), narrow=held_by_several)
    named = labels.select(F.col("item"), F.col("label"))
    sizes = materialize(placed.groupBy("item").agg(F.count("*").alias("of_item")).join(named, "item"), "classes")
    return heavy_join(placed, sizes, "item", F.col("of_item"), max(1, rows)).select("doc_id", F.col("item").alias("copy_of"), F.coalesce("label", "item").alias("class_id"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """The rows of df, all columns, of the one document of each class that stays; see near_dedup().

    Rows with null ids stay. A Bloom filter of the ids that go lets most other rows through without a shuffle.
    """
    name, maybe = unused("_going", df.columns), unused("_maybe", df.columns)
    going = materialize(near_dedup(df, id_col, text_col, threshold).where("class_id <> doc_id").select(F.col("doc_id").alias(name)).distinct(), "going")
    bits = bloom.size_for(max(1, going.count()), 16, MAX_FILTER_BYTES)
    probed = bloom.probe(df, bloom.of_keys(going, name, bits), F.col(id_col).cast("long"), bits, maybe)
    sure = probed.where(~F.col(maybe)).drop(maybe)
    rest = probed.where(F.col(maybe)).drop(maybe)
    return sure.unionByName(rest.join(going, F.col(id_col) == F.col(name), "left_anti"))
