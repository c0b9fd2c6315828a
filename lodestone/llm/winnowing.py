"""Document fingerprints by winnowing; DataFrame functions only.

A text is cut into words (of a long word, pieces of at most WORD characters), each run of K words is
hashed, and of every WINDOW hashes in a row the least is kept, the rightmost of equal ones, with its
position. Any run of WINDOW + K - 1 words that two texts share gives both a common fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import let, range_of

K, WINDOW, WORD = 5, 8, 16
LAST = (1 << 31) - 1


def _packed(hash_: Column, position: Column) -> Column:
    """31 bits of hash, then the position counted backwards: the least value is the least hash furthest right."""
    return F.shiftleft(hash_.bitwiseAND(LAST), 32) + (F.lit(LAST).cast("long") - position)


def _sliding_least(values: Column, width: int) -> Column:
    """At each place the least of the next width values, of fewer at the end; by doubling."""

    def merged(v: Column, by: int) -> Column:
        return F.zip_with(v, F.slice(v, by + 1, F.greatest(F.size(v), F.lit(1))), lambda a, b: F.least(a, b))

    def step(v: Column, have: int) -> Column:
        if have == width:
            return v
        by = min(have, width - have)
        return let(merged(v, by), lambda x: step(x, have + by))

    return step(values, 1)


def fingerprint(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """array<bigint> of the kept hashes with positions, in order of position; empty for a text without words.

    A text of fewer than k words has one hash, of all of them.
    """

    def hashes(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - k + 1, F.lit(1)))
        return F.transform(starts, lambda i: _packed(F.xxhash64(F.slice(words, i, k)), i.cast("long")))

    def chosen(grams: Column) -> Column:
        least = _sliding_least(grams, window)
        return F.array_distinct(F.slice(least, F.lit(1), F.greatest(F.size(grams) - window + 1, F.lit(1))))

    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit(rf"\S{{1,{WORD}}}"), F.lit(0)), lambda w: F.xxhash64(w))
    empty = F.array().cast("array<bigint>")
    return let(words, lambda w: F.when(F.size(w) == 0, empty).otherwise(let(hashes(w), chosen)))


def shown(prints: Column) -> Column:
    """hash:position of each fingerprint, hashes in hexadecimal, positions from 0."""
    return F.array_join(F.transform(prints, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, 32))), F.lit(":"), (F.lit(LAST - 1).cast("long") - x.bitwiseAND(LAST)).cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of the hashes of two fingerprints; two empty ones are alike."""
    hashes = lambda p: F.array_distinct(F.transform(p, lambda x: F.shiftright(x, 32)))

    def of(x: Column, y: Column) -> Column:
        return let(F.size(F.array_intersect(x, y)), lambda n: F.when(F.size(x) + F.size(y) == 0, F.lit(1.0)).otherwise(n / (F.size(x) + F.size(y) - n)))

    return let(hashes(a), lambda x: let(hashes(b), lambda y: of(x, y))).cast("double")


def document_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id and prints (array<bigint>, see fingerprint()) for every row; null text counts as empty. Other columns are ignored."""
    return df.select(F.col(id_col).alias("doc_id"), fingerprint(F.coalesce(F.col(text_col), F.lit("")), k, window).alias("prints"))


def with_next(docs: DataFrame, columns: list[str], added: dict[str, Column] | None = None, buckets: int | None = None) -> DataFrame:
    """docs (doc_id, text, ...) and the added columns, with next_ of each of columns: its value in the row of the next smaller doc_id; after the smallest, the largest.

    Rows are dealt by range of doc_id. A copy of each range's first row follows the last row of the
    range before it, so ranges need nothing from each other. Of rows with one id, the
    order is that of a hash of the text; null ids come last.
    """
    spark = docs.sparkSession
    buckets = buckets or min(8192, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    found = ids.select(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 100_000)).first()[0]
    bucket = range_of(F.col("doc_id"), sorted(set(found or [])))
    heads = ids.groupBy(bucket.alias("bucket")).agg(F.max("doc_id").alias("head")).orderBy(F.col("bucket").desc()).collect()
    # At most one row a range.
    after = [(heads[(i + 1) % len(heads)]["head"], h["bucket"]) for i, h in enumerate(heads)]
    links = spark.createDataFrame(after, "head long, to_bucket int")
    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    own = rows.withColumns({"bucket": bucket, "real": F.lit(True)})
    copies = rows.join(F.broadcast(links), F.col("doc_id").eqNullSafe(F.col("head"))).drop("head").withColumnRenamed("to_bucket", "bucket").withColumn("real", F.lit(False))
    order = Window.partitionBy("bucket").orderBy(F.col("real").desc(), F.col("doc_id").desc_nulls_last(), "tie")
    # Columns are added after the copies are chosen, so nothing is computed for rows that are not.
    both = own.unionByName(copies).withColumns({"tie": F.xxhash64("text"), **(added or {})})
    return both.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where("real").drop("real", "tie", "bucket")


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """One row a document: its fingerprint, that of its edited text, and how alike they and the next document's are.

    The edited text has the last half of the code points replaced by the first as many of the next document
    (descending id; after the last, the first). Null text is empty; a lone document is its own next. Repeated
    ids give a row each. Other columns are ignored.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    both = with_next(docs, ["text", "prints"], {"prints": fingerprint(F.col("text"), k, window)}).select("doc_id", n.cast("long").alias("n_chars"), "prints", "next_prints", let(edited, lambda e: F.struct(F.sha2(e, 256).alias("sha"), fingerprint(e, k, window).alias("prints"))).alias("edited"))
    return both.select(
        "doc_id", "n_chars", F.col("edited.sha").alias("edited_sha256"), shown(F.col("prints")).alias("fingerprint"), shown(F.col("edited.prints")).alias("edited_fingerprint"),
        likeness(F.col("prints"), F.col("edited.prints")).alias("near_edited"), likeness(F.col("prints"), F.col("next_prints")).alias("near_next"),
    )
