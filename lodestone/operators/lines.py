"""Operators on the lines and pages of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.storage import written
from lodestone.functions.text import let, strip


def line_table(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, line_no, line), line numbers from 1."""
    return df.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def repeated_over_pages(pages: DataFrame, key: str, text_col: str = "text", share: int = 35, least_pages: int = 5, shortest: int = 6, longest: int = 200) -> DataFrame:
    """(key, line, n): stripped lines that occur at least max(3, share percent of the pages) times in a document of enough pages.

    Every occurrence counts, also several on a page. Counting is partial before the shuffle, so a document with most of the rows is no hot task.
    """
    lines = pages.select(key, F.explode(F.split(text_col, "\n")).alias("line")).select(key, strip(F.col("line")).alias("line"))
    counts = lines.where(F.length("line").between(shortest, longest)).groupBy(key, "line").agg(F.count("*").alias("n"))
    sizes = pages.groupBy(key).agg(F.count("*").alias("pages"))
    often = F.greatest(F.lit(3), F.floor(F.col("pages") * share / 100))
    return counts.where("n >= 3").join(sizes.where(F.col("pages") >= least_pages), key).where(F.col("n") >= often).select(key, "line", "n")


def without_repeats(pages: DataFrame, key: str, text_col: str = "text", **limits) -> DataFrame:
    """pages with the lines of repeated_over_pages() taken out of each page. The lines of one document are few: each holds a share of its pages."""
    gone = repeated_over_pages(pages, key, text_col, **limits).groupBy(key).agg(F.collect_set("line").alias("_gone"))
    kept = F.filter(F.split(text_col, "\n"), lambda x: ~F.array_contains("_gone", strip(x)))
    return pages.join(gone, key, "left").withColumn(text_col, F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))).drop("_gone")


def sums_before(df: DataFrame, doc: str, order: str, values: dict[str, Column], parts: int | None = None) -> DataFrame:
    """(doc, order, and for each value the sum over the document's rows before this one), whatever the size of a document.

    Rows are dealt by ranges of (doc, order) and written once; a document's ranges add up their own sums, offsets are running sums over
    those few rows, and windows stay within a range. order must be unique in a document.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.select(doc, order, *[v.alias(n) for n, v in values.items()]).repartitionByRange(parts, doc, order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(doc).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(doc, "_part").agg(*[F.sum(n).alias(n) for n in values])
    offsets = sums.select(doc, "_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in values])
    inside = Window.partitionBy(doc, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.select(doc, order, "_part", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(n) for n in values])
    return own.join(offsets, [doc, "_part"]).select(doc, order, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in values])


def char_ranges(pages: DataFrame, doc: str, order: str, text_col: str = "text", gap: int = 2) -> DataFrame:
    """(doc, order, page, start, end): the number of each page, from 1, and where it stands when pages are joined by gap characters. Texts are not moved."""
    n = F.coalesce(F.length(text_col), F.lit(0)).cast("long")
    sized = pages.select(doc, order, n.alias("_n"))
    before = sums_before(sized, doc, order, {"page": F.lit(1).cast("long"), "start": F.col("_n") + gap})
    return before.join(sized, [doc, order]).select(doc, order, (F.col("page") + 1).alias("page"), "start", (F.col("start") + F.col("_n")).alias("end"))


def span_pages(spans: DataFrame, ranges: DataFrame, doc: str, page: str, width: int = 4096) -> DataFrame:
    """The first and last page that each span (doc, span_id, from, to) touches, both ends included.

    Both sides are put into bins of so many characters, so that a span meets only pages near it; a pair meets in the first bin that both have.
    """
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    left, right = spans.withColumn("_bin", bins("from", "to")), ranges.select(doc, page, "start", "end", bins("start", "end").alias("_bin"))
    first = F.floor(F.greatest("start", "from") / width)
    overlaps = (F.col("start") <= F.col("to")) & (F.col("end") >= F.col("from")) & (F.col("_bin") == first)
    return left.join(right, [doc, "_bin"]).where(overlaps).groupBy(doc, "span_id").agg(F.min(page).alias("page_start"), F.max(page).alias("page_end"))


def pages_of_text(text: Column, size: int) -> Column:
    """array<struct<page, text>>: pieces of so many lines, for trying page operators on plain documents."""
    lines = F.split(text, "\n")
    return let(lines, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / size).cast("int")), lambda i: F.struct((i + 1).alias("page"), F.array_join(F.slice(x, i * size + 1, F.lit(size)), "\n").alias("text"))))
