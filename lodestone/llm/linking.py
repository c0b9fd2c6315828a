"""From shared keys to classes of linked items, without all pairs of a group and without the driver.

Items are longs. An item has several keys (bands of a signature, parts of a line) and a sketch: a few
columns from which near() tells pairs that cannot be alike.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import bloom
from lodestone.llm.common import HEAVY_SHARE, discard, free_shuffles, heavy_join, materialize

MAX_FILTER_BYTES = 64 << 20
MANY_PAIRS = 5000
#: Keys are looked over in so many passes, so that the shuffle files of one pass alone stand at a time.
KEY_PASSES = 4
#: Asking items go to blocks in groups of about a block's items divided by this.
ASKERS = 4
Get = Callable[[str], Column]
Test = Callable[[Get, Get], Column]
#: The size of an item, and the least and the greatest size of an item that can be alike to it.
Reach = tuple[Column, Column, Column]


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(item, label) of every item of edges (a, b); label is the least item of its component.

    Alternating large-star and small-star steps until nothing changes; the edges are written to the shared
    folder after each round. The least neighbour is found by a partial aggregate, and items with a
    large share of the edges are joined by broadcast.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    for _ in range(most):
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("s")).first()
        if mark == before or not mark["n"]:
            break
        before, rows = mark, mark["n"]
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
        large = heavy_join(both, least, "a", F.col("n"), 2 * rows, 2 * rows).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = materialize(large, "edges")
        after = materialize(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
        moved = heavy_join(large, after, "a", F.col("n"), rows, rows).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        settled = materialize(moved.unionByName(after.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(now, least, large, after)
        now = settled
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("item"), F.col("b").alias("label")).unionByName(now.select("b", F.col("b").alias("label")).distinct().toDF("item", "label"))


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels, (item, label) as components() gives them, after further edges (a, b) between items, old or new.

    Only edges between labels are left to settle, so it takes few rounds.
    """
    def named(df: DataFrame, side: str) -> DataFrame:
        own = labels.select(F.col("item").alias(side), F.col("label").alias("_label"))
        return df.join(own, side, "left").withColumn(side, F.coalesce("_label", side)).drop("_label")

    between = materialize(named(named(edges.select("a", "b"), "a"), "b").where("a <> b"), "between")
    if between.isEmpty():
        return labels
    moved = materialize(components(between).select(F.col("item").alias("label"), F.col("label").alias("to")), "moved")
    old = labels.join(moved, "label", "left").select("item", F.coalesce("to", "label").alias("label"))
    fresh = moved.join(labels.select(F.col("item").alias("label")), "label", "left_anti").select(F.col("label").alias("item"), F.col("to").alias("label"))
    return materialize(old.unionByName(fresh), "labels")


def shared_members(rows: DataFrame) -> DataFrame:
    """The distinct rows (key, item, ...) whose key two items share, with hub, the least item of the key, and n, its items.

    The keys are looked over with a partial aggregate; then a Bloom filter of the shared ones keeps the items of
    nearly all others from being shuffled. The filter is broadcast and has at most MAX_FILTER_BYTES.
    """
    half = F.col("item").bitwiseAND((1 << 31) - 1)  # Items of one key with equal halves, a pair in 2**31, would be taken for one.
    passes = []
    for i in range(KEY_PASSES):
        some = rows.where(F.pmod("key", F.lit(KEY_PASSES)) == i)
        passes.append(materialize(some.groupBy("key").agg(F.min(half).alias("low"), F.max(half).alias("high")).where("low <> high").select("key"), "keys"))
        free_shuffles(rows.sparkSession)
    keys = reduce(DataFrame.unionByName, passes)
    bits = bloom.size_for(max(1, keys.count()), 16, MAX_FILTER_BYTES)
    maybe = materialize(bloom.probe(rows, bloom.of_keys(keys, "key", bits), F.col("key"), bits).where("maybe").drop("maybe").distinct(), "maybe")
    sizes = maybe.groupBy("key").agg(F.min("item").alias("hub"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("item")).alias("mark")).where("n > 1")
    # Of keys with the same items, which one text in several places gives, one is enough.
    sizes = materialize(sizes.groupBy("hub", "n", "mark").agg(F.min("key").alias("key")).drop("mark"), "sizes")
    total = sizes.agg(F.count("*").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    found = materialize(heavy_join(maybe, sizes, "key", F.col("n"), max(1, total["n"]), total["k"], "inner"), "members")
    discard(*passes, maybe, sizes)
    free_shuffles(rows.sparkSession)
    return found


def only(df: DataFrame, items: DataFrame, rows: int, key: str = "item") -> DataFrame:
    """The rows of df whose key is in items (unique, materialized, so many rows); a Bloom filter keeps most others from the shuffle."""
    bits = bloom.size_for(max(1, rows), 16, MAX_FILTER_BYTES)
    maybe = bloom.probe(df, bloom.of_keys(items, key, bits), F.col(key), bits).where("maybe").drop("maybe")
    return maybe.join(items, key, "left_semi")


def _with(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """pairs (a, b), materialized, with the table's columns of both items, suffixed _a and _b.

    Items that stand in MANY_PAIRS pairs and a large share of all, at most HEAVY_SHARE a side, are joined by broadcast.
    """
    out, least = pairs, max(MANY_PAIRS, pairs.count() // HEAVY_SHARE)
    for side in "ab":
        own = table.select(F.col("item").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])
        heavy = materialize(pairs.groupBy(side).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(side), "heavy")
        if heavy.isEmpty():
            out = out.join(own, side)
        else:
            few = F.broadcast(heavy)
            out = out.join(F.broadcast(own.join(few, side)), side).unionByName(out.join(few, side, "left_anti").join(own, side))
    return out


def sides(a: str = "{}_a", b: str = "{}_b") -> tuple[Get, Get]:
    return lambda c: F.col(a.format(c)), lambda c: F.col(b.format(c))


def _ordered(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def _bins(n: Column, block: int, ratio: float, reach: Reach | None) -> dict[str, Column]:
    """bin, a number of a row's size, and least and greatest, those of the sizes within its reach; all 0 where its key has no more than block items."""
    number = lambda c: F.floor(F.log(F.greatest(c.cast("double"), F.lit(1.0))) / (-0.5 * math.log(ratio))).cast("int")
    size, low, high = reach or (F.lit(1), F.lit(1), F.lit(1))
    found = {"bin": number(size), "least_bin": number(low * (1 - 1e-6)), "greatest_bin": number(high * (1 + 1e-6))}
    return {k: F.when(n > block, c).otherwise(0) if reach else F.lit(0) for k, c in found.items()}


def _blocks(n: Column, block: int) -> Column:
    return F.ceil(n / block).cast("int")


def _with_bins(binned: DataFrame, rows: int) -> DataFrame:
    """binned (key, bin, ...), materialized, so many rows, with bins: the number of items of the key in each bin."""
    bins = binned.groupBy("key", "bin").agg(F.count("*").alias("c")).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("bins"), F.sum("c").alias("of_key"))
    return heavy_join(binned, materialize(bins, "bins"), "key", F.col("of_key"), rows, rows).drop("of_key")


def _dealt(members: DataFrame, columns: list[str], block: int) -> DataFrame:
    """(key, bin, block, held): the items of each key and bin in blocks of about block, so that a common key is many rows."""
    blocks = members.withColumn("block", F.pmod(F.xxhash64("item"), _blocks(F.col("bins")[F.col("bin")], block)).cast("int"))
    return blocks.groupBy("key", "bin", "block").agg(F.collect_list(F.struct("item", *columns)).alias("held"))


def _asking(members: DataFrame, columns: list[str], block: int) -> DataFrame:
    """(key, bin, block, asks): some items of a key and bin, in groups, once for each block of their key that holds items of a size within the reach of one.

    A group goes as one row, so that the rows grow with the square of the groups of a key and not of its items.
    """
    group = F.pmod(F.xxhash64("item"), _blocks(F.col("bins")[F.col("bin")], max(1, block // ASKERS))).alias("group")
    own = members.groupBy("key", "bin", group).agg(
        F.collect_list(F.struct("item", *columns)).alias("asks"), F.any_value("bins").alias("bins"), F.min("least_bin").alias("least_bin"), F.max("greatest_bin").alias("greatest_bin")
    )
    return own.select("key", "asks", _places(block))


def _places(block: int) -> Column:
    """A generator of bin and block, of all blocks of a row's key that hold items of about its size."""
    near = F.filter(F.map_keys("bins"), lambda b: b.between(F.col("least_bin"), F.col("greatest_bin")))
    here = lambda b: F.transform(F.sequence(F.lit(0), _blocks(F.col("bins")[b], block) - 1), lambda i: F.struct(b.alias("bin"), i.alias("block")))
    return F.inline(F.flatten(F.transform(near, here)))


def link(rows: DataFrame, near: Test, fetch: Callable[[DataFrame], DataFrame], columns: list[str], alike: Test, more: Callable[[DataFrame], DataFrame] | None = None, block: int = 32, ratio: float = 0.9, near_reach: Reach | None = None, reach: Reach | None = None, narrow: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(item, label) of all items that a chain of links joins; a link is a pair that shares a key, is near and alike.

    rows: (item, key) and the columns of a sketch, which depend on the item alone; rows may repeat. fetch: from the items of near pairs
    to the columns that alike needs, called once; near, alike: from two functions that give a column of either item. more: adds to (item, ...)
    the columns of the sketch that are made for items that share a key alone.
    First each item is held against the least item of each of its keys, or, if it isn't near that, against one near
    item in each block of the key's items; then, where a key still has several
    labels, against an item of the key chosen by hash. So a group that holds together costs a few pairs an item.
    Items that are in another label than most of a key after that are compared with blocks of
    the key's items, of about block items each; only links leave that step. So none between different labels is missed.
    near_reach, of the sketch, and reach, of it and the columns of fetch, tell which sizes an item can be alike to; of large keys it meets only blocks of
    such sizes, and one that can be alike to none leaves. Numbers of sizes go up by about the root of ratio. narrow: changes the columns of fetch for
    the items, all given to it, that are left for the last step, so that reach and alike know more.
    """
    members = shared_members(rows)
    if more:
        members, old = materialize(more(members), "sketched"), members
        discard(old)
        free_shuffles(rows.sparkSession)
    own = [c for c in members.columns if c not in ("key", "item", "hub", "n")]
    total = max(1, members.count())
    hubs = materialize(members.where("item = hub").select("key", F.col("n").alias("of_key"), *[F.col(c).alias(f"{c}_b") for c in own]), "hubs")
    spokes = members.where("item <> hub").select("key", "n", F.col("item").alias("a"), F.col("hub").alias("b"), *[F.col(c).alias(f"{c}_a") for c in own])
    held = heavy_join(spokes, hubs, "key", F.col("of_key"), total, total)
    held = materialize(held.select("key", "n", "a", "b", *[f"{c}_a" for c in own], near(*sides()).alias("near")), "held")
    first = held.where("near").select("a", "b").distinct()
    # Items that are far from their key's hub may be near to others of the key; one of each block shows that.
    binned = materialize(members.where("n > 2").select("key", "item", "hub", *own, *[c.alias(k) for k, c in _bins(F.col("n"), block, ratio, near_reach).items()]), "binned")
    placed = _with_bins(binned, total)
    far = held.where("not near and n > 2").select("key", F.col("a").alias("item"))
    others = _dealt(placed.where("item <> hub"), own, block)
    asking = _asking(placed.join(far, ["key", "item"], "left_semi"), own, block)

    def first_near(y: Column) -> Column:
        some = F.filter("held", lambda x: (x["item"] != y["item"]) & near(lambda c: y[c], lambda c: x[c]))
        return F.struct(y["item"].alias("a"), F.array_min(F.transform(some, lambda x: x["item"])).alias("b"))

    apart = asking.join(others, ["key", "bin", "block"]).select(F.inline(F.filter(F.transform("asks", first_near), lambda p: p["b"].isNotNull())))
    wanted = materialize(first.unionByName(apart.select(*_ordered("a", "b"))).distinct(), "wanted")
    free_shuffles(rows.sparkSession)
    items = materialize(wanted.select(F.explode(F.array("a", "b")).alias("item")).distinct(), "items")
    known = materialize(fetch(items), "known")
    discard(hubs, held, items, binned)
    free_shuffles(rows.sparkSession)

    def checked(pairs: DataFrame) -> DataFrame:
        return materialize(_with(pairs, known, columns).where(alike(*sides())).select("a", "b"), "links")

    labels = materialize(components(checked(wanted)), "labels")
    free_shuffles(rows.sparkSession)
    for last in (False, True):
        # Read up to three times below.
        inside = materialize(known.select("item").join(labels, "item", "left").select("item", F.coalesce("label", "item").alias("label")), "inside")
        placed = members.where("n > 2").select("key", "item", *own).join(inside, "item")
        mixed = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min_by("item", F.xxhash64("item", "key")).alias("chosen"), F.count("*").alias("m")).where("low <> high")
        mixed = materialize(mixed.select("key", "chosen", "m"), "mixed")
        rows_left = mixed.agg(F.sum("m").alias("m")).first()["m"]
        if not rows_left:
            return labels
        placed = materialize(heavy_join(placed, mixed, "key", F.col("m"), rows_left, rows_left, "inner"), "placed")
        if not last:
            one = materialize(placed.where("item = chosen").select("key", F.col("label").alias("label_b"), F.col("m").alias("of_key"), *[F.col(c).alias(f"{c}_b") for c in own]), "chosen")
            pairs = placed.select("key", F.col("item").alias("a"), F.col("chosen").alias("b"), "label", *[F.col(c).alias(f"{c}_a") for c in own])
            pairs = heavy_join(pairs, one, "key", F.col("of_key"), rows_left, rows_left).where((F.col("label") != F.col("label_b")) & near(*sides()))
            second = materialize(pairs.select(*_ordered("a", "b")).distinct().join(wanted, ["a", "b"], "left_anti"), "pairs")
            labels = joined(labels, checked(second))
            discard(inside, one, mixed, placed, second)
            free_shuffles(rows.sparkSession)
    if narrow:
        some = placed.select("item").distinct()
        known, old = materialize(narrow(known.join(some, "item", "left_semi")), "known"), known
        discard(old)
    free_shuffles(rows.sparkSession)
    found = joined(labels, materialize(_in_blocks(placed, rows_left, known, own, near, columns, alike, block, ratio, reach), "links"))
    discard(members, inside, mixed, placed, wanted, known)
    free_shuffles(rows.sparkSession)
    return found


def _in_blocks(placed: DataFrame, rows: int, known: DataFrame, own: list[str], near: Test, columns: list[str], alike: Test, block: int, ratio: float, reach: Reach | None) -> DataFrame:
    """(a, b) of all links between different labels of a key; placed: (key, item, label, the sketch, m), rows rows, m items in the key.

    Two items of different labels include one outside the key's most usual label; those alone ask. The items of a key are
    dealt into blocks by size; a group of asking items goes to every block of its key within its reach and keeps what it is linked to there.
    """
    sizes = placed.groupBy("key", "label").agg(F.count("*").alias("c"))
    usual = materialize(sizes.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("usual"), F.sum("c").alias("of_key")), "usual")
    # An item has few keys. Two items are compared in the least key that they share, and by one of them if both ask.
    keys = placed.groupBy("item").agg(F.collect_list("key").alias("keys"))
    full = heavy_join(placed, usual, "key", F.col("of_key"), rows, rows).withColumn("asks", F.col("label") != F.col("usual")).drop("usual", "of_key")
    full = full.join(known.join(keys, "item"), "item").withColumns(_bins(F.col("m"), block, ratio, reach))
    full = materialize(full.where(reach[1] <= reach[2]) if reach else full, "full")
    free_shuffles(placed.sparkSession)
    sized = _with_bins(full, rows)
    taken = ["label", "asks", "keys", *own, *columns]
    dealt, asking = _dealt(sized, taken, block), _asking(sized.where("asks"), taken, block)

    def linked(y: Column, x: Column) -> Column:
        mine, theirs = lambda c: y[c], lambda c: x[c]
        here = (x["label"] != y["label"]) & (~x["asks"] | (x["item"] < y["item"]))
        once_here = F.array_min(F.array_intersect(y["keys"], x["keys"])) == F.col("key")
        return F.when(here, F.when(near(mine, theirs), F.when(once_here, alike(mine, theirs)))).otherwise(F.lit(False))

    def links(y: Column) -> Column:
        pair = lambda x: F.struct(F.greatest(y["item"], x["item"]).alias("a"), F.least(y["item"], x["item"]).alias("b"))
        return F.transform(F.filter("held", lambda x: linked(y, x)), pair)

    return asking.join(dealt, ["key", "bin", "block"]).select(F.inline(F.flatten(F.transform("asks", links)))).distinct()
