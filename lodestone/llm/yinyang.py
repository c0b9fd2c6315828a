"""Centroid clustering by Yinyang grouping: Lloyd's results, exactly, with most distances left out.

Centroids are put into groups once. Every vector carries an upper bound of the distance to its own
centroid and one lower bound for each group; both are moved by what centroids have drifted. A vector whose
upper bound lies below all its lower bounds is settled (global filter); of the others only the groups that may
hold a nearer centroid are opened (group filter), and in those only the centroids that their own drift leaves
in question are measured. Vectors and bounds are a table that each round reads and writes again; only the vectors
that changed their centroid enter the sums. The driver holds centroids alone: k rows, a parameter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import discard, materialize, tidy

SCALE = 1024
#: Components beyond are held at this value, so that distances of ordinary vectors fit a long.
MOST = float(1 << 31)
#: Bounds are widened by this share, so that rounding never hides a nearer centroid.
SLACK = 1e-12
LONGEST = (1 << 63) - 1


def kept(v: Column, dims: int) -> Column:
    """Whether v has dims components, all of them finite numbers."""
    return F.coalesce((F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def whole(v: Column) -> Column:
    """Every component as floor(1024 * x), held within MOST."""
    return F.transform(v, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(MOST)), F.lit(-MOST))))


def squared(v: np.ndarray, center: np.ndarray) -> np.ndarray:
    """Squared distances of rows to one centroid, exactly; those beyond a long count as the greatest long."""
    away = v - center
    out = np.einsum("ij,ij->i", away, away)  # modulo 2**64, so right wherever the result fits
    if len(away) and np.abs(away).max() >= 1 << 28:
        out = np.where((away.astype("f8") ** 2).sum(axis=1) >= LONGEST, LONGEST, out)
    return out


def grouped(centers: np.ndarray, groups: int, rounds: int = 5) -> list[np.ndarray]:
    """The centroids' numbers in at most so many groups, by a few rounds of k-means over the centroids."""
    points = centers.astype("f8")
    seeds = points[:groups].copy()
    for _ in range(rounds):
        at = ((points[:, None] - seeds[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(len(seeds)):
            if (at == g).any():
                seeds[g] = points[at == g].mean(axis=0)
    return [np.flatnonzero(at == g) for g in range(len(seeds)) if (at == g).any()]


class Bounds:
    """The filters of one round."""

    def __init__(self, centers: np.ndarray, before: np.ndarray | None, groups: list[np.ndarray]):
        self.centers, self.groups, self.first = centers, groups, before is None
        self.group_of = np.empty(len(centers), "i8")
        for g, own in enumerate(groups):
            self.group_of[own] = g
        if not self.first:
            self.drift = np.sqrt(((centers - before).astype("f8") ** 2).sum(axis=1)) * (1 + SLACK)
            self.group_drift = np.array([self.drift[own].max() for own in groups])
        self.measured = 0

    def distances(self, v: np.ndarray, number: int) -> np.ndarray:
        self.measured += len(v)
        return squared(v, self.centers[number])

    def begin(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, upper, lower) by all distances."""
        all_ = np.stack([self.distances(v, c) for c in range(len(self.centers))], axis=1)
        cluster = all_.argmin(axis=1)
        root = np.sqrt(all_.astype("f8"))
        rows = np.arange(len(v))
        upper = root[rows, cluster] * (1 + SLACK)
        root[rows, cluster] = np.inf
        return cluster, upper, np.stack([root[:, own].min(axis=1) for own in self.groups], axis=1) * (1 - SLACK)

    def move(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, upper, lower) after centroids have drifted."""
        cluster, before = cluster.copy(), lower
        upper, lower = upper + self.drift[cluster], lower - self.group_drift
        rows = np.flatnonzero(upper >= lower.min(axis=1))
        own = np.empty(len(rows), "i8")
        for c in np.unique(cluster[rows]):
            at = cluster[rows] == c
            own[at] = self.distances(v[rows[at]], c)
        upper[rows] = np.sqrt(own.astype("f8")) * (1 + SLACK)
        left = upper[rows] >= lower[rows].min(axis=1)
        rows, own = rows[left], own[left]
        was, best, best_d, near = cluster[rows], cluster[rows].copy(), own.copy(), {}
        for g, numbers in enumerate(self.groups):
            at = np.flatnonzero(lower[rows, g] <= upper[rows])
            if not len(at):
                continue
            bound = before[rows[at], g, None] - self.drift[numbers]
            exact = np.full(bound.shape, LONGEST)
            for j, c in enumerate(numbers):
                mine = was[at] == c
                exact[mine, j] = own[at[mine]]
                ask = np.flatnonzero(~mine & (bound[:, j] <= upper[rows[at]]))
                exact[ask, j] = self.distances(v[rows[at[ask]]], c)
                known = np.concatenate([ask, np.flatnonzero(mine)])
                bound[known, j] = np.sqrt(exact[known, j].astype("f8")) * (1 - SLACK)
            j = exact.argmin(axis=1)
            found, d = numbers[j], exact[np.arange(len(at)), j]
            better = (d < best_d[at]) | (d == best_d[at]) & (found < best[at])
            best[at[better]], best_d[at[better]] = found[better], d[better]
            near[g] = at, bound
        for g, (at, bound) in near.items():
            for j, c in enumerate(self.groups[g]):
                bound[best[at] == c, j] = np.inf
            lower[rows[at], g] = bound.min(axis=1)
        # A centroid that was left stands in a group that may not have been opened.
        gone = np.flatnonzero(best != was)
        held = self.group_of[was[gone]]
        lower[rows[gone], held] = np.minimum(lower[rows[gone], held], np.sqrt(own[gone].astype("f8")) * (1 - SLACK))
        cluster[rows], upper[rows] = best, np.sqrt(best_d.astype("f8")) * (1 + SLACK)
        return cluster, upper, lower


def lists(values: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype="i4") * values.shape[1]), pa.array(values.ravel(), kind))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def assign(held: DataFrame, centers: np.ndarray, before: np.ndarray | None, groups: list[np.ndarray], last: bool) -> DataFrame:
    """One round: (vec_id, v, cluster, was, upper, lower), and exact distances in the last."""
    dims, id_type = centers.shape[1], dict(held.dtypes)["vec_id"]
    names = ["vec_id", "v", "cluster", "was", "upper", "lower", "distance"]

    def run(batches):
        bounds = Bounds(centers, before, groups)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column(1), dims)
            if bounds.first:
                was, (cluster, upper, lower) = pa.nulls(len(v), pa.int32()), bounds.begin(v)
            else:
                was = batch.column(2)
                cluster, upper, lower = bounds.move(v, was.to_numpy().astype("i8"), batch.column(3).to_numpy(), matrix(batch.column(4), len(groups)))
            d = np.zeros(len(v), "i8")
            for c in np.unique(cluster) if last else ():
                d[cluster == c] = squared(v[cluster == c], centers[c])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), was, pa.array(upper), lists(lower, pa.float64()), pa.array(d)], names)

    read = held.select("vec_id", "v", *([] if before is None else ["cluster", "upper", "lower"]))
    return read.mapInArrow(tidy(run), f"vec_id {id_type}, v array<bigint>, cluster int, was int, upper double, lower array<double>, distance bigint")


def add_moved(held: DataFrame, sums: np.ndarray, counts: np.ndarray) -> None:
    """Puts what changed its centroid into the sums and counts: k rows come back."""
    changes = F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).cast("long").alias("sign")), F.struct(F.col("was").alias("c"), F.lit(-1).cast("long").alias("sign")))
    moved = held.where("was is null or was <> cluster").select("v", F.explode(changes).alias("x")).where("x.c is not null").select("v", "x.c", "x.sign")
    totals = [F.sum(F.get("v", F.lit(i)) * F.col("sign")) for i in range(sums.shape[1])]
    for r in moved.groupBy("c").agg(F.sum("sign"), *totals).collect():
        counts[r[0]] += r[1]
        sums[r[0]] += np.array(r[2:], "i8")


def cluster(df: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, groups: int | None = None, dims: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that is kept().

    Lloyd's rounds over whole numbers: the nearest centroid by squared distance, the smaller number at a tie; centroids become
    floor(sum / count), empty ones stay. They start as the k kept vectors of least sha256 of "seed:id" (equal ids:
    the lesser vector; a null id comes last). Fewer than k kept vectors are as many centroids; of none, or of an empty
    table, there are no rows. Rows that repeat count each time; other columns are ignored. Components beyond 2**21 are held there,
    squared distances and sums beyond a long at the greatest long. groups: at most so many of centroids (a quarter of k).
    """
    v = F.col(vector_col)
    points = df.where(kept(v, dims)).select(F.col(id_col).alias("vec_id"), whole(v).alias("v"))
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = points.orderBy(rank.asc_nulls_last(), "v").limit(k).collect()
    if not start:
        return points.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    centers, before = np.array([r["v"] for r in start], "i8"), None
    sums, counts = np.zeros_like(centers), np.zeros(len(centers), "i8")
    parts, held = grouped(centers, groups or -(-len(centers) // 4)), points
    for i in range(rounds + 1):
        now = materialize(assign(held, centers, before, parts, i == rounds), "clusters")
        if held is not points:
            discard(held)
        held = now
        if i < rounds:
            add_moved(held, sums, counts)
            before, full = centers, counts > 0
            centers = centers.copy()
            centers[full] = sums[full] // counts[full, None]
    return described(held, centers)


def described(held: DataFrame, centers: np.ndarray) -> DataFrame:
    """The clusters with their inertia and their centroids' digests."""
    digests = [(c, hashlib.sha256(",".join(map(str, center)).encode()).hexdigest()) for c, center in enumerate(centers.tolist())]
    most = F.lit(LONGEST).cast("decimal(38,0)")
    own = held.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s"))
    whole_sum = own.agg(F.least(F.sum("s"), most).cast("long").alias("inertia"))
    named = held.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    values = own.select("cluster", F.least(F.col("s"), most).cast("long").alias("cluster_inertia")).join(F.broadcast(named), "cluster").join(F.broadcast(whole_sum))
    return held.join(F.broadcast(values), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64) -> str:
    """The plain rounds in DuckDB's SQL."""
    near = "SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, c, list_sum(list_transform(list_zip(kept.v, x.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept, c{0} x) q GROUP BY r"
    steps = []
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({near.format(i)})")
        mean = f"SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM a{i} JOIN parts USING (r) GROUP BY c, i) q GROUP BY c"
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN ({mean}) m USING (c))")
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
parts AS MATERIALIZED (SELECT r, i, v[i] AS x FROM kept, generate_series(1, {dims}) t(i)),
c0 AS MATERIALIZED (SELECT c, v FROM (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1)::INT AS c, v FROM kept) q WHERE c < {k}),
{", ".join(steps)}, last AS MATERIALIZED ({near.format(rounds)}), own AS (SELECT c, sum(d)::BIGINT AS s FROM last GROUP BY c)
SELECT vec_id, c AS cluster, d AS distance, s AS cluster_inertia, (SELECT sum(s) FROM own)::BIGINT AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM last JOIN kept USING (r) JOIN c{rounds} USING (c) JOIN own USING (c)
"""
