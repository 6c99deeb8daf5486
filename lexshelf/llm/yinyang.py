"""Centroid clustering by Yinyang grouping, in exact whole numbers.

Centroids are clustered into groups once. Every vector carries an upper bound on the distance from its own centroid and one lower bound for each group of
the others. When centroids move, the bounds move by how far they went. A vector whose least lower bound is above its upper bound stays where it is
(global filter); of the others, only groups whose bound is not above it are scanned (group filter), and all centroids of these exactly.

Each round is one pass that reads the vectors with their bounds and writes them again, so a lost executor costs a part of one round. Sums for new centroids
are formed inside tasks, a row for each centroid and component; only these reach the driver. The centroids (k of them) are all that is shared.

Defined cases: vectors that are null, hold null or non-finite components, or have not exactly width of these take no part; a null id hashes as an empty
string; rows that repeat an id are vectors of their own; ties go to the smaller centroid; fewer vectors than k give as many centroids; components beyond the
range of a long are clamped to it, as are distances and their sums (whatever is below 2**63 is the exact integer); an empty table gives no rows, and columns
that are not named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexshelf.llm.common import scratch_path
from lexshelf.shared import removed

#: Centroids to a group, about; rows whose distances are worked out together; slack of the bounds, far above the error of their roundings.
GROUP, BLOCK, SLACK = 4, 8192, 1e-9
MOST = (1 << 63) - 1


def usable(vector: Column, width: int, scale: int) -> Column:
    """floor(scale x) of every component, null for vectors that take no part."""
    x = vector.cast("array<double>")
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when((F.size(x) == width) & ~F.exists(x, odd), F.transform(x, lambda c: F.floor(c * scale).cast("bigint")))


def exact_in_floats(x: np.ndarray, c: np.ndarray) -> bool:
    """Whether squared distances, and sums of squares on the way to them, are exact in 64-bit floats."""
    return all(x.shape[1] * float(abs(int(p))) ** 2 < 2.0**50 for a in (x, c) if a.size for p in (a.min(), a.max()))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x from all of c, exact: 64-bit integers where they fit, Python's otherwise."""
    if exact_in_floats(x, c):
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    a, b = x.astype(object), c.astype(object)
    return np.stack([((a - row) ** 2).sum(1) for row in b], axis=1) if len(b) else np.zeros((len(a), 0), object)


def own_squared(x: np.ndarray, c: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    """Squared distance of each row of x from its own centroid."""
    if exact_in_floats(x, c):
        return ((x - c[cluster]) ** 2).sum(1)
    return ((x.astype(object) - c.astype(object)[cluster]) ** 2).sum(1)


def roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(float))


def grouped(centroids: np.ndarray) -> np.ndarray:
    """The group of each centroid: a few rounds of k-means over the centroids themselves."""
    c = centroids.astype(float)
    n = -(-len(c) // GROUP)
    centres = c[np.linspace(0, len(c) - 1, n).astype(int)]
    for _ in range(5):
        near = ((c[:, None] - centres) ** 2).sum(2).argmin(1)
        centres = np.array([c[near == g].mean(0) if (near == g).any() else centres[g] for g in range(n)])
    return np.unique(near, return_inverse=True)[1]


def first_bounds(x: np.ndarray, c: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cluster, upper and lower bounds of vectors that have none yet."""
    d = squared(x, c)
    cluster = d.argmin(1)
    far = roots(d)
    upper = far[np.arange(len(x)), cluster]
    far[np.arange(len(x)), cluster] = np.inf
    return cluster, upper, np.stack([far[:, group == g].min(1, initial=np.inf) for g in range(group.max() + 1)], axis=1)


def next_bounds(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: np.ndarray, group: np.ndarray, drift: np.ndarray) -> int:
    """Brings cluster, upper and lower up to date in place after centroids moved by drift, and returns how many distances were worked out."""
    upper[:] = (upper + drift[cluster]) * (1 + SLACK)
    gone = np.array([drift[group == g].max() for g in range(group.max() + 1)])
    lower[:] = np.maximum(lower * (1 - SLACK) - gone * (1 + SLACK), 0)
    rows = np.flatnonzero(lower.min(1) <= upper)
    best = own_squared(x[rows], c, cluster[rows])
    count = len(rows)
    upper[rows] = roots(best)
    left = lower[rows].min(1) <= upper[rows]
    rows, best = rows[left], best[left]
    old, old_best = cluster[rows].copy(), best.copy()
    scanned = []
    for g in range(group.max() + 1):
        at = np.flatnonzero(lower[rows, g] <= roots(best))
        members = np.flatnonzero(group == g)
        d = squared(x[rows[at]], c[members])
        count += d.size
        j = d.argmin(1)
        least = d[np.arange(len(at)), j]
        better = (least < best[at]) | (least == best[at]) & (members[j] < cluster[rows[at]])
        best[at[better]], cluster[rows[at[better]]] = least[better], members[j[better]]
        scanned.append((at, members, d))
    upper[rows] = roots(best)
    for g, (at, members, d) in enumerate(scanned):  # the own centroid has no part in its group's bound
        far = roots(d)
        far[members == cluster[rows[at]][:, None]] = np.inf
        lower[rows[at], g] = far.min(1, initial=np.inf)
    moved = np.flatnonzero(cluster[rows] != old)
    at = rows[moved], group[old[moved]]
    lower[at] = np.minimum(lower[at], roots(old_best[moved]))
    return count


def lists(column: pa.Array, width: int, kind: type) -> np.ndarray:
    """A list column with width elements in each row, as a matrix that can be written to."""
    return np.array(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(-1, width)


def as_lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    edges = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(values.ravel(), kind))


def sums(state: DataFrame, k: int, width: int) -> list[tuple[int, int, int, int]]:
    """cluster, component, rows and sum: added up inside tasks first, so that a very common vector or cluster is no hot key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts = np.zeros((k, width), object), np.zeros(k, np.int64)
        for b in batches:
            x, cluster = lists(b.column(0), width, np.int64), b.column(1).to_numpy()
            one = np.eye(k)[cluster]
            exact = float(np.abs(x.astype(float)).max(initial=0)) * len(x) < 2.0**53
            total += (one.T @ x.astype(float)).astype(np.int64).astype(object) if exact else one.T.astype(np.int64).astype(object) @ x.astype(object)
            counts += np.bincount(cluster, minlength=k)
        at = np.repeat(np.flatnonzero(counts), width)
        part = np.tile(np.arange(width), len(at) // width)
        said = pa.array([Decimal(int(v)) for v in total[at, part]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(part, pa.int32()), pa.array(counts[at]), said], names=["cluster", "part", "n", "s"])

    found = state.select("x", "cluster").mapInArrow(run, "cluster int, part int, n bigint, s decimal(38,0)")
    return [(r.cluster, r.part, r.n, int(r.s)) for r in found.groupBy("cluster", "part").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()]  # k x width rows


def fit(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, salt: str = "1:") -> tuple[DataFrame, np.ndarray]:
    """id, cluster and distance (squared) of each vector that takes part, and the centroids.

    Centroids start as the k vectors with the least hash of salt and id. Each round assigns, then moves every centroid that has vectors to the floor of
    their mean; at the end vectors are assigned once more.
    """
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)[id]
    kept = vectors.select(F.col(id).alias("id"), usable(F.col(vector), width, scale).alias("x")).where("x is not null")
    first = kept.orderBy(F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), "id", "x").limit(k)
    c = np.array([r.x for r in first.collect()], np.int64).reshape(-1, width)
    if not len(c):
        return kept.select(F.col("id").alias(id), F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")), c
    group = grouped(c)
    schema = f"id {kind}, x array<bigint>, cluster int, upper double, lower array<double>"
    state, path = kept, None
    for i in range(rounds + 1):
        state, old_path, path = passed(state, c, group, None if not i else drift, schema), path, scratch_path(spark, "yinyang")
        state.write.parquet(path)
        if old_path:
            removed(spark, old_path)
        state = spark.read.schema(schema).parquet(path)
        if i < rounds:
            before, c = c, c.copy()
            for cluster, part, n, s in sums(state, len(c), width):
                c[cluster, part] = s // n
            drift = roots(((c.astype(object) - before.astype(object)) ** 2).sum(1)) * (1 + SLACK)
    return measured(state, c, id, kind), c


def passed(state: DataFrame, c: np.ndarray, group: np.ndarray, drift: np.ndarray | None, schema: str) -> DataFrame:
    """One round's assignment: vectors with their cluster and bounds. Without a drift, all distances are worked out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, BLOCK):
                b = whole.slice(s, BLOCK)
                x = lists(b.column(1), c.shape[1], np.int64)
                if drift is None:
                    cluster, upper, lower = first_bounds(x, c, group)
                else:
                    cluster, upper, lower = b.column(2).to_numpy().copy(), b.column(3).to_numpy().copy(), lists(b.column(4), group.max() + 1, float)
                    next_bounds(x, cluster, upper, lower, c, group, drift)
                made = [b.column(0), as_lists(x, pa.int64()), pa.array(cluster, pa.int32()), pa.array(upper), as_lists(lower, pa.float64())]
                yield pa.RecordBatch.from_arrays(made, names=["id", "x", "cluster", "upper", "lower"])

    return state.mapInArrow(run, schema)


def measured(state: DataFrame, c: np.ndarray, id: str, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = own_squared(lists(b.column(1), c.shape[1], np.int64), c, b.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([min(int(v), MOST) for v in d], pa.int64())], names=[id, "cluster", "distance"])

    return state.select("id", "x", "cluster").mapInArrow(run, f"`{id}` {kind}, cluster int, distance bigint")


def summed(assigned: DataFrame) -> DataFrame:
    """assigned with cluster_inertia and inertia: the distances summed over each cluster and over all."""
    whole = lambda c: F.least(c, F.lit(MOST).cast("decimal(38,0)")).cast("bigint")
    by = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("s"))
    total = by.agg(F.sum("s")).scalar()
    named = by.select("cluster", whole(F.col("s")).alias("cluster_inertia"), whole(total).alias("inertia"))
    return assigned.join(F.broadcast(named), "cluster")  # a row for each centroid
