"""Exact top-k search by inner product: a Voronoi join of queries and data.

A bounded sample gives about sqrt(n) pivots. Every vector belongs to its nearest pivot, and each cell is parted into RINGS by distance
from the pivot. A ring is summarised by its number of rows and its outer radius r: for a query q and a ring about pivot p, no
score exceeds q.p + |q| r (Cauchy-Schwarz). Queries are first solved in their own chunk, which gives each a threshold: the k-th score found
there. Then a query goes only to the rings whose bound reaches its threshold, only rings that some query visits are
moved, and the local results are merged.

Rings of more bytes than CHUNK_BYTES are cut into chunks by hash, so a very common vector is no hot ring.

Defined cases: vectors that are null or hold null or non-finite components take no part, missing components of shorter
vectors count as 0, components beyond the range of a long are clamped to it, and so are scores (whatever is below 2**63 is the exact integer), ties go
to the smaller id, repeated rows are neighbours of each other (only the query's own row is left out), a null id sorts first, fewer rows than k
give them all, an empty table gives no rows, vectors may be of any width (a chunk then holds fewer rows), and columns that are not named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexshelf.llm.common import tasks_for, written

#: Most pivots, rows of the sample that places them, and rings of a cell: 16,384 summaries at most reach the driver.
MOST_PIVOTS, SAMPLE_ROWS, RINGS = 4096, 20_000, 4
#: Bytes of one chunk's vectors, and scores (8 bytes each) that are held at once.
CHUNK_BYTES, SCORES = 16 << 20, 1 << 22
#: Chunks that are dealt to one task.
TASK_CHUNKS = 8
#: Stands for a null id inside.
NO_ID = -(1 << 63)
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
VISITS = "row bigint, id bigint, v array<bigint>, ring int, chunk int, rings array<int>"


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Whole numbers, rows padded with 0."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, clamped to the range of a long.

    Sums below 2**53 are exact in 64-bit floats. Beyond that, 64-bit integers are exact modulo 2**64, and floats with a bound on
    their error tell which sums leave the range; the few that the bound leaves open are summed one by one.
    """
    x, y = a.astype(float), b.astype(float)
    peak = np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * a.shape[1]
    if peak < 2.0**53:
        return (x @ y.T).astype(np.int64)
    wrapped = a @ b.T
    if peak < 2.0**62:
        return wrapped
    about = x @ y.T
    error = (a.shape[1] + 4) * 2.0**-52 * (np.abs(x) @ np.abs(y).T)
    out = np.where(np.abs(about) - error >= 2.0**63, np.where(about > 0, MOST, LEAST), wrapped)
    for i, j in np.argwhere((np.abs(about) - error < 2.0**63) & (np.abs(about) + error >= 2.0**63)):
        out[i, j] = min(max(sum(int(p) * int(q) for p, q in zip(a[i], b[j], strict=True)), int(LEAST)), int(MOST))
    return out


def usable(vector: Column) -> Column:
    """floor(1024 x) of every component, null for vectors that take no part."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = F.transform(vector.cast("array<double>"), lambda x: F.floor(x * 1024).cast("bigint"))
    return F.when(vector.isNotNull() & ~F.exists(vector.cast("array<double>"), odd), whole)


def pivots_of(rows: DataFrame, n: int, width: int, seed: int = 7) -> np.ndarray:
    """Centres from a few rounds of k-means over the SAMPLE_ROWS rows with the smallest hashes."""
    sample = rows.orderBy(F.xxhash64("row", F.lit(seed)), "row").limit(SAMPLE_ROWS).select("v").toPandas()
    x = np.unique(matrix(sample["v"], width), axis=0).astype(float)
    centres = x[np.random.default_rng(seed).permutation(len(x))[:n]]
    step = max(1, SCORES // max(len(centres), 1))
    for _ in range(5):
        sizes = (centres**2).sum(1)
        near = np.concatenate([(sizes - 2 * x[i : i + step] @ centres.T).argmin(1) for i in range(0, len(x), step)])
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return np.round(centres)


def assigned(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rows with cell (nearest pivot) and far (the distance from it, or a little more: never less)."""
    shared, width = rows.sparkSession.sparkContext.broadcast(pivots), pivots.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        sizes, step = (p**2).sum(1), max(1, SCORES // len(p))
        for pdf in batches:
            for i in range(0, len(pdf), step):
                part = pdf.iloc[i : i + step]
                x = matrix(part["v"], width).astype(float)
                own = (x**2).sum(1)
                d = x @ p.T
                d *= -2
                d += sizes
                cell = d.argmin(1).astype(np.int32)
                sums = own + sizes[cell]
                far = (d[np.arange(len(x)), cell] + own).clip(0)
                yield part.assign(cell=cell, far=np.sqrt(far + (width + 8) * 2.0**-51 * sums))

    return rows.mapInPandas(run, "row bigint, id bigint, query boolean, v array<bigint>, cell int, far double")


def solved(meetings: DataFrame, k: int, width: int) -> DataFrame:
    """query_row, query_id, row, id, score: the k best of each query and chunk.

    meetings: ring, chunk, side (0 data, 1 queries), row, id, v; sorted so that each chunk's data come first.
    """

    def best(data: list[pd.DataFrame], asked: pd.DataFrame, x: np.ndarray) -> Iterator[pd.DataFrame]:
        ids, rows = data[0]["id"].to_numpy(), data[0]["row"].to_numpy()
        scores = products(matrix(asked["v"], width), x)
        other = asked["row"].to_numpy()[:, None] != rows
        scores[~other] = LEAST
        cut = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(asked), LEAST)
        q, m = np.nonzero((scores >= cut[:, None]) & other)
        s = scores[q, m]
        order = np.lexsort((rows[m], ids[m], ~s, q))  # ~s falls as s rises, without overflow
        q, m, s = q[order], m[order], s[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        q, m, s = q[keep], m[keep], s[keep]
        yield pd.DataFrame({"query_row": asked["row"].to_numpy()[q], "query_id": asked["id"].to_numpy()[q], "row": rows[m], "id": ids[m], "score": s})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, data, x = None, [], None
        for pdf in batches:
            for key, part in pdf.groupby(["ring", "chunk", "side"], sort=False):
                if key[:2] != now:
                    now, data, x = key[:2], [], None
                if key[2] == 0:
                    data, x = [pd.concat([*data, part[["row", "id"]]], ignore_index=True)], np.vstack([*([] if x is None else [x]), matrix(part["v"], width)])
                elif data:
                    step = max(1, SCORES // len(x))
                    for i in range(0, len(part), step):
                        yield from best(data, part.iloc[i : i + step], x)

    return meetings.mapInPandas(run, "query_row bigint, query_id bigint, row bigint, id bigint, score bigint")


def top_k(rows: DataFrame, queries: Column, id: str = "vec_id", vector: str = "embedding", k: int = 10, pivots: int | None = None) -> DataFrame:
    """query_id, rank, id, score (long) for each row of rows that queries marks, against all others."""
    table = rows.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(id).cast("bigint"), F.lit(NO_ID)).alias("id"), F.coalesce(queries, F.lit(False)).alias("query"), usable(F.col(vector)).alias("v"))
    table = written(table.where("v is not null"), "knn-rows")
    count, width = table.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    of = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    named = of("query_id").alias("query_id"), F.col("rank"), of("id").alias(id), F.col("score")
    if not width:
        none = "query_id bigint, rank int, id bigint, score bigint"
        return rows.sparkSession.createDataFrame([], none).select(*named) if width is None else top_of(every_zero(table, k), k).select(*named)
    centres = pivots_of(table, pivots or min(MOST_PIVOTS, isqrt(count) + 1), width)
    cells = written(assigned(table, centres), "knn-cells")
    radii = F.broadcast(cells.groupBy("cell").agg(F.max("far").alias("radius")))  # a row for each pivot
    ring = F.when(F.col("radius") > 0, F.least(F.lit(RINGS - 1), F.floor(F.col("far") / F.col("radius") * RINGS))).otherwise(0)
    ringed = cells.join(radii, "cell").withColumn("ring", (F.col("cell") * RINGS + ring).cast("int"))
    per_chunk = max(1, CHUNK_BYTES // (8 * width))
    summary = written(ringed.groupBy("ring").agg(F.max("far").alias("radius"), F.ceil(F.count(F.lit(1)) / per_chunk).cast("int").alias("chunks")), "knn-rings")
    cuts = F.broadcast(summary.select("ring", "chunks"))  # RINGS rows for each pivot
    data = ringed.drop("radius").join(cuts, "ring").select("ring", F.pmod(F.xxhash64("row"), "chunks").cast("int").alias("chunk"), "row", "id", "query", "v")
    tasks = tasks_for(rows, summary.agg(F.sum("chunks")).first()[0], TASK_CHUNKS)

    def meet(data: DataFrame, asked: DataFrame) -> DataFrame:
        columns = ["ring", "chunk", "side", "row", "id", "v"]
        both = data.withColumn("side", F.lit(0)).select(columns).unionByName(asked.withColumn("side", F.lit(1)).select(columns))
        return solved(both.repartition(tasks, "ring", "chunk").sortWithinPartitions("ring", "chunk", "side"), k, width)

    asked = data.where("query")
    near = written(top_of(meet(data, asked), k), "knn-near")
    floor = near.where(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").alias("floor"))
    visits = written(reach(asked.join(floor, "row", "left").select("row", "id", "v", "ring", "chunk", "floor"), centres, summary), "knn-visits")
    visits = visits.select("row", "id", "v", F.struct("ring", "chunk").alias("own"), F.explode("rings").alias("ring"))
    visited = F.broadcast(visits.select("ring").distinct())
    spread = visits.join(cuts, "ring").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where(F.struct("ring", "chunk") != F.col("own"))
    far = meet(data.join(visited, "ring", "left_semi"), spread)
    return top_of(near.drop("rank").unionByName(far), k).select(*named)


def reach(asked: DataFrame, pivots: np.ndarray, summary: DataFrame) -> DataFrame:
    """asked with rings, those whose bound reaches its floor (all if it has none): the chunks that a query must visit."""
    found = summary.select("ring", "radius").collect()  # MOST_PIVOTS x RINGS rows at most
    ring = np.array([r["ring"] for r in found], np.int32)
    shared = asked.sparkSession.sparkContext.broadcast((ring, np.array([r["radius"] for r in found]), pivots[ring // RINGS]))
    width = pivots.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ring, radius, p = shared.value
        lengths = np.sqrt((p**2).sum(1)) + radius
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                part = pdf.iloc[i : i + 256]
                x = matrix(part["v"], width).astype(float)
                size = np.sqrt((x**2).sum(1))[:, None]
                bound = x @ p.T + size * radius + (width + 8) * 2.0**-51 * size * lengths + 1  # no rounding makes it too small
                bound = np.where(bound > 2.0**62, np.inf, bound)
                floor = part["floor"].to_numpy(float, na_value=-np.inf)
                yield part.drop(columns="floor").assign(rings=[ring[ok] for ok in bound >= np.nextafter(floor, -np.inf)[:, None]])

    return asked.mapInPandas(run, VISITS)


def every_zero(table: DataFrame, k: int) -> DataFrame:
    """All vectors are empty, so all scores are 0: the first k + 1 rows are everyone's candidates."""
    first = F.broadcast(table.orderBy("id", "row").limit(k + 1).select("row", "id"))
    return table.where("query").select(F.col("row").alias("query_row"), F.col("id").alias("query_id")).join(first, F.col("query_row") != F.col("row")).withColumn("score", F.lit(0).cast("bigint"))


def top_of(found: DataFrame, k: int) -> DataFrame:
    """Each query's k best, with rank: k rows at most from each chunk it met."""
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
