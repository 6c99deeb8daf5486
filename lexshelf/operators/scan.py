"""Prefix scans with any associative composition, in levels: no task meets more than GROUP rows of a stream, and none runs over the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexshelf.shared import settled

#: Neighbours that one step composes. Rows of a frame that a task gives, and bytes of their values.
GROUP = 4096
FRAME_ROWS, FRAME_BYTES = 4096, 4 << 20


def frames(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows, the last column of which may be long, in frames of bounded size."""
    out: list[tuple] = []
    held = 0
    for row in rows:
        out.append(row)
        held += len(row[-1] or "")
        if len(out) == FRAME_ROWS or held > FRAME_BYTES:
            yield pd.DataFrame(out, columns=columns)
            out, held = [], 0
    yield pd.DataFrame(out, columns=columns)


def grouped(rows: DataFrame, group: int) -> DataFrame:
    """rows with their group, neighbours of a group in one task and in order."""
    return rows.withColumn("part", F.floor(F.col("chunk") / group)).repartition("stream", "part").sortWithinPartitions("stream", "part", "chunk")


def runs(batches: Iterator[pd.DataFrame], group: int) -> Iterator[tuple[tuple[int, int], Iterator[tuple]]]:
    """The rows of each group, read as they come."""
    rows = (r for pdf in batches for r in pdf[["stream", "chunk", "value"]].itertuples(index=False, name=None))
    return groupby(rows, key=lambda r: (r[0], r[1] // group))


def prefixes(rows: DataFrame, compose: Callable[[str, str], str], identity: str, group: int = GROUP) -> DataFrame:
    """stream, chunk and before: the values of a stream's smaller chunks composed in order, identity for its first.

    rows: stream bigint, chunk bigint (each once in a stream, none below 0), value string. Each group of neighbours becomes one row, these are scanned in the
    same way, and each group then goes on from what is before it. A level has as many fewer rows as a group holds, so there are few levels.
    """

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def composed() -> Iterator[tuple]:
            for (stream, part), own in runs(batches, group):
                yield stream, part, reduce(compose, (value for _, _, value in own), identity)

        yield from frames(composed(), ["stream", "chunk", "value"])

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def kept() -> Iterator[pd.DataFrame]:
            for pdf in batches:
                heads = pdf[["stream", "part", "base"]].drop_duplicates(["stream", "part"])
                bases.update({(s, p): b for s, p, b in heads.itertuples(index=False, name=None)})
                yield pdf

        def before() -> Iterator[tuple]:
            for key, own in runs(kept(), group):
                whole = bases.pop(key) or identity
                for stream, chunk, value in own:
                    yield stream, chunk, whole
                    whole = compose(whole, value)

        bases: dict[tuple[int, int], str | None] = {}
        yield from frames(before(), ["stream", "chunk", "before"])

    ordered = grouped(rows, group)
    shape = "stream bigint, chunk bigint, before string"
    if rows.agg(F.max("chunk")).first()[0] in range(group) or rows.isEmpty():  # one group for each stream
        return ordered.withColumn("base", F.lit(None).cast("string")).mapInPandas(inside, shape)
    level = settled(ordered.mapInPandas(totals, "stream bigint, chunk bigint, value string"))
    bases = prefixes(level, compose, identity, group).select("stream", F.col("chunk").alias("part"), F.col("before").alias("base"))
    joined = rows.withColumn("part", F.floor(F.col("chunk") / group)).join(bases, ["stream", "part"])
    return joined.repartition("stream", "part").sortWithinPartitions("stream", "part", "chunk").mapInPandas(inside, shape)
