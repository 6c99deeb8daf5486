"""Block states as a base and deltas, merged now and then.

Each append is a folder of its own. A reader takes the base of the current version and the deltas that are not in it; the latest event of a block counts.
Compaction writes a new base of both with the names of what it took, and publishes them together, so an append at the same time is in no base and stays
a delta. What a version took goes only in vacuum: frames that were opened before a compaction still answer after it.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshelf.operators.index import with_events
from lexshelf.shared import removed
from lexshelf.sources import snapshots

EVENTS = "block_no bigint, index_state int, seq bigint"
#: Deltas up to which reading them costs less than a compaction.
MOST_DELTAS = 64


def append(events: DataFrame, home: str) -> None:
    """Adds events (block_no, index_state, seq)."""
    events.select("block_no", "index_state", "seq").write.parquet(f"{home}/deltas/{time.time_ns():020d}-{uuid.uuid4().hex}")


def opened(spark: SparkSession, home: str) -> tuple[str | None, set[str], list[str]]:
    """The current version, the deltas that are in it, and the others, each of them whole."""
    # Deltas are listed first: one that is merged meanwhile is then known from the version.
    names = sorted(name for name, _ in snapshots.listed(spark, f"{home}/deltas"))
    whole = [n for n in names if any(f == "_SUCCESS" for f, _ in snapshots.listed(spark, f"{home}/deltas/{n}"))]
    version = next(iter(snapshots.history(spark, home)), None)
    merged = {r.name for r in spark.read.schema("name string").parquet(f"{version}/merged").collect()} if version else set()
    return version, merged, [n for n in whole if n not in merged]


def latest(spark: SparkSession, home: str) -> DataFrame:
    """block_no, index_state and seq of the latest event of each block."""
    version, _, deltas = opened(spark, home)
    paths = [*([f"{version}/base"] if version else []), *(f"{home}/deltas/{n}" for n in deltas)]
    rows = spark.read.schema(EVENTS).parquet(*paths) if paths else spark.createDataFrame([], EVENTS)
    return rows.groupBy("block_no").agg(F.max(F.struct("seq", "index_state")).alias("last")).select("block_no", "last.index_state", "last.seq")


def catalog(blocks: DataFrame, home: str) -> DataFrame:
    """The catalog with its latest states."""
    return with_events(blocks, latest(blocks.sparkSession, home))


def compact(spark: SparkSession, home: str, most_deltas: int = 0) -> bool:
    """Merges base and deltas into a new base, if there are more than most_deltas, and tells whether it did."""
    _, merged, deltas = opened(spark, home)
    if len(deltas) <= most_deltas:
        return False
    version = snapshots.new_version(home)
    latest(spark, home).write.parquet(f"{version}/base")  # what came since is merged once more later, which changes nothing
    spark.createDataFrame([(n,) for n in [*sorted(merged), *deltas]], "name string").coalesce(1).write.parquet(f"{version}/merged")
    snapshots.publish(spark, home, version)
    return True


def vacuum(spark: SparkSession, home: str, least_age: float = 86_400) -> None:
    """Removes old versions, and the deltas that are in the current one, if they are older than least_age seconds."""
    snapshots.vacuum(spark, home, 1, least_age)
    version, merged, _ = opened(spark, home)
    before = time.time() - least_age
    for name, changed in snapshots.listed(spark, f"{home}/deltas"):
        if version and name in merged and changed <= before:
            removed(spark, f"{home}/deltas/{name}")
