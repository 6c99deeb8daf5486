"""The build as restartable stages (R1, R2, C23): properties, source check, block search, indexing.

Properties are appended rows of which the latest counts, laid over defaults. Whether a stage is done follows from the tables
themselves, so an interrupted or partly failed run is never taken for a finished one.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshelf.operators import states, titleindex
from lexshelf.operators.blocks import as_catalog, find_blocks
from lexshelf.operators.index import first_titles, is_complete, latest_block
from lexshelf.plans import leases
from lexshelf.schemas import BLOCKS
from lexshelf.sources.parts import ByteParts
from lexshelf.streaming.incremental import index_blocks, table_or_none

#: Bytes of a dump that are scanned between two commits of the catalog.
SCAN_BYTES = 1 << 38


def properties(spark: SparkSession, path: str, defaults: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """key, value: the latest value of each property, or its default (E9), of a dictionary or of a table of keys and values."""
    kept = table_or_none(spark, path, "key string, value string, seq bigint").groupBy("key").agg(F.max_by("value", "seq").alias("kept"))
    known = defaults if isinstance(defaults, DataFrame) else spark.createDataFrame(list((defaults or {}).items()), "key string, value string")
    return known.join(kept, "key", "full").select("key", F.coalesce("kept", "value").alias("value"))


def set_properties(rows: DataFrame, path: str) -> None:
    """Adds settings (key, value, seq); of a key, the one with the greatest seq counts."""
    rows.select("key", "value", "seq").write.mode("append").parquet(path)


def set_property(spark: SparkSession, path: str, key: str, value: str) -> None:
    set_properties(spark.createDataFrame([(key, value, time.time_ns())], "key string, value string, seq bigint"), path)


def fingerprint(dump: str) -> str:
    """Names and sizes of the dump's parts: a changed source shows here (K-23)."""
    return ";".join(f"{path.rpartition('/')[2]}={size}" for path, size in ByteParts(dump).files)


def catalog(spark: SparkSession, home: str) -> DataFrame:
    """The block catalog with its latest states."""
    return states.catalog(table_or_none(spark, f"{home}/blocks", BLOCKS), f"{home}/states")


def scan(spark: SparkSession, dump: str, home: str, scan_bytes: int = SCAN_BYTES, most_scans: int | None = None) -> None:
    """Finds the dump's blocks, scan_bytes at a time (R2): each time the scan goes on from the last block that the catalog holds."""
    size, done = ByteParts(dump).size, 0
    while most_scans is None or done < most_scans:
        known = {r.key: r.value for r in properties(spark, f"{home}/properties").collect()}
        scanned = int(known.get("scanned", 0))
        if scanned >= size:
            return
        last = latest_block(table_or_none(spark, f"{home}/blocks", BLOCKS)).first()  # one row
        stop = min(scanned + scan_bytes, size)
        as_catalog(find_blocks(spark, dump, after=last and (last["block_no"], last["block_start_bits"]), stop=stop)).write.mode("append").parquet(f"{home}/blocks")
        set_property(spark, f"{home}/properties", "scanned", str(stop))
        done += 1


def build(spark: SparkSession, dump: str, home: str, expected_bytes: int | None = None, most_blocks: int | None = None, scan_bytes: int = SCAN_BYTES) -> DataFrame:
    """Brings the tables under home up to date with a dump and returns complete, blocks and titles; run it again to go on.

    expected_bytes is checked before anything else (K-14); most_blocks limits the blocks indexed by this run. A run may be broken off at any point (R7):
    what it committed stays and can be searched (R6), and the next run goes on from there. Another build under the same home at the same time raises leases.Held;
    leases.cancel ends a build of this application.
    """
    with leases.held(spark, home):
        return built(spark, dump, home, expected_bytes, most_blocks, scan_bytes)


def built(spark: SparkSession, dump: str, home: str, expected_bytes: int | None, most_blocks: int | None, scan_bytes: int) -> DataFrame:
    """The work of build, for the holder of the lease."""
    size = ByteParts(dump).size
    if expected_bytes is not None and size != expected_bytes:
        raise ValueError(f"the dump has {size} bytes, not {expected_bytes}")
    known = {r.key: r.value for r in properties(spark, f"{home}/properties").collect()}  # a handful of rows
    now = fingerprint(dump)
    if known.get("source", now) != now:
        raise ValueError("the dump has changed since this index was begun: use another home")
    if "source" not in known:
        set_property(spark, f"{home}/properties", "source", now)
    scan(spark, dump, home, scan_bytes)
    todo = catalog(spark, home)
    if most_blocks is not None:
        todo = todo.where("index_state = 0").orderBy("block_no").limit(most_blocks)
    index_blocks(spark, todo, dump, f"{home}/titles", f"{home}/states")
    titles = first_titles(spark, f"{home}/titles").count()
    return is_complete(catalog(spark, home)).withColumns({"blocks": F.lit(catalog(spark, home).count()), "titles": F.lit(titles)})


def publish(spark: SparkSession, home: str, partitions: int | None = None) -> str:
    """Publishes the titles that are indexed so far as a new version, which searches open from now on: TitleIndex(spark, home)."""
    return titleindex.publish(first_titles(spark, f"{home}/titles"), home, partitions)
