"""The block catalog and the title index: first writer wins, states, sorted layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshelf.schemas import FINISHED, INITIAL, TITLE_CHARS, TITLES, conform
from lexshelf.shared import there


def first_wins(titles: DataFrame) -> DataFrame:
    """One row for each title, the first by block and position (K3). min() is combined before the shuffle, so a title in very many pages is no hot key."""
    least = titles.where(F.char_length("title") <= TITLE_CHARS).groupBy("title").agg(F.min(F.struct("block_start_bits", "title_start_pos")).alias("at"))
    return conform(least.select("at.block_start_bits", "at.title_start_pos", "title"), TITLES)


def new_titles(titles: DataFrame, index: DataFrame) -> DataFrame:
    """Titles that the index lacks."""
    return first_wins(titles).join(index.select("title"), "title", "left_anti").select(TITLES.names)


def write_index(titles: DataFrame, path: str, partitions: int | None = None, file_rows: int = 0) -> None:
    """The index sorted by title: files (of at most file_rows rows, if that is given) and row groups hold narrow ranges, so seeks and lookups read few of them."""
    ranged = titles.repartitionByRange(partitions, "title") if partitions else titles.repartitionByRange("title")
    ranged.sortWithinPartitions("title").write.option("maxRecordsPerFile", file_rows).mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TITLES).parquet(path)


def first_titles(spark: SparkSession, path: str) -> DataFrame:
    """One row for each title of an index that runs or batches appended to without reading it: the first by block and position, whichever of them wrote it. Empty before the first write."""
    return first_wins(read_index(spark, path)) if there(spark, path) else spark.createDataFrame([], TITLES)


def state_of(state: Column) -> Column:
    """A missing state is INITIAL."""
    return F.coalesce(state, F.lit(INITIAL))


def pending(blocks: DataFrame) -> DataFrame:
    """Blocks still to be indexed."""
    return blocks.where(state_of(F.col("index_state")) == INITIAL)


def mark_finished(blocks: DataFrame, block_no: int) -> DataFrame:
    """The catalog with one block's state set."""
    return blocks.withColumn("index_state", F.when(F.col("block_no") == block_no, F.lit(FINISHED)).otherwise(F.col("index_state")))


def with_events(blocks: DataFrame, events: DataFrame) -> DataFrame:
    """The catalog with appended state events (block_no, index_state, seq): the latest counts."""
    latest = events.groupBy("block_no").agg(F.max_by("index_state", "seq").alias("now"))
    return blocks.join(latest, "block_no", "left").withColumn("index_state", F.coalesce("now", state_of(F.col("index_state")))).drop("now").select(blocks.columns)


def blocks_from(blocks: DataFrame, bits: int) -> DataFrame:
    """Blocks from a bit position on, by number (S3)."""
    return blocks.where(F.col("block_start_bits") >= bits).orderBy("block_no")


def latest_block(blocks: DataFrame) -> DataFrame:
    """The block with the highest number; none for an empty catalog."""
    return blocks.orderBy(F.desc("block_no")).limit(1)


def is_complete(blocks: DataFrame) -> DataFrame:
    """complete: whether every block is FINISHED (K-13)."""
    return blocks.agg(F.coalesce(F.bool_and(state_of(F.col("index_state")) == FINISHED), F.lit(False)).alias("complete"))


def block_count(blocks: DataFrame) -> DataFrame:
    """blocks and latest: how many there are, and the highest number."""
    return blocks.agg(F.count(F.lit(1)).alias("blocks"), F.max("block_no").alias("latest"))


def first_blocks(blocks: DataFrame, n: int) -> DataFrame:
    """Positions of the first n blocks by number."""
    return blocks.orderBy("block_no").limit(n).select("block_no", "block_start_bits")
