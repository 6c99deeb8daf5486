"""Block record files: 20 bytes a record, big-endian long, long, int."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshelf.functions.text import decode_long, encode_record
from lexshelf.sources.binarysink import roll_parts, write_parts
from lexshelf.sources.parts import last_part, list_parts

RECORD_BYTES, BASE = 20, "blocks"


def to_records(blocks: DataFrame) -> DataFrame:
    """blocks with column record."""
    return blocks.withColumn("record", encode_record(F.col("block_no"), F.col("block_start_bits"), F.coalesce("index_state", F.lit(0))))


def from_records(records: DataFrame) -> DataFrame:
    return records.select(decode_long(F.col("record"), 1).alias("block_no"), decode_long(F.col("record"), 9).alias("block_start_bits"), decode_long(F.col("record"), 17, 4).cast("int").alias("index_state"))


def write_record_files(blocks: DataFrame, path: str, per_file: int = 4096, base: str = BASE) -> None:
    """Files ``<base>.<n>`` of per_file block numbers each (C17): 20 bytes a block, nothing else."""
    rows = to_records(blocks).select(F.floor(F.col("block_no") / per_file).cast("int").alias("part"), F.col("block_no").alias("at"), F.col("record").alias("content"))
    write_parts(rows, path, base)


def append_record_files(blocks: DataFrame, path: str, per_file: int = 4096, base: str = BASE) -> None:
    """Adds blocks as further files, after those that are there."""
    last = last_part(list_parts(blocks.sparkSession, path, base)).first().part
    rows = to_records(blocks).select(F.col("block_no").alias("place"), F.col("record").alias("content"))
    roll_parts(rows, path, base, RECORD_BYTES * per_file, first=0 if last is None else last + 1)


def repair_record_files(spark: SparkSession, path: str, base: str = BASE) -> int:
    """Cuts files that end inside a record back to whole records (C19) and returns how many there were. Each is written anew and then takes the place of the old one."""
    files = list_parts(spark, path, base).where(F.col("length") % RECORD_BYTES != 0)
    content = spark.read.format("binaryFile").option("pathGlobFilter", f"{base}.*").load(path).select("path", "content")
    whole = F.substring(F.col("content"), F.lit(1), (F.floor(F.col("length") / RECORD_BYTES) * RECORD_BYTES).cast("int"))
    n = files.count()
    if n:
        write_parts(files.join(content, "path").select("part", F.lit(0).alias("at"), whole.alias("content")), path, base)
    return n


def read_record_files(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all files under path. A partial record at a file's end is left out; a file is read whole by a task, so write files of a bounded size."""
    files = spark.read.format("binaryFile").load(path).select("path", "content", F.floor(F.col("length") / RECORD_BYTES).cast("int").alias("n")).where("n > 0")
    each = files.select("path", "content", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return from_records(each.select(F.substr("content", F.col("i") * RECORD_BYTES + 1, F.lit(RECORD_BYTES)).alias("record")))


def last_record(spark: SparkSession, path: str) -> DataFrame:
    """The last whole record of each file; none for files without one."""
    files = spark.read.format("binaryFile").load(path).select("content", F.floor(F.col("length") / RECORD_BYTES).cast("int").alias("n")).where("n > 0")
    return from_records(files.select(F.substr("content", (F.col("n") - 1) * RECORD_BYTES + 1, F.lit(RECORD_BYTES)).alias("record")))
