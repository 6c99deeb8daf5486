"""Explicit schemas of all tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCKS = T.StructType([T.StructField("block_no", T.LongType(), False), T.StructField("block_start_bits", T.LongType(), False), T.StructField("index_state", T.IntegerType(), False)])
TITLES = T.StructType([T.StructField("block_start_bits", T.LongType(), False), T.StructField("title_start_pos", T.LongType(), False), T.StructField("title", T.StringType(), False)])
PAGES = T.StructType(
    [
        T.StructField("title", T.StringType(), False),
        T.StructField("id", T.LongType()),
        T.StructField("rev_id", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("contributor_ip", T.ArrayType(T.StringType())),
        T.StructField("comment", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
#: Index states.
INITIAL, STARTED, FINISHED = 0, 1, 2
#: Longest title, in characters, that the index takes.
TITLE_CHARS = 4096


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order and types; missing ones are null."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def create_table(spark, name: str, schema: T.StructType, location: str | None = None) -> None:
    """CREATE TABLE IF NOT EXISTS ... USING parquet (S1, S6), in the warehouse or at a location."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet" + (f" LOCATION '{location}'" if location else ""))
