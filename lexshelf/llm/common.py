"""What the operators share: scratch tables in the shared folder, joins that cut hot keys, and text helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshelf.shared import removed, shared_dir

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: The folder of the scratch() block that is open, if any.
FOLDER: ContextVar[str | None] = ContextVar("scratch", default=None)
#: Rows of a key up to which it is never hot, and hot keys for each shuffle partition at most.
COOL_ROWS, HOT_KEYS = 256, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, inside the folder of the open scratch() block if there is one."""
    return f"{FOLDER.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Whatever operators write inside the block is removed at its end: their results must have been written elsewhere by then."""
    path = scratch_path(spark, "scratch")
    token = FOLDER.set(path)
    try:
        yield
    finally:
        FOLDER.reset(token)
        removed(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts lineage: later stages neither repeat the work nor depend on any executor's disk, and
    nondeterministic columns (generated ids) are fixed. Files stay until the scratch() block ends or the folder is cleared.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The column that holds a row of the user's whole, so that none of its names can meet one of an operator's own.
ROW = "row_of_user"


def packed(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(ROW))


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select(f"{ROW}.*")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(df: DataFrame, size: int, share: int) -> int:
    """Tasks for work that must be dealt by hand: the session's shuffle partitions, or as many more as leave share of the size to each."""
    return max(partitions(df), -(-size // share))


def hot_keys(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame | None:
    """keys and cuts, the number of parts to cut each into: those with more rows (n) than an eighth of a partition's share. None if there are none.

    There are fewer than HOT_KEYS for each shuffle partition, so they can be broadcast, whatever the table's size. counts should be a written table.
    """
    total, most = counts.agg(F.sum(n), F.max(n)).first()
    limit = max(COOL_ROWS, int(total or 0) // (HOT_KEYS * partitions(counts)))
    if (most or 0) <= limit:
        return None
    return F.broadcast(counts.where(F.col(n) > limit).select(*keys, F.ceil(F.col(n) / limit).cast("int").alias("cuts_of_key")))


def join_cut(rows: DataFrame, few: DataFrame, counts: DataFrame, keys: list[str], by: list[str], how: str = "inner", n: str = "n") -> DataFrame:
    """rows.join(few, keys, how) for few with a row or so for each key, where some keys have very many rows: their rows are dealt over several
    tasks by a hash of the columns by, and few's row goes to each of these. counts: keys and n, their rows. Keys are never null.
    """
    hot = hot_keys(counts, keys, n)
    if hot is None:
        return rows.join(few, keys, how)
    dealt = rows.join(hot, keys, "left").withColumn("cut_of_key", F.coalesce(F.pmod(F.xxhash64(*by), F.col("cuts_of_key")).cast("int"), F.lit(0))).drop("cuts_of_key")
    copied = few.join(hot, keys, "left").withColumn("cut_of_key", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("cuts_of_key"), F.lit(1)) - 1))).drop("cuts_of_key")
    return dealt.join(copied, [*keys, "cut_of_key"], how).drop("cut_of_key")


def text_of(name: str) -> Column:
    """The column as text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Broadcast df if its counted rows are at most limit; otherwise leave the join to Spark."""
    return F.broadcast(df) if rows <= limit else df
