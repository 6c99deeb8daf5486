"""Incremental, restartable indexing with Structured Streaming.

Each batch or run appends its titles first and its state after them, and reads nothing of what others wrote, so its cost does not grow with the index. Titles
that come again, in later batches or because a run was repeated, are told apart where the index is read or published (index.first_titles), not by state kept for every title.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from lexshelf.operators import states
from lexshelf.operators.blocks import as_catalog, block_titles, blocks_done, find_blocks, titles_only
from lexshelf.operators.index import first_wins, pending
from lexshelf.schemas import FINISHED
from lexshelf.shared import there
from lexshelf.sources.parts import ByteParts

#: What a stream of files has.
FILES = "path string, modificationTime timestamp, length bigint, content binary"


class Progress(StreamingQueryListener):
    """Calls told(batch, rows, rows a second) after each batch (C4, R5): spark.streams.addListener(Progress(print))."""

    def __init__(self, told) -> None:
        self.told = told

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.told(p.batchId, p.numInputRows, p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def table_or_none(spark: SparkSession, path: str, schema) -> DataFrame:
    """The Parquet table at path, empty before the first write."""
    return spark.read.schema(schema).parquet(path) if there(spark, path) else spark.createDataFrame([], schema)


def ranges_of(dump: ByteParts, names: set[str]) -> list[tuple[int, int]]:
    """First byte and end of each run of neighbouring files with these names."""
    out, at = [], 0
    for path, size in dump.files:
        if path.rpartition("/")[2] in names:
            out = [*out[:-1], (out[-1][0], at + size)] if out and out[-1][1] == at else [*out, (at, at + size)]
        at += size
    return out


def index_stream(spark: SparkSession, folder: str, index_path: str, checkpoint: str, files_per_trigger: int = 16) -> StreamingQuery:
    """Adds the titles of new dump files in folder to the index (read it by first_titles) and ends when all are read; rerun it, or stop() it and rerun it, to go on.

    The folder's files in order of name are one run of bytes, to which positions refer (fetch_markup takes them with the folder), so new files must have later
    names. The stream itself carries names only; blocks are sought and decoded in the ranges of the batch's files.
    """

    def add(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        names = {r["path"].rpartition("/")[2] for r in batch.select("path").collect()}  # files_per_trigger rows
        blocks = [find_blocks(own, folder, start=a, stop=b) for a, b in ranges_of(ByteParts(folder), names)]
        if not blocks:
            return
        titles = titles_only(block_titles(reduce(DataFrame.unionByName, blocks), folder))
        # One folder for each batch, overwritten if the batch is repeated.
        first_wins(titles).write.mode("overwrite").parquet(f"{index_path}/batch={number}")

    rows = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_trigger).load(folder).select("path")
    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_blocks(spark: SparkSession, blocks: DataFrame, dump: str, index_path: str, states_home: str, most_deltas: int = states.MOST_DELTAS) -> None:
    """Indexes the pending blocks of a catalog, and appends titles, then events for the blocks that were read to their end (K4).

    The states of blocks are those of operators.states: a delta for each run, merged into a base when there are more than most_deltas.
    """
    todo = pending(states.catalog(as_catalog(blocks), states_home))
    found = block_titles(todo, dump)
    stage = f"{states_home}-found"
    found.write.mode("overwrite").parquet(stage)
    found = spark.read.parquet(stage)
    first_wins(titles_only(found)).write.mode("append").parquet(index_path)
    done = todo.join(blocks_done(found), "block_start_bits").select("block_no", F.lit(FINISHED).alias("index_state"), F.unix_millis(F.current_timestamp()).alias("seq"))
    states.append(done, states_home)
    if states.compact(spark, states_home, most_deltas):
        states.vacuum(spark, states_home)
