"""A stream of the blocks of a dump that may still grow.

Offsets are bit positions of marks. A batch takes the blocks from one offset to the next, each of which is complete, as another mark follows it; what comes
after the last mark waits until the dump has grown. Batches are admitted by bytes: the driver looks for the last mark below the limit and reads no more than
two blocks for that. Tasks look for the marks of a batch, a chunk of bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from lexshelf.operators.blocks import MOST_BITS, block_faults, block_titles, decode, marks, titles_only
from lexshelf.operators.index import first_titles, first_wins
from lexshelf.sources.parts import AHEAD, CHUNK_BYTES, ByteParts, file_system
from lexshelf.streaming.observers import Observer, Observers

#: Bytes of a batch, and bytes that are searched for its last mark: two blocks at their largest.
BATCH_BYTES, TAIL = 1 << 34, 2 * MOST_BITS // 8 + 64


def last_mark(dump: ByteParts, at: int, limit: int) -> int:
    """The last mark beyond bit at that begins below byte limit, or the first one after that; at itself if the dump holds none yet.

    The block before a mark is decoded, as a mark may stand inside a block by chance.
    """
    wider = False
    while True:
        limit = min(limit, dump.size)
        begin = at // 8 if wider else max(at // 8, limit - TAIL)
        found = [(8 * begin + b, k) for b, k in marks(dump.read(begin, limit), limit - begin) if 8 * begin + b >= at]
        pairs = list(zip(found, found[1:], strict=False))
        for (start, is_block), (stop, _) in pairs if wider else reversed(pairs):
            try:
                if is_block:
                    decode(dump.read, start, stop)
                return stop
            except (OSError, ValueError, EOFError):
                continue
        if limit == dump.size:
            # The dump's first mark is an offset of its own.
            return found[0][0] if found and found[0][0] > at and begin <= at // 8 else at
        limit, wider = limit + TAIL, True


class Range(InputPartition):
    def __init__(self, start: int, stop: int, first: int, last: int) -> None:
        self.start, self.stop, self.first, self.last = start, stop, first, last


class BlockStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.note = options["path"], options.get("position")
        self.most, self.chunk = int(options.get("maxBytesPerTrigger", BATCH_BYTES)), int(options.get("chunkBytes", CHUNK_BYTES))
        self.at: int | None = None

    def initialOffset(self) -> dict:
        return {"bits": 0}

    def latestOffset(self) -> dict:
        at = self._noted() if self.at is None else self.at
        return {"bits": last_mark(ByteParts(self.path), at, at // 8 + self.most)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        """A restarted query plans the batch that it broke off again, or goes on from the end that is noted here."""
        self.at = end["bits"]
        if self.note:
            fs, path = file_system(self.note)
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(path) as out:
                out.write(str(self.at).encode())
        first, last = start["bits"] // 8, -(-end["bits"] // 8)
        return [Range(s, min(s + self.chunk, last), start["bits"], end["bits"]) for s in range(first, last, self.chunk)]

    def read(self, partition: Range) -> Iterator[tuple]:
        data = ByteParts(self.path).read(partition.start, partition.stop + AHEAD)
        for b, is_block in marks(data, partition.stop - partition.start):
            bits = 8 * partition.start + b
            if is_block and partition.first <= bits < partition.last:
                yield (bits,)

    def _noted(self) -> int:
        if not self.note:
            return 0
        fs, path = file_system(self.note)
        if not fs.get_file_info(path).is_file:
            return 0
        with fs.open_input_stream(path) as f:
            return int(f.read() or b"0")


class DumpBlocks(DataSource):
    """block_start_bits of the blocks of a dump: options path, maxBytesPerTrigger, chunkBytes, and position, a file for the position of restarts."""

    @classmethod
    def name(cls) -> str:
        return "dump_blocks"

    def schema(self) -> str:
        return "block_start_bits bigint"

    def streamReader(self, schema) -> BlockStream:
        return BlockStream(self.options)


def read_blocks(spark: SparkSession, path: str, position: str, most_bytes: int = BATCH_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    spark.dataSource.register(DumpBlocks)
    stream = spark.readStream.format("dump_blocks").option("path", path).option("position", position)
    return stream.option("maxBytesPerTrigger", most_bytes).option("chunkBytes", chunk_bytes).load()


def index_growing(
    spark: SparkSession, dump: str, home: str, most_bytes: int = BATCH_BYTES, chunk_bytes: int = CHUNK_BYTES, observers: dict[str, Observer] | None = None
) -> StreamingQuery:
    """Indexes a dump that grows, in batches of whole blocks, until it is stopped; started again, it goes on from the block after the last batch.

    Each batch writes its titles (and faults of blocks that cannot be read) as files of its own, which a repeated batch overwrites. No batch reads what earlier ones wrote:
    titles_so_far keeps the first of each. processAllAvailable() waits for all that the dump holds now. observers are told of each batch's rows of
    block_titles() after these are indexed.
    """
    told = Observers(f"{home}/told", observers or {})

    def add(batch: DataFrame, number: int) -> None:
        stage = f"{home}/found/batch={number}"
        block_titles(batch, dump).write.mode("overwrite").parquet(stage)
        found = batch.sparkSession.read.parquet(stage)
        first_wins(titles_only(found)).write.mode("overwrite").parquet(f"{home}/titles/batch={number}")
        block_faults(found).write.mode("overwrite").parquet(f"{home}/faults/batch={number}")
        told.tell(found, number)

    rows = read_blocks(spark, dump, f"{home}/position", most_bytes, chunk_bytes)
    return rows.writeStream.foreachBatch(add).option("checkpointLocation", f"{home}/checkpoint").start()


def titles_so_far(spark: SparkSession, home: str) -> DataFrame:
    """One row for each title that the batches found, the first by block and position."""
    return first_titles(spark, f"{home}/titles")


def batches(spark: SparkSession, home: str) -> DataFrame:
    """batch and blocks: how many blocks each batch read to their end."""
    found = spark.read.schema("block_start_bits bigint, title_start_pos bigint, title string, fault string, batch int").parquet(f"{home}/found")
    return found.where("title is null and fault is null").groupBy("batch").agg(F.count_distinct("block_start_bits").alias("blocks"))
