"""A dump stored in numbered parts: listing, joining addresses, and a data source that reads it in chunks.

The data source reads through Arrow's file systems, so paths may be local or in any store that they know. Each chunk is one
partition, however large the parts are.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexshelf.shared import removed

#: Bytes that a chunk shows beyond its own: a 48-bit mark that begins in its last byte needs seven bytes.
AHEAD = 7
CHUNK_BYTES = 16 << 20


def file_system(path: str):
    """Arrow's file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)


class ByteParts:
    """Parts ``<base>.0``, ``<base>.1``, ..., or one file, or all files of a folder by name, as one run of bytes."""

    def __init__(self, path: str, files: list[tuple[str, int]] | None = None) -> None:
        """files: the parts with their sizes, if they are known."""
        from pyarrow import fs

        self.fs, base = file_system(path)
        base = base.rstrip("/")
        if files is not None:
            self.files = files
            self.measure()
            return
        if self.fs.get_file_info(base).type == fs.FileType.Directory:
            found = [f for f in self.fs.get_file_info(fs.FileSelector(base)) if f.base_name[0] not in "._"]
            parts = sorted(found, key=lambda f: f.base_name)
        else:
            folder, _, name = base.rpartition("/")
            found = [f for f in self.fs.get_file_info(fs.FileSelector(folder or ".", allow_not_found=True)) if f.base_name == name or f.base_name.startswith(name + ".") and f.base_name[len(name) + 1 :].isdigit()]
            parts = sorted((f for f in found if f.base_name != name), key=lambda f: int(f.base_name[len(name) + 1 :])) or found
        self.files = [(f.path, f.size) for f in parts if f.is_file]
        self.measure()

    def measure(self) -> None:
        """Where each file ends, and so all of them."""
        self.ends = list(accumulate(n for _, n in self.files))
        self.size = self.ends[-1] if self.ends else 0

    def about(self, start: int, stop: int) -> tuple[list[tuple[str, int]], int]:
        """The files that hold bytes from start up to stop, and the first byte of the first one; found by halving, as a dump has very many chunks and parts."""
        if stop <= start:
            return [], 0
        i = bisect_right(self.ends, start)  # the first file that ends beyond start
        own = self.files[i : bisect_left(self.ends, stop) + 1]
        return own, self.ends[i] - own[0][1] if own else 0

    def read(self, start: int, stop: int) -> bytes:
        files, at = self.about(start, stop)
        out = []
        for path, n in files:
            a, b = max(start, at), min(stop, at + n)
            if a < b:
                with self.fs.open_input_file(path) as f:
                    out.append(f.read_at(b - a, a - at))
            at += n
        return b"".join(out)


class Chunk(InputPartition):
    """Bytes from start up to stop, the files that hold them, and where the first of these begins."""

    def __init__(self, start: int, stop: int, files: list[tuple[str, int]], first: int) -> None:
        self.start, self.stop, self.files, self.first = start, stop, files, first


class ChunkReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.chunk = options["path"], int(options.get("chunkBytes", CHUNK_BYTES))
        self.start, self.stop = int(options.get("startByte", 0)), int(options.get("stopByte", -1))

    def partitions(self) -> list[Chunk]:
        dump = ByteParts(self.path)  # the one listing
        stop = min(self.stop, dump.size) if self.stop >= 0 else dump.size
        ends = [(s, min(s + self.chunk, stop)) for s in range(self.start, stop, self.chunk)]
        return [Chunk(s, e, *dump.about(s, e + AHEAD)) for s, e in ends] or [Chunk(0, 0, [], 0)]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        if partition.stop > partition.start:
            own = ByteParts(self.path, partition.files)
            yield partition.start, partition.stop - partition.start, own.read(partition.start - partition.first, partition.stop + AHEAD - partition.first)


class DumpChunks(DataSource):
    """start, length, content: own bytes and AHEAD more of each chunk."""

    @classmethod
    def name(cls) -> str:
        return "dump_chunks"

    def schema(self) -> str:
        return "start bigint, length bigint, content binary"

    def reader(self, schema) -> ChunkReader:
        return ChunkReader(self.options)


def read_chunks(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, start: int = 0, stop: int = -1) -> DataFrame:
    """Chunks of the bytes from start up to stop (-1: the end)."""
    spark.dataSource.register(DumpChunks)
    return spark.read.format("dump_chunks").option("path", path).option("chunkBytes", chunk_bytes).option("startByte", start).option("stopByte", stop).load()


def list_parts(spark: SparkSession, folder: str, base: str) -> DataFrame:
    """path, part, length of the files named base.N (C11, C12); contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"{base}.*").load(folder).select("path", "length")
    return found.withColumn("part", F.expr("try_cast(substring_index(path, '.', -1) as int)")).where("part is not null")


def parts_summary(parts: DataFrame) -> DataFrame:
    """total_length and part_count."""
    return parts.agg(F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("total_length"), F.count(F.lit(1)).alias("part_count"))


def drop_last_part(spark: SparkSession, folder: str, base: str) -> None:
    """Deletes the part with the highest number, if there is any."""
    found = last_part(list_parts(spark, folder, base)).first()
    if found["path"]:
        removed(spark, found["path"])


def last_part(parts: DataFrame) -> DataFrame:
    """The part with the highest number, by number."""
    return parts.agg(F.max_by("path", "part").alias("path"), F.max("part").alias("part"))
