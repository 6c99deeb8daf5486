"""A sink of numbered binary files: exact bytes, no line ends, made visible by the driver's commit.

Tasks write into a staging folder under names of their own. Only files of tasks that ended well are moved to ``<base>.<part>``, once all have; files of
failed or repeated attempts go with the staging folder, also when the job is aborted.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from lexshelf.operators.running import running_before
from lexshelf.sources.parts import file_system


@dataclass
class Written(WriterCommitMessage):
    """Staged files of a task: part and path."""

    files: list[tuple[int, str]] = field(default_factory=list)


class PartWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.base, self.run = options["path"].rstrip("/"), options["base"], uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = file_system(self.folder)
        staged = f"{folder}/_parts-{self.run}"
        fs.create_dir(staged, recursive=True)
        done, now, out = Written(), None, None
        try:
            for batch in iterator:
                for part, content in zip(batch.column("part").to_pylist(), batch.column("content"), strict=True):
                    if part != now:
                        if out:
                            out.close()
                        now, name = part, f"{staged}/{uuid.uuid4().hex}"
                        out = fs.open_output_stream(name)
                        done.files.append((part, name))
                    out.write(content.as_buffer() if content.is_valid else b"")
        finally:
            if out:
                out.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = file_system(self.folder)
        files = [f for m in messages if m for f in m.files]
        parts = [p for p, _ in files]
        if len(set(parts)) < len(parts):
            self.abort(messages)
            raise ValueError("a part was written by several tasks: partition the rows by part and sort them by it")
        for part, path in files:
            target = f"{folder}/{self.base}.{part}"
            if fs.get_file_info(target).is_file:
                fs.delete_file(target)
            fs.move(path, target)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Removes what is staged."""
        fs, folder = file_system(self.folder)
        staged = f"{folder}/_parts-{self.run}"
        if fs.get_file_info(staged).type != pa.fs.FileType.NotFound:
            fs.delete_dir(staged)


class PartFiles(DataSource):
    """Rows of part and content; the rows of a part are neighbours in one task, in the order in which they are written."""

    @classmethod
    def name(cls) -> str:
        return "part_files"

    def schema(self) -> str:
        return "part int, content binary"

    def writer(self, schema, overwrite: bool) -> PartWriter:
        return PartWriter(self.options)


def write_parts(rows: DataFrame, folder: str, base: str) -> None:
    """Writes rows (part INT, at LONG, content BINARY) as the files ``<base>.<part>`` under folder: the contents of a part in order of at, nothing between."""
    rows.sparkSession.dataSource.register(PartFiles)
    dealt = rows.repartition("part").sortWithinPartitions("part", "at").select(F.col("part").cast("int").alias("part"), F.col("content").cast("binary").alias("content"))
    dealt.write.format("part_files").option("base", base).mode("append").save(folder)


def roll_parts(rows: DataFrame, folder: str, base: str, part_bytes: int, place: str = "place", content: str = "content", first: int = 0) -> None:
    """Writes the contents of rows, in order of place (distinct whole numbers), as one run of bytes cut into files of exactly part_bytes; the last may be shorter.

    A cut may fall inside of a row. Parts are numbered from first on.
    """
    sized = rows.select(F.col(place).cast("bigint").alias("place"), F.coalesce(F.col(content).cast("binary"), F.lit(b"")).alias("content")).where(F.octet_length("content") > 0)
    sized = sized.withColumn("size", F.octet_length("content").cast("bigint"))
    laid = running_before(sized, "place", "size")
    size = F.lit(part_bytes).cast("bigint")
    begin, last = F.floor(F.col("before") / size).cast("int"), F.floor((F.col("before") + F.col("size") - 1) / size).cast("int")
    pieces = laid.withColumn("nth", F.explode(F.sequence(begin, last)))
    start = F.greatest(F.lit(0).cast("bigint"), F.col("nth") * size - F.col("before"))
    stop = F.least(F.col("size"), (F.col("nth") + 1) * size - F.col("before"))
    cut = F.substring(F.col("content"), (start + 1).cast("int"), (stop - start).cast("int"))
    write_parts(pieces.select((F.col("nth") + first).alias("part"), F.col("before").alias("at"), cut.alias("content")), folder, base)
