"""A file behind HTTP, read in ranges by many tasks.

The driver asks for length and ETag; each task gets its own range, under the condition that the file is still the same. A connection that breaks off is taken up
again after the bytes that have come; a changed file, or a server that answers with the whole file, is an error.
"""

from __future__ import annotations

import http.client
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexshelf.sources.binarysink import roll_parts

CHUNK_BYTES, TRIES, WAIT_S, TIMEOUT_S = 16 << 20, 5, 0.2, 60


def head(url: str) -> tuple[int, str | None]:
    """Length and ETag."""
    with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=TIMEOUT_S) as r:
        length, tag = r.headers.get("Content-Length"), r.headers.get("ETag")
    if length is None:
        raise ValueError(f"{url} tells no length")
    return int(length), tag


def get_range(url: str, start: int, stop: int, tag: str | None = None, tries: int = TRIES) -> bytes:
    """Bytes start up to stop."""
    out, failed = b"", 0
    while len(out) < stop - start:
        headers = {"Range": f"bytes={start + len(out)}-{stop - 1}", **({"If-Range": tag} if tag and not tag.startswith("W/") else {})}
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=TIMEOUT_S) as r:
                if r.status != 206 or tag and r.headers.get("ETag", tag) != tag:
                    raise ValueError(f"{url} has changed, or gives no ranges")
                try:
                    more = r.read()
                except http.client.IncompleteRead as e:  # what came so far counts
                    more = e.partial
                out += more
                if not more:
                    raise ConnectionError("no bytes came")
        except (urllib.error.URLError, ConnectionError, TimeoutError) as e:
            if isinstance(e, urllib.error.HTTPError) and e.code < 500:
                raise
            failed += 1
            if failed >= tries:
                raise
            time.sleep(WAIT_S * 2**failed)
    return out[: stop - start]


class Part(InputPartition):
    def __init__(self, start: int, stop: int, tag: str | None) -> None:
        self.start, self.stop, self.tag = start, stop, tag


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.url, self.chunk, self.start = options["path"], int(options.get("chunkBytes", CHUNK_BYTES)), int(options.get("startByte", 0))
        self.tag = options.get("etag")

    def partitions(self) -> list[Part]:
        length, tag = head(self.url)
        if self.tag and self.tag != tag:
            raise ValueError(f"{self.url} has changed")
        return [Part(s, min(s + self.chunk, length), tag) for s in range(self.start, length, self.chunk)] or [Part(0, 0, tag)]

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition.stop > partition.start:
            yield partition.start, get_range(self.url, partition.start, partition.stop, partition.tag)


class HttpRanges(DataSource):
    """start and content of each chunk of a file: options path (the URL), chunkBytes, startByte, and etag, if the file must still have it."""

    @classmethod
    def name(cls) -> str:
        return "http_ranges"

    def schema(self) -> str:
        return "start bigint, content binary"

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options)


def read_ranges(spark: SparkSession, url: str, chunk_bytes: int = CHUNK_BYTES, start: int = 0, tag: str | None = None) -> DataFrame:
    spark.dataSource.register(HttpRanges)
    rows = spark.read.format("http_ranges").option("path", url).option("chunkBytes", chunk_bytes).option("startByte", start)
    return (rows.option("etag", tag) if tag else rows).load()


def download(spark: SparkSession, url: str, folder: str, base: str, part_bytes: int, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Copies a file into parts of exactly part_bytes. Parts that are there already, all of them whole, are kept, and the copy goes on after them."""
    from lexshelf.sources.parts import ByteParts

    have = [n for _, n in ByteParts(f"{folder}/{base}").files]
    whole = next((i for i, n in enumerate(have) if n != part_bytes), len(have))
    length, tag = head(url)
    if sum(have) == length:
        return
    rows = read_ranges(spark, url, chunk_bytes, whole * part_bytes, tag)
    roll_parts(rows.withColumnRenamed("start", "place"), folder, base, part_bytes, first=whole)
