"""The compressed-block lane: marks at bit precision, block pairs, carving, decoding, titles and pages by position.

Blocks of a bzip2 stream begin at any bit with a 48-bit mark; another mark ends a stream. Both are sought, so the last
block of each stream ends where its end mark begins.
"""

from __future__ import annotations

import bz2
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexshelf.functions.text import decode_entities, fault_of
from lexshelf.operators.scan import frames
from lexshelf.schemas import BLOCKS, INITIAL, TITLES, conform
from lexshelf.shared import settled
from lexshelf.sources.parts import AHEAD, CHUNK_BYTES, ByteParts, read_chunks

#: Marks of a block and of a stream's end, and the length of a mark, in bits.
BLOCK_MARK, END_MARK, MARK_BITS = 0x314159265359, 0x177245385090, 48
#: Bytes read at once, and the most bits that a block takes up: at 900,000 bytes it is never packed to more than this. Bytes searched at once, each of which takes some 32 in arrays.
READ_BYTES, MOST_BITS, SEEK_BYTES = 1 << 18, 8 * 1_100_000, 1 << 18
#: Blocks that a task decodes.
TASK_BLOCKS = 64


def marks(data: bytes, own: int) -> list[tuple[int, bool]]:
    """(bit, is a block) of each mark that begins in the first own bytes, sought in SEEK_BYTES at a time, so that memory does not grow with data."""
    out = []
    for at in range(0, own, SEEK_BYTES):
        piece = data[at : at + SEEK_BYTES + AHEAD]
        out += [(8 * at + bit, is_block) for bit, is_block in marks_at_once(piece, min(SEEK_BYTES, own - at))]
    return out


def marks_at_once(data: bytes, own: int) -> list[tuple[int, bool]]:
    if len(data) < 6:
        return []
    b = np.frombuffer(data + b"\0\0", np.uint8).astype(np.uint64)
    n = min(own, len(data) - 5)
    word = np.zeros(n, np.uint64)
    for i in range(8):
        word = word << np.uint64(8) | b[i : i + n] if len(b) >= i + n else word << np.uint64(8) | np.r_[b[i:], np.zeros(i + n - len(b), np.uint64)]
    out = []
    for shift in range(8):
        seen = word >> np.uint64(16 - shift) & np.uint64((1 << MARK_BITS) - 1)
        for mark in (BLOCK_MARK, END_MARK):
            out += [(int(i) * 8 + shift, mark == BLOCK_MARK) for i in np.flatnonzero(seen == np.uint64(mark)) if int(i) * 8 + shift + MARK_BITS <= 8 * len(data)]
    return sorted(out)


def scan_marks(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, start: int = 0, stop: int = -1) -> DataFrame:
    """chunk (its first byte), bits, is_block of the marks that begin in the bytes from start up to stop: one task for each chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start, length, content in pdf.itertuples(index=False):
                found = marks(content, length)
                yield pd.DataFrame({"chunk": start, "bits": [8 * start + b for b, _ in found], "is_block": [k for _, k in found]})

    return read_chunks(spark, path, chunk_bytes, start, stop).mapInPandas(run, "chunk bigint, bits bigint, is_block boolean")


def numbered(marked: DataFrame) -> DataFrame:
    """written marks with block_no (from 0; an end mark has that of the block before it) and stop_bits (the next mark).

    Windows run inside chunks; only one row for each chunk is ordered globally.
    """
    order = Window.partitionBy("chunk").orderBy("bits")
    chunks = marked.groupBy("chunk").agg(F.count(F.when(F.col("is_block"), 1)).alias("n"), F.min("bits").alias("first"))
    whole = Window.orderBy("chunk")
    chunks = chunks.select(
        "chunk", F.coalesce(F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lead("first").over(whole).alias("next")
    )
    inside = marked.select("*", F.sum(F.col("is_block").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("nth"), F.lead("bits").over(order).alias("later"))
    return inside.join(chunks, "chunk").select((F.col("before") + F.col("nth") - 1).alias("block_no"), F.col("bits").alias("block_start_bits"), F.coalesce("later", "next").alias("stop_bits"), "is_block")


def find_blocks(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, after: tuple[int, int] | None = None, start: int = 0, stop: int = -1) -> DataFrame:
    """blocks, with stop_bits; index_state is INITIAL.

    after (number and first bit of the last block that is known) begins the scan at that block's byte and finds the ones beyond it (B4);
    start and stop bound the bytes that are scanned.
    """
    number, bits = after or (0, 8 * start)
    marked = settled(scan_marks(spark, path, chunk_bytes, bits // 8, stop).where(F.col("bits") >= bits))
    found = numbered(marked).where("is_block").withColumn("block_no", F.col("block_no") + number)
    found = found.where(F.col("block_no") > number) if after else found
    return found.select("block_no", "block_start_bits", F.lit(INITIAL).alias("index_state"), "stop_bits")


def pair_blocks(blocks: DataFrame, end_bits: int | None = None) -> DataFrame:
    """blocks with stop_bits, the start of the next one (B6), for catalogs without stop_bits; the last one stops at end_bits."""
    following = blocks.select((F.col("block_no") - 1).alias("block_no"), F.col("block_start_bits").alias("stop_bits"))
    return blocks.join(following, "block_no", "left").withColumn("stop_bits", F.coalesce("stop_bits", F.lit(end_bits).cast("bigint")))


def carve(read, starts: list[int], stop: int) -> bytes:
    """A stream of the blocks at starts, which ends at bit stop: header, their bits, end mark, combined checksum, padding.

    read(a, b) gives bytes a to b of the dump. A block's checksum follows its mark; the combined one rotates left before each xor.
    """
    first = starts[0]
    data = int.from_bytes(read(first // 8, -(-stop // 8)), "big") >> -stop % 8
    bits = stop - first
    data &= (1 << bits) - 1
    check = 0
    for s in starts:
        own = data >> (bits - (s - first) - MARK_BITS - 32) & 0xFFFFFFFF
        check = ((check << 1 | check >> 31) & 0xFFFFFFFF) ^ own
    data, bits = (data << MARK_BITS | END_MARK) << 32 | check, bits + MARK_BITS + 32
    return b"BZh9" + (data << -bits % 8).to_bytes(-(-bits // 8), "big")


def decode(read, start: int, stop: int) -> bytes:
    return bz2.decompress(carve(read, [start], stop))


def decode_on(dump: ByteParts, start: int) -> Iterator[tuple[bytes, list[int]]]:
    """Decoded bytes of the block at bit start and of all that follow, one by one; marks are sought as it goes.

    A mark may stand inside a block by chance. A block that fails its checksum is therefore tried up to the marks after the next one as well; each
    block comes with the marks that turned out to stand inside it.
    """
    at, data, base, own = start, b"", start // 8, 0
    found: list[tuple[int, bool]] = []

    def sought(n: int) -> bool:
        """Whether n more marks are known, after reading on for them."""
        nonlocal data, own, found
        while len(found) < n and base + len(data) < dump.size:
            data += dump.read(base + len(data), base + len(data) + READ_BYTES)
            last = base + len(data) >= dump.size
            fresh = marks(data[own:], len(data) - own if last else len(data) - own - 7)
            found += [(8 * (base + own) + b, k) for b, k in fresh if 8 * (base + own) + b >= at]
            own = len(data) if last else max(len(data) - 7, 0)
        return len(found) >= n

    while sought(2):
        n = 1
        if found[0][1]:
            while True:
                try:
                    decoded = decode(lambda a, b: data[a - base : b - base], found[0][0], found[n][0])
                    break
                except (OSError, ValueError, EOFError):
                    n += 1
                    if not sought(n + 1) or found[n][0] - found[0][0] > MOST_BITS:
                        raise
            yield decoded, [bits for bits, _ in found[1:n]]
        found = found[n:]
        cut = found[0][0] // 8 - base
        at, data, base, own = found[0][0], data[cut:], base + cut, own - cut


def dealt(blocks: DataFrame) -> DataFrame:
    """block_start_bits, at most TASK_BLOCKS (or so) to a task: a block is eight bytes for Spark, which would give very many to one, and a megabyte of work."""
    rows = settled(blocks.select("block_start_bits"))
    n = rows.count()
    wanted = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_BLOCKS))
    return rows.repartition(max(min(n, wanted), 1))


FOUND = "block_start_bits bigint, title_start_pos bigint, title string, fault string"


def block_titles(blocks: DataFrame, path: str) -> DataFrame:
    """titles of the pages whose ``<page>`` begins in each block (R3), and status rows with a null title.

    A status row without a fault is a block that was read to its end, or a mark that stands inside such a block; one with a fault tells why a block could
    not be read. A title with a fault held bytes that are no UTF-8. A head that runs over the block's end is completed from the following blocks.
    """

    def heads(dump: ByteParts, start: int) -> tuple[list[tuple[int, bytes]], list[int]]:
        following = decode_on(dump, start)
        data, inside = next(following, (b"", []))
        own, at, out = len(data), 0, []

        def grow() -> bool:
            nonlocal data
            more, _ = next(following, (b"", []))
            data += more
            return bool(more)

        while 0 <= (at := data.find(b"<", at)) < own:
            while len(data) < at + 7 and b"<page>".startswith(data[at : at + 6]) and grow():
                pass
            if data[at : at + 6] == b"<page>" or data[at : at + 6] == b"<page ":
                while (stop := data.find(b"</title>", at)) < 0 and data.find(b"</page>", at) < 0 and grow():
                    pass
                begin, leave = data.find(b"<title>", at), data.find(b"</page>", at)
                if 0 <= begin < stop and (leave < 0 or stop < leave):
                    out.append((at, data[begin + 7 : stop]))
            at += 1
        return out, inside

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dump = ByteParts(path)
        for pdf in batches:
            for start in map(int, pdf["block_start_bits"]):
                try:
                    found, inside = heads(dump, start)
                except (OSError, ValueError, EOFError) as e:
                    rows = [(start, -1, None, str(e) or type(e).__name__)]  # the block keeps its state, and a later run tries it again
                else:
                    rows = [(bits, -1, None, None) for bits in [start, *inside]] + [(start, p, t.decode("utf-8", "replace"), fault_of(t)) for p, t in found]
                yield pd.DataFrame(rows, columns=[f.split()[0] for f in FOUND.split(", ")])

    found = dealt(blocks).mapInPandas(run, FOUND)
    return found.withColumn("title", decode_entities(F.col("title")))


def titles_only(found: DataFrame) -> DataFrame:
    return conform(found.where("title is not null"), TITLES)


def blocks_done(found: DataFrame) -> DataFrame:
    return found.where("title is null and fault is null").select("block_start_bits").distinct()


def block_faults(found: DataFrame) -> DataFrame:
    """block_start_bits and fault of the blocks that could not be read."""
    failed = found.where("title is null and fault is not null").select("block_start_bits", "fault")
    return failed.join(blocks_done(found), "block_start_bits", "left_anti")


def markup(dump: ByteParts, entries: Iterator[tuple[int, int, str]]) -> Iterator[tuple[int, int, str, str | None]]:
    """Entries with their pages' text, one by one as they come; neighbours of one block share its decoding."""
    now, data = None, b""
    following: Iterator[tuple[bytes, list[int]]] = iter(())
    for start, pos, title in entries:
        if start != now:
            now, data, following = start, b"", decode_on(dump, int(start))
        seek = int(pos)
        while (stop := data.find(b"</page>", seek)) < 0 and (more := next(following, (b"", []))[0]):
            seek = max(len(data) - 7, int(pos))
            data += more
        yield start, pos, title, data[pos:stop].decode("utf-8", "replace") if stop >= 0 else None


def fetch_markup(entries: DataFrame, path: str) -> DataFrame:
    """entries (block_start_bits, title_start_pos, title) with value, the page's text up to ``</page>`` (Q3 by position).

    Entries of one block meet in one task, so that each block is decoded once. Texts leave a task in frames of bounded size.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for pdf in batches for r in pdf.itertuples(index=False, name=None))
        yield from frames(markup(ByteParts(path), rows), [*TITLES.names, "value"])

    rows = conform(entries, TITLES).repartition("block_start_bits").sortWithinPartitions("block_start_bits", "title_start_pos")
    return rows.mapInPandas(run, "block_start_bits bigint, title_start_pos bigint, title string, value string").where("value is not null")


def as_catalog(found: DataFrame) -> DataFrame:
    return conform(found, BLOCKS)
