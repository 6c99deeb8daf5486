"""Suffix-array dedup: finds all strings of a given length that occur more than once, by bucket-pointer refinement.

A position's bucket holds all positions with the same q-gram. A bucket is refined by sorting its positions by the bucket identifiers of
later offsets; positions take the identifiers of their new buckets, which are the sort keys of the next round, and leave as soon as they are alone.

1. Initial buckets. Every window of ``length`` bytes belongs to the bucket of its least q-gram, so equal windows meet in one bucket; neighbouring
   windows with the same least q-gram are a block. Buckets that hold one block are left at once: their windows are unique.
2. What remains is refined by the identifiers of whole blocks. Blocks that share one are repeated from end to end.
3. Blocks that stay single in a shared bucket (the edges of passages) go on byte by byte, against one representative of each distinct block of
   their bucket. The bytes of such blocks travel to their bucket. There, 8-grams are the first identifiers, and each round sorts the positions that are
   left by their own identifier and the one 8, 16, 32, ... bytes on, as the rounds before have written it, up to length. These comparisons are
   exact.
4. Buckets of more than BUCKET_BYTES are split before that, in shuffled rounds. Equal windows hold their least q-gram at the same offset, so offsets are
   halved from round to round: the windows of a cell of w offsets share length - w + 1 bytes around the q-gram. A cell's new identifier is made of the one it had and
   of the w bytes at the later offset that the cell adds, and the next round takes it up. Cells with equal bytes are repeated from end to end, one of each kind stays to be compared with,
   identifiers that are left to one kind leave, and buckets that have become small enough go to 3. Cells are compared by their bytes, so this is exact too, and
   when w is 1 a cell is a window and nothing is left.

Identifiers that move between tasks are hashes (of 54 bits for a q-gram, and 64 more for a block or a window), as only equality matters. Buckets of any size
are counted, never gathered, and the rows of hot ones are dealt over several tasks. Whole texts move once, those with edges once more, compressed.

Defined cases: a null text is empty; texts shorter than length keep all bytes; a long text is handled in pieces of PIECE bytes, except that its
bytes are cut in one task; repeated rows (same id and text) lose what they share, like any other copies, and their blocks are gathered once; a null id is
kept as it is; an empty table gives no rows; columns that are not named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexshelf.llm.common import join_cut, small, tasks_for, text_of, written

LENGTH = 200
#: Bytes of text that are handled at once; a long text is cut into pieces that overlap by length - 1.
PIECE = 1 << 19
K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
BYTE_NAMES = np.random.default_rng(20240229).integers(0, 1 << 64, 256, np.uint64)
REPEATED, SINGLE, SAMPLE = 1, 2, 3
#: Bytes of edge blocks of one bucket that a task refines at once (with about 80 bytes of work space for each); larger buckets are split first.
BUCKET_BYTES = 2 << 20
#: Bytes of edge blocks that are dealt to one task.
TASK_BYTES = 32 << 20
#: Names of larger buckets (8 bytes each) up to which they are broadcast.
BROADCAST_BUCKETS = 1_000_000
#: Low bits of a q-gram's name that give way to its place, to tell which q-gram of a window is the least.
PLACE = np.uint64(1023)


def refined(at: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Names of strings, from the names at their start and at a later offset."""
    x = at * K1
    x ^= x >> np.uint64(29)
    x += later
    x *= K2
    x ^= x >> np.uint64(32)
    return x


def names(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window: its least q-gram name with place, whether several q-grams tie for it, and the window's own name.

    q is a power of two, a quarter to a half of length; the least name is sought from both ends, so a tie shows as two places.
    """
    grams, windows, width = gram_names(data, length)
    place = np.arange(len(grams), dtype=np.uint64) & PLACE
    left, right = least(grams | place, width), least(grams | (PLACE - place), width)
    return left, (left & PLACE) != PLACE - (right & PLACE), windows


def gram_names(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Names of all q-grams, with PLACE bits of zero, and of all windows; and how many q-grams a window has."""
    now, h, grams, q = BYTE_NAMES[np.frombuffer(data, np.uint8)], 1, None, 1
    while 2 * h <= length:
        grams, q = now, h
        now, h = refined(now[:-h], now[h:]), 2 * h
    windows = refined(now[: len(data) - length + 1], now[length - h :])
    return (now if grams is None else grams) & ~PLACE, windows, length - q + 1


def least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width neighbours."""
    span = 1
    while 2 * span <= width:
        x, span = np.minimum(x[:-span], x[span:]), 2 * span
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def anchors(data: bytes, length: int) -> np.ndarray:
    """For each window the place of its least q-gram, of several the leftmost: equal windows have it at the same offset."""
    grams, _, width = gram_names(data, length)
    rank = np.unique(grams, return_inverse=True)[1].astype(np.uint64)
    places = least(rank << np.uint64(32) | np.arange(len(grams), dtype=np.uint64), width)
    return (places & np.uint64(0xFFFFFFFF)).astype(np.int64)


def grouped(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(text numbers, starts in the texts, pieces), together about PIECE bytes."""
    of, starts, parts, n = [], [], [], 0
    for i, t in enumerate(texts):
        for s in range(0, len(t) - length + 1, PIECE):
            of.append(i), starts.append(s), parts.append(t[s : s + PIECE + length - 1])
            n += len(parts[-1])
            if n >= PIECE:
                yield np.array(of), np.array(starts), parts
                of, starts, parts, n = [], [], [], 0
    if parts:
        yield np.array(of), np.array(starts), parts


def located(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows that lie inside a part: place in the joined parts, part, place in the part."""
    sizes = np.array([len(p) for p in parts])
    offsets = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - length + 1, 0)
    part = np.repeat(np.arange(len(parts)), counts)
    inside = np.arange(len(part)) - np.repeat(np.cumsum(counts) - counts, counts)
    return offsets[part] + inside, part, inside


def blocks(parts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """part, start, windows, bucket, block (its name) and weight (2 if a window may recur inside the block).

    Windows with the same least q-gram are one block, and so are neighbours in which several q-grams tie for the same least name.
    """
    left, tie, windows = names(b"".join(parts), length)
    at, part, inside = located(parts, length)
    left, tie = left[at], tie[at]
    bucket = (left & ~PLACE) | tie
    apart = (bucket[1:] != bucket[:-1]) | (~tie[1:] & (left[1:] != left[:-1])) | (part[1:] != part[:-1])
    first = np.flatnonzero(np.r_[True, apart])
    count = np.diff(np.r_[first, len(at)])
    place = np.arange(len(at)) - np.repeat(first, count)
    block = np.add.reduceat(refined(windows[at], place.astype(np.uint64) * K3), first)
    return part[first], inside[first], count, bucket[first].view(np.int64), block.view(np.int64), 1 + tie[first]


def made(schema: str, *columns) -> pa.RecordBatch:
    """A batch with the schema's names and types, from arrays or lists."""
    kinds = {"bigint": np.int64, "int": np.int32}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(kinds[k])) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


BLOCK_ROWS = "bucket bigint, block bigint, key bigint, size int, start int, count int, weight int"
CELL_ROWS = "bucket bigint, key bigint, size int, copies int, anchor int, starts array<int>, bytes binary"
HITS = "key bigint, size int, start int, count int"


def whole_blocks(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, size = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for of, starts, parts in grouped(b.column(2).to_pylist(), length):
                part, inside, count, bucket, block, weight = blocks(parts, length)
                of, start = of[part], starts[part] + inside
                yield made(BLOCK_ROWS, bucket, block, key[of], size[of], start, count, weight)

    return run


def pieces_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices with about PIECE bytes."""
    upto = np.cumsum(batch.column("bytes").to_pandas().str.len().to_numpy(np.int64)) // PIECE if batch.num_rows else np.zeros(0)
    cuts = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def cells(length: int):
    """Edge blocks, cut where the place of the windows' leftmost least q-gram changes; anchor is that place in bytes, and the offset of the q-gram in the first window.

    What comes again inside a block is one row with several starts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in pieces_of(b):
                parts = piece.column("bytes").to_pylist()
                data = b"".join(parts)
                at, part, inside = located(parts, length)
                anchor = anchors(data, length)[at]
                first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])])
                found: dict[tuple[int, int, bytes], list[int]] = {}
                for i, n in zip(first.tolist(), np.diff(np.r_[first, len(at)]).tolist(), strict=True):
                    s = int(at[i])
                    found.setdefault((int(part[i]), int(anchor[i]) - s, data[s : s + n + length - 1]), []).append(int(inside[i]))
                of = np.array([p for p, _, _ in found])
                bucket, key, size, start, copies = (piece.column(n).to_numpy(zero_copy_only=False)[of] for n in ("bucket", "key", "size", "start", "copies"))
                starts = [[int(base) + i for i in at] for base, at in zip(start, found.values(), strict=True)]
                columns = [pa.array(bucket), pa.array(key), pa.array(size), pa.array(copies), pa.array([a for _, a, _ in found], pa.int32()), pa.array(starts, pa.list_(pa.int32())), pa.array([x for *_, x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in CELL_ROWS.split(", ")])

    return run


def halved(rows: DataFrame, width: int, length: int, begin: bool) -> DataFrame:
    """rows (CELL_ROWS) cut into cells of width offsets, each in the bucket of its old identifier and of the bytes that it adds; to begin with, of all bytes that its windows share."""
    n = F.octet_length("bytes") - (length - 1)
    rows = rows.withColumn("least", F.col("anchor") - n + 1)
    rows = rows.withColumn("cell", F.explode(F.sequence(F.floor(F.col("least") / width).cast("int"), F.floor(F.col("anchor") / width).cast("int"))))
    last = F.least(F.col("anchor"), F.col("cell") * width + (width - 1))
    count = last - F.greatest("least", F.col("cell") * width) + 1
    rows = rows.withColumns({"shift": F.col("anchor") - last, "last": last, "bytes": F.substr("bytes", F.col("anchor") - last + 1, count + (length - 1))})
    at, shared = F.col("last") - F.col("cell") * width + 1, length - width + 1
    added = F.substr("bytes", at, F.lit(shared)) if begin else F.substr("bytes", F.when(F.col("cell") % 2 == 0, at + (shared - width)).otherwise(at), F.lit(width))
    return rows.select(
        F.xxhash64("bucket", "cell", added).alias("bucket"), "key", "size", "copies", F.col("last").alias("anchor"), F.transform("starts", lambda x: x + F.col("shift")).alias("starts"), "bytes",
    )


def split(rows: DataFrame, length: int) -> tuple[DataFrame | None, DataFrame]:
    """Of edge blocks in large buckets: rows like them in small ones, and the repeated windows (HITS) that were found on the way."""
    rows = rows.mapInArrow(cells(length), CELL_ROWS)
    width, begin, small_ones, hits = 1, True, [], []
    while 4 * width <= length:
        width *= 2
    while width:
        made = written(halved(rows, width, length, begin), "suffix-cells")
        begin = False
        mark = F.xxhash64("key", "size", "starts")
        kinds = made.groupBy("bucket", "bytes").agg(F.sum(F.size("starts") * F.col("copies")).alias("times"), F.count(F.lit(1)).alias("n"), F.min(mark).alias("sample"))
        kinds = written(kinds, "suffix-kinds")
        told = written(join_cut(made, kinds.drop("n"), kinds, ["bucket", "bytes"], ["key", "starts"]), "suffix-told")
        again = told.where("times > 1 and copies = 1").select("key", "size", F.explode("starts").alias("start"), (F.octet_length("bytes") - (length - 1)).alias("count"))
        hits.append(again)
        if width == 1:
            break
        of_bucket = kinds.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("bytes")).alias("total"), F.min("times").alias("fewest"))
        of_bucket = written(of_bucket.where("n > 1 and fewest = 1").drop("fewest"), "suffix-open")
        one = told.where((F.col("times") == 1) | (mark == F.col("sample"))).withColumn("copies", F.when(F.col("times") == 1, F.lit(1)).otherwise(2))
        one = written(join_cut(one, of_bucket.drop("n"), of_bucket, ["bucket"], ["key", "starts"]).drop("times", "sample"), "suffix-kept")
        small_ones.append(one.where(F.col("total") <= BUCKET_BYTES).select("key", "size", "bucket", F.col("starts")[0].alias("start"), "copies", "bytes"))
        rows = one.where(F.col("total") > BUCKET_BYTES).drop("total")
        if rows.isEmpty():
            break
        width //= 2
    return reduce(DataFrame.unionByName, small_ones) if small_ones else None, reduce(DataFrame.unionByName, hits)


def repeated(parts: list[bytes], copies: np.ndarray, length: int) -> np.ndarray:
    """Places in the joined parts where a string of length begins that begins elsewhere in some part too; a part counts as often as copies says.

    Only places in parts of one copy are told. pointer holds each place's bucket: equal numbers are equal strings of at least h bytes.
    """
    sizes = np.array([len(p) for p in parts])
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(sizes.sum())  # bytes up to the end of the own part
    data = np.frombuffer(b"".join(parts), np.uint8)
    h = 1
    while 2 * h <= min(length, 8):
        h *= 2
    word, padded = np.zeros(len(data), np.uint64), np.r_[data, np.zeros(h, np.uint8)]
    for i in range(h):
        word = word << np.uint64(8) | padded[i : i + len(data)]
    at = np.flatnonzero(left >= h)
    pointer, weight = np.full(len(data), -1), np.repeat(copies, sizes)
    pointer[at], at = refine(word[at], at, 0)
    while len(at):
        later = h if 2 * h <= length else length - h
        at = at[left[at] >= h + later]
        if not later:
            break
        most = int(pointer.max()) + 1
        pointer_of, rest = refine(pointer[at] * most + pointer[at + later], at, most)
        pointer[at], at, h = pointer_of, rest, h + later
    _, bucket = np.unique(pointer[at], return_inverse=True)
    return at[(np.bincount(bucket, weight[at])[bucket] > 1) & (weight[at] == 1)] if len(at) else at


def refine(keys: np.ndarray, at: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """New bucket numbers from first on, in the order of the sorted keys, and those of the places at that are not alone in theirs."""
    _, bucket, count = np.unique(keys, return_inverse=True, return_counts=True)
    return first + bucket, at[count[bucket] > 1]


def bucket_hits(length: int):
    """Repeated windows of single blocks, as runs; rows come sorted by bucket, and whole buckets are refined together."""

    def solve(rows: pa.RecordBatch) -> pa.RecordBatch:
        parts = rows.column("bytes").to_pylist()
        key, size, start, copies = (rows.column(n).to_numpy(zero_copy_only=False) for n in ("key", "size", "start", "copies"))
        sizes = np.array([len(p) for p in parts])
        at = repeated(parts, copies, length)
        part = np.searchsorted(np.cumsum(sizes), at, "right")
        start = start[part] + at - (np.cumsum(sizes) - sizes)[part]
        first = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (at[1:] != at[:-1] + 1)])[: len(at)]
        return made(HITS, key[part][first], size[part][first], start[first], np.diff(np.r_[first, len(at)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for piece in pieces_of(b):
                bucket = piece.column("bucket").to_numpy()
                last = int(np.searchsorted(bucket, bucket[-1]))  # here the piece's last bucket begins, which may go on
                starts_new = not held or held[-1].column("bucket")[-1].as_py() != bucket[0]
                if n >= PIECE and (last or starts_new):
                    cut = 0 if starts_new else last
                    yield solve(joined([*held, piece.slice(0, cut)]))
                    held, n, piece = [], 0, piece.slice(cut)
                held.append(piece)
                n += piece.nbytes
        if held:
            yield solve(joined(held))

    def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return run


def covered(n: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A mask of n bytes with the ranges set."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, stops, -1)
    return np.cumsum(edge[:-1]) > 0


def judged(text: bytes, gone: np.ndarray) -> tuple[int, int, str, list[int], list[int]]:
    """Bytes removed, runs removed, hash of the rest, starts and stops of the runs."""
    edge = np.flatnonzero(np.diff(np.r_[0, gone.view(np.int8), 0]))
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return int(gone.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest(), edge[::2].tolist(), edge[1::2].tolist()


RESULT = "n_removed bigint, n_spans bigint, kept_sha256 string, starts array<int>, stops array<int>"


def first_pass(length: int):
    """Removes repeated blocks. Texts, and the bytes of edge blocks, go on only where windows are still to be told apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for packed, *found in zip(*(b.column(n).to_pylist() for n in ("packed", "at", "count", "status", "bucket")), strict=True):
                text = unpack.decompress(packed)
                s, c, k, bucket = (np.array(x or [], np.int64) for x in found)
                whole = k != SINGLE
                gone = covered(len(text), s[whole], s[whole] + c[whole] + length - 1)
                edges = zip(*(x[k != REPEATED].tolist() for x in (bucket, s, c, whole)), strict=True)
                edge = [{"bucket": q, "start": i, "copies": 2 if w else 1, "bytes": text[i : i + n + length - 1]} for q, i, n, w in edges]
                rows.append([*judged(text, gone), packed if (~whole).any() else None, edge])
            of_edge = pa.struct([("bucket", pa.int64()), ("start", pa.int32()), ("copies", pa.int32()), ("bytes", pa.binary())])
            kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.list_(pa.int32())] * 2, pa.binary(), pa.list_(of_edge)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in ("id", "key", "size", "times")), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["id", "key", "size", "times", "n_removed", "n_spans", "kept_sha256", "starts", "stops", "packed", "edges"],
            )

    return run


def last_pass(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for packed, *found in zip(*(b.column(n).to_pylist() for n in ("packed", "starts", "stops", "at", "count")), strict=True):
                text = unpack.decompress(packed)
                s, e, at, count = (np.array(x or [], np.int64) for x in found)
                rows.append(judged(text, covered(len(text), np.r_[s, at], np.r_[e, at + count + length - 1])))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.list_(pa.int32())] * 2]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("size"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["id", "size", "n_removed", "n_spans", "kept_sha256", "starts", "stops"],
            )

    return run


def packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(1)
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(map(pack.compress, b.column(4).to_pylist()), pa.binary())], names=["id", "key", "size", "nth", "packed"])


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, starts, stops (byte ranges removed): a row for each document."""
    if not 1 <= length <= 1024:
        raise ValueError("a length of 1 to 1024 bytes is told by ten bits of place")
    raw = text_of(text)
    rows = docs.select(F.col(id).alias("id"), F.xxhash64(id, raw).alias("key"), F.octet_length(raw).cast("int").alias("size"), raw.cast("binary").alias("bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.where(F.col("size") >= length).select("key", "size", "bytes").mapInArrow(whole_blocks(length), BLOCK_ROWS)
    shared = written(found.groupBy("bucket").agg(F.sum("weight").alias("n")).where("n > 1"), "suffix-buckets")
    left = written(join_cut(found, shared.select("bucket"), shared, ["bucket"], ["key", "start"]).drop("weight"), "suffix-shared")
    mark = F.xxhash64("key", "size", "start")
    same = written(left.groupBy("bucket", "block").agg(F.count(F.lit(1)).alias("n"), F.min(mark).alias("sample")), "suffix-blocks")
    single = same.where("n = 1").select("bucket").distinct().withColumn("open", F.lit(True))
    named = join_cut(same.withColumnRenamed("n", "times"), single, shared, ["bucket"], ["block"], "left")
    status = F.when(F.col("times") == 1, SINGLE).when(F.col("open") & (mark == F.col("sample")), SAMPLE).otherwise(REPEATED)
    judged_rows = join_cut(left, named, same, ["bucket", "block"], ["key", "start"])
    judged_rows = judged_rows.select("key", "size", F.struct("start", "count", status.alias("status"), F.when(status != REPEATED, F.col("bucket")).otherwise(0).alias("bucket")).alias("b"))
    # Repeated rows have one key: a set holds their blocks once, and n tells how many rows there are.
    of_doc = judged_rows.groupBy("key", "size").agg(F.collect_set("b").alias("b"), F.count(F.lit(1)).alias("n"))
    of_doc = written(of_doc.select("key", "size", (F.col("n") / F.size("b")).cast("long").alias("n"), *(F.col(f"b.{c}").alias(c if c != "start" else "at") for c in ("start", "count", "status", "bucket"))), "suffix-found")
    packed = rows.withColumn("nth", F.monotonically_increasing_id()).select("id", "key", "size", "nth", "bytes").mapInArrow(packed_rows, f"id {kind}, key bigint, size int, nth bigint, packed binary")
    joined = join_cut(packed, of_doc.withColumnRenamed("n", "times"), of_doc, ["key", "size"], ["nth"], "left").drop("nth")
    edge = "packed binary, edges array<struct<bucket:bigint,start:int,copies:int,bytes:binary>>"
    first = written(joined.mapInArrow(first_pass(length), f"id {kind}, key bigint, size int, times bigint, {RESULT}, {edge}"), "suffix-first")

    edges = first.select("key", "size", "times", F.explode("edges").alias("e")).select("key", "size", "times", "e.*")
    edges = edges.where("times = 1").unionByName(edges.where("times > 1").dropDuplicates(["bucket", "key", "size", "start"])).drop("times")
    of_bucket = written(edges.groupBy("bucket").agg(F.sum(F.octet_length("bytes")).alias("n")), "suffix-edges")
    hot = of_bucket.where(F.col("n") > BUCKET_BYTES).select("bucket")
    n_hot = hot.count()
    tasks = tasks_for(docs, int(of_bucket.agg(F.sum("n")).first()[0] or 0), TASK_BYTES)
    cool = edges if not n_hot else edges.join(small(hot, n_hot, BROADCAST_BUCKETS), "bucket", "left_anti")
    more = None
    if n_hot:
        parted, more = split(edges.join(small(hot, n_hot, BROADCAST_BUCKETS), "bucket", "left_semi"), length)
        cool = cool if parted is None else cool.unionByName(parted)
    hits = cool.repartition(tasks, "bucket").sortWithinPartitions("bucket", "key", "size", "start").mapInArrow(bucket_hits(length), HITS)
    hits = hits if more is None else hits.unionByName(more)
    hit = hits.groupBy("key", "size").agg(F.collect_list(F.struct("start", "count")).alias("b")).select("key", "size", F.col("b.start").alias("at"), F.col("b.count").alias("count"))
    known = first.where("packed is null").select("id", "size", *(x.split()[0] for x in RESULT.split(", ")))
    # Only blocks that stand once keep a text open, and no block of repeated rows does, so here each key has one row.
    rest = first.where("packed is not null").drop("edges").join(hit, ["key", "size"], "left")
    rest = rest.select("id", "size", "packed", "starts", "stops", "at", "count").mapInArrow(last_pass(length), f"id {kind}, size int, {RESULT}")
    return known.unionByName(rest).select(F.col("id").alias(id), F.col("size").cast("long").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256", "starts", "stops")
