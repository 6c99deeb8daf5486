"""MinHash near-dedup by HyperMinHash sketches: compressed registers in bands, corrected estimates, links confirmed on full sets.

A set's hashes fall into 256 buckets. Of the least hash of each bucket, a register stores the count of leading zeros and the bits after them (the mantissa,
inverted, so that the register of a union is the larger one; 0 is an empty bucket). Two precisions are kept: 10 bits of mantissa for estimates, 26 for
bands, as band keys must tell all documents apart. Bands are made of registers folded eight to one, so that small sets fill them, two to a band.

Sets that are j alike share no band with a chance of (1 - j**2)**16: 1e-9 at 0.85. Sets that share one meet in its shard, where the equal registers, less
those expected by chance, estimate their likeness. Pairs within six standard deviations of the threshold are candidates, and of these only as many are told
as connect them. Shards of the same members are solved once; large ones are cut into chunks (simhash.shard_links). Candidates that are connected form a
cluster. The full sets of its members meet in the cluster's tasks, and links are confirmed there by their exact intersections: again as many as connect what is
linked, so no link between components is lost. Equal sets are one node from the start.

Defined cases: a null text counts as empty; a text without words has an empty set, which links with nothing, not even another one; texts of fewer words than a
shingle have it whole; a set is made in the memory of one task; ids must be whole numbers (or be castable to such); rows that repeat an id or a text share a
component where their set is not empty; null ids take no part in naming a component and are never kept; an empty table gives no rows, and columns that are not
named are ignored. Shingles are told apart by 64-bit hashes, sets by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexshelf.llm.common import join_cut, small, text_of, written
from lexshelf.llm.simhash import BROADCAST_DROPPED, QUERY, SEED, TREE, Groups, components, remixed, row_key, shard_links

#: Registers, how many of them are folded into one of a band, and registers of a band.
REGISTERS, FOLD, BAND = 256, 8, 2
#: Bits of mantissa in estimates and in bands, and the most leading zeros that are told apart.
MANTISSA, WIDE_MANTISSA, MOST_ZEROS = 10, 26, 62
#: Standard deviations by which an estimate may fall short of the threshold.
SIGMAS = 6
#: Shingles that count as one row when a cluster is cut into chunks.
SET_SHARE = 1024
POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Hashes of the distinct runs of width words, ascending; letters A-Z in lower case."""
    words = np.array([xxhash.xxh64_intdigest(w, SEED) for w in text.lower().split()], np.uint64)
    n = max(len(words) - width + 1, 1) if len(words) else 0
    h = np.zeros(n, np.uint64)
    for i in range(min(width, len(words))):
        h = remixed(h + words[i : i + n], 0)
    h.sort()
    return h[np.r_[True, h[1:] != h[:-1]]] if n else h


def compressed(least: np.ndarray, bits: int) -> np.ndarray:
    """Registers of hashes: leading zeros and one, then the inverted mantissa."""
    v = np.maximum(least, np.uint64(1))
    zeros = (64 - np.searchsorted(POWERS, v, "right")).astype(np.uint64)
    mantissa = (v << zeros << np.uint64(1)) >> np.uint64(64 - bits)
    return (np.minimum(zeros, np.uint64(MOST_ZEROS)) + np.uint64(1)) << np.uint64(bits) | (np.uint64((1 << bits) - 1) - mantissa)


def registers(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The sketch of a set; 0 in empty buckets. The sketch of a union is the larger register of each bucket."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    bucket = (remixed(hashes, 1) >> np.uint64(56)).astype(np.int64)
    np.minimum.at(least, bucket, remixed(hashes, 2))
    return np.where(np.bincount(bucket, minlength=REGISTERS) > 0, compressed(least, bits), np.uint64(0))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band that is not empty."""
    folded = registers(hashes, WIDE_MANTISSA).reshape(-1, FOLD).max(1).reshape(-1, BAND)
    keys = np.arange(len(folded), dtype=np.uint64)
    for i in range(BAND):
        keys = remixed(keys + folded[:, i], 3)
    return keys[folded.any(1)].view(np.int64)


def expected_collisions() -> np.ndarray:
    """Registers that two unrelated sets share by chance, by the sizes of both in quarters of a power of two."""
    load = 2.0 ** (np.arange(160) / 4) / REGISTERS
    edges = np.exp(-load[:, None] * 2.0 ** -np.arange(MOST_ZEROS + 2))
    same = edges[:, 1:] - edges[:, :-1]  # the chance of each count of leading zeros
    return REGISTERS * (same @ same.T) / (1 << MANTISSA)


COLLISIONS = expected_collisions()


def estimates(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated likeness of pairs of sketches, and the registers that it rests on."""
    filled = ((a | b) != 0).sum(1)
    equal = ((a == b) & (a != 0)).sum(1)
    place = lambda sizes: np.minimum(4 * np.log2(np.maximum(sizes, 1)), len(COLLISIONS) - 1).astype(np.int64)
    return (equal - COLLISIONS[place(sizes_a), place(sizes_b)]) / np.maximum(filled, 1), filled


def whole_groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted rows in frames that hold their groups (key, a, b) whole, with the first row of each."""
    rest = None
    for pdf in batches:
        rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        ids = rest[["key", "a", "b"]].to_numpy()
        starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)])
        if len(starts) > 1:  # the last group may go on in the next batch
            yield rest.iloc[: starts[-1]], starts[:-1]
        rest = rest.iloc[starts[-1] :].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest, np.zeros(1, np.int64)


def may_meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether one row is planted and the other one walks, by their sides."""
    return ((a | b) != TREE) & ~((a == QUERY) & (b == QUERY))


def met(solve: Callable[[pd.DataFrame, np.ndarray, Groups], None]) -> Callable[[DataFrame, int, int, object], DataFrame]:
    """What shard_links calls for rows that meet by key, a and b: solve joins the groups of a frame's rows; links connect what it joined."""

    def linked(rows: DataFrame, n: int, *_) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf, starts in whole_groups(batches):
                _, first, which = np.unique(pdf["component"].to_numpy(), return_index=True, return_inverse=True)
                groups = Groups(len(pdf))
                groups.of = first[which]
                solve(pdf, starts, groups)
                moved, nodes = first[groups.of[first] != first], pdf["node"].to_numpy()
                x, y = nodes[moved], nodes[groups.of[moved]]
                yield pd.DataFrame({"src": np.maximum(x, y), "dst": np.minimum(x, y)})

        return rows.repartition(n, "key", "a", "b").sortWithinPartitions("key", "a", "b", "node").mapInPandas(run, "src long, dst long").where("src <> dst")

    return linked


def by_sketches(percent: int) -> Callable[[pd.DataFrame, np.ndarray, Groups], None]:
    """Joins rows whose estimate may reach the threshold: row and row + 1 of all groups at once, then row + 2, and so on."""
    j = percent / 100

    def solve(pdf: pd.DataFrame, starts: np.ndarray, groups: Groups) -> None:
        sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint16).reshape(len(pdf), REGISTERS)
        sizes, side = pdf["size"].to_numpy(), pdf["side"].to_numpy()
        stop = np.repeat(np.r_[starts[1:], len(pdf)], np.diff(np.r_[starts, len(pdf)]))
        here = np.arange(len(pdf))
        for step in range(1, int((stop - here).max())):
            here = here[here + step < stop[here]]
            there = here + step
            ok = (groups.of[here] != groups.of[there]) & may_meet(side[here], side[there])
            ok &= 100 * np.minimum(sizes[here], sizes[there]) >= percent * np.maximum(sizes[here], sizes[there])
            x, y = here[ok], there[ok]
            if len(x):
                about, filled = estimates(sketch[x], sketch[y], sizes[x], sizes[y])
                near = about >= j - SIGMAS * np.sqrt(j * (1 - j) / np.maximum(filled, 1))
                groups.join(x[near], y[near])

    return solve


def by_sets(percent: int) -> Callable[[pd.DataFrame, np.ndarray, Groups], None]:
    """Joins rows whose sets are exactly as much alike as is asked: 100 * intersection >= percent * union."""

    def solve(pdf: pd.DataFrame, starts: np.ndarray, groups: Groups) -> None:
        sizes, side = pdf["size"].to_numpy(), pdf["side"].to_numpy()
        for s, e in zip(starts, np.r_[starts[1:], len(pdf)], strict=True):
            rows = np.arange(s, e)
            sets = [np.frombuffer(h, np.uint64) for h in pdf["hashes"].iloc[s:e]]
            index = None
            for i in rows[:-1]:
                later = rows[i - s + 1 :]
                ok = (groups.of[later] != groups.of[i]) & may_meet(side[later], side[i])
                ok &= 100 * np.minimum(sizes[later], sizes[i]) >= percent * np.maximum(sizes[later], sizes[i])
                later = later[ok]
                if not len(later):
                    continue
                if len(later) < 8:
                    common = np.array([len(np.intersect1d(sets[i - s], sets[x - s], assume_unique=True)) for x in later])
                else:  # where each hash stands in the group, once; then one look for all of the row's hashes
                    if index is None:
                        every = np.concatenate(sets)
                        order = np.argsort(every, kind="stable")
                        index = every[order], np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order]
                    low, high = np.searchsorted(index[0], sets[i - s]), np.searchsorted(index[0], sets[i - s], "right")
                    at = np.arange((high - low).sum()) + np.repeat(low - np.cumsum(high - low) + (high - low), high - low)
                    common = np.bincount(index[1][at], minlength=len(sets))[later - s]
                linked = 100 * common >= percent * (sizes[later] + sizes[i] - common)
                groups.join(np.full(linked.sum(), i), later[linked])

    return solve


def features(docs: DataFrame, id: str, text: str, width: int) -> DataFrame:
    """row, id, row_key, size, name (128 bits, of the whole set), bands and sketch of each document."""

    def one(text: bytes) -> tuple[int, bytes, np.ndarray, bytes]:
        h = shingle_set(text, width)
        if not len(h):
            return 0, b"", h.view(np.int64), b""
        return len(h), hashlib.md5(h.tobytes()).digest(), band_keys(h), registers(h, MANTISSA).astype(np.uint16).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [one(t.as_py()) for t in b.column(3).cast(pa.binary())]
            size, name, bands, sketch = zip(*made, strict=True) if made else [[]] * 4
            columns = [pa.array(size, pa.int64()), pa.array(name, pa.binary()), pa.array(list(bands), pa.list_(pa.int64())), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *columns], names=["row", "id", "row_key", "size", "name", "bands", "sketch"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("id"), row_key(id, text).alias("row_key"), text_of(text).alias("text"))
    return rows.mapInArrow(run, "row bigint, id bigint, row_key binary, size bigint, name binary, bands array<bigint>, sketch binary")


def candidates(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """src, dst: links that connect all that may be linked. nodes: node, bands."""
    spread = nodes.select("node", F.explode("bands").alias("key"))
    members = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    shards = spread.groupBy("key").agg(*members).where("n > 1")
    shards = written(shards.groupBy("n", "x", "y").agg(F.min("key").alias("key")), "hyper-shards")  # of those with the same members one
    spread = join_cut(spread, shards.select("key"), shards, ["key"], ["node"])
    return shard_links(spread.join(rows.select(F.col("row").alias("node"), "size", "sketch"), "node"), 0, link=met(by_sketches(percent)))


def full_sets(docs: DataFrame, members: DataFrame, n_members: int, repeated: bool, id: str, text: str, width: int) -> DataFrame:
    """node, key, size, hashes of members (row_key, node, key). Texts stay where they are up to BROADCAST_DROPPED members, and move once beyond that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), width) for t in b.column(2).cast(pa.binary())]
            columns = [pa.array([len(h) for h in sets], pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *columns], names=["node", "key", "size", "hashes"])

    own = docs.select(row_key(id, text).alias("row_key"), text_of(text).alias("text"))
    found = own.join(small(members, n_members, BROADCAST_DROPPED), "row_key").select("node", "key", "text")
    found = found.dropDuplicates(["node"]) if repeated else found
    return found.mapInArrow(run, "node bigint, key bigint, size bigint, hashes binary")


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 85) -> DataFrame:
    """id, n_shingles, component_id (smallest reachable id), kept (whether that is the row's own): a row for each document.

    Sets are linked if they are at least percent per cent alike (Jaccard); for less than 80 per cent the bands would need fewer registers.
    """
    if not 80 <= percent <= 100:
        raise ValueError("a similarity of 80 to 100 per cent")
    rows = written(features(docs, id, text, width), "hyper-features")
    filled = rows.where("size > 0")
    names = written(filled.groupBy("name").agg(F.min("row").alias("node"), F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "hyper-names")
    nodes = filled.select(F.col("row").alias("node"), "bands").join(names.select("node"), "node", "left_semi")
    near = written(components(candidates(rows, nodes, percent)), "hyper-clusters")
    members = near.select("node", F.col("component").alias("key")).unionByName(near.select(F.col("component").alias("node"), F.col("component").alias("key")).distinct())
    members = written(rows.select("row_key", F.col("row").alias("node")).join(members, "node"), "hyper-members")
    repeated = bool(rows.groupBy("row_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count())
    sets = full_sets(docs, members, members.count(), repeated, id, text, width)
    links = shard_links(sets, 0, link=met(by_sets(percent)), weigh=F.ceil((F.col("size") + 1) / SET_SHARE))
    found = names.join(components(links), "node", "left").select("name", "least", F.coalesce("component", "node").alias("component"))
    found = written(found, "hyper-components")
    least = found.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    least = written(least, "hyper-least")
    named = join_cut(found, least.drop("n"), least, ["component"], ["name"]).select("name", "component_id")
    placed = join_cut(filled.select("row", "id", "size", "name"), named, names, ["name"], ["row"])
    every = placed.select("id", "size", "component_id").unionByName(rows.where("size = 0").select("id", "size", F.col("id").alias("component_id")))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return every.select(F.col("id").alias(id), F.col("size").alias("n_shingles"), "component_id", kept.alias("kept"))
