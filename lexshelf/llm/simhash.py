"""SimHash near-dedup: fingerprints, sharded BK-trees, connected components.

Fingerprints that differ in at most r bits agree on one of r + 1 blocks of bits (pigeonhole), so each distinct fingerprint goes to
r + 1 shards, keyed by as many bits of a block as leave about TREE_ROWS members to a shard. Each shard is a BK-tree: children are keyed by
the integer Hamming distance to their parent, and members walk it, following only edges within the radius of their own distance. A task emits
links that connect what it found, at most one per row, never all pairs.

Trees meet their queries in the tasks of their shard. They are not broadcast from the driver, as together they hold the fingerprints of all documents.
Instead, a shard that is too large for one task is keyed by all bits of its block, and if it still is, cut into chunks whose trees go to each block
of the shard's queries. Chunks are solved alone first. A large group of near copies is then one component already, as each of its shards is cut
otherwise; only rows outside a shard's largest component meet all of its chunks, in blocks of bounded size, so no link between components is lost
and none is sought inside them.

Links join distinct fingerprints only; documents follow their fingerprint. Components are found by star contraction over written link tables.

Defined cases: a null text counts as empty, a text of no words has fingerprint zero and links like any other, texts of fewer words than a shingle
are one shingle, a text is fingerprinted whole in the memory of one task, ids must be whole numbers (or be castable to such; others raise an error),
repeated rows share a component, null ids take no part in naming a component, an empty table gives no rows, and columns that are not named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexshelf.llm.common import ROW, join_cut, packed, small, tasks_for, text_of, unpacked, written

SEED = 42
#: Members that a shard's tree is meant to hold, and rows of one chunk of a shard; a task compares two chunks at most.
TREE_ROWS, CHUNK = 1024, 4096
#: Rows of shards that are dealt to one task.
TASK_ROWS = 1 << 18
#: Large shards (16 bytes each) up to which their table is broadcast.
BROADCAST_SHARDS = 500_000
#: Rows to drop (about 80 bytes each in memory) up to which they are broadcast.
BROADCAST_DROPPED = 1_000_000
#: What a row does in a task, and queries that walk a tree together.
TREE, QUERY, BOTH, TOGETHER = 0, 1, 2, 1024


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each run of width words, repeats included; letters A-Z in lower case."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.array([xxhash.xxh64_intdigest(s, SEED) for s in runs], np.uint64)


#: The bits of each byte value.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes. The values of each byte are counted first, if that is less work."""
    parts = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    if len(parts) < 512:
        ones = np.unpackbits(parts, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = (np.array([np.bincount(b, minlength=256) for b in parts.T]) @ BYTE_BITS).ravel()
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """id, fp: the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([majority(shingle_hashes(t, width)) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id).cast("long").alias("id"), text_of(text).alias("text")).mapInArrow(run, "id long, fp long")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances; the last axis holds the 64-bit words of a fingerprint."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class Tree:
    """A BK-tree over distinct fingerprints, level by level: a node's children are neighbours in the arrays, in order of their edge."""

    #: Above any distance.
    WIDE = 1 << 16

    def __init__(self, fps: np.ndarray) -> None:
        rest, group = np.arange(len(fps)), np.zeros(len(fps), np.int64)
        keys, members, n = [np.zeros(1, np.int64)], [], 0
        while len(rest):
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            members.append(rest[first])
            below = np.ones(len(rest), bool)
            below[first] = False
            d = distances(fps[rest[below]], fps[rest[first][group[below]]])
            key = (n + group[below]) * self.WIDE + d  # the parent and the edge that leads from it
            order = np.argsort(key, kind="stable")
            rest, key, n = rest[below][order], key[order], n + len(first)
            start = np.r_[True, key[1:] != key[:-1]][: len(key)]
            group = np.cumsum(start) - 1
            keys.append(key[start])
        #: The fingerprint at each node, and each node's parent and edge in one number, ascending.
        self.fps, self.member, self.key = fps, np.concatenate(members), np.concatenate(keys)[1:]

    def walk(self, queries: np.ndarray, radius: int, found: Callable[[np.ndarray, np.ndarray], None]) -> int:
        """Calls found(queries, members), as places, with all pairs within the radius, and returns how many fingerprints were compared."""
        compared = 0
        for i in range(0, len(queries), TOGETHER):
            q = np.arange(i, min(i + TOGETHER, len(queries)))
            node = np.zeros(len(q), np.int64)
            while len(q):
                d = distances(queries[q], self.fps[self.member[node]])
                compared += len(q)
                near = d <= radius
                found(q[near], self.member[node[near]])
                low = np.searchsorted(self.key, node * self.WIDE + np.maximum(d - radius, 0))
                count = np.searchsorted(self.key, node * self.WIDE + d + radius, "right") - low
                at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                q, node = np.repeat(q, count), np.repeat(low, count) + at + 1  # the root has no key
        return compared


class Groups:
    """Union of index pairs, whole arrays at a time."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.of[a], self.of[b]
            apart = x != y
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            low, high = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
            np.minimum.at(self.of, high, low)
            while (up := self.of[self.of] < self.of).any():
                self.of[up] = self.of[self.of][up]


def shard_links(rows: DataFrame, radius: int, accept: Callable[[pd.DataFrame, np.ndarray, np.ndarray], np.ndarray] | None = None, link=None, weigh: Column | None = None) -> DataFrame:
    """src, dst (src > dst): links that connect all that lies within the radius in some shard.

    rows: node, key (the shard), fp (ARRAY<LONG>) and what accept(frame, i, j) needs to confirm pairs. link takes the place of linked, for rows
    that are compared in another way; weigh tells for how many rows of a chunk a row counts.
    """
    link, size = link or linked, F.count(F.lit(1)) if weigh is None else F.sum(weigh)
    rows = written(rows, "shard-rows")
    n = tasks_for(rows, rows.count(), TASK_ROWS)
    large = written(rows.groupBy("key").agg(size.alias("n")).where(F.col("n") > CHUNK).select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("cuts")), "shard-large")
    n_large = large.count()
    cut = rows.join(small(large, n_large, BROADCAST_SHARDS), "key", "left")
    chunk = F.when(F.col("cuts").isNotNull(), F.pmod(F.xxhash64("node", "key"), "cuts")).otherwise(0).cast("int")
    alone = cut.withColumns({"a": chunk, "b": F.lit(0), "side": F.lit(BOTH), "component": F.col("node")}).drop("cuts")
    first = link(alone, n, radius, accept)
    if not n_large:
        return first
    first = written(first, "shard-links")
    big = cut.where("cuts is not null").withColumn("a", chunk).join(components(first).withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    big = written(big.withColumn("component", F.coalesce("component", "node")).drop("of"), "shard-big")
    sizes = big.groupBy("key", "component").agg(size.alias("n"))
    most = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n")).where(F.col("top.n") < F.col("n"))
    most = most.select("key", F.col("top.component").alias("main"), F.ceil((F.col("n") - F.col("top.n")) / CHUNK).cast("int").alias("others"))
    big = big.join(small(most, n_large, BROADCAST_SHARDS), "key")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    trees = big.withColumn("b", every("others")).withColumn("side", F.lit(TREE))
    outside = big.where(F.col("component") != F.col("main")).withColumn("b", F.pmod(F.xxhash64("node", F.lit(1)), "others").cast("int"))
    outside = outside.drop("a").withColumn("a", every("cuts")).withColumn("side", F.lit(QUERY))
    return first.unionByName(link(trees.unionByName(outside).drop("cuts", "main", "others"), n, radius, accept))


def linked(rows: DataFrame, n: int, radius: int, accept: Callable[[pd.DataFrame, np.ndarray, np.ndarray], np.ndarray] | None) -> DataFrame:
    """src, dst (src > dst) for rows that meet by key, a and b: those of side TREE or BOTH are planted, those of side QUERY or BOTH walk.

    Rows of one component count as connected, and one of them stands for it in the links.
    """
    rows = rows.repartition(n, "key", "a", "b").sortWithinPartitions("key", "a", "b", "node")

    def solve(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        fps = np.array(pdf["fp"].tolist(), np.int64).view(np.uint64)
        side, every = pdf["side"].to_numpy(), np.arange(len(pdf))
        _, first, which = np.unique(pdf["component"].to_numpy(), return_index=True, return_inverse=True)
        groups = Groups(len(pdf))
        groups.of = first[which]
        tree, queries = every[side != QUERY], every[side != TREE]
        distinct, place = np.unique(fps[tree], axis=0, return_inverse=True)
        order = np.argsort(place, kind="stable")  # rows of one fingerprint are neighbours
        start, count = np.searchsorted(place[order], np.arange(len(distinct))), np.bincount(place, minlength=len(distinct))

        def confirmed(q: np.ndarray, m: np.ndarray) -> None:
            if accept is not None and len(q):
                apart = groups.of[q] != groups.of[m]
                q, m = q[apart], m[apart]
                ok = accept(pdf, q, m)
                q, m = q[ok], m[ok]
            groups.join(q, m)

        def found(q: np.ndarray, at: np.ndarray) -> None:
            q = queries[q]
            for i in range(count[at].max(initial=0)):  # the first row of each fingerprint, then its second, and so on
                q, at = q[count[at] > i], at[count[at] > i]
                confirmed(q, tree[order[start[at] + i]])

        if len(tree) and len(queries):
            Tree(distinct).walk(fps[queries], radius, found)
        moved = first[groups.of[first] != first]
        nodes = pdf["node"].to_numpy()
        return nodes[moved], nodes[groups.of[moved]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            ids = rest[["key", "a", "b"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)])
            if len(starts) > 1:  # the last group may go on in the next batch
                yield from flush(rest.iloc[: starts[-1]], starts[:-1])
            rest = rest.iloc[starts[-1] :].reset_index(drop=True)
        if rest is not None and len(rest):
            yield from flush(rest, np.zeros(1, np.int64))

    def flush(pdf: pd.DataFrame, starts: np.ndarray) -> Iterator[pd.DataFrame]:
        ends = np.r_[starts[1:], len(pdf)]
        src, dst = [], []
        for s, e in zip(starts, ends, strict=True):
            if e - s > 1:
                x, y = solve(pdf.iloc[s:e].reset_index(drop=True))
                src.append(x), dst.append(y)
        if src:
            x, y = np.concatenate(src), np.concatenate(dst)
            yield pd.DataFrame({"src": np.maximum(x, y), "dst": np.minimum(x, y)})

    return rows.mapInPandas(run, "src long, dst long").where("src <> dst")


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node): a row for each node that reaches a smaller one.

    Alternate large-star and small-star steps: every node's larger neighbours, then its smaller ones, are tied to the
    smallest neighbour. Neighbours are reduced by min(), never collected, and those of a hub are dealt over several tasks. Each round's
    links are written, so lineage stays short and a lost executor costs one round at most.
    """

    def to_least(pairs: DataFrame, least: Column) -> DataFrame:
        """pairs (u, v) with m, the least of u's neighbours."""
        of = written(pairs.groupBy("u").agg(least.alias("m"), F.count(F.lit(1)).alias("n")), "links-least")
        return join_cut(pairs, of.drop("n"), of, ["u"], ["v"])

    links = written(links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = to_least(both, F.least("u", F.min("v"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        tied = to_least(large, F.min("v"))
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(tied.select("u", F.col("m").alias("v")))
        links = written(small.distinct(), "links")
        now = links.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            return links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        before = now


def blocks_of(fp: Column, radius: int, bits: int | None) -> Column:
    """ARRAY<LONG>: for each of radius + 1 blocks its place with its lowest bits (all, if None is said)."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    widths = [b - a for a, b in zip(edges, edges[1:], strict=False)]
    wanted = [w if bits is None else min(w, bits) for w in widths]
    return F.array(*(F.xxhash64(F.lit(i), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << w) - 1 if w < 64 else -1))) for i, (a, w) in enumerate(zip(edges, wanted, strict=False))))


def near_fingerprints(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """src, dst for nodes (node, fp LONG): exact for any radius; the smaller it is, the more the shards and the trees' edges rule out."""
    if not 0 <= radius < 64:
        raise ValueError("a radius of 0 to 63 bits")
    bits = max(0, (nodes.count() // TREE_ROWS).bit_length() - 1)
    if not bits:
        return shard_links(nodes.select("node", F.array("fp").alias("fp"), F.lit(0).cast("bigint").alias("key")), radius)
    keys = F.explode(F.arrays_zip(blocks_of(F.col("fp"), radius, bits).alias("wide"), blocks_of(F.col("fp"), radius, None).alias("whole")))
    rows = nodes.select("node", "fp", keys.alias("k")).select("node", F.array("fp").alias("fp"), F.col("k.wide").alias("wide"), F.col("k.whole").alias("whole"))
    full = written(rows.groupBy("wide").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK).select("wide", F.lit(True).alias("full")), "shard-full")
    rows = rows.join(small(full, full.count(), BROADCAST_SHARDS), "wide", "left")
    return shard_links(rows.select("node", "fp", F.when(F.col("full"), F.col("whole")).otherwise(F.col("wide")).alias("key")), radius)


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id (smallest reachable id): a row for each document."""
    rows = written(fingerprints(docs, id, text, width), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")), "fingerprint-nodes")
    found = components(near_fingerprints(nodes.where("node is not null").select("node", "fp"), radius))
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return join_cut(rows.withColumn("nth", F.monotonically_increasing_id()), named, nodes, ["fp"], ["nth"]).select(F.col("id").alias(id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: near_texts: minima that serve as shard keys, bins (as a power of two) of the signature that confirms pairs, and words of 64 bits in
#: a fingerprint. The signature's estimate of a similarity of 0.8 has a standard deviation of 0.015, and less for short texts.
KEYS, BINS, WORDS = 6, 10, 4
SALTS = np.random.default_rng(9).integers(1, 1 << 64, (KEYS + WORDS + 1, 2), np.uint64) | np.uint64(1)


def remixed(h: np.ndarray, i: int) -> np.ndarray:
    x = h * SALTS[i, 0]
    x ^= x >> np.uint64(31)
    return x * SALTS[i, 1]


def set_features(text: bytes, width: int) -> tuple[int, list[int], bytes, list[int]]:
    """Name, fingerprint, signature and shard keys of a text's set of shingles."""
    words = np.array([xxhash.xxh64_intdigest(w, SEED) for w in text.lower().split()], np.uint64)
    n = max(len(words) - width + 1, 1) if len(words) else 0
    h = np.zeros(n, np.uint64)
    for i in range(min(width, len(words))):
        h = remixed(h + words[i : i + n], 0)
    h.sort()
    h = h[np.r_[True, h[1:] != h[:-1]]] if n else h
    name = xxhash.xxh64_intdigest(h.tobytes(), SEED)
    if not len(h):
        return name - (1 << 63), [0] * WORDS, bytes(3 << BINS >> 3), [0]
    bins = h >> np.uint64(64 - BINS)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])  # hashes are sorted: these are the least of their bins
    told = (remixed(h[first], KEYS + WORDS) >> np.uint64(62)).astype(np.uint8)
    planes = np.zeros((3, 1 << BINS), np.uint8)  # whether a bin holds any hash, and two bits of its least
    planes[:, bins[first].astype(np.int64)] = np.ones_like(told), told & 1, told >> 1
    signature = np.packbits(planes).tobytes()
    fp = np.array([majority(remixed(h, KEYS + i)) for i in range(WORDS)], np.uint64).view(np.int64)
    keys = np.array([remixed(h, i).min() for i in range(KEYS)], np.uint64).view(np.int64)
    return name - (1 << 63), fp.tolist(), signature, keys.tolist()


def near_texts(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, radius: int = 64) -> DataFrame:
    """id, row_key (16 bytes: MD5 of id and text) and component for each row; rows of one group of near copies share a component.

    Texts whose shingle sets are about similarity alike (Jaccard) share one of KEYS minima but for 0.2**6 of them; those
    that share one meet in a shard. There, BK-trees over WORDS x 64-bit fingerprints propose pairs within radius (four standard
    deviations beyond the mean distance at 0.8), and signatures of the least hash in each of 2**BINS bins confirm them. At such a radius edges tell
    groups from each other, but not unrelated texts, which are all about as far from any pivot; the minima keep these apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = zip(*(set_features(t, width) for t in b.column(3).cast(pa.binary()).to_pylist()), strict=True) if b.num_rows else [[]] * 4
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(c, k) for c, k in zip(made, kinds, strict=True))], names=["row", "id", "row_key", "name", "fp", "signature", "keys"])

    def alike(pdf: pd.DataFrame, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bins whose least hash is the same, of those that either text has; a quarter of the others look the same in two bits."""
        every = np.frombuffer(b"".join(pdf["signature"]), np.uint64).reshape(len(pdf), 3, -1)
        count = lambda bits: np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        out = np.zeros(len(i), bool)
        for s in range(0, len(i), 1 << 15):
            a, b = every[i[s : s + (1 << 15)]], every[j[s : s + (1 << 15)]]
            both = a[:, 0] & b[:, 0]
            equal = both & ~(a[:, 1] ^ b[:, 1]) & ~(a[:, 2] ^ b[:, 2])
            out[s : s + (1 << 15)] = (4 * count(equal) - count(both)) / 3 >= similarity * count(a[:, 0] | b[:, 0])
        return out

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("id"), row_key(id, text).alias("row_key"), text_of(text).alias("text"))
    rows = written(rows.mapInArrow(run, "row long, id long, row_key binary, name long, fp array<long>, signature binary, keys array<long>"), "near-features")
    nodes = written(rows.groupBy("name", "fp", "keys").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("n")), "near-nodes")
    spread = nodes.select("node", F.explode("keys").alias("key"))
    shared = written(spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-keys")
    spread = join_cut(spread, shared.select("key"), shared, ["key"], ["node"]).join(rows.select(F.col("row").alias("node"), "fp", "signature"), "node")
    found = components(shard_links(spread, radius, alike))
    named = nodes.join(found, "node", "left").select("name", "fp", F.coalesce("component", "node").alias("component"))
    same = nodes.groupBy("name", "fp").agg(F.sum("n").alias("n"))
    return join_cut(rows, named, same, ["name", "fp"], ["row"]).select("id", "row_key", "component")


def row_key(id: str, text: str) -> Column:
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(id).cast("string"), F.lit("null")), F.lit(":"), text_of(text))))


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near-duplicates: of each group a row with the smallest id stays (of rows that repeat its id and text, any one).

    Texts are read and not moved to find the groups. The rows to drop are an anti-join by 16 bytes each, broadcast up to BROADCAST_DROPPED of them; beyond
    that, texts move once.
    A null text counts as empty, a null id comes last, and an empty table gives no rows.
    """
    found = near_texts(docs, id, text, width, similarity).groupBy("component", "id", "row_key").agg(F.count(F.lit(1)).alias("n"))
    found = written(found, "near-groups")
    groups = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "row_key")).alias("kept"), F.count(F.lit(1)).alias("n"))
    groups = written(groups.select("component", F.col("kept.row_key").alias("kept"), "n").where("n > 1"), "near-kept")
    others = join_cut(found, groups.drop("n"), groups, ["component"], ["row_key"]).where(F.col("row_key") != F.col("kept")).select("row_key")
    repeated = written(found.where("n > 1").select("row_key"), "near-repeated")
    own = packed(docs).withColumn("near_row_key", row_key(f"{ROW}.{id}", f"{ROW}.{text}"))
    others = written(others, "near-dropped")
    n_others, n_repeated = others.count(), repeated.count()

    def drop(keys: DataFrame) -> DataFrame:
        return own.join(small(keys.withColumnRenamed("row_key", "near_row_key"), n_others + n_repeated, BROADCAST_DROPPED), "near_row_key", "left_anti")

    if not n_repeated:
        return unpacked(drop(others))
    again = own.join(repeated.join(others, "row_key", "left_anti").withColumnRenamed("row_key", "near_row_key"), "near_row_key", "left_semi")
    return unpacked(drop(others.unionByName(repeated)).unionByName(again.dropDuplicates(["near_row_key"])))
