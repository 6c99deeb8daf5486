"""Best-fit packing planned on a histogram of lengths.

A length of at most ``capacity`` is all that best fit looks at, so documents are counted by length, sequences are planned over
counts, and documents take the planned slots by joining on their rank within their length. The plan has no more
rows than there are pairs of lengths and gaps, whatever the number of documents.

Defined cases: a null text is empty and packs as its end token alone, a null id is kept as it is, repeated rows are packed each for
itself, an empty table gives no rows, and columns that are not named are ignored. Longer texts are cut into whole pieces, the
first being the shorter one; a text is encoded whole, however long, in the memory of one task.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexshelf.llm.common import text_of, written

CAPACITY, END = 1024, 2
#: Rows of the plan (48 bytes each) up to which it is broadcast: 25 MB, more than any plan for a capacity of 1024 has.
BROADCAST_PLAN = 525_000
#: How this vocabulary splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as Unicode has it, and how much of it in a row is a long run.
SPACES = 1000
LONG_SPACE = re.compile(rf"[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{SPACES},}}")


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


def merges_in_order(model: dict) -> bool:
    """Whether a vocabulary file is plain byte-level BPE, whose ids are the ranks of its merges, with no text changed before."""
    split = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    plain = model["model"]["type"] == "BPE" and not any(model["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or model["normalizer"] or {k: (model["pre_tokenizer"] or {}).get(k) for k in split} != split or model["truncation"]:
        return False
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or not t["special"] or re.search(r"\s", t["content"]) for t in model["added_tokens"]):
        return False
    vocab = model["model"]["vocab"]
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["model"]["merges"]]
    ranks = sorted(vocab[c] for c in byte_alphabet()) + merged
    return ranks == list(range(len(ranks)))


def encoder(vocabulary: str):
    """text -> ids, as tokenizers gives them for that file without added special tokens.

    Plain byte-level BPE is merged by tiktoken, several times faster; any other file goes to tokenizers itself. So do runs
    of SPACES white-space characters and more, over which tiktoken's look-ahead would run out of stack: such a run, but for its last character where
    more text follows, is one word, so the text can be cut around it. Tests compare all of this with tokenizers' own ids.
    """
    import tiktoken
    from tokenizers import Tokenizer

    exact = cache(lambda: Tokenizer.from_file(vocabulary))
    whole = lambda text: exact().encode(text, add_special_tokens=False).ids
    with open(vocabulary, encoding="utf-8") as f:
        model = json.load(f)
    if not merges_in_order(model):
        return whole
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    to_byte = byte_alphabet()
    ranks = {bytes(map(to_byte.__getitem__, t)): i for t, i in model["model"]["vocab"].items() if t not in special}
    encoding = tiktoken.Encoding("lexshelf", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    fast = lambda text: encoding.encode(text, allowed_special="all")

    def encode(text: str) -> list[int]:
        out, at = [], 0
        for run in LONG_SPACE.finditer(text):
            alone = run.end() == len(text) or any(text.startswith(s, run.end()) for s in special)
            out += fast(text[at : run.start()])
            at = run.end() if alone else run.end() - 1
            out += whole(text[run.start() : at])
        return out + fast(text[at:]) if at else fast(text)

    return encode


def pieces(docs: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """id, piece, start, length, ids_crc32, task and nth (of its length in that task)."""
    rows = docs.select(F.col(id).alias("id"), text_of(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(vocabulary), np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()
        for b in batches:
            which, piece, start, length, crc, nth = [], [], [], [], [], []
            for i in range(b.num_rows):
                ids = np.array([*encode(b.column(1)[i].as_py()), end], "<u4")
                first = (len(ids) - 1) % capacity + 1
                for p, s in enumerate([0, *range(first, len(ids), capacity)]):
                    own = ids[s : s + (capacity if p else first)]
                    which.append(i), piece.append(p), start.append(s), length.append(len(own)), crc.append(zlib.crc32(own.tobytes())), nth.append(int(seen[len(own)]))
                    seen[len(own)] += 1
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(which, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([task] * len(which), pa.int32()), pa.array(nth, pa.int64())],
                names=["id", "piece", "start", "length", "ids_crc32", "task", "nth"],
            )

    return rows.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, ranks per sequence, offset), best fit from the longest down.

    Sequences with equal contents are one run of numbers. Each step gives the runs with the smallest gap that fits as many
    ranks as that gap holds, all sequences of the run at once, and splits a run only where the ranks give out.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rows, fresh = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            gap = min((g for g, runs in gaps.items() if runs and g >= length), default=None)
            if gap is None:
                gap, run = capacity, (fresh, -(-left // (capacity // length)))
                fresh += run[1]
            else:
                run = gaps[gap].pop()
            first, n = run
            each = gap // length
            whole = min(n, left // each)
            if whole:
                rows.append((length, rank, whole * each, first, each, capacity - gap))
                gaps[gap - each * length].append((first, whole))
                rank, left, first, n = rank + whole * each, left - whole * each, first + whole, n - whole
            if n and 0 < left < each:
                rows.append((length, rank, left, first, left, capacity - gap))
                gaps[gap - left * length].append((first, 1))
                left, first, n = 0, first + 1, n - 1
            if n:
                gaps[gap].append((first, n))
    return rows


def pack(docs: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece.

    Ranks within a length are the rank in the task that cut the piece, after all pieces of earlier tasks; only counts by task and
    length are added up, so a length that most pieces have is no hot group.
    """
    cut = written(pieces(docs, vocabulary, id, text, capacity, end), "pack-pieces")
    by_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    by_task = by_task.select("length", "task", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    ranked = cut.join(by_task, ["length", "task"]).withColumn("rank", F.col("earlier") + F.col("nth"))
    placed = slotted(ranked, plan(counts, capacity))
    return placed.select(F.col("id").alias(id), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def slotted(ranked: DataFrame, planned: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """ranked (length, rank) with sequence_id and offset.

    The plan, sorted by length and first rank, is searched by halving. It is broadcast up to BROADCAST_PLAN rows; a longer plan, which only larger
    capacities can have, is joined by length and range of ranks.
    """
    spark = ranked.sparkSession
    if len(planned) > BROADCAST_PLAN:
        slots = spark.createDataFrame(planned, "length bigint, first_rank bigint, ranks bigint, first_sequence bigint, each bigint, at bigint")
        nth = F.col("rank") - F.col("first_rank")
        found = ranked.join(slots, "length").where((nth >= 0) & (nth < F.col("ranks")))
        return found.withColumns({"sequence_id": F.col("first_sequence") + F.floor(nth / F.col("each")), "offset": F.col("at") + nth % F.col("each") * F.col("length")})
    table = np.array(sorted(planned), np.int64).reshape(-1, 6)
    most = int((table[:, 1] + table[:, 2]).max(initial=1))
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        t, n, r = shared.value, length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(t[:, 0] * most + t[:, 1], n * most + r, "right") - 1
        nth = r - t[at, 1]
        return pd.DataFrame({"sequence_id": t[at, 3] + nth // t[at, 4], "offset": t[at, 5] + nth % t[at, 4] * n})

    return ranked.withColumn("slot", slot("length", "rank")).select(*ranked.columns, "slot.*")
