"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Features of a text are its words and word pairs, and the shapes of both (letters, capitals, digits and other characters, runs of
one kind cut to one; a pair also tells whether a word repeats), hashed to 2**BITS slots, with counts over the square root of
the number of n-grams. Training takes a bounded sample of labelled rows (TRAIN_ROWS), dealt over SHARDS tasks by hash; each runs FTRL
over its rows, whole texts one by one, and the weights are averaged, so nothing but one vector of fixed size reaches the driver.
A score is the sparse dot product of a text's features with that vector, through the logistic function.

Defined cases: a null or empty text has no features and gets the score of the bias alone; labels that are null,
other than 0 and 1, or contradict each other for one id are left out; with no usable labels every score is 0.5; a text is scored whole, however
long; repeated rows are scored each for itself and train once; an empty table gives no rows; columns that are not named are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexshelf.llm.common import text_of

BITS = 18
#: Labelled rows that are used for training at most.
TRAIN_ROWS = 24_000
SHARDS, EPOCHS = 6, 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.05, 1.0


#: The kind of each byte: lower-case and non-ASCII letters, capitals, digits, white space; others stand for themselves.
KINDS = np.arange(256, dtype=np.uint8)
for _kind, _bytes in ((b"a", [*range(ord("a"), ord("z") + 1), *range(128, 256)]), (b"A", range(ord("A"), ord("Z") + 1)), (b"0", range(ord("0"), ord("9") + 1)), (b" ", b"\t\n\v\f\r")):
    KINDS[list(_bytes)] = ord(_kind)


def shapes(text: bytes) -> list[bytes]:
    """The shape of each word: ``Well,`` is ``Aa,`` and ``LOUD!!`` is ``A!``."""
    kinds = KINDS[np.frombuffer(text, np.uint8)]
    return kinds[np.r_[True, kinds[1:] != kinds[:-1]]].tobytes().split() if len(kinds) else []


def ngrams(text: bytes) -> np.ndarray:
    """Slots of all words, word pairs and their shapes, repeats included; slot 0 belongs to the bias."""
    words = text.split()
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    shape = np.fromiter(map(zlib.crc32, shapes(text)), np.uint64, len(words))
    a, b, c = np.uint64(0x9E3779B1), np.uint64(0x85EBCA77), np.uint64(0x27D4EB2F)
    again = (h[1:] == h[:-1]).astype(np.uint64)
    every = [h * np.uint64(0x9E3779B97F4A7C15), (h[:-1] * a + h[1:] * b) * np.uint64(0xC2B2AE3D27D4EB4F)]
    every += [(shape + c) * np.uint64(0x165667B19E3779F9), (shape[:-1] * b + shape[1:] * a + again * c) * np.uint64(0xD6E8FEB86659FD93)]
    return np.maximum(np.concatenate(every) >> np.uint64(64 - BITS), 1).astype(np.int64)


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots and their values, the bias first."""
    every = ngrams(text)
    slots, counts = np.unique(every, return_counts=True)
    return np.concatenate([[0], slots]), np.concatenate([[1.0], counts / np.sqrt(max(len(every), 1))])


def logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-min(max(x, -30.0), 30.0))))


class Model:
    """FTRL-proximal with per-coordinate rates, a text at a time."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(self, slots: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, text: bytes, y: int) -> None:
        slots, values = features(text)
        n, w = self.n[slots], self.weights(slots)
        g = (logistic(float(w @ values)) - y) * values
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        self.z[slots] += g - sigma * w
        self.n[slots] = n + g * g


def train(rows: list[tuple[bytes, int]], epochs: int = EPOCHS) -> np.ndarray:
    """The weights after the rows in order, epochs times."""
    model = Model()
    for text, y in rows * epochs:
        model.learn(text, y)
    return model.weights()


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id: str = "doc_id", text: str = "text", usable: Column | None = None, most: int = TRAIN_ROWS) -> np.ndarray:
    """The weights. Of the labelled ids, the most with the smallest hashes are used, each with its whole text.

    Rows stand in a shard's task in the order of training, once for each epoch, and pass one by one: the task holds the model and one text.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull())
    known = known if usable is None else known.where(usable)
    known = known.groupBy(F.col(id).alias("id")).agg(F.min(label).alias("y"), F.max(label).alias("y2")).where("y = y2").select("id", "y")
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(most)
    rows = docs.select(F.col(id).alias("id"), text_of(text).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.withColumn("rank", F.xxhash64("id", "text")).withColumn("shard", F.pmod("rank", F.lit(SHARDS)))

    def told(model: Model) -> pa.RecordBatch:
        w = model.weights()
        at = np.flatnonzero(w)
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at])], names=["slot", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, model = None, None
        for b in batches:
            for shard, text, y in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), b.column(2).to_pylist(), strict=True):
                if shard != now:
                    if model is not None:
                        yield told(model)
                    now, model = shard, Model()
                model.learn(text.as_py(), int(y))
        if model is not None:
            yield told(model)

    # A copy of one text may stand in very many rows: each distinct id trains once.
    rows = rows.groupBy("shard", "id").agg(F.min(F.struct("rank", "text", "y")).alias("r")).select("shard", "r.*")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS)))).repartition(SHARDS, "shard").sortWithinPartitions("shard", "epoch", "rank")
    found = rows.select("shard", "text", "y").mapInArrow(run, "slot bigint, w double").groupBy("slot").agg((F.sum("w") / SHARDS).alias("w")).toPandas()
    w = np.zeros(1 << BITS, np.float32)
    w[found["slot"].to_numpy(np.int64)] = found["w"].to_numpy()
    return w


def scorer(docs: DataFrame, weights: np.ndarray) -> Callable[[Column], Column]:
    """The score of a text column: only texts go through Python."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        w, got = shared.value, []
        for text in texts:
            slots = ngrams(text.encode())
            got.append(logistic(float(w[0]) + float(w[slots].sum(dtype=np.float64)) / np.sqrt(max(len(slots), 1))))
        return pd.Series(got, dtype=float)

    return scored


def score(docs: DataFrame, weights: np.ndarray, id: str = "doc_id", text: str = "text", name: str = "score") -> DataFrame:
    """id, and the score, called name: one pass without a shuffle."""
    return docs.select(F.col(id), scorer(docs, weights)(text_of(text)).alias(name))


def keep_good(docs: DataFrame, weights: np.ndarray, id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """docs that score at least least."""
    return docs.where(scorer(docs, weights)(text_of(text)) >= least)
