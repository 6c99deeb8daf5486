"""HyperMinHash near-dedup against all pairs of full sets."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from data import SCHEMA, documents  # noqa: E402

from lexshelf.llm import hyperminhash, simhash  # noqa: E402
from lexshelf.llm.hyperminhash import MANTISSA, REGISTERS, estimates, registers, shingle_set  # noqa: E402


def shingles(text: str | None) -> frozenset:
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def plain(rows: list[tuple], percent: int = 85) -> list[tuple]:
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if group[a] != group[b] and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    group = [group[b] if g == group[a] else g for g in group]
    least: dict[int, int | None] = {}
    for r, g in zip(rows, group, strict=True):
        least[g] = r[0] if least.get(g) is None else least[g] if r[0] is None else min(least[g], r[0])
    return sorted(((r[0], len(s), least[g], r[0] is not None and r[0] == least[g]) for r, s, g in zip(rows, sets, group, strict=True)), key=repr)


def edited(words: list[str], n: int, rng: random.Random) -> list[str]:
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def near_copies(seed: int = 3) -> list[tuple]:
    """Groups of texts of 1 to 400 words with so many edits that their likeness is about the threshold."""
    rng, rows = random.Random(seed), []
    for size in [1, 2, 4, 5, 6, 8, 11, 15, 25, 40, 80, 150, 400]:
        words = [f"w{rng.randrange(3000)}" for _ in range(size)]
        for i in range(8):
            rows.append((len(rows), " ".join(edited(words, min(i * size // 60 + (i > 4), size), rng) + [f"tail{i}"] * (i % 3 == 2))))
    return rows + [(900, rows[40][1].upper()), (901, rows[40][1].replace(" ", "\n\t ")), (902, "É w1 w2 w3 w4"), (903, "é w1 w2 w3 w4")]


@pytest.mark.parametrize("chunk", [4096, 3])
def test_dedup(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)  # 3: shards and clusters are cut
    rows = documents()
    rows += [(r[0] + 200, r[1], "en", "s", 0, "k", "r", "s") for r in near_copies()]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = hyperminhash.dedup(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows)


@pytest.mark.parametrize("percent", [80, 95, 100])
def test_thresholds(spark, percent):
    rows = near_copies(percent)
    got = hyperminhash.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), percent=percent)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, percent)


def test_chain_in_one_cluster(spark):
    """Each text is near the next one only, and a sibling of all is near none: links that estimates propose and full sets refute part the cluster."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(words)))
        words = words[6:] + [f"v{i}-{j}" for j in range(6)]
    for i in range(30):  # about 0.8 alike
        rows.append((100 + i, " ".join(edited([f"u{j}" for j in range(300)], 6 if i else 0, rng))))
    got = hyperminhash.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows)


@pytest.mark.parametrize("n", [1, 7, 60, 3000])
def test_sketches(n):
    rng = np.random.default_rng(n)
    a = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
    b = np.unique(np.r_[a[: n - n // 10], rng.integers(0, 1 << 64, n // 10, np.uint64)])
    ra, rb = registers(a, MANTISSA), registers(b, MANTISSA)
    assert (registers(np.union1d(a, b), MANTISSA) == np.maximum(ra, rb)).all() and ra.max() < 1 << 16
    about, filled = estimates(ra[None].astype(np.uint16), rb[None].astype(np.uint16), np.array([len(a)]), np.array([len(b)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(about[0] - true) <= 5 * np.sqrt(0.25 / filled[0]) and 0 < filled[0] <= REGISTERS


def test_unrelated_sets_are_corrected():
    rng = np.random.default_rng(2)
    size = np.array([2000])
    sketch = lambda: registers(rng.integers(0, 1 << 64, 2000, np.uint64), MANTISSA)[None]
    assert abs(np.mean([estimates(sketch(), sketch(), size, size)[0][0] for _ in range(300)])) < 2e-4


def test_words_of_shingles():
    assert len(shingle_set(b"", 5)) == len(shingle_set(b" \n", 5)) == 0
    assert len(shingle_set(b"a b", 5)) == len(shingle_set(b"a b c d e", 5)) == 1 and len(shingle_set(b"a a a a a a a", 5)) == 1
    assert (shingle_set(b"A b\x0bC", 5) == shingle_set(b"a  B c", 5)).all() and (shingle_set(b"a b", 5) != shingle_set(b"b a", 5)).all()


def test_nothing(spark):
    assert hyperminhash.dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError, match="80 to 100"):
        hyperminhash.dedup(spark.createDataFrame([], SCHEMA), percent=50)
