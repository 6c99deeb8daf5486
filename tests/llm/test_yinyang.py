"""Centroid clustering against plain k-means in whole numbers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from lexshelf.llm import yinyang

SCHEMA = "vec_id bigint, embedding array<double>, cluster string, x string, distance string, upper string"


def plain(rows: list[tuple], k: int, rounds: int, width: int, scale: int) -> tuple[list[tuple], list[list[int]]]:
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    said = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, r[1])
    centroids = [v for _, v in sorted(kept, key=said)[:k]]
    d = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((d(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in set(own):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            centroids[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=repr), centroids


def vectors(n: int, width: int, spread: float, seed: int = 0) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width)) * spread
    rows = [(i, (centres[i % 5] + rng.normal(size=width) * spread / 4).tolist()) for i in range(n)]
    rows += [(n, None), (n + 1, [0.5] * (width - 1)), (n + 2, [float("nan")] * width), (n + 3, [float("inf")] * width), (n + 4, [None] * width), (n + 5, [])]
    return rows + [rows[3], rows[3], (4, rows[5][1]), (None, rows[6][1]), (n + 6, [0.0] * width), (n + 7, [-0.001] * width)]


@pytest.mark.parametrize(("spread", "k", "rounds", "block"), [(1.0, 16, 3, 7), (0.02, 16, 3, 8192), (1.0, 9, 6, 50), (1e7, 8, 3, 8192), (1e15, 6, 2, 30), (1.0, 500, 2, 8192), (1.0, 1, 3, 8192)])
def test_against_plain_k_means(spark, monkeypatch, spread, k, rounds, block):
    """Small spreads give many ties and repeated vectors; large ones leave 64-bit floats, and then 64-bit squares."""
    monkeypatch.setattr(yinyang, "BLOCK", block)
    rows = vectors(150, 8, spread)
    want, centroids = plain(rows, k, rounds, 8, 64)
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(3)
    got, found = yinyang.fit(docs, k=k, rounds=rounds, width=8)
    assert got.columns == ["vec_id", "cluster", "distance"] and found.tolist() == centroids
    assert sorted((tuple(r) for r in got.collect()), key=repr) == [(i, c, min(d, yinyang.MOST)) for i, c, d in want]
    summed = {(r.cluster, r.cluster_inertia, r.inertia) for r in yinyang.summed(got).collect()}
    by = {c: sum(min(d, yinyang.MOST) for _, o, d in want if o == c) for c in {o for _, o, _ in want}}
    assert summed == {(c, min(s, yinyang.MOST), min(sum(by.values()), yinyang.MOST)) for c, s in by.items()}


def test_bounds_rule_distances_out():
    """On vectors that stand in clusters, bounds leave out most of the distances, and results stay those of a whole scan."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-500, 500, (32, 16))
    x = centres[rng.integers(0, 32, 4000)] + rng.integers(-20, 20, (4000, 16))
    c = x[:32].copy()
    group = yinyang.grouped(c)
    assert 1 < group.max() + 1 <= 8
    cluster, upper, lower = yinyang.first_bounds(x, c, group)
    counts = []
    for _ in range(6):
        before = c.copy()
        for j in set(cluster.tolist()):
            c[j] = x[cluster == j].sum(0) // (cluster == j).sum()
        counts.append(yinyang.next_bounds(x, cluster, upper, lower, c, group, np.sqrt(((c - before) ** 2).sum(1)) * (1 + yinyang.SLACK)))
        d = ((x[:, None] - c) ** 2).sum(2)
        assert (cluster == d.argmin(1)).all()
        for g in range(group.max() + 1):
            others = np.where((group == g) & (np.arange(32) != cluster[:, None]), d, 1 << 40)
            assert (lower[:, g] <= np.sqrt(others.min(1)) + 1e-6).all()
    assert counts[-1] < 4000 * 32 / 4


def test_no_vectors(spark):
    got, found = yinyang.fit(spark.createDataFrame([], SCHEMA))
    assert yinyang.summed(got).collect() == [] and len(found) == 0
    got, found = yinyang.fit(spark.createDataFrame([(1, None, "", "", "", "")], SCHEMA))
    assert got.collect() == [] and len(found) == 0
