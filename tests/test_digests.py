"""Digests of long runs of bytes, slice by slice."""

from __future__ import annotations

import hashlib
import random

import pytest

from lexshelf.plans import catalogue
from lexshelf.sources import digests


@pytest.mark.parametrize("sizes", [[0], [1], [1000], [64, 64], [100, 0, 7000, 1, 129]])
def test_slices_go_on(spark, tmp_path, monkeypatch, sizes):
    monkeypatch.setattr(digests, "SLICE_BYTES", 1777)
    data = [random.Random(i).randbytes(n) for i, n in enumerate(sizes)]
    for i, part in enumerate(data):
        (tmp_path / f"dump.{i}").write_bytes(part)
    assert digests.sha256(spark, f"{tmp_path}/dump") == (hashlib.sha256(b"".join(data)).hexdigest(), sum(sizes))


def test_without_the_library(spark, tmp_path, monkeypatch):
    (tmp_path / "dump").write_bytes(b"x" * 5000)
    monkeypatch.setattr(digests, "library", lambda: None)
    assert digests.sha256(spark, f"{tmp_path}/dump") == (hashlib.sha256(b"x" * 5000).hexdigest(), 5000)
    assert digests.gone_on(None, iter([b"a", b"bc"]), True) == hashlib.sha256(b"abc").digest()


def test_joined_parts_is_shared_out(spark, tmp_path, monkeypatch):
    texts, took, plain = ["ä" * 40_000, None, "", "b" * 90_001], [], digests.after
    spark.createDataFrame(list(enumerate(texts)), "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(digests, "SLICE_BYTES", 50_000)
    monkeypatch.setattr(digests, "after", lambda *a: (took.append(a[4] - a[3]), plain(*a))[1])
    whole = "".join(t or "" for t in texts).encode()
    assert catalogue.joined_parts(spark, str(tmp_path)).collect() == [(hashlib.sha256(whole).hexdigest(), len(whole))]
    assert sum(took) == len(whole) and max(took) == 50_000


@pytest.mark.parametrize(("texts", "want"), [([], (None, None)), ([None], (None, None)), ([""], (hashlib.sha256().hexdigest(), 0))])
def test_joined_parts_of_nothing(spark, tmp_path, texts, want):
    spark.createDataFrame(list(enumerate(texts)), "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert catalogue.joined_parts(spark, str(tmp_path)).collect() == [want]
