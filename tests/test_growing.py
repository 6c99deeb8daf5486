"""A stream of blocks over one .bz2 that grows by bytes, stopped and restarted."""

from __future__ import annotations

import bz2
import random

import pytest

from lexshelf.operators import blocks as B
from lexshelf.operators.index import first_wins
from lexshelf.sources.parts import ByteParts
from lexshelf.streaming import dumpsource as D


def text_of(n: int, seed: int) -> bytes:
    rng = random.Random(seed)
    body = lambda: "".join(rng.choice("abcdefghij klmnop\n") for _ in range(rng.randrange(100, 20_000)))
    return "".join(f"<page><title>T{seed}-{i}</title><text>{body()}</text></page>\n" for i in range(n)).encode()


def run(spark, path, home, most):
    query = D.index_growing(spark, path, home, most, 30_000)
    try:
        query.processAllAvailable()
    finally:
        query.stop()


@pytest.mark.parametrize("most", [40_000, 1 << 30])
def test_growing_file(spark, tmp_path, most):
    """The file is cut inside of blocks and of marks; a second stream follows the first one's end."""
    data = bz2.compress(text_of(90, 1), 1) + bz2.compress(text_of(20, 2), 1)
    path, home = tmp_path / "d.bz2", str(tmp_path / "home")
    path.write_bytes(b"")
    starts = sorted(r.block_start_bits for r in spark_blocks(spark, tmp_path, data))
    sizes = [3, starts[4] // 8 + 3, starts[4] // 8 + 9000, len(data) - 5, len(data)]
    for size in sizes:
        path.write_bytes(data[:size])
        run(spark, str(path), home, most)
    assert {r.title for r in D.titles_so_far(spark, home).collect()} == {f"T1-{i}" for i in range(90)} | {f"T2-{i}" for i in range(20)}
    per_batch = [r.blocks for r in D.batches(spark, home).collect()]
    assert sum(per_batch) == len(starts) and (len(per_batch) > len(sizes) if most == 40_000 else len(per_batch) <= len(sizes))
    whole = first_wins(B.titles_only(B.block_titles(B.find_blocks(spark, str(path)), str(path))))
    assert sorted(map(tuple, D.titles_so_far(spark, home).collect())) == sorted(map(tuple, whole.collect()))
    run(spark, str(path), home, most)  # nothing is new
    assert sum(r.blocks for r in D.batches(spark, home).collect()) == len(starts)


def spark_blocks(spark, tmp_path, data):
    (tmp_path / "whole.bz2").write_bytes(data)
    return B.find_blocks(spark, str(tmp_path / "whole.bz2")).collect()


def test_offsets(tmp_path):
    """An offset is a mark whose block before it can be read; a mark that stands inside a block by chance is none."""
    data = bz2.compress(text_of(40, 3), 1)
    path = tmp_path / "d.bz2"
    path.write_bytes(data)
    dump = ByteParts(str(path))
    found = [b for b, _ in B.marks(data, len(data))]
    assert D.last_mark(dump, 0, 1 << 40) == found[-1] and D.last_mark(dump, 0, found[3] // 8 + 7) == found[3]
    assert D.last_mark(dump, found[2], found[2] // 8 + 1) in found[3:] and D.last_mark(dump, found[-1], 1 << 40) == found[-1]
    cut = data[: found[2] // 8 + 5000] + B.BLOCK_MARK.to_bytes(6, "big") + bytes(range(200))
    path.write_bytes(cut)
    assert D.last_mark(ByteParts(str(path)), 0, 1 << 40) == found[2]
    path.write_bytes(data[:3])
    assert D.last_mark(ByteParts(str(path)), 0, 1 << 40) == 0
