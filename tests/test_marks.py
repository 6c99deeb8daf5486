"""Marks of blocks in long runs of bytes."""

from __future__ import annotations

import random
import tracemalloc

from lexshelf.operators import blocks as B


def planted(n: int, at: list[int]) -> bytes:
    """n bytes without marks but those at these bits, every other one of a block."""
    bits = int.from_bytes(random.Random(5).randbytes(n), "big")
    for k, bit in enumerate(at):
        left = 8 * n - bit - B.MARK_BITS
        bits = bits & ~(((1 << B.MARK_BITS) - 1) << left) | (B.END_MARK if k % 2 else B.BLOCK_MARK) << left
    return bits.to_bytes(n, "big")


def test_marks_over_edges_of_pieces(monkeypatch):
    edges = [8 * B.SEEK_BYTES * k for k in (1, 2)]
    at = [3, *(e + d for e in edges for d in (-70, -13, 40)), 8 * 3 * B.SEEK_BYTES - B.MARK_BITS]
    data = planted(3 * B.SEEK_BYTES, at)
    assert B.marks(data, len(data)) == [(bit, k % 2 == 0) for k, bit in enumerate(at)]
    assert B.marks(data, B.SEEK_BYTES) == [(bit, k % 2 == 0) for k, bit in enumerate(at) if bit < edges[0]]
    small = planted(100, [1, 60, 130, 752])
    for step in range(1, 101):
        monkeypatch.setattr(B, "SEEK_BYTES", step)
        for own in (0, 1, 8, 16, 17, 94, 95, 100):
            assert B.marks(small, own) == B.marks_at_once(small, own)
    assert B.marks(b"", 5) == []


def test_memory_of_marks_does_not_grow_with_the_chunk():
    data = bytes(16 << 20)
    tracemalloc.start()
    B.marks(data, len(data))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20
