"""Binary parts, record files, HTTP ranges and block states."""

from __future__ import annotations

import hashlib
import random
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lexshelf.operators import states
from lexshelf.schemas import BLOCKS
from lexshelf.sources import binarysink, http, records, snapshots
from lexshelf.sources.parts import ByteParts

ROWS = "place bigint, content binary"


@pytest.mark.parametrize("part_bytes", [7, 1000, 1 << 20])
def test_parts_are_rolled_inside_records(spark, tmp_path, part_bytes):
    rng = random.Random(part_bytes)
    rows = [(i * 37, rng.randbytes(rng.choice([0, 1, 5, 40, 900]))) for i in range(60)] + [(99_999, None), (5, b"\n\x00\r")]
    binarysink.roll_parts(spark.createDataFrame(rows, ROWS).repartition(5), str(tmp_path), "d.bin", part_bytes)
    want = b"".join(c or b"" for _, c in sorted(rows))
    dump = ByteParts(str(tmp_path / "d.bin"))
    assert dump.read(0, dump.size) == want and all(n == part_bytes for _, n in dump.files[:-1]) and len(dump.files) == -(-len(want) // part_bytes)
    assert all(p.name.startswith("d.bin.") for p in tmp_path.iterdir())


def test_aborted_job_leaves_nothing(spark, tmp_path):
    folder = tmp_path / "out"
    binarysink.write_parts(spark.createDataFrame([(0, 0, b"kept")], "part int, at bigint, content binary"), str(folder), "x")
    rows = spark.range(200).select((F.col("id") % 4).cast("int").alias("part"), "id", F.when(F.col("id") == 150, F.raise_error(F.lit("boom"))).otherwise(F.lit("row")).alias("content"))
    with pytest.raises(Exception, match="boom"):
        binarysink.write_parts(rows.withColumnRenamed("id", "at"), str(folder), "x")
    assert {p.name: p.read_bytes() for p in folder.iterdir()} == {"x.0": b"kept"}
    spark.dataSource.register(binarysink.PartFiles)
    twice = spark.createDataFrame([(1, b"a"), (1, b"b")], "part int, content binary").repartition(2)
    with pytest.raises(Exception, match="several tasks"):
        twice.write.format("part_files").option("base", "x").mode("append").save(str(folder))
    assert {p.name for p in folder.iterdir()} == {"x.0"}


def test_tail_is_repaired(spark, tmp_path):
    """A record file that was cut inside a record is cut back, and further blocks follow in new files."""
    blocks = spark.createDataFrame([(i, 32 + 100 * i, i % 3) for i in range(50)], BLOCKS)
    records.write_record_files(blocks.where("block_no < 30"), str(tmp_path), 8)
    assert sorted(p.stat().st_size for p in tmp_path.iterdir()) == [120, 160, 160, 160]
    with (tmp_path / "blocks.3").open("ab") as f:
        f.write(b"\x00" * 13)
    (tmp_path / "blocks.4").write_bytes(b"\x01" * 7)
    assert records.repair_record_files(spark, str(tmp_path)) == 2 and records.repair_record_files(spark, str(tmp_path)) == 0
    assert sorted((p.name, p.stat().st_size) for p in tmp_path.iterdir()) == [("blocks.0", 160), ("blocks.1", 160), ("blocks.2", 160), ("blocks.3", 120), ("blocks.4", 0)]
    records.append_record_files(blocks.where("block_no >= 30"), str(tmp_path), 8)
    assert sorted(map(tuple, records.read_record_files(spark, str(tmp_path)).collect())) == sorted(map(tuple, blocks.collect()))


@pytest.fixture
def server():
    """Serves data in ranges, and breaks the connection off now and then."""

    class Handler(BaseHTTPRequestHandler):
        data, tag, broken, ranges = random.Random(1).randbytes(300_000), '"v1"', 0, True

        def do_HEAD(self):
            self.send_response(200)
            self.send_header("Content-Length", str(len(self.data)))
            self.send_header("ETag", self.tag)
            self.end_headers()

        def do_GET(self):
            start, stop = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
            same = self.headers.get("If-Range", self.tag) == self.tag and Handler.ranges
            body = self.data[start : stop + 1] if same else self.data
            self.send_response(206 if same else 200)
            self.send_header("Content-Length", str(len(body)))
            self.send_header("ETag", self.tag)
            self.end_headers()
            if Handler.broken:
                Handler.broken -= 1
                body = body[: len(body) // 3]
                self.close_connection = True
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    made = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}/d.bz2", Handler
    made.shutdown()


def test_ranges_over_http(spark, tmp_path, server):
    url, handler = server
    assert http.head(url) == (300_000, '"v1"')
    handler.broken = 4
    got = b"".join(bytes(r.content) for r in sorted(http.read_ranges(spark, url, 40_000).collect()))
    assert got == handler.data and handler.broken == 0
    http.download(spark, url, str(tmp_path), "d.bz2", 70_000, 33_000)
    (tmp_path / "d.bz2.3").unlink()
    (tmp_path / "d.bz2.2").write_bytes(handler.data[140_000:150_000])
    handler.broken = 1
    http.download(spark, url, str(tmp_path), "d.bz2", 70_000, 33_000)  # goes on after the whole parts
    whole = ByteParts(str(tmp_path / "d.bz2"))
    assert [n for _, n in whole.files] == [70_000] * 4 + [20_000] and hashlib.md5(whole.read(0, whole.size)).digest() == hashlib.md5(handler.data).digest()
    with pytest.raises(Exception, match="has changed"):
        http.read_ranges(spark, url, 40_000, tag='"v0"').collect()
    with pytest.raises(ValueError, match="has changed"):
        http.get_range(url, 5, 10, '"v0"')
    handler.ranges = False
    with pytest.raises(ValueError, match="no ranges"):
        http.get_range(url, 5, 10)


def test_states_during_compaction(spark, tmp_path):
    """Readers before, during and after a compaction, appends beside it, and deltas that go."""
    home, want = str(tmp_path), {}
    blocks = spark.createDataFrame([(i, 32 + i, None) for i in range(20)], "block_no bigint, block_start_bits bigint, index_state int")
    rng = random.Random(4)
    seen = lambda frame: {r.block_no: r.index_state for r in frame.collect()}
    assert seen(states.catalog(blocks, home)) == dict.fromkeys(range(20), 0) and not states.compact(spark, home)
    seq = list(range(90))
    rng.shuffle(seq)  # events need not come in their order
    newest: dict[int, int] = {}

    def add(n):
        rows = [(rng.randrange(20), rng.randrange(3), seq.pop()) for _ in range(n)]
        for b, s, q in rows:
            if q >= newest.get(b, -1):
                newest[b], want[b] = q, s
        states.append(spark.createDataFrame(rows, states.EVENTS), home)

    for _ in range(3):
        add(10)
    before, expected = states.catalog(blocks, home), {i: want.get(i, 0) for i in range(20)}
    assert states.compact(spark, home) and not states.compact(spark, home)
    assert seen(before) == seen(states.catalog(blocks, home)) == expected
    for _ in range(3):
        add(10)
        assert seen(states.catalog(blocks, home)) == {i: want.get(i, 0) for i in range(20)}
    assert not states.compact(spark, home, 3) and states.compact(spark, home, 2) and seen(before) == expected
    add(10)
    states.vacuum(spark, home, 0)
    assert len(snapshots.listed(spark, f"{home}/deltas")) == 1 and len(snapshots.history(spark, home)) == 1
    assert seen(states.catalog(blocks, home)) == {i: want.get(i, 0) for i in range(20)}
