"""The dump lanes on generated dumps whose pages straddle blocks and parts."""

from __future__ import annotations

import bz2
import random
import time
from collections import Counter

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexshelf.operators import blocks as B
from lexshelf.operators import index as I
from lexshelf.operators import search as S
from lexshelf.operators import states
from lexshelf.operators.pages import broken_pages, parse_pages, titles_of
from lexshelf.operators.titleindex import TitleIndex
from lexshelf.plans import stages
from lexshelf.schemas import BLOCKS, FINISHED, PAGES, TITLES, create_table
from lexshelf.sources import binarysink, parts, records
from lexshelf.sources.dump import read_dump
from lexshelf.streaming.incremental import Progress, index_blocks, index_stream, table_or_none


def page(n: int, rng: random.Random) -> str:
    text = "".join(rng.choice([*"abcdefghij klmnopé\n", "&lt;"]) for _ in range(rng.randrange(200, 30_000)))
    return f"""  <page>
    <title>Page &amp; {n:03d} é</title>
    <ns>0</ns>
    <id>{n}</id>
    <revision><id>{n * 10}</id><contributor><username>u</username><id>99999</id></contributor><comment>c{n}</comment><text bytes="5" xml:space="preserve"> {text}</text></revision>
  </page>
"""


@pytest.fixture(scope="module")
def dump(tmp_path_factory):
    rng = random.Random(3)
    xml = "<dump>\n<siteinfo><sitename>x</sitename></siteinfo>\n" + "".join(page(i, rng) for i in range(120)) + "</dump>\n"
    folder = tmp_path_factory.mktemp("dump")
    data = bz2.compress(xml.encode(), 1)
    (folder / "whole.xml.bz2").write_bytes(data)
    size = len(data) // 3 + 11
    for i in range(3):
        (folder / f"cut.xml.bz2.{i}").write_bytes(data[i * size : (i + 1) * size])
    return folder, xml, data


@pytest.fixture(scope="module")
def blocks(spark, dump):
    return B.find_blocks(spark, str(dump[0] / "cut.xml.bz2"), 50_000).cache()


def test_page_lane(spark, dump):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        rows = read_dump(spark, str(dump[0] / "whole.xml.bz2"))
        assert rows.rdd.getNumPartitions() > 1
        pages = parse_pages(rows)
        assert [f.name for f in pages.schema] == PAGES.names
        got = sorted(pages.collect(), key=lambda r: r.id)
        assert [(r.title, r.id, r.rev_id, r.comment) for r in got] == [(f"Page & {i:03d} é", i, i * 10, f"c{i}") for i in range(120)]
        assert all(r.text.startswith(" ") for r in got)
        assert {r.title for r in titles_of(rows).collect()} == {r.title for r in got}
        assert broken_pages(rows).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_truncated_dump_fails(spark, dump, tmp_path):
    (tmp_path / "short.bz2").write_bytes(dump[2][: len(dump[2]) // 2])
    with pytest.raises(Exception, match=r"FAILED_READ_FILE|end of stream|EOF"):
        read_dump(spark, str(tmp_path / "short.bz2")).count()


def test_marks_and_decoding(spark, dump, blocks):
    _, xml, data = dump
    got = sorted(blocks.collect())
    starts = [r.block_start_bits for r in got]
    assert [r.block_no for r in got] == list(range(len(got))) and len(got) > 10 and starts[0] == 32
    assert all(a < b for a, b in zip(starts, starts[1:], strict=False)) and starts[-1] < 8 * len(data)
    assert [r.stop_bits for r in got[:-1]] == starts[1:]
    assert any(s % 8 for s in starts)
    read = lambda a, b: data[a:b]
    assert b"".join(B.decode(read, r.block_start_bits, r.stop_bits) for r in got) == xml.encode()
    three = bz2.decompress(B.carve(read, starts[2:5], got[4].stop_bits))
    assert three == b"".join(B.decode(read, r.block_start_bits, r.stop_bits) for r in got[2:5])
    whole = B.find_blocks(spark, str(dump[0] / "whole.xml.bz2"), 1 << 20)
    assert sorted(whole.collect()) == got
    assert sorted(B.find_blocks(spark, str(dump[0] / "cut.xml.bz2"), 50_000, after=(4, starts[4])).collect()) == got[5:]
    first = sorted(B.find_blocks(spark, str(dump[0] / "cut.xml.bz2"), 50_000, stop=starts[7] // 8).collect())
    assert [r.block_start_bits for r in first] == starts[:7]
    plain = B.as_catalog(blocks)
    assert sorted(r.stop_bits for r in B.pair_blocks(plain, got[-1].stop_bits).collect()) == [r.stop_bits for r in got]


def test_many_streams(spark, tmp_path):
    texts = [b"<page><title>T%d</title></page>" % i * 3 for i in range(5)]
    (tmp_path / "m.bz2").write_bytes(b"".join(map(bz2.compress, texts)))
    got = sorted(B.find_blocks(spark, str(tmp_path / "m.bz2"), 37).collect())
    data = (tmp_path / "m.bz2").read_bytes()
    assert [B.decode(lambda a, b: data[a:b], r.block_start_bits, r.stop_bits) for r in got] == texts
    assert b"".join(d for d, _ in B.decode_on(parts.ByteParts(str(tmp_path / "m.bz2")), 32)) == b"".join(texts)


def test_marks_inside_blocks(dump, blocks, monkeypatch):
    """A mark that stands inside a block by chance is passed over, and told with the block."""
    starts = sorted(r.block_start_bits for r in blocks.collect())
    false, plain = starts[2] + 12345, B.marks

    def seen(data: bytes, own: int) -> list[tuple[int, bool]]:
        base = 8 * dump[2].find(data[:64])
        extra = [(false - base, True)] if 0 <= false - base < 8 * own else []
        return sorted([*plain(data, own), *extra])

    monkeypatch.setattr(B, "marks", seen)
    got = list(B.decode_on(parts.ByteParts(str(dump[0] / "whole.xml.bz2")), 32))
    assert b"".join(d for d, _ in got) == dump[1].encode() and [m for _, m in got if m] == [[false]]
    with pytest.raises((OSError, ValueError, EOFError)):
        list(B.decode_on(parts.ByteParts(str(dump[0] / "whole.xml.bz2")), false))


def test_faults_are_told(spark, dump, blocks, tmp_path):
    """A block that cannot be decoded has a row with its fault and keeps its state; all others are indexed."""
    starts = sorted(r.block_start_bits for r in blocks.collect())
    data = bytearray(dump[2])
    for i in range(6):
        data[starts[5] // 8 + 300 + i] ^= 0x5A
    (tmp_path / "bad.bz2").write_bytes(data)
    found = B.block_titles(B.find_blocks(spark, str(tmp_path / "bad.bz2")), str(tmp_path / "bad.bz2")).cache()
    faults = {r.block_start_bits: r.fault for r in B.block_faults(found).collect()}
    assert starts[5] in faults and all(faults.values()) and set(faults) <= {starts[4], starts[5]}  # a head may run on from the block before
    assert {r.block_start_bits for r in B.blocks_done(found).collect()} == set(starts) - set(faults)
    raw = b"<page><title>cut \xe6\xbc</title></page><page><title>odd \xff</title></page><page><title>ok</title></page>"
    (tmp_path / "utf.bz2").write_bytes(bz2.compress(raw))
    found = B.block_titles(B.find_blocks(spark, str(tmp_path / "utf.bz2")), str(tmp_path / "utf.bz2"))
    assert {r.title: r.fault for r in found.where("title is not null").collect()} == {"cut \ufffd": "truncated", "odd \ufffd": "lead", "ok": None}


def test_block_titles_and_fetch(spark, dump, blocks):
    folder, xml, _ = dump
    path = str(folder / "cut.xml.bz2")
    found = B.titles_only(B.block_titles(blocks, path)).cache()
    got = sorted(found.collect(), key=lambda r: r.title)
    assert [r.title for r in got] == [f"Page & {i:03d} é" for i in range(120)]
    raw, sizes = xml.encode(), {}
    at = 0
    for r in sorted(blocks.collect()):
        sizes[r.block_start_bits] = at
        at += len(B.decode(lambda a, b: dump[2][a:b], r.block_start_bits, r.stop_bits))
    assert all(raw[sizes[r.block_start_bits] + r.title_start_pos :].startswith(b"<page>") for r in got)
    pages = parse_pages(B.fetch_markup(found, path))
    lane = parse_pages(read_dump(spark, str(folder / "whole.xml.bz2")))
    assert sorted(map(tuple, pages.select("id", "title", "text").collect())) == sorted(map(tuple, lane.select("id", "title", "text").collect()))


def test_fetched_pages_leave_in_bounded_frames(spark, dump, blocks, monkeypatch):
    path, runs = str(dump[0] / "cut.xml.bz2"), []
    found = B.titles_only(B.block_titles(blocks, path)).orderBy("block_start_bits", "title_start_pos").toPandas()
    entries = spark.createDataFrame(found)
    plain = type(entries).mapInPandas
    monkeypatch.setattr(type(entries), "mapInPandas", lambda df, f, schema: (runs.append(f), plain(df, f, schema))[1])
    B.fetch_markup(entries, path)
    many = pd.concat([found] * 20).sort_values(["block_start_bits", "title_start_pos"])
    lengths = [[len(v) for v in made["value"]] for made in runs[-1](iter([many]))]
    assert sum(map(len, lengths)) == 20 * 120 and sum(map(sum, lengths)) > 5 * (4 << 20)
    assert max(map(sum, lengths)) < (4 << 20) + 40_000


def test_index_blocks_is_idempotent(spark, dump, blocks, tmp_path):
    path, index, events = str(dump[0] / "cut.xml.bz2"), str(tmp_path / "index"), str(tmp_path / "events")
    half = blocks.where("block_no < 6")
    index_blocks(spark, half, path, index, events)
    first = I.read_index(spark, index).count()
    assert 0 < first < 120
    for _ in range(2):
        index_blocks(spark, blocks, path, index, events)
        assert I.read_index(spark, index).count() == I.read_index(spark, index).select("title").distinct().count() == 120
    now = states.catalog(B.as_catalog(blocks), events)
    assert I.is_complete(now).first()[0] and {r.index_state for r in now.collect()} == {FINISHED}


def test_index_of_many_runs(spark, dump, blocks, tmp_path):
    """A run for each block, the last ones first, with states that are merged on the way, and two runs broken off between titles and states: the index is that of one run."""
    path, index, home = str(dump[0] / "cut.xml.bz2"), str(tmp_path / "index"), str(tmp_path / "states")
    numbers = sorted((r.block_no for r in blocks.collect()), reverse=True)
    for i in range(0, len(numbers), 4):
        some = blocks.where(F.col("block_no").isin(numbers[i : i + 4]))
        if i in (0, 8):
            I.first_wins(B.titles_only(B.block_titles(some, path))).write.mode("append").parquet(index)  # and no states
        index_blocks(spark, some, path, index, home, most_deltas=1)
    version, merged, deltas = states.opened(spark, home)
    assert version and merged and len(deltas) <= 1
    assert I.read_index(spark, index).count() > 120
    want = I.first_wins(B.titles_only(B.block_titles(blocks, path))).collect()
    assert Counter(map(tuple, I.first_titles(spark, index).collect())) == Counter(map(tuple, want)) and len(want) == 120
    assert I.is_complete(states.catalog(B.as_catalog(blocks), home)).first()[0]
    assert I.first_titles(spark, str(tmp_path / "none")).count() == 0


def test_stream(spark, dump, tmp_path):
    folder, index, state = tmp_path / "in", str(tmp_path / "index"), str(tmp_path / "state")
    folder.mkdir()
    (folder / "a.bz2").write_bytes(dump[2])
    run = lambda: index_stream(spark, str(folder), index, state).awaitTermination()
    told = []
    listener = Progress(lambda *x: told.append(x))
    spark.streams.addListener(listener)
    run()
    assert I.read_index(spark, index).count() == 120
    for _ in range(100):
        if told:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert sum(rows for _, rows, _ in told) > 0
    run()
    (folder / "b.bz2").write_bytes(bz2.compress(b"<page><title>Page &amp; 007 \xc3\xa9</title></page><page><title>New</title></page>"))
    run()
    found = I.first_titles(spark, index)
    assert found.count() == 121 and I.read_index(spark, index).count() == 122
    fetched = {r.title: r.value for r in B.fetch_markup(found, str(folder)).collect()}
    assert len(fetched) == 121 and all(f"<title>{t.replace('&', '&amp;')}</title>" in v for t, v in fetched.items())


def test_stopped_stream_goes_on(spark, dump, tmp_path):
    """A query that is stopped between batches has committed whole batches, and another run adds the rest."""
    folder, index, state = tmp_path / "in", str(tmp_path / "index"), str(tmp_path / "state")
    folder.mkdir()
    for i in range(6):
        (folder / f"{i}.bz2").write_bytes(bz2.compress(b"".join(b"<page><title>T%d.%d</title></page>" % (i, j) for j in range(5))))
    query = index_stream(spark, str(folder), index, state, 1)
    while query.isActive and not table_or_none(spark, index, TITLES).count():
        time.sleep(0.05)
    query.stop()
    assert table_or_none(spark, index, TITLES).count() % 5 == 0
    index_stream(spark, str(folder), index, state, 1).awaitTermination()
    assert I.read_index(spark, index).select("title").distinct().count() == I.read_index(spark, index).count() == 30


def test_parts(spark, dump):
    listed = parts.list_parts(spark, str(dump[0]), "cut.xml.bz2")
    assert tuple(parts.parts_summary(listed).first()) == (len(dump[2]), 3)
    assert parts.last_part(listed).first().path.endswith(".2")
    whole = parts.ByteParts(str(dump[0] / "cut.xml.bz2"))
    assert whole.read(100, len(dump[2]) - 5) == dump[2][100:-5]
    made = spark.createDataFrame([("x.9", 9), ("x.10", 10)], "path string, part int")
    assert parts.last_part(made).first().path == "x.10"


def test_records(spark, tmp_path):
    rows = [(0, 32, 0), (1, 685112494, 1), (2, 1 << 40, 2)]
    made = records.to_records(spark.createDataFrame(rows, BLOCKS))
    assert sorted(map(tuple, records.from_records(made).collect())) == rows
    (tmp_path / "r.bin").write_bytes(b"".join(bytes(r.record) for r in sorted(made.collect())) + b"xx")
    (tmp_path / "empty.bin").write_bytes(b"")
    assert sorted(map(tuple, records.read_record_files(spark, str(tmp_path)).collect())) == rows
    assert list(map(tuple, records.last_record(spark, str(tmp_path)).collect())) == [rows[-1]]


def test_page_cases(spark):
    rows = [
        "<page><title>A</title><id>1</id><revision><id>2</id><text/></revision></page>",
        "<page><title>B</title><id>2</id><revision><id>3</id><comment /><text>x</text></revision><revision><id>4</id><text>&lt;page&gt; &#39;</text></revision></page>",
        "<page><title>\U0001f600</title></page>",
        "<page><id>5</id></page>",
        "<page><title>broken</title><id>6</id><rev></page>",
        "no page",
    ]
    df = spark.createDataFrame([(r.removesuffix("</page>"),) for r in rows], "value string")
    got = {r.title: (r.id, r.rev_id, r.comment, r.text) for r in parse_pages(df).collect()}
    assert got["A"] == (1, 2, None, "") and got["B"] == (2, 4, "", "<page> '") and got["\U0001f600"] == (None, None, None, None)
    assert len(got) == 3 and broken_pages(df).count() == 2


def test_index_rules(spark, tmp_path):
    rows = [(9, 0, "x"), (5, 7, "x"), (5, 3, "x"), (1, 1, "a%b"), (1, 2, "a_b"), (1, 3, "a\\b"), (1, 4, "t" * 4096), (1, 5, "t" * 4097)]
    rows += [(2, i, t) for i, t in enumerate(["Zebra", "apple", "Äpfel", "\uf600", "\U0001f600"])]
    index = I.first_wins(spark.createDataFrame(rows, TITLES))
    got = {r.title: (r.block_start_bits, r.title_start_pos) for r in index.collect()}
    assert got["x"] == (5, 3) and len(got) == 10 and "t" * 4097 not in got
    I.write_index(index, str(tmp_path / "i"), 3)
    index = I.read_index(spark, str(tmp_path / "i"))
    assert [r.title for r in S.seek(index, "Z", 0).collect()] == ["Zebra", "a%b", "a\\b", "a_b", "apple", "t" * 4096, "x", "Äpfel", "\uf600", "\U0001f600"]
    assert [r.title for r in S.seek_like(index, "a\\_").collect()] == ["a\\b"]
    assert [r.title for r in S.seek_like(index, "a!_b", escape="!").collect()] == ["a_b"]
    assert [r.title for r in S.seek_regexp(index, "a.b").collect()] == ["a%b", "a\\b", "a_b"]
    assert S.lookup(index, "nope").count() == 0 and tuple(S.lookup(index, "x").first()) == (5, 3)
    assert "GreaterThanOrEqual(title,Z)" in S.seek(index, "Z")._jdf.queryExecution().toString()


def test_seek_skips_row_groups(spark, tmp_path):
    """A seek and a lookup on the sorted index read only the row groups that may hold their titles."""
    rows = spark.range(200_000).select(F.col("id").alias("block_start_bits"), F.lit(0).cast("bigint").alias("title_start_pos"), F.format_string("t%06d", "id").alias("title"))
    I.write_index(rows, str(tmp_path / "i"), 8)
    index = I.read_index(spark, str(tmp_path / "i"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for found, want in ((S.seek(index, "t199990", 0), 10), (S.lookup(index, "t012345"), 1), (S.lookup(index, index.agg(F.max("title")).scalar()), 1)):
            assert found.count() == want and len(found.collect()) == want
            plan = found._jdf.queryExecution().executedPlan()
            scan = plan.collectLeaves().head()
            assert "PushedFilters: [IsNotNull(title), " in plan.toString() or "ScalarSubquery" in plan.toString() or "scalar-subquery" in plan.toString()
            found._jdf.queryExecution().executedPlan().executeCollectPublic()
            assert scan.metrics().apply("numOutputRows").value() <= 3 * 25_000 + 1000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_numbered_parts(spark, tmp_path):
    rows = [(0, 1, b"a"), (10, 3, b"\xff\n"), (10, 2, b"\r\n"), (9, 0, b"d"), (10, 5, None)]
    binarysink.write_parts(spark.createDataFrame(rows, "part int, at bigint, content binary"), str(tmp_path), "x")
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == {"x.0": b"a", "x.9": b"d", "x.10": b"\r\n\xff\n"}
    for left in (9, 0, None):
        parts.drop_last_part(spark, str(tmp_path), "x")
        assert parts.last_part(parts.list_parts(spark, str(tmp_path), "x")).first().part == left
    parts.drop_last_part(spark, str(tmp_path), "x")


def test_scan_in_slices(spark, dump, tmp_path):
    """R2: a scan that is broken off goes on from the last block of the catalog."""
    path, home = str(dump[0] / "cut.xml.bz2"), str(tmp_path / "home")
    stages.scan(spark, path, home, 200_000, most_scans=2)
    some = table_or_none(spark, f"{home}/blocks", BLOCKS).count()
    stages.scan(spark, path, home, 200_000)
    got = table_or_none(spark, f"{home}/blocks", BLOCKS).orderBy("block_no").collect()
    assert 0 < some < len(got) and got == B.as_catalog(B.find_blocks(spark, path)).orderBy("block_no").collect()


def test_routes():
    assert S.routed("###Foo", "console") == ("seek", "Foo", 20) and S.routed("Foo", "console") == ("fetch", "Foo", 1)
    assert S.routed("", "search")[0] == S.routed(None, "search")[0] == "nothing"
    assert S.routed("Fo%", "search") == ("like", "Fo%", 50) and S.routed("Fo", "search") == ("seek", "Fo", 50)


def test_states(spark):
    blocks = spark.createDataFrame([(0, 32, None), (1, 99, 1), (2, 150, 0)], "block_no bigint, block_start_bits bigint, index_state int")
    assert sorted(r.block_no for r in I.pending(blocks).collect()) == [0, 2]
    assert {r.block_no: r.index_state for r in I.mark_finished(blocks, 2).collect()} == {0: None, 1: 1, 2: 2}
    assert I.latest_block(blocks).first().block_no == 2 and I.latest_block(blocks.limit(0)).count() == 0
    assert I.is_complete(blocks.limit(0)).first()[0] is False
    assert [r.block_no for r in I.blocks_from(blocks, 99).collect()] == [1, 2]


def test_create_table(spark):
    create_table(spark, "catalog_blocks", BLOCKS)
    create_table(spark, "catalog_blocks", BLOCKS)
    spark.createDataFrame([(0, 32, 0)], BLOCKS).write.mode("append").insertInto("catalog_blocks")
    assert spark.table("catalog_blocks").select(F.max("block_no")).first()[0] == 0


def test_staged_build(spark, dump, tmp_path):
    path, home = str(dump[0] / "cut.xml.bz2"), str(tmp_path / "home")
    with pytest.raises(ValueError, match="bytes"):
        stages.build(spark, path, home, expected_bytes=5)
    part = stages.build(spark, path, home, len(dump[2]), most_blocks=4).first()
    assert not part.complete and 0 < part.titles < 120
    for _ in range(2):
        whole = stages.build(spark, path, home).first()
        assert whole.complete and whole.titles == 120 and whole.blocks == stages.catalog(spark, home).count() > 10
    stages.publish(spark, home, 4)
    assert [r.title for r in TitleIndex(spark, home).seek("Page & 118").collect()] == ["Page & 118 é", "Page & 119 é"]
    with pytest.raises(ValueError, match="changed"):
        stages.build(spark, str(dump[0] / "whole.xml.bz2"), home)


def test_properties(spark, tmp_path):
    path = str(tmp_path / "p")
    assert {tuple(r) for r in stages.properties(spark, path, {"a": "1"}).collect()} == {("a", "1")}
    stages.set_property(spark, path, "a", "2")
    stages.set_property(spark, path, "a", "3")
    stages.set_property(spark, path, "b", "4")
    assert {tuple(r) for r in stages.properties(spark, path, {"a": "1", "c": "5"}).collect()} == {("a", "3"), ("b", "4"), ("c", "5")}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=8), st.integers(0, 60), st.integers(0, 60))
def test_files_of_a_range(sizes, start, stop):
    """The files about a range are those that hold bytes of it, empty ones left aside, and the range's bytes are read from them alone."""
    whole = parts.ByteParts("/", [(str(i), n) for i, n in enumerate(sizes)])
    files, first = whole.about(start, stop)
    held = [str(i) for i, n in enumerate(sizes) if n and sum(sizes[:i]) < stop and sum(sizes[: i + 1]) > start and start < stop]
    assert [p for p, n in files if n] == held and whole.size == sum(sizes)
    assert not held or first == sum(sizes[: int(files[0][0])])
