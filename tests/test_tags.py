"""The tag automaton over chunks that are read alone, against one that reads all bytes in order."""

from __future__ import annotations

import bz2
import json
import random

import pytest

from lexshelf.operators import blocks as B
from lexshelf.operators import tags as T


def plain(data: bytes) -> list[tuple]:
    """(kind, name, depth, page_pos, pos, stop, value) of each event, one byte at a time; values are bytes."""
    out, stack, synced, state = [], [], False, "text"
    pos = start = page = None
    name, attr, text, value = b"", b"", b"", b""
    for i in range(len(data)):
        c = data[i : i + 1]
        if state == "text":
            if c == b"<":
                state, pos, name, attr, bare = "begun", i, b"", b"", True
            else:
                text += c
        elif state == "begun" and c == b"/":
            state = "close"
        elif state == "value":
            if c == b'"':
                if synced:
                    out.append(("attribute", attr.strip(b" \t\r\n="), len(stack), page, start, i, value))
                state, attr = "attrs", b""
            else:
                value += c
        elif c == b">" and state != "text":
            kind = {"begun": "start", "name": "start", "attrs": "start"}.get(state, state)
            want, alone = None, state in ("begun", "name")
            if kind == "start":
                if not synced and alone and name == b"page":
                    synced, stack = True, []
                if synced:
                    stack.append(name)
                    if alone and stack == [b"page"]:
                        page = pos
            elif kind == "close" and synced:
                want = text if stack == [b"page", b"title"] else None
                stack = stack[:-1]
            if synced:
                out.append((kind, name, len(stack), page, pos, i + 1, want))
            state, text = "text", b""
        elif state == "close":
            name += c
        elif state in ("begun", "name"):
            if c == b"/":
                state = "single"
            elif c in b" \t\r\n":
                state = "attrs"
            else:
                state, name = "name", name + c
        elif state == "attrs":
            if c == b'"':
                state, start, value = "value", i + 1, b""
            elif c == b"/":
                state = "single"
            else:
                attr += c
        elif state == "single" and c == b'"':
            state, attr = "attrs", b""
    return out


def in_chunks(chunks: list[bytes]) -> list[tuple]:
    """The events of chunks, by the composed summaries, without Spark."""
    before, whole = [], T.IDENTITY
    sums = [T.summary(c) for c in chunks]
    for s, _ in sums:
        before.append(whole)
        whole = T.compose_states(whole, s)
    exact = [T.effects(b, a) for b, (_, a) in zip(before, sums, strict=True)]
    stacks, now = [], json.dumps([T.NOTHING, None])
    for e in exact:
        stacks.append(now)
        now = T.compose_effects(now, e)
    events, pieces = [], {}
    for c, b, s in zip(chunks, before, stacks, strict=True):
        for kind, name, depth, page, pos, stop, span, value in T.chunk_events(c, b, s, T.TITLE):
            if kind == "piece":
                pieces[span] = pieces.get(span, b"") + value
            else:
                events.append((kind, name, depth, page, pos, stop, span, value))
    return [(k, n.encode(), d, g, p, e, v if span is None else pieces[span]) for k, n, d, g, p, e, span, v in events]


def cut(data: bytes, rng: random.Random, most: int) -> list[bytes]:
    at, out = 0, []
    while at < len(data):
        n = rng.randrange(0, most + 1)
        out.append(data[at : at + n])
        at += n
    return out or [b""]


TOKENS = ["<page>", "</page>", "<title>", "</title>", "<", ">", "/", '"', " ", "=", "a", "é", "<b>", "</b>", '<c d="e f" g="1>2">', "<s />", "<page x=\"y\">", "<br/>", "\n", "<revision><id>", "</id></revision>"]


def test_any_cuts():
    rng = random.Random(5)
    seen = 0
    for _ in range(300):
        data = "".join(rng.choice(TOKENS) for _ in range(rng.randrange(0, 60))).encode()
        want = plain(data)
        seen += len(want)
        assert in_chunks(cut(data, rng, rng.choice([1, 2, 5, 30]))) == want
    assert seen > 1000


def test_composition_is_associative():
    rng = random.Random(6)
    for _ in range(100):
        a, b, c = ("".join(rng.choice(TOKENS) for _ in range(rng.randrange(0, 14))).encode() for _ in range(3))
        x, y, z = (T.summary(d)[0] for d in (a, b, c))
        assert T.compose_states(T.compose_states(x, y), z) == T.compose_states(x, T.compose_states(y, z))
        e = [T.effects(T.IDENTITY, T.summary(d)[1]) for d in (a, b, c)]
        assert T.compose_effects(T.compose_effects(e[0], e[1]), e[2]) == T.compose_effects(e[0], T.compose_effects(e[1], e[2]))


def test_deep_elements_are_counted():
    data = b"<page>" + b"<a>" * 30 + b"</a>" * 30 + b"<title>t</title></page>"
    rng = random.Random(7)
    assert in_chunks(cut(data, rng, 9)) == plain(data)
    assert [e[6] for e in plain(data) if e[6]] == [b"t"]


def collected(events) -> list[tuple]:
    return sorted(((r.kind, r.name, r.depth, r.page_pos, r.pos, r.stop, r.value) for r in events.collect()), key=repr)


def wanted(data: bytes) -> list[tuple]:
    rows = [(k, n.decode(), d, g, p, e, None if v is None else v.decode().replace("&lt;", "<").replace("&amp;", "&")) for k, n, d, g, p, e, v in plain(data)]
    return sorted(rows, key=repr)


def test_streams_of_chunks(spark):
    """Streams of very unlike lengths, cut anywhere, scanned in groups of four: several levels."""
    rng = random.Random(8)
    texts = {s: "".join(rng.choice([t for t in TOKENS if t != "é"]) + rng.choice(["", "é&lt;"]) for _ in range(n)).encode() for s, n in ((0, 250), (3, 0), (9, 40), (12, 1))}
    texts[7] = b"<page><title>" + b"long " * 40 + b"</title></page>"
    rows = [(s, i, bytearray(c) if c else None) for s, d in texts.items() for i, c in enumerate(cut(d, rng, 12))]
    rng.shuffle(rows)
    chunks = spark.createDataFrame(rows, "stream bigint, chunk bigint, content binary")
    got = T.tag_events(chunks, group=4).cache()
    for s, d in texts.items():
        assert collected(got.where(f"stream = {s}")) == wanted(d)
    assert [r.title for r in T.title_events(got.where("stream = 7")).collect()] == ["long " * 40]
    assert T.tag_events(chunks.limit(0)).count() == 0


@pytest.fixture(scope="module")
def dump(tmp_path_factory):
    rng = random.Random(9)
    body = lambda: "".join(rng.choice("abcdefghij klmnop\n") for _ in range(rng.randrange(100, 40_000)))
    xml = '<dump version="1">\n' + "".join(f'<page>\n <title>T &amp; {i}</title>\n <redirect title="R{i} {"x" * 300}" />\n <text bytes="{i}">{body()}</text>\n</page>\n' for i in range(90)) + "</dump>\n"
    path = tmp_path_factory.mktemp("tags") / "d.xml.bz2"
    path.write_bytes(bz2.compress(xml.encode(), 1))
    return str(path), xml.encode()


def test_dump_whose_tags_straddle_blocks(spark, dump):
    path, xml = dump
    blocks = B.find_blocks(spark, path)
    n = blocks.count()
    assert n > 10
    got = T.dump_events(blocks, path, group=5).cache()
    assert collected(got) == wanted(xml)
    assert got.select("chunk").distinct().count() > 10
    assert {r.page_pos for r in T.page_starts(got).collect()} == {i for i in range(len(xml)) if xml.startswith(b"<page>", i)}
    assert T.child_closes(got).where("name = 'title'").count() == T.title_events(got).count() == 90


def test_a_block_that_cannot_be_read(spark, dump, tmp_path):
    """It counts as empty and gives a fault; the automaton goes on after it."""
    data = bytearray(open(dump[0], "rb").read())
    start = sorted(r.block_start_bits for r in B.find_blocks(spark, dump[0]).collect())[2] // 8
    data[start + 60] ^= 255
    (tmp_path / "bad.bz2").write_bytes(data)
    blocks = B.find_blocks(spark, str(tmp_path / "bad.bz2"))
    got = T.dump_events(blocks, str(tmp_path / "bad.bz2")).cache()
    assert [r.chunk for r in got.where("kind = 'fault'").collect()] == [2]
    assert got.where("chunk > 3 and kind = 'attribute'").count() > 0


def test_names_of_any_length_and_clashing_columns(spark):
    data = b"<page><" + b"n" * 1000 + b"><title>t</title></page>"
    rows = [(1, i, bytearray(data[i * 100 : i * 100 + 100])) for i in range(12)]
    got = T.tag_events(spark.createDataFrame(rows, "stream bigint, chunk bigint, before binary"))
    assert {(r.kind, len(r.name)) for r in got.collect()} == {("start", 4), ("start", 256), ("start", 5), ("close", 5), ("close", 4)}
