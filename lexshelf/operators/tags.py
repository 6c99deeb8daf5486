"""The tag automaton in parallel (X2-X4, X7, X9): events of start, close, single and attribute with byte positions, from chunks that are read alone.

A chunk does not know in which state it begins. It is therefore run from every state, and what each run comes to (the last state, and what it has of an
unfinished tag) is composed over the chunks by a prefix scan. With the names that run over its edges known, a chunk's effect on the stack of open elements
follows (so many are closed, then these are opened), and a second scan composes these. Then every chunk is read once more and gives its events.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexshelf.functions.text import decode_entities
from lexshelf.operators import blocks as B
from lexshelf.operators.scan import GROUP, frames, prefixes
from lexshelf.shared import settled
from lexshelf.sources.parts import ByteParts

#: States: character data, after ``<``, the name of an opening and of a closing tag, attributes, a value in quotes, after the slash of a single tag.
TEXT, BEGUN, NAME, CLOSE, ATTRS, VALUE, SINGLE = range(7)
#: What ends a state.
STOPS = [re.compile(p) for p in (b"<", b"(?s).", rb"[/ \t\r\n>]", b">", b'["/>]', b'"', b'[">]')]
#: Names of open elements that are known; deeper ones are counted. The element at which the automaton starts. Bytes that a name keeps.
DEPTH, ROOT, MOST_NAME = 8, "page", 256
#: Closes every element, however many there are.
ALL = 1 << 60
#: The path of the elements whose text is returned.
TITLE = ("page", "title")

Tag = dict[str, Any]


def fresh() -> Tag:
    """What a run knows at a chunk's start: names go on from before, positions are those from before (None)."""
    return {"pos": None, "name": [True, ""], "attr": [True, ""], "value": None, "text": None}


def walk(data: bytes, state: int, at: Tag) -> Iterator[tuple[str, int]]:
    """(kind, position after it) of each tag and attribute that ends in data; at holds what is known of it, and in the end what is known of the unfinished one.

    Kinds: bare (opens, without attributes), start (opens, with some), close, single, attribute; last comes ("", state at the end).
    """
    i, n = 0, len(data)

    def more(key: str, a: int, b: int) -> None:
        piece = data[a:b].decode("latin-1")
        at[key][1] = (at[key][1] + piece)[-MOST_NAME:] if key == "attr" else (at[key][1] + piece)[:MOST_NAME]

    while i < n:
        found = STOPS[state].search(data, i)
        stop = found.start() if found else n
        if state in (NAME, CLOSE):
            more("name", i, stop)
        elif state == ATTRS:
            more("attr", i, stop)
        if not found:
            break
        byte, i = data[stop : stop + 1], stop + 1
        if state == TEXT:
            state = BEGUN
            at.update(pos=stop, name=[False, ""], attr=[False, ""], value=None)
        elif state == BEGUN:
            state, i = (CLOSE, i) if byte == b"/" else (NAME, stop)
        elif byte == b'"':
            if state == ATTRS:
                state = VALUE
                at["value"] = i
            else:
                if state == VALUE:
                    yield "attribute", stop
                state = ATTRS
                at.update(attr=[False, ""], value=None)
        elif byte == b">":
            yield {NAME: "bare", CLOSE: "close", ATTRS: "start", SINGLE: "single"}[state], i
            state = TEXT
            at.update(pos=None, name=[False, ""], attr=[False, ""], value=None, text=i)
        elif byte == b"/":
            state = SINGLE
        else:
            state = ATTRS
    yield "", state


def joined(a: Tag, b: Tag, shift: int) -> Tag:
    """What is known after two neighbours; shift is the first one's length."""
    out: Tag = {k: a[k] if b[k] is None else b[k] + shift for k in ("pos", "value", "text")}
    for k, cut in (("name", slice(MOST_NAME)), ("attr", slice(-MOST_NAME, None))):
        out[k] = [a[k][0], (a[k][1] + b[k][1])[cut]] if b[k][0] else b[k]
    return out


IDENTITY = json.dumps({"n": 0, "to": [[q, fresh()] for q in range(7)]})


def compose_states(a: str, b: str) -> str:
    """Lengths, and for each first state the last one and what is known there."""
    x, y = json.loads(a), json.loads(b)
    to = []
    for end, known in x["to"]:
        last, later = y["to"][end]
        to.append([last, joined(known, later, x["n"])])
    return json.dumps({"n": x["n"] + y["n"], "to": to})


def step(effect: list | None, kind: str, name: str, pos: int | None, synced: bool = True) -> list | None:
    """The effect (closed, opened, names of the first of these, closed before the last page began, its position) with one more tag.

    Without synced, there is none before the first bare page, which then is the only open element.
    """
    if effect is None and not synced:
        return [ALL, 1, [ROOT], ALL, pos] if kind == "bare" and name == ROOT else None
    closed, opened, names, at_closed, at = effect
    if kind in ("bare", "start"):
        names = [*names, name] if opened < DEPTH else names
        opened += 1
        if kind == "bare" and name == ROOT and opened == 1:
            at_closed, at = closed, pos
    elif kind == "close":
        closed, opened = (closed, opened - 1) if opened else (closed + 1, 0)
        names = names[:opened]
    return [closed, opened, names, at_closed, at]


NOTHING: list = [0, 0, [], -1, None]


def then(a: list, b: list) -> list:
    """Two effects after each other. A page that b begins is an outermost one only if all that a opened is closed by then."""
    left = a[1] - b[0]
    at = [min(ALL, a[0] + b[3] - a[1]), b[4]] if b[4] is not None and b[3] >= a[1] else a[3:]
    if left >= 0:
        return [a[0], left + b[1], (a[2][:left] + b[2])[:DEPTH] if left < DEPTH else a[2], *at]
    return [min(ALL, a[0] - left), b[1], b[2], *at]


def compose_effects(a: str, b: str) -> str:
    """Pairs of effects: on a stack that is in step with the pages, and before the first page."""
    (s, u), (t, v) = json.loads(a), json.loads(b)
    return json.dumps([then(s, t), v if u is None else then(u, t)])


def summary(data: bytes) -> tuple[str, str]:
    """A chunk's runs from each state, for the first scan; and for the second, the first tag of each and the effects of those after it."""
    to, after = [], []
    for q in range(7):
        at, first, s, u, state = fresh(), None, NOTHING, None, q
        for kind, stop in walk(data, q, at):
            if not kind:
                state = stop
            elif kind != "attribute":
                if first is None:
                    first = [kind, at["pos"], list(at["name"])]
                else:
                    s, u = step(s, kind, at["name"][1], at["pos"]), step(u, kind, at["name"][1], at["pos"], False)
        to.append([state, at])
        after.append([first, s, u])
    return json.dumps({"n": len(data), "to": to}), json.dumps(after)


def effects(before: str, after: str) -> str:
    """A chunk's effects, now that its first state and the tag that runs into it are known. Positions become those in the stream."""
    known = json.loads(before)
    base, (state, at) = known["n"], known["to"][TEXT]
    first, s, u = json.loads(after)[state]
    s, u = ([*e[:4], None if e[4] is None else e[4] + base] if e else e for e in (s, u))
    if first:
        kind, pos, (goes_on, name) = first
        name, pos = (at["name"][1] + name)[:MOST_NAME] if goes_on else name, at["pos"] if pos is None else pos + base
        one, alone = step(NOTHING, kind, name, pos), step(None, kind, name, pos, False)
        s, u = then(one, s), then(alone, s) if alone else u
    return json.dumps([s, u])


#: A row is an event, or with kind "piece" a piece of a value that runs over an edge; span is where such a value begins.
RAW = "stream bigint, chunk bigint, kind string, name string, depth bigint, page_pos bigint, pos bigint, stop bigint, span bigint, value binary"


def chunk_events(data: bytes, before: str, stack: str, text_of: tuple[str, ...]) -> Iterator[tuple]:
    """RAW's columns after chunk, for one chunk."""
    known, now = json.loads(before), json.loads(stack)[1]
    base, (state, carried) = known["n"], known["to"][TEXT]
    at, path = fresh(), list(text_of)

    def cut(start: int, stop: int) -> bytes:
        return data[max(start - base, 0) : max(stop - base, 0)]

    def spanned(head: tuple, start: int, stop: int) -> Iterator[tuple]:
        if start >= base:
            yield (*head, None, cut(start, stop))
        else:
            yield (*head, start, None)
            yield ("piece", None, None, None, None, None, start, cut(start, stop))

    for kind, stop in walk(data, state, at):
        here = joined(carried, at, base)
        name, pos = here["name"][1], here["pos"]
        shown = name.encode("latin-1").decode("utf-8", "replace")
        wanted = now is not None and now[1] == len(path) and now[2] == path and here["text"] is not None
        if not kind:
            end = base + len(data)
            if stop == VALUE and now is not None:
                yield ("piece", None, None, None, None, None, here["value"], cut(here["value"], end))
            if wanted:
                yield ("piece", None, None, None, None, None, here["text"], cut(here["text"], end if stop == TEXT else pos))
        elif kind == "attribute":
            if now is not None:
                attr = here["attr"][1].strip(" \t\r\n=").encode("latin-1").decode("utf-8", "replace")
                yield from spanned((kind, attr, now[1], now[4], here["value"], base + stop), here["value"], base + stop)
        else:
            now = step(now, kind, name, pos, False)
            if now is not None:
                head = ({"bare": "start"}.get(kind, kind), shown, now[1], now[4], pos, base + stop)
                if wanted and kind == "close":
                    yield from spanned(head, here["text"], pos)
                else:
                    yield (*head, None, None)


def tag_events(chunks: DataFrame, load: Callable[[Any], bytes] | None = None, text_of: tuple[str, ...] = TITLE, group: int = GROUP, tasks: int | None = None) -> DataFrame:
    """stream, chunk, kind, name, depth, page_pos, pos, stop, value of the tags and attributes of each stream, in any order.

    chunks: stream bigint, chunk bigint (its order), and content binary, or any column from which load, given its value, gets the bytes. A chunk
    may end anywhere, also inside a tag, a name or a character; it may be empty (null content is) and a stream may be one chunk or very many. tasks: how many
    read the chunks, where Spark, which sees only load's small arguments, would take too few.

    kind: start, close, single, attribute. pos and stop: bytes of the stream from ``<`` to after ``>``; of an attribute, its value between the quotes. depth:
    elements open after it. page_pos: where the page that was begun last at depth 1 has its ``<``. chunk: the one in which the event ends. value: an attribute's
    value, and of a close of an element with the path text_of, the text since the tag before; entities are decoded, null otherwise.

    Everything before a stream's first ``<page>`` without attributes is passed over, and that one has depth 1. A close at depth 0 changes nothing. Beyond eight
    elements, names are not compared with text_of. A slash after a name makes a single tag. Of a name that is longer than MOST_NAME bytes, these are kept. Values
    have double quotes. A tag or value without an end is no event. A chunk that load cannot read (OSError, ValueError, EOFError) counts as empty, and gives a
    row of kind fault with the reason for its name; a mark that stands inside a block by chance does so too.
    """
    field = [c for c in chunks.columns if c not in ("stream", "chunk")][0]
    chunks = chunks.select("stream", "chunk", F.col(field).alias("content"))
    deal = (lambda rows: rows.repartition(tasks)) if tasks else (lambda rows: rows)
    get = load or (lambda content: b"" if content is None else bytes(content))

    def read(value) -> tuple[bytes, str | None]:
        try:
            return get(value), None
        except (OSError, ValueError, EOFError) as e:
            return b"", str(e) or type(e).__name__

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [summary(read(v)[0]) for v in pdf["content"]]
            yield pd.DataFrame({"stream": pdf["stream"], "chunk": pdf["chunk"], "value": [a for a, _ in both], "after": [b for _, b in both]})

    def resolved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["stream", "chunk", "before"]].assign(value=[effects(b, a) for b, a in zip(pdf["before"], pdf["after"], strict=True)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for pdf in batches:
                for stream, chunk, value, before, stack in pdf[["stream", "chunk", "content", "before", "stack"]].itertuples(index=False, name=None):
                    data, fault = read(value)
                    for row in chunk_events(data, before, stack, text_of):
                        yield (stream, chunk, *row)
                    if fault:
                        at = json.loads(before)["n"]
                        yield (stream, chunk, "fault", fault, None, None, at, at, None, None)

        for made in frames(rows(), [c.split()[0] for c in RAW.split(", ")]):
            yield made.astype(dict.fromkeys(("depth", "page_pos", "pos", "stop", "span"), "Int64"))

    sums = settled(deal(chunks).mapInPandas(summed, "stream bigint, chunk bigint, value string, after string"))
    states = prefixes(sums.select("stream", "chunk", "value"), compose_states, IDENTITY, group)
    exact = settled(states.join(sums.select("stream", "chunk", "after"), ["stream", "chunk"]).mapInPandas(resolved, "stream bigint, chunk bigint, before string, value string"))
    stacks = prefixes(exact.select("stream", "chunk", "value"), compose_effects, json.dumps([NOTHING, None]), group)
    entries = exact.select("stream", "chunk", "before").join(stacks.withColumnRenamed("before", "stack"), ["stream", "chunk"])
    raw = settled(deal(chunks.join(entries, ["stream", "chunk"])).mapInPandas(run, RAW))

    pieces = raw.where("kind = 'piece'").groupBy("stream", "span").agg(F.array_sort(F.collect_list(F.struct("chunk", "value"))).alias("p"))
    pieces = pieces.select("stream", "span", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["value"])).alias("value"))
    straddling = raw.where("kind <> 'piece' and span is not null").drop("value").join(pieces, ["stream", "span"])
    every = raw.where("kind <> 'piece' and span is null").unionByName(straddling)
    return every.drop("span").withColumn("value", decode_entities(F.make_valid_utf8(F.col("value").cast("string"))))


def dump_events(blocks: DataFrame, path: str, text_of: tuple[str, ...] = TITLE, group: int = GROUP) -> DataFrame:
    """tag_events of a dump whose blocks (block_no, block_start_bits) are decoded one by one; chunk is the block's number, positions are those in the decoded dump."""
    kept: list[ByteParts] = []

    def load(start: int) -> bytes:
        if not kept:
            kept.append(ByteParts(path))  # one listing for each task
        return next(B.decode_on(kept[0], int(start)), (b"", []))[0]

    rows = settled(blocks.select(F.lit(0).cast("bigint").alias("stream"), F.col("block_no").alias("chunk"), "block_start_bits"))
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // B.TASK_BLOCKS))
    return tag_events(rows, load, text_of, group, tasks)


def page_starts(events: DataFrame) -> DataFrame:
    """stream, page_pos of every page that begins."""
    return events.where("kind = 'start' and depth = 1 and pos = page_pos").select("stream", "page_pos")


def child_closes(events: DataFrame) -> DataFrame:
    """stream, page_pos, name, stop: the closing tags that leave depth 1, by where they end."""
    return events.where("kind = 'close' and depth = 1").select("stream", "page_pos", "name", "stop")


def title_events(events: DataFrame) -> DataFrame:
    """stream, chunk, page_pos, title: the text of the elements that the events were asked for."""
    return events.where("kind = 'close' and value is not null").select("stream", "chunk", "page_pos", F.col("value").alias("title"))
