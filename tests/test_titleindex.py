"""The published title index: patterns by trigrams, seeks by zones, versions; each against a full scan."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexshelf.functions import patterns
from lexshelf.operators import search as S
from lexshelf.operators.titleindex import PAGE_ROWS, TitleIndex, publish
from lexshelf.schemas import TITLES
from lexshelf.sources import snapshots

ZONE = 500
#: Three posting lists, each in up to three pages; there are 160,000 postings.
LISTS = 9 * PAGE_ROWS
LETTERS = st.text("ab%_!.|é\x02\x03\U0001f600", max_size=8)


def grams(title: str) -> set[str]:
    padded = patterns.START + title + patterns.END
    return {padded[i : i + 3] for i in range(len(padded) - 2)}


def agrees(runs: list[patterns.Run], title: str) -> bool:
    low, high = patterns.prefix_range(runs)
    return patterns.grams_of(runs) <= grams(title) and low <= title and (high is None or title < high)


@given(LETTERS, LETTERS, st.sampled_from([None, "!"]))
@settings(max_examples=400, deadline=None)
def test_like_needs_what_its_runs_say(pattern, title, escape):
    out, i = "", 0
    while i < len(pattern):
        if pattern[i] == escape and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += {"%": ".*", "_": "."}.get(pattern[i], re.escape(pattern[i]))
        i += 1
    if re.fullmatch(out, title, re.DOTALL):
        assert agrees(patterns.like_runs(pattern, escape), title)


PIECES = st.sampled_from(["a", "b", "ab", ".", "a*", "b?", "a+", "(ab)?", "(a|b)", "[ab]", "[^a]", r"\.", "é", "a{2}", "b{0,2}?", "(?:ab)+", r"\d", r"\w", "a+?", "(a[)]b)", "[(]", r"\(", "^", "(?=a)", "a|b", "(b\\))*"])


@given(st.lists(PIECES, max_size=6), st.text("ab.é()1", max_size=7))
@settings(max_examples=800, deadline=None)
def test_regexp_needs_what_its_runs_say(pieces, title):
    pattern = "".join(pieces)
    if re.fullmatch(f"(?s:{pattern})", title):
        assert agrees(patterns.regexp_runs(pattern), title)


def test_runs():
    run = patterns.Run
    assert patterns.like_runs("ab%c_d") == [run("ab", True, False), run("c", False, False), run("d", False, True)]
    assert patterns.regexp_runs(r"abc+d?ef\.g(x|y)*zz") == [run("abc", True, False), run("ef.g", False, False), run("zz", False, True)]
    assert patterns.regexp_runs(r"(?s)\QA.B\E.*x{2}yy") == [run("A.B", True, False), run("yy", False, True)]
    for unknown in ("a|b", "(?i)abc", r"\x41bc", r"abc(\Q)\E", "abc[]a]", "(abc", r"\p{L}abc", "abc{"):
        assert patterns.regexp_runs(unknown) == []
    assert patterns.prefix_range([run("a\U0010ffff", True, False)]) == ("a\U0010ffff", "b") and patterns.prefix_range([run("\U0010ffff", True, False)])[1] is None
    assert patterns.prefix_range([run("퟿", True, False)]) == ("퟿", "") and patterns.prefix_range([run("x", False, False)]) == ("", None)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    """20,000 titles in 40 zones: some hold a rare word, all a common one."""
    home = str(tmp_path_factory.mktemp("index"))
    n = F.col("id")
    title = F.concat(F.format_string("t%05d", n), F.when(n % 4999 == 7, F.lit(" rarity")).otherwise(F.lit(" the")), F.when(n % 5000 == 3, F.lit(" 100%_x!\\")).otherwise(F.lit("")))
    rows = spark.range(20_000).select(n.alias("block_start_bits"), F.lit(5).cast("bigint").alias("title_start_pos"), title.alias("title"))
    rows = rows.unionByName(spark.createDataFrame([(0, 0, t) for t in ("", "a", "é", "\U0001f600\U0001f600", "", "zz\x02\x03", "x" * 4096)], TITLES))
    publish(rows, home, 4, ZONE, 20_000)
    return TitleIndex(spark, home)


def rows_read(spark, frame) -> int:
    """Rows that a frame's scans give, when it is run."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frame = frame.select("*")
        plan = frame._jdf.queryExecution().executedPlan()
        plan.executeCollectPublic()
        leaves, total = plan.collectLeaves().iterator(), 0
        while leaves.hasNext():
            metrics = leaves.next().metrics()
            total += metrics.apply("numOutputRows").value() if metrics.contains("numOutputRows") else 0
        return total
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize(
    ("pattern", "most", "read"),
    [
        ("%rarity%", 50, LISTS), ("%rarity", 0, LISTS), ("%9999 the%", 50, LISTS), ("t0123%", 50, 2 * ZONE), ("t0000%rar%", 50, LISTS), ("%zzz%", 50, 0), ("%the%", 50, 2 * ZONE), ("%e%", 50, 2 * ZONE),
        ("", 50, ZONE), ("%", 5, ZONE), ("é", 50, 2 * ZONE), ("_", 50, None), ("%\\", 50, None), ("%0!%!_x!!%", 50, LISTS), ("\U0001f600%", 50, 2 * ZONE), ("zz%", 50, 2 * ZONE), ("%\x03", 50, None), ("%xxxxx%", 0, LISTS),
    ],
)
def test_like(spark, index, pattern, most, read):
    escape = "!" if "!" in pattern else None
    got, want = index.like(pattern, most, escape), S.seek_like(index.rows, pattern, most, escape)
    assert [r.title for r in got.collect()] == [r.title for r in want.collect()]
    assert read is None or rows_read(spark, got) <= read


@pytest.mark.parametrize(
    ("pattern", "most", "read"),
    [
        (".*rarity", 50, LISTS), (r"t0.*\d rar[a-z]ty", 50, LISTS), ("t1999[0-9] the", 50, 2 * ZONE), (".*(rarity|nothing)", 3, None), ("t.*", 20, 2 * ZONE), (".*nothing.*", 50, 0), ("(?i)T00007 RARITY", 50, None),
        (r".*\Q100%_\E.*", 50, LISTS), ("a|é", 50, None), ("(?s).*", 0, None),
    ],
)
def test_regexp(spark, index, pattern, most, read):
    got, want = index.regexp(pattern, most), S.seek_regexp(index.rows, pattern, most)
    assert [r.title for r in got.collect()] == [r.title for r in want.collect()]
    assert read is None or rows_read(spark, got) <= read


@pytest.mark.parametrize(("key", "most"), [("", 50), ("A", 50), ("t00499 the", 3), ("t00499 the", 700), ("t19990", 50), ("\U0001f600", 50), ("\U0010ffff", 50), ("t1", 0), ("t0", 12_000)])
def test_seek(spark, index, key, most):
    got, want = index.seek(key, most), S.seek(index.rows, key, most)
    assert [r.title for r in got.collect()] == [r.title for r in want.collect()]
    if 0 < most <= 700:
        assert rows_read(spark, got) <= most + 2 * ZONE


def test_lookup(spark, index):
    for title in ("t00007 rarity", "", "t1", "nope", "\U0001f600\U0001f600"):
        got = index.lookup(title)
        assert got.collect() == S.lookup(index.rows, title).collect()
        assert rows_read(spark, got) <= ZONE
    assert index.search(index.rows, None).collect() == [] and index.search(index.rows, "t0000%").count() == 10
    assert index.search(index.rows, "###t1", "console").count() == 20 and index.search(index.rows, "a", "console").count() == 1


def test_versions(spark, tmp_path):
    """Frames of one version answer after the next is published; two publishers at once give two whole versions; old ones go when asked."""
    home = str(tmp_path / "home")
    made = lambda word, n: spark.range(n).select(F.col("id").alias("block_start_bits"), F.lit(0).cast("bigint").alias("title_start_pos"), F.format_string(word + "%03d", "id").alias("title"))
    with pytest.raises(ValueError, match="nothing"):
        TitleIndex(spark, home)
    publish(made("old", 30), home)
    old = TitleIndex(spark, home)
    seek, like = old.seek("", 5), old.like("%ld02%")
    with ThreadPoolExecutor(3) as pool:
        versions = list(pool.map(lambda x: publish(made(*x), home), [("one", 10), ("two", 20), ("six", 25)]))
    assert len(set(versions)) == 3 and set(snapshots.history(spark, home)[:3]) == set(versions)
    new = TitleIndex(spark, home)
    words = {r.title[:3] for r in new.rows.collect()}
    assert len(words) == 1 and new.rows.count() == {"one": 10, "two": 20, "six": 25}[words.pop()] and new.seek("", 0).count() == new.zones.agg(F.sum("n")).first()[0]
    assert [r.title for r in seek.collect()] == [f"old{i:03d}" for i in range(5)] and like.count() == 10
    assert snapshots.vacuum(spark, home, keep=4, least_age=0) == [] == snapshots.vacuum(spark, home, keep=1, least_age=3600)
    assert len(snapshots.vacuum(spark, home, keep=1, least_age=0)) == 3 and snapshots.history(spark, home) == [new.version]
    assert new.rows.count() == new.seek("", 0).count()


def test_empty_index(spark, tmp_path):
    publish(spark.createDataFrame([], TITLES), str(tmp_path))
    index = TitleIndex(spark, str(tmp_path))
    assert index.seek("").collect() == index.like("%a%").collect() == index.like("%abcd%").collect() == index.regexp("ab.*").collect() == index.lookup("x").collect() == []
