from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexshelf.functions import text as X

CASES = [
    ("&amp;", "&", "&"),
    ("&amp;lt;", "&lt;", "&lt;"),
    ("A &amp; B &amp; C", "A & B & C", "A & B &amp; C"),
    ("&amp;&amp;&amp;", "&&&", "&&amp;&"),
    ("&lt;b&gt;", "<b>", "<b&gt;"),
    ("&nbsp;", " ", " "),
    ("&copy; &#39;", "&copy; &#39;", "&copy; &#39;"),
    ("a;b & c", "a;b & c", "a;b & c"),
    ("", "", ""),
]


def test_entities(spark):
    df = spark.createDataFrame(CASES, "input string, expected string, compat string")
    got = df.select("*", X.decode_entities(F.col("input")).alias("a"), X.decode_entities_compat(F.col("input")).alias("b")).collect()
    assert all((r.a, r.b) == (r.expected, r.compat) for r in got)


def test_entities_of_null(spark):
    df = spark.createDataFrame([(None,)], "s string")
    assert tuple(df.select(X.decode_entities(F.col("s")), X.title_of(F.col("s"))).first()) == (None, None)


@pytest.mark.parametrize(("url", "want"), [("a/b/c", "c"), ("abc", None), ("a/", ""), (None, None)])
def test_base_name(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(X.base_name(F.col("u"))).first()[0] == want


def test_split_address(spark):
    parts = X.split_address(F.lit(685112494).cast("bigint"))
    assert tuple(spark.range(1).select(parts["byte"], parts["skip_bits"], parts["part"], parts["offset"]).first()) == (85639061, 6, 0, 85639061)
    parts = X.split_address(F.lit(((1 << 30) + 5) * 8).cast("bigint"))
    assert tuple(spark.range(1).select(parts["part"], parts["offset"]).first()) == (1, 5)


def test_headers_and_rates(spark):
    df = spark.range(1).select(F.create_map(F.lit("Content-Length"), F.array(F.lit("42"))).alias("h"))
    assert df.select(X.content_length(F.col("h"))).first()[0] == 42
    assert tuple(spark.range(1).select(X.throughput(F.lit(10), F.lit(0)), X.throughput(F.lit(10), F.lit(4))).first()) == (None, 2.5)


def test_offsets(spark):
    df = spark.createDataFrame([("é<page>x",), ("none",)], "s string")
    assert [r[0] for r in df.select(X.tag_offset(F.col("s"), "<page>")).collect()] == [2, 4]
    assert df.select(X.page_line(F.lit("t"), F.lit(1), F.lit(2))).first()[0] == "[t-1-2]"
