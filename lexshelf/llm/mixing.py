"""Mixing sources to target weights with hash-threshold histograms.

Each document has a fixed hash. A source takes every document a whole number of times, and once more those
whose hash lies below the source's threshold. Thresholds come from nested histograms: sizes are summed by source
and leading hash bits, and only the bucket that holds the threshold is refined, so no sort of documents is needed.

Defined cases: a null text has size 0, a null source is a source of its own and comes last, rows of one id (or of none) with different texts
have hashes of their own while repeated rows have one and are taken together, documents of size 0 take 0, a document is never parted however long, so a
source comes as near its target as its documents allow, an empty table gives no rows, and columns that are not named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexshelf.llm.common import ROW, WORD, packed, small, text_of, unpacked, written

WEIGHTS = (5, 2, 1)
MOST = 3
#: Levels of the histogram and hash bits that each one resolves.
LEVELS, BITS = 4, 12
#: Per-source rows (about 80 bytes) up to which the plan is broadcast.
BROADCAST_SOURCES = 50_000


def size_of(text: str) -> Column:
    """Number of words; null has none."""
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def hash_of(id: str, text: str) -> Column:
    """48 bits of MD5 of id and text, the same in any run and engine."""
    key = F.concat(F.coalesce(F.col(id).cast("string"), F.lit("")), F.lit(":"), text_of(text))
    return F.conv(F.substring(F.md5(key), 1, LEVELS * BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target: one row for each source.

    The budget is the sum of all sizes. A source's share is by weight, but at most MOST times its size; the rest is
    shared again by weight among the others. Sources reach that cap in the order of size over weight, so the
    capped ones are a prefix of that order. Only one row per source is sorted here.
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("decimal(30,0)").alias("s"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    by = by.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank - 1) % len(WEIGHTS) + 1).cast("decimal(8,0)"))
    ratio = Window.orderBy(F.col("s") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("decimal(38,0)")
    by = by.select(
        "source", "s", "w",
        F.coalesce((MOST * F.sum("s").over(ratio)).cast("decimal(38,0)"), zero).alias("capped"),
        F.coalesce(F.sum("w").over(ratio), zero).alias("weighed"),
        F.sum("s").over(every).alias("total"), F.sum("w").over(every).alias("weights"),
    )
    left, over = F.col("total") - F.col("capped"), F.col("weights") - F.col("weighed")
    by = by.withColumn("is_capped", MOST * F.col("s") * over <= F.col("w") * left)
    free = F.min(F.when(~F.col("is_capped"), F.struct("capped", "weighed"))).over(every)
    by = by.withColumn("free", free)
    share = (F.col("w") * (F.col("total") - F.col("free.capped"))).cast("double") / (F.col("weights") - F.col("free.weighed")).cast("double")
    return by.select(
        "source", F.col("s").cast("long").alias("source_size"), F.when(F.col("is_capped"), (MOST * F.col("s")).cast("double")).otherwise(share).alias("target")
    )


def thresholds(docs: DataFrame, plan: DataFrame, sources: int) -> DataFrame:
    """plan with times (whole repeats) and below (hash threshold of one repeat more)."""
    times = F.when(F.col("source_size") == 0, 0).otherwise(F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST)))
    state = plan.withColumn("times", times.cast("long")).select(
        "*", (F.col("target") - F.col("times") * F.col("source_size")).alias("need"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("double").alias("base")
    )
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = docs.alias("d").join(small(state, sources, BROADCAST_SOURCES).alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
        inside = inside.where((F.col("need") > 0) & (F.shiftright("h", shift + BITS) == F.col("prefix")))
        sums = inside.groupBy(F.col("d.source").alias("source"), F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        up = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("n").over(up).cast("double"))
        found = sums.alias("b").join(small(state, sources, BROADCAST_SOURCES).alias("p"), F.col("b.source").eqNullSafe(F.col("p.source")))
        found = found.where(F.col("base") + F.col("upto") >= F.col("need")).groupBy(F.col("b.source").alias("source"))
        edge = found.agg(F.min(F.struct("bucket", (F.col("base") + F.col("upto") - F.col("n")).alias("base"), (F.col("base") + F.col("upto")).alias("full"))).alias("edge"))
        joined = state.alias("p").join(edge.alias("e"), F.col("e.source").eqNullSafe(F.col("p.source")), "left")
        state = written(
            joined.select(
                "p.source", "source_size", "target", "times", "need",
                F.coalesce("edge.bucket", "prefix").alias("prefix"), F.coalesce("edge.base", "base").alias("base"),
                *([F.col("edge.full").alias("full")] if level == LEVELS - 1 else []),
            ),
            "mix-level",
        )
    nearer = F.abs(F.col("full") - F.col("need")) < F.abs(F.col("base") - F.col("need"))
    below = F.when(F.col("need") > 0, F.col("prefix") + F.when(nearer, 1).otherwise(0)).otherwise(0).cast("long")
    return state.select("source", "source_size", "target", "times", below.alias("below"))


def narrowed(docs: DataFrame, id: str, text: str, source: str) -> DataFrame:
    """id, source, size and hash of each document."""
    return written(docs.select(F.col(id).alias("id"), F.col(source).alias("source"), size_of(text).alias("size"), hash_of(id, text).alias("h")), "mix-docs")


def planned(narrow: DataFrame) -> tuple[DataFrame, int]:
    """source, source_size, target, times, below: a row for each source, and their number."""
    plan = written(targets(narrow), "mix-targets")
    sources = plan.count()
    return thresholds(narrow, plan, sources), sources


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """id, source, size, source_size, target, copies, taken: one row for each document.

    Text is read once; everything after it works on a narrow table of ids, sizes and hashes.
    """
    narrow = narrowed(docs, id, text, source)
    plan, sources = planned(narrow)
    joined = narrow.alias("d").join(small(plan, sources, BROADCAST_SOURCES).alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    copies = F.col("times") + (F.col("h") < F.col("below")).cast("long")
    return joined.select(F.col("id").alias(id), F.col("d.source").alias(source), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs, each row as often as the mix takes it. Copies follow from a row's hash and its source's threshold, so no text is moved. An empty table gives no rows."""
    plan, sources = planned(narrowed(docs, id, text, source))
    named = small(plan.select(F.col("source").alias("mix_source"), F.struct("times", "below").alias("mix_plan")), sources, BROADCAST_SOURCES)
    joined = packed(docs).withColumn("mix_hash", hash_of(f"{ROW}.{id}", f"{ROW}.{text}")).join(named, F.col(f"{ROW}.{source}").eqNullSafe(F.col("mix_source")))
    copies = F.col("mix_plan.times") + (F.col("mix_hash") < F.col("mix_plan.below")).cast("long")
    return unpacked(joined.where(copies > 0).select(ROW, F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias("mix_time")))
