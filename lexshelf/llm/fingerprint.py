"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame operations only.

A sketch is the sorted array of the k least distinct hashes of a text's word shingles. Sketches merge by uniting and
cutting again, and estimate resemblance, containment and the number of distinct shingles.

Defined cases: a null text is empty, a text of no words has an empty sketch (two such have resemblance 1, one
and another 0), fewer words than a shingle are one shingle, a text is sketched whole (its shingles' hashes, 8 bytes for each word, are held by one task),
repeated rows are followed by each other in order of id and text, rows of one id or of none share a range, which is sorted with spilling, a null id comes
first, an empty table gives no rows, and columns that are not named are ignored. Ids are whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexshelf.llm.common import WORD, let, text_of

K, WIDTH = 128, 5
#: Rows of one range in followed_by(), and most ranges.
RANGE_ROWS, MOST_RANGES = 1000, 20_000


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """ARRAY<LONG>, ascending. Each word is hashed once; a shingle's hash is that of its words' hashes."""

    def shingles(h: Column) -> Column:
        n = F.size(h)
        runs = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(width))))
        return F.when(n >= width, runs).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), shingles)
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the merged sketch that both have."""
    both = let(merged(a, b, k), lambda m: F.when(F.size(m) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(m, a), b)) / F.size(m)))
    return both.cast("double")


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below k; else from the share of the hash range that the k least hashes take."""
    taken = (F.element_at(a, k).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / taken)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of a's shingles that b has as well."""
    both = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def merge_sketches(rows: DataFrame, by: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each group: hashes are reduced to distinct ones before they meet, so large groups stay small rows."""
    each = rows.select(*by, F.explode(column).alias("h")).distinct()
    ranked = each.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("n") <= k)
    return ranked.groupBy(*by).agg(F.sort_array(F.collect_list("h")).alias(column))


def text_of_sketch(a: Column) -> Column:
    """16 hex digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most value, by halving; null has none."""
    if not bounds:
        return F.lit(0)
    every = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(every, at + s - 1) <= value, at + s).otherwise(at))


def followed_by(rows: DataFrame, id: str, order: list[str], values: list[str]) -> DataFrame:
    """rows with next_<value> of the following row by id (an integer) and order, the first following the last.

    Rows are dealt into ranges of ids, whose bounds (MOST_RANGES numbers at most) are approximate quantiles. Each range
    also gets the first rows of the next one as guests, so every range finds its followers alone.
    """
    wanted = max(1, min(MOST_RANGES, rows.count() // RANGE_ROWS))
    bounds = sorted({int(b) for b in rows.approxQuantile(id, [i / wanted for i in range(1, wanted)], 0.2 / wanted)}) if wanted > 1 else []
    ranged = rows.withColumn("range", range_of(F.col(id), bounds)).withColumn("guest", F.lit(0))
    least = F.when(F.count(F.when(F.col(id).isNull(), 1)) == 0, F.min(id))
    firsts = sorted((r["range"], r["least"]) for r in ranged.groupBy("range").agg(least.alias("least")).collect())
    hosts = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    hosts = F.broadcast(rows.sparkSession.createDataFrame(hosts, "first bigint, host int"))  # MOST_RANGES rows at most
    guests = ranged.join(hosts, F.col(id).eqNullSafe(F.col("first"))).withColumn("range", F.col("host")).withColumn("guest", F.lit(1)).drop("first", "host")
    window = Window.partitionBy("range").orderBy("guest", *order)
    found = ranged.unionByName(guests).select("*", *(F.lead(v).over(window).alias(f"next_{v}") for v in values))
    return found.where("guest = 0").drop("range", "guest")


def fingerprint_edits(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and, from the same sketches, n_shingles (estimated distinct ones
    of the text), in_edited and in_next (the share of them that the edited text and the next document have).

    The edited text has its second half replaced by the beginning of the next document.
    """
    rows = docs.select(F.col(id).alias("id"), text_of(text).alias("text"))
    found = followed_by(rows, "id", ["id", "text"], ["text"])
    n = F.length("text")
    edited = F.concat(F.substr("text", F.lit(1), n - F.floor(n / 2).cast("int")), F.substr("next_text", F.lit(1), F.floor(n / 2).cast("int")))
    found = found.select("id", n.cast("long").alias("n_chars"), F.col("text"), "next_text", edited.alias("edited"))
    found = found.select(
        "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        sketch(F.col("text"), k, width).alias("a"), sketch(F.col("edited"), k, width).alias("b"), sketch(F.col("next_text"), k, width).alias("c"),
    )
    return found.select(
        F.col("id").alias(id), "n_chars", "edited_sha256", text_of_sketch(F.col("a")).alias("fingerprint"), text_of_sketch(F.col("b")).alias("edited_fingerprint"),
        resemblance(F.col("a"), F.col("b"), k).alias("near_edited"), resemblance(F.col("a"), F.col("c"), k).alias("near_next"),
        distinct_shingles(F.col("a"), k).alias("n_shingles"), containment(F.col("a"), F.col("b"), k).alias("in_edited"), containment(F.col("a"), F.col("c"), k).alias("in_next"),
    )
