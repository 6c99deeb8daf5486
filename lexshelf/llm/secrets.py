"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Three base kinds are found by pattern. A fourth, looser kind (``wide``: long tokens that mix letters and digits) only
proposes candidates. All candidate values are hashed and counted by the distinct repositories and owners that hold
them: a value that few owners hold looks like a live credential, one that many hold is a copied example. Wide candidates
that look live are added to the spans as kind ``owned``; base spans always stay.

Offsets are running sums over the lengths of matches and of what lies between them, so the work is linear in a text's length and in its spans.

Defined cases: a null text is empty and has no spans, a text is scanned whole however long (its spans are one row of the result), a null owner or
repository counts as one of its own, repeated rows are scanned each for itself, overlapping spans of different kinds all stay (a wide one that meets
a base span is dropped), an empty table gives no rows, and columns that are not named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexshelf.llm.common import ROW, join_cut, let, packed, text_of, unpacked, written

#: Patterns of the base kinds, in their listed order, with the group that is judged and its least length.
#: Access keys and hex strings are whole runs, so the least length can stand in the pattern; a short assigned value still takes part in the scan.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
KINDS = [("assign", ASSIGN, 2, 12), ("access", r"AKIA[A-Z0-9]{14,}", 0, 18), ("hex", r"[0-9a-f]{16,}", 0, 16)]
WIDE = r"[A-Za-z0-9+/_=-]{20,}"
#: A cheap test that every text with a match of that kind passes.
HINTS = [r"""[DdTtNnYy]["']?\x20*[:=]""", KINDS[1][1], KINDS[2][1], WIDE]
#: A value that more owners, or more repositories, hold is a copied example.
MOST_OWNERS, MOST_REPOSITORIES = 5, 10

PARTS = "array<struct<k:int,n:int,gap:int,gap_bytes:int,size:int,bytes:int,value:string>>"
SPANS = "array<struct<start:bigint,k:int,stop:bigint,value:string,live:boolean,owners:bigint,repositories:bigint>>"
KEEP = "array<struct<begin:bigint,size:bigint>>"
NAMES = ["assign", "access", "hex", "owned"]


def parts_of(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """PARTS: leftmost, non-overlapping matches in order, each with the lengths of what precedes it and of itself; value is null if too short."""
    p = F.lit(pattern)

    def measured(pieces: Column) -> Column:
        whole, judged = F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(group))
        matches = F.filter(F.arrays_zip(pieces.alias("gap"), whole.alias("whole"), judged.alias("value")), lambda x: x.whole.isNotNull())
        return F.transform(
            matches,
            lambda x, i: F.struct(
                F.lit(kind).alias("k"), i.alias("n"), F.length(x.gap).alias("gap"), F.octet_length(x.gap).alias("gap_bytes"), F.length(x.whole).alias("size"), F.octet_length(x.whole).alias("bytes"),
                F.when(F.length(x.value) >= least, x.value).alias("value"),
            ),
        )

    return let(F.split(text, pattern, -1), measured)


def candidates(docs: DataFrame, id: str, text: str, repository: Column, owner: Column) -> DataFrame:
    """row, id, digest (MD5 of the text), repository, owner, parts PARTS: a row for each document, without its text."""
    x = text_of(text)
    mixed = lambda m: m.value.rlike("[0-9]") & m.value.rlike("[A-Za-z]")
    none = F.array().cast(PARTS)
    found = [parts_of(x, p, g, least, i) for i, (_, p, g, least) in enumerate(KINDS)]
    wide = F.transform(parts_of(x, WIDE, 0, 20, len(KINDS)), lambda m: m.withField("value", F.when(mixed(m), m.value)))
    parts = F.concat(*(F.when(x.rlike(hint), f).otherwise(none) for hint, f in zip(HINTS, [*found, wide], strict=True)))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), F.md5(x).alias("digest"), repository.alias("repository"), owner.alias("owner"), parts.alias("parts"))


def spans_of(found: DataFrame) -> DataFrame:
    """row, repository, owner, k, start, stop (code points), begin, upto (bytes) and value of each candidate.

    Wide candidates that meet a base span are left out: one that starts no later and ends after the start, or one that starts inside.
    """
    each = found.select("row", F.coalesce("repository", F.lit("")).alias("repository"), F.coalesce("owner", F.lit("")).alias("owner"), F.explode("parts").alias("p")).select("row", "repository", "owner", "p.*")
    so_far = Window.partitionBy("row", "k").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumns({"stop": F.sum(F.col("gap") + F.col("size")).over(so_far), "upto": F.sum(F.col("gap_bytes") + F.col("bytes")).over(so_far)})
    each = each.select("row", "repository", "owner", "k", (F.col("stop") - F.col("size")).alias("start"), "stop", (F.col("upto") - F.col("bytes")).alias("begin"), "upto", "value").where("value is not null")
    base = F.col("k") < len(KINDS)
    earlier = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("reached", F.max(F.when(base, F.col("stop"))).over(earlier)).withColumn("next", F.min(F.when(base, F.col("start"))).over(later))
    apart = (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("next"), F.col("stop")) >= F.col("stop"))
    return each.where(base | apart).drop("reached", "next")


def value_hash(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 32)


def ownership(spans: DataFrame) -> DataFrame:
    """value_hash, repositories, owners (how many distinct ones hold each candidate value) and n, its occurrences.

    Rows are first reduced to distinct (value, repository, owner), so a value that is copied millions of times is
    combined before the shuffle and never meets in one task as rows.
    """
    each = spans.groupBy(value_hash(F.col("value")).alias("value_hash"), "repository", "owner").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("value_hash").agg(F.count_distinct("repository").alias("repositories"), F.count_distinct("owner").alias("owners"), F.sum("n").alias("n"))


def scan(
    docs: DataFrame, id: str = "doc_id", text: str = "text", repository: Column | None = None, owner: Column | None = None,
    most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES,
) -> DataFrame:
    """id, digest (MD5 of the text), spans SPANS, keep KEEP and rest: a row for each document.

    k is the place in NAMES; owners and repositories tell how many hold the value, and live is false for values that are held widely. keep tells which bytes stand before each live span and rest where the
    bytes after the last one begin. Texts are read once and never shuffled: only candidate values move, those that are found very often over
    several tasks, and documents without any keep their row without a join.
    """
    repository = F.concat_ws("/", "source", "lang") if repository is None else repository
    owner = F.col("source") if owner is None else owner
    found = written(candidates(docs, id, text, repository, owner), "secret-candidates")
    spans = written(spans_of(found.where(F.size("parts") > 0)), "secret-spans")
    held = written(ownership(spans), "secret-values")
    live = ((F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)).alias("live")
    each = join_cut(spans.withColumn("value_hash", value_hash(F.col("value"))), held.select("value_hash", live, "owners", "repositories"), held, ["value_hash"], ["row", "k", "start"])
    each = each.where((F.col("k") < len(KINDS)) | F.col("live"))
    earlier = Window.partitionBy("row").orderBy("start", "k", "stop").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("free", F.coalesce(F.max(F.when(F.col("live"), F.col("upto"))).over(earlier), F.lit(0)))
    span = F.struct("start", "k", "stop", "value", "live", "owners", "repositories")
    piece = F.when(F.col("live") & (F.col("begin") >= F.col("free")), F.struct(F.col("free").alias("begin"), (F.col("begin") - F.col("free")).alias("size")))
    by_row = each.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"), F.sort_array(F.collect_list(piece)).alias("keep"), F.coalesce(F.max(F.when(F.col("live"), F.col("upto"))), F.lit(0)).alias("rest"))
    some = found.where(F.size("parts") > 0).select("row", "id", "digest").join(by_row, "row", "left")
    some = some.select("id", "digest", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"), F.coalesce("keep", F.array().cast(KEEP)).alias("keep"), F.coalesce("rest", F.lit(0)).alias("rest"))
    none = found.where(F.size("parts") == 0).select("id", "digest", F.array().cast(SPANS).alias("spans"), F.array().cast(KEEP).alias("keep"), F.lit(0).cast("bigint").alias("rest"))
    return some.unionByName(none).withColumnRenamed("id", id)


def text_of_spans(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.k), s.start.cast("string"), s.stop.cast("string"))), ",")


def suspect(text: Column) -> Column:
    """Whether a text may hold any candidate at all."""
    group = ASSIGN.rindex("+)")
    assign = text.rlike(HINTS[0]) & text.rlike(ASSIGN[:group] + f"{{{KINDS[0][3]},}})")
    return assign | text.rlike(HINTS[1]) | text.rlike(HINTS[2]) | text.rlike(HINTS[3])


def redact(docs: DataFrame, scanned: DataFrame, id: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with each run of overlapping live spans replaced by mark, a null text staying null.

    Only texts that may hold a candidate are joined with the spans to be cut; all others pass as they are read. An empty table gives no rows.
    """
    x, own = text_of(f"{ROW}.{text}"), ["secret_id", "secret_digest"]
    name = lambda id: F.coalesce(F.col(id).cast("string"), F.lit("null"))  # noqa: E731 - a row with the same text, but no id, has the same cuts
    cuts = scanned.where(F.size("keep") > 0).groupBy(name(id).alias(own[0]), F.col("digest").alias(own[1]))
    cuts = written(cuts.agg(F.first(F.struct("keep", "rest")).alias("secret_cut"), F.count(F.lit(1)).alias("secret_n")), "secret-cuts")
    some = packed(docs).where(suspect(x)).withColumns({own[0]: name(f"{ROW}.{id}"), own[1]: F.md5(x), "secret_row": F.monotonically_increasing_id()})
    joined = join_cut(some, cuts.drop("secret_n"), cuts, own, ["secret_row"], "left", "secret_n")

    def cut(raw: Column) -> Column:
        piece = lambda begin, size: F.substr(raw, (begin + 1).cast("int"), size.cast("int")).cast("string")
        pieces = F.transform("secret_cut.keep", lambda p: piece(p.begin, p.size))
        return F.array_join(F.concat(pieces, F.array(piece(F.col("secret_cut.rest"), F.octet_length(x)))), mark)

    clean = let(x.cast("binary"), cut)
    said = F.when(F.col("secret_cut").isNull(), F.col(f"{ROW}.{text}")).otherwise(clean)
    return unpacked(joined.select(F.col(ROW).withField(text, said).alias(ROW))).unionByName(docs.where(~suspect(text_of(text))))
