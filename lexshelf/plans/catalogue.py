"""The queries of the reference's operators over the test tables, with their SQL for DuckDB.

``pages`` stands for the dump: the title element of html is a page's title, and page_id orders the blocks. The block catalog
is (block_no = page_id, block_start_bits = 32 + 8 x bytes of all earlier pages, index_state = page_id % 3).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshelf.functions import text as X
from lexshelf.operators import blocks as B
from lexshelf.operators import index as I
from lexshelf.operators import search as S
from lexshelf.operators import states, tags, titleindex
from lexshelf.operators.pages import broken_pages, parse_pages
from lexshelf.operators.running import running_before
from lexshelf.operators.titleindex import TitleIndex
from lexshelf.plans import stages
from lexshelf.schemas import BLOCKS, create_table
from lexshelf.shared import settled, shared_dir, version_of
from lexshelf.sources import binarysink, digests, records, snapshots
from lexshelf.sources import parts as P
from lexshelf.sources.dump import read_dump
from lexshelf.streaming import dumpsource
from lexshelf.streaming.observers import into_folder

KEY, LIKE, REGEXP, BITS, PART = "M", "%the%", "[A-M].*", 100_000, 65_536

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "pages").select("page_id", F.octet_length("html").cast("bigint").alias("size"))
    found = running_before(sizes, "page_id", "size")
    return found.select(F.col("page_id").alias("block_no"), (F.lit(32) + 8 * F.col("before")).cast("bigint").alias("block_start_bits"), (F.col("page_id") % 3).cast("int").alias("index_state"))


BLOCKS_SQL = """blocks_v as (select page_id as block_no, cast(32 + 8 * coalesce(sum(strlen(html)) over (order by page_id rows between unbounded preceding and 1 preceding), 0) as bigint) as block_start_bits,
    cast(page_id % 3 as integer) as index_state from pages)"""
TITLE_SQL = """replace(replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '&quot;', '"'), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"""
TITLES_SQL = f"""raw_v as (select page_id, {TITLE_SQL} as title from pages where regexp_matches(html, '<title>.*?</title>', 's')),
    titles_v as (select title, min(page_id) as page_id from raw_v where length(title) <= 4096 group by title)"""


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.title_of(F.col("html")).alias("title")).where("title is not null")


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title index, with page_id for the block."""
    rows = titled(spark, sf_dir).select(F.col("page_id").alias("block_start_bits"), F.lit(0).alias("title_start_pos"), "title")
    return I.first_wins(rows)


@query(f"with {TITLES_SQL} select page_id, title from raw_v")
def title_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titled(spark, sf_dir)


@query(f"with {TITLES_SQL} select page_id, title from titles_v")
def title_index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).select(F.col("block_start_bits").alias("page_id"), "title")


def titles_home(spark: SparkSession, sf_dir: str) -> str:
    return f"{shared_dir(spark)}/titles-{version_of(spark, f'{sf_dir}/pages.parquet')}"


def published(spark: SparkSession, sf_dir: str) -> TitleIndex:
    """The title index of pages as they are now: published by title_publish, or here if that has not run, then only read."""
    home = titles_home(spark, sf_dir)
    if not snapshots.history(spark, home):
        titleindex.publish(titles(spark, sf_dir), home)
    return TitleIndex(spark, home)


GRAMS_SQL = """padded_v as (select chr(2) || title || chr(3) as p from titles_v),
    grams_v as (select unnest(list_distinct(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3)))) as gram from padded_v)"""


@query(f"with {TITLES_SQL}, {GRAMS_SQL} select (select count(*) from titles_v) as titles, count(distinct gram) as grams, count(*) as postings from grams_v")
def title_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index built and published anew: titles by the zone map, trigrams and postings by their counts, where the lists hold as many rows."""
    titleindex.publish(titles(spark, sf_dir), titles_home(spark, sf_dir))
    made = TitleIndex(spark, titles_home(spark, sf_dir))
    listed = made.grams.groupBy("gram").agg(F.count(F.lit(1)).alias("rows")).join(made.counts, "gram", "full").where("rows = n")
    return listed.agg(made.zones.agg(F.sum("n")).scalar().alias("titles"), F.count(F.lit(1)).alias("grams"), F.sum("rows").alias("postings"))


@query(f"with {TITLES_SQL} select title from titles_v where title >= '{KEY}' order by title limit 50")
def title_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(spark, sf_dir).seek(KEY)


@query(f"with {TITLES_SQL} select title from titles_v where title >= '!' order by title limit 20")
def title_seek_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key before nearly all titles: the zones tell which files hold the first twenty."""
    return published(spark, sf_dir).seek("!", 20)


@query(f"with {TITLES_SQL} select title from titles_v where title >= 'C' order by title limit 20")
def title_seek_console(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(spark, sf_dir).search(titled(spark, sf_dir), "###C", "console")


@query(f"with {TITLES_SQL} select title from titles_v where title >= ''")
def title_seek_unlimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(spark, sf_dir).seek("", 0)


@query(f"with {TITLES_SQL} select title from titles_v where title like '%e%' order by title limit 50")
def title_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(spark, sf_dir).like("%e%")


#: The middle of the title of page 7 stands for what a reader types.
PIECE_SQL = f"with {TITLES_SQL}, piece_v as (select substr(title, 3, 6) as piece, right(title, 5) as tail from raw_v where page_id = 7)"


def literal(text: str) -> str:
    """Text as a part of a pattern whose escape character is an exclamation mark."""
    return "".join(f"!{c}" if c in "%_!" else c for c in text)


def piece(spark: SparkSession, sf_dir: str) -> str:
    return titled(spark, sf_dir).where("page_id = 7").first()["title"]


@query(f"{PIECE_SQL} select title from titles_v, piece_v where contains(title, piece) order by title limit 50")
def title_like_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern that few titles match, by its trigrams."""
    return published(spark, sf_dir).like(f"%{literal(piece(spark, sf_dir)[2:8])}%", escape="!")


@query(f"{PIECE_SQL} select title from titles_v, piece_v where title like '_%' and ends_with(title, tail)")
def title_like_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(spark, sf_dir).like(f"_%{literal(piece(spark, sf_dir)[-5:])}", 0, "!")


@query(f"{PIECE_SQL} select title from titles_v, piece_v where regexp_full_match(title, '.+' || regexp_escape(piece) || '[^0-9]*', 's') order by title limit 50")
def title_regexp_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regular expression whose literal run is known by its trigrams."""
    return published(spark, sf_dir).regexp(rf"(?s).+\Q{piece(spark, sf_dir)[2:8]}\E[^0-9]*")


@query(f"with {TITLES_SQL} select title from titles_v where title like '%zqxj%' or title = (select min(title) from titles_v)")
def title_like_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trigram that no title holds tells at once that there is no match; a title in full has one."""
    index = published(spark, sf_dir)
    first = index.rows.agg(F.min("title")).first()[0]
    return index.like("%zqxj%").unionByName(index.like(literal(first), escape="!"))


@query(f"""with {TITLES_SQL}, old_v as (select title from titles_v where page_id % 2 = 0 and title >= '{KEY}' order by title limit 50),
    new_v as (select title from titles_v where title >= '{KEY}' order by title limit 50)
    select 'before' as version, title from old_v union all select 'after', title from new_v""")
def search_across_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search that was opened on one version answers by it after the next one is published, while new searches see that."""
    home, every = f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}", titles(spark, sf_dir)
    titleindex.publish(every.where("block_start_bits % 2 = 0"), home)
    before = TitleIndex(spark, home).seek(KEY)
    titleindex.publish(every, home)
    snapshots.vacuum(spark, home, keep=2, least_age=0)  # the version that is still read is kept
    after = TitleIndex(spark, home).seek(KEY)
    return before.select(F.lit("before").alias("version"), "title").unionByName(after.select(F.lit("after").alias("version"), "title"))


@query("select url as title from (select distinct url from pages) where url like '%!_%' escape '!' or url like '%p_ge%'")
def title_like_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "pages").select(F.col("url").alias("title")).distinct()
    return S.seek_like(urls, "%!_%", 0, "!").unionByName(S.seek_like(urls, "%p_ge%", 0)).distinct()


@query(f"with {TITLES_SQL} select title from titles_v where regexp_full_match(title, '{REGEXP}', 's') order by title limit 50")
def title_regexp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(spark, sf_dir).regexp(f"(?s){REGEXP}")


@query(f"with {TITLES_SQL} select page_id as block_start_bits, cast(0 as bigint) as title_start_pos from titles_v where title = (select min(title) from titles_v)")
def title_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least title, which the zones know, looked up in the one file that can hold it."""
    index = published(spark, sf_dir)
    return index.lookup(index.zones.agg(F.min("least")).first()[0])


@query("select page_id, url, html from pages where page_id = 7")
def page_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("title", F.col("url"))
    return S.fetch(pages, pages.where("page_id = 7").agg(F.min("title")).scalar()).drop("title")


@query(
    f"""with {TITLES_SQL}, a as (select title from titles_v where title like 'A%' order by title limit 50), b as (select title from titles_v where title >= 'Q' order by title limit 50)
    select 'like' as route, title from a union all select 'seek', title from b"""
)
def search_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, pages = published(spark, sf_dir), titled(spark, sf_dir)
    parts = [found.search(pages, t).select(F.lit(S.routed(t, "search")[0]).alias("route"), "title") for t in ("A%", "Q", "")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("select page_id, cast(strlen(split_part(html, '<title>', 1)) as bigint) as title_pos from pages")
def tag_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.tag_offset(F.col("html"), "<title>").alias("title_pos"))


@query("select page_id, case when instr(url, '/') > 0 then split_part(url, '/', -1) end as base_name from pages")
def url_basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.base_name(F.col("url")).alias("base_name"))


@query(f"with {BLOCKS_SQL} select * from blocks_v")
def block_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir)


@query(f"with {BLOCKS_SQL} select * from blocks_v where block_start_bits >= {BITS} order by block_no")
def blocks_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.blocks_from(catalog(spark, sf_dir), BITS)


@query(f"with {BLOCKS_SQL} select * from blocks_v where block_no = (select max(block_no) from blocks_v)")
def block_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.latest_block(catalog(spark, sf_dir))


@query(f"with {BLOCKS_SQL} select block_no, block_start_bits from blocks_v order by block_no limit 25")
def block_first_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.first_blocks(catalog(spark, sf_dir), 25)


@query(f"with {BLOCKS_SQL} select count(*) as blocks, max(block_no) as latest from blocks_v")
def block_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.block_count(catalog(spark, sf_dir))


@query("select page_id, cast(case when page_id % 3 = 0 then null else strlen(html) end as bigint) as content_length from pages")
def header_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First Content-Length of header maps, null where the header is absent."""
    name = F.when(F.col("page_id") % 3 == 0, "Date").otherwise("Content-Length")
    headers = F.create_map(name, F.array(F.octet_length("html").cast("string"), F.lit("0")))
    return table(spark, sf_dir, "pages").select("page_id", X.content_length(headers).alias("content_length"))


@query(f"with {TITLES_SQL} select page_id, title from raw_v")
def title_decode_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles whose entities decode alike with and without the pass-over quirk, and the plain decoding of the others."""
    raw = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("raw"), F.col("html").rlike(r"(?s)<title>.*?</title>").alias("there"))
    plain, quirk = X.decode_entities(F.col("raw")), X.decode_entities_compat(F.col("raw"))
    return raw.where("there").select("page_id", F.when(plain == quirk, quirk).otherwise(plain).alias("title"))


@query(f"with {BLOCKS_SQL} select *, lead(block_start_bits) over (order by block_no) as stop_bits from blocks_v")
def block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.pair_blocks(catalog(spark, sf_dir))


@query(f"with {BLOCKS_SQL} select * from blocks_v where coalesce(index_state, 0) = 0")
def blocks_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.pending(catalog(spark, sf_dir))


@query(f"with {BLOCKS_SQL} select block_no, block_start_bits, case when block_no = 7 then 2 else index_state end as index_state from blocks_v")
def block_mark_finished(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.mark_finished(catalog(spark, sf_dir), 7)


@query(
    f"""with {BLOCKS_SQL}, e as (select page_id % 50 as block_no, cast(page_id % 3 as integer) as index_state, page_id as seq from pages where page_id % 4 = 0),
    l as (select block_no, arg_max(index_state, seq) as now from e group by 1)
    select block_no, block_start_bits, coalesce(now, index_state, 0) as index_state from blocks_v left join l using (block_no)"""
)
def block_state_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "pages").where("page_id % 4 = 0").select((F.col("page_id") % 50).alias("block_no"), (F.col("page_id") % 3).cast("int").alias("index_state"), F.col("page_id").alias("seq"))
    return I.with_events(catalog(spark, sf_dir), events)


@query(f"with {BLOCKS_SQL} select coalesce(bool_and(coalesce(index_state, 0) = 2), false) as complete from blocks_v")
def index_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.is_complete(catalog(spark, sf_dir))


@query(
    f"""with {BLOCKS_SQL} select block_no, block_start_bits // 8 as byte, block_start_bits % 8 as skip_bits, block_start_bits // 8 // {PART} as part, block_start_bits // 8 % {PART} as "offset" from blocks_v"""
)
def split_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = X.split_address(F.col("block_start_bits"), PART)
    return catalog(spark, sf_dir).select("block_no", *(c.alias(n) for n, c in parts.items()))


def rolled(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the pages' html as one run of bytes, cut into parts of PART bytes."""
    folder = f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}"
    binarysink.roll_parts(table(spark, sf_dir, "pages").select(F.col("page_id").alias("place"), F.col("html").alias("content")), folder, "dump", PART)
    return folder


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts, listed."""
    return P.list_parts(spark, rolled(spark, sf_dir), "dump")


@query(f"""select cast(n // {PART} as integer) as part, cast(least({PART}, total - (n // {PART}) * {PART}) as bigint) as length
    from (select unnest(range(0, total, {PART})) as n, total from (select cast(sum(strlen(html)) as bigint) as total from pages))""")
def rolled_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part but the last has exactly PART bytes, wherever pages end."""
    return part_files(spark, sf_dir).select("part", "length")


@query("select sha256(string_agg(html, '' order by page_id)) as digest, cast(sum(strlen(html)) as bigint) as bytes from pages")
def joined_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts read back as one run of bytes: its digest, for which tasks take slices in order, and its length; null where no page has html."""
    if table(spark, sf_dir, "pages").where("html is not null").isEmpty():
        return spark.createDataFrame([(None, None)], "digest string, bytes bigint")
    return spark.createDataFrame([digests.sha256(spark, f"{rolled(spark, sf_dir)}/dump")], "digest string, bytes bigint")


@query(f"select cast(sum(strlen(html)) as bigint) as total_length, cast(ceil(sum(strlen(html)) / {PART}) as bigint) as part_count from pages")
def dump_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parts_summary(part_files(spark, sf_dir))


@query(f"select 'dump.' || part as name, part from (select cast(ceil(sum(strlen(html)) / {PART}) - 1 as integer) as part from pages)")
def last_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.last_part(part_files(spark, sf_dir)).select(F.substring_index("path", "/", -1).alias("name"), "part")


@query(
    f"""with {TITLES_SQL}, known as (select title from raw_v where page_id % 2 = 0)
    select title, min(page_id) as page_id from raw_v r where not exists (select 1 from known k where k.title = r.title) and length(title) <= 4096 group by title"""
)
def resume_new_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = titled(spark, sf_dir).select(F.col("page_id").alias("block_start_bits"), F.lit(0).alias("title_start_pos"), "title")
    return I.new_titles(rows, rows.where("block_start_bits % 2 = 0")).select("title", F.col("block_start_bits").alias("page_id"))


@query("select o_orderkey, '[' || o_orderpriority || '-' || o_orderkey || '-' || o_custkey || ']' as line from orders")
def page_order_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", X.page_line(F.col("o_orderpriority"), F.col("o_orderkey"), F.col("o_custkey")).alias("line"))


@query(f"with {BLOCKS_SQL} select * from blocks_v")
def record_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.from_records(records.to_records(catalog(spark, sf_dir)))


@query(f"with {BLOCKS_SQL} select * from blocks_v")
def record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog written as record files, whose partial last records are left out in reading."""
    return records.read_record_files(spark, record_folder(spark, sf_dir))


@query(f"with {BLOCKS_SQL}, last_v as (select max(block_no) as block_no from blocks_v group by block_no // 40) select b.* from blocks_v b join last_v using (block_no)")
def last_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.last_record(spark, record_folder(spark, sf_dir))


def record_folder(spark: SparkSession, sf_dir: str) -> str:
    path = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    records.write_record_files(catalog(spark, sf_dir), path, 40)
    return path


@query("select doc_id, cast(strlen(text) as bigint) as n_bytes, case when strlen(right(text, 1)) > 1 then 'truncated' end as fault from documents")
def utf8_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of texts whose last byte is cut off."""
    raw = F.col("text").cast("binary")
    cut = F.substr(raw, F.lit(1), F.octet_length(raw) - 1)
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), X.utf8_fault(cut).alias("fault"))


@query("select title from (select distinct p_name as title from part) where title >= 'm' order by title limit 50")
def part_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.seek(table(spark, sf_dir, "part").select(F.col("p_name").alias("title")).distinct(), "m")


@query("select block_no, case when seconds = 0 then null else block_no / seconds end as rate from (select page_id as block_no, page_id % 5 as seconds from pages)")
def scan_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("block_no"), (F.col("page_id") % 5).alias("seconds"))
    return rows.select("block_no", X.throughput(F.col("block_no"), F.col("seconds")).alias("rate"))


#: Files of the test dump, each of which has a block at least.
DUMP_FILES = 12


def bz2_dump(spark: SparkSession, sf_dir: str) -> str:
    """All pages as a .bz2 dump of several files in the session's shared folder, written by Spark."""
    pages = table(spark, sf_dir, "pages").select("page_id", X.title_of(F.col("html")).alias("title"), "html").where("title is not null")
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    number, comment = F.col("page_id").cast("string"), F.concat(F.lit("<comment>"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("note "), F.col("page_id").cast("string"))).otherwise(""), F.lit("</comment>"))
    row = F.concat(
        F.lit("<page><title>"), safe(F.col("title")), F.lit("</title><id>"), number, F.lit("</id><revision><id>"), (F.col("page_id") * 10).cast("string"), F.lit("</id>"),
        F.when(F.col("page_id") % 3 == 2, "").otherwise(comment), F.lit("<text>"), safe(F.col("html")), F.lit("</text></revision></page>"),
    )
    path = f"{shared_dir(spark)}/dump-{uuid.uuid4().hex}"
    laid = pages.select("page_id", row.alias("value")).repartitionByRange(DUMP_FILES, "page_id").sortWithinPartitions("page_id")
    laid.select("value").write.option("lineSep", "\n").option("compression", "bzip2").text(path)
    return path


@query(f"with {TITLES_SQL} select title, page_id as id, page_id * 10 as rev_id, case page_id % 3 when 0 then 'note ' || page_id when 1 then '' end as comment from raw_v")
def dump_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as a compressed dump, read back in parallel and parsed."""
    return parse_pages(read_dump(spark, bz2_dump(spark, sf_dir))).select("title", "id", "rev_id", "comment")


@query("select page_id from pages where page_id % 4 < 2")
def pages_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of pages without a title, with an element left open, or in order, those that cannot be parsed."""
    kind, number = F.col("page_id") % 4, F.col("page_id").cast("string")
    value = F.concat(F.lit("<page>"), F.when(kind == 0, "").otherwise("<title>t</title>"), F.when(kind == 1, "<open>").otherwise(""), F.lit("<id>"), number, F.lit("</id>"))
    found = broken_pages(table(spark, sf_dir, "pages").select(value.alias("value")))
    return found.select(F.regexp_extract("value", "<id>([0-9]+)</id>", 1).cast("bigint").alias("page_id"))


@query(f"with {TITLES_SQL} select title from titles_v")
def block_lane_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks found by their marks, decoded one by one, their titles indexed."""
    path = bz2_dump(spark, sf_dir)
    return I.first_wins(B.titles_only(B.block_titles(B.find_blocks(spark, path), path))).select("title")


@query(f"with {TITLES_SQL} select title, page_id as id, html as text from titles_v join pages using (page_id)")
def block_lane_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every indexed page fetched by block and position, and parsed."""
    path = bz2_dump(spark, sf_dir)
    found = I.first_wins(B.titles_only(B.block_titles(B.find_blocks(spark, path), path)))
    return parse_pages(B.fetch_markup(found, path)).select("title", "id", "text")


@query(f"with {BLOCKS_SQL} select * from blocks_v")
def catalog_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog inserted in two batches into a table that is created twice, and read back from it."""
    name, path = f"blocks_{uuid.uuid4().hex}", f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}"
    for half in (0, 1):
        create_table(spark, name, BLOCKS, path)
        catalog(spark, sf_dir).where(F.col("block_no") % 2 == half).write.insertInto(name)
    return spark.table(name)


@query(f"with {TITLES_SQL} select count(*) as pages, true as marks_in_order, cast(0 as bigint) as unread from raw_v")
def magic_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks sought in small chunks: they decode to as many pages as were written, and their positions rise with their numbers."""
    path = bz2_dump(spark, sf_dir)
    blocks = B.find_blocks(spark, path, 1 << 16)
    found = settled(B.block_titles(blocks, path))
    pages = B.titles_only(found).agg(F.count(F.lit(1)).alias("pages")).crossJoin(B.block_faults(found).agg(F.count(F.lit(1)).alias("unread")))
    following = B.pair_blocks(blocks.drop("stop_bits")).agg(F.bool_and(F.coalesce("stop_bits", F.col("block_start_bits") + 1) > F.col("block_start_bits")).alias("marks_in_order"))
    return pages.crossJoin(following)  # one row each


@query(f"with {TITLES_SQL} select title, min(page_id) as first_page, true as blocks_once, true as some_before, true as some_after from raw_v group by title")
def scan_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of the blocks up to one in the middle, and of those that a scan finds which goes on from there: together each page once."""
    path = bz2_dump(spark, sf_dir)
    half = P.ByteParts(path).size // 2
    before = B.find_blocks(spark, path, stop=half)
    last = I.latest_block(before).first()  # one row
    after = B.find_blocks(spark, path, after=(last["block_no"], last["block_start_bits"]))
    both = before.unionByName(after)
    n = both.agg(F.count(F.lit(1)), F.count_distinct("block_no"), F.max("block_no") + 1).first()
    found = B.fetch_markup(B.titles_only(B.block_titles(both, path)), path)
    pages = parse_pages(found).groupBy("title").agg(F.min("id").alias("first_page"))
    facts = {"blocks_once": len(set(n)) == 1, "some_before": before.count() > 1, "some_after": after.count() > 1}
    return pages.withColumns({k: F.lit(v) for k, v in facts.items()})


def build_home(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    path = bz2_dump(spark, sf_dir)
    return path, f"{path}-home"


@query(f"with {TITLES_SQL} select true as complete, count(*) as titles, true as blocks_once from titles_v")
def stage_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The staged build, broken off twice, scanned in slices: the runs together do the whole work once."""
    path, home = build_home(spark, sf_dir)
    part = P.ByteParts(path).size // 3 + 1
    stages.scan(spark, path, home, part, most_scans=1)
    stages.build(spark, path, home, most_blocks=1, scan_bytes=part)
    built = stages.build(spark, path, home, scan_bytes=part).select("complete", "titles", "blocks")
    every = B.find_blocks(spark, path).join(stages.catalog(spark, home).select("block_no", "block_start_bits"), ["block_no", "block_start_bits"])
    return built.crossJoin(every.agg(F.count(F.lit(1)).alias("n"))).select("complete", "titles", (F.col("n") == F.col("blocks")).alias("blocks_once"))  # one row each


@query(f"with {TITLES_SQL} select title from titles_v where title >= '{KEY}' order by title limit 50")
def search_after_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search on the index while it is half built, and then on the whole one, which holds all titles that the half had."""
    path, home = build_home(spark, sf_dir)
    stages.build(spark, path, home, most_blocks=6)
    stages.publish(spark, home)
    early = {r["title"] for r in TitleIndex(spark, home).seek(KEY).collect()}
    stages.build(spark, path, home)
    stages.publish(spark, home)
    whole = TitleIndex(spark, home)
    kept = whole.rows.where(F.col("title").isin(sorted(early))).count() == len(early) > 0
    return whole.seek(KEY).where(F.lit(kept))


@query(
    """with set_v as (select event_type || '-' || user_id % 500 as key, arg_max(props, event_id) as value from events where user_id % 500 < 400 group by 1),
    default_v as (select distinct event_type || '-' || user_id % 500 as key, 'default' as value from events)
    select key, coalesce(s.value, d.value) as value from default_v d full join set_v s using (key)"""
)
def build_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings in the order of events, added in two batches, over defaults for all keys."""
    path, key = f"{shared_dir(spark)}/properties-{uuid.uuid4().hex}", F.concat_ws("-", "event_type", F.col("user_id") % 500)
    rows = table(spark, sf_dir, "events").select(key.alias("key"), F.col("props").alias("value"), F.col("event_id").alias("seq"), "user_id")
    for late in (1, 0):
        stages.set_properties(rows.where((F.col("user_id") % 500 < 400) & (F.col("seq") % 2 == late)), path)
    return stages.properties(spark, path, rows.select("key", F.lit("default").alias("value")).distinct())


@query(
    f"""with {BLOCKS_SQL}, e as (select event_id % (select count(*) from pages) as block_no, cast(event_id % 3 as integer) as index_state, event_id as seq from events),
    l as (select block_no, arg_max(index_state, seq) as now from e group by 1)
    select step, block_no, block_start_bits, case step when 'after' then coalesce(a.now, index_state) else coalesce(l.now, index_state) end as index_state
    from blocks_v cross join (values ('during'), ('after')) s(step) left join l using (block_no)
    left join (select block_no, 2 as now from blocks_v where block_no % 5 = 0) f using (block_no)
    left join (select block_no, case when block_no % 5 = 0 then 2 else now end as now from blocks_v left join l using (block_no)) a using (block_no)"""
)
def state_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block states from three deltas, opened before a compaction and read after it; then from the new base with one more delta."""
    home, blocks = f"{shared_dir(spark)}/states-{uuid.uuid4().hex}", catalog(spark, sf_dir)
    n = table(spark, sf_dir, "pages").count()
    events = table(spark, sf_dir, "events").select((F.col("event_id") % n).alias("block_no"), (F.col("event_id") % 3).cast("int").alias("index_state"), F.col("event_id").alias("seq"))
    for i in range(3):
        states.append(events.where(F.col("seq") % 3 == i), home)
    during = states.catalog(blocks, home)
    states.compact(spark, home)
    states.append(blocks.where("block_no % 5 = 0").select("block_no", F.lit(2).alias("index_state"), F.lit(1 << 40).alias("seq")), home)
    after = states.catalog(blocks, home)
    return during.select(F.lit("during").alias("step"), "*").unionByName(after.select(F.lit("after").alias("step"), "*"))


@query(f"with {TITLES_SQL} select title from titles_v")
def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title index built by a stream of blocks, in several batches, by two runs while the dump grows."""
    return dumpsource.titles_so_far(spark, streamed(spark, sf_dir)[1]).select("title")


@query(f"with {TITLES_SQL} select true as several, true as blocks_once")
def stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More than three batches, which read each block of the dump once."""
    path, home = streamed(spark, sf_dir)
    n = B.find_blocks(spark, path).count()
    return dumpsource.batches(spark, home).agg((F.count(F.lit(1)) > 3).alias("several"), (F.sum("blocks") == n).alias("blocks_once"))


@query(f"with {TITLES_SQL} select title, title as fetched from titles_v where title >= 'C'")
def stream_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages fetched by the positions that the stream wrote, each with its index entry's title."""
    path, home = streamed(spark, sf_dir)
    found = B.fetch_markup(dumpsource.titles_so_far(spark, home).where("title >= 'C'"), path)
    return found.select("title", X.title_of(F.col("value")).alias("fetched"))


def streamed(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """A dump that is streamed while its second half is missing, grows, and is streamed to its end by another run; and the home of its index."""
    path = bz2_dump(spark, sf_dir)
    home, size = f"{path}-stream", P.ByteParts(path).size
    names = sorted(name for name, _ in snapshots.listed(spark, path) if name[0] not in "._")
    fs, later = snapshots.file_system(spark, f"{path}-later")
    fs.mkdirs(later)
    move = lambda name, a, b: fs.rename(snapshots.file_system(spark, f"{a}/{name}")[1], snapshots.file_system(spark, f"{b}/{name}")[1])
    for name in names[DUMP_FILES // 2 :]:
        move(name, path, f"{path}-later")
    for part in ([], names[DUMP_FILES // 2 :]):
        for name in part:
            move(name, f"{path}-later", path)
        query = dumpsource.index_growing(spark, path, home, size // 4)
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    return path, home


#: The rows of bz2_dump, each with where its page begins in the decoded dump.
SAFE = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
LAID_SQL = f"""row_v as (select page_id, title, page_id % 3 as kind, '<page><title>' || {SAFE.format("title")} || '</title>' as a, '<id>' || page_id || '</id>' as b,
        '<revision><id>' || page_id * 10 || '</id>' || case page_id % 3 when 0 then '<comment>note ' || page_id || '</comment>' when 1 then '<comment></comment>' else '' end
        || '<text>' || {SAFE.format("html")} || '</text></revision>' as c from raw_v join pages using (page_id)),
    laid_v as (select *, cast(coalesce(sum(strlen(a) + strlen(b) + strlen(c) + 8) over (order by page_id rows between unbounded preceding and 1 preceding), 0) as bigint) as page_pos from row_v)"""


def dump_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = bz2_dump(spark, sf_dir)
    return tags.dump_events(B.find_blocks(spark, path), path, group=4)  # several levels of the scan also for few blocks


@query(f"with {TITLES_SQL}, {LAID_SQL} select title, page_pos from laid_v")
def tag_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with the positions of their pages in the decoded dump, from blocks that are decoded alone."""
    return tags.title_events(dump_tags(spark, sf_dir)).select("title", "page_pos")


@query(f"with {TITLES_SQL}, {LAID_SQL} select page_pos from laid_v")
def tag_page_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.page_starts(dump_tags(spark, sf_dir)).select("page_pos")


@query(f"""with {TITLES_SQL}, {LAID_SQL} select page_pos, 'title' as name, page_pos + strlen(a) as stop from laid_v
    union all select page_pos, 'id', page_pos + strlen(a) + strlen(b) from laid_v union all select page_pos, 'revision', page_pos + strlen(a) + strlen(b) + strlen(c) from laid_v""")
def tag_child_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The children that each page closes, by where they end."""
    return tags.child_closes(dump_tags(spark, sf_dir)).select("page_pos", "name", "stop")


@query(f"""with {TITLES_SQL}, {LAID_SQL}
    select kind, cast(depth as bigint) as depth, count(*) as events from (
        select unnest(['start', 'start', 'start', 'start', 'start', 'start']) as kind, unnest([1, 2, 2, 2, 3, 3]) as depth from laid_v union all
        select unnest(['close', 'close', 'close', 'close', 'close', 'close']), unnest([0, 1, 1, 1, 2, 2]) from laid_v union all
        select unnest(['start', 'close']), unnest([3, 2]) from laid_v where kind < 2) group by 1, 2""")
def tag_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements opened and closed at each depth of the whole dump."""
    return dump_tags(spark, sf_dir).groupBy("kind", "depth").agg(F.count(F.lit(1)).alias("events"))


@query(f"""with m as (select doc_id, '<page><title>' || doc_id || '</title><text>' || {SAFE.format("text")} || '</text><origin lang="' || coalesce(lang, '') || '" source="' as a,
        coalesce(source, '') as s from documents)
    select doc_id, 'lang' as name, coalesce(lang, '') as value, cast(strlen(a) - 10 - strlen(coalesce(lang, '')) as bigint) as pos from m join documents using (doc_id)
    union all select doc_id, 'source', s, cast(strlen(a) as bigint) from m""")
def tag_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes at the end of each document, by position; each is a stream that is cut into pieces of 1000 bytes, wherever these end."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    said = lambda name: F.coalesce(F.col(name), F.lit(""))
    markup = F.concat(
        F.lit("<page><title>"), F.col("doc_id").cast("string"), F.lit("</title><text>"), safe(said("text")), F.lit('</text><origin lang="'), said("lang"), F.lit('" source="'), said("source"), F.lit('" /></page>')
    )
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stream"), markup.cast("binary").alias("whole"))
    cuts = F.sequence(F.lit(0), F.floor((F.octet_length("whole") - 1) / 1000).cast("int"))
    chunks = rows.select("stream", "whole", F.explode(cuts).alias("n")).select("stream", F.col("n").cast("bigint").alias("chunk"), F.substr("whole", F.col("n") * 1000 + 1, F.lit(1000)).alias("content"))
    found = tags.tag_events(chunks).where("kind = 'attribute'")
    return found.select(F.col("stream").alias("doc_id"), "name", "value", "pos")


@query(f"""with {TITLES_SQL} select observer, title, count(*) as told from raw_v cross join (values ('long'), ('short'), ('unsteady')) o(observer)
    where case observer when 'long' then length(title) >= 20 when 'short' then length(title) < 20 else true end group by observer, title""")
def stream_observers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three observers of a stream over the dump. One fails in the second batch, after it wrote that, which stops the stream; started again, it is told of each title once."""
    path = bz2_dump(spark, sf_dir)
    home, size, calls = f"{path}-observed", P.ByteParts(path).size, []
    told = {
        "long": into_folder(f"{home}/long", lambda rows: rows.where("length(title) >= 20").select("title")),
        "short": into_folder(f"{home}/short", lambda rows: rows.where("length(title) < 20").select("title")),
    }
    write = into_folder(f"{home}/unsteady", lambda rows: rows.where("title is not null").select("title"))

    def unsteady(rows: DataFrame, batch: int) -> None:
        calls.append(batch)
        write(rows, batch)
        if len(calls) == 2:
            raise ValueError("broken off")

    for _ in range(2):
        stream = dumpsource.index_growing(spark, path, f"{home}/index", size // 4, observers={"unsteady": unsteady, **told})
        try:
            stream.processAllAvailable()
        except StreamingQueryException as e:
            if "observers failed" not in str(e):
                raise
        finally:
            stream.stop()
    parts = [spark.read.parquet(f"{home}/{name}").select(F.lit(name).alias("observer"), "title") for name in ("long", "short", "unsteady")]
    again = F.lit(calls[1:3] == [calls[1]] * 2)  # the batch that was broken off was told once more
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where(again).groupBy("observer", "title").agg(F.count(F.lit(1)).alias("told"))
