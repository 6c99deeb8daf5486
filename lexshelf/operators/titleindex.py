"""The published title index: sorted titles in small files with a zone map, and posting lists of trigrams for patterns.

A version holds four tables:
- sorted: the titles in order, at most ZONE_ROWS to a file;
- zones: file, least and greatest title and rows of each of these files;
- grams: gram and title, sorted by both, in folders by bucket of the gram;
- counts: bucket and rows of each gram, sorted by gram.

A seek opens the files that can hold its first rows, as the zones tell. A pattern is taken apart into the trigrams that a match must hold. Where its
rarest ones have fewer rows than the files that would have to be read otherwise, their posting lists are intersected and the titles in all of them are verified.
Otherwise the files in the range of its literal prefix are read in order, a few at first and more as long as too few matches are found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lexshelf.functions.patterns import Run, gram_column, grams_of, like_runs, prefix_range, regexp_runs
from lexshelf.operators.index import read_index, write_index
from lexshelf.operators.search import SEARCH_ROWS, capped, fetch, routed
from lexshelf.schemas import TITLES
from lexshelf.sources import snapshots

#: Titles of a file of the sorted index, rows of a bucket of posting lists (about), buckets at most, and lists that are intersected at most.
ZONE_ROWS, BUCKET_ROWS, MOST_BUCKETS, LISTS = 1 << 16, 1 << 22, 4096, 3
ZONES = "file string, least string, greatest string, n bigint"
GRAMS = "gram string, title string, bucket int"
COUNTS = "gram string, n bigint, bucket int"
#: Rows of a page of posting lists: Parquet's column index tells which pages may hold a gram, and only these are read.
PAGES, PAGE_ROWS = "parquet.page.row.count.limit", 512
#: Rows up to which a limit is planned from the zones.
PLANNED = 10_000


def publish(titles: DataFrame, home: str, partitions: int | None = None, zone_rows: int = ZONE_ROWS, bucket_rows: int = BUCKET_ROWS) -> str:
    """Writes a version of the index of titles (one row for each) under home, makes it the current one, and returns its folder.

    DataFrames that were opened on earlier versions still answer, until snapshots.vacuum removes these.
    """
    spark, version = titles.sparkSession, snapshots.new_version(home)
    write_index(titles, f"{version}/sorted", partitions, zone_rows)
    index = read_index(spark, f"{version}/sorted")
    zones = index.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min("title").alias("least"), F.max("title").alias("greatest"), F.count(F.lit(1)).alias("n"))
    zones.coalesce(1).sortWithinPartitions("least").write.parquet(f"{version}/zones")  # a row for each file
    each = index.select(F.explode(gram_column(F.col("title"))).alias("gram"), "title")
    counts = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counts.write.parquet(f"{version}/counted")
    counts = spark.read.schema("gram string, n bigint").parquet(f"{version}/counted")
    rows = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bucket = F.pmod(F.xxhash64("gram"), F.lit(min(max(rows // bucket_rows, 1), MOST_BUCKETS))).cast("int").alias("bucket")
    counts.select("*", bucket).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{version}/counts")
    # Ranges of gram and title cut the lists of very common trigrams.
    lists = each.select("gram", "title", bucket).repartitionByRange("bucket", "gram", "title").sortWithinPartitions("bucket", "gram", "title")
    lists.write.partitionBy("bucket").option("maxRecordsPerFile", bucket_rows).option(PAGES, PAGE_ROWS).parquet(f"{version}/grams")
    snapshots.publish(spark, home, version)
    return version


class TitleIndex:
    """A version of the index under home, the current one if none is said."""

    def __init__(self, spark: SparkSession, home: str, version: str | None = None) -> None:
        self.spark, self.version = spark, version or snapshots.current(spark, home)
        self.rows = self._table("sorted", TITLES)
        self.zones = self._table("zones", ZONES)
        self.grams = self._table("grams", GRAMS)
        self.counts = self._table("counts", COUNTS)

    def _table(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.version}/{name}")

    def _read(self, files: list[str]) -> DataFrame:
        """Titles of some files of the sorted index."""
        return self.spark.read.schema(TITLES).parquet(*(f"{self.version}/sorted/{f}" for f in files)) if files else self.spark.createDataFrame([], TITLES)

    def _zones_of(self, low: str, high: str | None, most: int | None = None) -> list:
        """file and n of the files that may hold titles from low on and before high, in order; the first most of them."""
        found = self.zones.where(F.col("greatest") >= low)
        found = (found if high is None else found.where(F.col("least") < high)).orderBy("least")
        return (found if most is None else found.limit(most)).select("file", "n").collect()  # names of files only

    def seek(self, key: str, most: int = SEARCH_ROWS) -> DataFrame:
        """The first most titles at or after key (Q1); 0 is all of them. Of the files, only those are opened that can hold these."""
        if not 0 < most <= PLANNED:
            return capped(self.rows.where(F.col("title") >= key).select("title"), most)
        files, sure = [], 0
        for i, zone in enumerate(self._zones_of(key, None, most + 1)):
            files.append(zone.file)
            sure += zone.n if i else 0  # the first file may begin before the key
            if sure >= most:
                break
        return capped(self._read(files).where(F.col("title") >= key).select("title"), most)

    def lookup(self, title: str) -> DataFrame:
        """Block and position of a title; no row if it is unknown."""
        zones = self.zones.where((F.col("least") <= title) & (F.col("greatest") >= title)).select("file").collect()  # at most one file
        return self._read([z.file for z in zones]).where(F.col("title") == title).select("block_start_bits", "title_start_pos").limit(1)

    def like(self, pattern: str, most: int = SEARCH_ROWS, escape: str | None = None) -> DataFrame:
        """Titles like a SQL pattern (Q2), as search.seek_like finds them."""
        shown, mark = (pattern, escape) if escape else (pattern.replace("\\", "\\\\"), "\\")
        return self._matches(like_runs(pattern, escape), F.like("title", F.lit(shown), F.lit(mark)), most)

    def regexp(self, pattern: str, most: int = SEARCH_ROWS) -> DataFrame:
        """Titles that a regular expression matches from end to end (L2)."""
        return self._matches(regexp_runs(pattern), F.col("title").rlike(rf"\A(?:{pattern})\z"), most)

    def search(self, pages: DataFrame, text: str | None, mode: str = "search") -> DataFrame:
        """What search.search finds, by this index."""
        route, key, most = routed(text, mode)
        if route == "fetch":
            return fetch(pages, key)
        if route == "nothing":
            return self.rows.select("title").limit(0)
        return self.like(key, most) if route == "like" else self.seek(key, most)

    def _matches(self, runs: list[Run], holds: Column, most: int) -> DataFrame:
        low, high = prefix_range(runs)
        inside = F.col("title") >= low
        inside = inside if high is None else inside & (F.col("title") < high)
        zones = self._zones_of(low, high)
        lists = self._rarest(grams_of(runs))
        if lists is not None:
            if lists and not lists[0].n:
                return self.rows.select("title").limit(0)
            in_files = sum(z.n for z in zones)
            # So many rows hold as many matches as are wanted, if every title in the rarest list is one.
            in_order = min(in_files, most * self._all_rows() // lists[0].n) if most else in_files
            if sum(x.n for x in lists) < in_order:
                return capped(self._intersected(lists).where(inside & holds), most)
        return self._in_order([z.file for z in zones], inside & holds, most)

    def _all_rows(self) -> int:
        return self.zones.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def _rarest(self, grams: set[str]) -> list | None:
        """gram, n and bucket of the LISTS rarest trigrams, the rarest first; n is 0 for one that no title holds. None without trigrams."""
        if not grams:
            return None
        known = {r.gram: r for r in self.counts.where(F.col("gram").isin(sorted(grams))).collect()}  # trigrams of one pattern
        missing = [Row(gram=g, n=0, bucket=0) for g in sorted(grams - known.keys())[:1]]
        return missing or sorted(known.values(), key=lambda r: (r.n, r.gram))[:LISTS]

    def _intersected(self, lists: list) -> DataFrame:
        """Titles that stand in all lists."""
        found = self.grams.where(F.col("bucket").isin(sorted({x.bucket for x in lists})) & F.col("gram").isin([x.gram for x in lists]))
        return found.groupBy("title").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(lists)).select("title")

    def _in_order(self, files: list[str], holds: Column, most: int) -> DataFrame:
        """Reads one file, then four times as many, and so on, until they hold enough."""
        n = 1
        while most and n < len(files) and self._read(files[:n]).where(holds).limit(most).count() < most:
            n *= 4
        return capped(self._read(files[:n] if most else files).where(holds).select("title"), most)
