"""Page extraction (P1-P8) from rows of sources.dump."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexshelf.functions.text import title_of
from lexshelf.schemas import PAGES, conform

PAGE = "title string, id bigint, revision array<struct<id: bigint, comment: string, text: string>>"
#: Text as it stands: no trimming, and only an absent element is null.
XML_OPTIONS = {"rowTag": "page", "ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE", "nullValue": "\u0000"}


def page_markup(value: Column) -> Column:
    """The page element of a row, null where there is none; attributes of the page tag are allowed."""
    body = F.regexp_extract(value, r"(?s)<page(?:\s[^>]*)?>.*", 0)
    return F.when(body != "", F.concat(body, F.lit("</page>")))


def last_of(revisions: Column, field: str) -> Column:
    """The last value of a field over all revisions: an empty element counts, an absent one does not."""
    return F.try_element_at(F.filter(F.transform(revisions, lambda r: r[field]), lambda x: x.isNotNull()), F.lit(-1))


def parse_pages(rows: DataFrame, value: str = "value") -> DataFrame:
    """page rows; pages that are no well-formed XML, or have no title, are left out (see broken_pages)."""
    p = F.from_xml(page_markup(F.col(value)), PAGE, XML_OPTIONS)
    pages = rows.select(p.alias("p")).where("p.title is not null")
    r = F.col("p.revision")
    return conform(pages.select("p.title", "p.id", last_of(r, "id").alias("rev_id"), last_of(r, "comment").alias("comment"), last_of(r, "text").alias("text")), PAGES)


def broken_pages(rows: DataFrame, value: str = "value") -> DataFrame:
    """Rows whose page could not be parsed or has no title."""
    markup = page_markup(F.col(value))
    return rows.where(markup.isNotNull() & F.from_xml(markup, PAGE, XML_OPTIONS)["title"].isNull())


def titles_of(rows: DataFrame, value: str = "value") -> DataFrame:
    """title of each page, without parsing it all."""
    return rows.select(title_of(F.regexp_extract(F.col(value), r"(?s)<page[\s>].*", 0)).alias("title")).where("title is not null")
