"""Title search: seek, pattern, regular expression, lookup, page fetch, and routing of typed text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows shown by the console and by the search box, and the mark of a console search.
CONSOLE_ROWS, SEARCH_ROWS, SEEK_MARK = 20, 50, "###"


def capped(rows: DataFrame, most: int) -> DataFrame:
    """The first most rows by title; 0 is no limit."""
    ordered = rows.orderBy("title")
    return ordered.limit(most) if most else ordered


def seek(titles: DataFrame, key: str, most: int = SEARCH_ROWS) -> DataFrame:
    """Titles at or after key, in code-point order (Q1)."""
    return capped(titles.where(F.col("title") >= key).select("title"), most)


def seek_like(titles: DataFrame, pattern: str, most: int = SEARCH_ROWS, escape: str | None = None) -> DataFrame:
    """Titles like a SQL pattern (Q2); without an escape character, a backslash in the pattern is an ordinary one."""
    pattern, escape = (pattern, escape) if escape else (pattern.replace("\\", "\\\\"), "\\")
    return capped(titles.where(F.like("title", F.lit(pattern), F.lit(escape))).select("title"), most)


def seek_regexp(titles: DataFrame, pattern: str, most: int = SEARCH_ROWS) -> DataFrame:
    """Titles that a regular expression matches from end to end (L2)."""
    return capped(titles.where(F.col("title").rlike(rf"\A(?:{pattern})\z")).select("title"), most)


def lookup(titles: DataFrame, title: str | Column) -> DataFrame:
    """Block and position of a title; no row if it is unknown (S10, K-7)."""
    return titles.where(F.col("title") == title).select("block_start_bits", "title_start_pos").limit(1)


def fetch(pages: DataFrame, title: str | Column) -> DataFrame:
    """The page with that title; no row if it is unknown (Q3)."""
    return pages.where(F.col("title") == title).limit(1)


def routed(text: str | None, mode: str) -> tuple[str, str, int]:
    """(route, key, most rows): console text is a fetch unless marked as a seek; the search box tells patterns by their percent sign."""
    if mode == "console":
        return ("seek", text[len(SEEK_MARK) :], CONSOLE_ROWS) if text and text.startswith(SEEK_MARK) else ("fetch", text or "", 1)
    if not text:
        return "nothing", "", 0
    return ("like" if "%" in text else "seek"), text, SEARCH_ROWS


def search(titles: DataFrame, pages: DataFrame, text: str | None, mode: str = "search") -> DataFrame:
    route, key, most = routed(text, mode)
    if route == "fetch":
        return fetch(pages, key)
    if route == "nothing":
        return titles.select("title").limit(0)
    return seek_like(titles, key, most) if route == "like" else seek(titles, key, most)
