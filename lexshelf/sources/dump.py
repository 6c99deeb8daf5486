"""Dumps as rows of pages: text split at ``</page>``, which Spark reads in parallel even from one .bz2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

END = "</page>"


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """value: text up to each ``</page>``. Page text escapes ``<``, so the mark is unambiguous."""
    return spark.read.option("lineSep", END).text(path)
