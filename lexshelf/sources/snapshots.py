"""Versions of a table set: written in a folder of their own, published at once, removed later.

A version's files never change. Publishing adds one empty file to a log, whose name holds a rising number and the version's name; the
greatest name is the version that readers open. That is one create in any file system, so a reader sees a whole version or the one before, and two
publishers at a time each publish their own whole version: the greater name wins for every reader.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import SparkSession

from lexshelf.shared import removed

LOG, VERSIONS = "published", "versions"


def file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def listed(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """Name and time of change (seconds) of what lies in a folder; nothing if there is none."""
    fs, hadoop = file_system(spark, path)
    return [(f.getPath().getName(), f.getModificationTime() / 1000) for f in fs.listStatus(hadoop)] if fs.exists(hadoop) else []


def new_version(home: str) -> str:
    """A folder to write a version in."""
    return f"{home}/{VERSIONS}/{uuid.uuid4().hex}"


def publish(spark: SparkSession, home: str, version: str) -> None:
    """Makes a version that is fully written the one that readers open from now on."""
    last = max((int(name.split("-")[0]) for name, _ in listed(spark, f"{home}/{LOG}")), default=0)
    fs, marker = file_system(spark, f"{home}/{LOG}/{last + 1:012d}-{version.rpartition('/')[2]}")
    fs.create(marker, False).close()


def history(spark: SparkSession, home: str) -> list[str]:
    """Folders of the published versions, the current one first."""
    names = sorted((name for name, _ in listed(spark, f"{home}/{LOG}")), reverse=True)
    return [f"{home}/{VERSIONS}/{name.partition('-')[2]}" for name in names]


def current(spark: SparkSession, home: str) -> str:
    found = history(spark, home)
    if not found:
        raise ValueError(f"nothing is published in {home}")
    return found[0]


def vacuum(spark: SparkSession, home: str, keep: int = 2, least_age: float = 86_400) -> list[str]:
    """Removes versions that are neither among the newest keep nor younger than least_age seconds, with those that were never finished; returns their folders.

    A version leaves the log before its files go, so no reader can begin on it.
    """
    kept, before = set(history(spark, home)[: max(keep, 1)]), time.time() - least_age
    gone = [f"{home}/{VERSIONS}/{name}" for name, changed in listed(spark, f"{home}/{VERSIONS}") if changed <= before]
    gone = [folder for folder in gone if folder not in kept]
    for name, _ in listed(spark, f"{home}/{LOG}"):
        if f"{home}/{VERSIONS}/{name.partition('-')[2]}" in gone:
            removed(spark, f"{home}/{LOG}/{name}")
    for folder in gone:
        removed(spark, folder)
    return gone
