"""One build at a time, and builds that can be cancelled.

A lease is a file that only one holder can create. It tells the holder and until when it holds; the holder writes it again as long as it works, so only a
build whose driver is gone is overtaken. Jobs of a holder carry a tag by which cancel() ends them; what they committed stays, and the next build goes on from there.
"""

from __future__ import annotations

import hashlib
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from lexshelf.sources.snapshots import file_system

SECONDS = 60.0


class Held(RuntimeError):
    """Someone else holds the lease."""


def tag_of(home: str) -> str:
    return f"build-{hashlib.md5(home.encode()).hexdigest()}"


def cancel(spark: SparkSession, home: str) -> None:
    """Ends the jobs of the build under home, in this application."""
    spark.sparkContext.cancelJobsWithTag(tag_of(home))


def _write(fs, path, owner: str, seconds: float, overwrite: bool) -> None:
    out = fs.create(path, overwrite)
    out.write(bytearray(f"{time.time() + seconds:.3f} {owner}".encode()))
    out.close()


def _read(fs, path) -> tuple[float, str]:
    """Until when it is held, and by whom; one that is just being written counts as held."""
    for _ in range(10):
        stream = fs.open(path)
        said = bytes(stream.readAllBytes()).decode().partition(" ")
        stream.close()
        if said[2]:
            break
        time.sleep(0.05)
    return (float(said[0]), said[2]) if said[2] else (fs.getFileStatus(path).getModificationTime() / 1000 + SECONDS, "someone")


def _taken(spark: SparkSession, fs, path, owner: str, seconds: float) -> bool:
    """Tries to create the lease; one that has run out is moved away first, which only one of several can do."""
    try:
        _write(fs, path, owner, seconds, False)
        return True
    except Py4JJavaError:
        if not fs.exists(path):
            return False
        until, holder = _read(fs, path)
        if until > time.time():
            raise Held(f"{path.toString()} is held by {holder} for {until - time.time():.0f} more seconds") from None
        aside = file_system(spark, f"{path.toString()}-{uuid.uuid4().hex}")[1]
        if fs.rename(path, aside):
            fs.delete(aside, False)
        return False


@contextmanager
def held(spark: SparkSession, home: str, owner: str = "", seconds: float = SECONDS, wait: float = 0.0) -> Iterator[str]:
    """Holds the lease of home while the block runs, and tags its jobs. Raises Held if another holds it for longer than wait seconds."""
    owner = f"{owner or spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"
    fs, path = file_system(spark, f"{home}/lease")
    fs.mkdirs(path.getParent())
    give_up = time.time() + wait
    while True:
        try:
            if _taken(spark, fs, path, owner, seconds):
                break
        except Held:
            if time.time() >= give_up:
                raise
        time.sleep(0.1)
    done = threading.Event()

    def renew() -> None:
        while not done.wait(seconds / 3):
            _write(fs, path, owner, seconds, True)

    beat = threading.Thread(target=renew, daemon=True)
    beat.start()
    spark.sparkContext.addJobTag(tag_of(home))
    try:
        yield owner
    finally:
        spark.sparkContext.removeJobTag(tag_of(home))
        done.set()
        beat.join()
        if fs.exists(path) and _read(fs, path)[1] == owner:
            fs.delete(path, False)
