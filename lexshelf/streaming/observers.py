"""Several observers of one stream's batches (R5), each told of every batch once, whatever becomes of the others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from lexshelf.shared import there
from lexshelf.sources import snapshots

Observer = Callable[[DataFrame, int], None]


class Observers:
    """Named observers, and a folder that remembers of which batches each was told.

    tell() calls them one after the other with the batch's rows, which should be a written table, and its number. One that fails stops none of
    the others. In the end the failures are raised together, so the stream stops and repeats the batch when it is started again: then only those are told that
    had failed. An observer that breaks off half way is told again, so what it writes for a batch must replace what it wrote before (into_folder does). One that
    is added later hears of the batches from then on. Names are parts of paths: letters, digits, - and _.
    """

    def __init__(self, home: str, observers: dict[str, Observer]) -> None:
        if odd := [name for name in observers if not name.replace("-", "").replace("_", "").isalnum()]:
            raise ValueError(f"names of observers hold other characters than letters, digits, - and _: {odd}")
        self.home, self.observers = home, dict(observers)

    def tell(self, rows: DataFrame, batch: int) -> None:
        failed = []
        for name, observer in self.observers.items():
            mark = f"{self.home}/{name}/{batch}"
            if there(rows.sparkSession, mark):
                continue
            try:
                observer(rows, batch)
            except Exception as e:  # raised below, when all have been told
                e.add_note(f"observer {name}, batch {batch}")
                failed.append(e)
            else:
                fs, path = snapshots.file_system(rows.sparkSession, mark)
                fs.create(path, True).close()
        if failed:
            raise ExceptionGroup(f"{len(failed)} of {len(self.observers)} observers failed in batch {batch}", failed)


def into_folder(path: str, change: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Observer:
    """An observer that writes each batch, changed, into a folder of its own, which a repeated one replaces; spark.read.parquet(path) has all of them."""

    def write(rows: DataFrame, batch: int) -> None:
        change(rows).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write
