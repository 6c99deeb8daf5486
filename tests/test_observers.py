"""Several observers of one stream."""

from __future__ import annotations

import pytest

from lexshelf.streaming.observers import Observers, into_folder


def test_one_that_fails_stops_none_and_is_told_again(spark, tmp_path):
    rows, heard, broken = spark.range(5), [], [True]

    def shaky(_, batch: int) -> None:
        heard.append(("shaky", batch))
        if broken[0]:
            raise ValueError("no disk")

    observers = {"first": into_folder(str(tmp_path / "first")), "shaky": shaky, "last": lambda _, batch: heard.append(("last", batch))}
    told = Observers(str(tmp_path / "told"), observers)
    with pytest.raises(ExceptionGroup, match="1 of 3 observers failed in batch 0") as e:
        told.tell(rows, 0)
    assert e.value.exceptions[0].__notes__ == ["observer shaky, batch 0"]
    broken[0] = False
    again = Observers(str(tmp_path / "told"), {**observers, "late": lambda _, batch: heard.append(("late", batch))})
    again.tell(rows, 0)
    again.tell(rows, 1)
    assert heard == [("shaky", 0), ("last", 0), ("shaky", 0), ("late", 0), ("shaky", 1), ("last", 1), ("late", 1)]
    assert spark.read.parquet(str(tmp_path / "first")).groupBy("batch").count().orderBy("batch").collect() == [(0, 5), (1, 5)]


def test_names(tmp_path):
    with pytest.raises(ValueError, match="names of observers"):
        Observers(str(tmp_path), {"../x": print})
