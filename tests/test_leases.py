"""Leases of a build: one holder, renewal, overtaking, cancelling."""

from __future__ import annotations

import bz2
import threading
import time

import pytest
from pyspark.sql import functions as F

from lexshelf.plans import leases, stages


def test_one_holder(spark, tmp_path):
    home = str(tmp_path)
    with leases.held(spark, home, "first", 0.9):
        time.sleep(1.5)  # renewed meanwhile
        with pytest.raises(leases.Held, match="held by first"), leases.held(spark, home, "second"):
            pass
        waiting = threading.Thread(target=lambda: took.append(hold()))
        took: list[str] = []

        def hold() -> str:
            with leases.held(spark, home, "third", wait=30) as owner:
                return owner

        waiting.start()
        time.sleep(0.3)
        assert not took
    waiting.join()
    assert took[0].startswith("third") and not list(tmp_path.glob("lease*"))


def test_lost_holder_is_overtaken(spark, tmp_path):
    (tmp_path / "lease").write_text(f"{time.time() - 1:.3f} gone")
    with leases.held(spark, str(tmp_path), "next") as owner:
        assert (tmp_path / "lease").read_text().endswith(owner)
    (tmp_path / "lease").write_text("")  # just being written
    with pytest.raises(leases.Held), leases.held(spark, str(tmp_path)):
        pass


def test_cancelled_build_goes_on(spark, tmp_path):
    home, failed = str(tmp_path / "home"), []

    def slow() -> None:
        try:
            with leases.held(spark, home):
                spark.range(4).mapInPandas(lambda batches: (time.sleep(60) or b for b in batches), "id bigint").agg(F.sum("id")).collect()
        except Exception as e:
            failed.append(e)

    work = threading.Thread(target=slow)
    work.start()
    while not (tmp_path / "home" / "lease").exists():
        time.sleep(0.1)
    began = time.time()
    with pytest.raises(leases.Held):
        stages.build(spark, "nowhere", home)
    while work.is_alive() and time.time() - began < 50:
        leases.cancel(spark, home)
        work.join(0.5)
    assert len(failed) == 1 and time.time() - began < 50
    path = tmp_path / "d.bz2"
    path.write_bytes(bz2.compress(b"<page><title>A</title></page>"))
    assert stages.build(spark, str(path), home).first().complete and not (tmp_path / "home" / "lease").exists()
