"""Every stage on a small corpus with clashing columns, against plain versions of its decision."""

from __future__ import annotations

import re
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from data import SCHEMA, documents  # noqa: E402

import corpus_pipeline  # noqa: E402
from lexshelf.llm import mixing, quality  # noqa: E402

#: Every name that the operators give to a column anywhere, and the struct of a row.
NAMES = sorted({n for p in Path(quality.__file__).parent.glob("*.py") for n in re.findall(r"""(?:alias|withColumn|withColumnRenamed)\([^"()]*"(\w+)"|"(\w+)": F\.""", p.read_text()) for n in n if n})
EXTRA = sorted({*NAMES, "secret_id", "secret_digest", "secret_row", "secret_cut", "secret_n", "near_row_key", "mix_hash", "mix_time", "mix_source", "mix_plan", "score_id", "score_text", "quality_score_of_row", "row_of_user", "cut_of_key", "cuts_of_key"} - {"doc_id", "text", "lang", "source", "n_chars", "key", "row", "size"})


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = documents(80)
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in EXTRA:
        docs = docs.withColumn(c, F.lit(f"mine {c}"))
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], 0 if r[0] == 103 else 1) for r in rows if r[0] is not None]
    spark.createDataFrame(labels, "doc_id bigint, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, sf_dir)
        last = i == len(corpus_pipeline.STAGES) - 1
        assert last or made.columns == docs.columns, name
        made.write.parquet(f"{tmp_path}/{i}")
        got = spark.read.parquet(f"{tmp_path}/{i}")
        before, after = docs.collect(), got.collect()
        assert last or len(EXTRA) > 60 and all(r[c] == f"mine {c}" for r in after for c in EXTRA), name
        if name == "quality classifier":
            w = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), usable=~corpus_pipeline.queries.held_out())
            assert len(after) == quality.score(docs, w).where("score >= 0.5").count() > 50
        elif name == "simhash near-dedup":
            def shingles(t):
                words = (t or "").lower().split()
                return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()

            sets = [shingles(r.text) for r in before]
            group = list(range(len(before)))
            for a in range(len(before)):
                for b in range(a):
                    x, y = sets[a], sets[b]
                    if group[a] != group[b] and (x == y or x and y and len(x & y) / len(x | y) >= 0.8):
                        p, q = group[a], group[b]
                        group = [p if g == q else g for g in group]
            least = {}
            for r, g in zip(before, group, strict=True):
                least[g] = min(least.get(g, (True, 0)), (r.doc_id is None, r.doc_id or 0))
            assert Counter((r.doc_id is None, r.doc_id or 0) for r in after) == Counter(least.values())
        elif name == "secret scans":
            clean = {r.doc_id: r.text for r in before}
            assert len(after) == len(before)
            some = re.compile("hunter2hunter2x|AKIA|[0-9a-f]{16}")
            assert all((r.text == clean[r.doc_id]) != bool(some.search(clean[r.doc_id] or "")) for r in after if len(r.text or "") < 1000)
        elif name == "mixing sources":
            times = {(r.doc_id, r.source): r.copies for r in mixing.mix(docs).collect()}
            assert Counter((r.doc_id, r.source) for r in after) == Counter({k: n for k, n in times.items() if n})
        else:
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
            assert Counter(r.doc_id for r in after if r.piece == 0) == Counter(r.doc_id for r in before)
        docs = got
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()
