"""Ranked lexical search: postings joined with the items' terms, integer scores, the best documents of each item.

Postings (term, row, id, n, tf) hold a row for each term that a document has. They are dealt by document, so that all postings of a document, whatever their
terms, are in one task: items' terms meet them there by a hash join on the term, and the scores of an item and document are summed without
a shuffle. Only the best documents of each task and item move. (Buckets of terms alone would move a row for each match: some 230 million on half
a GB of documents, five times as many as there are pairs of an item and a document.)

Two passes over the documents' terms are needed, as a score depends on how many documents hold a term: the first writes each document's terms and tells
N, L and df; the second scores. Terms that no item holds are left out where their list is small enough to be shared; where it is not, the join does the same.

Defined cases: a null or empty text has no term; such documents are never found and count neither for N nor for L; such items find nothing; each row is a
document or an item of its own, also where ids repeat; a null id comes last among equal scores; an empty table on either side gives no rows; texts are read
whole in the memory of one task; columns that are not named are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexshelf.llm.common import join_cut, tasks_for, text_of, written

#: Bytes that belong to terms are digits, letters and all that is beyond ASCII; A-Z become a-z, all others part terms.
TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
#: Rows and bytes of items' terms up to which all tasks have them whole, and documents of a task.
MOST_ROWS, MOST_BYTES, TASK_ROWS = 500_000, 16 << 20, 4096


def counted(rows: DataFrame, id: str, text: str, only: set[bytes] | None = None) -> DataFrame:
    """row, id, n (terms, repeats counted) and found, the distinct terms (of those in only, if it is given) with tf."""
    spark, kind = rows.sparkSession, dict(rows.dtypes)[id]
    shared = spark.sparkContext.broadcast(only) if only is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value if shared is not None else None
        for b in batches:
            sizes, edges, terms, tf = [], [0], [], []
            for t in b.column(2).cast(pa.binary()):
                words = t.as_py().translate(TERM_BYTES).split()
                times = Counter(words)
                kept = times.keys() if wanted is None else times.keys() & wanted
                sizes.append(len(words))
                terms += kept
                tf += [times[w] for w in kept]
                edges.append(len(terms))
            each = pa.StructArray.from_arrays([pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tf, pa.int64())], names=["term", "tf"])
            found = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), each)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(sizes, pa.int64()), found], names=["row", "id", "n", "found"])

    named = rows.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), text_of(text).alias("text"))
    return named.mapInArrow(run, f"row bigint, id {kind}, n bigint, found array<struct<term: string, tf: bigint>>")


def postings(forward: DataFrame, n_docs: int) -> DataFrame:
    """term, row, id, n, tf of written counts, all of a document in one task."""
    dealt = forward.where(F.size("found") > 0).repartition(tasks_for(forward, n_docs, TASK_ROWS), "row")
    return dealt.select("row", "id", "n", F.explode("found").alias("f")).select("f.term", "row", "id", "n", "f.tf")


def weight(docs: int, df: Column) -> Column:
    """How much a term tells: floor(1000 ln((2N + 2) / (2 df + 1)))."""
    return F.floor(1000 * F.ln(F.lit(float(2 * docs + 2)) / (2 * df + 1).cast("double"))).cast("bigint")


def score(weight: Column, tf: Column, n: Column, docs: int, terms: int) -> Column:
    """A term's share of a document's score, in 64-bit integers: long documents need a term more often."""
    length = F.lit(25).cast("bigint") + F.call_function("div", 75 * n * F.lit(docs).cast("bigint"), F.lit(terms).cast("bigint"))
    return weight * F.call_function("div", F.lit(1_000_000_000).cast("bigint") * tf, 1000 * tf + 8 * length)


def top_k(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = 10) -> DataFrame:
    """item, rank (from 1), id and score of each item's k best documents with a score above 0."""
    asked = written(counted(items, item, item_text).select(F.col("row").alias("item"), F.col("id").alias("item_of"), F.explode("found").alias("f")).select("item", "item_of", "f.term", F.col("f.tf").alias("times")), "lexical-items")
    vocabulary = asked.select("term").distinct()
    n_asked, bytes_asked = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    is_small = n_asked <= MOST_ROWS and bytes_asked <= MOST_BYTES
    only = {r.term.encode() for r in vocabulary.collect()} if is_small else None
    forward = written(counted(docs, id, text, only), "lexical-terms")
    n_docs, n_terms, n_rows = forward.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    each = forward.select(F.explode("found").alias("f")).groupBy("f.term").agg(F.count(F.lit(1)).alias("n"))
    df = written(each.join(vocabulary, "term", "left_semi") if only is None else each, "lexical-df")
    wanted = asked.join(df, "term").select("item", "item_of", "term", (weight(n_docs, F.col("n")) * F.col("times")).alias("weight"))
    wanted = written(wanted, "lexical-weights")
    named = wanted.select("item", "item_of").distinct()
    few, every = wanted.select("item", "term", "weight"), postings(forward, n_rows)
    met = every.join(F.broadcast(few), "term") if is_small else join_cut(every, few, df, ["term"], ["row"])
    scored = met.groupBy("item", "row", "id").agg(F.sum(score(F.col("weight"), F.col("tf"), F.col("n"), n_docs, max(n_terms, 1))).alias("score")).where("score > 0")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    best = written(scored.select("item", "row", "id", "score", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k), "lexical-best")
    return best.join(named, "item").select(F.col("item_of").alias(item), "rank", F.col("id").alias(id), "score")
