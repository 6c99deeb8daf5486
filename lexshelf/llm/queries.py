"""The queries opN_<name>, thin layers over the operators, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshelf.llm import chat, fingerprint, hyperminhash, knn, lexical, mixing, packing, quality, secrets, simhash, suffix, warc, yinyang
from lexshelf.llm.common import table


def vocabulary() -> str:
    """The vocabulary file of op5_pack; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.k < len(secrets.KINDS))
    count = lambda k: F.size(F.filter("spans", lambda s: s.k == k)).cast("long")
    return found.select(
        "doc_id", *(count(i).alias(f"n_{name}") for i, (name, *_) in enumerate(secrets.KINDS)),
        F.sha2(secrets.text_of_spans(base), 256).alias("base_sha256"), secrets.text_of_spans(F.col("spans")).alias("spans"),
        *(F.array_join(F.transform("spans", lambda s: s[name].cast("string")), ",").alias(name) for name in ("owners", "repositories", "live")),
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.dedup(table(spark, sf_dir, "documents"))


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = quality.fit(docs, table(spark, sf_dir, "labels"), usable=~held_out())
    scored = quality.score(docs, weights)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op9_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    turn = F.col("id").alias("turn")
    extra = spark.range(2).select(F.lit(-7).alias("conv_id"), turn, F.when(turn == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    extra = extra.select(*(F.col(c).cast(rows.schema[c].dataType) for c in rows.columns))
    return chat.digests(chat.format_conversations(rows.unionByName(extra)))


def op11_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = yinyang.fit(table(spark, sf_dir, "embeddings"))
    named = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    digests = spark.createDataFrame(named, "cluster int, centroid_sha256 string")  # a row for each centroid
    return yinyang.summed(assigned).join(F.broadcast(digests), "cluster")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top_k(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.dedup(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_suffix_dedup, op2_secret_scan, op3_fingerprints, op4_mix_sources, op5_pack, op6_simhash_dedup, op7_quality, op8_warc, op9_knn_join, op10_chat_format, op11_yinyang, op12_lexical_search, op13_hyperminhash)
}

WORD_SQL = r"[^\x20\x09-\x0D]+"


def spans_sql(kind: int, pattern: str, group: int, least: int) -> str:
    """Rows (doc_id, start, k, stop, value) of one kind: offsets come from the pieces between matches."""
    quoted = pattern.replace("'", "''")
    return f"""
        select doc_id, start, {kind} as k, start + length(whole[i]) as stop, value[i] as value from (
            select *, cast(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) as bigint) as start
            from (select *, unnest(range(1, len(whole) + 1)) as i from (
                select doc_id, string_split_regex(coalesce(text, ''), '{quoted}') as gaps, regexp_extract_all(coalesce(text, ''), '{quoted}', 0) as whole,
                       regexp_extract_all(coalesce(text, ''), '{quoted}', {group}) as value
                from documents where regexp_matches(coalesce(text, ''), '{quoted}'))))
        where length(value[i]) >= {least}"""


#: The base patterns as the contract has them, with the group that is judged and its least length.
BASE = [(secrets.ASSIGN, 2, 12), ("AKIA[A-Z0-9]+", 0, 18), ("[0-9a-f]+", 0, 16)]
SECRETS_SQL = f"""
    with base as ({" union all ".join(spans_sql(i, *kind) for i, kind in enumerate(BASE))}),
    wide as (select * from ({spans_sql(3, secrets.WIDE, 0, 20)}) w where regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]')
             and not exists (select 1 from base b where b.doc_id = w.doc_id and b.start < w.stop and w.start < b.stop)),
    every as (select * from base union all select * from wide),
    held as (select value, count(distinct coalesce(source, '')) as owners, count(distinct concat_ws('/', source, lang)) as repositories
             from every join documents using (doc_id) group by value),
    shown as (select e.*, owners, repositories, owners <= {secrets.MOST_OWNERS} and repositories <= {secrets.MOST_REPOSITORIES} as live from every e join held using (value) where k < 3 or owners <= {secrets.MOST_OWNERS} and repositories <= {secrets.MOST_REPOSITORIES}),
    named as (select *, (['assign', 'access', 'hex', 'owned'])[k + 1] || ':' || start || ':' || stop as span from shown),
    by_doc as (select doc_id, count(*) filter (k = 0) as n_assign, count(*) filter (k = 1) as n_access, count(*) filter (k = 2) as n_hex,
                      string_agg(span, ',' order by start, k) filter (k < 3) as base, string_agg(span, ',' order by start, k, stop) as spans,
                      string_agg(cast(owners as varchar), ',' order by start, k, stop) as owners, string_agg(cast(repositories as varchar), ',' order by start, k, stop) as repositories,
                      string_agg(cast(live as varchar), ',' order by start, k, stop) as live from named group by doc_id)
    select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
           coalesce(owners, '') as owners, coalesce(repositories, '') as repositories, coalesce(live, '') as live
    from documents left join by_doc using (doc_id)
"""

MIX_SQL = f"""
    with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{WORD_SQL}')) as bigint) as size, substring(md5(concat(coalesce(cast(doc_id as varchar), ''), ':', coalesce(text, ''))), 1, 12) as h from documents),
    by_source as (select source, cast(sum(size) as bigint) as s from d group by source),
    weighed as (select *, ([5, 2, 1])[(row_number() over (order by source nulls last) - 1) % 3 + 1] as w from by_source),
    ordered as (select *, coalesce(3 * sum(s) over o, 0) as capped, coalesce(sum(w) over o, 0) as gone, sum(s) over () as total, sum(w) over () as weights
                from weighed window o as (order by s / w, source nulls last rows between unbounded preceding and 1 preceding)),
    judged as (select *, 3 * s * (weights - gone) <= w * (total - capped) as is_capped from ordered),
    free as (select coalesce(sum(3 * s) filter (is_capped), 0) as c, coalesce(sum(w) filter (is_capped), 0) as g from judged),
    planned as (select source, s as source_size, case when is_capped then cast(3 * s as double) else cast(w * (total - c) as double) / cast(weights - g as double) end as target from judged, free),
    needed as (select *, case when source_size = 0 then 0 else least(floor(target / source_size), 3) end as times from planned),
    summed as (select source, h, sum(n) over (partition by source order by h) as full_, sum(n) over (partition by source order by h) - n as base
               from (select source, h, sum(size) as n from d group by source, h)),
    edges as (select n.source, min(h) as edge, min_by(abs(full_ - need) < abs(base - need), h) as takes_edge
              from (select *, target - times * source_size as need from needed) n join summed x on x.source is not distinct from n.source where need > 0 and full_ >= need group by n.source)
    select d.doc_id, d.size, n.source_size, n.target, cast(d.size * (times + case when d.h < edge or d.h = edge and takes_edge then 1 else 0 end) as bigint) as taken
    from d join needed n on n.source is not distinct from d.source left join edges e on e.source is not distinct from d.source
"""


def escape_sql(column: str, codes: list[tuple[str, str]]) -> str:
    for raw, code in codes:
        raw = "chr(10)" if raw == "\n" else f"'{raw}'"
        column = f"replace({column}, {raw}, '{code}')"
    return column


CHAT_SQL = f"""
    with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
               union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    e as (select *, {escape_sql("role", chat.ROLE_CODES)} as r, {escape_sql("text", chat.CODES)} as x from t),
    o as (select *, role is distinct from lag(role) over w as head, role is distinct from lead(role) over w as tail from e
          window w as (partition by conv_id order by turn nulls first, r, x))
    select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, r, x)) as turns_sha256,
           cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
           sha256(coalesce(string_agg(text, '' order by turn nulls first, r, x) filter (role = 'assistant'), '')) as loss_sha256,
           cast(sum(case when head then {len(chat.OPEN) + 1} + length(r) else {len(chat.SEP)} end + length(x) + case when tail then {len(chat.CLOSE)} else 0 end) as bigint) as formatted_chars
    from o group by conv_id
"""

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQUARED_SQL = "cast(list_sum(list_transform(list_zip(v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint)"


def cluster_sql(rounds: int = 3) -> str:
    parts = [
        """e as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(64 * x::double) as bigint)) as v from embeddings
            where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        "c0 as (select row_number() over (order by h) - 1 as c, v as w from (select sha256('1:' || vec_id) as h, v from e order by h limit 16))",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} as (select r, any_value(vec_id) as vec_id, any_value(v) as v, min({{'d': {SQUARED_SQL}, 'c': c}}) as best from e, c{i} group by r)")
        if i < rounds:
            parts.append(f"m{i} as (select best.c as c, i, sum(v[i]) as s, count(*) as n from a{i}, range(1, 65) t(i) group by best.c, i)")
            parts.append(f"n{i} as (select c, list(cast((s - ((s % n) + n) % n) / n as bigint) order by i) as w from m{i} group by c)")
            parts.append(f"c{i + 1} as (select c, coalesce(n{i}.w, c{i}.w) as w from c{i} left join n{i} using (c))")
    return f"""with {", ".join(parts)}
        select vec_id, cast(best.c as integer) as cluster, best.d as distance, cast(sum(best.d) over (partition by best.c) as bigint) as cluster_inertia,
               cast(sum(best.d) over () as bigint) as inertia, sha256(array_to_string(w, ',')) as centroid_sha256
        from a{rounds} join c{rounds} on c = best.c"""


TERM_SQL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LEXICAL_SQL = f"""
    with t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '{TERM_SQL}') as ts from documents),
    d as (select doc_id, len(ts) as n from t where len(ts) > 0),
    s as (select count(*) as big_n, cast(sum(n) as bigint) as big_l from d),
    p as (select doc_id, term, count(*) as tf from (select doc_id, unnest(ts) as term from t) group by all),
    f as (select term, count(*) as df from p group by term),
    i as (select item_id, term, count(*) as times from (
        select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '{TERM_SQL}')) as term from benchmark) group by all),
    m as (select item_id, doc_id, cast(sum(times * cast(floor(1000 * ln(cast(2 * big_n + 2 as double) / cast(2 * df + 1 as double))) as bigint)
                                        * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l)))) as bigint) as score
          from i join f using (term) join p using (term) join d using (doc_id), s group by all),
    r as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from m where score > 0)
    select * from r where rank <= 10
"""

HYPER_SQL = f"""
    with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '{WORD_SQL}') as ws from documents),
    s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
                              else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end as sh from w),
    u as (select doc_id, len(sh) as n, unnest(sh) as x from s),
    c as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as m, any_value(b.n) as n, count(*) as k from u a join u b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
    e as (select a, b from c where 100 * k >= 85 * (m + n - k)),
    reach(doc_id, other) as (select doc_id, doc_id from s union select r.doc_id, e.b from reach r join e on r.other = e.a)
    select doc_id, cast(len(sh) as bigint) as n_shingles, least_id as component_id, doc_id = least_id as kept
    from s join (select doc_id, min(other) as least_id from reach group by doc_id) using (doc_id)
"""

ORACLES: dict[str, str] = {
    "op11_yinyang": cluster_sql(),
    "op12_lexical_search": LEXICAL_SQL,
    "op13_hyperminhash": HYPER_SQL,
    "op2_secret_scan": SECRETS_SQL,
    "op4_mix_sources": MIX_SQL,
    "op10_chat_format": CHAT_SQL,
    "op8_warc": """
        with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
        r as (select payload_digest, max(page_id) as response from p where payload_bytes >= 1000 group by 1 having count(*) > 1)
        select page_id, payload_bytes, p.payload_digest,
               case when response is null or response = page_id then 'response' else 'revisit' end as record_type,
               case when response <> page_id then response end as refers_to
        from p left join r on p.payload_digest = r.payload_digest and payload_bytes >= 1000
    """,
    "op9_knn_join": """
        with e as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * x::double) as bigint)) as v from embeddings
                   where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as query_id, d.vec_id, cast(list_sum(list_transform(list_zip(q.v, d.v), lambda z: z[1] * z[2])) as bigint) as score
              from e q, e d where q.vec_id % 100 = 0 and d.vec_id <> q.vec_id),
        r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 10
    """,
}
