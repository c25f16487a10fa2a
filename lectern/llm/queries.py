"""Registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontamination,
    embedding_dedup,
    fingerprints,
    interactions,
    language_id,
    layout,
    line_dedup,
    minhash,
    packing,
    quality,
    secrets,
    suffix_dedup,
    token_counts,
)
from .common import sha256_hex, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_lines",
        "n_dropped",
        F.length("text").cast("long").alias("n_kept_chars"),
        sha256_hex(F.coalesce("text", F.lit(""))).alias("kept_sha256"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.importance_resampling(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(
        table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken")
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(~language_id.held_out()))
    return language_id.identify(docs, model).select(
        "doc_id", F.coalesce(language_id.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "spans"
    )


def op11_clustered_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.clustered_layout(table(spark, sf_dir, "documents"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP5_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (
""" + "\nUNION ALL\n".join(
    f"SELECT doc_id, {o} AS ord, '{k}' AS kind, {least} AS least, regexp_extract_all(text, {p}, 0) AS whole, regexp_extract_all(text, "
    f"{p}, {g}) AS own, string_split_regex(text, {p}) AS gaps FROM d WHERE regexp_matches(text, {p})"
    for o, k, p, g, least in (
        (0, "assign", """'(?i)(password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)'""", 2, 6),
        (1, "access", "'AKIA[A-Z0-9]+'", 0, 20), (2, "hex", "'[0-9a-f]+'", 0, 24), (3, "pem", "'-----BEGIN [A-Z ]*PRIVATE KEY-----'", 0, 1),
        (4, "github", "'gh[pousr]_[A-Za-z0-9]+'", 0, 40), (5, "jwt", "'eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+'", 0, 30),
    )
) + """),
u AS (SELECT doc_id, ord, kind, least, unnest(range(1, len(whole) + 1)) AS i, unnest(list_transform(whole, lambda x: length(x))) AS w, unnest(list_transform(own, lambda x: length(x))) AS o, unnest(list_transform(gaps[1:len(whole)], lambda x: length(x))) AS g FROM m),
p AS (SELECT *, sum(w + g) OVER (PARTITION BY doc_id, ord ORDER BY i) AS e FROM u),
k AS (SELECT doc_id, ord, kind, CAST(e - w AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM p WHERE o >= least),
a AS (SELECT doc_id, count_if(ord = 0) AS n_assign, count_if(ord = 1) AS n_access, count_if(ord = 2) AS n_hex,
  string_agg(CASE WHEN ord < 3 THEN kind || ':' || s || ':' || e END, ',' ORDER BY s, ord) AS base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""

OP6_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 13) AS m, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) AS win FROM b WHERE len(w) > 0),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS i, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS win FROM d, ms WHERE len(w) >= m),
f AS (SELECT DISTINCT doc_id, i, m, item_id FROM dw JOIN bw USING (m, win)),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM f) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM f GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

OP11_SQL = """
WITH t AS (SELECT list(CAST(c AS BIGINT) ORDER BY i) AS t FROM (SELECT i, list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, i) AS c FROM (SELECT unnest(range(0, 256)) AS i))),
d AS (SELECT doc_id, source, lang, coalesce(strlen(text), -1) AS length,
  xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 365 AS date FROM documents, t),
r AS (SELECT doc_id, 8 * (rank() OVER (ORDER BY source NULLS FIRST) - 1) // count(*) OVER () AS s, 8 * (rank() OVER (ORDER BY lang NULLS FIRST) - 1) // count(*) OVER () AS g,
  8 * (rank() OVER (ORDER BY length) - 1) // count(*) OVER () AS l, 8 * (rank() OVER (ORDER BY date) - 1) // count(*) OVER () AS d FROM d),
z AS (SELECT *, (d >> 2 & 1) * 2048 + (l >> 2 & 1) * 1024 + (g >> 2 & 1) * 512 + (s >> 2 & 1) * 256 + (d >> 1 & 1) * 128 + (l >> 1 & 1) * 64 + (g >> 1 & 1) * 32 + (s >> 1 & 1) * 16 + (d & 1) * 8 + (l & 1) * 4 + (g & 1) * 2 + (s & 1) AS z FROM r),
p AS (SELECT *, row_number() OVER (ORDER BY z, doc_id) - 1 AS position FROM z), q AS (SELECT *, position // 2000 AS file FROM p),
f AS (SELECT file, min(s) AS s0, max(s) AS s1, min(g) AS g0, max(g) AS g1, min(l) AS l0, max(l) AS l1, min(d) AS d0, max(d) AS d1 FROM q GROUP BY file),
c AS (SELECT DISTINCT s, g, l, d FROM q),
n AS (SELECT c.*, count(*) AS touched FROM c JOIN f ON s BETWEEN s0 AND s1 AND g BETWEEN g0 AND g1 AND l0 <= l + 1 AND l1 >= l - 1 AND d0 <= d + 1 AND d1 >= d - 1 GROUP BY ALL),
cf AS (SELECT DISTINCT s, g, l, d, file FROM q),
m AS (SELECT c.s, c.g, c.l, c.d, count(DISTINCT file) AS matching FROM c JOIN cf ON c.s = cf.s AND c.g = cf.g AND abs(c.l - cf.l) <= 1 AND abs(c.d - cf.d) <= 1 GROUP BY ALL)
SELECT doc_id, CAST(z AS BIGINT) AS z, position, file, touched AS files_touched, matching AS files_matching, concat_ws(',', s0, s1, g0, g1, l0, l1, d0, d1) AS file_bounds
FROM q JOIN f USING (file) JOIN n USING (s, g, l, d) JOIN m USING (s, g, l, d)
"""

OP12_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS k, vec_id, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS e FROM embeddings),
p AS (SELECT a.k AS a, b.k AS b FROM v a JOIN v b ON a.k <> b.k AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(k, o) AS (SELECT k, k FROM v UNION SELECT r.k, p.b FROM r JOIN p ON p.a = r.o),
c AS (SELECT r.k, min(o.vec_id) AS component_id FROM r JOIN v o ON o.k = r.o GROUP BY r.k), n AS (SELECT a AS k, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c USING (k) LEFT JOIN n USING (k)
"""

OP13_SQL = """
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text),
  regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), FALSE)] AS fails FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
h AS (SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM m GROUP BY part, fails),
f AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, f.i AS step, o[f.i] AS own, o[1:f.i - 1] AS earlier FROM o, f),
j AS (SELECT part, o, step, own, n, good, toxic, fails[own] AS x, len(list_filter(earlier, lambda y: fails[y])) > 0 AS gone, len(list_filter(fails, lambda y: y)) AS failing FROM h, s),
g AS (SELECT part, o, step, own, sum(CASE WHEN NOT x AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN x AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN x AND gone THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN x AND failing = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN x AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN x AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM j GROUP BY part, o, step, own)
SELECT part, array_to_string(list_transform(o, lambda y: substr('ABCDE', y, 1)), '') AS filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM g
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_suffix_dedup,
        op2_fingerprints,
        op3_line_dedup,
        op4_quality,
        op5_secrets,
        op6_decontamination,
        op7_near_duplicates,
        op8_token_counts,
        op9_packing,
        op10_language_id,
        op11_clustered_layout,
        op12_embedding_near_dedup,
        op13_filter_interactions,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_secrets": OP5_SQL,
        "op6_decontamination": OP6_SQL,
        "op11_clustered_layout": OP11_SQL,
        "op12_embedding_near_dedup": OP12_SQL,
        "op13_filter_interactions": OP13_SQL,
    }
