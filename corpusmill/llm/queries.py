"""The ten operators' queries, each over its whole table with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontaminate, html, language_model, minhash, packing, quality, storage, substrings, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    storage.bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.weigh(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bm25_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op4_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_induced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_importance": op1_importance,
    "op2_bm25_leaks": op2_bm25_leaks,
    "op3_gated_lm": op3_gated_lm,
    "op4_rotated_codes": op4_rotated_codes,
    "op5_minhash": op5_minhash,
    "op6_html": op6_html,
    "op7_warc": op7_warc,
    "op8_induced": op8_induced,
    "op9_toxicity": op9_toxicity,
    "op10_packing": op10_packing,
}

#: Sets, pairs and components by plain joins.
_NEAR = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, b AS o FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.o = e.a),
m AS (SELECT doc_id, min(o) AS o FROM r GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(o, doc_id)) AS component_id, coalesce(doc_id <= o, true) AS kept FROM n LEFT JOIN m USING (doc_id)
"""

#: Base32 digits of a SHA-1 are those of its four parts of 40 bits.
_ARCHIVED = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM d GROUP BY h)
SELECT page_id, n AS payload_bytes,
translate(to_base(('0x' || substr(h, 1, 10))::BIGINT, 32, 8) || to_base(('0x' || substr(h, 11, 10))::BIGINT, 32, 8) || to_base(('0x' || substr(h, 21, 10))::BIGINT, 32, 8) || to_base(('0x' || substr(h, 31, 10))::BIGINT, 32, 8), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN f USING (h)
"""

#: All strings of 50 bytes as hexadecimal text; runs of removed bytes by their first and last strings.
_REPEATED = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 49)) AS pos FROM d WHERE len(x) >= 100),
k AS (SELECT doc_id, pos, substr(x, 2 * pos + 1, 100) AS k FROM s),
f AS (SELECT k, min(doc_id) AS first FROM k GROUP BY k HAVING min(doc_id) < max(doc_id)),
g AS (SELECT doc_id, pos FROM k JOIN f USING (k) WHERE doc_id > first),
o AS (SELECT *, lag(pos) OVER w AS before, lead(pos) OVER w AS after FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
u AS (SELECT doc_id, CAST(sum(least(50, coalesce(after - pos, 50))) AS BIGINT) AS n_removed, count(*) FILTER (WHERE before IS NULL OR pos > before + 50) AS n_spans FROM o GROUP BY doc_id),
i AS (SELECT doc_id, pos AS lo, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM o WHERE before IS NULL OR pos > before + 50),
z AS (SELECT doc_id, pos + 50 AS hi, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM o WHERE after IS NULL OR after > pos + 50),
y AS (SELECT doc_id, lo, row_number() OVER (PARTITION BY doc_id ORDER BY lo) AS r FROM i),
v AS (SELECT y.doc_id, y.r, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY y.doc_id ORDER BY y.r) AS was FROM y JOIN z ON y.doc_id = z.doc_id AND y.r = z.r),
t AS (SELECT v.doc_id, string_agg(substr(x, 2 * was + 1, 2 * (lo - was)), '' ORDER BY r) || substr(any_value(x), 2 * max(hi) + 1) AS kept FROM v JOIN d USING (doc_id) GROUP BY v.doc_id)
SELECT doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN u USING (doc_id) LEFT JOIN t USING (doc_id)
"""

#: The others depend on trained models, samples or programs that SQL has no words for; tests compare them with brute force.
ORACLE_SQL: dict[str, str] = {"op5_minhash": _NEAR, "op7_warc": _ARCHIVED, "op8_induced": _REPEATED}
