"""Queries over the article corpus: cleaning, chunking, sampling, budgets, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import metrics as M
from corpusmill.operators import sampling as S
from corpusmill.plans.common import Register, inline, table, values
from corpusmill.sources import files

query = Register()
QUERIES, ORACLE_SQL = query.queries, query.sql
_BLANKS = r" ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || '　"


#: Where the first piece of a paragraph's rest ends: after the last sentence end of a full window, or with it.
_CUT = "CASE WHEN length(rest) > 400 THEN coalesce(nullif(length(regexp_extract(left(rest, 400), '(?s)^(.*[。！？；.!?])', 1)), 0), 400) ELSE length(rest) END"
#: Plain text of Markdown.  RE2 can't look behind, so runs of stars stand aside (as \\x02) while single ones go in pairs.
_PLAIN = r"regexp_replace(text, '(?m)^#{1,6}\s*', '', 'g')"
for _mark, _by in ((r"\*\*(.*?)\*\*", r"\1"), (r"\*\*\*", "\x02\x02\x02"), (r"\*\*", "\x02\x02"), (r"\x02\*", "\x02\x02"), (r"\*(.*?)\*", r"\1"), (r"\x02", "*"), (r"_(.*?)_", r"\1"), (r"\n{2,}", "\n")):
    _PLAIN = f"regexp_replace({_PLAIN}, '{_mark}', '{_by}', 'g')"
#: Chunks (doc_id, nth, chunk): one recursion cuts paragraphs, another packs the pieces.
_CHUNKS = rf"""WITH RECURSIVE t AS (SELECT doc_id, lang, string_split(trim({_PLAIN}, '{_BLANKS}'), chr(10)) AS lines FROM documents WHERE text <> ''),
p AS (SELECT doc_id, i AS para, trim(lines[i], '{_BLANKS}') AS x FROM t, unnest(range(1, len(lines) + 1)) AS u(i)),
c AS (SELECT doc_id, para, 0 AS n, '' AS piece, x AS rest FROM p WHERE x <> '' UNION ALL SELECT doc_id, para, n + 1, trim(left(rest, {_CUT}), '{_BLANKS}'), substr(rest, {_CUT} + 1) FROM c WHERE rest <> ''),
q AS (SELECT doc_id, piece, row_number() OVER (PARTITION BY doc_id ORDER BY para, n) AS r FROM c WHERE piece <> ''),
k AS (SELECT doc_id, r, piece AS held, NULL::VARCHAR AS done FROM q WHERE r = 1 UNION ALL SELECT k.doc_id, q.r, CASE WHEN length(held) + 1 + length(piece) <= 400 THEN held || chr(10) || piece ELSE piece END, CASE WHEN length(held) + 1 + length(piece) <= 400 THEN NULL ELSE held END FROM k JOIN q ON q.doc_id = k.doc_id AND q.r = k.r + 1),
h AS (SELECT doc_id, r, done AS chunk FROM k WHERE done IS NOT NULL UNION ALL SELECT doc_id, max(r) + 1, arg_max(held, r) FROM k GROUP BY doc_id),
g AS (SELECT doc_id, chunk, row_number() OVER (PARTITION BY doc_id ORDER BY r) - 1 AS nth FROM h WHERE length(chunk) >= 150) """


def _chunks(text: str):
    return T.chunk_native(T.markdown_to_plain(text), 400, 150, "。！？；.!?")


@query(_CHUNKS + "SELECT lang, count(DISTINCT t.doc_id) AS articles, count(*) FILTER (WHERE chunk IS NULL) AS skipped, count(chunk) AS chunks, CAST(coalesce(sum(length(chunk)), 0) AS BIGINT) AS chars FROM t LEFT JOIN g USING (doc_id) GROUP BY lang")
def corpus_chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of at most 400 and at least 150 characters by language."""
    docs = table(spark, sf_dir, "documents").where("text <> ''")
    chunks = docs.select("lang", _chunks("text").alias("chunks"))
    rows = chunks.select("lang", F.size("chunks").alias("n"), F.aggregate("chunks", F.lit(0), lambda a, x: a + F.length(x)).alias("chars"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("articles"), F.count_if(F.col("n") == 0).alias("skipped"), F.sum("n").alias("chunks"), F.sum("chars").alias("chars"))


@query(f"SELECT doc_id, trim({_PLAIN}, '{_BLANKS}') AS plain FROM documents")
def md_clean_full(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.markdown_to_plain("text").alias("plain"))


@query(rf"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\*\*(.*?)\*\*', '\1', 'g'), '\n{{2,}}', chr(10), 'g'), '{_BLANKS}') AS plain FROM documents WHERE contains(text, '**')")
def md_clean_bold(spark, sf_dir):
    bold = F.regexp_replace("text", r"(?d)\*\*(.*?)\*\*", "$1")
    return table(spark, sf_dir, "documents").where(F.col("text").contains("**")).select("doc_id", T.utrim(F.regexp_replace(bold, r"\n{2,}", "\n")).alias("plain"))


@query(f"SELECT lang, count(*) AS articles, count(*) FILTER (WHERE text IS NULL OR text = '') AS empty, count(*) FILTER (WHERE length(trim(text, '{_BLANKS}')) < 150) AS skipped FROM documents GROUP BY lang")
def empty_article_skip(spark, sf_dir):
    short = F.length(T.utrim("text")) < 150
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("articles"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("empty"), F.count_if(short).alias("skipped"))


@query(f"SELECT length(p) // 100 AS bucket, count(*) AS paragraphs, max(length(p)) AS longest FROM (SELECT trim(unnest(string_split(text, chr(10))), '{_BLANKS}') AS p FROM documents) WHERE p <> '' GROUP BY 1")
def long_paragraph_hist(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.explode(T.paragraphs("text")).alias("p"))
    return rows.groupBy(F.floor(F.length("p") / 100).alias("bucket")).agg(F.count(F.lit(1)).alias("paragraphs"), F.max(F.length("p")).cast("long").alias("longest"))


@query("SELECT lang, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang")
def utf8_bytes_by_lang(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.length("text")).alias("chars"))


@query(
    "SELECT doc_id, bytes, before AS bytes_before FROM (SELECT doc_id, bytes, CAST(coalesce(sum(bytes) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before "
    "FROM (SELECT doc_id, octet_length(encode(text)) AS bytes, sha256('824:' || doc_id) AS k FROM documents)) WHERE before < 500000"
)
def byte_budget_prefix(spark, sf_dir):
    return S.byte_budget(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"), 500_000, 824, "doc_id").select("doc_id", "bytes", "bytes_before")


def _ranks(seed: int) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256('{seed}:' || source || ':' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents"


@query(f"SELECT source, doc_id, r <= greatest(1, round_even(n * 0.25::DOUBLE, 0)) AS held_out FROM ({_ranks(42)})")
def stratified_holdout(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    return S.stratified_holdout(docs, "source", 0.25, 42, "doc_id").select("source", "doc_id", "held_out")


_PRACTICE = "SELECT source, doc_id FROM ({}) WHERE r <= least(greatest(10, ceil(n * 0.1::DOUBLE)), n)"


@query(_PRACTICE.format(_ranks(7)))
def practice_sample(spark, sf_dir):
    return S.stratified_sample(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", 0.1, 10, 7, "doc_id")


@query(
    f"WITH p AS ({_PRACTICE.format(_ranks(7))}), pool AS (SELECT * FROM documents WHERE sha256(trim(text, '{_BLANKS}')) NOT IN (SELECT sha256(trim(text, '{_BLANKS}')) FROM documents JOIN p USING (doc_id))) "
    f"{_PRACTICE.format(_ranks(11).replace('FROM documents', 'FROM pool'))}"
)
def grading_sample_disjoint(spark, sf_dir):
    """A sample of what the practice sample has no text of."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.sha2(T.utrim("text").cast("binary"), 256).alias("key"))
    practice = S.stratified_sample(docs, "source", 0.1, 10, 7, "doc_id")
    pool = docs.join(practice.select("key").distinct(), "key", "left_anti")
    return S.stratified_sample(pool, "source", 0.1, 10, 11, "doc_id").select("source", "doc_id")


@query(f"SELECT doc_id FROM documents WHERE substr(sha256('42:' || doc_id), 1, 8) < '{int(0.3 * 2**32):08x}'")
def bernoulli_sample(spark, sf_dir):
    return S.bernoulli(table(spark, sf_dir, "documents").select("doc_id"), 0.3, 42, "doc_id")


@query("SELECT conv_id, turn FROM conversations, (SELECT least(1, 100.0::DOUBLE / count(*)) AS f FROM conversations) WHERE ('0x' || substr(sha256('5:' || conv_id || ':' || turn), 1, 8))::BIGINT < floor(f * 4294967296::DOUBLE)")
def calibrated_sample_n(spark, sf_dir):
    return S.calibrated(table(spark, sf_dir, "conversations").select("conv_id", "turn"), 100, 5, "conv_id", "turn")


@query("SELECT item_id FROM benchmark ORDER BY sha256('3:' || item_id), item_id LIMIT 12")
def fixed_sample_n(spark, sf_dir):
    return S.fixed(table(spark, sf_dir, "benchmark").select("item_id"), 12, 3, "item_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY sha256('42:' || doc_id)) - 1 AS position FROM documents")
def seeded_shuffle_rank(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return S.numbered(docs.withColumn("k", S.order_key(42, "doc_id")), "k").select("doc_id", "position")


@query("SELECT doc_id, position, position // 32 AS batch_id FROM (SELECT doc_id, row_number() OVER (ORDER BY sha256('45:' || doc_id)) - 1 AS position FROM documents)")
def batch_epoch_ids(spark, sf_dir):
    return S.batches(table(spark, sf_dir, "documents").select("doc_id"), 32, 42, 3, "doc_id")


@query("SELECT 'documents' AS origin, text FROM documents WHERE text <> '' UNION ALL SELECT 'conversations', text FROM conversations WHERE text <> ''")
def union_merge_corpora(spark, sf_dir):
    part = lambda n: table(spark, sf_dir, n).where("text <> ''").select(F.lit(n).alias("origin"), "text")
    return files.merged(part("documents"), part("conversations"))


@query("SELECT doc_id, lang, NULL::BIGINT AS item_id, text FROM documents UNION ALL SELECT NULL, NULL, item_id, text FROM benchmark")
def union_heterogeneous(spark, sf_dir):
    return files.merged(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


@query("SELECT json_valid(props) AS good, count(*) AS lines FROM (SELECT props FROM events UNION ALL SELECT props || '}' FROM events WHERE event_id % 7 = 0) GROUP BY 1")
def jsonl_parse_bad_count(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    both = events.select("props").unionByName(events.where("event_id % 7 = 0").select(F.concat("props", F.lit("}")).alias("props")))
    return both.groupBy(T.is_json("props").alias("good")).agg(F.count(F.lit(1)).alias("lines"))


@query("SELECT event_id, CASE event_id % 4 WHEN 1 THEN event_type WHEN 2 THEN event_type || '{' WHEN 3 THEN event_type END AS text FROM events")
def text_or_json_fallback(spark, sf_dir):
    """Objects without the field, objects with it, lines that aren't JSON, and JSON strings."""
    e, kind = F.col("event_id") % 4, F.col("event_type")
    line = F.when(e == 0, F.col("props")).when(e == 1, F.concat(F.lit('{"text": "'), kind, F.lit('"}'))).when(e == 2, F.concat(kind, F.lit("{"))).otherwise(F.concat(F.lit('"'), kind, F.lit('"')))
    return table(spark, sf_dir, "events").select("event_id", T.text_or_json(line).alias("text"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN event_type ELSE 'first ' || event_type END AS text FROM events")
def sniffed_text(spark, sf_dir):
    e, kind = F.col("event_id") % 3, F.col("event_type")
    line = F.when(e == 0, F.col("props")).when(e == 1, F.concat(F.lit('{"text": "'), kind, F.lit('"}'))).otherwise(F.concat(F.lit('{"conversations": [{"content": "first '), kind, F.lit('"}, {"content": "x"}], "text": "y"}')))
    return table(spark, sf_dir, "events").select("event_id", T.sniffed_text(line).alias("text"))


_SCRIPT = {"国": "國", "学": "學", "说": "說", "话": "話", "软": "軟", "体": "體"}
_PHRASES = {"软件": "軟體", "信息": "資訊", "国": "國", "学": "學"}
_SIMPLIFIED = [(1, "国学说话", "國學說話", "國學说话"), (2, "软件信息学", "軟件信息學", "軟體資訊學"), (3, "", "", "")]


@query(f"SELECT id, by_character, by_phrase FROM {values('id, s, by_character, by_phrase', _SIMPLIFIED)}")
def script_translate(spark, sf_dir):
    rows = inline(spark, "id int, s string, c string, p string", _SIMPLIFIED)
    return rows.select("id", T.translate_characters("s", _SCRIPT).alias("by_character"), T.translate_phrases_udf(_PHRASES)("s").alias("by_phrase"))


_JSON = [(1, '{"a": ["国", {"国": "学"}], "n": 1}', '{"a": ["國", {"国": "學"}], "n": 1}'), (2, "{", None)]


@query(f"SELECT id, out FROM {values('id, line, out', _JSON)}")
def json_string_map(spark, sf_dir):
    return inline(spark, "id int, line string, want string", _JSON).select("id", T.translate_json_udf(_SCRIPT)("line").alias("out"))


@query("SELECT c AS letter, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY 1 ORDER BY n DESC, c LIMIT 50")
def char_frequency_topk(spark, sf_dir):
    letters = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "")).alias("letter")).where("letter <> ''")
    return letters.groupBy("letter").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "letter").limit(50)


@query(
    "SELECT lang, CAST(sum(t) AS BIGINT) AS tokens, CAST(sum(c) AS BIGINT) AS chars, round(sum(t) / sum(c)::DOUBLE, 9) AS ratio, round(avg(t / c::DOUBLE), 9) AS mean_ratio FROM (SELECT lang, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS t, length(text) AS c FROM documents) WHERE c > 0 GROUP BY lang"
)
def tokens_per_char(spark, sf_dir):
    tokens = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    rows = table(spark, sf_dir, "documents").select("lang", tokens.alias("t"), F.length("text").alias("c")).where("c > 0")
    return rows.groupBy("lang").agg(F.sum("t").alias("tokens"), F.sum("c").alias("chars"), F.round(F.sum("t") / F.sum("c"), 9).alias("ratio"), F.round(F.avg(F.col("t") / F.col("c")), 9).alias("mean_ratio"))


@query("WITH c AS (SELECT c, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY 1 ORDER BY n DESC, c LIMIT 2000) SELECT count(*) AS letters, count(*) FILTER (WHERE NOT (ascii(c) BETWEEN 32 AND 126)) AS uncovered, CAST(sum(n) AS BIGINT) AS n FROM c")
def vocabulary_coverage(spark, sf_dir):
    """Of the most frequent characters, those that a vocabulary (here: printable ASCII) lacks."""
    letters = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "")).alias("letter")).where("letter <> ''")
    top = letters.groupBy("letter").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "letter").limit(2000)
    vocabulary = spark.range(32, 127).select(F.char("id").alias("letter"), F.lit(True).alias("known"))
    return top.join(F.broadcast(vocabulary), "letter", "left").agg(F.count(F.lit(1)).alias("letters"), F.count_if(F.col("known").isNull()).alias("uncovered"), F.sum("n").alias("n"))


@query(
    "WITH l AS (SELECT DISTINCT trim(unnest(string_split(text, chr(10)))) AS line, doc_id % 2 AS side FROM documents), a AS (SELECT line FROM l WHERE side = 0 AND line <> ''), b AS (SELECT line FROM l WHERE side = 1 AND line <> '') "
    "SELECT (SELECT count(*) FROM b) AS test_lines, (SELECT count(*) FROM b WHERE line IN (SELECT line FROM a)) AS shared, round((SELECT avg(CAST(line IN (SELECT line FROM a) AS INT)) FROM b), 9) AS ratio"
)
def contamination_ratio(spark, sf_dir):
    """Which share of distinct lines of one half the other half has as well."""
    lines = table(spark, sf_dir, "documents").select((F.col("doc_id") % 2).alias("side"), F.explode(F.transform(F.split("text", "\n"), F.trim)).alias("line")).where("line <> ''").distinct()
    seen = lines.where("side = 0").select("line", F.lit(1).alias("seen"))
    rows = lines.where("side = 1").join(seen, "line", "left").select(F.coalesce("seen", F.lit(0)).alias("seen"))
    return rows.agg(F.count(F.lit(1)).alias("test_lines"), F.sum("seen").alias("shared"), F.round(F.avg("seen"), 9).alias("ratio"))


@query(
    "WITH s AS (SELECT nationkey, sum(ok) AS ok, count(*) AS n, sum(ok) / count(*)::DOUBLE AS a FROM (SELECT c_nationkey AS nationkey, CAST(c_acctbal > 0 AS INT) AS ok FROM customer) GROUP BY 1), c AS (SELECT n_regionkey, avg(a) AS m FROM s JOIN nation ON n_nationkey = nationkey GROUP BY 1) "
    "SELECT round((SELECT avg(m) FROM c), 9) AS macro, round(sum(ok) / sum(n)::DOUBLE, 9) AS micro, CAST(sum(n) AS BIGINT) AS n, round(sqrt((sum(ok) / sum(n)::DOUBLE) * (1 - sum(ok) / sum(n)::DOUBLE) / sum(n)), 9) AS stderr FROM s"
)
def subject_macro_micro(spark, sf_dir):
    """Nations stand for subjects, regions for categories."""
    rows = M.subject_accuracy(table(spark, sf_dir, "customer"), "c_nationkey", F.col("c_acctbal") > 0)
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    out = M.macro_micro(rows.join(nation, "c_nationkey"), "n_regionkey")
    return out.select(F.round("macro", 9).alias("macro"), F.round("micro", 9).alias("micro"), "n", F.round("stderr", 9).alias("stderr"))


@query("SELECT lang AS type, round(avg(quality), 9) AS accuracy, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def per_type_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("type")), "doc_id")
    return M.type_accuracy(rows, "type", F.col("quality") == 1).withColumn("accuracy", F.round("accuracy", 9))


@query("SELECT doc_id, len(t) AS tokens, len(t) > 64 AS truncated, t[greatest(len(t) - 63, 1)] AS first_kept FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS t FROM documents)")
def truncate_keep_end(spark, sf_dir):
    from corpusmill.operators.prompts import keep_last_tokens

    tokens = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    rows = table(spark, sf_dir, "documents").select("doc_id", tokens.alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("tokens"), (F.size("t") > 64).alias("truncated"), F.get(keep_last_tokens("t", 64), F.lit(0)).alias("first_kept"))


_JSON_LINE = """'{"text":' || to_json(chunk)::VARCHAR || '}'"""


@query(
    _CHUNKS + "SELECT doc_id, nth, line, bytes, before AS bytes_before FROM (SELECT *, CAST(coalesce(sum(bytes) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before "
    f"FROM (SELECT doc_id, nth, {_JSON_LINE} AS line, octet_length(encode({_JSON_LINE})) + 1 AS bytes, sha256('824:' || doc_id || ':' || nth) AS o FROM g)) WHERE before < 1048576"
)
def corpus_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all articles as lines of JSON, with their place in a seeded order and bytes before them."""
    docs = table(spark, sf_dir, "documents").where("text <> ''")
    # the outer form, since for the other one Spark cuts every text once more to look for those without chunks
    chunks = docs.select("doc_id", F.posexplode_outer(_chunks("text")).alias("nth", "text")).where("text is not null")
    line = files.json_text("text")
    return S.byte_budget(chunks.withColumn("line", line), F.concat("line", F.lit("\n")), 1 << 20, 824, "doc_id", "nth").select("doc_id", F.col("nth").cast("long").alias("nth"), "line", "bytes", "bytes_before")
