"""Queries over dialogues: what is remembered, what is retrieved, how contexts are judged, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import memory as R
from corpusmill.operators import metrics as M
from corpusmill.operators import prompts as P
from corpusmill.plans.common import Register, inline, table, values

query = Register()
QUERIES, ORACLE_SQL = query.queries, query.sql
ABSTAIN = "你沒有提過"


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("persona_id"), F.col("turn").alias("pos"), "text")


@query("SELECT conv_id AS qid, right(string_agg(text, chr(10) ORDER BY turn), 300) AS context FROM conversations GROUP BY conv_id")
def recent_context_300(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    asked = turns.select("persona_id").distinct().withColumn("qid", F.col("persona_id"))
    return R.recent(turns, asked)


_GRAMS = "list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2)))"


@query(
    "WITH n AS (SELECT count(DISTINCT conv_id) AS n FROM conversations), q AS (SELECT item_id AS qid, item_id % n AS p, text AS question FROM benchmark, n), "
    f"s AS (SELECT qid, turn, text, len(list_intersect({_GRAMS.format('question')}, {_GRAMS.format('text')})) AS score FROM q JOIN conversations ON conv_id = p), "
    "w AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY qid ORDER BY score DESC, turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM s WHERE score > 0) "
    "SELECT qid, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE used <= 1200), '') AS context FROM q LEFT JOIN w USING (qid) GROUP BY qid"
)
def keyword_retrieval(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    n = turns.select("persona_id").distinct().count()
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), (F.col("item_id") % n).alias("persona_id"), F.col("text").alias("question"))
    return R.keyword(turns, asked, 1200)


@query(r"SELECT source AS persona_id, line AS text, max(doc_id) AS pos FROM (SELECT source, doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE line <> '' AND NOT (regexp_matches(line, '[？?]$') AND NOT regexp_matches(line, '[，,。；]')) GROUP BY ALL")
def memory_dedupe_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("persona_id"), F.col("doc_id").alias("pos"), F.explode(T.paragraphs("text")).alias("text")).distinct()
    return R.ingest(rows).select("persona_id", "text", "pos")


@query("SELECT conv_id, turn, regexp_matches(text, '[？?]$') AND NOT regexp_matches(text, '[，,。；]') AS asks FROM conversations")
def question_filter(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_question("text").alias("asks"))


@query("SELECT conv_id, turn, turn % 3 = 1 AS other FROM conversations WHERE text IS NOT NULL")
def about_other_flag(spark, sf_dir):
    """Every third turn is told of a friend; the others are one's own, though some name a friend later on."""
    turn = F.col("turn") % 3
    said = F.when(turn == 1, F.concat(F.lit("聽說我朋友"), "text")).when(turn == 2, F.concat("text", F.lit("我跟朋友"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", R.about_other(said).alias("other"))


_TOPICS = {"city": (("住", "城市"), ("住", "家在", "台南", "嘉義")), "job": (("工作", "職業"), ("工作", "上班", "師"))}
_TOLD = [(1, 0, "我家在嘉義"), (1, 1, "我朋友住高雄"), (1, 2, "晚餐不知道要吃什麼"), (1, 3, "我是一名老師"), (1, 4, "我女兒5歲，兒子8歲"), (1, 5, "我住哪裡？"), (1, 6, "我女兒今年6歲了"), (2, 0, "我每個月房租12000元"), (2, 1, "房東漲價，現在要15000元"), (2, 2, "我有２個兄弟姊妹")]
_ASKED = [
    (1, 1, "我住在哪裡？", "我家在嘉義"),
    (2, 1, "我朋友住哪裡？", "我朋友住高雄"),
    (3, 1, "我的職業是什麼？", "我是一名老師"),
    (4, 1, "女兒和兒子加起來幾歲？", "計算結果：14歲"),
    (5, 1, "我兒子明年幾歲？", "計算結果：9歲"),
    (6, 1, "我女兒還有幾年成年？", "計算結果：12年"),
    (7, 2, "我一年房租多少？", "計算結果：180000元"),
    (8, 2, "我家連我總共幾個兄弟姊妹？", "計算結果：3個"),
    (9, 2, "我養什麼寵物？", ""),
    (10, 1, "我女兒和兒子差幾歲？", "計算結果：2歲"),
]


#: Questions that want a number worked out; a lexicon of the caller's, like the topics.
_RULES = (
    R.Rule("siblings", (("兄弟姊妹", "手足"), ("連我", "總共")), ("女兒", "兒子", "租"), 1, "個"),
    R.Rule("rent", (("租",), ("一年", "每年")), (), 12, "元"),
    R.Rule("until", (("女兒",), ("成年",)), ("兒子",), r"(\d+)\s*歲", "年", 18),
    R.Rule("later", (("兒子",), ("明年", "後年")), ("女兒",), ((("後年",), 2),), "歲", 1),
    R.Rule("apart", (("女兒",), ("兒子",), ("差",)), (), 0, "歲"),
    R.Rule("together", (("女兒",), ("兒子",), ("加起來", "總共")), (), 0, "歲"),
)


def _dialogue(spark):
    told = inline(spark, "persona_id int, pos int, text string", _TOLD)
    return R.ingest(told), inline(spark, "qid int, persona_id int, question string, want string", _ASKED).drop("want")


@query(f"SELECT qid, context FROM {values('qid, persona_id, question, context', _ASKED)}")
def query_expansion_retrieval(spark, sf_dir):
    memory, asked = _dialogue(spark)
    return R.retrieve(memory, asked, _TOPICS, _RULES)


@query(f"SELECT qid, CASE WHEN context LIKE '計算%' THEN context END AS answer FROM {values('qid, persona_id, question, context', _ASKED)}")
def calc_answer(spark, sf_dir):
    return R.computed(*_dialogue(spark), _RULES)


_FACTS = [(1, "daughter", 6), (1, "son", 8), (2, "rent", 15000), (2, "siblings", 2)]


@query(f"SELECT persona_id, fact, value FROM {values('persona_id, fact, value', _FACTS)}")
def numeric_fact_latest(spark, sf_dir):
    return R.latest_facts(_dialogue(spark)[0]).select("persona_id", F.explode("facts").alias("fact", "value"))


@query("SELECT user_id, arg_max(CAST(json_extract_string(props, '$.k') AS BIGINT), (ts, event_id)) AS k FROM events GROUP BY user_id")
def event_fact_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.struct("ts", "event_id").alias("at"))
    return rows.groupBy("user_id").agg(F.max_by("k", "at").alias("k"))


@query("SELECT conv_id AS qid, string_agg(text, chr(10) ORDER BY turn) AS context FROM conversations WHERE turn % 2 = 0 GROUP BY conv_id")
def oracle_context(spark, sf_dir):
    """Evidence: the even turns."""
    turns = _turns(spark, sf_dir)
    asked = turns.where("pos % 2 = 0").groupBy("persona_id").agg(F.array_sort(F.collect_list("pos")).alias("evidence")).withColumn("qid", F.col("persona_id"))
    return R.oracle(turns, asked)


_OPTIONS = [(1, 1, "嘉義", "高雄", "台南", ABSTAIN, "B"), (2, 1, "住基隆", "貓", "狗", ABSTAIN, "D"), (3, 1, "老師", "兒子", "女兒", "吃", "C"), (4, 2, "甲", "乙", "丙", "丁", "A")]


@query(f"SELECT qid, guess FROM {values('qid, persona_id, a, b, c, d, guess', _OPTIONS)}")
def last_mention(spark, sf_dir):
    turns = inline(spark, "persona_id int, pos int, text string", _TOLD)
    rows = inline(spark, "qid int, persona_id int, a string, b string, c string, d string, w string", _OPTIONS)
    options = F.create_map(*[x for k in "ABCD" for x in (F.lit(k), F.col(k.lower()))])
    return R.last_mention(rows.withColumn("options", options), turns, ABSTAIN)


_JUDGED = [
    ("single", "甲\n乙", "甲=fact;丙=other", "甲", True, "x"),
    ("abstain", "", "", "", True, "x"),
    ("single", "丙說x", "丙說x=other", "甲", False, "x"),
    ("update", "丁", "丁=update", "丁", True, "y"),
]


@query("SELECT 4::BIGINT AS n, 2 / 3::DOUBLE AS evidence_recall, 0.25::DOUBLE AS small_talk_share, 1.75::DOUBLE AS context_chars, 1::DOUBLE AS abstain_empty_share, 0.25::DOUBLE AS other_people_share, 2::BIGINT AS correct_with_evidence, 0::BIGINT AS correct_without_evidence, 1::BIGINT AS picks_other")
def context_quality(spark, sf_dir):
    rows = inline(spark, "type string, context string, l string, e string, correct boolean, pred_text string", _JUDGED)
    split = lambda c, by: F.filter(F.split(c, by), lambda x: x != "")
    labels = F.map_from_entries(F.transform(split("l", ";"), lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)).alias("k"), F.split_part(x, F.lit("="), F.lit(2)).alias("v"))))
    return M.context_quality(rows.withColumn("labels", labels).withColumn("evidence", split("e", ";")))


@query("SELECT conv_id AS qid, CASE WHEN c <> '' THEN '以下是你記得的關於使用者的資訊：' || chr(10) || c || chr(10) || chr(10) ELSE '' END || '問題：q' || chr(10) || 'A. 1' || chr(10) || 'B. 2' || chr(10) || 'C. 3' || chr(10) || 'D. 4' || chr(10) || '請直接回答選項字母。' || chr(10) || '答案：' AS prompt FROM (SELECT conv_id, right(string_agg(text, chr(10) ORDER BY turn), 300) AS c FROM conversations GROUP BY conv_id)")
def memory_prompt(spark, sf_dir):
    options = F.create_map(*[F.lit(x) for x in ("A", "1", "B", "2", "C", "3", "D", "4")])
    return recent_context_300(spark, sf_dir).select("qid", P.memory_prompt("context", F.lit("q"), options).alias("prompt"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS user_text FROM conversations GROUP BY conv_id")
def action_prompt(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t"))
    return rows.select("conv_id", F.element_at(P.action_prompt("t"), 2)["content"].alias("user_text"))


@query()
def persona_generate(spark, sf_dir):
    """How many questions of each type and letter generated personas get, one for each conversation."""
    from corpusmill.operators.personas import generate

    n = table(spark, sf_dir, "conversations").select("conv_id").distinct().count()
    asked = generate(spark, n, 1).select(F.explode("questions").alias("q"))
    return asked.groupBy(F.col("q.type").alias("type"), F.col("q.answer").alias("answer")).agg(F.count(F.lit(1)).alias("n"))


@query()
def tool_items_generate(spark, sf_dir):
    """How many generated tool items of each kind want a call, one item for each conversation."""
    from corpusmill.operators.personas import generate_tools

    n = table(spark, sf_dir, "conversations").select("conv_id").distinct().count()
    return generate_tools(spark, n, 1).groupBy("kind", F.get_json_object("expected", "$.action").alias("action")).agg(F.count(F.lit(1)).alias("n"))


def _drained(stream, mode: str):
    """All rows that a stream over files yields, written to files in the shared folder and read back."""
    from corpusmill.sources.files import shared_path

    spark = stream.sparkSession
    out, at = shared_path(spark, "stream"), shared_path(spark, "stream-checkpoint")
    writer = stream.writeStream.option("checkpointLocation", at).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", out).outputMode("append").start().awaitTermination()
    else:
        # a file sink takes no updates: each batch of them is a folder of its own, written anew if the batch is
        writer.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).start().awaitTermination()
        at = spark._jvm.org.apache.hadoop.fs.Path(out)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(out)


def _conversation_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "conversations").schema
    # a pattern, since a stream takes a plain path for a folder
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations.parquet*")


@query("SELECT conv_id, turn, translate(text, 'aeiou', 'AEIOU') AS text FROM conversations WHERE text <> ''")
def stream_line_transform(spark, sf_dir):
    from corpusmill.streaming.dialogue import transform_lines

    rows = _conversation_stream(spark, sf_dir).select("conv_id", "turn", "text")
    return _drained(transform_lines(rows, T.translate_characters("text", dict(zip("aeiou", "AEIOU"))), "text"), "append")


@query(r"SELECT CAST(conv_id AS VARCHAR) AS persona_id, t AS text, max(turn) AS pos FROM (SELECT conv_id, turn, trim(text) AS t FROM conversations) WHERE NOT (regexp_matches(t, '[？?]$') AND NOT regexp_matches(t, '[，,。；]')) GROUP BY ALL")
def stream_memory_state(spark, sf_dir):
    """What a stream of turns leaves in memory: of each persona's equal lines the latest."""
    from corpusmill.streaming.dialogue import memory_updates

    key, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, provider)
    try:
        rows = _conversation_stream(spark, sf_dir).select(F.col("conv_id").alias("persona_id"), F.col("turn").alias("pos"), "text")
        updates = _drained(memory_updates(rows), "update")
    finally:
        spark.conf.set(key, before)
    return updates.groupBy("persona_id", "text").agg(F.max("pos").alias("pos"))
