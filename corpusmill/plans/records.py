"""Queries over training records: prompts, conversations, options, tool calls, metrics of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import metrics as M
from corpusmill.operators import prompts as P
from corpusmill.operators import toolcalls as C
from corpusmill.plans.common import Register, inline, table, values

query = Register()
QUERIES, ORACLE_SQL = query.queries, query.sql

_QUESTIONS = [
    (1, "logic", " 1+1=? ", "1", "2", "3", "4", "B"),
    (2, "law", "何者為法？", "甲", "乙", "丙", "丁", "D"),
    (3, "none", "x", "a", "b", "c", "d", "E"),
    (4, "logic", "2+2=?", "4", "5.0", "6", "7", "A"),
]
_NAMES = "id, subject, question, A, B, C, D, answer"
_SCHEMA = "id int, subject string, question string, A string, B string, C string, D string, answer string"
_SUBJECTS = [("logic", "邏輯思維"), ("law", "法學大意")]
_BODY = "trim(question) || chr(10) || 'A. ' || A || chr(10) || 'B. ' || {b} || chr(10) || 'C. ' || C || chr(10) || 'D. ' || D"
_HEAD = "'以下是關於' || coalesce(s.subject_zh, t.subject) || '的單選題，請直接給出正確答案的選項。' || chr(10) || chr(10)"
_FROM = f"{values(_NAMES, _QUESTIONS)} LEFT JOIN (SELECT * FROM {values('subject, subject_zh', _SUBJECTS)}) s ON s.subject = t.subject"


def _questions(spark):
    return inline(spark, _SCHEMA, _QUESTIONS)


def _subjects(spark):
    return inline(spark, "subject string, subject_zh string", _SUBJECTS)


@query(f"SELECT id, {_HEAD} || {_BODY.format(b='B')} || chr(10) || '答案：' AS prompt FROM {_FROM}")
def mcq_prompt(spark, sf_dir):
    return P.exam_prompt(_questions(spark), _subjects(spark)).select("id", "prompt")


@query(
    f"SELECT id, {_HEAD} || {_BODY.format(b='''CASE B WHEN '5.0' THEN '5' ELSE B END''')} AS user_text, '答案：' || answer || '. ' || CASE answer WHEN 'A' THEN A WHEN 'B' THEN B WHEN 'C' THEN C ELSE D END AS assistant_text FROM {_FROM} WHERE answer IN ('A', 'B', 'C', 'D')"
)
def conversation_build(spark, sf_dir):
    rows = P.conversation(_questions(spark), _subjects(spark))
    return rows.select("id", F.element_at("conversations", 1)["content"].alias("user_text"), F.element_at("conversations", 2)["content"].alias("assistant_text"))


@query(
    "WITH s AS (SELECT lang, string_agg(text, '|' ORDER BY doc_id) AS shots FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 3 GROUP BY lang) SELECT doc_id, shots FROM documents JOIN s USING (lang)"
)
def fewshot_topk(spark, sf_dir):
    """The first three texts of a language, attached to each of its rows."""
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents")
    first = docs.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).where("r <= 3")
    shots = first.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("r", F.col("text").alias("t")))).alias("x")).select("lang", F.array_join(F.transform("x", lambda x: x["t"]), "|").alias("shots"))
    return docs.join(F.broadcast(shots), "lang").select("doc_id", "shots")


@query(f"SELECT subject, string_agg(trim(question) || chr(10) || 'A. ' || A || chr(10) || 'B. ' || B || chr(10) || 'C. ' || C || chr(10) || 'D. ' || D || chr(10) || '答案：' || answer || chr(10) || chr(10), '' ORDER BY id) AS shots FROM {values(_NAMES, _QUESTIONS)} GROUP BY subject")
def exam_few_shots(spark, sf_dir):
    return P.few_shots(_questions(spark), "subject", "id", 5)


@query(
    "WITH q AS (SELECT item_id, 'a' || item_id AS A, 'b' || item_id AS B, 'c' || item_id AS C, 'd' || item_id AS D, chr(65 + CAST(item_id % 4 AS INT)) AS answer FROM benchmark), o AS (SELECT item_id, answer, l, x, row_number() OVER (PARTITION BY item_id ORDER BY sha256('9:' || item_id || ':' || l)) AS r "
    "FROM (SELECT item_id, answer, unnest(['A', 'B', 'C', 'D']) AS l, unnest([A, B, C, D]) AS x FROM q)) SELECT item_id, max(x) FILTER (WHERE r = 1) AS A, max(x) FILTER (WHERE r = 2) AS B, max(x) FILTER (WHERE r = 3) AS C, max(x) FILTER (WHERE r = 4) AS D, chr(CAST(64 + max(r) FILTER (WHERE l = answer) AS INT)) AS answer FROM o GROUP BY item_id"
)
def option_shuffle_relabel(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", *[F.concat(F.lit(x.lower()), "item_id").alias(x) for x in M.LETTERS], F.char(65 + F.col("item_id") % 4).alias("answer"))
    return P.shuffled_options(rows, 9, "item_id")


_CALLS = [
    (1, '好<tool_call>\n{"name": "memory_save", "arguments": {"key": "城市", "value": "台南"}}\n</tool_call>', True, True, "memory_save", '{"key": "城市", "value": "台南"}'),
    (2, '<tool_call>{"name": "calculator", "arguments": "{\\"expression\\": \\"3×4\\"}"}</tool_call>', True, True, "calculator", '{"expression": "3×4"}'),
    (3, "<tool_call>{broken}</tool_call>", True, False, None, None),
    (4, '<tool_call>{"name": 5, "arguments": {}}</tool_call>', True, False, None, None),
    (5, "<call>get_date</call>", True, True, "get_date", "{}"),
    (6, "<call>memory_search{bad}</call>", True, False, "memory_search", None),
    (7, "<tool_call>{", True, False, None, None),
    (8, "沒有呼叫", False, False, None, None),
    (9, '<call>a {"x": 1}</call><call>b</call>', True, True, "a", '{"x": 1}'),
]


@query(f"SELECT id, has_call, parsed, tool, args FROM {values('id, text, has_call, parsed, tool, args', _CALLS)}")
def toolcall_parse(spark, sf_dir):
    rows = inline(spark, "id int, text string", [x[:2] for x in _CALLS])
    return rows.select("id", C.parse("text").alias("c")).select("id", "c.*")


_MATCHES = [
    (1, "memory_save", '{"key": "居住城市", "value": "台南市"}', '{"key": ["城市"], "value": ["台南"]}', True),
    (2, "memory_save", '{"key": "x", "value": "台南市"}', '{"key": ["城市"], "value": ["台南"]}', False),
    (3, "memory_search", '{"query": "我的工作"}', '{"query": ["職業", "工作"]}', True),
    (4, "calculator", '{"expression": "(1+2)×3"}', '{"value": 9}', True),
    (5, "calculator", '{"expression": "__import__"}', '{"value": 9}', False),
    (6, "get_date", "{}", "{}", True),
    (7, "other", "{}", "{}", False),
]


@query(f"SELECT id, ok FROM {values('id, tool, args, accept, ok', _MATCHES)}")
def args_match(spark, sf_dir):
    rows = inline(spark, "id int, tool string, args string, accept string, ok boolean", _MATCHES)
    return rows.select("id", C.arguments_match(F.col("tool"), F.col("args"), F.col("accept")).alias("ok"))


@query("SELECT event_id, round(CAST(event_id % 97 AS DOUBLE) * (event_id % 13 + 1) - (event_id % 7) / 4.0::DOUBLE, 6) AS value FROM events")
def safe_arith(spark, sf_dir):
    e = F.col("event_id")
    expression = F.concat((e % 97).cast("string"), F.lit("×("), (e % 13).cast("string"), F.lit(" + 1) - "), (e % 7).cast("string"), F.lit("÷4"))
    return table(spark, sf_dir, "events").select("event_id", F.round(C.arithmetic(expression), 6).alias("value"))


_COUNTED = {"want_call": "event_id % 2 = 0", "has_call": "event_id % 3 <> 0", "parsed": "event_id % 5 <> 0", "tool_ok": "event_id % 7 <> 0", "arg_ok": "event_id % 7 <> 0 AND event_id % 11 <> 0"}
_TOOL_SQL = (
    "WITH e AS (SELECT " + ", ".join(f"({v}) AS {k}" for k, v in _COUNTED.items()) + " FROM events), c AS (SELECT count(*) AS total, count(*) FILTER (WHERE has_call = want_call) AS decision_ok, count(*) FILTER (WHERE has_call) AS has_call, count(*) FILTER (WHERE has_call AND parsed) AS parsed, count(*) FILTER (WHERE want_call) AS want_call, "
    "count(*) FILTER (WHERE want_call AND tool_ok) AS tool_ok, count(*) FILTER (WHERE want_call AND arg_ok) AS arg_ok, count(*) FILTER (WHERE CASE WHEN want_call THEN arg_ok ELSE NOT has_call END) AS e2e FROM e) "
)
_RATIOS = "decision_ok / total::DOUBLE AS decision_accuracy, parsed / has_call::DOUBLE AS parse_rate, tool_ok / want_call::DOUBLE AS tool_accuracy, arg_ok / want_call::DOUBLE AS argument_accuracy, e2e / total::DOUBLE AS end_to_end"


def _tools(spark, sf_dir):
    return M.tool_counters(table(spark, sf_dir, "events").select(*[F.expr(v).alias(k) for k, v in _COUNTED.items()]))


@query(_TOOL_SQL + f"SELECT *, {_RATIOS} FROM c")
def tool_counters_ratios(spark, sf_dir):
    return _tools(spark, sf_dir)


@query(_TOOL_SQL + "SELECT round(0.7::DOUBLE * (SELECT avg(a) FROM (SELECT avg(quality) AS a FROM labels JOIN documents USING (doc_id) GROUP BY lang)) + 0.3::DOUBLE * e2e / total, 9) AS score FROM c")
def leaderboard_score(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    macro = M.type_accuracy(rows, "lang", F.col("quality") == 1).agg(F.avg("accuracy").alias("macro"))
    # one row each
    return macro.join(F.broadcast(_tools(spark, sf_dir)), F.lit(True)).select(F.round(M.leaderboard(F.col("macro"), F.col("end_to_end")), 9).alias("score"))


@query("SELECT event_id, substr('ABCD', CAST(list_position([a, b, c, d], greatest(a, b, c, d)) AS INT), 1) AS pred FROM (SELECT event_id, event_id % 3 AS a, event_id % 5 AS b, event_id % 4 AS c, event_id % 2 AS d FROM events)")
def argmax_tie_low(spark, sf_dir):
    scores = F.array(*[F.col("event_id") % n for n in (3, 5, 4, 2)])
    return table(spark, sf_dir, "events").select("event_id", M.argmax_letter(scores).alias("pred"))


@query("SELECT event_id, round(g - (a + b + c + d - g) / 3, 9) AS boost FROM (SELECT event_id, event_id % 4 AS k, x[1] - 1 AS a, x[2] - 2 AS b, x[3] - 1 AS c, x[4] - 0.5::DOUBLE AS d, [x[1] - 1, x[2] - 2, x[3] - 1, x[4] - 0.5::DOUBLE][event_id % 4 + 1] AS g FROM (SELECT event_id, [value, value * 2, event_id % 3, event_id % 5] AS x FROM events))")
def grounding_gold_boost(spark, sf_dir):
    e, v = F.col("event_id"), F.col("value")
    scores = F.array(v, v * 2, (e % 3).cast("double"), (e % 5).cast("double"))
    base = F.array(*[F.lit(x) for x in (1.0, 2.0, 1.0, 0.5)])
    rows = table(spark, sf_dir, "events").select("event_id", scores.alias("s"), base.alias("b"), (e % 4).alias("gold"))
    return rows.select("event_id", F.round(M.gold_boost(F.col("s"), F.col("b"), F.col("gold")), 9).alias("boost"))


_AUDIT = [(1, "single", "甲", "乙", "丙", "你沒有提過", False), (2, "single", "甲", "甲", "丙", "你沒有提過", True), (3, "multi", "甲", "乙", "丙", "丁", False), (4, "multi", "甲", "乙", "丙", "你沒有提過", True), (5, "tool", "甲", "乙", "丙", "丁", True)]


@query(f"SELECT id, malformed FROM {values('id, type, a, b, c, d, malformed', _AUDIT)}")
def question_audit(spark, sf_dir):
    rows = inline(spark, "id int, type string, a string, b string, c string, d string, w boolean", _AUDIT)
    options = F.create_map(*[x for k in "ABCD" for x in (F.lit(k), F.col(k.lower()))])
    return M.question_audit(rows.withColumn("options", options), "你沒有提過").select("id", "malformed")


@query(
    "WITH t AS (SELECT conv_id, turn, len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS n FROM conversations), m AS (SELECT *, max(n) OVER (PARTITION BY b) AS longest FROM (SELECT *, (row_number() OVER (ORDER BY sha256('7:' || conv_id || ':' || turn)) - 1) // 32 AS b FROM t)) SELECT conv_id, turn, CAST(longest AS BIGINT) AS padded_length, CAST(longest - n AS BIGINT) AS pads, CAST(least(n, 4) AS BIGINT) AS masked FROM m"
)
def label_mask_pad(spark, sf_dir):
    """The first four tokens of a turn are its prompt; a batch is 32 turns of a seeded order."""
    from corpusmill.operators import sampling as S

    tokens = F.transform(F.filter(F.split("text", " "), lambda x: x != ""), lambda x: F.length(x).cast("long"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", tokens.alias("t"))
    ids, labels = P.masked(F.slice("t", 1, 4), F.slice("t", 5, 1 << 30))
    dealt = S.batches(rows, 32, 7, 0, "conv_id", "turn")
    out = P.padded(dealt.select("conv_id", "turn", "batch_id", ids.alias("ids"), labels.alias("labels")), "ids", "batch_id", -1)
    return out.select("conv_id", "turn", F.size("ids").cast("long").alias("padded_length"), F.size(F.filter("ids", lambda x: x == -1)).cast("long").alias("pads"), F.size(F.filter("labels", lambda x: x == -100)).cast("long").alias("masked"))


_REPLIES = ("好的。", "了解。", "知道了。")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '<tool_call>' || chr(10) || '{\"name\": \"get_date\", \"arguments\": {}}' || chr(10) || '</tool_call>' ELSE ['好的。', '了解。', '知道了。'][('0x' || substr(sha256('1:' || event_id), 1, 8))::BIGINT % 3 + 1] END AS target FROM events")
def tool_targets(spark, sf_dir):
    tool = F.when(F.col("event_id") % 2 == 0, F.lit("get_date"))
    return table(spark, sf_dir, "events").select("event_id", P.tool_target(tool, F.lit("{}"), _REPLIES, 1, "event_id").alias("target"))
