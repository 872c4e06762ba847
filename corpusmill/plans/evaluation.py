"""Queries over whole evaluations: predictions, tools, exams, training records, reports, sinks and run folders."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import evaluation as E
from corpusmill.operators import metrics as M
from corpusmill.operators import prompts as P
from corpusmill.plans import dialogue
from corpusmill.plans.common import Register, table
from corpusmill.sources import files

query = Register()
QUERIES, ORACLE_SQL = query.queries, query.sql

#: A question for each conversation: its type and right letter by its number; a stand-in for a model scores the options by the prompt's length.
_CONTEXTS = "c AS (SELECT conv_id, right(string_agg(text, chr(10) ORDER BY turn), 300) AS context FROM conversations GROUP BY conv_id), "
_PREDICTED = _CONTEXTS + (
    "s AS (SELECT conv_id AS qid, ['single', 'update', 'multi'][conv_id % 3 + 1] AS type, chr(CAST(65 + conv_id % 4 AS INT)) AS answer, context, [(length(context) + conv_id) % 7, (length(context) + 3) % 5, conv_id % 6, (length(context) * 3) % 4] AS x FROM c), "
    "p AS (SELECT *, substr('ABCD', CAST(list_position(x, list_max(x)) AS INT), 1) AS pred FROM s) "
)


def _questions(spark, sf_dir):
    c = F.col("conv_id")
    rows = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    options = F.create_map(*[x for k in M.LETTERS for x in (F.lit(k), F.concat(F.lit(k.lower()), c))])
    kind = F.element_at(F.array(*map(F.lit, ("single", "update", "multi"))), (c % 3 + 1).cast("int"))
    return rows.select(c.alias("qid"), kind.alias("type"), F.concat(F.lit("q"), c).alias("question"), options.alias("options"), F.char(65 + c % 4).alias("answer"))


def _predictions(spark, sf_dir):
    contexts = dialogue.recent_context_300(spark, sf_dir)
    n, q = F.length("context"), F.col("qid")
    scores = contexts.select("qid", F.array((n + q) % 7, (n + 3) % 5, q % 6, (n * 3) % 4).alias("scores"))
    return E.answered(_questions(spark, sf_dir), contexts, scores)


@query("WITH " + _PREDICTED + "SELECT qid, type, answer, pred, pred = answer AS correct, context FROM p")
def memory_predictions(spark, sf_dir):
    return _predictions(spark, sf_dir).select("qid", "type", "answer", "pred", "correct", "context")


@query("WITH " + _PREDICTED + "SELECT round((SELECT avg(a) FROM (SELECT avg(CAST(pred = answer AS INT)) AS a FROM p GROUP BY type)), 9) AS macro_acc, round(avg(CAST(pred = answer AS INT)), 9) AS micro_acc, count(*) AS n_questions FROM p")
def memory_evaluation(spark, sf_dir):
    out = E.memory_summary(_predictions(spark, sf_dir))
    return out.select(F.round("macro_acc", 9).alias("macro_acc"), F.round("micro_acc", 9).alias("micro_acc"), "n_questions")


def _items(spark, sf_dir):
    e = F.col("event_id")
    expected = F.when(e % 4 == 0, F.lit('{"action": "call", "tool": "get_date", "args": {}, "accept": {}}')).when(e % 4 == 1, F.concat(F.lit('{"action": "call", "tool": "calculator", "args": {"expression": "'), e, F.lit('+1"}, "accept": {"value": '), e + 1, F.lit("}}"))).otherwise(F.lit('{"action": "answer"}'))
    return table(spark, sf_dir, "events").select(e.alias("id"), F.col("event_type").alias("kind"), expected.alias("expected"), F.array(F.lit("hi"), F.col("event_type")).alias("context"))


def _outputs(items):
    e = F.col("id")
    said = F.when(e % 5 == 0, F.lit("no call")).when(e % 3 == 0, F.lit("<call>get_date</call>")).otherwise(F.concat(F.lit('<tool_call>{"name": "calculator", "arguments": {"expression": "1+'), e, F.lit('"}}</tool_call>')))
    return items.select("id", said.alias("output"))


_TOOLED = (
    "WITH i AS (SELECT event_id AS id, event_id % 4 < 2 AS want_call, CASE event_id % 4 WHEN 0 THEN 'get_date' WHEN 1 THEN 'calculator' END AS want_tool, event_id % 5 <> 0 AS has_call, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'get_date' ELSE 'calculator' END AS tool FROM events), "
    "p AS (SELECT *, coalesce(tool = want_tool, false) AS ok FROM i) "
)


@query(_TOOLED + "SELECT id, has_call, tool, ok AS tool_ok, ok AS arg_ok FROM p")
def tool_predictions(spark, sf_dir):
    items = _items(spark, sf_dir)
    return E.tool_predictions(items, _outputs(items)).select("id", "has_call", "tool", "tool_ok", "arg_ok")


@query(_TOOLED + "SELECT count(*) AS total, count(*) FILTER (WHERE has_call = want_call) AS decision_ok, count(*) FILTER (WHERE want_call AND ok) AS tool_ok, count(*) FILTER (WHERE CASE WHEN want_call THEN ok ELSE NOT has_call END) AS e2e FROM p")
def tool_evaluation(spark, sf_dir):
    items = _items(spark, sf_dir)
    return M.tool_counters(E.tool_predictions(items, _outputs(items))).select("total", "decision_ok", "tool_ok", "e2e")


@query(
    "WITH p AS (SELECT item_id % 7 AS subject, item_id % 4 + 1 AS k, [item_id % 3, item_id % 5, length(text) % 4, item_id % 2] AS x FROM benchmark), s AS (SELECT subject, avg(CAST(list_position(x, list_max(x)) = k AS INT)) AS a, sum(CAST(list_position(x, list_max(x)) = k AS INT)) AS r, count(*) AS n FROM p GROUP BY 1), "
    "c AS (SELECT avg(a) AS m FROM s GROUP BY subject % 2), t AS (SELECT sum(r) / sum(n)::DOUBLE AS q, CAST(sum(n) AS BIGINT) AS n FROM s) SELECT round((SELECT avg(m) FROM c), 9) AS macro, round(q, 9) AS micro, n, round(sqrt(q * (1 - q) / n), 9) AS stderr FROM t"
)
def exam_evaluation(spark, sf_dir):
    i = F.col("item_id")
    rows = table(spark, sf_dir, "benchmark").select((i % 7).alias("subject"), F.char(65 + i % 4).alias("answer"), F.array(i % 3, i % 5, F.length("text").cast("long") % 4, i % 2).alias("scores"))
    subjects = spark.range(7).select(F.col("id").alias("subject"), (F.col("id") % 2).alias("category"))
    out = E.exam_summary(rows, subjects)
    return out.select(F.round("macro", 9).alias("macro"), F.round("micro", 9).alias("micro"), "n", F.round("stderr", 9).alias("stderr"))


@query("SELECT event_type AS type, count(*) AS n, count(*) FILTER (WHERE event_id % 3 = 0) AS with_baseline, round(avg(CASE WHEN event_id % 3 = 0 THEN g - (a + b + c + d - g) / 3 END), 9) AS boost FROM (SELECT *, [a, b, c, d][event_id % 4 + 1] AS g FROM (SELECT event_id, event_type, value - 1 AS a, 2 * value - 1 AS b, event_id % 3 - 1 AS c, event_id % 5 - 1 AS d FROM events)) GROUP BY 1")
def baseline_boost(spark, sf_dir):
    """Predictions joined with a run without memory, which has a third of the questions."""
    e, v = F.col("event_id"), F.col("value")
    rows = table(spark, sf_dir, "events").select(e.alias("qid"), F.lit("m").alias("model"), F.col("event_type").alias("type"), F.char(65 + e % 4).alias("answer"), F.array(v, v * 2, (e % 3).cast("double"), (e % 5).cast("double")).alias("scores"))
    base = rows.where("qid % 3 = 0").select("model", "qid", F.array(*[F.lit(1.0)] * 4).alias("scores"))
    out = E.against_baseline(rows, base).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count("boost").alias("with_baseline"), F.avg("boost").alias("boost"))
    return out.withColumn("boost", F.round("boost", 9))


@query("WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'other' ELSE 'fact' END AS type, text FROM conversations WHERE turn % 2 = 0) SELECT conv_id AS persona_id, text, arg_max(type, turn) AS type FROM a WHERE text IS NOT NULL GROUP BY ALL")
def labelled_lines(spark, sf_dir):
    turns = dialogue._turns(spark, sf_dir).where("text is not null")
    notes = turns.where("pos % 2 = 0").select("persona_id", "pos", F.when(F.col("pos") % 3 == 0, "other").otherwise("fact").alias("type"))
    return E.labelled_lines(notes, turns).select("persona_id", F.explode("labels").alias("text", "type"))


_REPLIES = ("好的。", "了解。", "知道了。")


@query("SELECT 'tool' AS task, event_id AS id, event_type AS kind, 'hi' || chr(10) || event_type AS said, CASE event_id % 4 WHEN 0 THEN '<tool_call>' || chr(10) || '{\"name\": \"get_date\", \"arguments\": {}}' || chr(10) || '</tool_call>' WHEN 1 THEN '<tool_call>' || chr(10) || '{\"name\": \"calculator\", \"arguments\": {\"expression\":\"' || event_id || '+1\"}}' || chr(10) || '</tool_call>' ELSE ['好的。', '了解。', '知道了。'][('0x' || substr(sha256('3:' || event_id), 1, 8))::BIGINT % 3 + 1] END AS target FROM events")
def sft_tool_rows(spark, sf_dir):
    return E.tool_records(_items(spark, sf_dir), _REPLIES, 3).select("task", "id", "kind", F.element_at("messages", 2)["content"].alias("said"), "target")


@query("WITH " + _CONTEXTS + "q AS (SELECT * FROM c) SELECT 'reading' AS task, conv_id AS id, ['single', 'update', 'multi'][conv_id % 3 + 1] AS type, context, 'q' || conv_id AS question, chr(CAST(97 + conv_id % 4 AS INT)) || conv_id AS target FROM q")
def sft_reading_rows(spark, sf_dir):
    out = E.reading_records(_questions(spark, sf_dir), dialogue.recent_context_300(spark, sf_dir))
    return out.select("task", "id", "type", "context", F.col("question.question").alias("question"), "target")


@query("WITH c AS (SELECT conv_id, sum(length(text)) AS chars, count(*) AS turns, count(DISTINCT role) AS roles FROM conversations GROUP BY conv_id) SELECT count(*) AS personas, count(DISTINCT roles) AS role_counts, round(avg(turns), 9) AS mean_turns, round(avg(chars), 9) AS mean_chars, max(turns) AS most_turns FROM c")
def dialogue_size_report(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("turns"), F.count_distinct("role").alias("roles"))
    return rows.agg(F.count(F.lit(1)).alias("personas"), F.count_distinct("roles").alias("role_counts"), F.round(F.avg("turns"), 9).alias("mean_turns"), F.round(F.avg("chars"), 9).alias("mean_chars"), F.max("turns").alias("most_turns"))


@query("SELECT ['single', 'update', 'multi'][conv_id % 3 + 1] AS type, count(*) AS n, round(avg(CAST(conv_id % 5 = conv_id % 4 AS INT)), 9) AS always_abstain FROM (SELECT DISTINCT conv_id FROM conversations) GROUP BY 1")
def abstain_baseline(spark, sf_dir):
    """The option of number conv_id % 5 says that it was never told; there is none for the number 4."""
    rows = _questions(spark, sf_dir)
    never = F.element_at(F.array(*map(F.lit, (*M.LETTERS, "-"))), (F.col("qid") % 5 + 1).cast("int"))
    rows = rows.withColumn("options", F.transform_values("options", lambda k, v: F.when(k == never, dialogue.ABSTAIN).otherwise(v)))
    out = E.guess_accuracy(rows, E.always_abstain(rows, dialogue.ABSTAIN), "always_abstain")
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("n")).join(out, "type").withColumn("always_abstain", F.round("always_abstain", 9))


@query("SELECT conv_id AS persona_id, turn // 4 AS session_id, row_number() OVER (PARTITION BY conv_id, turn // 4 ORDER BY turn) - 1 AS turn, strftime(DATE '2024-01-01' + CAST(7 * (turn // 4) AS INT), '%Y-%m-%d') AS date, text FROM conversations")
def session_turns(spark, sf_dir):
    """Sessions of four turns, a week apart: each turn's place in its session and its date."""
    turns = dialogue._turns(spark, sf_dir).withColumn("session_id", F.floor(F.col("pos") / 4).cast("long"))
    return E.dated(turns, F.lit("2024-01-01").cast("date")).select("persona_id", "session_id", F.col("turn").cast("long").alias("turn"), "date", "text")


@query("SELECT doc_id, n > 500 AS over, n AS tokens FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents)")
def over_length_split(spark, sf_dir):
    tokens = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).cast("long")
    rows = table(spark, sf_dir, "documents").select("doc_id", tokens.alias("tokens"))
    fit, over = E.split_over_length(rows, F.col("tokens"), 500)
    return fit.withColumn("over", F.lit(False)).unionByName(over.withColumn("over", F.lit(True))).select("doc_id", "over", "tokens")


@query("SELECT origin, count(*) AS letters, count(*) FILTER (WHERE c BETWEEN '一' AND '鿿') AS ideographs FROM (SELECT 'documents' AS origin, unnest(string_split(text, '')) AS c FROM documents UNION ALL SELECT 'names', unnest(string_split('國' || n_name || '字', '')) FROM nation) WHERE c <> '' GROUP BY origin")
def ideograph_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), "text")
    names = table(spark, sf_dir, "nation").select(F.lit("names").alias("origin"), F.concat(F.lit("國"), "n_name", F.lit("字")).alias("text"))
    letters = docs.unionByName(names).select("origin", F.explode(F.split("text", "")).alias("c")).where("c <> ''")
    return letters.groupBy("origin").agg(F.count(F.lit(1)).alias("letters"), F.count_if(F.col("c").rlike("^[\u4e00-\u9fff]$")).alias("ideographs"))


_RUN = "macro_acc double, micro_acc double, n_questions long"


@query("WITH " + _PREDICTED + "SELECT qid, type, pred, answer, pred = answer AS correct, context, round((SELECT avg(CAST(pred = answer AS INT)) FROM p), 9) AS micro_acc, (SELECT count(*) FROM p) AS n_questions FROM p")
def run_folder(spark, sf_dir):
    """A run is written (summary.json, memory_pred.jsonl) and loaded again."""
    root, rows = files.shared_path(spark, "run"), _predictions(spark, sf_dir).select("qid", "type", "pred", "answer", "correct", "context")
    files.write_run(E.memory_summary(rows).drop("per_type"), root, memory_pred=rows)
    summary, found = files.read_run(spark, root, _RUN, memory_pred=rows.schema)
    # the summary is one row
    return found["memory_pred"].join(F.broadcast(summary.select(F.round("micro_acc", 9).alias("micro_acc"), "n_questions")), F.lit(True))


@query("WITH " + _PREDICTED + "SELECT count(*) AS rows, true AS same, true AS differs FROM p")
def prediction_checksum(spark, sf_dir):
    """The checksum is the same in any order of rows, and another one if a row changes."""
    rows = _predictions(spark, sf_dir)
    first, turned, other = (files.checksum(x) for x in (rows, rows.orderBy(F.desc("qid")), rows.withColumn("pred", F.when(F.col("qid") == 1, "-").otherwise(F.col("pred")))))
    pair = first.join(F.broadcast(turned.select(F.col("checksum").alias("b"))), F.lit(True)).join(F.broadcast(other.select(F.col("checksum").alias("c"))), F.lit(True))
    return pair.select("rows", (F.col("checksum") == F.col("b")).alias("same"), (F.col("checksum") != F.col("c")).alias("differs"))


@query("WITH " + _PREDICTED + "SELECT lpad(type, 14, ' ') || lpad(CAST(count(*) AS VARCHAR), 14, ' ') || lpad(format('{:.4f}', round(avg(CAST(pred = answer AS INT)), 4)), 14, ' ') AS line FROM p GROUP BY type")
def aligned_report(spark, sf_dir):
    rows = M.type_accuracy(_predictions(spark, sf_dir), "type", F.col("correct"))
    return files.aligned(rows.withColumn("accuracy", M.rounded("accuracy", 4)), "type", "n", "accuracy")


@query("SELECT count(*) AS lines FROM documents WHERE text <> ''")
def shuffled_rewrite(spark, sf_dir):
    """Lines of JSON are written in a seeded order and counted again."""
    from corpusmill.operators import sampling as S

    path = files.shared_path(spark, "shuffled")
    rows = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", "text").withColumn("_order", S.order_key(824, "doc_id"))
    # a range of the order key to a task: files in the order of their names are in the key's
    files.write_json_lines(rows.repartitionByRange("_order").sortWithinPartitions("_order").drop("_order"), path)
    return files.lines(spark, path).agg(F.count(F.lit(1)).alias("lines"))


@query("SELECT * FROM (SELECT 'tool' AS task, count(*) AS n FROM events UNION ALL SELECT 'reading', count(DISTINCT conv_id) FROM conversations)")
def training_mix(spark, sf_dir):
    """Tool and reading rows are written apart and together, and read back from the mix."""
    root = files.shared_path(spark, "sft")
    tool = E.tool_records(_items(spark, sf_dir), _REPLIES, 3).withColumn("id", F.col("id").cast("string"))
    reading = E.reading_records(_questions(spark, sf_dir), dialogue.recent_context_300(spark, sf_dir)).withColumn("id", F.col("id").cast("string"))
    for name, rows in (("sft_tool", tool), ("sft_reading", reading)):
        files.write_json_lines(rows, f"{root}/{name}.jsonl")
    mix = files.lines(spark, f"{root}/sft_tool.jsonl").unionByName(files.lines(spark, f"{root}/sft_reading.jsonl"))
    mix.write.text(f"{root}/sft_mix.jsonl")
    good, _ = files.json_lines(spark, "task string", f"{root}/sft_mix.jsonl")
    return good.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
