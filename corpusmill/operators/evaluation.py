"""Evaluation of runs: predictions against questions, tool items and exams, their summaries, and training records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators import metrics as M
from corpusmill.operators import prompts as P
from corpusmill.operators import toolcalls as C


def flattened(personas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(persona_id, session_id, date, turn, pos, text) of all turns, in their order, and the questions of all personas."""
    sessions = personas.select("persona_id", F.posexplode("sessions").alias("nth", "s"))
    turns = sessions.select("persona_id", "nth", F.col("s.session_id").alias("session_id"), F.col("s.date").alias("date"), F.posexplode("s.turns").alias("turn", "text"))
    order = Window.partitionBy("persona_id").orderBy("nth", "turn")
    turns = turns.withColumn("pos", F.row_number().over(order) - 1).drop("nth")
    questions = personas.select("persona_id", F.explode("questions").alias("q")).select("persona_id", "q.*")
    return turns, questions


def dated(turns: DataFrame, first_day: Column, session: str = "session_id", gap: int = 7) -> DataFrame:
    """Turns with their session's date, sessions `gap` days apart, and their place within the session."""
    place = F.row_number().over(Window.partitionBy("persona_id", session).orderBy("pos")) - 1
    return turns.withColumn("date", F.date_format(F.date_add(first_day, (F.col(session) * gap).cast("int")), "yyyy-MM-dd")).withColumn("turn", place)


def answered(questions: DataFrame, contexts: DataFrame, scores: DataFrame) -> DataFrame:
    """Predictions: questions (qid, type, answer) with their context and the letter of their highest score."""
    rows = questions.join(contexts, "qid").join(scores.select("qid", "scores"), "qid")
    pred = M.argmax_letter("scores")
    return rows.withColumn("pred", pred).withColumn("correct", pred == F.col("answer"))


def memory_summary(predictions: DataFrame) -> DataFrame:
    """One row: accuracy by type, its mean over the types that occur, over all questions, and how many there are."""
    by_type = predictions.groupBy("type").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("right"))
    return by_type.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "accuracy")))).alias("per_type"),
        F.avg("accuracy").alias("macro_acc"),
        M.ratio(F.sum("right"), F.sum("n")).alias("micro_acc"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_questions"),
    )


def tool_predictions(items: DataFrame, outputs: DataFrame) -> DataFrame:
    """Items (id, kind, expected as JSON) with outputs (id, output): the call, and whether it is the right one."""
    wanted = items.select("id", "kind", (F.get_json_object("expected", "$.action") == "call").alias("want_call"), F.get_json_object("expected", "$.tool").alias("want_tool"), F.coalesce(F.get_json_object("expected", "$.accept"), F.lit("{}")).alias("accept"))
    return C.graded(wanted.join(outputs, "id"))


def exam_summary(predictions: DataFrame, subjects: DataFrame) -> DataFrame:
    """One row over (subject, answer, scores), with subjects (subject, category): macro, micro, n, stderr."""
    rows = predictions.withColumn("pred", M.argmax_letter("scores"))
    by_subject = M.subject_accuracy(rows, "subject", F.col("pred") == F.col("answer"))
    return M.macro_micro(by_subject.join(subjects, "subject"), "category")


def against_baseline(predictions: DataFrame, baseline: DataFrame) -> DataFrame:
    """Predictions with `boost`, how much the right option gains over the same model's run without memory, if there is one."""
    base = baseline.select("model", "qid", F.col("scores").alias("_base"))
    rows = predictions.join(base, ["model", "qid"], "left")
    gold = F.array_position(F.array(*map(F.lit, M.LETTERS)), F.col("answer")) - 1
    return rows.withColumn("boost", F.when(F.col("_base").isNotNull(), M.gold_boost(F.col("scores"), F.col("_base"), gold))).drop("_base")


def labelled_lines(annotations: DataFrame, turns: DataFrame) -> DataFrame:
    """(persona_id, labels map<line, type>): of a line said more than once, the last annotation holds."""
    rows = annotations.join(turns.select("persona_id", "pos", "text"), ["persona_id", "pos"])
    last = rows.groupBy("persona_id", "text").agg(F.max_by("type", "pos").alias("type"))
    return last.groupBy("persona_id").agg(F.map_from_entries(F.collect_list(F.struct("text", "type"))).alias("labels"))


def tool_records(items: DataFrame, replies: tuple[str, ...], seed: int) -> DataFrame:
    """Training rows of tool items: what the agent would send, and the call or reply to learn."""
    tool = F.when(F.get_json_object("expected", "$.action") == "call", F.get_json_object("expected", "$.tool"))
    target = P.tool_target(tool, F.coalesce(F.get_json_object("expected", "$.args"), F.lit("{}")), replies, seed, "id")
    return items.select(F.lit("tool").alias("task"), "id", "kind", P.action_prompt("context").alias("messages"), target.alias("target"))


def reading_records(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """Training rows of questions (qid, type, question, options, answer): context, question and the right option's text."""
    rows = questions.join(contexts, "qid")
    return rows.select(F.lit("reading").alias("task"), F.col("qid").alias("id"), "type", "context", F.struct("question", "options").alias("question"), F.try_element_at("options", F.col("answer")).alias("target"))


def always_abstain(questions: DataFrame, abstain: str) -> DataFrame:
    """(qid, guess): the option that says it was never told; `-` where there is none."""
    letters = F.map_keys(F.map_filter("options", lambda _, v: v == abstain))
    return questions.select("qid", F.coalesce(F.get(F.array_sort(letters), F.lit(0)), F.lit("-")).alias("guess"))


def guess_accuracy(questions: DataFrame, guesses: DataFrame, name: str) -> DataFrame:
    """(type, accuracy of the guesses) of each type, under a name of the caller's."""
    return questions.join(guesses, "qid").groupBy("type").agg(F.avg((F.col("guess") == F.col("answer")).cast("double")).alias(name))


def split_over_length(rows: DataFrame, size: Column, limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows that fit, and those that are too long, to be looked at rather than cut."""
    fits = F.coalesce(size <= limit, F.lit(False))
    return rows.where(fits), rows.where(~fits)
