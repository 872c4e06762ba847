"""Prompts and training records: multiple-choice questions, few-shot bodies, conversations, option shuffles, targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators.metrics import LETTERS
from corpusmill.operators.sampling import order_key

# The wording that models are trained and scored with.
INSTRUCTION = "以下是關於{subject_zh}的單選題，請直接給出正確答案的選項。\n\n"
ANSWER_PREFIX = "答案："
CONTEXT_HEAD = "以下是你記得的關於使用者的資訊：\n"
QUESTION_HEAD = "問題："
ASK_LETTER = "請直接回答選項字母。"
SYSTEM = "你是一個會記住使用者資訊的助理。"


def question(with_answer: bool = False) -> Column:
    """A question row (question, A-D, answer) as text, open or answered."""
    lines = [T.utrim("question"), *[F.concat(F.lit(f"{x}. "), T.utrim(x)) for x in LETTERS], F.lit(ANSWER_PREFIX)]
    body = F.concat_ws("\n", *lines)
    return F.concat(body, "answer", F.lit("\n\n")) if with_answer else body


def instruction(subject: Column | str) -> Column:
    head, tail = INSTRUCTION.split("{subject_zh}")
    return F.concat(F.lit(head), subject, F.lit(tail))


def few_shots(train: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """(group, shots): the first k answered questions of each group."""
    first = train.withColumn("_nth", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_nth") <= k)
    rows = first.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col("_nth").alias("n"), question(True).alias("text")))).alias("rows"))
    return rows.select(group, F.array_join(F.transform("rows", lambda x: x["text"]), "").alias("shots"))


def exam_prompt(questions: DataFrame, subjects: DataFrame, shots: DataFrame | None = None, chat: bool = False) -> DataFrame:
    """With `prompt`; subjects (subject, subject_zh) is a dimension table, and one that lacks a subject leaves its name."""
    out = questions.join(subjects, "subject", "left").withColumn("_name", F.coalesce("subject_zh", "subject"))
    out = out.join(shots, "subject", "left") if shots is not None else out.withColumn("shots", F.lit(""))
    body = F.concat(instruction(F.col("_name")), F.coalesce("shots", F.lit("")), question())
    if chat:
        body = T.utrim(F.substring(body, F.lit(1), F.length(body) - len(ANSWER_PREFIX)))
    return out.withColumn("prompt", body).drop("_name", "shots", "subject_zh")


def conversation(questions: DataFrame, subjects: DataFrame, with_answer_text: bool = True) -> DataFrame:
    """Two-message training rows; rows whose answer isn't a letter are dropped."""
    rows = questions.select(*[T.clean_value(c).alias(c) if c in (*LETTERS, "question", "answer") else F.col(c) for c in questions.columns]).where(F.col("answer").isin(*LETTERS))
    user = exam_prompt(rows, subjects, chat=True)
    options = F.create_map(*[x for k in LETTERS for x in (F.lit(k), F.col(k))])
    answer = F.concat(F.lit(ANSWER_PREFIX), "answer", *([F.lit(". "), F.element_at(options, F.col("answer"))] if with_answer_text else []))
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return user.withColumn("conversations", F.array(message("user", F.col("prompt")), message("assistant", answer))).drop("prompt")


def memory_prompt(context: Column | str, question_text: Column | str, options: Column | str) -> Column:
    context = F.col(context) if isinstance(context, str) else context
    head = F.when(context != "", F.concat(F.lit(CONTEXT_HEAD), context, F.lit("\n\n"))).otherwise("")
    rows = [F.concat(F.lit(f"{x}. "), F.element_at(options, F.lit(x)), F.lit("\n")) for x in LETTERS]
    return F.concat(head, F.lit(QUESTION_HEAD), question_text, F.lit("\n"), *rows, F.lit(ASK_LETTER + "\n" + ANSWER_PREFIX))


def shuffled_options(df: DataFrame, seed: int, key: str) -> DataFrame:
    """Options in a seeded order, and the answer's new letter."""
    pairs = F.array(*[F.struct(order_key(seed, key, F.lit(x)).alias("o"), F.lit(x).alias("letter"), F.col(x).alias("text")) for x in LETTERS])
    out = df.withColumn("_order", F.array_sort(pairs))
    at = F.array_position(F.transform("_order", lambda x: x["letter"]), F.col("answer"))
    new = {x: F.element_at("_order", i + 1)["text"] for i, x in enumerate(LETTERS)}
    return out.withColumns(new | {"answer": F.element_at(F.array(*map(F.lit, LETTERS)), at.cast("int"))}).drop("_order")


def tool_target(tool: Column | str, arguments: Column | str, replies: tuple[str, ...], seed: int, key: str) -> Column:
    """A call as tagged JSON (arguments: its JSON text), or, where no tool is wanted, one of the replies."""
    tool = F.col(tool) if isinstance(tool, str) else tool
    pick = F.conv(F.substring(order_key(seed, key), 1, 8), 16, 10).cast("long") % len(replies) + 1
    call = F.concat(F.lit('<tool_call>\n{"name": "'), tool, F.lit('", "arguments": '), arguments, F.lit("}\n</tool_call>"))
    return F.when(tool.isNotNull(), call).otherwise(F.element_at(F.array(*map(F.lit, replies)), pick.cast("int")))


def action_prompt(context: Column | str) -> Column:
    """System and user messages of a tool decision; context: the turns so far."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(message("system", F.lit(SYSTEM)), message("user", F.array_join(context, "\n")))


def masked(prompt: Column | str, target: Column | str) -> tuple[Column, Column]:
    """Ids and labels of a training row; the prompt's labels are -100."""
    return F.concat(prompt, target), F.concat(F.array_repeat(F.lit(-100).cast("long"), F.size(prompt)), target)


def padded(df: DataFrame, ids: str, batch: str, pad: int) -> DataFrame:
    """Right-padded to the longest of each batch."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    return df.withColumn("_longest", longest).withColumn(ids, F.concat(ids, F.array_repeat(F.lit(pad).cast("long"), F.col("_longest") - F.size(ids)))).drop("_longest")


def keep_last_tokens(ids: Column | str, limit: int) -> Column:
    return F.slice(ids, F.greatest(F.size(ids) - limit + 1, F.lit(1)), limit)
