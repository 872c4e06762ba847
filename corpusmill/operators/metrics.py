"""Scores and roll-ups: argmax of options, group and macro means, counters and ratios, context quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = ("A", "B", "C", "D")


def ratio(x: Column | str, y: Column | str) -> Column:
    """x / y, and 0 where y is 0."""
    return F.coalesce(F.try_divide(F.col(x).cast("double") if isinstance(x, str) else x.cast("double"), F.col(y).cast("double") if isinstance(y, str) else y.cast("double")), F.lit(0.0))


def rounded(c: Column | str, digits: int) -> Column:
    """A share rounded as SQL's round() has it for doubles, scaled up and down again: 0.00015 is 0.0001 to four digits."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 10.0**digits + 0.5) / 10.0**digits


def argmax_letter(scores: Column | str, letters: tuple[str, ...] = LETTERS) -> Column:
    """The letter of the highest score; of equal scores the first."""
    return F.element_at(F.array(*map(F.lit, letters)), F.array_position(scores, F.array_max(scores)).cast("int"))


def subject_accuracy(df: DataFrame, subject: str, correct: Column) -> DataFrame:
    return df.groupBy(subject).agg(F.sum(correct.cast("long")).alias("right"), F.count(F.lit(1)).alias("n")).withColumn("accuracy", ratio("right", "n"))


def macro_micro(by_subject: DataFrame, category: str) -> DataFrame:
    """One row: mean of category means of subject accuracies, accuracy over all rows and its standard error."""
    categories = by_subject.groupBy(category).agg(F.avg("accuracy").alias("mean"))
    macro = categories.agg(F.avg("mean").alias("macro"))
    total = by_subject.agg(ratio(F.sum("right"), F.sum("n")).alias("micro"), F.sum("n").alias("n"))
    p = F.col("micro")
    # both sides are aggregates of one row
    return macro.join(F.broadcast(total), F.lit(True)).withColumn("stderr", F.sqrt(ratio(p * (1 - p), "n")))


def type_accuracy(df: DataFrame, kind: str, correct: Column) -> DataFrame:
    return df.groupBy(kind).agg(F.avg(correct.cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


TOOL_COUNTERS = ("total", "decision_ok", "has_call", "parsed", "want_call", "tool_ok", "arg_ok", "e2e")


def tool_counters(df: DataFrame) -> DataFrame:
    """One row of counters over (want_call, has_call, parsed, tool_ok, arg_ok), and their ratios."""
    call = F.col("want_call")
    counted = {
        "decision_ok": F.col("has_call") == call,
        "has_call": F.col("has_call"),
        "parsed": F.col("has_call") & F.col("parsed"),
        "want_call": call,
        "tool_ok": call & F.col("tool_ok"),
        "arg_ok": call & F.col("arg_ok"),
        "e2e": F.when(call, F.col("arg_ok")).otherwise(~F.col("has_call")),
    }
    out = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in counted.items()])
    ratios = {"decision_accuracy": ("decision_ok", "total"), "parse_rate": ("parsed", "has_call"), "tool_accuracy": ("tool_ok", "want_call"), "argument_accuracy": ("arg_ok", "want_call"), "end_to_end": ("e2e", "total")}
    return out.select("*", *[ratio(x, y).alias(k) for k, (x, y) in ratios.items()])


def leaderboard(macro: Column, end_to_end: Column) -> Column:
    return 0.7 * macro + 0.3 * end_to_end


def is_close(a: Column, b: Column, rel: float = 1e-6, least: float = 1e-6) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(least))


def context_quality(df: DataFrame) -> DataFrame:
    """One row of context and grounding metrics over

    (type, context, labels map<line,type>, evidence array, correct, pred_text): what share of lines is small talk, whether
    all evidence is in the context, and whether answers come with it or without.
    """
    lines = F.filter(F.split("context", "\n"), lambda x: x != "")
    df = df.withColumn("lines", lines)
    known = lambda x: F.map_contains_key("labels", x)
    other = lambda x: F.coalesce(F.try_element_at("labels", x) == "other", F.lit(False))
    hit = F.size(F.array_except("evidence", "lines")) == 0
    needs = F.size("evidence") > 0
    df = df.select(
        "*",
        F.size("lines").alias("n_lines"),
        F.size(F.filter("lines", lambda x: ~known(x))).alias("small"),
        F.exists("lines", other).alias("has_other"),
        F.exists("lines", lambda x: other(x) & x.contains(F.col("pred_text"))).alias("picks_other"),
        (needs & hit).alias("hit"),
        needs.alias("needs"),
    )
    abstain = F.col("type") == "abstain"
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        ratio(F.count_if("hit"), F.count_if("needs")).alias("evidence_recall"),
        ratio(F.sum("small"), F.greatest(F.sum("n_lines"), F.lit(1))).alias("small_talk_share"),
        F.avg(F.length("context").cast("double")).alias("context_chars"),
        ratio(F.count_if(abstain & (F.col("n_lines") == 0)), F.count_if(abstain)).alias("abstain_empty_share"),
        ratio(F.count_if("has_other"), F.count(F.lit(1))).alias("other_people_share"),
        F.count_if(F.col("hit") & F.col("correct")).alias("correct_with_evidence"),
        F.count_if(F.col("needs") & ~F.col("hit") & F.col("correct")).alias("correct_without_evidence"),
        F.count_if("picks_other").alias("picks_other"),
    )


def gold_boost(scores: Column, base: Column, gold: Column) -> Column:
    """How much more the right option gains over a run without memory than the others do on average (gold: from 0)."""
    gain = F.transform(F.arrays_zip(scores.alias("s"), base.alias("b")), lambda x: x["s"] - x["b"])
    right = F.element_at(gain, gold.cast("int") + 1)
    total = F.aggregate(gain, F.lit(0.0), lambda a, x: a + x)
    return right - (total - right) / (F.size(gain) - 1)


def question_audit(df: DataFrame, abstain: str) -> DataFrame:
    """(type, options map): whether a question is malformed - options repeat, or the abstaining option is out of place."""
    values = F.map_values("options")
    distinct = F.size(F.array_distinct(values)) == F.size(values)
    return df.withColumn("malformed", ~distinct | (F.array_contains(values, abstain) == (F.col("type") == "multi")))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
