"""Tool calls in model output: parsing, arithmetic without eval(), and matching of arguments."""

from __future__ import annotations

import ast
import json
import operator
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from corpusmill.operators.metrics import is_close

# How models write a call.
TAGGED = r"<tool_call>\s*(?P<object>\{.*?\})\s*</tool_call>"
SHORT = r"<call>\s*(?P<name>[A-Za-z_]+)\s*(?P<args>\{.*?\})?\s*</call>"

#: Notations by the mark that announces them, in the order in which they are looked for.
NOTATIONS: tuple[tuple[str, re.Pattern], ...] = (("<tool_call>", re.compile(TAGGED, re.S)), ("<call>", re.compile(SHORT, re.S)))
CALL = "has_call boolean, parsed boolean, tool string, args string"


def _object(text) -> dict | None:
    """A JSON object, given as such or as text."""
    try:
        found = json.loads(text) if isinstance(text, str) else text
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def _read(text: str | None) -> tuple[bool, bool, str | None, str | None]:
    """(a call is announced, it is sound, the tool if it is told, the arguments if sound)."""
    pattern = next((p for mark, p in NOTATIONS if mark in (text or "")), None)
    m = pattern.search(text) if pattern else None
    if m is None:
        return pattern is not None, False, None, None
    told = m.groupdict()
    whole = _object(told["object"]) or {} if "object" in told else {"name": told["name"], "arguments": told["args"] or {}}
    name, args = whole.get("name"), _object(whole.get("arguments", {}))
    sound = isinstance(name, str) and args is not None
    # the short notation tells the tool even where its arguments are broken
    return True, sound, name if sound or "name" in told else None, json.dumps(args, ensure_ascii=False) if sound else None


def parse(text: Column | str) -> Column:
    """struct(has_call, parsed, tool, args as JSON) of the first call in either notation."""

    @pandas_udf(CALL)
    def read(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_read(x) for x in texts], columns=["has_call", "parsed", "tool", "args"])

    return read(text)


_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.UAdd: operator.pos, ast.USub: operator.neg}


def _value(node: ast.AST) -> float:
    if isinstance(node, ast.Constant) and type(node.value) in (int, float):
        return node.value
    if isinstance(node, ast.UnaryOp) and type(node.op) in _OPS:
        return _OPS[type(node.op)](_value(node.operand))
    if isinstance(node, ast.BinOp):
        a, b = _value(node.left), _value(node.right)
        if isinstance(node.op, ast.Pow):
            # bounded: a tower of powers would take the worker's memory
            if abs(b) > 64 or abs(a) > 1e6:
                raise ValueError("too large")
            return a**b
        return _OPS[type(node.op)](a, b)
    raise ValueError("not arithmetic")


def evaluate(expression: str | None) -> float | None:
    """Value of + - * / ( ) arithmetic (also with x, × and ÷), null for anything else."""
    text = str(expression).replace("×", "*").replace("÷", "/").replace("x", "*")
    if not re.fullmatch(r"[\d\s.+\-*/()]+", text) or len(text) > 1000:
        return None
    try:
        return float(_value(ast.parse(text.strip(), mode="eval").body))
    except (ArithmeticError, KeyError, MemoryError, RecursionError, SyntaxError, TypeError, ValueError):
        return None


def arithmetic(expression: Column | str) -> Column:
    @pandas_udf("double")
    def value(expressions: pd.Series) -> pd.Series:
        return expressions.map(evaluate).astype("float64")

    return value(expression)


def arguments_match(tool: Column, args: Column, accept: Column) -> Column:
    """Whether a call's arguments are acceptable; args and accept are JSON, accept with lists of parts or a number."""
    said = lambda k: F.coalesce(F.get_json_object(args, f"$.{k}"), F.lit(""))
    listed = lambda k: F.coalesce(F.from_json(F.get_json_object(accept, f"$.{k}"), "array<string>"), F.expr("cast(array() as array<string>)"))
    within = lambda k: F.exists(listed(k), lambda a: said(k).contains(a))
    number = F.get_json_object(accept, "$.value").try_cast("double")
    return F.coalesce(
        F.when(tool == "memory_save", within("key") & within("value")).when(tool == "memory_search", within("query")).when(tool == "calculator", is_close(arithmetic(said("expression")), number)).when(tool == "get_date", F.lit(True)),
        F.lit(False),
    )


def graded(outputs: DataFrame) -> DataFrame:
    """(output, want_call, want_tool, accept) with call fields, tool_ok and arg_ok."""
    rows = outputs.withColumn("_call", parse("output")).select("*", "_call.*").drop("_call")
    right = F.coalesce(F.col("tool") == F.col("want_tool"), F.lit(False)) & F.col("parsed")
    return rows.withColumn("tool_ok", right).withColumn("arg_ok", F.col("tool_ok") & arguments_match(F.col("tool"), F.col("args"), F.col("accept")))
