"""Every query of the engine by name, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.plans import corpus, dialogue, evaluation, records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = corpus.QUERIES | records.QUERIES | dialogue.QUERIES | evaluation.QUERIES
ORACLE_SQL: dict[str, str] = corpus.ORACLE_SQL | records.ORACLE_SQL | dialogue.ORACLE_SQL | evaluation.ORACLE_SQL
