"""Streams of lines and of dialogue turns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusmill.functions import text as T
from corpusmill.operators.memory import about_other

MEMORY = "persona_id string, text string, pos long, about_other boolean"


def transform_lines(lines: DataFrame, change: Column, column: str = "value") -> DataFrame:
    """A stateless change of each line; the same on a stream and on a table."""
    return lines.withColumn(column, change).where(F.length(column) > 0)


class _Latest(StatefulProcessor):
    """Of each persona's equal lines the latest position; turns may come late, the larger position wins."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getMapState("lines", "text string", "pos long, about_other boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changed: dict[str, tuple[int, bool]] = {}
        for batch in rows:
            for text, pos, other in zip(batch["text"], batch["pos"], batch["about_other"]):
                if text not in changed or changed[text][0] < pos:
                    changed[text] = int(pos), bool(other)
        out = []
        for text, (pos, other) in changed.items():
            if not self.lines.containsKey((text,)) or self.lines.getValue((text,))[0] < pos:
                self.lines.updateValue((text,), (pos, other))
                out.append((key[0], text, pos, other))
        yield pd.DataFrame(out, columns=["persona_id", "text", "pos", "about_other"])

    def close(self) -> None:
        pass


def memory_updates(turns: DataFrame) -> DataFrame:
    """Upserts of memory lines from a stream of (persona_id, pos, text): the last one of (persona_id, text) holds.

    Needs the RocksDB state store provider.
    """
    rows = turns.withColumn("text", T.utrim("text")).where(~T.is_question("text")).select(F.col("persona_id").cast("string").alias("persona_id"), F.col("pos").cast("long").alias("pos"), "text", about_other("text").alias("about_other"))
    return rows.groupBy("persona_id").transformWithStateInPandas(_Latest(), MEMORY, "Update", "None")
