"""Queries over the last 300 characters of dialogues against their SQL, where a line ends just before them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import metrics
from corpusmill.plans import catalogue

QUERIES = ["recent_context_300", "aligned_report", "memory_predictions", "memory_prompt", "run_folder", "sft_reading_rows"]


@pytest.fixture(scope="module")
def edge(spark, tmp_path_factory):
    """Conversations whose last line has 295 to 305 characters, some without a text in places, one without any."""
    at = str(tmp_path_factory.mktemp("edge"))
    rows = [(c, t, "user", x) for c in range(66) for t, x in enumerate(("甲" * 20, "😀乙" * 10, None if c % 5 == 0 else "", "丙" * (295 + c % 11), None if c % 7 == 0 else "丁"[: c % 2]))]
    rows += [(66, t, "user", None) for t in range(3)] + [(67, t, "user", x) for t, x in enumerate(["戊" * 150, "己" * 148, *[None] * 9])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(2).write.parquet(f"{at}/conversations.parquet")
    return at


@pytest.mark.parametrize("name", QUERIES)
def test_lines_at_the_edge(spark, edge, name):
    df = catalogue.QUERIES[name](spark, edge)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{edge}/conversations.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def test_shares_round_as_in_sql(spark):
    got = [r.x for r in spark.range(801).orderBy("id").select(metrics.rounded(F.col("id") / 800, 4).alias("x")).collect()]
    assert got == [x for (x,) in duckdb.sql("SELECT round(i / 800::DOUBLE, 4) FROM range(801) AS t(i) ORDER BY i").fetchall()]
