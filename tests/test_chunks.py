"""Chunks are cut in the JVM, in one go over a text."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import sampling
from corpusmill.plans import catalogue


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Texts with ends, blanks, marks and letters beyond the first plane where windows of 400 and chunks end."""
    at, draw = str(tmp_path_factory.mktemp("odd")), random.Random(7)
    texts = ["字" * 400 + " " * 400 + "尾" * 200, "字" * 399 + "。" + " " * 401 + "。尾" * 90, "字" * 200 + "\n" + "字" * 199, "字" * 200 + "\n" + "字" * 200, "字" * 149, "字" * 150, "", "　", None, "甲。" * 40_000, "甲" * 70_001]
    texts += ["".join(draw.choice(("字", "a", "😀", " ", "　", "\r", "\n", "。", ".", "？", "b" * 90, "甲乙" * 40, "\n\n", "# ", " " * 50)) for _ in range(draw.randint(1, 400))) for _ in range(300)]
    spark.createDataFrame([(i, x, "zh" if i % 2 else "en") for i, x in enumerate(texts)], "doc_id long, text string, lang string").repartition(3).write.parquet(f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize("name", ["corpus_chunk_stats", "corpus_jsonl"])
def test_chunk_queries(spark, odd, name, capsys):
    df = catalogue.QUERIES[name](spark, odd)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{odd}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)
    df.explain(True)
    assert "ArrowEvalPython" not in capsys.readouterr().out


def test_chunks_of_odd_texts(spark, odd):
    for r in spark.read.parquet(f"{odd}/documents.parquet").where("length(text) < 20000").select(T.chunk_udf(400, 1)("text").alias("a"), T.chunk_native("text", 400, 1).alias("b")).collect():
        assert list(r.a) == list(r.b or [])


def test_trim_as_strip(spark):
    texts = [(x + "a" + x + "b" + x + x,) for x in map(chr, (*range(1, 0xD800), *range(0xE000, 0x10000), 0x1F600))]
    assert all(r.t == r.x.strip() for r in spark.createDataFrame(texts, "x string").select("x", T.utrim("x").alias("t")).collect())


def test_budget_leaves_later_ranges(spark):
    df = spark.range(3000).select("id", F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")).alias("t")).repartition(5)
    rows = sorted((r.k, r.id, len(r.t)) for r in df.select("id", "t", sampling.order_key(5, "id").alias("k")).collect())
    for target in (0, 1, 500, 4000, 10**6):
        want, before = [], 0
        for _, i, n in rows:
            want += [(i, n, before)] if before < target else []
            before += n
        got = sampling.byte_budget(df, F.col("t"), target, 5, "id").select("id", "bytes", "bytes_before").collect()
        assert sorted(map(tuple, got), key=lambda r: want.index(r) if r in want else -1) == want
