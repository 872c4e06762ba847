import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import memory as R
from corpusmill.operators import personas, sampling, toolcalls

TEXTS = [None, "", "　", "一。二！三？" * 100, "無標點" * 300, "a" * 400, "a" * 401, "短\n\n短", "x\r\ny", "😀。" * 250]


def test_chunks_of_both_forms(spark):
    df = spark.createDataFrame([(x,) for x in TEXTS], "t string")
    for most, least in ((400, 1), (50, 10), (7, 1)):
        for r in df.select("t", T.chunk_udf(most, least)("t").alias("a"), T.chunk_native(F.coalesce("t", F.lit("")), most, least).alias("b")).collect():
            assert r.a == r.b
            assert all(least <= len(c) <= most for c in r.a)
            if least == 1:
                assert re.sub(r"\s", "", "".join(r.a)) == re.sub(r"\s", "", r.t or "")


def test_bigrams_of_short_texts(spark):
    rows = spark.createDataFrame([("",), ("a",), ("aba",), ("aaaa",)], "t string").select(T.bigrams("t").alias("b")).collect()
    assert [r.b for r in rows] == [[], [], ["ab", "ba"], ["aa"]]


@settings(max_examples=200, deadline=None)
@given(st.text("0123456789+-*/(). x×÷", max_size=20))
def test_arithmetic_never_raises(s):
    v = toolcalls.evaluate(s)
    assert v is None or isinstance(v, float)


def test_arithmetic():
    assert toolcalls.evaluate("(1+2)×3÷4") == 2.25
    assert toolcalls.evaluate("9**9**9") is None
    assert toolcalls.evaluate("1/0") is None
    assert toolcalls.evaluate("__import__('os')") is None


def test_samples_do_not_depend_on_partitions(spark):
    one, many = spark.range(1000).coalesce(1), spark.range(1000).repartition(13)
    for f in (lambda d: sampling.bernoulli(d, 0.3, 1, "id"), lambda d: sampling.fixed(d, 50, 1, "id"), lambda d: sampling.stratified_sample(d.withColumn("s", F.col("id") % 7), "s", 0.1, 10, 1, "id")):
        assert sorted(r.id for r in f(one).collect()) == sorted(r.id for r in f(many).collect())


def test_numbered_is_a_permutation(spark):
    df = sampling.numbered(spark.range(500).repartition(7).withColumn("k", sampling.order_key(1, "id")), "k")
    rows = sorted((r.k, r.position) for r in df.collect())
    assert [p for _, p in rows] == list(range(500))


def test_empty_tables(spark):
    none = spark.range(0)
    assert sampling.byte_budget(none.withColumn("t", F.lit("x")), F.col("t"), 10, 1, "id").count() == 0
    assert sampling.calibrated(none, 5, 1, "id").count() == 0


def test_personas_hold_what_they_promise(spark):
    rows = personas.generate(spark, 40, 1).collect()
    assert sorted(map(str, rows)) == sorted(map(str, personas.generate(spark.newSession(), 40, 1).repartition(3).collect()))
    for p in rows:
        dates = [s.date for s in p.sessions]
        assert dates == sorted(dates) and len(p.questions) == 10
        for q in p.questions:
            assert len(set(q.options.values())) == 4
            assert (q.options[q.answer] == personas.ABSTAIN) == (q.type == "abstain")
            for s, t in q.evidence:
                assert q.options[q.answer] in p.sessions[s].turns[t]


@pytest.mark.parametrize(
    "change, rows",
    [
        (T.markdown_to_plain, [("# 標題\n\n**粗體**與*斜體*", "標題\n粗體與斜體"), ("***x*** a_b_c", "x abc"), ("　前後空白　", "前後空白"), ("a\r## b\n##   c", "a\r## b\nc"), ("", ""), ("😀 _底線_\n\n\n尾", "😀 底線\n尾"), ("**a *b* c**", "a b c")]),
        (T.text_or_json, [('{"text": "甲"}', "甲"), ("只是文字", "只是文字"), ('{"other": 1}', None), ("[1,2", "[1,2"), ('{"text": ""}', "")]),
        (T.sniffed_text, [('{"conversations": [{"role": "user", "content": "問"}], "text": "x"}', "問"), ('{"text": "文"}', "文"), ('{"a": 1}', "")]),
        (T.is_question, [("我住在哪裡？", True), ("我住台南，你去過嗎？", False), ("我住台南。", False), ("really?", True), ("？\n", False)]),
        (R.about_other, [("我朋友住高雄", True), ("跟你說，我大學同學對蛋過敏", True), ("聽說我主管要轉職", True), ("我每個禮拜都跟朋友去打籃球", False), ("我跟我老公的女兒5歲", False), ("我姐姐是老師", True)]),
    ],
)
def test_samples(spark, change, rows):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "id int, x string")
    assert [r.y for r in df.select("id", change("x").alias("y")).orderBy("id").collect()] == [r[1] for r in rows]
