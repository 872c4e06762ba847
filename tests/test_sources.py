"""Sources and sinks over small files."""

import json

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import evaluation, personas, sampling
from corpusmill.sources import files


@pytest.fixture()
def exams(tmp_path):
    for subject in ("law", "art", "bio"):
        for split in ("train", "val", "test"):
            (tmp_path / f"{subject}_{split}.csv").write_text(f'question,A,B,C,D,answer\n"{subject}, ""{split}""",1,2,3,4,B\n', encoding="utf-8")
    return str(tmp_path)


def test_exam_tables(spark, exams):
    assert files.subjects(spark, exams) == ["art", "bio", "law"]
    rows = files.exam_tables(spark, exams).collect()
    assert sorted((r.subject, r.split) for r in rows) == [(s, p) for s in ("art", "bio", "law") for p in ("train", "val")]
    assert {r.question for r in rows if r.subject == "law"} == {'law, "train"', 'law, "val"'}


def test_json_lines_and_raw_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "甲"}\n\n{broken\n{"other": 1}\n', encoding="utf-8")
    good, bad = files.json_lines(spark, "text string", str(tmp_path / "a.jsonl"))
    assert [r.text for r in good.collect()] == ["甲", None] and [r.value for r in bad.collect()] == ["{broken"]
    assert files.lines(spark, str(tmp_path / "a.jsonl"), head=2).count() == 2
    files.write_json_lines(good, str(tmp_path / "out"))
    assert sorted(json.loads(x.value)["text"] or "" for x in files.lines(spark, str(tmp_path / "out")).collect()) == ["", "甲"]
    assert files.lines(spark, str(tmp_path / "out")).where(F.col("value").contains("甲")).count() == 1


def test_questions_by_extension(spark, tmp_path):
    row = {"subject": "s", "question": "q", "A": "1", "B": "2", "C": "3", "D": "4", "answer": "A"}
    (tmp_path / "q.jsonl").write_text(json.dumps(row) + "\n\n" + json.dumps(row) + "\n")
    assert files.questions(spark, str(tmp_path / "q.jsonl")).count() == 2
    (tmp_path / "bad.jsonl").write_text(json.dumps(row | {"answer": "E"}) + "\n")
    with pytest.raises(Exception, match="A-D"):
        files.questions(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "q.csv").write_text("subject,question\ns,q\n")
    with pytest.raises(ValueError, match="columns missing"):
        files.questions(spark, str(tmp_path / "q.csv"))


def test_tool_registry_and_hub_split(spark, tmp_path):
    (tmp_path / "tools.json").write_text(json.dumps({"tools": [{"name": "a", "description": "x", "parameters": {"type": "object"}}, {"name": "b"}]}, indent=1))
    assert [r.name for r in files.tool_registry(spark, str(tmp_path / "tools.json")).collect()] == ["a", "b"]
    (tmp_path / "hub.jsonl").write_text(json.dumps({"question": "q", "A": "1", "B": "2", "C": "3", "D": "4", "answer": "A", "more": 1}) + "\n")
    df = files.hub_split(spark, str(tmp_path / "hub.jsonl"), "law", "test")
    assert df.columns == ["subject", "question", "A", "B", "C", "D", "answer", "split"] and df.count() == 1


def test_shards_in_a_seeded_order():
    plain = files.shards("s3://b/part-{index:05d}-of-{count:05d}.parquet", 3)
    assert plain == [f"s3://b/part-{i:05d}-of-00003.parquet" for i in range(3)]
    mixed = files.shards("{index}", 50, seed=1)
    assert mixed != files.shards("{index}", 50) and sorted(mixed) == sorted(files.shards("{index}", 50)) and mixed == files.shards("{index}", 50, seed=1)


def test_ranks_do_not_depend_on_ranges(spark):
    df = spark.createDataFrame([(None if i % 7 == 0 else f"s{i % 3}", i) for i in range(300)], "stratum string, id long").repartition(5)
    one, many = ({(r.stratum, r.id): (r.rank, r.size) for r in sampling.ranked(df, "stratum", 3, "id", rows=n).collect()} for n in (10**6, 7))
    assert one == many and len(many) == 300 and sorted(v[0] for k, v in many.items() if k[0] == "s1") == list(range(1, many[("s1", 1)][1] + 1))


def test_generated_tools_and_personas(spark):
    items = personas.generate_tools(spark, 400, 5).collect()
    kinds = {r.kind for r in items}
    assert kinds == set(personas.TOOL_KINDS)
    for r in items:
        e = json.loads(r.expected)
        assert (e["action"] == "answer") == r.kind.startswith("answer")
        if r.kind == "calculator":
            from corpusmill.operators.toolcalls import evaluate

            assert evaluate(e["args"]["expression"]) == e["accept"]["value"]
    assert [tuple(r) for r in personas.generate_tools(spark, 400, 5).repartition(7).collect() and items[:3]] == [tuple(r) for r in items[:3]]
    people = personas.generate(spark, 30, 2, forced=("rent",), held_out={"city": ("住在{v}的是我。",)}, chance=1.0)
    turns, questions = evaluation.flattened(people)
    assert people.where(F.element_at("profile", "房租").isNotNull()).count() == 30
    assert turns.where(F.col("text").startswith("住在")).count() > 0 and turns.where(F.col("text").startswith("我家在")).count() == 0
    # evidence points at a turn that holds the answer
    told = {(r.persona_id, r.session_id, r.turn): r.text for r in turns.collect()}
    for q in questions.collect():
        for s, t in q.evidence:
            assert q.options[q.answer] in told[(q.persona_id, s, t)]
