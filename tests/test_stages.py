import pytest
from pyspark.sql import functions as F

from loomspark.functions import jsonops as J
from loomspark.operators import prompts, public_sets, stages


def test_stage_round_trip(spark):
    pages = spark.createDataFrame([(1, "<p>" + "long text " * 20 + "</p>"), (2, "<p>short</p>"), (3, "<b>" + "other text " * 20 + "</b>")], "k long, html string")
    req = stages.page_requests(pages, "k", "html", system="s", temperature=0.0, batch_size=1)
    assert [(r.key, r.batch) for r in req.orderBy("key").collect()] == [(1, 1), (3, 2)]
    good = '{"is_relevant": true, "target_population": "Adult", "category": "Post-op & Pain", "reason": "r"}'
    line = lambda k, t: F.to_json(
        F.struct(
            F.lit(k).alias("key"),
            F.struct(
                F.array(F.struct(F.struct(F.array(F.struct(F.lit(t).alias("text"))).alias("parts")).alias("content"))).alias("candidates")
            ).alias("response"),
        )
    )
    lines = spark.range(1).select(
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("line"), line("1", "no").alias("value")),
                F.struct(F.lit(2).alias("line"), line("1", good).alias("value")),
                F.struct(F.lit(3).alias("line"), line("9", good).alias("value")),
            )
        ).alias("x")
    ).select("x.*")
    ok, bad = stages.merge_results(pages.where("k <> 2"), "k", stages.results(lines), J.stage1_error)
    assert [r.k for r in ok.select("k").collect()] == [1]
    assert {r.key: r.status for r in bad.collect()} == {"3": "missing", "9": "unexpected"}


def test_public_sets(spark):
    a = public_sets.lettered(spark.createDataFrame([(1, "q", "w", "x", "y", "z")], "id long, question string, opa string, opb string, opc string, opd string"), "one")
    b = public_sets.mapped(spark.createDataFrame([("k", "q", {"A": "u", "B": "v"}, "B")], "id string, question string, options map<string,string>, label string"), "two")
    got = {r.id: r for r in public_sets.union([a, b]).collect()}
    assert got["k"].correct_answer == "v" and len(got["1"].options) == 4
    with pytest.raises(ValueError):
        public_sets.union([a, a])


def test_budget(spark):
    df = spark.createDataFrame([("ask {context}", "c" * 1000)], "p string, c string")
    got = prompts.within_budget(df, "p", "c", "o", 300, len).first().o
    assert len(got) <= 300 and got.startswith("ask ccc")


def test_prompt(spark):
    df = spark.createDataFrame([("q?", {"b": "2", "a": "1"}, None)], "q string, o map<string,string>, p string")
    text = df.select(prompts.mcqa_prompt(F.col("q"), F.col("o"), profile=F.col("p"), instruction="Do.")).first()[0]
    assert text.startswith("### Instruction: Do.\n\n### Output structure:\n") and text.endswith("### Question: q?\n(A): 1\n(B): 2\n\n### Answer:") and "profile" not in text


def test_conditions_from_retrieval_to_accuracy(spark):
    from loomspark.operators import experiments, models, trajectory

    docs = spark.createDataFrame([(0, "child with fever", "s"), (1, "adult pain dose", "t"), (2, "other words", "s")], "doc_id long, text string, source string")
    options = {x: x for x in "abcd"}
    q = spark.createDataFrame(
        [
            (1, "fever of a child", "fever", "child", "why fever", options, "a", "Pediatric"),
            (2, "pain dose", "dose", "adult", "which dose", options, "b", "Adult"),
        ],
        "q_id long, full string, core string, profile string, question string, options map<string,string>, correct_answer string, target_population string",
    )
    rows = experiments.run(docs, q, models.echo, (2, 2, 1)).collect()
    assert len(rows) == 10 and {r.condition for r in rows} == {"no_rag", "base_rag", "prof_rag", "q_qp", "q_q"}
    for r in rows:
        text = {1: "child with fever", 2: "adult pain dose"}[r.q_id]
        assert (text in r.prompt) == (r.condition != "no_rag") and r.predicted == "abcd"[len(r.prompt) % 4]
    got = experiments.report(spark.createDataFrame(rows)).where("population = 'All'").collect()
    assert [r.condition for r in got] == ["no_rag", "base_rag", "prof_rag", "q_qp", "q_q"] and all(r.n == 2 for r in got)
    flagged = spark.createDataFrame([("unknown",), ("s",)], "document_source string")
    assert len(trajectory.source_warnings(flagged)) == 2 and trajectory.source_warnings(spark.createDataFrame([("both",)], "document_source string")) == []


def test_validators_take_typed_and_odd_objects_alike(spark):
    """objects of the usual types are read at once, others field by field; both say the same."""
    import json

    q = {"question_type": "Diagnosis", "target_population": "Adult", "category": "c", "patient_profile": "p", "scenario": "s", "question": "q", "options": {"a": "1", "B": "2", "c": "3", "d": "4"}, "correct_answer": "b", "explanation": "e", "difficulty": "Easy"}
    r = {"condition_base": "c", "action": "a", "triggers": [{"criterion": "t"}], "source_fragment": "f", "notes": None}
    without = lambda d, k: {x: y for x, y in d.items() if x != k}
    asked = [(q, None), (q | {"extra": 1}, None), (without(q, "scenario"), "scenario is missing"), (q | {"question": " "}, "question is blank"), (q | {"question": 3}, "question is blank")]
    asked += [(q | {"options": {"a": "1", "b": " ", "c": "3", "d": "4"}}, "options are not a-d"), (q | {"options": {"a": 1, "b": "2", "c": "3", "d": "4"}}, "options are not a-d"), (q | {"difficulty": "x"}, "unknown difficulty")]
    ruled = [(r, None), (r | {"notes": "n"}, None), (r | {"notes": 1}, "notes is no text"), (without(r, "notes"), "notes is missing"), (r | {"triggers": []}, "a rule has no trigger")]
    ruled += [(r | {"triggers": [{"criterion": "t"}, {"criterion": " "}]}, "a trigger has no criterion"), (r | {"triggers": [{"criterion": "t"}, {}]}, "a trigger has no criterion"), (r | {"action": ""}, "action is blank")]
    got = spark.createDataFrame([(i, json.dumps([x])) for i, (x, _) in enumerate(asked)], "i int, t string")
    got = got.select("i", J.stage3_error(J.parsed(F.col("t")), F.lit("Adult"), F.lit("c")).alias("e")).orderBy("i").collect()
    assert [x.e for x in got] == [e for _, e in asked]
    got = spark.createDataFrame([(i, json.dumps({"rules": [x]})) for i, (x, _) in enumerate(ruled)], "i int, t string")
    assert [x.e for x in got.select("i", J.stage2_error(J.parsed(F.col("t"))).alias("e")).orderBy("i").collect()] == [e for _, e in ruled]
