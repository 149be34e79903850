"""Ablations with reuse, combined corpora, public sets with all their columns, extractions, and JSON objects in replies."""

import json

import pytest
from pyspark.sql import functions as F

from loomspark.functions import jsonops as J
from loomspark.operators import corpus, experiments, models, public_sets, retrieval
from loomspark.operators.trajectory import flatten_results, load_results


def test_ablations(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 7} topic{i % 5} common text number {i}") for i in range(60)], "doc_id long, text string")
    options = {x: f"option {x}" for x in "abcd"}
    rows = [(i, f"word{i % 7} common", f"topic{i % 5}", f"a person with word{(i + 3) % 7}", f"question {i}", options, "abcd"[i % 4], ["Adult", "Pediatric", "General"][i % 3]) for i in range(12)]
    q = spark.createDataFrame(rows, "q_id long, full string, core string, profile string, question string, options map<string,string>, correct_answer string, target_population string")
    asked = spark.sparkContext.accumulator(0)

    def model(prompts):
        asked.add(len(prompts))
        return [f"Final answer: ({'abcd'[len(p) % 4]})" for p in prompts]

    folder, facts = str(tmp_path), {"corpus": "c", "model": "m", "dataset": "d"}
    got = experiments.ablation(q, docs, folder, "ranking", ["base_rag", "prof_rag"], model, facts, k=(10, 4, 1)).collect()
    assert [(r.condition, r.n, r.n_adult, r.corpus) for r in got] == [("base_rag", 12, 4, "c"), ("prof_rag", 12, 4, "c")] and asked.value == 24
    with pytest.raises(FileExistsError):
        experiments.ablation(q, docs, folder, "ranking", ["base_rag"], model, facts)
    again = experiments.ablation(q, docs, folder, "ranking", ["base_rag", "q_q"], model, facts, k=(10, 4, 1), skip_existing=True).collect()
    assert asked.value == 36 and again[0] == got[0]
    assert sorted(r.condition for r in spark.read.parquet(f"{folder}/ranking/metrics.parquet").collect()) == ["base_rag", "prof_rag", "q_q"]
    with pytest.raises(ValueError, match="has 12 rows"):
        experiments.ablation(q.where("q_id < 5"), docs, folder, "ranking", ["q_q"], model, facts, skip_existing=True)
    # the same documents as the cascade, in the layout that results have
    one = [x for x in (tmp_path / "ranking").iterdir() if x.name.startswith("prof_rag")][0]
    rows = flatten_results(load_results(spark, str(one))).select("question_id", "stage", "rank", "corpus_index", "score", "condition", "query_kind", "reranked", "requested_k").collect()
    want = retrieval.cascade(docs, q, (10, 4, 1)).where("condition = 'prof_rag'").collect()
    ids = spark.read.parquet(str(one))
    assert "id" not in ids.columns and len(rows) == len(want)
    assert sorted((r.stage, r["rank"], r.corpus_index, r.score) for r in rows) == sorted((r.stage, r["rank"], r.doc_id, r.score) for r in want)
    assert {(r.stage, r.query_kind, r.reranked, r.requested_k) for r in rows} == {("initial", "core", False, 10), ("middle", "full", False, 4), ("final", "profile", True, 1)}
    swapped = experiments.ablation(q, docs, folder, "profile", ["original", "cross_group"], model, facts, k=(10, 4, 1)).collect()
    assert [r.ablation for r in swapped] == ["profile"] * 2
    other = [x for x in (tmp_path / "profile").iterdir() if x.name.startswith("cross_group")][0]
    assert all(r.ablation_profile == r.profile and r.retrieval_trajectory.final.query == r.profile for r in spark.read.parquet(str(other)).collect())


def test_combined_corpus(spark):
    a = spark.createDataFrame([(0, " one two three ", "x"), (1, "same", "y"), (2, "  ", "z"), (3, "same", "w")], "n long, text string, m string")
    b = spark.createDataFrame([(5, "same", 1), (6, "only here", 2), (7, "one two three four", 3)], "n long, article_abstract string, k int")
    docs = corpus.tagged([("A", a), ("B", b)], "n")
    assert sorted((r.source, r.source_index, r.text, r.m, r.k) for r in docs.collect() if r.source == "B") == [("B", "5", "same", None, 1), ("B", "6", "only here", None, 2), ("B", "7", "one two three four", None, 3)]
    once = {r.text: (r.source, r.n, r.source_membership) for r in corpus.with_membership(docs, ["source_no", "n"]).collect()}
    assert once == {"one two three": ("A", 0, ["A"]), "same": ("A", 1, ["A", "B"]), "only here": ("B", 6, ["B"]), "one two three four": ("B", 7, ["B"])}
    cut = lambda d: corpus.chunk(d, 3, 0)
    got = sorted((r.source, r.n, r.chunk_id, r.text, r.source_membership) for r in corpus.combined_chunks(docs, ["source_no", "n"], cut).collect())
    assert got == [("A", 0, 0, "one two three", ["A", "B"]), ("A", 1, 0, "same", ["A", "B"]), ("B", 6, 0, "only here", ["B"]), ("B", 7, 0, "one two three", ["A", "B"]), ("B", 7, 1, "four", ["B"])]
    assert corpus.combined_chunks(docs, ["source_no", "n"], cut, keep_duplicates=True).count() == 7


def test_public_sets_keep_their_columns(spark):
    a = public_sets.lettered(spark.createDataFrame([("1", "q", "a", "b", "c", None, "Anatomy")], "id string, question string, opa string, opb string, opc string, opd string, subject_name string"), "s1")
    b = public_sets.mapped(spark.createDataFrame([(2, "q", {"A": "x", "B": "y"}, "B", "Diagnosis")], "id long, question string, options map<string,string>, label string, medical_task string"), "s2")
    c = public_sets.indexed(spark.createDataFrame([("u", "q", *"abcde", "c", "C", "because")], "link string, question string, opa string, opb string, opc string, opd string, ope string, answer string, answer_idx string, explanation string"), "s3")
    d = public_sets.given(spark.createDataFrame([("7", ("q", {"A": "x"}, "A"), "Surgery")], "id string, data struct<Question:string,Options:map<string,string>,`Correct Option`:string>, subject_name string"), "s4")
    got = {r.source: (r.question, r.correct_option, r.correct_answer, r.explanation, r.subject_name, r.medical_task) for r in public_sets.union([a, b, c, d]).collect()}
    assert got == {"s1": ("q", "", "", None, "Anatomy", None), "s2": ("q", "b", "y", None, None, "Diagnosis"), "s3": ("q", "c", "c", "because", None, None), "s4": ("q", "A", None, None, "Surgery", None)}
    with pytest.raises(ValueError):
        public_sets.given(spark.range(1), "s")


def test_profiles_are_all_or_none(spark):
    df = spark.createDataFrame([("p1", "c1", "q1"), (None, "c2", "q2")], "extracted_patient_profile string, extracted_question_core string, question string")
    reply = lambda prompts: [json.dumps({"PATIENT_PROFILE": "from " + p, "QUESTION_CORE": "core"}) if "q2" in p else "none" for p in prompts]
    got = models.with_profiles(df, reply, "of {question}", F.col("question")).orderBy("question").collect()
    assert [(x.extracted_patient_profile, x.extracted_question_core) for x in got] == [("general patient", "q1"), ("from of q2", "core")]
    whole = df.na.fill("p")
    assert models.with_profiles(whole, None, "", F.col("question")) is whole


@pytest.mark.parametrize(
    ("text", "want"),
    [('{"a": 1}', {"a": 1}), ('```json\n{"a": 1}\n```', {"a": 1}), ('so {"a": {"b": 2}} end', {"a": {"b": 2}}), ('{"a": 1,}', None), ("[1]", None), ('[{"a": 1}]', None), ("none", None), ('{"a": 1} {"b": 2}', None), ('```JSON {"a": 1}```', {"a": 1})],
)
def test_json_objects(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(F.to_json(J.json_object(F.col("t"))).alias("v")).first().v
    assert (json.loads(got) if got else None) == want
