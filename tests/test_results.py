"""Result files of both layouts, numbered lines, and what became of batches."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomspark.functions.text import text_hash
from loomspark.operators import trajectory as T
from loomspark.sources import io

STRUCTURED = [
    {"id": 7, "target_population": "Adult", "retrieval_trajectory": {"condition": "c", "backend": "bm25",
        "initial": {"query_kind": "full", "query": "q", "requested_k": 3, "documents": [
            {"rank": 1, "corpus_index": 5, "score": 2.5, "text": "one", "metadata": {"source_membership": ["a", "b"], "source": "z", "n": 1}},
            {"corpus_index": 6, "text": "two", "metadata": {"source": "p|q"}}, "bare", {"text": "it's", "metadata": "{'source': \"o'x\"}"}]},
        "middle": {"documents": None, "requested_k": 8}, "final": {"documents": [], "reranked": True}}},
    {"id": None, "question_id": "x", "retrieval_trajectory": None, "top_64": ["old one", "two"], "top_1": "['it\\'s', \"b\"]"},
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A table of JSON lines, one in parquet with an older layout, a folder of part files, and one written by pandas."""
    p = tmp_path_factory.mktemp("results")
    (p / "a.jsonl").write_text("".join(json.dumps(r) + "\n" for r in STRUCTURED))
    pd.DataFrame({"id": ["k1", "k2"], "candidate_texts": ["['a b', \"it's c\"]", "nan"], "top_64": ["unused", "unused"], "retrieved_texts": ["plain", None]}).to_parquet(p / "b.parquet")
    rows = spark.range(40).select(F.concat(F.lit("r"), "id").alias("question_id"), F.concat(F.lit("{'initial': {'documents': ['t"), "id", F.lit("']}, 'condition': None}")).alias("retrieval_trajectory"))
    rows.orderBy(F.length("question_id"), "question_id").write.parquet(str(p / "c.parquet"))
    pd.DataFrame({"id": [1], "retrieval_trajectory": [{"initial": {"documents": [{"text": "deep"}]}}]}).to_pickle(p / "d.pkl")
    (p / "notes.txt").write_text("no table")
    return str(p)


def test_both_layouts_in_one_folder(spark, folder):
    look = spark.createDataFrame([("two", ["s1"]), ("it's", ["s1", "s2"]), (" t3", ["s3"])], "t string, source_membership array<string>").select(text_hash(F.col("t")).alias("text_hash"), "source_membership")
    got = T.flatten_results(T.load_results(spark, folder), look)
    assert len(got.columns) == 21
    rows = {(r.result_name, r.result_row, r.stage, r["rank"]): r for r in got.collect()}
    a = [(r.question_id, r.target_population, r.condition, r.query_kind, r.requested_k, r.observed_k, r.corpus_index, r.score, r.text, r.source_membership, r.document_source) for k, r in sorted(rows.items()) if k[:3] == ("a", 0, "initial")]
    assert a == [
        ("7", "Adult", "c", "full", 3, 4, 5, 2.5, "one", "a|b", "both"),
        ("7", "Adult", "c", "full", 3, 4, 6, None, "two", "p|q", "both"),
        ("7", "Adult", "c", "full", 3, 4, None, None, "bare", "", "unknown"),
        ("7", "Adult", "c", "full", 3, 4, None, None, "it's", "o'x", "o'x"),
    ]
    assert json.loads(rows["a", 0, "initial", 1].metadata)["n"] == 1 and rows["a", 0, "initial", 3].metadata == "{}"
    assert not [k for k in rows if k[:2] == ("a", 0) and k[2] != "initial"]  # an empty list is no reason to look elsewhere
    old = {(k[2], k[3]): (r.question_id, r.target_population, r.text, r.requested_k, r.document_source, r.query) for k, r in rows.items() if k[:2] == ("a", 1)}
    assert old == {("initial", 1): ("x", "unknown", "old one", 2, "unknown", None), ("initial", 2): ("x", "unknown", "two", 2, "s1", None), ("final", 1): ("x", "unknown", "it's", 2, "both", None), ("final", 2): ("x", "unknown", "b", 2, "unknown", None)}
    b = {k[1:]: r.text for k, r in rows.items() if k[0] == "b"}
    assert b == {(0, "initial", 1): "a b", (0, "initial", 2): "it's c", (0, "final", 1): "plain"}
    c = [(r.result_row, r.source_row_index, r.question_id, r.text, r.document_source) for k, r in sorted(rows.items()) if k[0] == "c"]
    assert c == [(i, str(i), f"r{i}", f"t{i}", "s3" if i == 3 else "unknown") for i in range(40)]
    assert rows["d", 0, "initial", 1].text == "deep" and len({r.result_file for r in rows.values()}) == 4


def test_a_folder_without_tables(spark, tmp_path):
    (tmp_path / "x.txt").write_text("")
    with pytest.raises(ValueError, match="no table"):
        T.load_results(spark, str(tmp_path))


def test_numbers_of_lines_over_splits(spark, tmp_path):
    lines = [f'{{"k": {i}, "t": "{"x" * (i * 37 % 400)}"}}' if i % 7 else ["", "  ", "[1]", "{bad", '{"a": 1} {"b": 2}'][i % 5] for i in range(3000)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_text("\r\n".join(lines[:50]))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.text(str(tmp_path / "a.jsonl")).rdd.getNumPartitions() > 10
        got = sorted((r.file.rsplit("/")[-1], r.line, r.value, r.error is None) for r in io.read_json_lines(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)

    def valid(x):
        try:
            return isinstance(json.loads(x), dict)
        except ValueError:
            return False

    want = [(f, i, x, valid(x)) for f, some in (("a.jsonl", lines), ("b.jsonl", lines[:50])) for i, x in enumerate(some, 1) if x.strip()]
    assert got == want


def test_rows_with_their_own_sources_are_dealt_out(spark, tmp_path, monkeypatch):
    """A lookup too large to broadcast: rows that look nothing up are not all one task's."""
    monkeypatch.setattr(T, "small", lambda df: df)
    docs = [{"rank": i, "text": f"t{i}", "metadata": {"source": "s"}} for i in range(200)]
    (tmp_path / "a.jsonl").write_text("".join(json.dumps({"id": k, "retrieval_trajectory": {"initial": {"documents": docs}, "final": {"documents": [f"t{k}"]}}}) + "\n" for k in range(20)))
    look = spark.createDataFrame([("t3", ["x", "y"])], "t string, source_membership array<string>").select(text_hash(F.col("t")).alias("text_hash"), "source_membership")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = T.flatten_results(T.load_results(spark, str(tmp_path)), look).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was[0])
        spark.conf.set("spark.sql.adaptive.enabled", was[1])
    parts = [r.part for r in rows if r.stage == "initial"]
    assert len(parts) == 4000 and max(parts.count(p) for p in set(parts)) < 2000
    assert {r.source_membership for r in rows if r.stage == "initial"} == {"s"}
    assert {(r.question_id, r.source_membership) for r in rows if r.stage == "final" and r.source_membership} == {("3", "x|y")}


def test_batches_sort_the_texts_once(spark, monkeypatch):
    """what requests and results are made of is written, so no reader shuffles the texts again."""
    from loomspark.plans import results as R

    seen, write = [], R.io.write_request_batches
    monkeypatch.setattr(R.io, "write_request_batches", lambda df, path, **how: (seen.append(how["source"]), write(df, path, **how))[1])
    R.batch_results(spark, "/root/testdata/sf0.001")
    assert len(seen) == 1 and "Exchange" not in seen[0]._jdf.queryExecution().executedPlan().toString()
