"""Top-k with bounds against all scores, the index on disk, dense products, and prompts within a budget."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.functions.text import format_context
from loomspark.operators import index, prompts
from loomspark.operators import retrieval as R


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    texts = [" ".join(rng.choices(words, weights, k=rng.randrange(60))) for _ in range(900)]
    texts[10] = texts[11] = texts[12]  # ties
    docs = spark.createDataFrame([(i, t if i % 97 else None) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5).cache()
    queries = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(25)))) for i in range(40)]
    queries += [(100, "w0"), (101, "w299 w298 w0 w0 w0"), (102, "unknown"), (103, None), (104, texts[12])]
    return docs, spark.createDataFrame(queries, "item_id long, text string")


def rows(df):
    return sorted((r.q_id, r["rank"], r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize("k", [1, 5, 64, 5000])
def test_bounds_lose_nothing(corpus, k):
    docs, queries = corpus
    want = R.top_k(R.bm25_scores(docs, R.query_terms(queries, "item_id", "text")), k, "q_id")
    assert rows(R.bm25_top_k(docs, queries, k)) == rows(want)
    terms = R.written(R.query_terms(queries, "item_id", "text"))
    assert rows(R.best_k(R.gathered(docs, terms), terms, k, direct=0)) == rows(want)


def test_index_on_disk(spark, corpus, tmp_path):
    docs, queries = corpus
    path = str(tmp_path / "index")
    assert index.opened(spark, path) is None
    p = index.indexed(docs, path, {"of": 1}, buckets=8)
    want = rows(R.bm25_top_k(docs, queries, 10))
    assert rows(index.top_k(p, queries, 10)) == want
    note = index.versions.current(spark, path)
    # another session doesn't know the tables
    for part in ("rows", "stats"):
        spark.sql(f"DROP TABLE index_{note['version']}_{part}")
    again = index.indexed(docs.limit(0), path, {"of": 1})
    assert index.versions.current(spark, path) == note and rows(index.top_k(again, queries, 10)) == want
    # a few terms read a few buckets, and postings are not dealt out
    terms = R.written(R.query_terms(queries.where("item_id = 100"), "item_id", "text"))
    few = index.of_terms(again, terms)
    plan = R._added(few.rows, terms.join(few.stats, "term"), few.avg_len, "q_id")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "SelectedBucketsCount: 1 out of 8" in plan and "hashpartitioning(term" not in plan
    grouped = again.rows.groupBy("term").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in grouped
    # what has changed is built anew, or an error
    with pytest.raises(ValueError, match="was made of"):
        index.indexed(docs, path, {"of": 2}, changed="error")
    half = docs.where("doc_id < 400")
    assert rows(index.top_k(index.indexed(half, path, {"of": 2}, buckets=4), queries, 10)) == rows(R.bm25_top_k(half, queries, 10))
    assert index.versions.current(spark, path)["number"] == 2


def test_terms_too_many_to_name(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "MOST_TERMS", 3)
    docs, queries = corpus
    p = index.indexed(docs, str(tmp_path / "i"), {}, buckets=3)
    assert rows(index.top_k(p, queries, 7)) == rows(R.bm25_top_k(docs, queries, 7))
    empty = index.indexed(docs.limit(0), str(tmp_path / "e"), {})
    assert index.top_k(empty, queries, 7).collect() == []


def test_cascade_with_and_without_an_index(spark, corpus, tmp_path):
    docs, queries = corpus
    q = queries.select(F.col("item_id").alias("q_id"), F.col("text").alias("full"), F.substring_index("text", " ", 3).alias("core"), F.substring_index("text", " ", -2).alias("profile"))
    found = lambda df: sorted((r.condition, r.q_id, r.stage, r["rank"], r.doc_id, r.score) for r in df.collect())
    got = found(R.cascade(docs, q, (20, 6, 2)))
    # all scores of all kinds, stage by stage
    scores = {}
    for kind in ("full", "core", "profile"):
        for r in R.bm25_scores(docs, R.query_terms(q.select("q_id", kind), "q_id", kind)).collect():
            scores[r.q_id, kind, r.doc_id] = r.score
    want = []
    for condition, (first, middle, final) in R.CONDITIONS.items():
        for (item,) in q.select("q_id").collect():
            had = sorted(((-s, d) for (i, k, d), s in scores.items() if i == item and k == first))[:20]
            want += [(condition, item, "initial", n, d, -s) for n, (s, d) in enumerate(had, 1)]
            for stage, kind, most in (("middle", middle, 6), ("final", final, 2)):
                had = sorted((s if kind is None else -scores.get((item, kind, d), 0.0), d) for s, d in had)[:most]
                want += [(condition, item, stage, n, d, -s) for n, (s, d) in enumerate(had, 1)]
    assert got == sorted(want)
    p = index.indexed(docs, str(tmp_path / "i"), {}, buckets=4)
    assert found(R.cascade(docs, q, (20, 6, 2), index=p)) == got


@pytest.mark.parametrize(("k", "block"), [(1, 4096), (7, 3), (2000, 4096)])
def test_dense_products(spark, k, block):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 5)).round(1)  # many ties
    v[50:90] = v[50]
    rows_ = [(i, x.tolist() if i % 60 else None) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<float>").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = rows(R.dense_top_k(df, df.where("vec_id % 40 = 1"), k, block=block))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    f = {i: np.array(x, np.float32).astype(float) for i, x in rows_ if x is not None}
    want = []
    for q in f:
        if q % 40 == 1:
            best = sorted((-round(float(f[q] @ x), 6), i) for i, x in f.items())[:k]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want)]
    assert np.allclose([x[3] for x in got], [x[3] for x in sorted(want)], atol=2e-6)
    assert R.dense_top_k(df.limit(0), df.where("vec_id = 1"), 3).collect() == [] and R.dense_top_k(df, df.limit(0), 3).collect() == []


def test_prompts_within_a_budget(spark):
    rng = random.Random(6)
    count = lambda texts: [len(t.split()) + t.count("zz") * 3 for t in texts]
    data = []
    for i in range(60):
        texts = [" " + " ".join(rng.choice(["a", "bcd", "zz", "longer"]) for _ in range(rng.randrange(900))) + "\n" for _ in range(rng.randrange(5))]
        data.append((i, f"Question {i}\n{{context}}\nend", texts if i % 9 else None, "bare"))
    df = spark.createDataFrame(data, "i long, p string, t array<string>, b string")

    def one_by_one(texts, prompt, budget):
        """Length after length, the longest first."""
        size = 1500
        while True:
            got = prompt.replace("{context}", prompts.laid_out(texts, size))
            if count([got])[0] <= budget:
                return got
            if size <= 128:
                return None
            size = max(128, int(size * 0.75))

    want = {i: "bare" if not t else one_by_one(t, p, 260) for i, p, t, _ in data}
    fits = [i for i, x in want.items() if x is not None]
    got = {r.i: r.o for r in prompts.budgeted(df.where(F.col("i").isin(fits)), "p", "t", "o", 260, count, 1500, "b").collect()}
    assert got == {i: want[i] for i in fits} and len({len(x) for x in got.values()}) > 20
    with pytest.raises(Exception, match="over its budget"):
        prompts.budgeted(df.where("i = 1"), "p", "t", "o", 2, count).collect()
    # the layout of a worker is that of the plan
    odd = [["one"], ["a " * 100, "b" * 90, "c d" * 40, "", " e "], []]
    for most in (10, 80, 4500):
        same = spark.createDataFrame([(t,) for t in odd], "t array<string>").select(format_context(F.col("t"), most).alias("c")).collect()
        assert [r.c for r in same] == [prompts.laid_out(t, most) for t in odd]


def test_products_of_a_block_are_held_in_tiles():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    v = rng.normal(size=(10_000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(v))), pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * 8, pa.array(v.reshape(-1)))], names=["doc_id", "vec"])
    tracemalloc.start()
    got = [r for b in R._best_products([batch], list(range(4096)), v[:4096], 3) for r in b.to_pylist()]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 150e6  # all products of the block: 328 MB, several times over
    for q in (0, 255, 256, 4095):
        want = sorted((-round(float(s), 6), i) for i, s in enumerate(v @ v[q]))[:3]
        assert [(r["doc_id"], round(r["score"], 6)) for r in got if r["q_id"] == q] == [(i, -s) for s, i in want]


def test_words_are_counted_where_a_text_is_read(spark):
    texts = ["A b a, B!", None, "c C1 c", "", "a " * 700 + "É1 K z"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    terms = spark.createDataFrame([("a",), ("c",), ("1",)], "term string")
    plan = R.postings(docs, terms)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    found = lambda df: sorted((r.doc_id, r.len, r.term, r.tf) for r in df.collect())
    assert found(R.postings(docs, terms)) == [(0, 4, "a", 2), (2, 3, "c", 2), (4, 703, "1", 1), (4, 703, "a", 700)]
    p = R.gathered(docs, terms)
    assert (p.n_docs, p.avg_len) == tuple(R.collection(docs).first())
    # rows that repeat an id are one document's postings, as before
    more = docs.unionByName(docs.where("doc_id = 0")).unionByName(spark.createDataFrame([(None, "a"), (None, "a c")], "doc_id long, text string"))
    same = more.select("doc_id", F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+")).alias("term"), F.size(R.bm25_tokens(F.col("text"))).cast("long").alias("len"))
    want = same.where("term in ('a', 'c', '1')").groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
    key = lambda rows_: sorted(rows_, key=str)
    assert key(tuple(r) for r in R.postings(more, terms).select("doc_id", "len", "term", "tf").collect()) == key(tuple(r) for r in want.select("doc_id", "len", "term", "tf").collect())
    p = R.gathered(more, terms)
    assert (p.n_docs, p.avg_len) == tuple(R.collection(more).first())
