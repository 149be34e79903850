"""Loaders with checks, files, chunks by a tokenizer, and the stages of construction from end to end."""

import hashlib
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomspark.functions import jsonops as J
from loomspark.operators import agreement as A
from loomspark.operators import corpus, metrics, stages, trajectory
from loomspark.plans.construction import S1
from loomspark.sources import io


def ratings(spark, *rows):
    cols = ", ".join(f"`{m}` string" for m in (*A.ORDINAL, A.TARGET))
    return spark.createDataFrame([(k, *marks) for k, *marks in rows], f"data_id string, {cols}")


def test_ratings(spark):
    good = A.checked_ratings(ratings(spark, (" a ", "1", "2", "3.0", "5", "Correct "), ("b", "1", "1", "1", "1", "Incorrect")))
    assert [tuple(r) for r in good.orderBy("data_id").collect()] == [("a", 1, 2, 3, 5, "Correct"), ("b", 1, 1, 1, 1, "Incorrect")]
    for bad, what in [
        ((" ", "1", "1", "1", "1", "Correct"), "empty"),
        (("a", "6", "1", "1", "1", "Correct"), "1 to 5"),
        (("a", "1.5", "1", "1", "1", "Correct"), "1 to 5"),
        (("a", None, "1", "1", "1", "Correct"), "1 to 5"),
        (("a", "x", "1", "1", "1", "Correct"), "1 to 5"),
        (("a", "1", "1", "1", "1", "yes"), "Incorrect"),
    ]:
        with pytest.raises(ValueError, match=what):
            A.checked_ratings(ratings(spark, bad))
    with pytest.raises(ValueError, match="unique"):
        A.checked_ratings(ratings(spark, ("a", *"1111", "Correct"), ("a ", *"1111", "Correct")))


def test_model_labels(spark):
    def labels(rows):
        return spark.createDataFrame(rows, "id long, source string, question_type string, target_population string, is_anesthesia_model boolean")

    a = A.checked_labels(labels([(1, "s", "OTHER", "Adult", True), (2, "s", "DIAGNOSIS", "General", False)]), "a")
    b = A.checked_labels(labels([(2, "s", "OTHER", "Adult", True), (1, "s", "OTHER", "Adult", True)]), "b")
    assert A.aligned_labels([a, b]).count() == 4
    with pytest.raises(ValueError, match="lacks"):
        A.aligned_labels([a, b.where("id = 1")])
    with pytest.raises(ValueError, match="sources"):
        A.aligned_labels([a, b.withColumn("source", F.lit("t"))])
    for bad, what in [
        ([(1, "s", "Other", "Adult", True)], "question_type"),
        ([(1, "s", "OTHER", "adult", True)], "target_population"),
        ([(1, "s", "OTHER", "Adult", None)], "is_anesthesia_model"),
        ([(None, "s", "OTHER", "Adult", True)], "id is missing"),
        ([(1, "s", "OTHER", "Adult", True)] * 2, "unique"),
    ]:
        with pytest.raises(ValueError, match=what):
            A.checked_labels(labels(bad), "m")


def test_kappa_against_all_pairs_of_labels(spark):
    rows = [(i % 5, (i * i + i) % 7) for i in range(60)]
    df = spark.createDataFrame(rows, "a int, b int")
    labels = sorted({x for r in rows for x in r})
    n, span = len(rows), len(labels) - 1
    for quadratic in (False, True):
        w = {(x, y): ((labels.index(x) - labels.index(y)) / span) ** 2 if quadratic else float(x != y) for x in labels for y in labels}
        o = sum(w[r] for r in rows)
        e = sum(w[x, y] * sum(r[0] == x for r in rows) * sum(r[1] == y for r in rows) / n for x in labels for y in labels)
        assert abs(A.cohen_kappa(df, "a", "b", quadratic).first().kappa - (1 - o / e)) < 1e-5


def test_evaluation_rows(spark):
    four = {x: f"o{x}" for x in "ABCD"}
    df = spark.createDataFrame(
        [("q", "Adult", four, "(B)"), ("r", "adult", four, "C"), ("s", "General", {"a": "1"}, "a")],
        "question string, target_population string, options map<string,string>, correct_answer string",
    )
    assert [(r.question, r.evaluated_answer, r.evaluated_options["a"]) for r in io.validated(df, "ADULT").collect()] == [("q", "b", "oA")]
    with pytest.raises(Exception, match="no options"):
        io.validated(df).collect()
    with pytest.raises(ValueError, match="unknown population"):
        io.validated(df, "child")
    rows = spark.createDataFrame([("a", "a", "Adult"), ("b", "a", None), (None, "a", "Adult")], "p string, c string, g string")
    got = {r.population: (r.n, r.correct, r.unparsed) for r in metrics.accuracy(rows, "p", "c", "g").collect()}
    assert got == {"All": (3, 1, 1), "Adult": (2, 1, 1), "Pediatric": (0, 0, 0), "General": (0, 0, 0)}
    with pytest.raises(Exception, match="unknown population"):
        metrics.accuracy(rows.withColumn("g", F.lit("adult")), "p", "c", "g").collect()


def test_upsert_keeps_the_last_in_order(spark):
    new = spark.createDataFrame([("x", 1, 3), ("x", 2, 9), ("x", 3, 5), (None, 4, 1)], "k string, v int, o int")
    old = spark.createDataFrame([("x", 0, 99), ("a", 0, 1)], "k string, v int, o int")
    assert [(r.k, r.v) for r in metrics.upsert(old, new, ["k"], "o").collect()] == [(None, 4), ("a", 0), ("x", 2)]
    assert [(r.k, r.v) for r in metrics.upsert(old, new.coalesce(1), ["k"]).collect()] == [(None, 4), ("a", 0), ("x", 3)]


def test_extractions_by_position(spark):
    q = spark.createDataFrame([(0, "a"), (1, "b")], "position long, question string")
    x = spark.createDataFrame([(1, "b", "p1", "c1"), (0, "a", "p0", "c0")], "position long, question string, extracted_patient_profile string, extracted_question_core string")
    assert [r.extracted_question_core for r in metrics.with_extractions(q, x, "position").orderBy("position").collect()] == ["c0", "c1"]
    for bad, what in [(x.where("position = 0"), "lacks"), (x.withColumn("question", F.lit("z")), "differ")]:
        with pytest.raises(ValueError, match=what):
            metrics.with_extractions(q, bad, "position")


def test_keywords_and_corpus(spark):
    df = spark.createDataFrame([(0, "skipped", "x", "u"), (1, " b ", None, "u"), (2, "a", "b", "u"), (3, "", "c", "u")], "n int, one string, two string, `Unnamed: 0` string")
    assert io.read_keywords(df, "n", 1) == ["b", "a", "c"]
    with pytest.raises(ValueError, match="no keyword"):
        io.read_keywords(df, "n", 4)
    one = spark.createDataFrame([(0, " a "), (1, " "), (2, "b")], "r int, text string")
    two = spark.createDataFrame([(5, "c", "m")], "r int, content string, more string")
    got = io.load_corpus([("x", one), ("y", two)], "r").orderBy("corpus_index").collect()
    assert [(r.corpus_index, r.corpus_row, r.text) for r in got] == [(0, 0, "a"), (1, 2, "b"), (2, 5, "c")] and json.loads(got[2].metadata)["more"] == "m"


def test_files(spark, tmp_path):
    p = str(tmp_path)
    io.write_bytes(spark, f"{p}/b.PDF", b"x")
    io.write_bytes(spark, f"{p}/A.pdf", b"yy")
    assert [r.path.rsplit("/")[-1] for r in io.list_files(spark, p, "*.{pdf,PDF}").collect()] == ["A.pdf", "b.PDF"]
    assert io.file_hashes(spark, f"{p}/A.pdf").first().sha256 == hashlib.sha256(b"yy").hexdigest()
    with pytest.raises(FileExistsError):
        io.write_bytes(spark, f"{p}/A.pdf", b"")
    io.write_bytes(spark, f"{p}/x.json", io.manifest(b=1, a="é").encode())
    assert io.read_json(spark, f"{p}/x.json") == {"a": "é", "b": 1}
    pd.DataFrame({"q": ["a", None], "n": [1, 2]}).to_pickle(f"{p}/t.pkl")
    assert [tuple(r) for r in io.read_table(spark, f"{p}/t.pkl").collect()] == [("a", 1), (None, 2)]
    lines = io.read_json_lines(spark, f"{p}/x.json").collect()
    assert [(r.line, r.error is None) for r in lines] == [(1, False), (2, False), (3, False), (4, False)]
    made = []

    def build():
        made.append(1)
        return spark.range(3)

    for facts in ({"k": 1}, {"k": 1}, {"k": 2}):
        assert io.built_once(spark, f"{p}/cache", {**facts, "of": io.identity(spark, f"{p}/A.pdf")}, build).count() == 3
    assert len(made) == 2
    n = iter((1, 1, 0))
    assert io.retried(lambda: 1 / (1 - next(n)), 3) == 1.0
    req = spark.createDataFrame([(1, "a"), (2, "b")], "batch long, line string")
    assert io.write_request_batches(req, f"{p}/req", stage=1) == {"stage": 1, "batches": 2, "requests": 2}
    assert io.read_json(spark, f"{p}/req.manifest.json")["requests"] == 2


@pytest.mark.parametrize("size", [5, 384])
def test_chunks_of_a_tokenizer(spark, size):
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("byte_bpe_50k.json")
    tok, overlap = Tokenizer.from_file(file), size // 3
    texts = [None, "", "one", "ünï 漢字 text", " ".join(f"word{i}" for i in range(size))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.chunk_id): (r.token_start, r.token_end, r.token_count, r.document_token_count, r.text) for r in corpus.chunk_by_tokenizer(docs, file, size, overlap).collect()}
    want = {}
    for k, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        if ids and len(ids) <= size:
            want[k, 0] = (0, len(ids), len(ids), len(ids), t)
        elif ids:
            start = n = 0
            while True:
                end = min(start + size, len(ids))
                part = tok.decode(ids[start:end]).strip()
                if part:
                    want[k, n] = (start, end, end - start, len(ids), part)
                    n += 1
                if end == len(ids):
                    break
                start += size - overlap
    assert got == want


def test_older_results(spark):
    df = spark.createDataFrame([(1, ["a", "b"], "['c']", "d"), (2, [], "nan", None)], "id long, top_64 array<string>, middle_texts string, top_1 string")
    got = sorted((r.id, r.stage, r["rank"], r.observed_k, r.document_text) for r in trajectory.legacy(df, ["id"]).collect())
    assert got == [(1, "final", 1, 1, "d"), (1, "initial", 1, 2, "a"), (1, "initial", 2, 2, "b"), (1, "middle", 1, 1, "c")]
    with pytest.raises(ValueError, match="no column"):
        trajectory.legacy(df.select("id"), ["id"])
    look = trajectory.source_lookup(spark.createDataFrame([("t", "s1"), (" t ", "s2"), ("u", "s1")], "text string, source string"))
    rows = spark.createDataFrame([("x|y", None, "t"), ("", "z", "t"), (None, None, "t"), (None, None, "u"), (None, None, "v")], "source_membership string, source string, document_text string")
    got = {tuple(r.document_membership): r.document_source for r in trajectory.document_membership(rows, look).collect()}
    assert got == {("x", "y"): "both", ("z",): "z", ("s1", "s2"): "both", ("s1",): "s1", (): "unknown"}


def reply(key, text):
    return json.dumps({"key": key, "response": {"candidates": [{"content": {"parts": [{"text": text}]}}]}})


def test_construction_from_end_to_end(spark):
    pages = spark.createDataFrame([("k1", "g", 1, "long"), ("k2", "g", 2, "text"), ("k3", "h", 1, "more")], "k string, guideline string, page long, guidelinetext_processed string")
    rule = lambda c: {"condition_base": c, "action": "a", "triggers": [{"criterion": "x"}], "source_fragment": "s", "notes": None}
    question = {
        "question_type": "Diagnosis",
        "target_population": "Adult",
        "category": "Post-op & Pain",
        "patient_profile": "p",
        "scenario": "s",
        "question": "why",
        "options": {x: x for x in "abcd"},
        "correct_answer": "C",
        "explanation": "e",
        "difficulty": "Easy",
    }
    lines = {
        1: [reply("k1", S1), reply("k2", "```json\n" + S1.replace("true", "false") + "\n```"), reply("k3", S1)],
        2: [reply("k1", json.dumps({"rules": [rule("c1"), rule("c2")]})), reply("k3", "no"), reply("k3", json.dumps({"rules": [rule("d1")]}))],
        3: [reply("guideline_page_000001", json.dumps([question, question])), reply("guideline_page_000002", json.dumps({**question, "difficulty": "x"}))],
    }
    lines = {n: spark.createDataFrame(list(enumerate(v, 1)), "line long, value string") for n, v in lines.items()}
    got, errors = stages.construct(pages, "k", lines, "k")
    rows = got.collect()
    assert [(r.key, r.page, r.question_number, r.correct_answer, [x.condition for x in r.rules]) for r in rows] == [
        ("guideline_page_000001", 1, 0, "c", ["c1", "c2"]),
        ("guideline_page_000001", 1, 1, "c", ["c1", "c2"]),
    ]
    assert [e.count() for e in errors.values()] == [0, 0, 1] and errors[3].first().status == "invalid"
    assert {r.status: r.n for r in stages.totals(errors[3]).collect()} == {"invalid": 1}


def test_profile_of_fields_in_capitals(spark):
    df = spark.createDataFrame([('{"PATIENT_PROFILE": "a child", "QUESTION_CORE": " "}',)], "t string")
    assert tuple(df.select(*J.profile(F.col("t"), F.lit("q"))).first()) == ("a child", "q")


def test_results_and_outcomes(spark, tmp_path):
    p = str(tmp_path)
    made = []

    def build():
        made.append(1)
        return spark.range(3).withColumnRenamed("id", "a")

    for _ in range(2):
        assert io.result_or(spark, io.result_path(p, "a model/x", "q"), 3, ["a"], build).count() == 3
    assert len(made) == 1 and (tmp_path / "a_model_x__q.parquet").exists()
    with pytest.raises(ValueError, match="not 4"):
        io.result_or(spark, io.result_path(p, "a model/x", "q"), 4, ["a"], build)
    paths = io.stage_paths(p, "stage1")
    with pytest.raises(ValueError, match="2 errors"):
        io.write_outcome(spark.range(3), spark.range(2), paths["rows"])
    assert io.read_json(spark, paths["summary"]) == {"errors": 2, "rows": 3} and spark.read.parquet(paths["errors"]).count() == 2
    assert io.write_outcome(spark.range(1), spark.range(1), paths["rows"], overwrite=True, allow_errors=True) == {"rows": 1, "errors": 1}
    from loomspark.operators import public_sets

    assert [tuple(r) for r in public_sets.by_source(spark.createDataFrame([("b",), ("a",), ("b",)], "source string")).collect()] == [("a", 1), ("b", 2)]


def test_chunks_by_a_rank_file_are_the_tokenizers(spark):
    import random

    import public_tokenizers

    rng = random.Random(5)
    parts = ["word", " ", "  ", "\n\n", "\t", " ", "　", "it's", "'LL", "12345", "ünï", "漢字", "ไทย", "́", "😀", "\x00", "!!!", "<|endoftext|>", "<|end", "﻿", "²", "a" * 70]
    texts = [None, "", *("".join(rng.choices(parts, k=rng.randrange(1, 60))) for _ in range(400))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = lambda **how: sorted(tuple(r) for r in corpus.chunk_by_tokenizer(docs, public_tokenizers.path("byte_bpe_50k.json"), 20, 5, **how).collect())
    assert found(ranks=public_tokenizers.path("byte_bpe_50k.tiktoken")) == found()
