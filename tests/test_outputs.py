"""Outputs as one, content hashes, and the results of batches against what was prepared."""

import json

import pytest
from pyspark.sql import functions as F

from loomspark.functions import jsonops as J
from loomspark.operators import stages
from loomspark.sources import io, versions


def test_a_failed_job_leaves_the_old_set(spark, tmp_path):
    a, b, c = (str(tmp_path / x) for x in ("a", "b.csv", "c.json"))
    io.write_all(spark, {a: spark.range(3), b: spark.range(2), c: b"{}"})
    with pytest.raises(FileExistsError, match="c.json"):
        io.write_all(spark, {str(tmp_path / "new"): spark.range(3), c: b"x"})
    assert not io.exists(spark, str(tmp_path / "new"))
    bad = spark.range(2).select(F.raise_error(F.lit("broken")).cast("string").alias("x"))
    with pytest.raises(Exception, match="broken"):
        io.write_all(spark, {a: spark.range(9), b: bad, c: b"new"}, overwrite=True)
    assert spark.read.parquet(a).count() == 3 and (tmp_path / "c.json").read_text() == "{}"
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["a", "b.csv", "c.json"]
    io.write_all(spark, {a: spark.range(9), c: lambda beside: str(spark.read.parquet(beside[a]).count()).encode()}, overwrite=True)
    assert spark.read.parquet(a).count() == 9 and (tmp_path / "c.json").read_text() == "9"
    # its own input may be overwritten, as the new one is whole before the old one goes
    io.write_table(spark.read.parquet(a).where("id > 4"), a, overwrite=True)
    assert spark.read.parquet(a).count() == 4


def test_what_takes_its_place_too_late_goes_back(spark, tmp_path, monkeypatch):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    io.write_all(spark, {a: spark.range(1), b: spark.range(2)})
    real = io._rename

    def failing(s, old, new):
        if new == b and ".staged-" in old:
            raise OSError("no")
        real(s, old, new)

    monkeypatch.setattr(io, "_rename", failing)
    with pytest.raises(OSError, match="no"):
        io.write_all(spark, {a: spark.range(7), b: spark.range(8)}, overwrite=True)
    assert (spark.read.parquet(a).count(), spark.read.parquet(b).count()) == (1, 2)
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["a", "b"]


def test_content_hash(spark):
    rows = [(i, f"t{i}" if i % 5 else None, {"k": i, "j": 1}, [float(i), None], None if i % 3 else "x") for i in range(200)]
    schema = "id long, t string, m map<string,int>, a array<double>, n string"
    df = spark.createDataFrame(rows, schema)
    same = io.content_hash(df)
    assert io.content_hash(df.repartition(7, "n").select("n", "m", "t", "a", "id")) == same
    assert io.content_hash(spark.createDataFrame([(a, b, dict(reversed(c.items())), d, e) for a, b, c, d, e in rows[::-1]], schema)) == same
    others = [
        df.where("id <> 7"),
        df.unionAll(df.where("id = 7")),
        df.withColumn("t", F.when(F.col("id") == 7, "t8").otherwise(F.col("t"))),
        df.withColumn("t", F.coalesce("t", F.lit(""))),
        df.withColumn("id", F.col("id").cast("int")),
        df.withColumnRenamed("n", "o"),
        df.select("id", "m", "a", F.col("n").alias("t"), F.col("t").alias("n")),
        df.limit(0),
    ]
    assert len({same, *map(io.content_hash, others)}) == 1 + len(others)


def test_versions(spark, tmp_path):
    p = str(tmp_path)
    assert versions.current(spark, p) is None
    for i in range(4):
        spark.range(i).write.parquet(f"{p}/v{i}")
        versions.commit(spark, p, f"v{i}", n=i)
    note = versions.current(spark, p)
    assert (note["version"], note["n"], note["number"]) == ("v3", 3, 4) and spark.read.parquet(versions.path_of(p, note)).count() == 3
    assert not (tmp_path / "v1").exists() and (tmp_path / "v2").exists()


def line(key, text, **more):
    return json.dumps({"key": key, "response": {"candidates": [{"content": {"parts": [{"text": text}]}}]}, **more})


GOOD = '{"is_relevant": true, "target_population": "Adult", "category": "Post-op & Pain", "reason": "r"}'


@pytest.fixture
def prepared(spark, tmp_path):
    """Requests of seven pages in two batches, and their result files."""
    pages = spark.createDataFrame([(i, f"page {i}") for i in range(7)], "position long, text string")
    index = pages.select(F.concat(F.lit("k"), "position").alias("key"), F.col("position").alias("row_position"))
    requests = index.select(F.floor(F.col("row_position") / 4 + 1).cast("long").alias("batch"), F.col("key").alias("line"))
    place = io.stage_paths(str(tmp_path), "stage1")["requests"]
    made = io.write_request_batches(requests, place, source=pages, index=index, stage="stage1")
    assert made["batches"] == 2 and len(made["input_hash"]) == 64
    one = [line("k0", GOOD), "", line("k1", "no JSON"), line("k1", GOOD), line("k0", GOOD), json.dumps({"response": 1}), json.dumps({"key": 3})]
    two = [line("k2", GOOD.replace("true", '"true"')), json.dumps({"key": "k3", "error": {"message": "quota"}}), line("k9", GOOD), line("k4", f"```json\n{GOOD}\n```"), line("k0", "again")]
    for i, x in enumerate((one, two), 1):
        (tmp_path / f"stage1_results_batch_{i:03d}.jsonl").write_text("\n".join(x))
    return pages, tmp_path


def test_merge_of_a_stage(spark, prepared):
    pages, folder = prepared
    ok, errors = stages.merge_stage(spark, str(folder), "stage1", pages, "position", J.stage1_error(F.col("response")))
    assert sorted(r.position for r in ok.collect()) == [0, 1, 4]
    got = sorted((r.key or "", r.file.rsplit("_")[-1] if r.file else "", r.line or 0, r.error) for r in errors.collect())
    assert got == [
        ("", "001.jsonl", 6, "no key"),
        ("", "001.jsonl", 7, "no key"),
        ("k0", "001.jsonl", 5, "the key is there already"),
        ("k0", "002.jsonl", 5, "the key is there already"),
        ("k1", "001.jsonl", 3, "no JSON in the response"),
        ("k2", "", 0, "is_relevant is no boolean"),
        ("k3", "002.jsonl", 2, "the service says: quota"),
        ("k5", "", 0, "no result"),
        ("k6", "", 0, "no result"),
        ("k9", "", 0, "unexpected key"),
    ]


def test_merge_is_of_what_was_prepared(spark, prepared):
    pages, folder = prepared
    merge = lambda df, stage="stage1": stages.merge_stage(spark, str(folder), stage, df, "position", F.lit(None).cast("string"))
    with pytest.raises(ValueError, match="has changed"):
        merge(pages.withColumn("text", F.when(F.col("position") == 3, "other").otherwise(F.col("text"))))
    with pytest.raises(Exception, match="manifest"):
        merge(pages, "stage2")
    (folder / "stage1_results_batch_003.jsonl").write_text("")
    with pytest.raises(ValueError, match="unexpected: .*003"):
        merge(pages)
    (folder / "stage1_results_batch_003.jsonl").unlink()
    (folder / "stage1_results_batch_002.jsonl").write_text("{broken")
    with pytest.raises(ValueError, match="line 1"):
        merge(pages)
    (folder / "stage1_results_batch_002.jsonl").unlink()
    with pytest.raises(ValueError, match="missing: .*002"):
        merge(pages)
