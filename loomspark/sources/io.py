"""Tables in and out."""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions.jsonops import POPULATIONS, kind, normalized_options, one_json
from loomspark.functions.text import strip
from loomspark.operators.corpus import RETRIEVAL_TEXT, require_columns, text_column, with_position
from loomspark.operators.lineage import small, written
from loomspark.operators.metrics import correct_answer


#: Bytes up to which a file that only the driver can read is read there.
DRIVER_BYTES = 256 << 20


#: Suffixes of tables (fixed values).
TABLES = ("parquet", "csv", "jsonl", "json", "pkl", "pickle", "xlsx", "xls")


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """By suffix: parquet, csv (quotes doubled, many lines), json lines; pickles and sheets of checked size through the
    driver; anything else is an error."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "parquet":
        return reader.parquet(path)
    if kind == "csv":
        return reader.csv(path, header=True, multiLine=True, escape='"')
    if kind in ("jsonl", "json"):
        return reader.json(path)
    if kind in ("pkl", "pickle", "xlsx", "xls"):
        return _driver_table(spark, path, kind)
    raise ValueError(f"unsupported table: {path}")


def _driver_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Pickles run code when they are read: only files of one's own."""
    import io

    import pandas as pd

    row = spark.read.format("binaryFile").load(path).select("length").first()
    if row.length > DRIVER_BYTES:
        raise ValueError(f"{path} is larger than {DRIVER_BYTES} bytes; store it as parquet")
    data = io.BytesIO(bytes(spark.read.format("binaryFile").load(path).select("content").first().content))
    frame = pd.read_pickle(data) if kind.startswith("p") else pd.read_excel(data)
    frame.columns = [str(c) for c in frame.columns]
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None)).coalesce(1)


def read_positioned(spark: SparkSession, path: str, name: str) -> DataFrame:
    """read_table with the place of each row in the table, from 0."""
    if path.rstrip("/").rsplit(".", 1)[-1].lower() in TABLES[4:]:
        return read_table(spark, path).withColumn(name, F.monotonically_increasing_id())  # of one partition
    return numbered(read_table(spark, path), name, across=True)


def tables_in(spark: SparkSession, path: str) -> list[str]:
    """The tables (files or folders, by suffix) that lie in a folder, by name; a path that is a table is one itself."""
    if path.rstrip("/").rsplit(".", 1)[-1].lower() in TABLES:
        return [path]
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(str(x.getPath().toString()) for x in fs.listStatus(folder))
    return [x for x in found if x.rsplit(".", 1)[-1].lower() in TABLES]


def read_keywords(df: DataFrame, order: str, skip: int = 0) -> list[str]:
    """Distinct trimmed keywords of a sheet: column by column, row by row from `skip` on by `order`; columns without a name
    are left out; none is an error."""
    usable = [c for c in df.columns if c != order and not c.strip().lower().startswith("unnamed:")]
    if not usable:
        raise ValueError("no usable column")
    rows = with_position(df, order, "_i").where(F.col("_i") >= skip)
    cells = rows.select("_i", F.posexplode(F.array(*[F.col(f"`{c}`").cast("string") for c in usable])).alias("_c", "v"))
    words = cells.select("_c", "_i", strip(F.col("v")).alias("v")).where("v <> ''").groupBy("v").agg(F.min(F.struct("_c", "_i")).alias("at"))
    got = [r.v for r in words.orderBy("at").collect()]  # the keywords of a search, which the driver plans
    if not got:
        raise ValueError("no keyword")
    return got


def read_json(spark: SparkSession, path: str) -> dict:
    """One JSON object of a file; anything else is an error."""
    value = json.loads(spark.read.text(path, wholetext=True).first().value)
    if not isinstance(value, dict):
        raise ValueError(f"{path} is no JSON object")
    return value


def list_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, length, modified) of a folder's files, by name without regard to case."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    return files.select("path", "length", F.col("modificationTime").alias("modified")).orderBy(name, "path")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def parse_source_spec(spec: str) -> tuple[str, str]:
    name, _, path = spec.partition("=")
    if not name or not path:
        raise ValueError(f"expected SOURCE=PATH: {spec}")
    return name, path


def parse_rag_spec(spec: str) -> tuple[str, list[str], str | None]:
    """name::path|||path::cache."""
    name, *rest = spec.split("::")
    if not rest or not name.replace("-", "").replace("_", "").isalnum():
        raise ValueError(f"bad specification: {spec}")
    return name, rest[0].split("|||"), rest[1] if len(rest) > 1 else None


def load_corpus(frames: list[tuple[str, DataFrame]], row: str) -> DataFrame:
    """Sources as one table of text and metadata with a running corpus_index from 0; rows keep their place in their
    source, which column `row` gives; blanks are dropped before they are counted."""
    out = None
    for n, (name, df) in enumerate(frames):
        c = text_column(df, RETRIEVAL_TEXT)
        meta = F.to_json(F.struct(*[x for x in df.columns if x != c], F.lit(name).alias("corpus_path"), F.lit(c).alias("text_column")))
        part = df.select(F.struct(F.lit(n).alias("source_no"), F.col(row).cast("long").alias("corpus_row")).alias("at"), strip(F.col(c)).alias("text"), meta.alias("metadata")).where("text <> ''")
        out = part if out is None else out.unionByName(part)
    return with_position(out, "at", "corpus_index").select("corpus_index", "at.*", "text", "metadata")


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """One id a line; what follows # and blank lines are dropped."""
    ids = spark.read.text(path).select(strip(F.substring_index("value", "#", 1)).alias("id")).where("id <> ''").distinct()
    if ids.isEmpty():
        raise ValueError("the list is empty")
    return ids


def numbered(df: DataFrame, name: str, first: int = 0, file: str | None = None, across: bool = False) -> DataFrame:
    """Rows that a file source reads, with each one's place in its file from `first` on (and the file's path); or its place
    across all files, by path.

    A file's splits are read one by one in order: a place is that in the split and the rows of the splits before it, of
    which there is a row each. Nothing may stand between the source and this but projections.
    """
    columns = df.columns
    rows = df.select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    splits = rows.groupBy("_file", "_start").agg(F.min("_id").alias("_least"), F.count("*").alias("_n"))
    order = Window.orderBy("_file", "_start") if across else Window.partitionBy("_file").orderBy("_start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    splits = written(splits.select("_file", "_start", "_least", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    out = rows.join(small(splits), ["_file", "_start"]).withColumn(name, F.col("_before") + F.col("_id") - F.col("_least") + first)
    return out.select(*columns, *([F.col("_file").alias(file)] if file else []), name)


def read_json_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, value, error) with line numbers from 1; blank lines are left out but counted; what is no object has an
    error. A file may have many splits."""
    lines = numbered(spark.read.text(path), "line", 1, "file").where(strip(F.col("value")) != "")
    ok = kind(one_json(F.col("value"))) == "OBJECT"
    return lines.select("file", "line", "value", F.when(~F.coalesce(ok, F.lit(False)), "not a JSON object").alias("error"))


def validated(df: DataFrame, population: str = "all") -> DataFrame:
    """Evaluation rows of one population (its name in any case; rows exactly), each with options a-d and an answer key;
    rows without them are an error when they are read."""
    require_columns(df, ["question"])
    if population.lower() != "all":
        names = {p.lower(): p for p in POPULATIONS}
        if population.lower() not in names:
            raise ValueError(f"unknown population {population}")
        require_columns(df, ["target_population"])
        df = df.where(F.col("target_population") == names[population.lower()])
    some = [F.col(c) for c in ("new_options", "options") if c in df.columns]
    keys = [F.when(F.col("new_options").isNotNull(), F.col("new_correct_answer"))] if {"new_options", "new_correct_answer"} <= set(df.columns) else []
    keys += [F.col(c) for c in ("correct_answer", "final_answer") if c in df.columns]
    if not some or not keys:
        raise ValueError("no options or no answer key")
    options = F.coalesce(*map(normalized_options, some))
    options = F.when(options.isNotNull(), options).otherwise(F.raise_error(F.lit("a row has no options a-d")).cast("map<string,string>"))
    answer = correct_answer(*keys)
    answer = F.when(answer.isNotNull(), answer).otherwise(F.raise_error(F.lit("a row has no answer a-d")).cast("string"))
    return df.withColumns({"evaluated_options": options, "evaluated_answer": answer})


def _filesystem(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _filesystem(spark, path)
    return fs.exists(place)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    fs, place = _filesystem(spark, old)
    if not fs.rename(place, _filesystem(spark, new)[1]):
        raise OSError(f"{old} can't become {new}")


def _delete(spark: SparkSession, path: str) -> None:
    fs, place = _filesystem(spark, path)
    fs.delete(place, True)


def _save(df: DataFrame, path: str, kind: str) -> None:
    if kind == "csv":
        nested = [c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))]
        df.withColumns({c: F.to_json(c) for c in nested}).write.mode("errorifexists").option("escape", '"').csv(path, header=True)
    elif kind in ("json", "jsonl"):
        df.withColumns({c: F.nanvl(c, F.lit(None)) for c, t in df.dtypes if t in ("double", "float")}).write.mode("errorifexists").json(path)
    else:
        df.write.mode("errorifexists").parquet(path)


def write_all(spark: SparkSession, outputs: dict, overwrite: bool = False) -> None:
    """Several outputs as one: path to a table, to bytes, or to a function that gives either once the tables before it are
    staged (and is told where). Tables are of their suffix's kind, else parquet.

    That one exists is an error before any work, unless overwrite. All are written beside their places first; only when the
    last is there do they take them, and if one can't, those that were there come back.
    """
    paths = {p.rstrip("/"): made for p, made in outputs.items()}
    there = [p for p in paths if exists(spark, p)]
    if there and not overwrite:
        raise FileExistsError(f"{', '.join(there)} already exists")
    mark = uuid.uuid4().hex
    beside = {p: f"{p}.staged-{mark}" for p in paths}
    moved, placed = [], []
    try:
        for p, made in paths.items():
            made = made(beside) if callable(made) else made
            if isinstance(made, bytes):
                write_bytes(spark, beside[p], made)
            else:
                _save(made, beside[p], p.rsplit(".", 1)[-1].lower())
        try:
            for p in there:
                _rename(spark, p, f"{p}.before-{mark}")
                moved.append(p)
            for p in paths:
                _rename(spark, beside[p], p)
                placed.append(p)
        except Exception:
            for p in placed:
                _delete(spark, p)
            for p in moved:
                _rename(spark, f"{p}.before-{mark}", p)
            raise
    except Exception:
        for p in beside.values():
            _delete(spark, p)
        raise
    for p in moved:
        _delete(spark, f"{p}.before-{mark}")


def write_table(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """By suffix; nested columns become JSON text in csv; an existing path is an error unless overwrite, and stays as it is
    until the new one is whole."""
    write_all(df.sparkSession, {path: df}, overwrite)


def content_hash(df: DataFrame) -> str:
    """The SHA-256 of a table's content: its columns and their types, and sums of the hashes of its rows. It is the same for
    any order and partitions, and another where a cell differs or a row is missing or there twice."""
    columns = sorted(df.columns)
    canonical = lambda c, t: F.array_sort(F.map_entries(c)) if t.startswith("map<") else c
    types = dict(df.dtypes)
    row = F.sha2(F.to_json(F.struct(*[canonical(F.col(f"`{c}`"), types[c]).alias(f"c{i}") for i, c in enumerate(columns)]), {"ignoreNullFields": "false"}), 256)
    pieces = [F.sum(F.conv(F.substring("_row", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)").cast("decimal(38,0)")) for i in range(4)]
    got = df.select(row.alias("_row")).agg(F.count("*"), *pieces).first()
    said = json.dumps([[(c, types[c]) for c in columns], [str(x) for x in got]])
    return hashlib.sha256(said.encode()).hexdigest()


def write_request_batches(df: DataFrame, path: str, line: str = "line", overwrite: bool = False, source: DataFrame | None = None, index: DataFrame | None = None, **facts) -> dict:
    """A folder for each batch of request lines, beside it a manifest of batches, rows, further facts and the content hash of
    the source that they were made of, which is returned; and the index (key, row_position) of the requests."""
    spark, path = df.sparkSession, path.rstrip("/")
    n = df.agg(F.max("batch"), F.count("*")).first()
    made = {**facts, "batches": int(n[0] or 0), "requests": int(n[1])}
    if source is not None:
        made["input_hash"] = content_hash(source)
    outputs = {f"{path}.manifest.json": manifest(**made).encode()}
    if index is not None:
        outputs[f"{path}.index.parquet"] = index
    there = [p for p in (path, *outputs) if exists(spark, p)]
    if there and not overwrite:
        raise FileExistsError(f"{', '.join(there)} already exists")
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    df.select("batch", F.col(line).alias("value")).write.partitionBy("batch").text(staged)
    write_all(spark, outputs, overwrite)
    if exists(spark, path):
        _delete(spark, path)
    _rename(spark, staged, path)
    return made


def verified_input(spark: SparkSession, path: str, source: DataFrame, stage: str) -> tuple[dict, DataFrame]:
    """(manifest, index) of requests at a path, if they were made for this stage of a source of this content."""
    path = path.rstrip("/")
    made = read_json(spark, f"{path}.manifest.json")
    if made.get("stage") != stage:
        raise ValueError(f"the requests are of stage {made.get('stage')!r}, not {stage!r}")
    if made.get("input_hash") != content_hash(source):
        raise ValueError(f"the input of {stage} has changed since its requests were made; make them again")
    index = spark.read.parquet(f"{path}.index.parquet")
    require_columns(index, ["key", "row_position"])
    if not index.groupBy("key").count().where("count > 1").isEmpty():
        raise ValueError(f"the index of {stage} has keys twice")
    return made, index


def expected_results(spark: SparkSession, folder: str, stage: str, batches: int) -> list[str]:
    """The result files of a stage's batches, all of which must be there, and no others."""
    want = [f"{stage}_results_batch_{i:03d}.jsonl" for i in range(1, batches + 1)]
    fs, place = _filesystem(spark, folder)
    names = {str(x.getPath().getName()): str(x.getPath().toString()) for x in fs.listStatus(place)}
    found = {n for n in names if re.fullmatch(rf"{re.escape(stage)}_results_batch_.*\.jsonl", n)}
    if found != set(want):
        raise ValueError(f"the result files of {stage} are not those of its batches; missing: {sorted(set(want) - found)}, unexpected: {sorted(found - set(want))}")
    return [names[n] for n in want]


def manifest(**facts) -> str:
    """Sorted JSON of a run's facts."""
    return json.dumps(facts, sort_keys=True, ensure_ascii=False, indent=2)


def write_bytes(spark: SparkSession, path: str, data: bytes, overwrite: bool = False) -> None:
    """A small file in one step, in any file system of Spark's: written beside, then renamed."""
    jvm = spark.sparkContext._jvm
    target, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target) and not overwrite:
        raise FileExistsError(path)
    out = fs.create(beside, True)
    out.write(bytearray(data))
    out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(beside, target):
        raise OSError(f"{path} can't be written")


def built_once(spark: SparkSession, path: str, facts: dict, build) -> DataFrame:
    """The table at path, if it was built from the same facts (inputs, parameters); else built, written and noted anew.

    The note is written last, so a table that was broken off is built again.
    """
    note = manifest(**facts)
    try:
        same = spark.read.text(f"{path}.json", wholetext=True).first().value == note
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        same = False
    if not same:
        build().write.mode("overwrite").parquet(path)
        write_bytes(spark, f"{path}.json", note.encode(), overwrite=True)
    return spark.read.parquet(path)


def identity(spark: SparkSession, path: str) -> list:
    """What tells a file or folder from a later one: paths, lengths and times of its files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return [[r.path, r.length, str(r.modificationTime)] for r in files.select("path", "length", "modificationTime").orderBy("path").collect()]


def retried(call, attempts: int = 3, wait: float = 0.0, errors: tuple = (Exception,)):
    """call(), tried again after errors with a wait that doubles; the last error stands."""
    import time

    for n in range(attempts):
        try:
            return call()
        except errors:
            if n + 1 == attempts:
                raise
            time.sleep(wait * 2**n)
    raise ValueError("attempts must be positive")


def result_or(spark: SparkSession, path: str, rows: int, columns, build, overwrite: bool = False) -> DataFrame:
    """The result at path, if it is there with these columns and as many rows; a different one is an error unless
    overwrite; where there is none it is built and written."""
    try:
        found = None if overwrite else spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = None
    if found is None:
        build().write.mode("overwrite").parquet(path)
        found = spark.read.parquet(path)
    require_columns(found, columns)
    if (n := found.count()) != rows:
        raise ValueError(f"{path} has {n} rows, not {rows}")
    return found


def write_outcome(df: DataFrame, errors: DataFrame, path: str, overwrite: bool = False, allow_errors: bool = False) -> dict:
    """Rows and errors of a stage beside each other, with their counts, as one; then an error, if there are errors and none
    are allowed, so that both can be looked at."""
    spark, path = df.sparkSession, path.rstrip("/")
    made = {}

    def summary(beside):
        made.update(rows=spark.read.parquet(beside[path]).count(), errors=spark.read.parquet(beside[f"{path}.errors"]).count())
        return manifest(**made).encode()

    write_all(spark, {path: df, f"{path}.errors": errors, f"{path}.summary.json": summary}, overwrite)
    if made["errors"] and not allow_errors:
        raise ValueError(f"{made['errors']} errors: {path}.errors")
    return made


def stage_paths(folder: str, stage: str) -> dict[str, str]:
    """Where a stage's requests, manifest, results, rows and errors lie."""
    base = f"{folder.rstrip('/')}/{stage}"
    return {"requests": f"{base}_requests", "manifest": f"{base}_requests.manifest.json", "results": f"{base}_results", "rows": base, "errors": f"{base}.errors", "summary": f"{base}.summary.json"}


def result_path(folder: str, *parts: str) -> str:
    """A result's place: its parts as safe file names, joined."""
    return f"{folder.rstrip('/')}/" + "__".join(re.sub(r"[^A-Za-z0-9_.-]+", "_", p).strip("._") or "_" for p in parts) + ".parquet"
