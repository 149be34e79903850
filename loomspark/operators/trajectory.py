"""Flattened retrieval results and their source composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions.binding import let
from loomspark.functions.jsonops import inner, kind, listed, members_of, membership, one_json, parsed_nested
from loomspark.functions.text import strip, text_hash
from loomspark.operators.lineage import small, written
from loomspark.sources.io import numbered, read_positioned, tables_in

STAGES = ("initial", "middle", "final")
#: Columns of results of an older layout, the first that is there.
LEGACY = {"initial": ("candidate_texts", "top_64"), "middle": ("middle_texts", "top_8"), "final": ("retrieved_texts", "top_1")}


def source_category(members: Column) -> Column:
    return F.when(F.coalesce(F.size(members), F.lit(0)) <= 0, "unknown").when(F.size(members) > 1, "both").otherwise(members[0])


def flatten(results: DataFrame, keys: list[str], trajectory: str = "trajectory") -> DataFrame:
    """A row for each document of each stage of nested results."""
    t = F.col(trajectory)
    stages = F.array(*[F.struct(F.lit(s).alias("stage"), t[s]["query_kind"].alias("query_kind"), t[s]["requested_k"].alias("requested_k"), t[s]["documents"].alias("documents")) for s in STAGES])
    rows = results.select(*keys, t["condition"].alias("condition"), F.explode(stages).alias("s")).select(
        *keys,
        "condition",
        "s.stage",
        "s.query_kind",
        "s.requested_k",
        F.size("s.documents").alias("observed_k"),
        F.explode("s.documents").alias("d"),
    )
    return rows.select(*keys, "condition", "stage", "query_kind", "requested_k", "observed_k", "d.*")


def with_documents(rows: DataFrame, docs: DataFrame, index: str = "corpus_index", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Flattened rows with the text and the other columns of the documents that they name."""
    return rows.join(docs.withColumnRenamed(id_col, index).withColumnRenamed(text, "document_text"), index, "left")


def legacy(results: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each text of each stage of results of an older layout, whose columns are arrays or text that holds a list;
    one plain text is a list of one. Columns that are not there have no rows."""
    names = [n for of in LEGACY.values() for n in of]
    if not set(names) & set(results.columns):
        raise ValueError(f"no column among {sorted(names)}")
    rows = results.select(*keys, F.to_variant_object(F.struct(*[c for c in results.columns if c in names])).alias("_row"))
    staged = rows.select(*keys, _staged(F.lit(None).cast("variant"), F.col("_row")))
    return _documents(staged).select(*keys, "stage", "observed_k", "rank", F.col("text").alias("document_text"))


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """(result_file, result_name, result_row, row) of all tables at a path: a table, or a folder of tables whose columns and
    types may differ; row is a variant of what a table has. Folders of part files are one table."""
    out = None
    for table in tables_in(spark, path):
        name, _, kind_ = table.rstrip("/").rsplit("/", 1)[-1].rpartition(".")
        if kind_.lower() in ("json", "jsonl"):  # a line is a row as it is, so no schema has to fit all
            df = numbered(spark.read.text(table), "_place", across=True).where(strip(F.col("value")) != "")
            row = one_json(F.col("value"))
        else:
            df = read_positioned(spark, table, "_place")
            row = F.to_variant_object(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "_place"]))
        part = df.select(F.lit(table).alias("result_file"), F.lit(name).alias("result_name"), F.col("_place").cast("long").alias("result_row"), row.alias("row"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"no table at {path}")
    return out


def _present(row: Column, names) -> Column:
    """The first of these fields that a row has, null or not."""
    return F.coalesce(*[inner(row, n) for n in names])


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _staged(trajectory: Column, row: Column) -> Column:
    """Exploded (s): the three stages, each with its part of the trajectory and what an older layout has for it."""
    parts = [F.struct(F.lit(s).alias("stage"), inner(trajectory, s).alias("payload"), _present(row, LEGACY[s]).alias("older")) for s in STAGES]
    return F.explode(F.array(*parts)).alias("s")


def _documents(staged: DataFrame) -> DataFrame:
    """A row for each document of exploded stages, by the newer layout where a row's stage has it, else by the older one."""
    keys = [c for c in staged.columns if c != "s"]
    payload = F.col("s.payload")
    own = inner(payload, "documents")
    # no list is an empty list; what is something else is none
    empty = own.isNull() | kind(own).isin("VOID") | _text(own).isin("", "0", "false", "{}", "[]")
    documents = F.when(kind(payload) == "OBJECT", F.when(empty, F.array().cast("array<variant>")).when(kind(own) == "ARRAY", F.try_variant_get(own, "$", "array<variant>")))
    older = let(parsed_nested(F.col("s.older")), listed)
    rows = staged.select(*keys, "s", documents.alias("documents"))
    new = F.col("documents").isNotNull()
    rows = rows.select(*keys, "s", new.alias("new"), F.when(new, F.col("documents")).otherwise(older).alias("documents"))
    info = lambda name, type_: F.when(F.col("new"), F.try_variant_get("s.payload", f"$.{name}", type_)).alias(name)
    asked = F.when(F.col("new"), F.try_variant_get("s.payload", "$.requested_k", "long")).otherwise(F.size("documents"))
    rows = rows.select(
        *keys,
        "s.stage",
        info("query_kind", "string"),
        info("query", "string"),
        info("reranked", "boolean"),
        asked.cast("long").alias("requested_k"),
        F.size("documents").cast("long").alias("observed_k"),
        "new",
        F.posexplode_outer("documents").alias("_n", "d"),  # an inner one would parse them twice
    ).where("_n is not null")
    d = F.col("d")
    is_object = F.col("new") & (kind(d) == "OBJECT")
    field = lambda name, type_: F.when(is_object, F.try_variant_get("d", f"$.{name}", type_))
    return rows.select(
        *[c for c in rows.columns if c not in ("_n", "d", "new")],
        F.coalesce(field("rank", "long"), (F.col("_n") + 1).cast("long")).alias("rank"),
        field("corpus_index", "long").alias("corpus_index"),
        field("score", "double").alias("score"),
        F.when(is_object, F.coalesce(field("text", "string"), F.lit(""))).otherwise(F.coalesce(_text(d), F.lit(""))).alias("text"),
        F.when(is_object, parsed_nested(inner(d, "metadata"))).alias("metadata"),
    )


def flatten_results(rows: DataFrame, lookup: DataFrame | None = None, trajectory: str = "retrieval_trajectory", population: str = "target_population") -> DataFrame:
    """A row for each document of each stage of loaded results, by either layout, with the membership of its metadata, else
    its source, else that of its text in lookup (text_hash, source_membership).

    A row without an id is named by its question_id, else by its place; one without a population is unknown.
    """
    row = F.col("row")
    text = lambda name: F.when(~kind(inner(row, name)).isin("VOID"), F.try_variant_get("row", f"$.{name}", "string"))
    base = rows.select(
        "result_file",
        "result_name",
        "result_row",
        F.col("result_row").cast("string").alias("source_row_index"),
        F.coalesce(text("id"), text("question_id"), F.col("result_row").cast("string")).alias("question_id"),
        F.coalesce(text(population), F.lit("unknown")).alias("target_population"),
        F.struct(parsed_nested(inner(row, trajectory)).alias("t")).alias("t"),
        "row",
    )
    keys = [c for c in base.columns if c not in ("t", "row")]
    t = F.col("t.t")
    name = lambda n: F.when(kind(t) == "OBJECT", F.try_variant_get(t, f"$.{n}", "string")).alias(n)
    found = _documents(base.select(*keys, name("condition"), name("backend"), _staged(F.when(kind(t) == "OBJECT", t), row)))
    metadata = F.when(kind(F.col("metadata")) == "OBJECT", F.col("metadata"))
    found = found.withColumn("metadata", metadata)
    own = F.transform(F.array(*[inner(F.col("metadata"), n) for n in ("source_membership", "source")]), members_of)
    found = found.withColumn("_own", F.get(F.filter(own, lambda m: F.size(m) > 0), F.lit(0)))
    members = F.coalesce("_own", F.array().cast("array<string>"))
    if lookup is not None:
        # rows with their own sources look nothing up: each has a key of its own, since equal ones (nulls too) are one task's
        alone = F.concat_ws(" ", F.lit("own"), F.xxhash64("result_file", "result_row", "stage", "rank").cast("string"))
        found = found.withColumn("_h", F.when(F.col("_own").isNull(), text_hash(F.col("text"))).otherwise(alone))
        # written, so that its side of the join is a shuffle as it is, and Spark may divide what a frequent text gives one task
        known = written(lookup.select(F.col("text_hash").alias("_h"), F.col("source_membership").alias("_found")))
        found = found.join(small(known), "_h", "left")
        members = F.coalesce("_own", "_found", F.array().cast("array<string>"))
    found = found.withColumn("_m", members)
    return found.select(
        *keys,
        "condition",
        "backend",
        "stage",
        "query_kind",
        "query",
        "reranked",
        "requested_k",
        "observed_k",
        "rank",
        "corpus_index",
        "score",
        source_category(F.col("_m")).alias("document_source"),
        F.array_join("_m", "|").alias("source_membership"),
        "text",
        F.coalesce(F.to_json("metadata"), F.lit("{}")).alias("metadata"),
    )


def document_membership(rows: DataFrame, lookup: DataFrame, members: str = "source_membership", source: str = "source", text: str = "document_text") -> DataFrame:
    """rows with the membership of each document: its own list, else its own source, else that of its text; else none."""
    found = rows.withColumn("_h", text_hash(F.coalesce(F.col(text), F.lit("")))).join(lookup.select(F.col("text_hash").alias("_h"), F.col("source_membership").alias("_m")), "_h", "left")
    own = [membership(F.col(c)) if dict(rows.dtypes).get(c) == "string" else F.col(c) for c in (members, source) if c in rows.columns]
    some = [F.when(F.size(c) > 0, c) for c in own]
    got = F.coalesce(*some, F.col("_m"), F.array().cast("array<string>"))
    return found.withColumn("document_membership", got).withColumn("document_source", source_category(got)).drop("_h", "_m")


def source_lookup(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """(text_hash, source_membership): sorted sources of each stripped text."""
    pairs = docs.select(text_hash(F.col(text)).alias("text_hash"), F.col(source).alias("source")).distinct()
    return pairs.groupBy("text_hash").agg(F.sort_array(F.collect_set("source")).alias("source_membership"))


def question_source_counts(rows: DataFrame, keys: list[str], source: str = "document_source") -> DataFrame:
    """Documents of each source and their percentage of the documents seen, per question and stage."""
    n = rows.groupBy(*keys, source).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy(*keys))
    return n.withColumn("percentage", F.bround(100 * F.col("count") / total, 2))


def population_summary(rows: DataFrame, keys: list[str], question: str, source: str = "document_source") -> DataFrame:
    """Documents and distinct questions of each source per group, with shares of the group's documents."""
    n = rows.groupBy(*keys, source).agg(F.count("*").alias("n_documents"), F.count_distinct(question).alias("n_questions"))
    total = F.sum("n_documents").over(Window.partitionBy(*keys))
    return n.withColumn("percentage", F.bround(100 * F.col("n_documents") / total, 2))


def source_warnings(rows: DataFrame, source: str = "document_source") -> list[str]:
    """What the sources of retrieved documents make doubtful: some unknown, or none of several."""
    n, unknown, both = rows.agg(F.count("*"), F.count_if(F.col(source) == "unknown"), F.count_if(F.col(source) == "both")).first()
    out = [f"{unknown} of {n} retrieved documents have no source"] if unknown else []
    return out + (["no document is of several sources; was membership kept when the corpus was built?"] if n and not both else [])
