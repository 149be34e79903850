"""Public question sets of different layouts as one: (id, source, question, options, correct_option, correct_answer,
explanation, subject_name, medical_task); what a set doesn't have is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.operators.agreement import LABEL_TYPES
from loomspark.operators.corpus import require_columns

LETTERS = ("a", "b", "c", "d", "e")


def _options(cols: dict[str, str]) -> Column:
    pairs = [x for k, c in cols.items() for x in (F.lit(k), F.col(c))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def _set(df: DataFrame, source: str, id_col: str, options: Column, option: Column, answer: Column, more: tuple[str, ...]) -> DataFrame:
    """A set in the common layout, with those of the last three columns that are of it and that it has."""
    there = lambda c: (F.col(c).cast("string") if c in more and c in df.columns else F.lit(None).cast("string")).alias(c)
    return df.select(
        F.col(id_col).cast("string").alias("id"),
        F.lit(source).alias("source"),
        "question",
        options.alias("options"),
        option.alias("correct_option"),
        answer.alias("correct_answer"),
        *map(there, ("explanation", "subject_name", "medical_task")),
    )


def lettered(df: DataFrame, source: str, id_col: str = "id", prefix: str = "op", letters=LETTERS[:4]) -> DataFrame:
    """Options in columns opa, opb, ...; answers are blank; a subject, if there is one."""
    require_columns(df, [id_col, "question", *(f"{prefix}{x}" for x in letters)])
    return _set(df, source, id_col, _options({x: f"{prefix}{x}" for x in letters}), F.lit(""), F.lit(""), ("subject_name",))


def mapped(df: DataFrame, source: str, label: str = "label") -> DataFrame:
    """Options in a map; a label names the correct one; a task, if there is one."""
    require_columns(df, ["id", "question", "options", label])
    low = F.transform_keys("options", lambda k, _: F.lower(k))
    key = F.lower(F.col(label))
    return _set(df, source, "id", low, key, F.element_at(low, key), ("medical_task",))


def indexed(df: DataFrame, source: str, id_col: str = "link", prefix: str = "op") -> DataFrame:
    """Five option columns, the answer's text and its letter, and an explanation, if there is one."""
    require_columns(df, [id_col, "question", "answer", "answer_idx", *(f"{prefix}{x}" for x in LETTERS)])
    return _set(df, source, id_col, _options({x: f"{prefix}{x}" for x in LETTERS}), F.lower("answer_idx"), F.col("answer"), ("explanation",))


def given(df: DataFrame, source: str) -> DataFrame:
    """A set whose column data already holds the parts (fixed names, some may be missing), beside subject and task."""
    require_columns(df, ["id", "data"])
    names = {f.name for f in df.schema["data"].dataType.fields}
    part = lambda n, t="string": (F.col("data")[n] if n in names else F.lit(None)).cast(t)
    rows = df.withColumns({"question": part("Question"), "explanation": part("Explanation")})
    return _set(rows, source, "id", part("Options", "map<string,string>"), part("Correct Option"), part("Correct Answer"), ("explanation", "subject_name", "medical_task"))


def union(frames: list[DataFrame]) -> DataFrame:
    """All sets as one; ids must be unique."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    if not out.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("ids are not unique")
    return out


def benchmark_name(source: Column, names: dict[str, str]) -> Column:
    """The benchmark of a source; one that is not mapped is an error when it is read."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, source), F.raise_error(F.concat(F.lit("unmapped source: "), source)).cast("string"))


def classification_error(v: Column) -> Column:
    """A model's label: known question type and population, a real boolean, a reason."""
    text = lambda p: F.try_variant_get(v, f"$.{p}", "string")
    kind = F.schema_of_variant(F.try_variant_get(v, "$.is_anesthesia", "variant"))
    return (
        F.when(v.isNull(), "no JSON object")
        .when(~F.coalesce(text("question_type").isin(*LABEL_TYPES), F.lit(False)), "unknown question_type")
        .when(~F.coalesce(text("target_population").isin("Adult", "Pediatric", "General"), F.lit(False)), "unknown target_population")
        .when(~F.coalesce(kind == "BOOLEAN", F.lit(False)), "is_anesthesia is no boolean")
        .when(F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.reason", "variant")) != "STRING", F.lit(True)), "reason is no text")
    )


def by_source(items: DataFrame) -> DataFrame:
    """(source, n_items), by source."""
    return items.groupBy("source").agg(F.count("*").alias("n_items")).orderBy("source")
