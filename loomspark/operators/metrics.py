"""Answers, accuracy, metrics upsert and gold contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions.jsonops import POPULATIONS
from loomspark.functions.text import join_key
from loomspark.operators.agreement import faults
from loomspark.operators.corpus import require_columns


def missing(c: Column) -> Column:
    return c.isNull() | F.coalesce(F.isnan(c.try_cast("double")), F.lit(False))


def query_text(profile: Column, scenario: Column, question: Column) -> Column:
    """Profile, scenario and question if the first two are there, else the question."""
    return F.when(profile.isNotNull() & scenario.isNotNull(), F.concat_ws(" ", profile, scenario, question)).otherwise(question)


def correct_answer(*answers: Column) -> Column:
    """The first that is there: trimmed, lower case, without brackets, if it is a-d."""
    a = F.lower(F.btrim(F.trim(F.coalesce(*answers)), F.lit("()")))
    return F.when(a.isin("a", "b", "c", "d"), a)


def accuracy(df: DataFrame, predicted: str, correct: str, population: str) -> DataFrame:
    """(population, n, correct, unparsed, accuracy) for All and each population; unparsed counts as wrong; a row without
    a population is in All only, an unknown population is an error."""
    p = F.trim(F.col(population))
    known_or_none = F.when(p.isNull() | p.isin(*POPULATIONS), p).otherwise(F.raise_error(F.concat(F.lit("unknown population: "), p)).cast("string"))
    groups = F.explode(F.array_compact(F.array(F.lit("All"), known_or_none)))
    rows = df.select(groups.alias("population"), F.col(predicted).alias("p"), F.col(correct).alias("c"))
    got = rows.groupBy("population").agg(F.count("*").alias("n"), F.count_if(F.col("p") == F.col("c")).alias("correct"), F.count_if(F.col("p").isNull()).alias("unparsed"))
    known = df.sparkSession.createDataFrame([(x,) for x in ("All", *POPULATIONS)], "population string")
    out = F.broadcast(known).join(got, "population", "left").na.fill(0, ["n", "correct", "unparsed"])
    return out.withColumn("accuracy", F.when(F.col("n") > 0, F.bround(100 * F.col("correct") / F.col("n"), 4)))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The last row of each key of old then new, sorted by key with nulls first; nulls are equal keys.

    Within a side the last is the greatest in `order`; without it, the last as the rows are read.
    """
    place = lambda df: F.col(order) if order else F.monotonically_increasing_id()
    rows = old.withColumns({"_side": F.lit(0), "_place": place(old)}).unionByName(new.withColumns({"_side": F.lit(1), "_place": place(new)}), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("_side"), F.desc("_place"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_side", "_place").orderBy(*[F.asc_nulls_first(k) for k in keys])


def with_extractions(df: DataFrame, extracted: DataFrame, position: str, question: str = "question") -> DataFrame:
    """df with the extracted profile and core that stand at the same position; rows and questions must be the same."""
    require_columns(extracted, [position, "extracted_patient_profile", "extracted_question_core"])
    checks = [F.col(question).alias("_q")] if question in extracted.columns else []
    right = extracted.select(F.col(position), "extracted_patient_profile", "extracted_question_core", F.lit(True).alias("_r"), *checks)
    both = df.drop("extracted_patient_profile", "extracted_question_core").withColumn("_l", F.lit(True)).join(right, position, "full_outer")
    bad = {"rows that one side lacks": F.col("_l").isNull() | F.col("_r").isNull()}
    if checks:
        bad["questions differ"] = ~F.col("_q").eqNullSafe(F.col(question))
    return faults(both, bad).drop("_l", "_r", "_q")


def gold_contexts(df: DataFrame, gold: DataFrame, keys: list[str], text: str) -> DataFrame:
    """df with its gold passage by canonical keys; conflicting gold rows and misses are errors in _gold_error."""
    named = [join_key(F.col(k)).alias(f"_k{i}") for i, k in enumerate(keys)]
    ks = [f"_k{i}" for i in range(len(keys))]
    g = gold.select(*named, F.col(text).alias("_t")).groupBy(*ks).agg(F.min("_t").alias("gold_text"), F.count_distinct("_t").alias("_n"))
    out = df.select("*", *named).join(g, ks, "left").drop(*ks)
    return out.withColumn("gold_error", F.when(F.col("_n") > 1, "conflict").when(F.col("gold_text").isNull(), "missing")).drop("_n")
