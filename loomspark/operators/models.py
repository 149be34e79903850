"""Adapters where a model or a service would be called, with a deterministic stand-in."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import jsonops as J
from loomspark.operators.prompts import filled


def answered(df: DataFrame, prompt: str, out: str, model: Callable[[list[str]], Iterable[str]], batch: int = 24) -> DataFrame:
    """df with the model's text for each prompt; the callable is made once per batch of rows on the executors."""
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField(out, StringType())])

    def run(frames):
        for f in frames:
            got: list[str] = []
            for i in range(0, len(f), batch):
                got += list(model(f[prompt].iloc[i : i + batch].tolist()))
            yield f.assign(**{out: got})

    return df.mapInPandas(run, schema)


def missing_only(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that still lack one of the columns; nothing to do if none."""
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.col(c).isNull()
    return df.where(cond)


#: The columns of an extraction (fixed values).
EXTRACTED = ("extracted_patient_profile", "extracted_question_core")


def with_profiles(df: DataFrame, model: Callable[[list[str]], Iterable[str]], template: str, original: Column, batch: int = 24) -> DataFrame:
    """df with each row's extracted profile and core. Where every row has both, they stay as they are; else the model is asked
    for all rows anew, with the row's original text at {question}, and replies without a profile give the general patient."""
    if set(EXTRACTED) <= set(df.columns) and missing_only(df, list(EXTRACTED)).isEmpty():
        return df
    rows = df.drop(*EXTRACTED).withColumn("_original", original)
    rows = rows.withColumn("_prompt", filled(template, {"question": F.col("_original")}))
    rows = answered(rows, "_prompt", "_reply", model, batch)
    profile, core = J.profile(F.col("_reply"), F.col("_original"))
    return rows.withColumns(dict(zip(EXTRACTED, (profile, core), strict=True))).drop("_original", "_prompt", "_reply")


def echo(prompts: list[str]) -> list[str]:
    """A stand-in: answers with the letter that the prompt's length gives."""
    return [f"Final answer: ({'abcd'[len(p or '') % 4]})" for p in prompts]
