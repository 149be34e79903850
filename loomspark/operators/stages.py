"""The construction stages as compositions: requests out, results in, and what became of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import jsonops as J
from loomspark.functions.text import clean_html
from loomspark.operators import qa_build as Q
from loomspark.operators.lineage import written
from loomspark.sources import io

MIN_CHARACTERS = 100


def build_requests(df: DataFrame, prompt: Column, key: str, system: str, temperature: float, batch_size: int = 500) -> DataFrame:
    """key, batch and request line of every row; keys must be unique."""
    if not df.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} is not unique")
    rows = df.select(F.col(key).alias("key"), Q.request_json(F.col(key).cast("string"), prompt, system, temperature).alias("line"))
    return Q.batches(rows, "key", batch_size)


def page_requests(pages: DataFrame, key: str, html: str, template: Callable[[Column], Column] | None = None, **how) -> DataFrame:
    """Requests for pages whose cleaned text is long enough."""
    text = clean_html(F.col(html))
    rows = pages.withColumn("_text", text).where(F.length("_text") >= MIN_CHARACTERS)
    return build_requests(rows, F.col("_text") if template is None else template(F.col("_text")), key, **how)


def results(lines: DataFrame) -> DataFrame:
    """(key, line, text, error) of result lines (line, value)."""
    v = F.col("value")
    return lines.select(F.get_json_object(v, "$.key").alias("key"), "line", J.response_text(v).alias("text"), J.response_error(v).alias("error"))


def load_results(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results: key, response (a variant); errors: key, file, line, error, raw) of result lines (file, line, value).

    Of a key's lines in order the first that can be parsed is its result, all behind it are repeats; a line without a key
    in text, or that can't be parsed, is an error.
    """
    v = J.one_json(F.col("value"))
    rows = lines.select("file", "line", F.col("value").alias("raw"), F.struct(v.alias("v")).alias("v"))
    v = F.col("v.v")
    key = F.when(J.kind(J.inner(v, "key")) == "STRING", F.try_variant_get(v, "$.key", "string"))
    text = J.response_text(F.col("raw"))
    rows = rows.select("file", "line", "raw", key.alias("key"), text.alias("text"), J.response_error(F.col("raw")).alias("said"), F.struct(J.parsed(text).alias("v")).alias("response"))
    response = F.col("response.v")
    rows = rows.withColumn("good", F.col("key").isNotNull() & response.isNotNull())
    place = F.struct("file", "line")
    first = rows.where("good").groupBy("key").agg(F.min(place).alias("first"))
    both = rows.join(first, "key", "left")
    error = (
        F.when(F.col("key").isNull(), "no key")
        .when(place > F.col("first"), "the key is there already")
        .when(F.col("text").isNull(), F.coalesce(F.concat(F.lit("the service says: "), F.col("said")), F.lit("no text in the response")))
        .when(~F.col("good"), "no JSON in the response")
    )
    both = written(both.withColumn("error", error))
    return both.where("error is null").select("key", response.alias("response")), both.where("error is not null").select("key", "file", "line", "error", "raw")


def validated_results(index: DataFrame, results: DataFrame, errors: DataFrame, fault: Column) -> tuple[DataFrame, DataFrame]:
    """(results of the index's keys that have no fault, all errors): results of other keys, keys without a result or any
    error, and results at fault are errors too. fault is an error text of key, response and the index's columns, or null."""
    both = index.withColumn("_i", F.lit(True)).join(results.select("key", "response", F.lit(True).alias("_r")), "key", "full_outer")
    told = errors.select("key").where("key is not null").distinct().withColumn("_e", F.lit(True))
    why = F.when(F.col("_i").isNull(), "unexpected key").when(F.col("_r").isNull(), F.when(F.col("_e").isNull(), "no result")).otherwise(fault)
    both = written(both.join(told, "key", "left").withColumn("error", why))
    ok = both.where("error is null and _i and _r").select(*index.columns, "response")
    more = both.where("error is not null").select("key", F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("line"), "error", F.to_json("response").alias("raw"))
    return ok, errors.unionByName(more)


def merge_stage(spark, folder: str, stage: str, source: DataFrame, position: str, fault: Column) -> tuple[DataFrame, DataFrame]:
    """(rows of the source with their results, errors) of a stage in a folder, if its requests were made of this source and
    the results of all their batches are there."""
    made, index = io.verified_input(spark, io.stage_paths(folder, stage)["requests"], source, stage)
    files = io.expected_results(spark, folder, stage, made["batches"])
    lines = io.read_json_lines(spark, files) if files else spark.createDataFrame([], "file string, line long, value string, error string")
    broken = lines.where("error is not null").limit(1).collect()
    if broken:
        raise ValueError(f"{broken[0].file}, line {broken[0].line}: {broken[0].error}")
    ok, errors = validated_results(index, *load_results(lines), fault)
    return source.join(ok.select(F.col("row_position").alias(position), "response"), position), errors


def merge_results(df: DataFrame, key: str, got: DataFrame, error: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(rows with their first valid response as a variant, keys without one); error maps the variant to a text or null.
    merge_stage also reports each line that was no result."""
    seen = got.withColumn("response", J.parsed(F.col("text")))
    why = F.coalesce(F.col("error"), error(F.col("response")))
    status = Q.merged_results(df.select(F.col(key).cast("string").alias("key")), seen, why)
    ok = status.where("status = 'ok'").select("key", "line").join(seen.select("key", "line", "response"), ["key", "line"])
    return df.join(ok.withColumnRenamed("key", "_key"), F.col(key).cast("string") == F.col("_key")).drop("_key", "line"), status.where("status <> 'ok'")


def relevant(df: DataFrame, response: str = "response") -> DataFrame:
    """Pages that stage 1 found relevant, with its fields; a category is required of them."""
    v = F.col(response)
    text = lambda name: F.try_variant_get(v, f"$.{name}", "string").alias(name)
    return df.where(F.try_variant_get(v, "$.is_relevant", "boolean")).select(*[c for c in df.columns if c != response], text("target_population"), text("category"), text("reason"))


def totals(status: DataFrame) -> DataFrame:
    """(status, n) of merged results, for reports."""
    return status.groupBy("status").agg(F.count("*").alias("n"))


def construct(pages: DataFrame, key: str, lines: dict[int, DataFrame], order: str, guideline: str = "guideline", page: str = "page") -> tuple[DataFrame, dict[int, DataFrame]]:
    """(final questions, errors by stage) of pages, from the result lines (line, value) of the three stages: relevant
    pages, their rules, groups by page, and the questions of their responses. Rows whose response isn't valid are errors."""
    errors = {}
    judged, errors[1] = merge_results(pages, key, results(lines[1]), J.stage1_error)
    chosen = relevant(judged)
    ruled, errors[2] = merge_results(chosen, key, results(lines[2]), J.stage2_error)
    rules = Q.explode_rules(ruled).withColumn("rule_order", F.struct(order, "rule_number_on_page"))
    single = ["target_population", "category", "reason"]
    groups = Q.numbered_groups(Q.stage3_groups(rules, [guideline, page], "rule_order", single, ["condition", "action", "triggers", "source_fragment", "notes"]))
    mixed = groups.where("mixed").limit(1).collect()
    if mixed:
        raise ValueError(f"{mixed[0]['key']} has more than one value where it must have one")
    seen = results(lines[3]).withColumn("response", J.parsed(F.col("text")))
    of = seen.join(groups.select("key", "target_population", "category"), "key", "left")
    bad = J.stage3_error(F.col("response"), F.col("target_population"), F.col("category"))
    status = Q.merged_results(groups, of, F.coalesce(F.col("error"), bad))
    errors[3] = status.where("status <> 'ok'")
    ok = status.where("status = 'ok'").select("key", "line").join(seen.select("key", "line", "response"), ["key", "line"])
    return Q.final_questions(groups, ok), errors
