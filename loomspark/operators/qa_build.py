"""Requests, results, rules, groups, final questions and answer rebalancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions import jsonops as J
from loomspark.operators.corpus import with_position

LABELS = ("a", "b", "c", "d")


def request_json(key: Column, prompt: Column, system: str, temperature: float) -> Column:
    """The request line of one row."""
    content = F.array(F.struct(F.array(F.struct(prompt.alias("text"))).alias("parts"), F.lit("user").alias("role")))
    return F.to_json(
        F.struct(
            key.alias("key"),
            F.struct(
                content.alias("contents"),
                F.lit(system).alias("system_instruction"),
                F.struct(F.lit(temperature).alias("temperature")).alias("generation_config"),
            ).alias("request"),
        )
    )


def batches(df: DataFrame, ordinal: str, size: int = 500, blocks: int = 64) -> DataFrame:
    """batch and batch_row of rows by a dense or sparse ordinal."""
    out = with_position(df, ordinal, "_i", blocks)
    return out.withColumn("batch", (F.floor(F.col("_i") / size) + 1).cast("long")).withColumn("batch_row", (F.col("_i") % size).cast("long")).drop("_i")


def merged_results(index: DataFrame, results: DataFrame, error: Column) -> DataFrame:
    """(key, status): ok, invalid, missing or unexpected; the first valid result of a key wins."""
    good = F.when(error.isNull(), 0).otherwise(1)
    first = results.withColumn("_e", error).groupBy("key").agg(F.min(F.struct(good.alias("bad"), "line", F.col("_e").alias("error"))).alias("r"), F.count("*").alias("n_results"))
    both = index.select("key", F.lit(True).alias("_i")).join(first, "key", "full_outer")
    status = F.when(F.col("_i").isNull(), "unexpected").when(F.col("r").isNull(), "missing").when(F.col("r.bad") == 1, "invalid").otherwise("ok")
    return both.select("key", status.alias("status"), F.col("r.line").alias("line"), F.coalesce("n_results", F.lit(0)).alias("n_results"))


def explode_rules(pages: DataFrame, response: str = "response") -> DataFrame:
    """A row for each rule of each page's stage 2 response (a variant), numbered on its page from 1; the page's other
    columns stay. Pages without a list of rules have none."""
    # an inner explode would read the rules twice, once to filter pages without any
    rows = pages.select(*[c for c in pages.columns if c != response], F.posexplode_outer(J.rules_of(F.col(response))).alias("_n", "_r")).where("_n is not null")
    text = lambda name: F.try_variant_get("_r", f"$.{name}", "string")
    triggers = F.to_json(F.try_variant_get("_r", "$.triggers", "variant"))
    return rows.select(
        *[c for c in rows.columns if c not in ("_n", "_r")],
        text("condition_base").alias("condition"),
        text("action").alias("action"),
        triggers.alias("triggers"),
        text("source_fragment").alias("source_fragment"),
        text("notes").alias("notes"),
        (F.col("_n") + 1).cast("long").alias("rule_number_on_page"),
    )


def stage3_groups(rules: DataFrame, keys: list[str], order: str, single: list[str], nested: list[str]) -> DataFrame:
    """One page's rules, nested in order, its first order, and whether a value that must be single is not (mixed).

    A group holds the rules of one page of a guideline, so a list of them is bounded by a page.
    """
    aggs = [F.count_distinct(c).alias(f"_{c}") for c in single]
    g = rules.groupBy(*keys).agg(
        F.min(order).alias("first"),
        F.count("*").alias("n_rules"),
        F.sort_array(F.collect_list(F.struct(order, *nested))).alias("rules"),
        *[F.min(c).alias(c) for c in single],
        *aggs,
    )  # one page's rules
    bad = F.lit(False)
    for c in single:
        bad = bad | (F.col(f"_{c}") != 1)
    return g.withColumn("mixed", bad).drop(*[f"_{c}" for c in single])


def numbered_groups(groups: DataFrame, prefix: str = "guideline_page_") -> DataFrame:
    """Groups with their key, numbered by first sight from 1 in six digits."""
    rows = with_position(groups, "first", "_i")
    return rows.withColumn("key", F.concat(F.lit(prefix), F.lpad((F.col("_i") + 1).cast("string"), 6, "0"))).drop("_i")


def final_rows(groups: DataFrame, nested: list[str]) -> DataFrame:
    """Groups with an array column for each rule field."""
    return groups.select(*[c for c in groups.columns if c != "rules"], *[F.col(f"rules.{c}").alias(f"rule_{c}") for c in nested])


def final_questions(groups: DataFrame, responses: DataFrame, population: str = "target_population", category: str = "category") -> DataFrame:
    """A row for each question of each group's response (key, response: a variant), with the group's columns, sorted by
    key; groups without a response have none, a response that isn't valid for its group is an error."""
    both = groups.join(responses.select("key", "response"), "key")
    why = J.stage3_error(F.col("response"), F.col(population), F.col(category))
    checked = F.when(why.isNull(), J.questions_of(F.col("response"))).otherwise(F.raise_error(F.concat("key", F.lit(": "), why)).cast("array<variant>"))
    rows = both.select(*groups.columns, F.posexplode_outer(checked).alias("question_number", "_q")).where("question_number is not null")
    text = lambda name: F.try_variant_get("_q", f"$.{name}", "string").alias(name)
    fields = ("question_type", "patient_profile", "scenario", "question", "explanation", "difficulty")
    out = rows.select(
        *groups.columns,
        "question_number",
        *map(text, fields),
        J.options_of(F.col("_q")).alias("options"),
        F.lower(F.try_variant_get("_q", "$.correct_answer", "string")).alias("correct_answer"),
    )
    return out.orderBy("key", "question_number")


def answer_counts(df: DataFrame, *columns: str) -> DataFrame:
    """(column, label, count) of answer keys, for all four labels."""
    known = df.sparkSession.createDataFrame([(c, x) for c in columns for x in LABELS], "column string, label string")
    seen = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("label")) for c in columns])).alias("x")).select("x.*")
    return F.broadcast(known).join(seen.groupBy("column", "label").agg(F.count("*").alias("count")), ["column", "label"], "left").na.fill(0, ["count"])


def rebalance(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """label_order and correct_label: labels are dealt in order of md5(seed:key), counts differ by at most one,
    and distractors take the other labels in order of md5(seed:key:option). Options are option_a to option_d."""
    k = F.col(key).cast("string")
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), k).cast("binary"))
    # places by counts of hash prefixes and a window inside each prefix
    rows = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 2))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # at most 256 rows
    sums = rows.groupBy("_b").agg(F.count("*").alias("_c")).withColumn("_s", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    total = sums.agg(F.sum("_c").alias("_t"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))).join(F.broadcast(sums), "_b").crossJoin(F.broadcast(total))  # one row
    place = F.col("_s") + F.col("_n") - 1
    base, rest = F.floor(F.col("_t") / 4), F.col("_t") % 4
    ends = [base * (i + 1) + F.least(rest, F.lit(i + 1)) for i in range(4)]
    label = F.when(place < ends[0], "a").when(place < ends[1], "b").when(place < ends[2], "c").otherwise("d")
    return rows.withColumn("correct_label", label).drop("_h", "_b", "_n", "_c", "_s", "_t")


def shuffled_distractors(options: Column, correct: Column, new_label: Column, key: Column, seed: int = 42) -> Column:
    """map label -> text: the correct text at new_label, the others in hashed order on the labels left."""
    others = F.filter(F.array(*map(F.lit, LABELS)), lambda x: x != correct)
    hashed = F.array_sort(F.transform(others, lambda x: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), key, x).cast("binary")).alias("h"), F.element_at(options, x).alias("t"))))
    free = F.filter(F.array(*map(F.lit, LABELS)), lambda x: x != new_label)
    return F.map_concat(F.map_from_arrays(F.array(new_label), F.array(F.element_at(options, correct))), F.map_from_arrays(free, F.transform(hashed, lambda x: x["t"])))


def rebalanced(df: DataFrame, key: str, options: str = "options", correct: str = "correct_answer", seed: int = 42) -> DataFrame:
    """df with its options and answer dealt anew, and both as they were before; options that aren't a-d, or an answer that
    is no label, are an error."""
    o, c = J.normalized_options(F.col(options)), F.lower(F.col(correct))
    o = F.when(o.isNotNull(), o).otherwise(F.raise_error(F.lit("options are not a-d")).cast("map<string,string>"))
    c = F.when(c.isin(*LABELS), c).otherwise(F.raise_error(F.lit("answer is not a-d")).cast("string"))
    rows = df.withColumns({f"{options}_before_rebalance": o, f"{correct}_before_rebalance": c})
    rows = rebalance(rows, key, seed)
    new = shuffled_distractors(F.col(f"{options}_before_rebalance"), F.col(f"{correct}_before_rebalance"), F.col("correct_label"), F.col(key).cast("string"), seed)
    return rows.withColumn(options, new).withColumn(correct, F.col("correct_label")).drop("correct_label")
