"""Rater agreement, majority vote and composition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions.jsonops import POPULATIONS
from loomspark.operators.corpus import require_columns

#: The raters' metrics, and the columns and question types of model labels.
ORDINAL = ("Guideline Consistency", "Medical Validity", "One-Best-Answer Clarity", "Distractor Plausibility")
TARGET = "Target Population Appropriateness"
LABEL_COLUMNS = ("id", "source", "question_type", "target_population", "is_anesthesia_model")
LABEL_TYPES = ("DIAGNOSIS", "MANAGEMENT", "BASIC_SCIENCE", "OTHER")


def aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Both raters' rows by key, with suffixes _1 and _2; keys must be unique and the same."""
    for df in (left, right):
        if not df.groupBy(key).count().where("count > 1").isEmpty():
            raise ValueError(f"{key} is not unique")
    a = left.select(key, *[F.col(c).alias(f"{c}_1") for c in left.columns if c != key], F.lit(1).alias("_a"))
    b = right.select(key, *[F.col(c).alias(f"{c}_2") for c in right.columns if c != key], F.lit(1).alias("_b"))
    both = a.join(b, key, "full_outer")
    if not both.where("_a is null or _b is null").isEmpty():
        raise ValueError("the raters' keys differ")
    return both.drop("_a", "_b")


def cohen_kappa(pairs: DataFrame, left: str, right: str, quadratic: bool = False) -> DataFrame:
    """One row (n_items, kappa) of pairs; weights by place among the labels seen; null if chance disagreement is 0.

    Disagreement by chance comes from the raters' label counts and their moments, so no label meets all others.
    """
    cells = pairs.groupBy(F.col(left).alias("l"), F.col(right).alias("r")).agg(F.count("*").alias("n"))  # labels, not rows, from here on
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("l").alias("v"), F.col("n").alias("nl"), F.lit(0).cast("long").alias("nr")),
                F.struct(F.col("r").alias("v"), F.lit(0).cast("long").alias("nl"), F.col("n").alias("nr")),
            )
        ).alias("x")
    ).select("x.*")
    labels = sides.groupBy("v").agg(F.sum("nl").alias("nl"), F.sum("nr").alias("nr")).withColumn("i", (F.row_number().over(Window.orderBy("v")) - 1).cast("double"))
    moment = lambda n, k: F.sum(F.col(n) * F.pow("i", F.lit(k)))
    total = labels.agg(
        F.sum("nl").alias("n_items"),
        F.greatest(F.max("i"), F.lit(1.0)).alias("span"),
        moment("nl", 1).alias("l1"),
        moment("nl", 2).alias("l2"),
        moment("nr", 1).alias("r1"),
        moment("nr", 2).alias("r2"),
        F.sum(F.col("nl").cast("double") * F.col("nr")).alias("same"),
    )
    place = labels.select("v", "i")
    seen = cells.join(place.select(F.col("v").alias("l"), F.col("i").alias("li")), "l").join(place.select(F.col("v").alias("r"), F.col("i").alias("ri")), "r")
    seen = seen.agg(F.sum(F.pow(F.col("li") - F.col("ri"), 2) * F.col("n")).alias("far"), F.sum(F.when(F.col("li") != F.col("ri"), F.col("n")).otherwise(0)).cast("double").alias("other"))
    n, span2 = F.col("n_items").cast("double"), F.pow("span", F.lit(2))
    if quadratic:
        o, e = F.col("far") / span2, (n * F.col("l2") + n * F.col("r2") - 2 * F.col("l1") * F.col("r1")) / span2
    else:
        o, e = F.col("other"), n * n - F.col("same")
    out = total.crossJoin(seen)  # one row each
    return out.select(F.coalesce("n_items", F.lit(0)).alias("n_items"), F.when(e > 1e-12, F.round(1 - o * n / e, 6)).alias("kappa"))


def rating_summary(pairs: DataFrame, metric: str, left: str, right: str, quadratic: bool = True) -> DataFrame:
    """One row: pooled mean and sample deviation, exact and within-one agreement, kappa."""
    pooled = pairs.select(F.explode(F.array(left, right)).alias("v"))
    a = pooled.agg(F.count("v").alias("n_ratings"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("std"))
    near = F.abs(F.col(left) - F.col(right))
    b = pairs.agg(F.round(F.avg((near == 0).cast("double")), 6).alias("exact_agreement"), F.round(F.avg((near <= 1).cast("double")), 6).alias("within_one"))
    k = cohen_kappa(pairs, left, right, quadratic)
    return a.crossJoin(b).crossJoin(k).select(F.lit(metric).alias("metric"), "*")  # one row each


def binary_summary(pairs: DataFrame, metric: str, left: str, right: str, positive: str = "Correct") -> DataFrame:
    """One row on a yes-or-no metric: the pooled share of positive ratings, exact agreement, and kappa without weights."""
    pooled = pairs.select(F.explode(F.array(left, right)).alias("v"))
    a = pooled.agg(F.count("v").alias("n_ratings"), F.round(F.avg((F.col("v") == positive).cast("double")), 6).alias("accuracy"))
    b = pairs.agg(F.round(F.avg((F.col(left) == F.col(right)).cast("double")), 6).alias("exact_agreement"))
    return a.crossJoin(b).crossJoin(cohen_kappa(pairs, left, right)).select(F.lit(metric).alias("metric"), "*")  # one row each


def summarize(both: DataFrame) -> DataFrame:
    """All metrics of two raters' aligned rows (columns with suffixes _1 and _2), a row for each metric."""
    out = None
    for m in ORDINAL:
        part = rating_summary(both, m, f"`{m}_1`", f"`{m}_2`").withColumns({"scale": F.lit("ordinal_1_5"), "kappa_weighting": F.lit("quadratic"), "accuracy": F.lit(None).cast("double")})
        out = part if out is None else out.unionByName(part)
    last = binary_summary(both, TARGET, f"`{TARGET}_1`", f"`{TARGET}_2`").withColumns(
        {"scale": F.lit("binary"), "kappa_weighting": F.lit("unweighted"), **{c: F.lit(None).cast("double") for c in ("mean", "std", "within_one")}}
    )
    return out.unionByName(last)


def faults(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """df, if no row meets any of the checks (fault: condition); else an error that names the first fault and its rows."""
    counts = df.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(f"c{i}") for i, c in enumerate(checks.values())]).first()
    for i, name in enumerate(checks):
        if counts[f"c{i}"]:
            raise ValueError(f"{name}: {counts[f'c{i}']} rows")
    return df


def unique(df: DataFrame, key: str) -> DataFrame:
    again = [r[0] for r in df.groupBy(key).count().where("count > 1").orderBy(key).limit(5).collect()]
    if again:
        raise ValueError(f"{key} is not unique: {again}")
    return df


def checked_ratings(df: DataFrame, key: str = "data_id") -> DataFrame:
    """One rater's rows: trimmed keys, not empty and unique, whole ratings of 1 to 5, and Correct or Incorrect."""
    require_columns(df, [key, *ORDINAL, TARGET])
    number = {m: F.col(m).try_cast("double") for m in ORDINAL}
    out = df.select(F.trim(F.col(key).cast("string")).alias(key), *[number[m].alias(m) for m in ORDINAL], F.trim(F.col(TARGET)).alias(TARGET))
    bad = {f"{m} is no whole rating of 1 to 5": ~(F.col(m).between(1, 5) & (F.col(m) % 1 == 0)) for m in ORDINAL}
    faults(out, {f"{key} is empty": F.col(key) == "", **bad, f"{TARGET} is neither Correct nor Incorrect": ~F.col(TARGET).isin("Correct", "Incorrect")})
    return unique(out, key).withColumns({m: F.col(m).cast("int") for m in ORDINAL})


def checked_labels(df: DataFrame, model: str) -> DataFrame:
    """One model's labels: the columns that are needed, unique ids, closed vocabularies, real booleans; with the model's name."""
    require_columns(df, LABEL_COLUMNS)
    if dict(df.dtypes)["is_anesthesia_model"] != "boolean":
        raise ValueError(f"{model}: is_anesthesia_model is no boolean")
    out = df.select(*LABEL_COLUMNS)
    faults(out, {f"{model}: {c} is missing": F.col(c).isNull() for c in LABEL_COLUMNS if c != "source"})
    faults(out, {f"{model}: unknown question_type": ~F.col("question_type").isin(*LABEL_TYPES), f"{model}: unknown target_population": ~F.col("target_population").isin(*POPULATIONS)})
    return unique(out, "id").withColumn("model", F.lit(model))


def aligned_labels(frames: list[DataFrame]) -> DataFrame:
    """The frames of all models as one, if they have the same ids with the same sources."""
    first = frames[0].select("id", F.col("source").alias("s0"), F.lit(1).alias("a"))
    for f in frames[1:]:
        both = first.join(f.select("id", F.col("source").alias("s1"), F.lit(1).alias("b")), "id", "full_outer")
        faults(both, {"ids that one model lacks": F.col("a").isNull() | F.col("b").isNull(), "sources differ between models": ~F.col("s0").eqNullSafe(F.col("s1"))})
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def fleiss_kappa(ratings: DataFrame, item: str, label: str, raters: int = 3) -> DataFrame:
    """One row (n_items, kappa) of long ratings; items without exactly `raters` ratings make it null."""
    cells = ratings.groupBy(item, label).agg(F.count("*").alias("n"))
    items = cells.groupBy(item).agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    p = items.agg(F.count("*").alias("n_items"), F.avg((F.col("sq") - raters) / F.lit(raters * (raters - 1))).alias("p"), F.count_if(F.col("m") != raters).alias("bad"))
    q = cells.groupBy(label).agg(F.sum("n").alias("n"))
    total = q.agg(F.sum("n").alias("t"), F.sum(F.col("n").cast("double") * F.col("n")).alias("s"))
    pe = F.col("s") / (F.col("t").cast("double") * F.col("t"))
    kappa = F.when((F.col("bad") == 0) & (pe < 1), F.round((F.col("p") - pe) / (1 - pe), 6))
    return p.crossJoin(total).select("n_items", kappa.alias("kappa"))  # one row each


def majority(labels: list[Column]) -> Column:
    """The label that at least two of three non-null labels have, else null."""
    a, b, c = labels
    vote = F.when(a == b, a).when(a == c, a).when(b == c, b)
    return F.when(a.isNotNull() & b.isNotNull() & c.isNotNull(), vote)


def all_different(labels: list[Column]) -> Column:
    return F.size(F.array_distinct(F.array(*labels))) == 3


def majority_vote(ratings: DataFrame, keys: list[str], columns: list[str], deciding: list[str]) -> DataFrame:
    """Three raters' rows by keys: the vote on each column, and whether a deciding column is all different."""
    keep = ratings.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rater", *columns))).alias("r"), F.count("*").alias("n")).where("n = 3")  # three rows a group
    at = lambda c: [F.col("r")[i][c] for i in range(3)]
    excluded = F.lit(False)
    for c in deciding:
        excluded = excluded | all_different(at(c))
    return keep.select(*keys, *[majority(at(c)).alias(c) for c in columns], excluded.alias("excluded"))


def composition(items: DataFrame, group: str, flags: dict[str, Column]) -> DataFrame:
    """Counts and percentages of flags by group, and over all (group null)."""
    out = items.rollup(group).agg(F.count("*").alias("n_items"), *[F.count_if(c).alias(f"n_{k}") for k, c in flags.items()])
    return out.select(group, "n_items", *[x for k in flags for x in (F.col(f"n_{k}"), F.bround(100 * F.col(f"n_{k}") / F.col("n_items"), 2).alias(f"pct_{k}"))])
