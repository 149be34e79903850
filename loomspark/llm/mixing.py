"""Mixing sources to target weights, in DataFrame functions only.

A source's weight is its token share to the power of an exponent. The exponent is bisected (a grid of points each round)
until the mixture's entropy meets a target between the natural and the uniform one, or the most repeated source
stands at the repetition limit, whichever comes first from the natural side. Weights times the budget give quotas in
tokens; a quota is realised as whole permutations (blocks) of the source and a part of one more, in hashed order.
Running sums are taken inside hashed buckets of a source, over the buckets of a shelf, and over its shelves, so a hot source
is never in one task.

Defined cases: null and empty sources are one source; a text without words counts one token; rows of equal id are
ordered by their text's hash and both may be taken; an empty table gives an empty result; other columns are kept by `mix`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.llm.common import cut, fresh

#: Share of the way from natural to uniform entropy; most repeats of a source; rows in a bucket.
ENTROPY_SHARE, MOST_REPEATS, BUCKET_ROWS = 0.5, 4.0, 2048
#: Sources up to which weights are broadcast (under 10 MB); beyond, they are joined with salts.
BROADCAST_SOURCES, SALTS = 50_000, 32
GRID, ROUNDS = 32, 6
#: Buckets of a shelf.
SHELF_BUCKETS = 1024


def tokens(text_col: str):
    return F.greatest(F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)), F.lit(1)).cast("long")


def _at(shares: DataFrame, points: list[float]) -> list:
    """entropy and the greatest of p^(t-1)/Z for each exponent t."""
    p = F.exp(F.col("t") * F.col("lp"))
    rows = shares.select("lp", F.explode(F.array(*[F.lit(float(x)) for x in points])).alias("t"))
    got = rows.groupBy("t").agg(F.sum(p).alias("z"), F.sum(p * F.col("lp")).alias("s"), F.max(F.exp((F.col("t") - 1) * F.col("lp"))).alias("m"))
    return got.select("t", (F.log("z") - F.col("t") * F.col("s") / F.col("z")).alias("h"), (F.col("m") / F.col("z")).alias("r"), F.col("z")).orderBy("t").collect()  # one row a point


def exponent(shares: DataFrame, budget_ratio: float, entropy_share: float = ENTROPY_SHARE, most_repeats: float = MOST_REPEATS) -> tuple[float, float]:
    """The exponent and its normaliser: the least one in [0, 1] whose entropy and repeats are within both limits."""
    ends = _at(shares, [0.0, 1.0])
    goal = ends[1].h + entropy_share * (ends[0].h - ends[1].h)
    ok = lambda x: x.h <= goal + 1e-12 and x.r * budget_ratio <= max(most_repeats, budget_ratio)
    low, high, best = 0.0, 1.0, ends[1]
    if ok(ends[0]):
        return 0.0, ends[0].z
    for _ in range(ROUNDS):
        got = _at(shares, [low + (high - low) * i / GRID for i in range(GRID + 1)])
        k = next((i for i, x in enumerate(got) if ok(x)), GRID)
        best, low, high = got[k], got[max(0, k - 1)].t, got[k].t
    return best.t, best.z


def weights(rows: DataFrame, budget_ratio: float = 1.0, entropy_share: float = ENTROPY_SHARE, most_repeats: float = MOST_REPEATS) -> DataFrame:
    """source_key, n_rows, source_tokens, weight, quota of every source of rows (source_key, tokens)."""
    src = cut(rows.groupBy("source_key").agg(F.count("*").alias("n_rows"), F.sum("tokens").alias("source_tokens")))
    total = src.agg(F.sum("source_tokens")).first()[0]
    if not total:
        return src.withColumn("weight", F.lit(0.0)).withColumn("quota", F.lit(0.0))
    shares = src.withColumn("lp", F.log(F.col("source_tokens") / F.lit(float(total))))
    t, z = exponent(shares, budget_ratio, entropy_share, most_repeats)
    weight = F.exp(F.lit(t) * F.col("lp")) / F.lit(z)
    return shares.withColumn("weight", weight).withColumn("quota", F.col("weight") * float(total) * budget_ratio).drop("lp")


def mix(docs: DataFrame, seed: int = 42, budget_ratio: float = 1.0, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", only_ids: bool = False) -> DataFrame:
    """The rows of the mixture: docs' columns (or the id), and _source, _tokens, _weight, _block, _order (with further
    underscores behind names that docs has already)."""
    keep = [id_col] if only_ids else docs.columns
    names = fresh(docs.select(*[F.col(f"`{c}`") for c in keep]), "_source", "_tokens", "_weight", "_block", "_order")
    salt = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc"),
        F.col(id_col).alias("id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        tokens(text_col).alias("tokens"),
        salt.alias("salt"),
    )
    if only_ids:
        rows = cut(rows)
    w = cut(weights(rows.select(F.col("source").alias("source_key"), "tokens"), budget_ratio))
    w = w.select(
        F.col("source_key").alias("source"),
        "weight",
        F.floor(F.col("quota") / F.col("source_tokens")).cast("int").alias("whole"),
        (F.col("quota") - F.floor(F.col("quota") / F.col("source_tokens")) * F.col("source_tokens")).alias("rest"),
        F.ceil(F.col("n_rows") / BUCKET_ROWS).cast("long").alias("buckets"),
    )
    if w.count() <= BROADCAST_SOURCES:
        rows = rows.join(F.broadcast(w), "source")
    else:
        w = w.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("n", F.pmod("salt", F.lit(SALTS)).cast("int")).join(w, ["source", "n"]).drop("n")
    order = lambda block: F.xxhash64("salt", block)
    whole = rows.where("whole > 0").withColumn("block", F.explode(F.expr("sequence(0, whole - 1)"))).withColumn("order", order(F.col("block")))
    part = rows.where("rest > 0").withColumn("block", F.col("whole")).withColumn("order", order(F.col("block")))
    part = part.withColumn("bucket", F.pmod("order", F.col("buckets"))).withColumn("shelf", F.floor(F.col("bucket") / SHELF_BUCKETS))
    # tokens before a shelf of buckets, before a bucket in its shelf, and before a row in its bucket
    up_to = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = cut(part.groupBy("source", "shelf", "bucket").agg(F.sum("tokens").alias("b")))
    shelves = sums.groupBy("source", "shelf").agg(F.sum("b").alias("s"))
    shelves = shelves.withColumn("at", F.coalesce(F.sum("s").over(up_to("source", "shelf")), F.lit(0))).drop("s")
    starts = sums.withColumn("in", F.coalesce(F.sum("b").over(up_to("source", "shelf", "bucket")), F.lit(0))).join(shelves, ["source", "shelf"])
    starts = starts.select("source", "bucket", (F.col("at") + F.col("in")).alias("start"))
    inside = Window.partitionBy("source", "bucket").orderBy("order", "id").rowsBetween(Window.unboundedPreceding, -1)
    # only buckets that the quota reaches; the bucket's tokens before this row decide
    part = part.join(starts, ["source", "bucket"]).where("start < rest")
    part = part.withColumn("place", F.col("start") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)) + F.col("tokens") / 2).where("place < rest")
    shown = [F.col("doc.*"), *(F.col(c).alias(n) for c, n in zip(("source", "tokens", "weight", "block", "order"), names, strict=True))]
    return whole.select(*shown).unionByName(part.select(*shown))
