"""Profile replacement for ablations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def replacement_profiles(df: DataFrame, condition: str, key: str, population: str, profile: str, seed: int = 42, limit: int = 120) -> DataFrame:
    """df with new_profile: original, random (either pool), within_group or cross_group; pools hold at most `limit`
    distinct profiles a population in hashed order; General takes the Adult branch; the own profile is no candidate
    but across groups. No candidate is an error."""
    if condition == "original":
        return df.withColumn("new_profile", F.col(profile))
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("p")).cast("binary"))
    bad = df.where(~F.col(population).isin("Adult", "Pediatric", "General") | F.col(population).isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"unknown population {bad[0][population]}")
    pools = df.where(F.col(population).isin("Adult", "Pediatric") & (F.col(profile) != "general patient")).select(F.col(population).alias("g"), F.col(profile).alias("p")).distinct()
    first = F.row_number().over(Window.partitionBy("g").orderBy(h, "p"))
    got: dict[str, list] = {}
    for r in pools.withColumn("n", first).where(F.col("n") <= limit).orderBy("n").collect():  # at most `limit` profiles a population
        got.setdefault(r.g, []).append(r.p)
    adult, child = got.get("Adult", []), got.get("Pediatric", [])
    arr = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    young = F.col(population) == "Pediatric"
    if condition == "random":
        pool = arr([*adult, *child])
    elif condition == "within_group":
        pool = F.when(young, arr(child)).otherwise(arr(adult))
    elif condition == "cross_group":
        pool = F.when(young, arr(adult)).otherwise(arr(child))
    else:
        raise ValueError(f"unknown condition {condition}")
    if condition != "cross_group":
        pool = F.filter(pool, lambda x: x != F.col(profile))
    drawn = F.array_sort(F.transform(pool, lambda x: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), x).cast("binary")).alias("h"), x.alias("p"))))
    return df.withColumn("new_profile", F.coalesce(F.get(drawn, F.lit(0))["p"], F.raise_error(F.concat(F.lit("no replacement candidate for "), F.col(key).cast("string"))).cast("string")))
