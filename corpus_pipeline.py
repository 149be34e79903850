"""The corpus pipeline: quality rules, near-dedup, surrogates, mixing, packing, each stage over all its predecessor kept."""

from __future__ import annotations

from loomspark.llm import mixing, neardup, packing, pii, quality, queries


def quality_rules(spark, docs, sf_dir):
    """Documents that the fertility rules reject go; those without text fail the base rule. Empty tables stay empty."""
    return quality.keep(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near duplicates stays, that of the least id; texts without words are in no group and
    stay, as do all rows of an id that stays and rows without an id."""
    return neardup.keep_one(docs)


def surrogates(spark, docs, sf_dir):
    """Personal data are replaced in the texts; n_chars follows. Null texts stay null, with a null n_chars."""
    from pyspark.sql import functions as F

    return pii.replace(docs, queries.surrogate_key(spark)).withColumn("n_chars", F.char_length("text").cast("long"))


def mix_sources(spark, docs, sf_dir):
    """Rows are repeated or left out so that sources meet their target weights; null sources are one source."""
    return mixing.mix(docs).select(*docs.columns)


def pack(spark, docs, sf_dir):
    """Pieces of token sequences; a null text is its end alone."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("near dedup", near_dedup), ("surrogates", surrogates), ("mixing", mix_sources), ("packing", pack)]
#: No stage but the last ones could be SQL: tokenisers, MinHash and packing have none.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages, one after the other, applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
