"""The thin queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.llm import collocations, fingerprints, infilling, licenses, lm, mixing, neardup, packing, passages, pii, quality, sharding, urls
from loomspark.llm.common import read


def surrogate_key(spark) -> str:
    """The secret of surrogates, from the session; where none is set (tests, checks), a public one that protects nothing."""
    return spark.conf.get("spark.loomspark.surrogateKey", "public key for tests")


def op1_chained_passages(spark, sf_dir):
    return passages.passages(read(spark, sf_dir))


def op2_license_scan(spark, sf_dir):
    return licenses.scan_documents(read(spark, sf_dir))


def op3_context_mixing(spark, sf_dir):
    return lm.score(read(spark, sf_dir))


def op4_surrogates(spark, sf_dir):
    return pii.replace(read(spark, sf_dir), surrogate_key(spark), count_col="n_entities").select("doc_id", "text", "n_entities")


def op5_temperature_mixing(spark, sf_dir):
    mixed = mixing.mix(read(spark, sf_dir), only_ids=True)
    return mixed.select(
        "doc_id",
        F.col("_source").alias("source"),
        F.col("_tokens").alias("n_tokens"),
        F.col("_weight").alias("weight"),
        F.col("_block").alias("block"),
        F.col("_order").alias("sort_key"),
    )


def op6_minhash_near_dedup(spark, sf_dir):
    return neardup.near_duplicates(read(spark, sf_dir))


def op7_winnowing(spark, sf_dir):
    return fingerprints.edited_likeness(read(spark, sf_dir))


def op8_min_cost_resharding(spark, sf_dir):
    placed = sharding.assign(read(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "old_shard", "moved")


def op9_hierarchical_packing(spark, sf_dir):
    return packing.pack(read(spark, sf_dir))


def op10_tokeniser_fertility(spark, sf_dir):
    return quality.measure(read(spark, sf_dir))


def op11_event_infilling(spark, sf_dir):
    return infilling.digests(infilling.fill_in_middle(read(spark, sf_dir)))


def op12_automaton_collocations(spark, sf_dir):
    return collocations.collocations(read(spark, sf_dir))


def op13_redirect_equivalence(spark, sf_dir):
    return urls.judge(read(spark, sf_dir, "pages"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f for f in (
        op1_chained_passages,
        op2_license_scan,
        op3_context_mixing,
        op4_surrogates,
        op5_temperature_mixing,
        op6_minhash_near_dedup,
        op7_winnowing,
        op8_min_cost_resharding,
        op9_hierarchical_packing,
        op10_tokeniser_fertility,
        op11_event_infilling,
        op12_automaton_collocations,
        op13_redirect_equivalence,
        pipeline,
    )
}
ORACLES: dict[str, str] = {
    "op11_event_infilling": infilling.ORACLE,
    "op12_automaton_collocations": collocations.ORACLE,
    "op13_redirect_equivalence": urls.ORACLE,
}
