"""Queries on retrieval, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators import retrieval as R
from loomspark.operators import trajectory as T


def read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def questions(spark, sf_dir):
    """Benchmark texts: the first sentence is the profile, the rest the core."""
    t = F.col("text")
    return read(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("q_id"),
        t.alias("full"),
        F.substring_index(t, ".", 1).alias("profile"),
        F.expr("substring(text, instr(text, '.') + 1)").alias("core"),
    )


def bm25_index_stats(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    n = docs.count()
    df = R.postings(docs).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).withColumn("n_docs", F.lit(n))
    return R.with_idf(df).select("term", "df", "tf", F.round("idf", 6).alias("idf"))


def bm25_topk(spark, sf_dir):
    got = R.bm25_top_k(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), 64)
    return got.select(F.col("q_id").alias("item_id"), "rank", "doc_id", "score")


def dense_topk(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    got = R.dense_top_k(e, e.where("vec_id % 50 = 0"), 8)
    return got.select(F.col("q_id").alias("vec_id"), "rank", F.col("doc_id").alias("neighbor"), "score")


def rerank_cascade(spark, sf_dir):
    got = R.cascade(read(spark, sf_dir, "documents"), questions(spark, sf_dir))
    return got.withColumnRenamed("q_id", "item_id")


def _found(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("document_source"), F.col("lang").alias("population"))
    return rerank_cascade(spark, sf_dir).join(docs, "doc_id")


def trajectory_documents(spark, sf_dir):
    rows = _found(spark, sf_dir)
    docs = F.sort_array(F.collect_list(F.struct("rank", F.col("doc_id").alias("corpus_index"), "score", "document_source")))  # at most k a stage
    nested = rows.groupBy("condition", "item_id", "stage").agg(docs.alias("documents"))
    of = lambda s: F.max(
        F.when(
            F.col("stage") == s,
            F.struct(
                F.lit("text").alias("query_kind"),
                F.lit({"initial": 64, "middle": 8, "final": 1}[s]).alias("requested_k"),
                F.lit(s == "final").alias("reranked"),
                "documents",
            ),
        )
    ).alias(s)
    t = nested.groupBy("condition", "item_id").agg(*[of(s) for s in T.STAGES])
    t = t.select("item_id", F.struct("condition", *T.STAGES).alias("trajectory"))
    flat = T.flatten(t, ["item_id"])
    return flat.select(
        "item_id",
        "condition",
        "stage",
        F.col("requested_k").cast("long").alias("requested_k"),
        F.col("observed_k").cast("long").alias("observed_k"),
        "rank",
        "corpus_index",
        "score",
        "document_source",
    )


def question_source_counts(spark, sf_dir):
    got = T.question_source_counts(_found(spark, sf_dir), ["condition", "item_id", "stage"])
    return got


def population_summary(spark, sf_dir):
    return T.population_summary(_found(spark, sf_dir), ["condition", "population", "stage"], "item_id")


TOK = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"
_BASE = f"""
toks AS (SELECT doc_id, {TOK.format("text")} AS t FROM documents),
lens AS (SELECT doc_id, len(t) AS len FROM toks),
stat AS (SELECT count(*) AS n, avg(len::DOUBLE) AS a FROM lens),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks) GROUP BY ALL),
idf AS (SELECT term, count(*) AS df, sum(tf) AS tf, ln(1 + ((SELECT n FROM stat) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post GROUP BY term)
"""
_SCORES = """
sc AS (SELECT q_id, kind, doc_id, round(sum(qtf * idf * post.tf * 2.5 / greatest(post.tf + 1.5 * (0.25 + 0.75 * len / greatest((SELECT a FROM stat), 1e-6)), 1e-12)), 6) AS score
  FROM qt JOIN post USING (term) JOIN idf USING (term) JOIN lens USING (doc_id) GROUP BY ALL)
"""


def _queries_sql(q: str) -> str:
    return f"q AS ({q}), qt AS (SELECT q_id, kind, term, count(*) AS qtf FROM (SELECT q_id, kind, unnest({TOK.format('txt')}) AS term FROM q) GROUP BY ALL)"


_KINDS = "SELECT item_id AS q_id, unnest(['full', 'core', 'profile']) AS kind, unnest([text, substring(text, instr(text, '.') + 1), split_part(text, '.', 1)]) AS txt FROM benchmark"
_CASCADE = f"""{_BASE}, {_queries_sql(_KINDS)}, {_SCORES},
plan AS (SELECT * FROM (VALUES ('base_rag', 'full', 'full', NULL), ('prof_rag', 'core', 'full', 'profile'), ('q_qp', 'core', 'full', NULL), ('q_q', 'core', 'core', NULL)) p(condition, f1, f2, f3)),
s1 AS (SELECT *, row_number() OVER (PARTITION BY condition, q_id ORDER BY score DESC, doc_id) AS r1 FROM plan JOIN sc ON kind = f1 QUALIFY r1 <= 64),
s2 AS (SELECT s1.condition, s1.q_id, f3, s1.doc_id, coalesce(sc.score, 0.0) AS score, row_number() OVER (PARTITION BY s1.condition, s1.q_id ORDER BY coalesce(sc.score, 0.0) DESC, s1.doc_id) AS r2 FROM s1 LEFT JOIN sc ON sc.q_id = s1.q_id AND sc.kind = f2 AND sc.doc_id = s1.doc_id QUALIFY r2 <= 8),
s3 AS (SELECT s2.condition, s2.q_id, s2.doc_id, CASE WHEN f3 IS NULL THEN s2.score ELSE coalesce(sc.score, 0.0) END AS score2, row_number() OVER (PARTITION BY s2.condition, s2.q_id ORDER BY CASE WHEN f3 IS NULL THEN s2.score ELSE coalesce(sc.score, 0.0) END DESC, s2.doc_id) AS r3 FROM s2 LEFT JOIN sc ON sc.q_id = s2.q_id AND sc.kind = f3 AND sc.doc_id = s2.doc_id QUALIFY r3 <= 1),
cas AS (SELECT condition, q_id AS item_id, 'initial' AS stage, r1 AS rank, doc_id, score FROM s1 UNION ALL SELECT condition, q_id, 'middle', r2, doc_id, score FROM s2 UNION ALL SELECT condition, q_id, 'final', r3, doc_id, score2 FROM s3),
found AS (SELECT cas.*, source AS document_source, lang AS population FROM cas JOIN documents USING (doc_id))
"""

QUERIES = {f.__name__: f for f in (bm25_index_stats, bm25_topk, dense_topk, rerank_cascade, trajectory_documents, question_source_counts, population_summary)}
ORACLES = {
    "bm25_index_stats": f"WITH {_BASE} SELECT term, df, tf::BIGINT AS tf, round(idf, 6) AS idf FROM idf",
    "bm25_topk": f"WITH {_BASE}, {_queries_sql("SELECT item_id AS q_id, 0 AS kind, text AS txt FROM benchmark")}, {_SCORES} SELECT q_id AS item_id, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM sc QUALIFY rank <= 64",
    "dense_topk": "WITH s AS (SELECT q.vec_id, e.vec_id AS neighbor, round(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0) SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbor) AS rank, neighbor, score FROM s QUALIFY rank <= 8",
    "rerank_cascade": f"WITH {_CASCADE} SELECT condition, item_id, stage, rank, doc_id, score FROM cas",
    "trajectory_documents": f"WITH {_CASCADE} SELECT item_id, condition, stage, CASE stage WHEN 'initial' THEN 64 WHEN 'middle' THEN 8 ELSE 1 END::BIGINT AS requested_k, count(*) OVER (PARTITION BY item_id, condition, stage) AS observed_k, rank, doc_id AS corpus_index, score, document_source FROM found",
    "question_source_counts": f"WITH {_CASCADE} SELECT condition, item_id, stage, document_source, count(*) AS count, round_even(100 * count(*) / sum(count(*)) OVER (PARTITION BY condition, item_id, stage), 2)::DOUBLE AS percentage FROM found GROUP BY condition, item_id, stage, document_source",
    "population_summary": f"WITH {_CASCADE} SELECT condition, population, stage, document_source, count(*) AS n_documents, count(DISTINCT item_id) AS n_questions, round_even(100 * count(*) / sum(count(*)) OVER (PARTITION BY condition, population, stage), 2)::DOUBLE AS percentage FROM found GROUP BY condition, population, stage, document_source",
}
