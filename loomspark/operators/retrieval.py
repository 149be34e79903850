"""BM25 and dense retrieval, top-k and the rerank cascade, all questions in one plan."""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions.text import bm25_tokens
from loomspark.operators.lineage import BROADCAST_ROWS, small, written

K1, B = 1.5, 0.75
#: Postings of all queries together that are added up without looking for bounds first.
DIRECT_ROWS = 100_000_000
#: Texts whose words are held counted at a time; queries and rows of a product that a task holds at a time.
COUNTED, TILE_QUERIES, TILE_ROWS = 256, 256, 4096
#: First, middle and final query of each condition (fixed values).
CONDITIONS = {"base_rag": ("full", "full", None), "prof_rag": ("core", "full", "profile"), "q_qp": ("core", "full", None), "q_q": ("core", "core", None)}


def query_terms(queries: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(id, more..., term, qtf)."""
    t = queries.select(F.col(id_col).alias("q_id"), *more, F.explode(bm25_tokens(F.col(text_col))).alias("term"))
    return t.groupBy("q_id", *more, "term").agg(F.count("*").alias("qtf"))


def postings(docs: DataFrame, terms: DataFrame | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, len, term, tf); only of the given terms, if any, which are looked up where a text is read."""
    return _counted(docs, terms, text_col, id_col).where("term is not null")


def _counted(docs: DataFrame, terms: DataFrame | None, text_col: str, id_col: str) -> DataFrame:
    """postings, and a row without a term for some documents each: len their words, tf their number.

    A text's words are counted by the task that reads it, so they are not shuffled; only rows that repeat an id are added up
    afterwards.
    """
    ids = docs.select(F.col(id_col).alias("doc_id"))
    kind, spark = ids.schema["doc_id"].dataType.simpleString(), docs.sparkSession
    n, n_ids, n_null = ids.agg(F.count("*"), F.count_distinct("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    names = None if terms is None else [r.term for r in terms.select("term").distinct().limit(BROADCAST_ROWS + 1).collect()]
    asked = None if names is None or len(names) > BROADCAST_ROWS else spark.sparkContext.broadcast(frozenset(names))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.coalesce(text_col, F.lit(""))).alias("text"))
    rows = texts.mapInArrow(lambda batches: _word_counts(batches, asked.value if asked else None), f"doc_id {kind}, len long, term string, tf long")
    if names is not None and asked is None:
        rows = rows.where("term is null").unionByName(rows.join(terms.select("term").distinct(), "term", "left_semi").select(*rows.columns))
    if n_ids < n - n_null or n_null > 1:
        rows = rows.groupBy("doc_id", "len", "term").agg(F.sum("tf").alias("tf"), F.count("*").alias("n")).select("doc_id", F.when(F.col("term").isNull(), F.col("len") * F.col("n")).otherwise(F.col("len")).alias("len"), "term", "tf")
    return rows


def _word_counts(batches, asked: frozenset | None):
    """_counted's rows of Arrow batches (doc_id, text), whose texts are lower-case."""
    import pyarrow as pa

    found = re.compile("[a-z0-9]+").findall
    for whole in batches:
        for b in (whole.slice(i, COUNTED) for i in range(0, whole.num_rows, COUNTED)):
            of, lens, words, times, total = [], [], [], [], 0
            for i, t in enumerate(b.column(1).to_pylist()):
                tokens = found(t)
                total += len(tokens)
                got = Counter(tokens)
                some = got.keys() if asked is None else got.keys() & asked
                of += [i] * len(some)
                lens += [len(tokens)] * len(some)
                words += some
                times += [got[w] for w in some]
            ids = b.column(0).take(pa.array([*of, None], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([*lens, total], pa.int64()), pa.array([*words, None], pa.string()), pa.array([*times, b.num_rows], pa.int64())], names=["doc_id", "len", "term", "tf"])


def collection(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: n_docs, avg_len."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.size(bm25_tokens(F.col(text_col))).cast("double")).alias("avg_len"))


def with_idf(df: DataFrame) -> DataFrame:
    return df.withColumn("idf", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def weight(avg: float) -> Column:
    """What a posting adds to a score, without qtf and idf."""
    return F.col("tf") * (K1 + 1) / F.greatest(F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(max(avg, 1e-6))), F.lit(1e-12))


class Postings(NamedTuple):
    """An inverted index: rows (term, doc_id, len, tf), stats (term, df, idf, most: the greatest weight of its rows)."""

    rows: DataFrame
    stats: DataFrame
    n_docs: int
    avg_len: float


def term_stats(rows: DataFrame, n_docs: int, avg_len: float) -> DataFrame:
    counted = rows.groupBy("term").agg(F.count("*").alias("df"), F.max(weight(avg_len)).alias("most")).withColumn("n_docs", F.lit(n_docs))
    return with_idf(counted).select("term", "df", "idf", "most")


def gathered(docs: DataFrame, terms: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> Postings:
    """Postings of these terms only, read from the texts once and written."""
    counted = written(_counted(docs, terms, text_col, id_col))
    n, words = counted.where("term is null").agg(F.coalesce(F.sum("tf"), F.lit(0)), F.coalesce(F.sum("len"), F.lit(0))).first()  # one row
    rows, avg = counted.where("term is not null"), words / n if n else 0.0
    return Postings(rows, written(term_stats(rows, n, avg)), n, avg)


def _added(rows: DataFrame, terms: DataFrame, avg: float, *keys: str) -> DataFrame:
    """(keys..., doc_id, part) of the postings of terms; a frequent term's postings stay where they are, terms go to them."""
    joined = rows.join(small(terms.select(*keys, "term", "qtf", "idf")), "term")
    return joined.groupBy(*keys, "doc_id").agg(F.sum(F.col("qtf") * F.col("idf") * weight(avg)).alias("part"))


def bm25_scores(docs: DataFrame, terms: DataFrame, *more: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(q_id, more..., doc_id, score) of all documents that hold a query's term."""
    terms = written(terms)
    p = gathered(docs, terms, text_col, id_col)
    return _added(p.rows, terms.join(p.stats, "term"), p.avg_len, "q_id", *more).withColumn("score", F.round("part", 6)).drop("part")


def top_k(scores: DataFrame, k: int, *keys: str, id_col: str = "doc_id") -> DataFrame:
    """The k best of each key with 1-based rank; ties by least id."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), id_col)
    return scores.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def best_k(p: Postings, terms: DataFrame, k: int, *more: str, direct: int = DIRECT_ROWS) -> DataFrame:
    """(q_id, more..., doc_id, score, rank): the k best documents of each query, the same as of all scores.

    Up to `direct` postings of all queries together they are simply added up. Beyond, terms with large upper bounds are read
    first, and the best of what they bring is scored in full: the k-th best score is that at least. The terms with the
    least bounds, as long as together they can't reach it, bring no document of their own: they are read only for documents
    that may still come in by what the others gave them.
    """
    keys = ["q_id", *more]
    t = terms.join(p.stats, "term")
    if (t.agg(F.sum("df")).first()[0] or 0) <= direct:
        return top_k(_added(p.rows, t, p.avg_len, *keys).withColumn("score", F.round("part", 6)).drop("part"), k, *keys)
    order = Window.partitionBy(*keys).orderBy(F.desc("ub"), "term")
    t = t.withColumn("ub", F.col("qtf") * F.col("idf") * F.col("most"))
    # what this term and all behind it can give, and what those before it can
    t = t.withColumn("rest", F.sum("ub").over(order.rowsBetween(0, Window.unboundedFollowing))).withColumn("before", F.sum("ub").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("ub"))
    t = written(t.withColumn("first", F.col("before") < F.col("rest")).select(*keys, "term", "qtf", "idf", "ub", "rest", "first"))
    part = written(_added(p.rows, t.where("first"), p.avg_len, *keys))
    ahead = written(top_k(part.withColumnRenamed("part", "score"), k, *keys).select(*keys, "doc_id"))
    full = top_k(rescored(p, t, ahead, *more).withColumnRenamed("part", "score"), k, *keys)
    least = full.where(F.col("rank") == k).select(*keys, F.col("score").alias("least"))
    t = written(t.join(small(written(least)), keys, "left").withColumn("least", F.coalesce("least", F.lit(0.0))))
    # rounding to six places moves a score by half of a millionth at most
    needed = F.col("first") | (F.col("rest") >= F.col("least") - 2e-6)
    part = written(part.unionByName(_added(p.rows, t.where(needed & ~F.col("first")), p.avg_len, *keys)).groupBy(*keys, "doc_id").agg(F.sum("part").alias("part")))
    gain = t.groupBy(*keys).agg(F.max("least").alias("least"), F.sum(F.when(~needed, F.col("ub")).otherwise(0.0)).alias("gain"))
    may = written(part.join(small(gain), keys).where(F.col("part") + F.col("gain") >= F.col("least") - 2e-6).select(*keys, "doc_id", "part"))
    may = may.unionByName(rescored(p, t.where(~needed), may.select(*keys, "doc_id"), *more)).groupBy(*keys, "doc_id").agg(F.sum("part").alias("part"))
    return top_k(may.withColumn("score", F.round("part", 6)).drop("part"), k, *keys)


def rescored(p: Postings, terms: DataFrame, candidates: DataFrame, *more: str) -> DataFrame:
    """(q_id, more..., doc_id, part): what these terms give to candidates (q_id, more..., doc_id); those without any have no row."""
    keys = ["q_id", *more]
    rows = p.rows.join(small(terms.select("term").distinct()), "term", "left_semi").join(small(candidates.select("doc_id").distinct()), "doc_id", "left_semi")
    both = rows.join(small(candidates.select(*keys, "doc_id")), "doc_id").join(small(terms.select(*keys, "term", "qtf", "idf")), [*keys, "term"])
    return both.groupBy(*keys, "doc_id").agg(F.sum(F.col("qtf") * F.col("idf") * weight(p.avg_len)).alias("part"))


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int, q_id: str = "item_id", q_text: str = "text") -> DataFrame:
    terms = written(query_terms(queries, q_id, q_text))
    return best_k(gathered(docs, terms), terms, k)


def dense_top_k(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 4096) -> DataFrame:
    """The k best dot products of a stated query set against all rows, in double precision.

    Queries go out in blocks of bounded size, as a matrix; a task multiplies it with the rows of its Arrow batches and keeps
    k of each query at most, of which the k best of all tasks are taken. Null vectors, and queries without one, have no rows.
    """
    q = queries.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("q_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    parts = max(1, -(-q.count() // block))
    rows = corpus.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    id_type, q_type, out = rows.schema["doc_id"].dataType.simpleString(), q.schema["q_id"].dataType.simpleString(), None
    for i in range(parts):
        some = q if parts == 1 else q.where(F.pmod(F.xxhash64("q_id"), F.lit(parts)) == i)
        got = some.collect()  # a block
        if not got:
            continue
        held = corpus.sparkSession.sparkContext.broadcast(([r.q_id for r in got], np.array([r.vec for r in got], np.float64)))
        best = rows.mapInArrow(lambda batches, held=held: _best_products(batches, *held.value, k), f"q_id {q_type}, doc_id {id_type}, score double")
        best = top_k(best.withColumn("score", F.round("score", 6)), k, "q_id")
        out = best if out is None else out.unionByName(best)
    return out if out is not None else corpus.sparkSession.createDataFrame([], f"q_id {q_type}, doc_id {id_type}, score double, rank long")


def _best_products(batches, q_ids: list, matrix: np.ndarray, k: int):
    """Of a task's rows, the k best of each query: by score to six places, then by least id. Products are made and thinned out
    in tiles, so that what a task holds depends neither on the queries of a block nor on the rows of a batch."""
    import pyarrow as pa

    held: dict = {}  # (ids, scores) of a tile's queries, k each at most, the best first
    for b in batches:
        ids, vectors = b.column(0), b.column(1)
        if not b.num_rows:
            continue
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        if len(flat) != b.num_rows * matrix.shape[1] or np.any(np.diff(vectors.offsets.to_numpy()) != matrix.shape[1]):
            raise ValueError(f"a vector has not {matrix.shape[1]} components")
        flat, at = flat.reshape(b.num_rows, -1), ids.to_numpy(zero_copy_only=False)
        for r in range(0, b.num_rows, TILE_ROWS):
            for i in range(0, len(q_ids), TILE_QUERIES):
                held[i] = _best(held.get(i), at[r : r + TILE_ROWS], matrix[i : i + TILE_QUERIES] @ flat[r : r + TILE_ROWS].T, k)
    for i, (names, scores) in held.items():
        n = names.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array([q for q in q_ids[i : i + TILE_QUERIES] for _ in range(n)]), pa.array(names.reshape(-1)), pa.array(scores.reshape(-1))], names=["q_id", "doc_id", "score"])


def _best(held, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores): the k best of each query (a row) among those held and new ones, the best first."""
    names = np.broadcast_to(ids, scores.shape)
    if held is not None:
        names, scores = np.concatenate([held[0], names], 1), np.concatenate([held[1], scores], 1)
    if scores.shape[1] > 4 * k:
        # what is below the k-th score can't be among the k; of what is left ties are told by id
        shown = np.round(scores, 6)
        least = np.partition(shown, shown.shape[1] - k, axis=1)[:, shown.shape[1] - k, None]
        width = int((shown >= least).sum(1).max())
        order = np.argsort(-shown, axis=1, kind="stable")[:, :width] if width > k else np.argpartition(-shown, k - 1, axis=1)[:, :k]
        names, scores = np.take_along_axis(names, order, 1), np.take_along_axis(scores, order, 1)
    order = np.lexsort((names, -np.round(scores, 6)), axis=1)[:, :k]
    return np.take_along_axis(names, order, 1), np.take_along_axis(scores, order, 1)


def cascade(docs: DataFrame, questions: DataFrame, k: tuple[int, int, int] = (64, 8, 1), index: Postings | None = None, conditions: dict | None = None) -> DataFrame:
    """(condition, q_id, stage, rank, doc_id, score) for all conditions (or those given, as in CONDITIONS); questions has
    q_id, full, core, profile.

    Only the first stage looks at the whole corpus (or its index); later ones score the candidates that the stage before
    left, for each query text once.
    """
    kinds = ("full", "core", "profile")
    long = questions.select("q_id", F.explode(F.array(*[F.struct(F.lit(x).alias("kind"), F.col(x).alias("text")) for x in kinds])).alias("e")).select("q_id", "e.kind", "e.text")
    terms = written(query_terms(long, "q_id", "text", "kind"))
    p = index or gathered(docs, terms)
    conditions = CONDITIONS if conditions is None else conditions
    plan = [(c, *s) for c, s in conditions.items()]
    plan = F.broadcast(questions.sparkSession.createDataFrame(plan, "condition string, kind string, middle string, final string"))
    firsts = sorted({s[0] for s in conditions.values()})
    found = written(best_k(p, terms.where(F.col("kind").isin(firsts)), k[0], "kind"))
    first = found.join(plan, "kind").select("condition", "q_id", F.col("kind").alias("had"), "middle", "final", "doc_id", "score", "rank")

    def again(before, kind, most):
        """Candidates by the query of a kind; where it is null or the same as before, they keep their scores."""
        same = F.col(kind).isNull() | F.col(kind).eqNullSafe(F.col("had"))
        asked = written(before.where(~same).select("q_id", F.col(kind).alias("kind"), "doc_id").distinct())
        some = terms.join(small(asked.select("q_id", "kind").distinct()), ["q_id", "kind"], "left_semi").join(p.stats, "term")
        new = rescored(p, some, asked, "kind").select("q_id", F.col("kind").alias(kind), "doc_id", F.round("part", 6).alias("new"))
        got = before.join(new, ["q_id", kind, "doc_id"], "left")
        score = F.when(same, F.col("score")).otherwise(F.coalesce("new", F.lit(0.0)))
        got = got.withColumn("score", score).withColumn("had", F.coalesce(kind, "had")).drop("new", "rank")
        return written(top_k(got, most, "condition", "q_id"))

    middle = again(first, "middle", k[1])
    final = again(middle, "final", k[2])
    pick = lambda df, stage: df.select("condition", "q_id", F.lit(stage).alias("stage"), "rank", "doc_id", "score")
    return pick(first, "initial").unionByName(pick(middle, "middle")).unionByName(pick(final, "final"))
