"""An inverted index on disk: postings in buckets by term, read again as long as what it was made of is the same.

Postings and what is known of each term lie in two tables in as many buckets by term and sorted by it, so a query reads
the buckets of its terms only, terms meet their postings where they lie, and neither is shuffled. A note names the current
version and what it was made of.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import retrieval as R
from loomspark.sources import versions

#: Documents of a bucket, about, buckets at least and at most, and terms up to which a query names them to the scan.
BUCKET_DOCS, LEAST_BUCKETS, MOST_BUCKETS, MOST_TERMS = 50_000, 8, 8192, 5_000


def _table(spark: SparkSession, path: str, part: str, note: dict, columns: str) -> DataFrame:
    """A part of an index as a bucketed table, which this session may not know yet."""
    place = f"{versions.path_of(path, note)}/{part}"
    name = f"index_{note['version'].replace('-', '_')}_{part}"
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` ({columns}) USING parquet CLUSTERED BY (term) SORTED BY (term) INTO {note['buckets']} BUCKETS LOCATION '{place}'")
    return spark.table(f"`{name}`")


def _rows(spark: SparkSession, path: str, note: dict) -> DataFrame:
    return _table(spark, path, "rows", note, f"term STRING, doc_id {note['id_type']}, len BIGINT, tf BIGINT")


def _written(df: DataFrame, place: str, name: str, buckets: int) -> None:
    df.write.bucketBy(buckets, "term").sortBy("term").option("path", place).saveAsTable(f"`{name}`", format="parquet")


def opened(spark: SparkSession, path: str) -> R.Postings | None:
    """The current index at a path; null where there is none."""
    note = versions.current(spark, path)
    if note is None:
        return None
    rows = _rows(spark, path, note)
    stats = _table(spark, path, "stats", note, "term STRING, df BIGINT, idf DOUBLE, most DOUBLE")
    return R.Postings(rows, stats, note["n_docs"], note["avg_len"])


def build(docs: DataFrame, path: str, made_of: dict, text_col: str = "text", id_col: str = "doc_id", buckets: int | None = None) -> R.Postings:
    """Writes a new version of the index at a path, notes what it was made of, and opens it."""
    spark = docs.sparkSession
    n = docs.count()
    buckets = buckets or min(MOST_BUCKETS, max(LEAST_BUCKETS, n // BUCKET_DOCS))
    note = {"version": f"v_{uuid.uuid4().hex}", "buckets": buckets, "n_docs": n, "id_type": docs.schema[id_col].dataType.simpleString()}
    place = versions.path_of(path, note)
    rows = R.postings(docs, None, text_col, id_col).select("term", F.col("doc_id"), "len", "tf")
    # a bucket is a task's, so that it is one file
    _written(rows.repartition(buckets, "term"), f"{place}/rows", f"index_{note['version']}_rows", buckets)
    rows = _rows(spark, path, note)
    total = rows.agg(F.sum("tf")).first()[0] or 0  # all words are in postings
    note["avg_len"] = total / n if n else 0.0
    _written(R.term_stats(rows, n, note["avg_len"]), f"{place}/stats", f"index_{note['version']}_stats", buckets)
    versions.commit(spark, path, **note, made_of=made_of)
    return opened(spark, path)


def indexed(docs: DataFrame, path: str, made_of: dict, changed: str = "rebuild", **how) -> R.Postings:
    """The index at a path if it was made of the same (facts on input and parameters, such as io.identity or
    io.content_hash); else it is built anew, or, with changed="error", that is an error."""
    note = versions.current(docs.sparkSession, path)
    if note and note["made_of"] == made_of:
        return opened(docs.sparkSession, path)
    if note and changed == "error":
        raise ValueError(f"the index at {path} was made of {note['made_of']}, not of {made_of}")
    return build(docs, path, made_of, **how)


def of_terms(p: R.Postings, terms: DataFrame) -> R.Postings:
    """The index as far as these terms need it: they are named to the scan, which reads their buckets only; so many that
    they can't be are looked up."""
    names = [r.term for r in terms.select("term").distinct().limit(MOST_TERMS + 1).collect()]
    if len(names) <= MOST_TERMS:
        return p._replace(rows=p.rows.where(F.col("term").isin(names)), stats=p.stats.where(F.col("term").isin(names)))
    asked = terms.select("term").distinct()
    return p._replace(rows=p.rows.join(asked, "term", "left_semi"), stats=p.stats.join(asked, "term", "left_semi"))


def top_k(p: R.Postings, queries: DataFrame, k: int, q_id: str = "item_id", q_text: str = "text") -> DataFrame:
    """(q_id, doc_id, score, rank): the k best documents of an index for each query."""
    terms = R.written(R.query_terms(queries, q_id, q_text))
    return R.best_k(of_terms(p, terms), terms, k)
