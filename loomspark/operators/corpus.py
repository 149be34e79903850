"""Search planning with provenance, exclusion, document preparation, chunking and exact dedup."""

from __future__ import annotations

import base64
import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions.text import strip, token_windows
from loomspark.operators.lineage import written

#: Text columns by priority, for chunking and for retrieval (fixed values).
CHUNK_TEXT = ("text", "article_abstract", "translated_text", "guidelinetext_processed")
RETRIEVAL_TEXT = ("text", "translated_text", "guidelinetext_processed", "content")


def text_column(df: DataFrame, priority=CHUNK_TEXT) -> str:
    for c in priority:
        if c in df.columns:
            return c
    raise ValueError(f"no text column among {', '.join(priority)}")


def require_columns(df: DataFrame, names) -> DataFrame:
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def normalized_modifiers(c: Column) -> Column:
    """Trimmed, lower-case, not blank, distinct, first seen first."""
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def plan_queries(keywords: DataFrame, modifiers: list[str] | None = None, limit: int = 1500, modified_limit: int = 500) -> DataFrame:
    """(base_keyword, modifier, query, limit): each keyword alone, or with each modifier in front."""
    kw = keywords.select(F.col("keyword").alias("base_keyword"))
    if not modifiers:
        return kw.select("base_keyword", F.lit(None).cast("string").alias("modifier"), F.col("base_keyword").alias("query"), F.lit(limit).alias("limit"))
    some = normalized_modifiers(F.array(*map(F.lit, modifiers)))
    rows = kw.withColumn("modifier", F.explode(some))
    return rows.select("base_keyword", "modifier", F.concat_ws(" ", "modifier", "base_keyword").alias("query"), F.lit(modified_limit).alias("limit"))


def limited(hits: DataFrame, key: str = "query", order: str = "doc_id") -> DataFrame:
    """The first `limit` hits of each query."""
    w = Window.partitionBy(key).orderBy(order)
    return hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= F.col("limit")).drop("_n")


def provenance(hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """For each document the queries, keywords and modifiers that found it, first seen first (hits have query_no)."""
    seen = lambda c: F.array_distinct(F.filter(F.transform(F.col("_all"), lambda x: x[c]), lambda x: x.isNotNull()))
    rows = hits.groupBy(id_col).agg(F.sort_array(F.collect_set(F.struct("query_no", "query", "base_keyword", "modifier"))).alias("_all"))  # at most one a query
    return rows.select(id_col, seen("query").alias("matched_queries"), seen("base_keyword").alias("matched_keywords"), seen("modifier").alias("matched_modifiers"))


def split_excluded(df: DataFrame, excluded: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(retained, excluded)."""
    ids = excluded.select(key).distinct()
    return df.join(ids, key, "left_anti"), df.join(ids, key, "left_semi")


def prepare_documents(df: DataFrame, source: str | Column, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows with text that is not blank, stripped, their source, and their place in the source as loaded."""
    src = F.lit(source) if isinstance(source, str) else source
    rows = df.withColumns({"source": src, "source_index": F.col(id_col).cast("string"), text: strip(F.col(text).cast("string"))})
    return rows.where(F.col(text) != "")


def dropped(df: DataFrame, text: str = "text") -> Column:
    """How many rows of a group prepare_documents leaves out."""
    return F.count_if(F.coalesce(strip(F.col(text)), F.lit("")) == "")


def with_position(df: DataFrame, order: str, name: str = "position", blocks: int | None = None) -> DataFrame:
    """df with a dense position from 0 by `order`: places inside ranges, and counts of the ranges before.

    There are as many ranges as shuffle partitions, of which Spark joins small ones. They come from a sample, so they are
    written once: worked out twice, they could differ.
    """
    ranges = df.repartitionByRange(order) if blocks is None else df.repartitionByRange(blocks, order)
    rows = written(ranges.withColumn("_p", F.spark_partition_id()))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(order)))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    start = rows.groupBy("_p").agg(F.count("*").alias("_c")).withColumn("_s", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    return rows.join(F.broadcast(start), "_p").withColumn(name, (F.col("_s") + F.col("_n") - 1).cast("long")).drop("_p", "_n", "_s")


def exact_dedup(docs: DataFrame, order: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row for each text: the first, with all sources in order of first sight."""
    key = F.sha2(F.col(text), 256).alias("text_key")
    rows = docs.select(key, F.col(order).alias("doc_id"), F.col(source).alias("source"))
    first = rows.groupBy("text_key", "source").agg(F.min("doc_id").alias("o"), F.count("*").alias("n"))
    out = first.groupBy("text_key").agg(F.min("o").alias("doc_id"), F.sum("n").alias("n_copies"), F.sort_array(F.collect_list(F.struct("o", "source"))).alias("s"))
    return out.select("doc_id", "text_key", "n_copies", F.transform("s", lambda x: x["source"]).alias("source_membership"))


def chunk(docs: DataFrame, size: int = 384, overlap: int = 64, text: str = "text") -> DataFrame:
    """A row for each window; blank windows go before they are numbered."""
    w = F.filter(token_windows(F.col(text), size, overlap), lambda x: F.trim(x["text"]) != "")
    rows = docs.withColumn("_w", w).withColumn("document_token_count", F.coalesce(F.try_element_at("_w", F.lit(-1))["token_end"], F.lit(0)))
    keep = [c for c in docs.columns if c != text]
    rows = rows.select(*keep, "document_token_count", F.posexplode_outer("_w").alias("chunk_id", "_c")).where("chunk_id is not null")
    return rows.select(
        *keep,
        "chunk_id",
        "_c.token_start",
        "_c.token_end",
        (F.col("_c.token_end") - F.col("_c.token_start")).alias("token_count"),
        "document_token_count",
        F.col("_c.text").alias(text),
    )


def chunk_membership(chunks: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """(text_key, source_membership): the sorted sources that hold an equal chunk."""
    pairs = chunks.select(F.sha2(F.col(text), 256).alias("text_key"), F.col(source).alias("source")).distinct()
    return pairs.groupBy("text_key").agg(F.sort_array(F.collect_set("source")).alias("source_membership"))


def tagged(frames: list[tuple[str, DataFrame]], order: str, text: str | None = None) -> DataFrame:
    """Sources as one table of all their columns: prepared documents with source and source_no; each source's text is in its
    own column, by name or as it is found, and in column text here."""
    out = None
    for n, (name, df) in enumerate(frames):
        c = text or text_column(df)
        rows = df if c == "text" else df.drop("text").withColumnRenamed(c, "text")
        part = prepare_documents(rows, name, "text", order).withColumn("source_no", F.lit(n))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def with_membership(docs: DataFrame, order: list[str], text: str = "text", source: str = "source") -> DataFrame:
    """The first row of each text by `order`, with all its sources in order of first sight (source_membership)."""
    place = F.struct(*order)
    seen = docs.select(F.sha2(F.col(text), 256).alias("_key"), place.alias("_at"), F.col(source).alias("_source"))
    by_source = seen.groupBy("_key", "_source").agg(F.min("_at").alias("_at"))
    first = by_source.groupBy("_key").agg(F.min("_at").alias("_at"), F.sort_array(F.collect_list(F.struct("_at", "_source"))).alias("_m"))  # a source each
    first = first.select("_at", F.transform("_m", lambda x: x["_source"]).alias("source_membership"))
    return docs.drop("source_membership").withColumn("_at", place).join(first, "_at").drop("_at")


def combined_chunks(docs: DataFrame, order: list[str], cut=chunk, keep_duplicates: bool = False) -> DataFrame:
    """The chunks of all sources together, of each text once (unless duplicates are kept), with the sorted sources that have
    an equal chunk in source_membership; docs are prepared documents with text and source. cut(docs) gives chunks."""
    once = docs if keep_duplicates else with_membership(docs, order)
    members = chunk_membership(cut(docs.select("source", "text")))
    chunks = cut(once.drop("source_membership")).withColumn("text_key", F.sha2("text", 256))
    return chunks.join(members, "text_key", "left").drop("text_key")


@functools.cache
def _ranked(file: str):
    """A byte-level BPE vocabulary's rank file as an encoding, one for each worker process."""
    import public_tokenizers
    import tiktoken

    with open(file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(file, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def chunk_by_tokenizer(docs: DataFrame, file: str, size: int = 384, overlap: int = 64, text: str = "text", ranks: str | None = None) -> DataFrame:
    """A row for each window of a tokenizer's ids (a JSON file that executors can read), decoded and stripped; a text of one
    window stays as it is; blank windows go before they are numbered. Nothing is shuffled.

    ranks is a rank file of the same vocabulary, if there is one: it gives the same ids sooner. Texts that hold an added token
    are left to the tokenizer.
    """
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size")
    kept = [f for f in docs.schema.fields if f.name != text]
    numbers = ("chunk_id", "token_start", "token_end", "token_count", "document_token_count")
    schema = StructType([*kept, *(StructField(n, IntegerType()) for n in numbers), StructField(text, StringType())])

    def windows(tok, added, t):
        if ranks and not any(a in (t or "") for a in added):
            ids = _ranked(ranks).encode_ordinary(t or "")
        else:
            ids = tok.encode(t or "", add_special_tokens=False).ids
        if len(ids) <= size:
            return [(0, len(ids), t)] * bool(ids), len(ids)
        starts = range(0, len(ids) - overlap, size - overlap)
        cut = [(a, min(a + size, len(ids))) for a in starts]
        return [(a, b, tok.decode(ids[a:b]).strip()) for a, b in cut], len(ids)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        from tokenizers import Tokenizer

        tok, arrow = Tokenizer.from_file(file), to_arrow_schema(schema)
        added = [a.content for a in tok.get_added_tokens_decoder().values()]
        for b in batches:
            of, rows = [], []
            for i, t in enumerate(b.column(b.schema.get_field_index(text)).to_pylist()):
                got, total = windows(tok, added, t)
                for n, (start, end, part) in enumerate(x for x in got if x[2]):
                    of.append(i)
                    rows.append((n, start, end, end - start, total, part))
            carried = b.select([f.name for f in kept]).take(pa.array(of, pa.int64()))
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int32()] * 5 + [pa.string()])]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*carried.columns, *made], arrow, strict=True)], schema=arrow)

    return docs.mapInArrow(run, schema)
