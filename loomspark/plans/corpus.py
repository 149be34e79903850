"""Queries on the corpus: planning, cleaning, chunks, dedup, membership; and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import text as X
from loomspark.operators import corpus as C
from loomspark.operators import qa_build as Q
from loomspark.operators import trajectory as T
from loomspark.plans.retrieval import read

KEYWORDS, MODIFIERS = ("with", "the", "que", "und"), (" Adult ", "pediatric", "adult")


def _keywords(spark):
    return spark.createDataFrame([(k,) for k in KEYWORDS], "keyword string")


def search_plan(spark, sf_dir):
    kw = read(spark, sf_dir, "part").select(F.lower(F.split(F.trim("p_name"), " ")[0]).alias("keyword")).distinct()
    return C.plan_queries(kw, list(MODIFIERS)).withColumn("limit", F.col("limit").cast("long"))


def search_provenance(spark, sf_dir):
    """Keyword hits: a document is found by a keyword that is one of its words."""
    plan = C.plan_queries(_keywords(spark), limit=1500).withColumn("query_no", F.expr(f"array_position(array({', '.join(repr(k) for k in KEYWORDS)}), query)"))
    words = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_intersect(F.array_distinct(X.bm25_tokens(F.col("text"))), F.array(*map(F.lit, KEYWORDS)))).alias("query"))
    hits = C.limited(words.join(F.broadcast(plan), "query"))
    return C.provenance(hits).select(
        "doc_id",
        F.array_join("matched_queries", ",").alias("matched_queries"),
        F.array_join("matched_keywords", ",").alias("matched_keywords"),
        F.size("matched_modifiers").cast("long").alias("n_modifiers"),
    )


def exclude_gold(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    kept, gone = C.split_excluded(docs, read(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")
    return kept.withColumn("status", F.lit("retained")).unionByName(gone.withColumn("status", F.lit("excluded")))


def chunk_documents(spark, sf_dir):
    docs = C.prepare_documents(read(spark, sf_dir, "documents"), F.col("source"))
    c = C.chunk(docs.select("doc_id", "source", "text"))
    return c.select(
        "doc_id",
        "source",
        *[F.col(x).cast("long").alias(x) for x in ("chunk_id", "token_start", "token_end", "token_count", "document_token_count")],
        F.md5(F.col("text").cast("binary")).alias("text_md5"),
    )


def dedup_membership(spark, sf_dir):
    got = C.exact_dedup(read(spark, sf_dir, "documents"))
    return got.select("doc_id", "text_key", "n_copies", F.array_join("source_membership", ",").alias("source_membership"))


def chunk_membership(spark, sf_dir):
    c = C.chunk(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    got = C.chunk_membership(c)
    return got.select("text_key", F.array_join("source_membership", ",").alias("source_membership"), T.source_category(F.col("source_membership")).alias("category"))


def corpus_report(spark, sf_dir):
    """Rows, dropped rows, chunks, and chunks that another source has too, of each source."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = d.groupBy("source").agg(F.count("*").alias("n_rows"), C.dropped(d).alias("n_dropped"))
    c = C.chunk(C.prepare_documents(d, F.col("source"))).select("source", F.sha2(F.col("text"), 256).alias("text_key"))
    shared = C.chunk_membership(c.withColumnRenamed("text_key", "text")).where(F.size("source_membership") > 1).select("text_key")
    c = c.withColumn("text_key", F.sha2("text_key", 256)).join(shared.withColumn("s", F.lit(1)), "text_key", "left")
    return rows.join(c.groupBy("source").agg(F.count("*").alias("n_chunks"), F.count("s").alias("n_shared")), "source", "left").na.fill(0)


def source_lookup(spark, sf_dir):
    got = T.source_lookup(read(spark, sf_dir, "documents"))
    return got.select("text_hash", F.array_join("source_membership", ",").alias("source_membership"))


def html_clean(spark, sf_dir):
    t = read(spark, sf_dir, "pages").select("page_id", X.clean_html(F.col("html")).alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("text_md5"))


def page_split(spark, sf_dir):
    """Paragraphs stand for headers."""
    html = F.replace(F.replace("html", F.lit("<p>"), F.lit("<header>")), F.lit("</p>"), F.lit("</header>"))
    got = read(spark, sf_dir, "pages").select("page_id", X.split_pages(html).alias("s"))
    # an outer explode asks for no filter that would split once more; a document always has a page
    rows = got.select("page_id", F.col("s.n").alias("n_headers"), F.posexplode_outer("s.pages").alias("page", "content"))
    return rows.select("page_id", "n_headers", (F.col("page") + 1).cast("long").alias("page"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


def request_batches(spark, sf_dir):
    docs = Q.batches(read(spark, sf_dir, "documents").where(F.length("text") >= 100).select("doc_id"), "doc_id", 500, blocks=16)
    return docs.select("doc_id", "batch", "batch_row")


def stable_tag(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", X.stable_tag(F.col("url")).alias("tag"))


def join_key(spark, sf_dir):
    v = F.concat(F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(""), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ".0").otherwise(""))
    return read(spark, sf_dir, "orders").select("o_orderkey", X.join_key(v).alias("join_key"))


_W = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
def _chunks(docs: str) -> str:
    return rf"""
w AS (SELECT doc_id, source, text, {_W} AS t FROM {docs}),
i AS (SELECT *, len(t) AS n, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) <= 384 THEN [0] ELSE generate_series(0, ceil((len(t) - 384) / 320)::BIGINT) END) AS c FROM w),
ch AS (SELECT doc_id, source, c AS chunk_id, c * 320 AS token_start, least(c * 320 + 384, n) AS token_end, least(c * 320 + 384, n) - c * 320 AS token_count, n AS document_token_count,
  CASE WHEN n <= 384 THEN text ELSE array_to_string(t[c * 320 + 1 : c * 320 + 384], ' ') END AS txt FROM i)
"""


_CHUNKS = _chunks("documents")
_STRIP = r"regexp_replace(regexp_replace({}, '^[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]+', ''), '[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]+$', '')"
_CLEAN = "html"
for _tag in ("script", "style"):
    _CLEAN = f"regexp_replace({_CLEAN}, '(?is)<{_tag}[^>]*>.*?</{_tag}\\s*>', ' ', 'g')"
_CLEAN = f"regexp_replace({_CLEAN}, '(?s)<[^>]*>', ' ', 'g')"
# the character references that the pages hold; the ampersand last
for _a, _b in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
    _CLEAN = f"replace({_CLEAN}, '{_a}', '{_b}')"
_CLEAN = f"trim(regexp_replace({_CLEAN}, '\\s+', ' ', 'g'), ' ')"

_STRIPPED = _chunks(f"(SELECT doc_id, source, {_STRIP.format('text')} AS text FROM documents)")
QUERIES = {
    f.__name__: f for f in (
        search_plan,
        search_provenance,
        exclude_gold,
        chunk_documents,
        dedup_membership,
        chunk_membership,
        corpus_report,
        source_lookup,
        html_clean,
        page_split,
        request_batches,
        stable_tag,
        join_key,
    )
}
ORACLES = {
    "search_plan": "SELECT k AS base_keyword, m AS modifier, m || ' ' || k AS query, 500::BIGINT AS \"limit\" FROM (SELECT DISTINCT lower(split_part(trim(p_name), ' ', 1)) AS k FROM part), (SELECT unnest(['adult', 'pediatric']) AS m)",
    "search_provenance": f"WITH h AS (SELECT doc_id, q, list_position({list(KEYWORDS)!r}, q) AS no FROM (SELECT doc_id, unnest(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), {list(KEYWORDS)!r})) AS q FROM documents) QUALIFY row_number() OVER (PARTITION BY q ORDER BY doc_id) <= 1500) SELECT doc_id, string_agg(q, ',' ORDER BY no) AS matched_queries, string_agg(q, ',' ORDER BY no) AS matched_keywords, 0::BIGINT AS n_modifiers FROM h GROUP BY doc_id",
    "exclude_gold": "SELECT doc_id, source, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'excluded' ELSE 'retained' END AS status FROM documents",
    "chunk_documents": f"WITH {_STRIPPED} SELECT doc_id, source, chunk_id, token_start, token_end, token_count, document_token_count, md5(txt) AS text_md5 FROM ch",
    "dedup_membership": "WITH f AS (SELECT text, source, min(doc_id) AS o, count(*) AS n FROM documents GROUP BY ALL) SELECT min(o) AS doc_id, sha256(text) AS text_key, sum(n)::BIGINT AS n_copies, string_agg(source, ',' ORDER BY o, source) AS source_membership FROM f GROUP BY text",
    "chunk_membership": f"WITH {_CHUNKS}, p AS (SELECT DISTINCT txt, source FROM ch) SELECT sha256(txt) AS text_key, string_agg(source, ',' ORDER BY source) AS source_membership, CASE WHEN count(*) > 1 THEN 'both' ELSE min(source) END AS category FROM p GROUP BY txt",
    "corpus_report": f"WITH {_STRIPPED}, m AS (SELECT txt FROM ch GROUP BY txt HAVING count(DISTINCT source) > 1), g AS (SELECT source, count(*) AS n_chunks, count(*) FILTER (WHERE txt IN (SELECT txt FROM m)) AS n_shared FROM ch GROUP BY source) SELECT source, n_rows, n_dropped, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_shared, 0) AS n_shared FROM (SELECT source, count(*) AS n_rows, count(*) FILTER (WHERE len({_W}) = 0) AS n_dropped FROM documents GROUP BY source) LEFT JOIN g USING (source)",
    "source_lookup": f"WITH p AS (SELECT DISTINCT sha256({_STRIP.format('text')}) AS h, source FROM documents) SELECT h AS text_hash, string_agg(source, ',' ORDER BY source) AS source_membership FROM p GROUP BY h",
    "html_clean": f"SELECT page_id, length({_CLEAN}) AS n_chars, md5({_CLEAN}) AS text_md5 FROM pages",
    "page_split": r"WITH m AS (SELECT page_id, string_split(regexp_replace(replace(replace(html, '<p>', '<header>'), '</p>', '</header>'), '(?is)(<header\b[^>]*>.*?</header\s*>)', chr(57344) || '\1', 'g'), chr(57344)) AS p FROM pages), g AS (SELECT page_id, len(p) - 1 AS n_headers, list_filter(CASE WHEN len(p) > 1 THEN list_prepend(p[1] || p[2], p[3:]) ELSE p END, lambda x: length(trim(x)) > 0) AS s FROM m) SELECT page_id, n_headers, unnest(generate_series(1, len(s))) AS page, md5(unnest(s)) AS content_md5 FROM g",
    "request_batches": "SELECT doc_id, (r // 500 + 1)::BIGINT AS batch, (r % 500)::BIGINT AS batch_row FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents WHERE length(text) >= 100)",
    "stable_tag": "SELECT page_id, regexp_replace(CASE WHEN regexp_extract(url, 'models--([^/]+)', 1) <> '' THEN regexp_extract(url, 'models--([^/]+)', 1) ELSE list_last(string_split(regexp_replace(url, '/+$', ''), '/')) END, '[^A-Za-z0-9_.-]+', '_', 'g') || '-' || left(sha256(url), 8) AS tag FROM pages",
    "join_key": "SELECT o_orderkey, o_orderkey::VARCHAR AS join_key FROM orders",
}
