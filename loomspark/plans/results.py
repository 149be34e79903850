"""Queries on result files, batches, indexes and prompts, which write to the shared folder and read again; and their oracles."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from loomspark.functions import jsonops as J
from loomspark.functions import text as X
from loomspark.operators import corpus as C
from loomspark.operators import index as I
from loomspark.operators import prompts as P
from loomspark.operators import qa_build as Q
from loomspark.operators import stages as S
from loomspark.operators import trajectory as T
from loomspark.operators.lineage import scratch, written
from loomspark.plans import corpus as corpus_plans
from loomspark.plans import retrieval as retrieval_plans
from loomspark.plans.retrieval import read
from loomspark.sources import io

BATCHES, BUDGET, MOST = 4, 120, 2000


def _sentences(c="text"):
    return F.filter(F.split(F.coalesce(F.col(c), F.lit("")), r"\.", -1), lambda x: F.length(x) > 0)


def _written_list(items):
    """A list as Python writes it: quotes as they fit each text."""
    def quoted(x):
        for a, b in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            x = F.replace(x, F.lit(a), F.lit(b))
        single = F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'"))
        return F.when(x.contains("'") & ~x.contains('"'), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(single)

    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))


def python_lists(spark, sf_dir):
    """The sentences of each document, with an apostrophe more, as a Python list in text and back."""
    items = F.concat(_sentences(), F.array(F.lit("it's"), F.concat(F.lit('a "b" \\ \''), F.col("lang"))))
    d = read(spark, sf_dir, "documents").select("doc_id", _written_list(items).alias("t"))
    got = d.select("doc_id", F.try_variant_get(J.nested(F.col("t")), "$", "array<string>").alias("a"))
    return got.select("doc_id", F.size("a").cast("long").alias("n"), F.md5(F.array_join("a", "\x01").cast("binary")).alias("items_md5"))


def result_documents(spark, sf_dir):
    """Results of two layouts in one folder: a nested trajectory for documents of even id; for the others lists in text, and
    the whole text in an array. Sources come from metadata, else from the corpus."""
    docs = read(spark, sf_dir, "documents")
    folder = scratch(spark)
    sentence = lambda s, i: F.struct((i + 1).cast("long").alias("rank"), F.col("doc_id").alias("corpus_index"), s.alias("text"), F.create_map(F.lit("source"), F.col("source")).alias("metadata"))
    stage = lambda kind, k, documents: F.struct(F.lit(kind).alias("query_kind"), F.col("lang").alias("query"), F.lit(k).alias("requested_k"), documents.alias("documents"))
    new = F.struct(
        F.lit("q_q").alias("condition"),
        stage("core", 64, F.transform(_sentences(), sentence)).alias("initial"),
        stage("core", 8, F.array().cast("array<string>")).alias("middle"),
        stage("core", 1, F.array(F.struct(F.col("text")))).alias("final"),
    )
    even = docs.where("doc_id % 2 = 0").select("doc_id", F.col("doc_id").alias("id"), F.col("lang").alias("target_population"), new.alias("retrieval_trajectory"))
    odd = docs.where("doc_id % 2 <> 0").select("doc_id", F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("question_id"), _written_list(_sentences()).alias("candidate_texts"), F.array("text").alias("top_1"))
    for name, df in (("new", even), ("old", odd)):
        df.orderBy("doc_id").drop("doc_id").write.parquet(f"{folder}/{name}.parquet")
    got = T.flatten_results(T.load_results(spark, folder), T.source_lookup(docs))
    return got.select(
        "result_name",
        "result_row",
        "question_id",
        "target_population",
        "condition",
        "stage",
        "query",
        "requested_k",
        "observed_k",
        "rank",
        "corpus_index",
        "document_source",
        "source_membership",
        F.md5(F.col("text").cast("binary")).alias("text_md5"),
    )


def indexed_topk(spark, sf_dir):
    """bm25_topk by an index on disk."""
    docs = read(spark, sf_dir, "documents")
    p = I.indexed(docs, scratch(spark), {"table": "documents"})
    got = I.top_k(p, read(spark, sf_dir, "benchmark"), 64)
    return got.select(F.col("q_id").alias("item_id"), "rank", "doc_id", "score")


def batch_results(spark, sf_dir):
    """Requests of all documents, results of their batches in files, and what became of each key: by the id's last digit none,
    one that comes again, one that is no JSON, a fault, an error of the service, one of an unknown key, or a good one."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    folder = scratch(spark)
    # written: requests, results of each batch, both hashes and the merge read it, and each would sort the texts anew
    rows = written(C.with_position(docs, "doc_id", "position"))
    n = rows.count()
    key = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    batch = F.floor(F.col("position") * BATCHES / max(n, 1) + 1).cast("long")
    index = rows.select(key.alias("key"), F.col("position").alias("row_position"), batch.alias("batch"))
    requests = rows.select(batch.alias("batch"), Q.request_json(key, F.col("text"), "judge", 0.0).alias("line"))
    io.write_request_batches(requests, io.stage_paths(folder, "stage1")["requests"], source=rows, index=index.drop("batch"), stage="stage1")
    digit = F.col("doc_id") % 10
    verdict = F.to_json(F.struct((digit > 5).alias("is_relevant"), F.when(digit == 3, "adult").otherwise("Adult").alias("target_population"), F.lit(J.CATEGORIES[0]).alias("category"), F.substring_index("text", ".", 1).alias("reason")))
    said = F.when(digit == 2, F.lit("no verdict")).when(digit == 6, F.concat(F.lit("```json\n"), verdict, F.lit("\n```"))).otherwise(verdict)
    part = F.struct(F.array(F.struct(F.struct(F.array(F.struct(said.alias("text"))).alias("parts")).alias("content"))).alias("candidates"))
    line = lambda k: F.to_json(F.struct(k.alias("key"), part.alias("response")))
    failed = F.to_json(F.struct(key.alias("key"), F.struct(F.lit("quota").alias("message")).alias("error")))
    lines = F.when(digit == 0, F.array().cast("array<string>")).when(digit == 1, F.array(line(key), line(key))).when(digit == 4, F.array(failed))
    lines = lines.when(digit == 5, F.array(line(F.concat(F.lit("x_"), key)))).otherwise(F.array(line(key)))
    made = rows.select(batch.alias("batch"), F.explode(lines).alias("value"))
    for i in range(1, BATCHES + 1 if n >= BATCHES else n + 1):
        made.where(F.col("batch") == i).select("value").write.text(f"{folder}/stage1_results_batch_{i:03d}.jsonl")
    # each batch's folder of part files is its file
    ok, errors = S.merge_stage(spark, folder, "stage1", rows, "position", J.stage1_error(F.col("response")))
    ok = ok.select(key.alias("key"), F.lit("ok").alias("outcome"), F.md5(F.try_variant_get("response", "$.reason", "string").cast("binary")).alias("reason_md5"))
    return ok.unionByName(errors.select("key", F.col("error").alias("outcome"), F.lit(None).cast("string").alias("reason_md5")))


def budgeted_prompts(spark, sf_dir):
    """Prompts of all documents' texts, clipped until they have few enough words."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    d = read(spark, sf_dir, "documents").select("doc_id", F.lit("Read:\n{context}\nSay why.").alias("p"), F.array("text").alias("t"))
    got = P.budgeted(d, "p", "t", "prompt", BUDGET, lambda texts: [len(word.findall(t)) for t in texts], MOST)
    return got.select("doc_id", F.length("prompt").cast("long").alias("n_chars"), F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


def combined_chunks(spark, sf_dir):
    """Chunks of each text once, over all sources, with the sources that have an equal one."""
    docs = C.prepare_documents(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), F.col("source"))
    got = C.combined_chunks(docs, ["doc_id"])
    return got.select("doc_id", "source", F.col("chunk_id").cast("long").alias("chunk_id"), F.md5(F.col("text").cast("binary")).alias("text_md5"), F.array_join("source_membership", ",").alias("source_membership"))


def chunk_tokens(spark, sf_dir):
    """Chunks of a public tokenizer's ids; no SQL has one, a test holds them against the tokenizer."""
    import public_tokenizers

    file, ranks = (str(public_tokenizers.path(f"byte_bpe_50k.{kind}")) for kind in ("json", "tiktoken"))
    c = C.chunk_by_tokenizer(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), file, ranks=ranks)
    return c.select(*[F.col(x).cast("long").alias(x) for x in ("doc_id", "chunk_id", "token_start", "token_end", "token_count", "document_token_count")], "source", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_S = "list_filter(string_split(coalesce(text, ''), '.'), lambda x: length(x) > 0)"
_STRIPPED = corpus_plans._STRIP
_LENGTHS = P.lengths(MOST)
_CLIP = "CASE WHEN length(t) <= k THEN t WHEN instr(substring(t, 1, k), ' ') > 0 THEN left(substring(t, 1, k), length(substring(t, 1, k)) - instr(reverse(substring(t, 1, k)), ' ')) || '...' ELSE substring(t, 1, k) || '...' END"
_CATEGORY = "CASE WHEN m IS NULL THEN 'unknown' WHEN contains(m, '|') THEN 'both' ELSE m END"

QUERIES = {f.__name__: f for f in (python_lists, result_documents, indexed_topk, batch_results, budgeted_prompts, combined_chunks, chunk_tokens)}
ORACLES = {
    "python_lists": f"""SELECT doc_id, len(s)::BIGINT AS n, md5(array_to_string(s, chr(1))) AS items_md5 FROM (SELECT doc_id, list_concat({_S}, ['it''s', 'a "b" \\ ''' || lang]) AS s FROM documents)""",
    "result_documents": f"""WITH look AS (SELECT h, string_agg(source, '|' ORDER BY source) AS m FROM (SELECT DISTINCT {_STRIPPED.format("text")} AS h, source FROM documents) GROUP BY h),
      d AS (SELECT *, doc_id % 2 = 0 AS is_new, row_number() OVER (PARTITION BY doc_id % 2 ORDER BY doc_id) - 1 AS r, {_S} AS s FROM documents),
      i AS (SELECT *, unnest(generate_series(1, len(s))) AS n FROM d),
      rows_ AS (SELECT is_new, r, doc_id, lang, source, 'initial' AS stage, n AS rank, len(s) AS k, s[n] AS t FROM i UNION ALL SELECT is_new, r, doc_id, lang, NULL, 'final', 1, 1, text FROM d),
      found AS (SELECT rows_.*, CASE WHEN is_new AND stage = 'initial' THEN source ELSE look.m END AS m FROM rows_ LEFT JOIN look ON look.h = {_STRIPPED.format("t")})
      SELECT CASE WHEN is_new THEN 'new' ELSE 'old' END AS result_name, r::BIGINT AS result_row, CASE WHEN is_new THEN '' ELSE 'q' END || doc_id AS question_id,
        CASE WHEN is_new THEN lang ELSE 'unknown' END AS target_population, CASE WHEN is_new THEN 'q_q' END AS condition, stage, CASE WHEN is_new THEN lang END AS query,
        (CASE WHEN NOT is_new THEN k WHEN stage = 'initial' THEN 64 ELSE 1 END)::BIGINT AS requested_k, k::BIGINT AS observed_k, rank::BIGINT AS rank,
        CASE WHEN is_new AND stage = 'initial' THEN doc_id END AS corpus_index, {_CATEGORY} AS document_source, coalesce(m, '') AS source_membership, md5(t) AS text_md5 FROM found""",
    "indexed_topk": retrieval_plans.ORACLES["bm25_topk"],
    "batch_results": """WITH d AS (SELECT doc_id, 'doc_' || doc_id AS key, doc_id % 10 AS g, md5(split_part(text, '.', 1)) AS h FROM documents)
      SELECT key, 'ok' AS outcome, h AS reason_md5 FROM d WHERE g IN (1, 6, 7, 8, 9)
      UNION ALL SELECT key, CASE g WHEN 0 THEN 'no result' WHEN 1 THEN 'the key is there already' WHEN 2 THEN 'no JSON in the response' WHEN 3 THEN 'unknown target_population' WHEN 4 THEN 'the service says: quota' ELSE 'no result' END, NULL FROM d WHERE g < 6
      UNION ALL SELECT 'x_' || key, 'unexpected key', NULL FROM d WHERE g = 5""",
    "budgeted_prompts": rf"""WITH t AS (SELECT doc_id, {_STRIPPED.format("coalesce(text, '')")} AS t, unnest({_LENGTHS}) AS k FROM documents),
      p AS (SELECT doc_id, k, 'Read:' || chr(10) || '### Retrieved excerpt (top-1)' || chr(10) || '[1] Text:' || chr(10) || {_CLIP} || chr(10) || 'Say why.' AS p FROM t)
      SELECT doc_id, length(p)::BIGINT AS n_chars, md5(p) AS prompt_md5 FROM p WHERE len(regexp_extract_all(p, '[^\x20\x09-\x0D]+')) <= {BUDGET} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) = 1""",
    "combined_chunks": f"""WITH {corpus_plans._chunks(f"(SELECT doc_id, source, {_STRIPPED.format('text')} AS text FROM documents)")},
      m AS (SELECT txt, string_agg(DISTINCT source, ',' ORDER BY source) AS m FROM ch GROUP BY txt), first AS (SELECT min(doc_id) AS doc_id FROM (SELECT doc_id, {_STRIPPED.format('text')} AS x FROM documents) GROUP BY x)
      SELECT doc_id, source, chunk_id, md5(ch.txt) AS text_md5, m AS source_membership FROM ch JOIN m USING (txt) JOIN first USING (doc_id)""",
}
