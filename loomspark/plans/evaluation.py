"""Queries on answers, raters and public sets; and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import text as X
from loomspark.operators import agreement as A
from loomspark.operators import corpus as C
from loomspark.operators import metrics as M
from loomspark.operators import public_sets as S
from loomspark.plans.retrieval import read

#: Answers of models, and the letter in each, written down by hand.
PHRASES = (
    ("Final answer: (C)", "c"),
    ("so final answer is B", None),
    ("first final answer: a, then Final answer: d", "d"),
    ("it may be (A) or (D)", "d"),
    ("Final answer: Based on it", "b"),
    ("none", None),
    ("Final answer: Option B", "b"),
    ("Final answer: [C]", "c"),
    ("finalanswer: a", "a"),
    ("Final answer is D, not (a)", "a"),
    ("FINAL  ANSWER option (d)", "d"),
)


def _answers(spark, sf_dir):
    """Each document's text as an explanation, with an answer behind it in one of many ways."""
    d = read(spark, sf_dir, "documents")
    phrase = F.get(F.array(*[F.lit(p) for p, _ in PHRASES]), (F.col("doc_id") % len(PHRASES)).cast("int"))
    return d.select(
        "doc_id",
        F.concat_ws(" ", "text", phrase).alias("answer"),
        F.expr("array('a', 'b', 'c', 'd')[doc_id % 4]").alias("correct"),
        F.expr("array('Adult', 'Pediatric', 'General')[doc_id % 3]").alias("population"),
    )


def answer_parse(spark, sf_dir):
    return _answers(spark, sf_dir).select("doc_id", X.parse_answer(F.col("answer")).alias("parsed"))


def accuracy_by_population(spark, sf_dir):
    rows = _answers(spark, sf_dir).withColumn("parsed", X.parse_answer(F.col("answer")))
    return M.accuracy(rows, "parsed", "correct", "population")


def metrics_upsert(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    agg = lambda df: df.groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))
    return M.upsert(agg(o.where("o_orderkey % 2 = 0")), agg(o.where("o_orderkey % 2 <> 0")), ["key"])


def _raters(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id")
    return d.select("doc_id", F.expr("1 + doc_id % 5").alias("r1"), F.expr("1 + (doc_id + (case when doc_id % 7 = 0 then 1 else 0 end)) % 5").alias("r2"))


def quadratic_kappa(spark, sf_dir):
    return A.cohen_kappa(_raters(spark, sf_dir), "r1", "r2", True)


def cohen_kappa(spark, sf_dir):
    return A.cohen_kappa(read(spark, sf_dir, "labels").select("quality", "toxic"), "quality", "toxic")


def rating_summary(spark, sf_dir):
    return A.rating_summary(_raters(spark, sf_dir), "validity", "r1", "r2")


def _votes(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.explode(F.array(*map(F.lit, range(3)))).alias("rater"))
    return d.select(
        "doc_id",
        "source",
        "rater",
        F.expr("array('Adult', 'Pediatric', 'General')[(doc_id * (rater + 1)) % 3]").alias("target_population"),
        F.expr("array('diagnosis', 'basic', 'other')[(doc_id + rater * (doc_id % 4)) % 3]").alias("question_type"),
        F.expr("(doc_id + rater) % 5 = 0").alias("is_anesthesia"),
    )


def fleiss_kappa(spark, sf_dir):
    return A.fleiss_kappa(_votes(spark, sf_dir), "doc_id", "question_type")


def majority_vote(spark, sf_dir):
    return A.majority_vote(_votes(spark, sf_dir), ["doc_id", "source"], ["target_population", "question_type", "is_anesthesia"], ["target_population", "question_type"])


def composition_rollup(spark, sf_dir):
    items = majority_vote(spark, sf_dir).where("not excluded")
    return A.composition(
        items,
        "source",
        {
            "diagnosis": F.col("question_type").isin("diagnosis", "basic"),
            "pediatric": F.col("target_population") == "Pediatric",
            "anesthesia": F.col("is_anesthesia"),
        },
    )


def normalise_union(spark, sf_dir):
    """Three differently shaped tables as one question set: options in columns, in a map with a label, and with an index."""
    p = read(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_name").alias("question"),
        F.col("p_brand").alias("opa"),
        F.col("p_type").alias("opb"),
        F.lit(None).cast("string").alias("opc"),
        F.lit("none").alias("opd"),
    )
    d = read(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
        F.col("text").alias("question"),
        F.create_map(F.lit("A"), F.col("lang"), F.lit("B"), F.col("source")).alias("options"),
        F.lit("B").alias("label"),
    )
    b = read(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("link"),
        F.col("text").alias("question"),
        *[F.lit(x).alias(f"op{x}") for x in "abcde"],
        F.lit("D").alias("answer_idx"),
        F.lit("d").alias("answer"),
    )
    out = S.union([S.lettered(p, "part"), S.mapped(d, "documents"), S.indexed(b, "benchmark")])
    options = F.array_join(F.transform(F.array_sort(F.map_entries("options")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.select("id", "source", F.md5(F.col("question").cast("binary")).alias("question_md5"), options.alias("options"), "correct_option", "correct_answer")


def gold_context(spark, sf_dir):
    """Gold rows of all orders; every fifth line's key has no gold row."""
    page = F.concat(F.col("l_orderkey").cast("string"), F.when(F.col("l_orderkey") % 5 == 0, ".5").otherwise(".0"))
    left = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).select(page.alias("page"), "n")
    gold = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.col("o_orderpriority").alias("summary"))
    return M.gold_contexts(left, gold, ["page"], "summary")


def _labels(spark, sf_dir, model):
    """One model's labels of all documents."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    kinds = "array('DIAGNOSIS', 'MANAGEMENT', 'BASIC_SCIENCE', 'OTHER')"
    return A.checked_labels(
        d.select(
            "id",
            "source",
            F.expr(f"{kinds}[(id + {model} * (id % 3)) % 4]").alias("question_type"),
            F.expr(f"array('Adult', 'Pediatric', 'General')[(id * ({model} + 1)) % 3]").alias("target_population"),
            F.expr(f"(id + {model}) % 5 = 0").alias("is_anesthesia_model"),
        ),
        f"m{model}",
    )


def aligned_labels(spark, sf_dir):
    got = A.aligned_labels([_labels(spark, sf_dir, m) for m in range(3)])
    return got.groupBy("model", "question_type", "target_population").agg(F.count("*").alias("n"), F.count_if("is_anesthesia_model").alias("n_anesthesia"))


def _ratings(spark, sf_dir, rater):
    """One rater's rows on all documents, as they come from a file: text."""
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit(" q"), F.col("doc_id").cast("string")).alias("data_id"), "doc_id")
    marks = [F.expr(f"cast(1 + (doc_id * {i + 1} + {rater} * (doc_id % 7 % 2)) % 5 as string)").alias(m) for i, m in enumerate(A.ORDINAL)]
    return A.checked_ratings(d.select("data_id", *marks, F.expr(f"if((doc_id + {rater} * (doc_id % 4 % 2)) % 3 = 0, 'Incorrect', 'Correct')").alias(A.TARGET)))


def rating_report(spark, sf_dir):
    both = A.aligned(_ratings(spark, sf_dir, 0), _ratings(spark, sf_dir, 1), "data_id")
    return A.summarize(both).select("metric", "scale", "n_items", "n_ratings", "mean", "accuracy", "exact_agreement", "within_one", "kappa", "kappa_weighting")


def extractions(spark, sf_dir):
    """Extracted profiles by position, of the same questions."""
    q = C.with_position(read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question")), "item_id")
    x = q.select(
        "position",
        "question",
        F.substring_index("question", ".", 1).alias("extracted_patient_profile"),
        F.expr("substring(question, instr(question, '.') + 1)").alias("extracted_question_core"),
    )
    return M.with_extractions(q, x, "position").select("item_id", "position", "extracted_patient_profile", "extracted_question_core")


_SAID = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p, _ in PHRASES) + f"][doc_id % {len(PHRASES)} + 1]"
_LAST = "list_last(regexp_extract_all(answer, '{}', 1))"
_ANS = f"""SELECT doc_id, lower(coalesce({_LAST.format(X.ANSWER)}, {_LAST.format(X.BARE)})) AS p, ['a','b','c','d'][doc_id % 4 + 1] AS correct,
  ['Adult','Pediatric','General'][doc_id % 3 + 1] AS population FROM (SELECT doc_id, concat_ws(' ', text, {_SAID}) AS answer FROM documents)"""
_RAT = "SELECT doc_id, 1 + doc_id % 5 AS r1, 1 + (doc_id + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END) % 5 AS r2 FROM documents"


def _kappa(src: str, weight: str) -> str:
    return f"""WITH p AS ({src}), lab AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT l AS v FROM p UNION SELECT r FROM p)),
    sp AS (SELECT greatest(max(i), 1) AS s FROM lab), c AS (SELECT l, r, count(*) AS n FROM p GROUP BY ALL), rl AS (SELECT l, sum(n) AS nl FROM c GROUP BY l), rr AS (SELECT r, sum(n) AS nr FROM c GROUP BY r),
    g AS (SELECT {weight} AS w, coalesce(n, 0) AS n, coalesce(nl, 0) AS nl, coalesce(nr, 0) AS nr FROM lab a CROSS JOIN lab b CROSS JOIN sp LEFT JOIN c ON c.l = a.v AND c.r = b.v LEFT JOIN rl ON rl.l = a.v LEFT JOIN rr ON rr.r = b.v),
    k AS (SELECT sum(n)::BIGINT AS n_items, CASE WHEN sum(w * nl * nr) > 1e-12 THEN round(1 - sum(w * n) * sum(n) / sum(w * nl * nr), 6) END::DOUBLE AS kappa FROM g)"""


def _report(i: int, metric: str) -> str:
    """A rater metric from its definition: all labels meet all labels."""
    src = f"SELECT 1 + (doc_id * {i + 1}) % 5 AS l, 1 + (doc_id * {i + 1} + doc_id % 7 % 2) % 5 AS r FROM documents"
    return f"(WITH p AS ({src}), k AS ({_kappa(src, _QUAD)} SELECT * FROM k), v AS (SELECT l AS v FROM p UNION ALL SELECT r FROM p) SELECT '{metric}' AS metric, 'ordinal_1_5' AS scale, n_items, (SELECT count(*) FROM v) AS n_ratings, (SELECT round(avg(v), 6) FROM v) AS mean, NULL::DOUBLE AS accuracy, (SELECT round(avg((l = r)::INT), 6) FROM p) AS exact_agreement, (SELECT round(avg((abs(l - r) <= 1)::INT), 6) FROM p) AS within_one, kappa, 'quadratic' AS kappa_weighting FROM k)"


def _report_target() -> str:
    src = "SELECT CASE WHEN doc_id % 3 = 0 THEN 'Incorrect' ELSE 'Correct' END AS l, CASE WHEN (doc_id + doc_id % 4 % 2) % 3 = 0 THEN 'Incorrect' ELSE 'Correct' END AS r FROM documents"
    return f"(WITH p AS ({src}), k AS ({_kappa(src, _PLAIN)} SELECT * FROM k), v AS (SELECT l AS v FROM p UNION ALL SELECT r FROM p) SELECT 'Target Population Appropriateness' AS metric, 'binary' AS scale, n_items, (SELECT count(*) FROM v) AS n_ratings, NULL::DOUBLE AS mean, (SELECT round(avg((v = 'Correct')::INT), 6) FROM v) AS accuracy, (SELECT round(avg((l = r)::INT), 6) FROM p) AS exact_agreement, NULL::DOUBLE AS within_one, kappa, 'unweighted' AS kappa_weighting FROM k)"


_PLAIN, _QUAD = "CASE WHEN a.i <> b.i THEN 1.0::DOUBLE ELSE 0.0 END", "pow((a.i - b.i)::DOUBLE / s, 2)"
_VOTES = "SELECT doc_id, source, rater, ['Adult','Pediatric','General'][(doc_id * (rater + 1)) % 3 + 1] AS target_population, ['diagnosis','basic','other'][(doc_id + rater * (doc_id % 4)) % 3 + 1] AS question_type, (doc_id + rater) % 5 = 0 AS is_anesthesia FROM documents, (SELECT unnest([0, 1, 2]) AS rater)"
_VOTE = "CASE WHEN count(DISTINCT {0}) < 3 THEN mode({0}) END AS {0}"
_MAJ = f"SELECT doc_id, source, {_VOTE.format('target_population')}, {_VOTE.format('question_type')}, sum(is_anesthesia::INT) >= 2 AS is_anesthesia, count(DISTINCT v.target_population) = 3 OR count(DISTINCT v.question_type) = 3 AS excluded FROM ({_VOTES}) v GROUP BY doc_id, source"
_PCT = "count(*) FILTER (WHERE {1}) AS n_{0}, round_even(100 * count(*) FILTER (WHERE {1}) / count(*), 2)::DOUBLE AS pct_{0}"

QUERIES = {
    f.__name__: f for f in (
        answer_parse,
        accuracy_by_population,
        metrics_upsert,
        cohen_kappa,
        quadratic_kappa,
        rating_summary,
        fleiss_kappa,
        majority_vote,
        composition_rollup,
        normalise_union,
        gold_context,
        aligned_labels,
        rating_report,
        extractions,
    )
}
ORACLES = {
    "answer_parse": f"SELECT doc_id, p AS parsed FROM ({_ANS})",
    "accuracy_by_population": f"WITH a AS ({_ANS}), g AS (SELECT population, p, correct FROM a UNION ALL SELECT 'All', p, correct FROM a) SELECT population, count(*) AS n, count(*) FILTER (WHERE p = correct) AS correct, count(*) FILTER (WHERE p IS NULL) AS unparsed, round_even(100 * count(*) FILTER (WHERE p = g.correct) / count(*), 4)::DOUBLE AS accuracy FROM g GROUP BY population",
    "metrics_upsert": "WITH u AS (SELECT o_custkey AS key, count(*) AS n, max(o_orderkey) AS last, 0 AS s FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1 UNION ALL SELECT o_custkey, count(*), max(o_orderkey), 1 FROM orders WHERE o_orderkey % 2 <> 0 GROUP BY 1) SELECT key, n, last FROM u QUALIFY row_number() OVER (PARTITION BY key ORDER BY s DESC) = 1",
    "cohen_kappa": _kappa("SELECT quality AS l, toxic AS r FROM labels", _PLAIN) + " SELECT * FROM k",
    "quadratic_kappa": _kappa(f"SELECT r1 AS l, r2 AS r FROM ({_RAT})", _QUAD) + " SELECT * FROM k",
    "rating_summary": _kappa(
        f"SELECT r1 AS l, r2 AS r FROM ({_RAT})",
        _QUAD,
    ) + ", pool AS (SELECT l AS v FROM p UNION ALL SELECT r FROM p) SELECT 'validity' AS metric, (SELECT count(*) FROM pool) AS n_ratings, (SELECT round(avg(v), 6) FROM pool) AS mean, (SELECT round(stddev_samp(v), 6) FROM pool) AS std, (SELECT round(avg((l = r)::INT), 6) FROM p) AS exact_agreement, (SELECT round(avg((abs(l - r) <= 1)::INT), 6) FROM p) AS within_one, n_items, kappa FROM k",
    "fleiss_kappa": f"WITH c AS (SELECT doc_id, question_type AS l, count(*) AS n FROM ({_VOTES}) GROUP BY ALL), i AS (SELECT doc_id, (sum(n * n) - 3) / 6.0::DOUBLE AS p FROM c GROUP BY doc_id), q AS (SELECT l, sum(n)::DOUBLE AS n FROM c GROUP BY l), e AS (SELECT sum(n * n) / (sum(n) * sum(n)) AS pe FROM q) SELECT count(*) AS n_items, round((avg(p) - (SELECT pe FROM e)) / (1 - (SELECT pe FROM e)), 6) AS kappa FROM i",
    "majority_vote": _MAJ,
    "composition_rollup": f"WITH m AS (SELECT * FROM ({_MAJ}) WHERE NOT excluded) SELECT source, count(*) AS n_items, {_PCT.format('diagnosis', "question_type IN ('diagnosis', 'basic')")}, {_PCT.format('pediatric', "target_population = 'Pediatric'")}, {_PCT.format('anesthesia', 'is_anesthesia')} FROM m GROUP BY ROLLUP (source)",
    "normalise_union": "SELECT 'p' || p_partkey AS id, 'part' AS source, md5(p_name) AS question_md5, 'a=' || p_brand || ';b=' || p_type || ';d=none' AS options, '' AS correct_option, '' AS correct_answer FROM part UNION ALL SELECT 'd' || doc_id, 'documents', md5(text), 'a=' || lang || ';b=' || source, 'b', source FROM documents UNION ALL SELECT 'b' || item_id, 'benchmark', md5(text), 'a=a;b=b;c=c;d=d;e=e', 'd', 'd' FROM benchmark",
    "gold_context": "SELECT l_orderkey || CASE WHEN l_orderkey % 5 = 0 THEN '.5' ELSE '.0' END AS page, n, CASE WHEN l_orderkey % 5 <> 0 THEN o_orderpriority END AS gold_text, CASE WHEN l_orderkey % 5 = 0 OR o_orderpriority IS NULL THEN 'missing' END AS gold_error FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) LEFT JOIN orders ON o_orderkey = l_orderkey",
    "aligned_labels": "SELECT 'm' || m AS model, ['DIAGNOSIS', 'MANAGEMENT', 'BASIC_SCIENCE', 'OTHER'][(doc_id + m * (doc_id % 3)) % 4 + 1] AS question_type, ['Adult', 'Pediatric', 'General'][(doc_id * (m + 1)) % 3 + 1] AS target_population, count(*) AS n, count(*) FILTER (WHERE (doc_id + m) % 5 = 0) AS n_anesthesia FROM documents, (SELECT unnest([0, 1, 2]) AS m) GROUP BY ALL",
    "rating_report": " UNION ALL ".join(_report(i, m) for i, m in enumerate(A.ORDINAL)) + " UNION ALL " + _report_target(),
    "extractions": "SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS position, split_part(text, '.', 1) AS extracted_patient_profile, substring(text, instr(text, '.') + 1) AS extracted_question_core FROM benchmark",
}
