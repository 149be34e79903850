"""Queries on question construction and ablation; and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import jsonops as J
from loomspark.functions import text as X
from loomspark.functions.binding import let
from loomspark.operators import ablation as B
from loomspark.operators import prompts as P
from loomspark.operators import qa_build as Q
from loomspark.plans.retrieval import read


def _wrapped(spark, sf_dir):
    """Event properties as model output: fenced, in prose, with a trailing comma, or cut off."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "props")
    k = F.col("event_id") % 4
    out = F.when(k == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(
        k == 1,
        F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" done")),
    ).when(k == 2, F.regexp_replace("props", r"\}$", ",}")).otherwise(F.lit("no object"))
    return e.withColumn("output", out)


def json_repair(spark, sf_dir):
    v = J.parsed(F.col("output"))
    return _wrapped(spark, sf_dir).select("event_id", v.isNotNull().alias("valid"), F.md5(J.repaired(F.col("output")).cast("binary")).alias("repaired_md5"))


def result_errors(spark, sf_dir):
    rows = _wrapped(spark, sf_dir)
    index = rows.where("event_id % 10 <> 1").select((F.floor(F.col("event_id") / 2)).alias("key")).distinct()
    results = rows.where("event_id % 10 <> 3").select((F.floor(F.col("event_id") / 2)).alias("key"), F.col("event_id").alias("line"), "output")
    return Q.merged_results(index, results, F.when(J.parsed(F.col("output")).isNull(), "no JSON"))


def _pages(spark, sf_dir):
    """Documents as pages of a guideline (their source), with their sentences as rules of a stage 2 response."""
    d = read(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("source").alias("guideline"),
        F.col("doc_id").alias("page"),
        "lang",
        F.filter(F.split("text", r"\."), lambda x: F.length(x) > 0).alias("s"),
    )
    rule = lambda x: F.struct(
        x.alias("condition_base"),
        F.concat(F.lit("act "), F.length(x).cast("string")).alias("action"),
        F.array(F.struct(F.lit("over 5").alias("criterion"))).alias("triggers"),
        x.alias("source_fragment"),
        F.lit(None).cast("string").alias("notes"),
    )
    response = F.to_json(F.struct(F.transform("s", rule).alias("rules")), {"ignoreNullFields": "false"})
    return d.select("doc_id", "guideline", "page", "lang", F.try_parse_json(response).alias("response"))


def explode_rules(spark, sf_dir):
    r = Q.explode_rules(_pages(spark, sf_dir))
    return r.select("guideline", "page", "rule_number_on_page", "action", "triggers", "notes", F.md5(F.col("condition").cast("binary")).alias("condition_md5"))


def _groups(spark, sf_dir):
    """Groups by page; in every seventh document some rules name another population."""
    r = Q.explode_rules(_pages(spark, sf_dir))
    odd = (F.col("doc_id") % 7 == 0) & (F.col("rule_number_on_page") % 3 == 0)
    r = r.withColumn("rule_order", F.struct("doc_id", "rule_number_on_page")).withColumn("target_population", F.when(odd, "General").otherwise("Adult")).withColumn("category", F.lit("Post-op & Pain"))
    return Q.numbered_groups(Q.stage3_groups(r, ["guideline", "page"], "rule_order", ["target_population", "category"], ["condition", "rule_number_on_page"]))


def stage3_groups(spark, sf_dir):
    f = Q.final_rows(_groups(spark, sf_dir), ["rule_number_on_page"])
    return f.select("key", "guideline", "page", "n_rules", "mixed", F.aggregate("rule_rule_number_on_page", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_numbers"))


def final_questions(spark, sf_dir):
    """Two questions for each page of even number, as a list; one for others; none for every fifth."""
    g = _groups(spark, sf_dir).where("not mixed")
    options = F.create_map(*[x for k in "ABcd" for x in (F.lit(k), F.concat(F.lit(f"option {k} of "), F.col("page").cast("string")))])
    fixed = {"question_type": "Diagnosis", "patient_profile": "a child", "scenario": "a ward", "explanation": "so", "difficulty": "Easy", "correct_answer": "B"}
    one = lambda n: F.struct(
        *[F.lit(v).alias(k) for k, v in fixed.items()],
        F.col("target_population"),
        F.col("category"),
        F.concat(F.lit(f"question {n} of "), F.col("key")).alias("question"),
        options.alias("options"),
    )
    reply = F.when(F.col("page") % 2 == 0, F.to_json(F.array(one(1), one(2)))).otherwise(F.to_json(one(1)))
    responses = g.where("page % 5 <> 0").select("key", F.try_parse_json(reply).alias("response"))
    out = Q.final_questions(g, responses)
    return out.select(
        "key",
        "page",
        F.col("question_number").cast("long").alias("question_number"),
        "question",
        "correct_answer",
        F.element_at("options", F.col("correct_answer")).alias("answer"),
        "difficulty",
        "target_population",
    )


S1 = '{"is_relevant": true, "target_population": "Adult", "category": "Post-op & Pain", "reason": "r"}'
def _sentences():
    return F.filter(F.split(F.coalesce("text", F.lit("")), r"\.", -1), lambda x: F.length(x) > 0)


def _case(n, *replies):
    """One of these by the rest of the id."""
    out = replies[-1]
    for i, r in reversed(list(enumerate(replies[:-1]))):
        out = F.when(F.col("doc_id") % n == i, r).otherwise(out)
    return out


def _json(*fields):
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def response_faults(spark, sf_dir):
    """Replies of all three stages made of the documents' own texts, with a fault or none by their ids, and what is found."""
    d = read(spark, sf_dir, "documents")
    null, adult, place = F.lit(None).cast("string"), F.lit("Adult").alias("target_population"), F.lit(J.CATEGORIES[0]).alias("category")
    relevant, reason = (F.col("doc_id") % 2 == 0).alias("is_relevant"), F.col("text").alias("reason")
    good = _json(relevant, adult, place, reason)
    stage1 = _case(
        7,
        good,
        _json(relevant, adult, place),
        _json(relevant.cast("string").alias("is_relevant"), adult, place, reason),
        _json(relevant, F.lower("lang").alias("target_population"), place, reason),
        _json(relevant, adult, null.alias("category"), reason),
        F.concat(F.lit("Here it is: "), good, F.lit(" done")),
        F.substring(good, F.lit(1), F.length(good) - 1),
    )
    trigger = F.array(F.struct(F.col("lang").alias("criterion")))

    def rules(triggers, fragment):
        one = lambda x, i: F.struct(F.concat(F.lit("if "), x).alias("condition_base"), F.lit("act").alias("action"), triggers(i).alias("triggers"), fragment(x, i).alias("source_fragment"), null.alias("notes"))
        return _json(F.transform(_sentences(), one).alias("rules"))

    whole = lambda x, i: F.concat(F.lit("f "), x)
    stage2 = _case(
        5,
        rules(lambda i: trigger, whole),
        F.lit('{"rules": {}}'),
        let(F.size(_sentences()), lambda n: rules(lambda i: trigger, lambda x, i: F.when(i == n - 1, " \n").otherwise(whole(x, i)))),
        rules(lambda i: F.when(i == 0, F.array().cast("array<struct<criterion:string>>")).otherwise(trigger), whole),
        _json(F.transform(_sentences(), lambda x, i: i).alias("rules")),
    )

    def question(options=("a", "B", "c", "d"), difficulty="Easy", answer="b", text=None):
        texts = F.struct(*[F.concat(F.lit(f"{x} of "), F.col("text")).alias(x) for x in options])
        fixed = {"question_type": "Diagnosis", "patient_profile": "p", "scenario": "s", "explanation": "e", "difficulty": difficulty, "correct_answer": answer}
        asked = F.concat(F.lit("? "), F.col("text")) if text is None else F.lit(text)
        return F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in fixed.items()], adult, place, asked.alias("question"), texts.alias("options")))

    both = lambda **how: F.concat(F.lit("["), question(), F.lit(", "), question(**how), F.lit("]"))
    stage3 = _case(6, both(), question(), both(options=("a", "b", "c")), both(difficulty="easy"), both(answer="e"), both(text=" "))
    v = d.select("doc_id", *[J.parsed(c).alias(k) for k, c in (("v1", stage1), ("v2", stage2), ("v3", stage3))])
    return v.select("doc_id", J.stage1_error(F.col("v1")).alias("stage1"), J.stage2_error(F.col("v2")).alias("stage2"), J.stage3_error(F.col("v3"), F.lit("Adult"), F.lit(J.CATEGORIES[0])).alias("stage3"))


def profiles(spark, sf_dir):
    """Replies that name a document's first sentence as the profile and the rest as the core, in several ways."""
    d = read(spark, sf_dir, "documents")
    first, rest = F.substring_index("text", ".", 1), F.expr("substring(text, instr(text, '.') + 1)")
    named = lambda p, c: _json(p.alias("PATIENT_PROFILE"), c.alias("QUESTION_CORE"))
    reply = _case(
        6,
        named(first, rest),
        F.concat(F.lit("```json\n"), named(first, F.lit("")), F.lit("\n```")),
        named(F.concat(F.lit("General Patient, "), first), rest),
        _json(first.alias("patient_profile"), rest.alias("question_core")),
        F.concat(F.lit("none: "), F.col("text")),
        F.to_json(F.array(first)),
    )
    p, core = J.profile(reply, F.col("text"))
    return d.select("doc_id", F.md5(p.cast("binary")).alias("profile_md5"), F.md5(core.cast("binary")).alias("core_md5"))


def memberships(spark, sf_dir):
    """Sources and languages of documents as names with bars, lists of Python and of JSON, one name, and none."""
    names = F.array(F.col("source"), F.concat("lang", F.lit("'s")), F.concat(F.lit(" "), F.col("source"), F.lit(" ")))
    quoted = lambda x: F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'"))
    listed = F.array_join(F.transform(names, quoted), ", ")
    said = _case(6, F.array_join(names, "|"), F.concat(F.lit("["), listed, F.lit("]")), F.to_json(names), F.concat(F.lit("("), listed, F.lit(",)")), F.col("source"), F.lit(" nan "))
    d = read(spark, sf_dir, "documents").select("doc_id", said.alias("t"))
    return d.select("doc_id", F.array_join(J.membership(F.col("t")), ",").alias("members"))


def rebalance(spark, sf_dir):
    return Q.rebalance(read(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def rebalanced_options(spark, sf_dir):
    """Options and answers of all documents, dealt anew."""
    options = F.create_map(*[x for k in "AbcD" for x in (F.lit(k), F.concat(F.lit(f"text {k.lower()} of "), F.col("doc_id").cast("string")))])
    d = read(spark, sf_dir, "documents").select("doc_id", options.alias("options"), F.expr("array('A', 'b', 'c')[doc_id % 3]").alias("correct_answer"))
    got = Q.rebalanced(d, "doc_id")
    texts = F.array_join(F.transform(F.array(*map(F.lit, Q.LABELS)), lambda x: F.element_at("options", x)), ";")
    return got.select("doc_id", texts.alias("texts"), "correct_answer", F.col("correct_answer_before_rebalance").alias("old_answer"))


def mcqa_prompts(spark, sf_dir):
    """Prompts with and without a profile and a context."""
    options = F.create_map(*[x for k in "abcd" for x in (F.lit(k), F.lit(f"option {k}"))])
    b = read(spark, sf_dir, "benchmark")
    even = F.col("item_id") % 2 == 0
    p = P.mcqa_prompt(F.col("text"), options, F.when(even, X.format_context(F.array(F.lit(" one "), F.lit("two")))).otherwise(""), F.when(even, F.lit(" a child ")), F.lit("a ward"), "Choose.")
    return b.select("item_id", p.alias("prompt"))


def profile_replacement(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark").select("item_id", F.expr("array('Adult', 'Pediatric', 'General')[item_id % 3]").alias("population"), F.col("text").alias("profile"))
    out = None
    for c in ("original", "random", "within_group", "cross_group"):
        part = B.replacement_profiles(b, c, "item_id", "population", "profile").select(F.lit(c).alias("condition"), "item_id", "new_profile")
        out = part if out is None else out.unionByName(part)
    return out


def context_format(spark, sf_dir):
    t = X.format_context(F.array(F.col("text"), F.lit("short")), 200)
    return read(spark, sf_dir, "benchmark").select("item_id", t.alias("context"))


def prompt_build(spark, sf_dir):
    p = P.filled("Context:\n{c}\nQuestion: {q}\nAnswer with a-d.", {"c": F.col("text"), "q": F.col("item_id")})
    line = Q.request_json(F.col("item_id").cast("string"), p, "be brief", 0.0)
    return read(spark, sf_dir, "benchmark").select("item_id", p.alias("prompt"), F.md5(line.cast("binary")).alias("request_md5"))


def answer_counts(spark, sf_dir):
    d = Q.rebalance(read(spark, sf_dir, "documents").select("doc_id"), "doc_id").withColumn("old_label", F.expr("array('a', 'b', 'c')[doc_id % 3]"))
    return Q.answer_counts(d, "old_label", "correct_label")


_WR = r"SELECT event_id, user_id, CASE event_id % 4 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 1 THEN 'Here it is: ' || props || ' done' WHEN 2 THEN regexp_replace(props, '\}$', ',}') ELSE 'no object' END AS output FROM events"
_FENCE = r"regexp_extract(output, '(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$', 1)"
_REP = rf"regexp_replace(regexp_extract(CASE WHEN {_FENCE} <> '' THEN {_FENCE} ELSE output END, '(?s)[{{\[].*[}}\]]', 0), ',\s*([}}\]])', '\1', 'g')"
_RU = """SELECT doc_id, source AS guideline, doc_id AS page, c, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM (
  SELECT doc_id, source, p[n] AS c, n FROM (SELECT *, unnest(generate_series(1, len(p))) AS n FROM (SELECT doc_id, source, string_split(text, '.') AS p FROM documents))) WHERE length(c) > 0"""
_GR = f"""SELECT *, 'guideline_page_' || lpad((row_number() OVER (ORDER BY page))::VARCHAR, 6, '0') AS key FROM (
  SELECT guideline, page, count(*) AS n_rules, page % 7 = 0 AND count(*) >= 3 AS mixed, sum(k)::BIGINT AS sum_numbers FROM ({_RU}) GROUP BY guideline, page)"""


_N = "len(list_filter(string_split(coalesce(text, ''), '.'), lambda x: length(x) > 0))"
_EDGES = r"regexp_replace(regexp_replace({}, '^[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]+', ''), '[\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}]+$', '')"
_P, _C = _EDGES.format("split_part(text, '.', 1)"), _EDGES.format("substring(text, instr(text, '.') + 1)")
_NAMED = f"doc_id % 6 < 2 AND {_P} <> '' AND NOT contains(lower({_P}), 'general patient')"
_B = "SELECT item_id, ['Adult','Pediatric','General'][item_id % 3 + 1] AS population, text AS profile FROM benchmark"
_POOL = f"SELECT population AS g, profile AS p FROM (SELECT DISTINCT population, profile FROM ({_B}) WHERE population <> 'General' AND profile <> 'general patient') QUALIFY row_number() OVER (PARTITION BY population ORDER BY md5('42:' || profile), profile) <= 120"
_DRAW = "coalesce((SELECT arg_min(p, md5('42:' || item_id || ':' || p)) FROM pool WHERE {}), b.profile)"

QUERIES = {
    f.__name__: f for f in (
        json_repair,
        result_errors,
        explode_rules,
        stage3_groups,
        final_questions,
        response_faults,
        profiles,
        memberships,
        answer_counts,
        rebalance,
        rebalanced_options,
        mcqa_prompts,
        profile_replacement,
        context_format,
        prompt_build,
    )
}
ORACLES = {
    "json_repair": f"SELECT event_id, json_valid({_REP}) AND {_REP} <> '' AS valid, md5({_REP}) AS repaired_md5 FROM ({_WR})",
    "result_errors": f"WITH r AS ({_WR}), i AS (SELECT DISTINCT event_id // 2 AS key FROM r WHERE event_id % 10 <> 1), s AS (SELECT event_id // 2 AS key, event_id AS line, CASE WHEN json_valid({_REP}) AND {_REP} <> '' THEN 0 ELSE 1 END AS bad FROM r WHERE event_id % 10 <> 3), f AS (SELECT key, min(bad * 1000000000000 + line) AS m, count(*) AS n FROM s GROUP BY key) SELECT coalesce(i.key, f.key) AS key, CASE WHEN i.key IS NULL THEN 'unexpected' WHEN f.key IS NULL THEN 'missing' WHEN m >= 1000000000000 THEN 'invalid' ELSE 'ok' END AS status, (m % 1000000000000)::BIGINT AS line, coalesce(n, 0) AS n_results FROM i FULL JOIN f ON i.key = f.key",
    "explode_rules": f"""SELECT guideline, page, k AS rule_number_on_page, 'act ' || length(c) AS action, '[{{"criterion":"over 5"}}]' AS triggers, NULL::VARCHAR AS notes, md5(c) AS condition_md5 FROM ({_RU})""",
    "stage3_groups": f"SELECT key, guideline, page, n_rules, mixed, sum_numbers FROM ({_GR})",
    "final_questions": f"SELECT key, page, n AS question_number, 'question ' || (n + 1) || ' of ' || key AS question, 'b' AS correct_answer, 'option B of ' || page AS answer, 'Easy' AS difficulty, 'Adult' AS target_population FROM (SELECT *, unnest(generate_series(0, 1 - page % 2)) AS n FROM ({_GR}) WHERE NOT mixed AND page % 5 <> 0)",
    "response_faults": f"""SELECT doc_id, CASE doc_id % 7 WHEN 1 THEN 'reason is missing' WHEN 2 THEN 'is_relevant is no boolean' WHEN 3 THEN 'unknown target_population' WHEN 4 THEN CASE WHEN doc_id % 2 = 0 THEN 'category is missing' END WHEN 6 THEN 'no JSON object' END AS stage1,
      CASE WHEN doc_id % 5 = 1 THEN 'rules is no list' WHEN doc_id % 5 = 0 OR {_N} = 0 THEN NULL ELSE ['source_fragment is blank', 'a rule has no trigger', 'a rule is no object'][doc_id % 5 - 1] END AS stage2,
      CASE WHEN doc_id % 6 > 1 THEN ['options are not a-d', 'unknown difficulty', 'answer is not a-d', 'question is blank'][doc_id % 6 - 1] END AS stage3 FROM documents""",
    "profiles": f"SELECT doc_id, md5(CASE WHEN {_NAMED} THEN {_P} ELSE 'general patient' END) AS profile_md5, md5(CASE WHEN {_NAMED} AND doc_id % 6 = 0 AND {_C} <> '' THEN {_C} ELSE text END) AS core_md5 FROM documents",
    "memberships": "SELECT doc_id, CASE WHEN doc_id % 6 < 4 THEN source || ',' || lang || chr(39) || 's' WHEN doc_id % 6 = 4 THEN source ELSE '' END AS members FROM documents",
    "answer_counts": "WITH t AS (SELECT count(*) AS t FROM documents) SELECT 'old_label' AS \"column\", l AS label, (SELECT count(*) FROM documents WHERE ['a', 'b', 'c'][doc_id % 3 + 1] = l) AS count FROM (SELECT unnest(['a', 'b', 'c', 'd']) AS l) UNION ALL SELECT 'correct_label', ['a', 'b', 'c', 'd'][i + 1], t // 4 + CASE WHEN i < t % 4 THEN 1 ELSE 0 END FROM t, (SELECT unnest([0, 1, 2, 3]) AS i)",
    "rebalance": "WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS p, count(*) OVER () AS t FROM documents) SELECT doc_id, CASE WHEN p < t // 4 + least(t % 4, 1) THEN 'a' WHEN p < 2 * (t // 4) + least(t % 4, 2) THEN 'b' WHEN p < 3 * (t // 4) + least(t % 4, 3) THEN 'c' ELSE 'd' END AS correct_label FROM o",
    "rebalanced_options": """WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS p, count(*) OVER () AS t, ['a', 'b', 'c'][doc_id % 3 + 1] AS old FROM documents),
      n AS (SELECT *, CASE WHEN p < t // 4 + least(t % 4, 1) THEN 'a' WHEN p < 2 * (t // 4) + least(t % 4, 2) THEN 'b' WHEN p < 3 * (t // 4) + least(t % 4, 3) THEN 'c' ELSE 'd' END AS new FROM o),
      s AS (SELECT *, list_transform(list_sort(list_transform(list_filter(['a', 'b', 'c', 'd'], lambda x: x <> old), lambda x: md5('42:' || doc_id || ':' || x) || x)), lambda x: right(x, 1)) AS others, list_filter(['a', 'b', 'c', 'd'], lambda x: x <> new) AS free FROM n)
      SELECT doc_id, array_to_string(list_transform(['a', 'b', 'c', 'd'], lambda x: 'text ' || CASE WHEN x = new THEN old ELSE others[list_position(free, x)] END || ' of ' || doc_id), ';') AS texts, new AS correct_answer, old AS old_answer FROM s""",
    "mcqa_prompts": """SELECT item_id, array_to_string(list_filter(['### Instruction: Choose.' || CASE WHEN item_id % 2 = 0 THEN ' Use the retrieved excerpts as evidence where they help.' ELSE '' END,
      '### Output structure:' || chr(10) || '- Explanation: Your step-by-step reasoning' || chr(10) || '- Final answer: Your final answer (e.g. (A), (B), ...)',
      CASE WHEN item_id % 2 = 0 THEN '### Patient profile: a child' END, '### Clinical scenario: a ward',
      '### Question: ' || text || chr(10) || '(A): option a' || chr(10) || '(B): option b' || chr(10) || '(C): option c' || chr(10) || '(D): option d',
      CASE WHEN item_id % 2 = 0 THEN '### Retrieved excerpts (top-2)' || chr(10) || '[1] Text:' || chr(10) || 'one' || chr(10) || chr(10) || '[2] Text:' || chr(10) || 'two' END, '### Answer:'], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS prompt FROM benchmark""",
    "profile_replacement": f"WITH b AS ({_B}), pool AS ({_POOL}) SELECT 'original' AS condition, item_id, profile AS new_profile FROM b UNION ALL SELECT 'random', item_id, {_DRAW.format('p <> b.profile')} FROM b UNION ALL SELECT 'within_group', item_id, {_DRAW.format("p <> b.profile AND g = CASE WHEN b.population = 'Pediatric' THEN 'Pediatric' ELSE 'Adult' END")} FROM b UNION ALL SELECT 'cross_group', item_id, {_DRAW.format("g = CASE WHEN b.population = 'Pediatric' THEN 'Adult' ELSE 'Pediatric' END")} FROM b",
    "context_format": r"""SELECT item_id, '### Retrieved excerpts (top-2)' || chr(10) || '[1] Text:' || chr(10) || CASE WHEN length(t) <= 200 THEN t WHEN instr(substring(t, 1, 200), ' ') > 0 THEN left(substring(t, 1, 200), length(substring(t, 1, 200)) - instr(reverse(substring(t, 1, 200)), ' ')) || '...' ELSE substring(t, 1, 200) || '...' END || chr(10) || chr(10) || '[2] Text:' || chr(10) || 'short' AS context FROM (SELECT item_id, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS t FROM benchmark)""",
    "prompt_build": """SELECT item_id, prompt, md5('{"key":"' || item_id || '","request":{"contents":[{"parts":[{"text":' || to_json(prompt)::VARCHAR || '}],"role":"user"}],"system_instruction":"be brief","generation_config":{"temperature":0.0}}}') AS request_md5 FROM (SELECT item_id, 'Context:' || chr(10) || text || chr(10) || 'Question: ' || item_id || chr(10) || 'Answer with a-d.' AS prompt FROM benchmark)""",
}
