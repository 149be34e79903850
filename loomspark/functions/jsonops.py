"""Model output: repair, parse and validate JSON as Column expressions; validators give an error text or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions.binding import let
from loomspark.functions.literals import python_json
from loomspark.functions.text import strip

#: Closed vocabularies (fixed values).
POPULATIONS = ("Adult", "Pediatric", "General")
ANSWERS = ("a", "b", "c", "d")
DIFFICULTIES = ("Easy", "Medium", "Hard")
CATEGORIES = ("Pre-op Assessment", "Pharmacology & Fluid", "Airway & Equipment", "Crisis & Complication", "Post-op & Pain")
QUESTION_TYPES = ("Management", "Calculation", "Diagnosis")


def repaired(c: Column) -> Column:
    """The JSON text inside a fence or prose, trailing commas removed."""
    fence = lambda t: F.regexp_extract(t, r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$", 1)
    body = let(c, lambda t: F.when(t.contains("```"), F.coalesce(F.nullif(fence(t), F.lit("")), t)).otherwise(t))
    return F.regexp_replace(F.regexp_extract(body, r"(?s)[{\[].*[}\]]", 0), r",\s*([}\]])", "$1")


def one_json(c: Column) -> Column:
    """Text that is one JSON value, and nothing behind it, as a variant; else null."""

    def read(t):
        # the parser stops behind the first value: a mark must follow, which the text can't name
        def marked(h):
            both = F.try_parse_json(F.concat(F.lit("[["), t, F.lit("],"), h.cast("string"), F.lit("]")))
            alone = lambda v: (F.try_variant_get(v, "$[1]", "long") == h) & F.try_variant_get(v, "$[0][1]", "variant").isNull()
            return let(both, lambda v: F.when(alone(v), F.try_variant_get(v, "$[0][0]", "variant")))

        return let(F.xxhash64(t), marked)

    return let(c, read)


def parsed(c: Column) -> Column:
    """The repaired text as a variant; null where it is no JSON."""
    return one_json(repaired(c))


def json_object(c: Column) -> Column:
    """The JSON object that a text is, alone or in a fence, or that its outermost braces hold; null where there is none.
    Nothing is repaired."""

    def read(t):
        fenced = F.regexp_extract(t, r"(?is)^\s*```(?:json)?\s*(\{.*\})\s*```\s*$", 1)
        inside = lambda b: F.coalesce(one_json(b), one_json(F.nullif(F.regexp_extract(b, r"(?s)\{.*\}", 0), F.lit(""))))
        return let(F.coalesce(F.nullif(fenced, F.lit("")), t), inside)

    return let(let(c, read), lambda v: F.when(kind(v) == "OBJECT", v))


def field_type(v: Column, path: str) -> Column:
    """The type of a field: tells true from "true", null and a missing key."""
    return F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant"))


def response_text(c: Column) -> Column:
    return F.get_json_object(c, "$.response.candidates[0].content.parts[0].text")


def response_error(c: Column) -> Column:
    return F.coalesce(F.get_json_object(c, "$.error.message"), F.get_json_object(c, "$.error"))


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID, ...; null where there is no value."""
    return F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)


def inner(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def text_of(v: Column, name: str) -> Column:
    """A field's text; null where it is no text."""
    return F.when(kind(inner(v, name)) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))


def lacking(v: Column, names) -> Column:
    """The first of these fields that an object doesn't have (null counts as there), else null."""
    return F.coalesce(*[F.when(inner(v, n).isNull(), f"{n} is missing") for n in names])


def _blank(c: Column) -> Column:
    return F.coalesce(~c.rlike(r"(?U)\S"), F.lit(True))


def _one_of(c: Column, values) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False))


def _fields(v: Column, names, body) -> Column:
    """body of a struct of an object's fields, each taken once: a variant, its kind and its text, by name; null in place of
    the variant is a missing field."""
    one = lambda x: F.struct(x.alias("v"), kind(x).alias("kind"), F.try_variant_get(x, "$", "string").alias("as_text"))
    return let(F.struct(*[let(inner(v, n), one).alias(n) for n in names]), body)


def _words(f: Column, name: str) -> Column:
    """A field's text; null where it is no text."""
    return F.when(f[name]["kind"] == "STRING", f[name]["as_text"])


def _first_missing(f: Column, names) -> Column:
    return F.coalesce(*[F.when(f[n]["v"].isNull(), f"{n} is missing") for n in names])


def _checked(v: Column, names, otherwise: str, body) -> Column:
    """The error of an object with these fields: that it is none, that one is missing, or what body says of its fields."""
    said = lambda f: F.coalesce(_first_missing(f, names), body(f))
    return let(v, lambda x: F.when(F.coalesce(kind(x) != "OBJECT", F.lit(True)), otherwise).otherwise(_fields(x, names, said)))


def _typed(v: Column, schema: str, fields: str, body, otherwise) -> Column:
    """body of an object's fields, taken out at once, if the object's schema is of this pattern and none of them is null;
    else what otherwise says. The fields of most objects are as they should be, and one by one they cost several times that."""
    names = [f.split()[0] for f in fields.split(", ")]
    whole = lambda f: F.when(f.isNotNull() & ~F.coalesce(*[F.when(f[n].isNull(), True) for n in names], F.lit(False)), F.struct(body(f).alias("said")))
    said = F.when(F.schema_of_variant(v).rlike(f"^{schema}$"), let(F.try_variant_get(v, "$", f"struct<{fields}>"), whole))
    return let(said, lambda x: F.when(x.isNotNull(), x["said"]).otherwise(otherwise))


def _first_error(items: Column, error) -> Column:
    """The first error among a list's items; null for none."""
    return F.get(F.filter(F.transform(items, error), lambda e: e.isNotNull()), F.lit(0))


def stage1_error(v: Column) -> Column:
    """A page verdict: all fields, is_relevant a real boolean, a known population, a known category (null only if not
    relevant), and a reason in words."""

    def said(f):
        no_category = f["category"]["kind"] == "VOID"
        return (
            F.when(f["is_relevant"]["kind"] != "BOOLEAN", "is_relevant is no boolean")
            .when(~_one_of(_words(f, "target_population"), POPULATIONS), "unknown target_population")
            .when(~no_category & ~_one_of(_words(f, "category"), CATEGORIES), "unknown category")
            .when(no_category & (f["is_relevant"]["as_text"] == "true"), "category is missing")
            .when(f["reason"]["kind"] != "STRING", "reason is no text")
        )

    return _checked(v, ("is_relevant", "target_population", "category", "reason"), "no JSON object", said)


def rules_of(v: Column) -> Column:
    """The rules of a stage 2 response, each a variant; null where there is no list."""
    rules = lambda x: let(inner(x, "rules"), lambda r: F.when(kind(r) == "ARRAY", F.try_variant_get(r, "$", "array<variant>")))
    return let(v, lambda x: F.when(kind(x) == "OBJECT", rules(x)))


def _rule_error(r: Column) -> Column:
    def trigger_error(t):
        criterion = lambda x: F.when(_blank(F.when(kind(x) == "STRING", F.try_variant_get(x, "$", "string"))), "a trigger has no criterion")
        return F.when(F.coalesce(kind(t) != "OBJECT", F.lit(True)), "a trigger has no criterion").otherwise(let(inner(t, "criterion"), criterion))

    def said(f):
        out = F.lit(None).cast("string")
        for name in ("condition_base", "action", "source_fragment"):
            out = F.coalesce(out, F.when(_blank(_words(f, name)), f"{name} is blank"))
        triggers = F.when(f["triggers"]["kind"] == "ARRAY", F.try_variant_get(f["triggers"]["v"], "$", "array<variant>"))
        listed_ = lambda t: F.when(F.coalesce(F.size(t), F.lit(0)) <= 0, "a rule has no trigger").otherwise(_first_error(t, trigger_error))
        return F.coalesce(out, let(triggers, listed_), F.when(~f["notes"]["kind"].isin("STRING", "VOID"), "notes is no text"))

    def as_they_should_be(f):
        out = F.lit(None).cast("string")
        for name in ("condition_base", "action", "source_fragment"):
            out = F.coalesce(out, F.when(_blank(f[name]), f"{name} is blank"))
        return F.coalesce(out, F.when(F.exists(f["triggers"], lambda t: _blank(t["criterion"])), "a trigger has no criterion"))

    schema = "OBJECT<action: STRING, condition_base: STRING, notes: (STRING|VOID), source_fragment: STRING, triggers: ARRAY<OBJECT<criterion: STRING>>>"
    fields = "condition_base string, action string, source_fragment string, triggers array<struct<criterion:string>>"
    slow = _checked(r, ("condition_base", "action", "triggers", "source_fragment", "notes"), "a rule is no object", said)
    return _typed(r, schema, fields, as_they_should_be, slow)


def stage2_error(v: Column) -> Column:
    """Rules: a list of objects with condition, action and source texts, triggers with criteria, and notes or null."""
    read = lambda r: F.when(r.isNull(), "rules is no list").otherwise(_first_error(r, _rule_error))
    return let(v, lambda x: F.when(F.coalesce(kind(x) != "OBJECT", F.lit(True)), "no JSON object").otherwise(let(rules_of(x), read)))


def normalized_options(options: Column) -> Column:
    """Options with lower-case keys if they are exactly a-d and none is blank, else null."""
    low = F.transform_keys(options, lambda k, _: F.lower(F.trim(k)))
    ok = (F.array_sort(F.map_keys(low)) == F.array(*map(F.lit, ANSWERS))) & F.forall(F.map_values(low), lambda x: F.trim(x) != "")
    return F.when(ok, low)


def nested(c: Column) -> Column:
    """Text that holds a list or an object, as a variant: JSON, or a Python literal, whose tuples and sets are lists."""
    return let(strip(c), lambda t: F.when(t.rlike(r"^[\[{(]"), F.coalesce(one_json(t), one_json(python_json(t)))))


def _options(o: Column) -> Column:
    """Options in a variant: an object of texts, or one written as text; normalized, else null."""
    held = let(o, lambda x: F.when(kind(x) == "STRING", nested(F.try_variant_get(x, "$", "string"))).otherwise(x))

    def read(x):
        texts = F.forall(F.map_values(F.try_variant_get(x, "$", "map<string,variant>")), lambda y: kind(y) == "STRING")
        return F.when(kind(x) == "OBJECT", F.when(texts, normalized_options(F.try_variant_get(x, "$", "map<string,string>"))))

    return let(held, read)


def options_of(v: Column) -> Column:
    """The options of a question: an object, or one written as text; normalized, else null."""
    return _options(inner(v, "options"))


def questions_of(v: Column) -> Column:
    """The questions of a stage 3 response: a list of them, or one."""
    return F.when(kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>")).when(v.isNotNull(), F.array(v))


def _question_error(q: Column, population: Column, category: Column) -> Column:
    def said(f):
        out = F.when(~_one_of(_words(f, "question_type"), QUESTION_TYPES), "unknown question_type")
        out = out.when(~_words(f, "target_population").eqNullSafe(population), "population differs from its group")
        out = out.when(~_words(f, "category").eqNullSafe(category), "category differs from its group")
        out = out.when(~_one_of(_words(f, "difficulty"), DIFFICULTIES), "unknown difficulty")
        for name in ("patient_profile", "scenario", "question", "explanation"):
            out = out.when(_blank(_words(f, name)), f"{name} is blank")
        out = out.when(_options(f["options"]["v"]).isNull(), "options are not a-d")
        return out.when(~_one_of(F.lower(f["correct_answer"]["as_text"]), ANSWERS), "answer is not a-d")

    fields = ("question_type", "target_population", "category", "patient_profile", "scenario", "question", "options", "correct_answer", "explanation", "difficulty")
    def as_they_should_be(f):
        out = F.when(~_one_of(f["question_type"], QUESTION_TYPES), "unknown question_type")
        out = out.when(~f["target_population"].eqNullSafe(population), "population differs from its group")
        out = out.when(~f["category"].eqNullSafe(category), "category differs from its group")
        out = out.when(~_one_of(f["difficulty"], DIFFICULTIES), "unknown difficulty")
        for name in ("patient_profile", "scenario", "question", "explanation"):
            out = out.when(_blank(f[name]), f"{name} is blank")
        out = out.when(normalized_options(f["options"]).isNull(), "options are not a-d")
        return out.when(~_one_of(F.lower(f["correct_answer"]), ANSWERS), "answer is not a-d")

    text = r"\w+: STRING"
    kinds = {n: rf"OBJECT<{text}(, {text})*>" if n == "options" else "STRING" for n in fields}
    schema = "OBJECT<" + ", ".join(f"{n}: {kinds[n]}" for n in sorted(fields)) + ">"
    typed = ", ".join(f"{n} {'map<string,string>' if n == 'options' else 'string'}" for n in fields)
    return _typed(q, schema, typed, as_they_should_be, _checked(q, fields, "a question is no object", said))


def stage3_error(v: Column, population: Column, category: Column) -> Column:
    """Generated questions: at least one, each whole, of the population and category of its group."""
    read = lambda qs: F.when(F.size(qs) == 0, "no question").otherwise(_first_error(qs, lambda q: _question_error(q, population, category)))
    return let(v, lambda x: F.when(x.isNull(), "no JSON object").otherwise(let(questions_of(x), read)))


def profile(c: Column, original: Column) -> tuple[Column, Column]:
    """(profile, question core) of a reply, plain or fenced. No JSON, no profile or the general patient anywhere in it gives
    the general patient and the original question; a blank core gives the original question."""
    def read(t):
        fenced = F.trim(F.regexp_replace(F.get(F.split(t, "```", -1), F.lit(1)), "^json", ""))
        return one_json(F.when(t.contains("```"), fenced).otherwise(t))

    def found(v):
        field = lambda name: strip(F.coalesce(F.when(kind(v) == "OBJECT", F.try_variant_get(v, f"$.{name}", "string")), F.lit("")))
        return F.struct(field("PATIENT_PROFILE").alias("p"), field("QUESTION_CORE").alias("core"))

    def chosen(f):
        ok = (f["p"] != "") & ~F.lower(f["p"]).contains("general patient")
        return F.struct(F.when(ok, f["p"]).otherwise("general patient").alias("p"), F.when(ok & (f["core"] != ""), f["core"]).otherwise(original).alias("core"))

    got = let(let(let(strip(c), read), found), chosen)
    return got["p"], got["core"]


def parsed_nested(v: Column) -> Column:
    """A variant as it is, but one of text that holds a list or an object as that; blank text, nan and null are null."""

    def read(t):
        return F.when(~F.lower(strip(t)).isin("", "nan"), F.coalesce(nested(t), v))

    text = let(F.try_variant_get(v, "$", "string"), read)
    return F.when(kind(v) == "STRING", text).when(kind(v) != "VOID", v)


def listed(v: Column) -> Column:
    """The members of a variant as array<variant>: of a list its elements, of an object its names, else itself alone."""
    names = F.transform(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), lambda k: F.try_parse_json(F.to_json(F.struct(k.alias("k")))))
    names = F.transform(names, lambda x: inner(x, "k"))
    return F.when(kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>")).when(kind(v) == "OBJECT", names).when(v.isNotNull(), F.array(v))


def _names(parts: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(parts, lambda x: strip(x)), lambda x: F.coalesce(x, F.lit("")) != ""))


def members_of(v: Column) -> Column:
    """Sources in a variant as ordered distinct trimmed names: a list, text with |, or one name; null is none."""

    def read(x):
        text = F.try_variant_get(x, "$", "string")
        parts = F.when(kind(x) == "STRING", F.split(text, r"\|", -1)).otherwise(F.transform(listed(x), lambda y: F.try_variant_get(y, "$", "string")))
        return F.coalesce(_names(parts), F.array().cast("array<string>"))

    return let(parsed_nested(v), read)


def membership(c: Column) -> Column:
    """Sources in text as ordered distinct trimmed names: "a|b", a list written as text, or one name; null is none."""

    def read(t):
        held = let(nested(t), lambda v: F.when(kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<string>")))
        parts = F.when((t == "") | (F.lower(t) == "nan"), F.array().cast("array<string>")).otherwise(F.coalesce(held, F.split(t, r"\|", -1)))
        return _names(parts)

    return let(strip(F.coalesce(c, F.lit(""))), read)
