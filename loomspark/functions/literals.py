"""Python literals in text as JSON text: a quote-aware scanner in Column expressions.

Backslashes in front of quotes and of backslashes are first put aside, so that a quote always ends its string. One pattern
of alternatives then cuts the text into tokens; what it can't cut is no literal. Tokens become JSON each by itself and
by its neighbours: strings with their escapes, neighbouring strings as one, numbers, words, commas before a bracket's
end. Only where there are round brackets or sets do a state machine's two folds over the tokens find out what each bracket is:
a tuple and a set are lists, a bracket around one value is nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions.binding import let

#: Stand for two backslashes, \' and \" (noncharacters, which no text may hold).
BACKSLASH, QUOTE, DOUBLE = "﷐", "﷑", "﷒"
_STRING = r"""[uUrR]?(?:'''.*?'''|\"\"\".*?\"\"\"|'[^'\n\r]*+'|"[^"\n\r]*+")"""
_NUMBER = r"(?:[-+][ \t]*)?(?:0[xX][0-9a-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][-+]?[0-9_]+)?)"
TOKEN = rf"(?s){_STRING}|{_NUMBER}|(?:None|True|False|null|true|false|NaN)\b|set\(\s*\)|[\[\](){{}},:]|[ \t\r\n\f]+"
ESCAPE = r"(?s)\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{1,3}|.)"
#: Words of Python and of JSON, and what they are in JSON (fixed values).
PYTHON = {"None": "null", "True": "true", "False": "false"}
JSON = {"null": "null", "true": "true", "false": "false", "NaN": "null"}
#: Escapes of one letter that JSON has too, and those that it has by number (fixed values).
SAME, NUMBERED = "nrtbf", {"a": r"\u0007", "v": r"\u000b"}
#: What no JSON has, so that the whole is none.
BAD = " ! "


def _quoted(c: Column) -> Column:
    """A JSON string's inside."""
    j = F.to_json(F.array(c))
    j = j.substr(F.lit(3), F.length(j) - 4)
    return F.replace(F.replace(F.replace(j, F.lit(BACKSLASH), F.lit("\\\\")), F.lit(QUOTE), F.lit("'")), F.lit(DOUBLE), F.lit('\\"'))


def _escape(e: Column) -> Column:
    """One escape of a Python string in a JSON string."""
    kind, rest = e.substr(2, 1), e.substr(F.lit(3), F.length(e))
    number = F.conv(rest, 16, 10).cast("long")
    point = F.decode(F.unhex(F.lpad(rest, 8, "0")), "UTF-32")
    out = F.when(kind.isin(*SAME), e)
    for k, v in NUMBERED.items():
        out = out.when(kind == k, v)
    out = out.when(kind.rlike("[0-7]"), F.concat(F.lit("\\u"), F.lpad(F.conv(e.substr(F.lit(2), F.length(e)), 8, 16), 4, "0")))
    out = out.when((kind == "x") & (F.length(e) == 4), F.concat(F.lit("\\u00"), rest)).when((kind == "u") & (F.length(e) == 6), e)
    out = out.when((kind == "U") & (F.length(e) == 10) & (number < 1114112) & ~number.between(55296, 57343), _quoted(point))
    # an unknown escape is a backslash and its letter; one that is cut short, or a name, is none
    return out.when(kind.isin("x", "u", "U", "N"), BAD + '"').otherwise(F.concat(F.lit("\\\\"), _quoted(kind)))


def _string(x: Column, before: Column, behind: Column) -> Column:
    """A string token's part of a JSON string, open to strings beside it."""

    def inside(t):
        mark = F.regexp_extract(t, "^[uUrR]?('''|\"\"\"|'|\")", 1)
        raw = t.rlike("^[rR]")
        start = F.length(mark) + F.when(t.rlike("^[uUrR]"), 2).otherwise(1)
        body = t.substr(start, F.length(t) - start - F.length(mark) + 1)
        # a raw string keeps what was put aside as it was
        kept = F.replace(F.replace(F.replace(body, F.lit(BACKSLASH), F.lit("\\\\")), F.lit(QUOTE), F.lit("\\'")), F.lit(DOUBLE), F.lit('\\"'))
        kept = F.to_json(F.array(kept))
        kept = kept.substr(F.lit(3), F.length(kept) - 4)
        gaps, found = F.split(body, ESCAPE, -1), F.regexp_extract_all(body, F.lit(ESCAPE), F.lit(0))
        decoded = F.array_join(F.zip_with(gaps, found, lambda g, e: F.concat(_quoted(g), F.when(e.isNull(), "").otherwise(_escape(e)))), "")
        return F.when(raw, kept).when(body.contains("\\"), decoded).otherwise(_quoted(body))

    return F.concat(F.when(_is_string(before), "").otherwise(' "'), let(x, inside), F.when(_is_string(behind), "").otherwise('"'))


def _is_string(x: Column) -> Column:
    return F.coalesce(x.rlike("^[uUrR]?['\"]"), F.lit(False))


def _number(x: Column) -> Column:
    n = F.regexp_replace(x, "[_ \t+]", "")
    n = F.when(x.rlike("[eE][+]"), F.regexp_replace(F.regexp_replace(x, "[_ \t]", ""), r"^\+", "")).otherwise(n)
    n = F.regexp_replace(n, r"^(-?)0+(?=0$|[0-9]+[.eE])", "$1")
    plain = F.regexp_replace(F.regexp_replace(n, r"\.(?![0-9])", ".0"), r"^(-?)\.", "$10.")
    whole = lambda base: F.concat(F.regexp_extract(n, "^-?", 0), F.conv(F.regexp_replace(n, "^-?0[a-zA-Z]", ""), base, 10))
    return F.when(n.rlike("^-?0[xX]"), whole(16)).when(n.rlike("^-?0[oO]"), whole(8)).when(n.rlike("^-?0[bB]"), whole(2)).otherwise(plain)


def bracket_kinds(tokens: Column) -> Column:
    """What the bracket at each token is: l(ist), t(uple), s(et), d(ict), g(roup) or x (has no partner); . elsewhere."""
    chars = F.transform(tokens, lambda x: F.when(x.rlike(r"^[\[\](){},:]$"), x).otherwise("v"))
    start = F.struct(F.lit("").alias("stack"), F.lit("").alias("out"), F.lit("").alias("prev"))

    def step(a, c):
        top, rest = F.right(a["stack"], F.lit(1)), F.left(a["stack"], F.length(a["stack"]) - 1)
        push = F.when(c == "[", "l").when(c == "(", "g").when(c == "{", "s")
        turned = F.when((c == ",") & (top == "g"), "t").when((c == ":") & (top == "s"), "d")
        stack = F.when(push.isNotNull(), F.concat(a["stack"], push)).when(turned.isNotNull(), F.concat(rest, turned)).when(c.isin("]", ")", "}"), rest).otherwise(a["stack"])
        ended = (
            F.when(c == "]", F.when(top == "l", "l").otherwise("x"))
            .when(c == ")", F.when(~top.isin("g", "t"), "x").when(a["prev"] == "(", "t").otherwise(top))
            .when(c == "}", F.when(~top.isin("s", "d"), "x").when(a["prev"] == "{", "d").otherwise(top))
            .otherwise(".")
        )
        return F.struct(stack.alias("stack"), F.concat(a["out"], ended).alias("out"), c.alias("prev"))

    def back(a, x):
        c, kind = x["c"], x["k"]
        opens = c.isin("[", "(", "{")
        top = F.right(a["stack"], F.lit(1))
        stack = F.when(kind != ".", F.concat(a["stack"], kind)).when(opens, F.left(a["stack"], F.length(a["stack"]) - 1)).otherwise(a["stack"])
        own = F.when(opens, F.when(top == "", "x").otherwise(top)).otherwise(kind)
        return F.struct(stack.alias("stack"), F.concat(own, a["out"]).alias("out"))

    def folded(cs):
        ends = F.split(F.aggregate(cs, start, step)["out"], "")
        pairs = F.reverse(F.transform(cs, lambda c, i: F.struct(c.alias("c"), F.get(ends, i).alias("k"))))
        return F.split(F.aggregate(pairs, F.struct(F.lit("").alias("stack"), F.lit("").alias("out")), back)["out"], "")

    return let(chars, folded)


def _json(tokens: Column) -> Column:
    at = lambda i: F.get(tokens, i)
    has = lambda words: F.arrays_overlap(tokens, F.array(*map(F.lit, words)))
    json_words = has(JSON)
    # words of both at once are neither's
    python_words = has([*PYTHON, "("]) | F.exists(tokens, lambda x: x.rlike("^(?:[uUrR]|'|set)"))
    odd = F.array_contains(tokens, "(") | F.exists(F.transform(tokens, lambda x, i: (x == "{") & (at(i + 1) != "}") & ~F.coalesce(at(i + 2) == ":", F.lit(False))), lambda x: F.coalesce(x, F.lit(False)))

    def written(kinds):
        def piece(x, i):
            behind, before = at(i + 1), F.when(i > 0, at(i - 1))
            own = F.get(kinds, i)
            out = F.when(_is_string(x), _string(x, before, behind))
            closing = F.when(own.isin("l", "t", "s"), "]").when(own == "d", "}").when(own == "g", " ").otherwise(BAD)
            opening = F.when(own.isin("l", "t", "s"), "[").when(own == "d", "{").when(own == "g", " ").otherwise(BAD)
            plain = F.when(kinds.isNull() & x.rlike(r"^[\[\]{}]$"), x)
            out = out.when(x.rlike(r"^[\])}]$"), F.coalesce(plain, closing)).when(x.rlike(r"^[\[({]$"), F.coalesce(plain, opening))
            needless = F.coalesce(behind.rlike(r"^[\])}]$"), F.lit(False)) & ~F.coalesce(before.rlike(r"^[\[({,]$"), F.lit(True)) & ~json_words
            out = out.when(x == ",", F.when(needless, "").otherwise(",")).when(x == ":", x).when(x.startswith("set"), "[]")
            value = F.lit(None).cast("string")
            for words in (PYTHON, JSON):
                for k, v in words.items():
                    value = F.coalesce(value, F.when(x == k, v))
            value = F.concat(F.lit(" "), F.coalesce(value, _number(x)))
            return out.otherwise(F.when(F.coalesce(behind == ":", F.lit(False)), F.concat(F.lit('"'), F.trim(value), F.lit('"'))).otherwise(value))

        return F.array_join(F.transform(tokens, piece), "")

    kinds = F.when(odd, bracket_kinds(tokens))
    return F.when(~(json_words & python_words), let(kinds, written))


def python_json(c: Column) -> Column:
    """A Python literal of lists, tuples, sets, dicts, strings, numbers, None, True and False as JSON text, which may still be
    no JSON where the literal's brackets and commas are wrong; null where it holds anything else."""
    aside = F.replace(F.replace(F.replace(c, F.lit("\\\r\n"), F.lit("")), F.lit("\\\n"), F.lit("")), F.lit("\\\\"), F.lit(BACKSLASH))
    aside = F.replace(F.replace(aside, F.lit("\\'"), F.lit(QUOTE)), F.lit('\\"'), F.lit(DOUBLE))

    def scanned(t):
        def whole(found):
            n = F.aggregate(found, F.lit(0), lambda a, x: a + F.length(x))
            return F.when(n == F.length(t), let(F.filter(found, lambda x: ~x.rlike(r"^[ \t\r\n\f]")), _json))

        return let(F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0)), whole)

    return F.when(~c.rlike(f"[{BACKSLASH}{QUOTE}{DOUBLE}]"), let(aside, scanned))
