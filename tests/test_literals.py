"""The scanner of Python literals against ast.literal_eval."""

import ast
import json
import random

import pytest
from pyspark.sql import functions as F

from loomspark.functions import jsonops as J
from loomspark.functions import literals

HAND = [
    """['A b', "it's c"]""",
    r"""['it\'s', "a \"b\"", 'both \' and "']""",
    r"""['\xa0', 'é', '\U0001F600', '\101\7', '\a\v\b\f\n\r\t', '\\', '\\\'', '\q', '\\n']""",
    "[1, -2, +3, 1.5, .5, 1., 1e5, 1E+5, 1_000, 0x1F, 0o17, 0b101, - 4]",
    "{'a': None, 'b': True, \"c\": [False, {'d': (1, 2)}], 1: 'x'}",
    "('t', 'u')", "('t',)", "()", "(1)", "('a' 'b')", "(('a'), ['b'])", "((1, 2), (3,))", "([1, 2])",
    "{1, 2}", "{'a'}", "set()", "[set(), {}, []]", "{('a'): 1}", "{'a' 'b': 1}", "{'x': {1, 2}, 'y': ({3},)}",
    "['a' 'b' \"c\", 'd']", "[1, 2, ]", "[\n 'a',\n\t'b',\n]", "['''a\nb''', \"\"\"c'd\"\"\"]", r"[r'\d\'', u'x', R'\\']",
    "[[[[['deep']]]]]", "['a, b', '[c]', '{d}', '(e)', 'f: g', '#']", "['']", "['漢字 𝒳', ' ']", "['a\\\nb']", '["x", "y",]',
    # no literals
    "['a", "[1 2]", "[,]", "[1,,2]", "(,)", "[a]", "['a' 1]", "[1, 2)", "]", "{'a': }", "{1: 2, 3}", "[true, None]", "['a', null]", "['x\ny']", r"['\xZ1']", r"['\u12']", r"['\U00110000']",
    "[b'x']", "[f'x']", "[1j]", "[1-2]", "[lambda: 1]", "[...]", "[1.2.3]", "['a']['b']", "['a'].b", "[x for x in y]", "((1)", "[1]]", "['a']; []",
]


def wanted(text):
    """The JSON value of a literal, or None; tuples and sets are lists."""
    def plain(x):
        if isinstance(x, dict):
            return {k if isinstance(k, str) else json.dumps(k): plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, (list, tuple, set)) else x

    try:
        return json.loads(json.dumps(plain(ast.literal_eval(text))))
    except (SyntaxError, ValueError, TypeError):
        return None


def found(spark, texts, expression):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    return [None if r.v is None else json.loads(r.v) for r in df.select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()]


def same(a, b):
    """Sets have no order."""
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and (all(map(same, a, b)) or sorted(map(str, a)) == sorted(map(str, b)))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    return a == b


def parsed(c):
    return F.to_json(J.one_json(literals.python_json(c)))


def test_by_hand(spark):
    for text, got in zip(HAND, found(spark, HAND, parsed), strict=True):
        assert same(got, wanted(text)), text


def test_random_values(spark):
    rng = random.Random(5)
    words = ["a", "it's", 'say "x"', "both ' and \"", "back\\slash", "new\nline", "tab\t", "\x00\x1f", " é漢𝒳", "", ", ", "[]", "None", "\\'", "'", '"', "\\", "a: b"]

    def value(depth):
        kind = rng.randrange(10 if depth else 5)
        if kind < 3:
            return "".join(rng.choice(words) for _ in range(rng.randrange(4)))
        if kind < 5:
            return rng.choice([None, True, False, 0, -7, 10**18, 2.5, 1e-7, -3.0])
        many = [value(depth - 1) for _ in range(rng.randrange(4))]
        return many if kind < 7 else tuple(many) if kind < 8 else {f"{i}{rng.choice(words)}": v for i, v in enumerate(many)}

    texts = [repr([value(4)]) for _ in range(600)]
    for text, got in zip(texts, found(spark, texts, parsed), strict=True):
        assert got == wanted(text), text
    # broken ones are the same to both
    broken = [t[:k] + rng.choice(["", "'", ",", "]", "\\"]) + t[k + 1 :] for t in texts for k in [rng.randrange(len(t))]]
    for text, got in zip(broken, found(spark, broken, parsed), strict=True):
        assert got == wanted(text), text


def test_nested_and_members(spark):
    long = repr([f"it's number {i}\n" * 30 for i in range(400)])
    texts = ["['a', \"b's\"]", long, '[1] x', '[1]]', '[1], [2]', '[1]], "end"', '{"a": 1} {"b": 2}', '["x", NaN]', "plain ['a']", " ( 'p' , 'q' ) ", "nan", None]
    got = found(spark, texts, lambda c: F.to_json(J.nested(c)))
    assert got == [["a", "b's"], ast.literal_eval(long), None, None, None, None, None, ["x", None], None, ["p", "q"], None, None]
    got = [r.v for r in spark.createDataFrame([(t,) for t in ("['a', \"b's\"]", "('x', 'it\\'s ', 'x')", "{'a'}", "[1, None]")], "t string").select(J.membership(F.col("t")).alias("v")).collect()]
    assert got[:3] == [["a", "b's"], ["x", "it's"], ["a"]]


@pytest.mark.parametrize("text", ["﷐", "['﷑']"])
def test_noncharacters_are_no_literal(spark, text):
    assert found(spark, [text], parsed) == [None]
