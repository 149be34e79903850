"""License scans: Aho-Corasick over words, and a shunting-yard parser for licence expressions.

Texts are lower-cased (A-Z) and cut into words; all phrases are found at once by an automaton over the words
joined by blanks, so a hit starts and ends at word bounds. Tags (`SPDX-License-Identifier:`) are followed by an
expression that is parsed with OR < AND < WITH and parentheses; its leaves give further labels, if all of them are known
identifiers: of a public family, or references.

Defined cases: null and empty texts have no words and no hits; the same phrase in one place counts once for each
phrase; repeated rows are scanned each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import LOWER, batches_of, encoded, rows

#: Phrases of the base rule and their labels (fixed values).
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notice phrases, their labels and weights (fixed values).
MORE = {
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "bsd license": ("bsd", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "creative commons attribution": ("cc-by", 0.8),
    "cc by nc": ("cc-by-nc", 0.8),
    "cc by sa": ("cc-by-sa", 0.8),
    "cc by nd": ("cc-by-nd", 0.8),
    "cc0": ("cc0", 0.6),
    "public domain": ("public-domain", 0.4),
    "all rights reserved": ("proprietary", 0.5),
    "the unlicense": ("unlicense", 0.6),
    "isc license": ("isc", 0.8),
}
BASE_WEIGHT = 0.8
TAG = "spdx license identifier"
#: Families of public licence identifiers, as the identifiers begin (fixed values); of several the longest counts.
FAMILIES = (
    "0bsd", "aal", "adsl", "afl", "agpl", "apache", "apl", "apsl", "artistic", "beerware", "blueoak", "bsd", "bsl", "bzip2", "cal",
    "cc-by", "cc-by-nc", "cc-by-nc-nd", "cc-by-nc-sa", "cc-by-nd", "cc-by-sa", "cc0", "cddl", "cecill", "cern-ohl", "cpal", "cpl",
    "curl", "ecl", "efl", "elastic", "epl", "eupl", "fair", "freetype", "ftl", "gfdl", "gpl", "hpnd", "icu", "ijg", "intel", "ipl",
    "isc", "json", "lgpl", "libpng", "libtiff", "lpl", "lppl", "miros", "mit", "mpl", "ms-pl", "ms-rl", "mulanpsl", "ncsa", "nist-pd",
    "npl", "odbl", "odc-by", "ofl", "ogl-uk", "openssl", "osl", "pddl", "php", "postgresql", "psf", "python", "qpl", "ruby", "sgi-b",
    "sleepycat", "sspl", "tcl", "unicode", "unlicense", "upl", "vim", "w3c", "wtfpl", "x11", "zlib", "zpl",
)
#: Words that end an exception's or a reference's identifier (fixed values).
EXCEPTION, REFERENCE = "-exception", "licenseref-"
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TAG_AT = re.compile(rb"spdx-license-identifier:[ \t]*([^\n\r]+)")
EXPRESSION_TOKEN = re.compile(r"\(|\)|[a-z0-9][a-z0-9.+\-]*")

SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "expression string, expression_valid boolean, n_tags long, choices long"
)


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for p, label in BASE.items():
        a.add_word(f" {p} ", (True, label, BASE_WEIGHT, len(p.split())))
    for p, (label, w) in MORE.items():
        a.add_word(f" {p} ", (False, label, w, len(p.split())))
    a.add_word(f" {TAG} ", (False, "", 1.0, 3))
    a.make_automaton()
    return a


def parse(text: str) -> tuple[list, bool]:
    """Shunting-yard: the expression in postfix order, and whether it is well formed."""
    out: list[str] = []
    ops: list[str] = []
    want, ok = True, True
    for t in EXPRESSION_TOKEN.findall(text):
        if t == "(":
            ok &= want
            ops.append(t)
        elif t == ")":
            ok &= not want
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                return out, False
            ops.pop()
        elif t in PRECEDENCE:
            ok &= not want
            while ops and ops[-1] != "(" and PRECEDENCE[ops[-1]] >= PRECEDENCE[t]:
                out.append(ops.pop())
            ops.append(t)
            want = True
        else:
            if not want:  # prose behind the expression ends it
                break
            out.append(t)
            want = False
    while ops:
        if ops[-1] == "(":
            ok = False
        out.append(ops.pop())
    return out, ok and not want and bool(out)


def evaluate(postfix: list[str]) -> tuple[int, frozenset]:
    """How many choices of licences an expression grants (2^62 at most), and all licences in it (with their exceptions).

    An exception belongs to one licence; where `with` stands between other things, all are taken as they are.
    """
    stack: list[tuple[int, frozenset]] = []
    for t in postfix:
        if t in PRECEDENCE and len(stack) >= 2:
            (m, b), (n, a) = stack.pop(), stack.pop()
            if t == "with" and len(a) == len(b) == 1:
                stack.append((n, frozenset(f"{x} with {y}" for x in a for y in b)))
            else:
                stack.append((min(n + m if t == "or" else n * m, 2**62), a | b))
        else:
            stack.append((1, frozenset([t])))
    return stack[-1] if stack else (0, frozenset())


def family(identifier: str) -> str | None:
    """The label of an identifier: its family's, its own if it is a reference; null if it is no known one."""
    name, _, exception = identifier.partition(" with ")
    if exception and EXCEPTION not in exception:
        return None
    if name.startswith(REFERENCE):
        return name
    base = name.removesuffix("+")
    return max((f for f in FAMILIES if base == f or base.startswith(f + "-")), key=len, default=None)


def scan(text: str | None, a) -> tuple:
    """One text's counts, labels, score and expressions."""
    data = encoded(text).translate(LOWER)
    words = WORD.findall(data)
    n_base, first, last = 0, None, None
    base: set[str] = set()
    labels: set[str] = set()
    miss, n_tags, choices, valid = 1.0, 0, 0, None
    expressions: list[str] = []
    if words:
        # a latin-1 view keeps bytes and places alike; phrases are ASCII
        flat = (b" " + b" ".join(words) + b" ").decode("latin-1")
        at = where = 0
        for e, (is_base, label, w, size) in a.iter(flat):
            where += flat.count(" ", at, e)  # blanks before the closing one: words up to the phrase's last
            at, start = e, where - size
            if is_base:
                n_base += 1
                first = start if first is None else min(first, start)
                last = start if last is None else max(last, start)
                base.add(label)
            if label:
                labels.add(label)
                miss *= 1 - w
            else:
                n_tags += 1
        if n_tags:
            for m in TAG_AT.finditer(data):
                e = m.group(1).decode("utf-8", "replace").strip()
                post, ok = parse(e)
                n, leaves = evaluate(post)
                known = {family(x) for x in leaves}
                ok = ok and None not in known
                expressions.append(" ".join(post))
                valid = ok if valid is None else valid and ok
                choices = min(choices + n, 2**62)
                if ok:
                    labels |= known
                    miss *= 0.05
    join = lambda s: ",".join(sorted(s))
    return len(words), n_base, first, last, join(base), join(labels), 1 - miss, "; ".join(expressions), valid, n_tags, choices


def scan_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each row of docs: id and what its whole text holds."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = docs.sparkSession.createDataFrame([], "id long, " + SCHEMA).schema
    schema["id"].dataType = docs.schema[id_col].dataType
    arrow = to_arrow_schema(schema)

    def run(batches):
        a = automaton()
        yield from batches_of(((k, *scan(t, a)) for k, t in rows(batches, "id", "text")), arrow)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
