"""Text functions as Column expressions."""

from __future__ import annotations

import functools
import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions.binding import let

#: How an answer is given, the named way first.
ANSWER = r"(?i)final\s*answer\s*:?\s*(?:option\s*)?[\(\[]?\s*([A-D])\s*[\)\]]?"
BARE = r"(?i)\(([A-D])\)"
#: A character reference that ends in a semicolon.
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def strip(c: Column) -> Column:
    """All Unicode white space off both ends, not only blanks."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def bm25_tokens(c: Column) -> Column:
    """ASCII letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


#: Names of character references that are tried before all others (fixed values).
FREQUENT = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "\u00a9", "middot": "\u00b7"}


@functools.cache
def _names() -> str:
    """All names of HTML, by their first two characters, as JSON: a map is searched from its start."""
    by: dict[str, dict[str, str]] = {}
    for name, chars in html5.items():
        if name.endswith(";"):
            by.setdefault(name[:2], {})[name[:-1]] = chars
    return json.dumps(by)


def unescaped(c: Column) -> Column:
    """Character references decoded, by number and by the names of HTML; unknown ones stay."""
    names = F.from_json(F.lit(_names()), "map<string,map<string,string>>")
    point = lambda n: F.when((n > 0) & (n < 1114112) & ~n.between(55296, 57343), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))

    def decoded(e):
        number = F.when(e.rlike("^&#[xX]"), F.conv(e.substr(F.lit(4), F.length(e) - 4), 16, 10).cast("long")).when(e.startswith("&#"), e.substr(F.lit(3), F.length(e) - 3).cast("long"))
        named = lambda n: F.try_element_at(F.try_element_at(names, F.substring(n, 1, 2)), n)
        found = F.lit(None).cast("string")
        for name, char in FREQUENT.items():
            found = F.when(e == f"&{name};", char).otherwise(found)
        return F.coalesce(found, F.when(e.startswith("&#"), point(number)).otherwise(named(e.substr(F.lit(2), F.length(e) - 2))), e)

    def joined(t):
        gaps, refs = F.split(t, REFERENCE, -1), F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(0))
        return F.array_join(F.zip_with(gaps, refs, lambda gap, e: F.concat(gap, F.coalesce(decoded(e), F.lit("")))), "")

    return let(c, lambda t: F.when(t.contains("&"), joined(t)).otherwise(t))


def clean_html(c: Column) -> Column:
    """Scripts and styles dropped, tags to blanks, character references decoded, white space collapsed; null is empty."""
    c = F.coalesce(c, F.lit(""))
    for tag in ("script", "style"):
        c = F.regexp_replace(c, rf"(?is)<{tag}[^>]*>.*?</{tag}\s*>", " ")
    return strip(F.regexp_replace(unescaped(F.regexp_replace(c, r"(?s)<[^>]*>", " ")), r"(?U)\s+", " "))


def is_page_header(fragment: Column) -> Column:
    """A header element whose text names a chapter, and whose own style, if any, has the font size of chapter headers."""
    attributes = F.regexp_extract(fragment, r"(?is)^\s*<header\b([^>]*)>", 1)
    style = F.regexp_replace(F.lower(F.regexp_extract(attributes, r"(?is)\bstyle\s*=\s*(['\"])(.*?)\1", 2)), r"\s+", "")
    words = F.regexp_replace(unescaped(F.regexp_replace(fragment, r"(?s)<[^>]+>", " ")), r"(?U)\s+", " ")
    named = fragment.rlike(r"(?is)^\s*<header\b[^>]*>") & words.rlike(r"(?i)\bchapter \d+\b")
    return F.coalesce(named & ((style == "") | style.contains("font-size:18px")), F.lit(False))


def split_pages(html: Column, mode: str = "all") -> Column:
    """struct<pages, n>: cut before every whole header element, or before those that name a chapter ("validated"), of which
    there are n; what stands before the first header is in the first page; blank pages go; no HTML is an error."""
    if mode not in ("all", "validated"):
        raise ValueError(f"unknown mode {mode}")
    mark = "\ue000"
    header = r"(?is)<header\b[^>]*>.*?</header\s*>"

    def marked(t):
        all_ = F.regexp_replace(t, header, mark + "$0")
        if mode == "all":
            return all_
        element = lambda p: F.regexp_extract(p, "(?is)^" + header.removeprefix("(?is)"), 0)
        kept = lambda p, i: F.when((i > 0) & is_page_header(element(p)), F.concat(F.lit(mark), p)).otherwise(p)
        return F.array_join(F.transform(F.split(all_, mark, -1), kept), "")

    def cut(parts):
        # the first two are one page, all others are as they are
        first = F.when(F.size(parts) > 1, F.concat(parts[0], F.get(parts, F.lit(1)))).otherwise(parts[0])
        pages = F.concat(F.array(first), F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))))
        return F.struct(F.filter(pages, lambda p: p.rlike(r"(?U)\S")).alias("pages"), (F.size(parts) - 1).cast("long").alias("n"))

    whole = F.when(html.rlike(r"(?U)\S"), html).otherwise(F.raise_error(F.lit("no HTML")).cast("string"))
    return let(F.split(let(whole, marked), mark, -1), cut)


def split_at_headers(html: Column, mode: str = "all") -> tuple[Column, Column]:
    """(pages, number of headers) of split_pages, which a plan that needs both puts in a column once."""
    got = split_pages(html, mode)
    return got["pages"], got["n"]


def token_windows(text: Column, size: int = 384, overlap: int = 64) -> Column:
    """array<struct<token_start, token_end, text>> of windows of words; one window keeps the text itself."""
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size")
    stride = size - overlap

    def cut(w):
        n = F.size(w)
        one = F.array(F.struct(F.lit(0).alias("token_start"), n.alias("token_end"), text.alias("text")))
        steps = F.sequence(F.lit(0), F.ceil((n - size) / F.lit(stride)).cast("int"))
        many = F.transform(steps, lambda i: F.struct((i * stride).alias("token_start"), F.least(i * stride + size, n).alias("token_end"), F.array_join(F.slice(w, i * stride + 1, size), " ").alias("text")))
        return F.when(n == 0, F.slice(one, 1, 0)).when(n <= size, one).otherwise(many)

    return F.transform(F.array(words(text)), cut)[0]


def parse_answer(c: Column) -> Column:
    """The letter of the last "final answer", else of the last bracketed one, else null; lower case."""
    last = lambda p: F.try_element_at(F.regexp_extract_all(c, F.lit(p), F.lit(1)), F.lit(-1))
    return F.lower(F.coalesce(last(ANSWER), last(BARE)))


def clip(c: Column, most: int) -> Column:
    """At most so many characters, back to the last blank, with an ellipsis."""
    head = F.substring(c, 1, most)
    at = F.length(head) - F.instr(F.reverse(head), " ")
    cut = F.when(F.instr(head, " ") > 0, head.substr(F.lit(1), at)).otherwise(head)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(cut, F.lit("...")))


def format_context(texts: Column, most: int = 4500) -> Column:
    """Numbered blocks of stripped texts under a header that counts them; nothing for no texts."""
    blocks = F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] Text:\n"), clip(strip(t), most)))
    n = F.size(texts)
    head = F.concat(F.lit("### Retrieved "), F.when(n == 1, "excerpt").otherwise("excerpts"), F.lit(" (top-"), n.cast("string"), F.lit(")\n"))
    return F.when(n <= 0, "").otherwise(F.concat(head, F.array_join(blocks, "\n\n")))


def stable_tag(c: Column) -> Column:
    """A safe file name: the repository part of a cached model path or the base name, then 8 digits of SHA-256."""
    cached = F.regexp_extract(c, r"models--([^/]+)", 1)
    base = F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1)
    name = F.regexp_replace(F.when(cached != "", cached).otherwise(base), "[^A-Za-z0-9_.-]+", "_")
    return F.concat_ws("-", name, F.left(F.sha2(c, 256), F.lit(8)))


def join_key(c: Column) -> Column:
    """Canonical key text: null is empty, whole numbers lose their fraction, else trimmed text."""
    t = strip(c.cast("string"))
    number = F.when(t.rlike(r"^[+-]?\d{1,15}(?:\.0*)?$"), F.regexp_replace(t, r"\.0*$", ""))
    return F.coalesce(number, t, F.lit(""))


def text_hash(c: Column) -> Column:
    return F.sha2(strip(c), 256)
