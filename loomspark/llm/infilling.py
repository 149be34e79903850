"""Fill-in-middle transformation of whole texts, cut at units found by an Aho-Corasick event scan.

A unit is a run of white space with the word behind it, or the white space at a text's end. One automaton goes over a
text once and reports its events: the ASCII characters that change the class of what stands around them (white space),
and sentinels. Between two events next to each other lies a gap: with something in it, it holds one word and so ends
one unit; without, none. Units are so counted from the sparse events alone, and the end of the unit of a given rank is
looked up among the gaps that hold something; nothing is kept for any other character.

Two cuts are drawn for each document from a hash of its id. Texts become suffix-prefix-middle or prefix-suffix-middle,
or stay plain; texts that hold a sentinel stay plain, so that every output can be turned back.

Defined cases: a null text is empty; an empty text has no unit and stays plain; a row without an id draws from an empty
id; rows that repeat an id draw alike, each for its own text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import batches_of, rows

#: Characters that change the class, and sentinels (fixed values).
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
SEED, RATE, SPM_RATE = 42, 50, 80
SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"


def automaton():
    """One automaton over white space (0) and sentinels (1)."""
    import ahocorasick

    a = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for c in SPACE:
        a.add_word(c, 0)
    for s in (PREFIX, SUFFIX, MIDDLE):
        a.add_word(s, 1)
    a.make_automaton()
    return a


def events(text: str, a) -> tuple[np.ndarray, int]:
    """(places of white space, number of sentinels)."""
    sentinels = 0

    def spaces():
        nonlocal sentinels
        for at, kind in a.iter(text):
            if kind:
                sentinels += 1
            else:
                yield at

    return np.fromiter(spaces(), np.int64), sentinels


class Units:
    """The number of a text's units, and where the unit of a rank ends, from its events."""

    def __init__(self, spaces: np.ndarray, length: int):
        before = np.concatenate(([-1], spaces))
        behind = np.concatenate((spaces, [length]))
        self.ends = behind[behind - before > 1]  # a gap that holds something is one word, and ends a unit
        self.length = length
        self.n = len(self.ends) + int(length > 0 and len(spaces) > 0 and spaces[-1] == length - 1)

    def end(self, rank: int) -> int:
        """Code points in the first `rank` units."""
        return 0 if rank == 0 else int(self.ends[rank - 1]) if rank <= len(self.ends) else self.length


def draws(key: str, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers of a document: the first groups of eight digits of the SHA-256 of seed and id."""
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(h[i : i + 8], 16) for i in (0, 8, 16, 24))


def infilled(key: str, text: str | None, a, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    text = text or ""
    spaces, sentinels = events(text, a)
    units = Units(spaces, len(text))
    h1, h2, h3, h4 = draws(key, seed)
    if not text or sentinels or h3 % 100 >= rate:
        return units.n, PLAIN, None, None, text
    low, high = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    p, m = units.end(low), units.end(high)
    if h4 % 100 < spm_rate:
        return units.n, SPM, p, m - p, f"{SUFFIX}{text[m:]}{PREFIX}{text[:p]}{MIDDLE}{text[p:m]}"
    return units.n, PSM, p, m - p, f"{PREFIX}{text[:p]}{SUFFIX}{text[m:]}{MIDDLE}{text[p:m]}"


def fill_in_middle(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """One row for each row of docs: id, units, form, lengths and the output text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = docs.sparkSession.createDataFrame([], "id long, " + SCHEMA).schema
    schema["id"].dataType = docs.schema[id_col].dataType
    arrow = to_arrow_schema(schema)

    def run(batches):
        a = automaton()
        made = ((k, *infilled("" if k is None else str(k), t, a, seed, rate, spm_rate)) for k, t in rows(batches, "id", "text"))
        yield from batches_of(made, arrow, 256)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of; each sentinel stands in it once."""
    body, last = F.substr(output, F.lit(len(PREFIX) + 1)), F.substring_index(output, MIDDLE, -1)
    second = lambda s: F.substring_index(F.substring_index(output, s, -1), MIDDLE, 1)
    psm = F.concat(F.substring_index(body, SUFFIX, 1), last, second(SUFFIX))
    spm = F.concat(second(PREFIX), last, F.substring_index(body, PREFIX, 1))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def digests(made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of fill_in_middle with hashes in place of the output and of the text restored from it."""
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    o = F.col("output")
    return made.select(id_col, "n", "form", "prefix_chars", "middle_chars", sha(o).alias("output_sha256"), sha(restored(o, F.col("form"))).alias("restored_sha256"))


#: The same in SQL.
ORACLE = r"""
with t as (
  select doc_id, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u,
    sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h
  from documents),
d as (
  select doc_id, text, u, cast(len(u) as bigint) as n,
    cast('0x' || substr(h, 1, 8) as ubigint) % (len(u) + 1) as c1, cast('0x' || substr(h, 9, 8) as ubigint) % (len(u) + 1) as c2,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or cast('0x' || substr(h, 17, 8) as ubigint) % 100 >= 50 then 'plain'
      when cast('0x' || substr(h, 25, 8) as ubigint) % 100 < 80 then 'spm' else 'psm' end as form
  from t),
p as (
  select doc_id, text, n, form, array_to_string(u[1:cast(least(c1, c2) as bigint)], '') as pre,
    array_to_string(u[cast(least(c1, c2) as bigint) + 1:cast(greatest(c1, c2) as bigint)], '') as mid,
    array_to_string(u[cast(greatest(c1, c2) as bigint) + 1:], '') as suf
  from d)
select doc_id, n, form, case when form <> 'plain' then cast(length(pre) as bigint) end as prefix_chars,
  case when form <> 'plain' then cast(length(mid) as bigint) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
    else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""
