"""Quality rules by tokeniser fertility.

Public vocabularies measure how a text splits: characters per token, the share of tokens that fall back to
lone bytes, and the entropy of tokens. A text is rejected where a measure leaves the band of its script under any of
the vocabularies.
One pass over the rows without any shuffle.

Defined cases: null and empty texts have no words and fail the base rule; repeated rows are judged each for
itself; an empty table gives an empty result; other columns are ignored by `measure`, kept by `keep`.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import batches_of, bpe, encoded, rows

VOCABULARIES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")
#: For each script the least and most characters a token, the most byte-fallback share, and the least token
#: entropy as a share of what as many tokens could have; under a vocabulary of English text, which cuts others short.
ENGLISH = {
    "LATIN": (1.4, 9.0, 0.25, 0.40),
    "GREEK": (0.5, 8.0, 0.75, 0.35),
    "CYRILLIC": (0.5, 8.0, 0.75, 0.35),
    "ARABIC": (0.4, 8.0, 0.85, 0.35),
    "HEBREW": (0.4, 8.0, 0.85, 0.35),
    "CJK": (0.2, 4.0, 0.98, 0.30),
    "HIRAGANA": (0.2, 4.0, 0.98, 0.30),
    "HANGUL": (0.2, 4.0, 0.98, 0.30),
    "OTHER": (0.2, 12.0, 1.0, 0.30),
}
#: The same under a vocabulary of many languages: prose of any Latin language comes out near 2 and more, symbols between
#: words bring it under 1.75.
MANY = {
    **ENGLISH,
    "LATIN": (1.8, 9.0, 0.10, 0.40),
    "GREEK": (0.9, 8.0, 0.50, 0.40),
    "CYRILLIC": (1.2, 8.0, 0.30, 0.40),
    "ARABIC": (0.8, 8.0, 0.60, 0.40),
    "HEBREW": (0.6, 8.0, 0.80, 0.40),
    "CJK": (0.4, 4.0, 0.90, 0.35),
    "HIRAGANA": (0.4, 4.0, 0.90, 0.35),
    "HANGUL": (0.4, 4.0, 0.90, 0.35),
}
#: Bands by vocabulary; others have those of English text.
BANDS = {"byte_bpe_multi_50k.tiktoken": MANY}
#: Characters that count as symbols (fixed values).
SYMBOLS = b"#*$%&|<>"
#: Bound of a worker's memo of words.
MEMO = 400_000

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "script string, chars_per_token double, byte_share double, token_entropy double, rejected_by string, kept boolean"
)


def base_counts(data: bytes) -> tuple[int, int, int, int, int, list[bytes]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the words of a whole text."""
    words = data.split()
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    symbols = sum(map(data.count, map(bytes, ([x] for x in SYMBOLS))))
    lines = [x for x in data.split(b"\n") if x.split()]
    dup = len(lines) - len(set(lines))
    ids: dict[bytes, int] = {}
    seq = [ids.setdefault(w, len(ids)) for w in words]
    windows = Counter(zip(seq, seq[1:], seq[2:], strict=False))
    repeat = 0
    if len(windows) < len(seq) - 2:
        end = 0
        for i, w in enumerate(zip(seq, seq[1:], seq[2:], strict=False)):
            if windows[w] > 1:
                repeat += i + 3 - max(end, i)
                end = i + 3
    return len(words), chars, symbols, dup, repeat, words


def script_of(text: str) -> str:
    """The script of most letters, from their Unicode names; texts in ASCII are Latin."""
    if text.isascii():
        return "LATIN"
    n: Counter = Counter()
    for c, k in Counter(text).items():
        if c.isalpha():
            n[unicodedata.name(c, "OTHER").split(" ")[0].split("-")[0]] += k
    if not n:
        return "OTHER"
    top = min(n, key=lambda s: (-n[s], s))
    return top if top in ENGLISH else "OTHER"


class Fertility:
    """Characters per token, byte share and entropy of words under one vocabulary, with a bounded memo."""

    def __init__(self, file: str):
        self.enc, self.memo, self.bands = bpe(file), {}, BANDS.get(file, ENGLISH)
        self.lone = set()
        for i in range(self.enc.n_vocab):
            try:
                b = self.enc.decode_single_token_bytes(i)
            except KeyError:
                continue
            try:
                b.decode()
            except UnicodeDecodeError:
                self.lone.add(i)

    def ids(self, w: bytes) -> tuple:
        """The word's tokens, from the memo if there."""
        ids = self.memo.get(w)
        if ids is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            ids = tuple(self.enc.encode_ordinary(" " + w.decode("utf-8", "replace")))
            if len(w) <= 64:
                self.memo[w] = ids
        return ids

    def __call__(self, words: list[bytes]) -> tuple[int, int, float]:
        """Tokens, byte-fallback tokens, and entropy in bits of one text's words."""
        tokens = Counter(chain.from_iterable(map(self.ids, words)))
        total = sum(tokens.values())
        back = sum(tokens[i] for i in self.lone & tokens.keys())
        n = np.fromiter(tokens.values(), np.float64, len(tokens))
        entropy = math.log2(total) - float(n @ np.log2(n)) / total if total else 0.0
        return total, back, entropy


def judge(text: str | None, meters: list) -> tuple:
    data = encoded(text)
    n_words, chars, symbols, dup, repeat, words = base_counts(data)
    failed = n_words < 50 or 100 * repeat > 50 * n_words
    script = script_of(text or "")
    per, share, even, why = [], [], [], []
    for m in meters:
        low, high, most, least = m.bands[script]
        total, back, entropy = m(words)
        per.append(chars / total if total else 0.0)
        share.append(back / total if total else 0.0)
        even.append(entropy / math.log2(min(total, 4096)) if total > 1 else 0.0)
        if not total:
            continue
        why += ["chars_per_token"] * (not low <= per[-1] <= high) + ["byte_share"] * (share[-1] > most) + ["token_entropy"] * (even[-1] < least)
    return n_words, chars, symbols, dup, repeat, failed, script, min(per), min(share), max(even), ",".join(dict.fromkeys(why)), not (why or failed)


def measure(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", vocabularies=VOCABULARIES) -> DataFrame:
    """The counts, measures and verdict of every row, with its id."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = docs.schema[id_col].dataType
    schema = docs.sparkSession.createDataFrame([], "id long, " + SCHEMA).schema
    schema["id"].dataType = kind
    arrow = to_arrow_schema(schema)

    def run(batches):
        meters = [Fertility(v) for v in vocabularies]
        yield from batches_of(((k, *judge(t, meters)) for k, t in rows(batches, "id", "text")), arrow)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def keep(docs: DataFrame, text_col: str = "text", vocabularies=VOCABULARIES) -> DataFrame:
    """The rows of docs that pass, with all their columns and nothing else."""
    schema = docs.schema

    def run(batches):
        import pyarrow as pa

        meters = [Fertility(v) for v in vocabularies]
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            yield b.filter(pa.array([judge(t, meters)[-1] for t in texts], pa.bool_()))

    return docs.mapInArrow(run, schema)
