"""Phrase collocations: generalised suffix automata of shards, counts reduced over all of them, and suffix links.

A shard is a run of pieces of one language. Its automaton is made from its words in bulk: the tree of suffix links is the
tree of the words read backwards from each end, level by level down to the depth asked for, where the places below a node
are its endpos. A node whose only longer form has as many places is the same state as that form, so a state is
its longest substring, how short it may be cut from the left, and its endpos count. States are enumerated into substrings
(those of one state share its count), and counts are summed over shards by phrase.

A phrase is no more frequent than the phrases in it. First turns count hashes of all pairs, then of the triples whose pairs
are frequent; the automata read only runs of frequent pairs, and their longer substrings are spelt out only where those
inside are frequent. These are told by bitmaps of bounded size, whose chance hits cost counts that are dropped
afterwards, never a phrase. A longer phrase subsumes those that its suffix links lead to, with words cut from
the right too.

Defined cases: null and empty texts and pieces without words have no phrases; a null language is `und` (one with the
language of that name); rows that repeat an id count each; rows of an empty table give an empty result; ids and other
columns are ignored. Scores are whole numbers, worked out in decimals of 38 digits.
"""

from __future__ import annotations

import collections
import itertools

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.llm.common import LOWER, U64, cut, encoded, hot_limit, met, mix64, rows

LEAST, LONGEST, COVER, TOP = 30, 4, 80, 2000
UND = "und"
SCALE = 2_000_000
#: Words of a shard of hashes and of one with an automaton (about so many), and bytes of a text that are split at once.
PAIRS, SHARD, BLOCK = 1 << 22, 1 << 20, 1 << 21
#: Bits of the map of frequent pairs: for each pair, at least, and at most (32 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 16, 28
#: A top list is cut in so many groups before its language's.
GROUPS = 64
_BREAK = b"\xff"  # in no UTF-8
_M = U64(0x9E3779B97F4A7C15)


def _table() -> bytes:
    t = bytearray(LOWER)
    for c in b".,;:!?\x0a\x0b\x0c\x0d":
        t[c] = 0xFF
    t[9] = 32
    return bytes(t)


TABLE = _table()


def blocks(data: bytes, size: int = BLOCK):
    """data in blocks of about a size, cut at blanks."""
    at = 0
    while len(data) - at > size:
        end = data.find(b" ", at + size)
        if end < 0:
            break
        yield data[at:end]
        at = end
    yield data[at:]


def tokens(text: str | None):
    """Lists of a text's lower-cased words, with a break between pieces and at the end."""
    data = encoded(text).translate(TABLE)
    for b in blocks(data):
        yield b.replace(_BREAK, b" \xff ").split()
    yield [_BREAK]


def automaton(words: np.ndarray, depth: int, skip: int = 0):
    """(end, length, shortest, count) of each state of the suffix automaton of words (0: a break), to a depth.

    A state's substrings end at place `end` and have `shortest` to `length` words; its suffix link is the state of
    shortest - 1 words. Substrings that end before `skip` are not counted.
    """
    n = len(words)
    at = np.flatnonzero(words[skip:]) + skip
    base = int(words.max(initial=0)) + 1
    levels = []
    node = words[at].astype(np.int64)
    for d in range(1, depth + 1):
        if d > 1:
            into = at - d + 1
            longer = into >= 0
            longer[longer] = words[into[longer]] > 0
            parent, at = node[longer], at[longer]
            node = parent * base + words[at - d + 1]
        ids, first, node, count = np.unique(node, return_index=True, return_inverse=True, return_counts=True)
        up = ids // base if d > 1 else None
        levels.append([at[first], np.full(len(ids), d, np.int64), count, np.ones(len(ids), bool), up])
        if not len(at):
            break
    for (_, _, more, last, _), (_, shortest, count, _, up), before in zip(levels, levels[1:], levels, strict=False):
        same = count == more[up]  # a parent with as many places is no state of its own
        last[up[same]] = False
        shortest[same] = before[1][up[same]]
    out = [(e[k], np.full(int(k.sum()), d, np.int64), s[k], c[k]) for d, (e, s, c, k, _) in enumerate(levels, 1)]
    return tuple(np.concatenate(x) if out else np.empty(0, np.int64) for x in zip(*out, strict=True)) if n else (np.empty(0, np.int64),) * 4


def word_hashes(names: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, names), U64, len(names))


def gram_hashes(lang: str, hashes: np.ndarray, words: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the phrases of a size that end at these places."""
    acc = np.zeros(len(ends), U64)
    with np.errstate(over="ignore"):
        for k in range(size - 1, -1, -1):
            acc = acc * _M + hashes[words[ends - k]]
        return mix64(acc + U64(xxhash.xxh3_64_intdigest(lang.encode(), seed=size)))


class Frequent:
    """Bitmaps of the hashes of frequent phrases, by size."""

    def __init__(self, maps: dict[int, tuple[np.ndarray, int]]):
        self.maps = maps

    def has(self, size: int, h: np.ndarray) -> np.ndarray:
        bits, n = self.maps[size]
        place = (h >> U64(64 - n)).astype(np.int64)
        return (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1

    def inside(self, lang, hashes, words, ends, size: int) -> np.ndarray:
        """Whether both phrases of a word less in the phrases that end at these places are frequent."""
        if size - 1 not in self.maps:
            return np.ones(len(ends), bool)
        ok = self.has(size - 1, gram_hashes(lang, hashes, words, ends, size - 1))
        ok[ok] = self.has(size - 1, gram_hashes(lang, hashes, words, ends[ok] - 1, size - 1))
        return ok


class Shard:
    """Words of a task by language, up to a number; a text that goes on in the next shard takes its last words along."""

    def __init__(self, carry: int):
        self.carry = carry
        self.parts: dict[str, list[np.ndarray]] = collections.defaultdict(list)
        self.carried: dict[str, int] = collections.defaultdict(int)
        self.new()

    def new(self):
        self.ids = collections.defaultdict(itertools.count(1).__next__)
        self.ids[_BREAK] = 0
        self.n = 0

    def add(self, lang: str, words: list[bytes]):
        self.parts[lang].append(np.array(list(map(self.ids.__getitem__, words)), np.int32))
        self.n += len(words)

    def taken(self):
        """(words by id, [(lang, words, how many of them were counted before)]); begins anew."""
        names = sorted(self.ids, key=self.ids.__getitem__)
        out = [(lang, np.concatenate(parts), self.carried[lang]) for lang, parts in self.parts.items()]
        self.parts.clear()
        self.carried.clear()
        self.new()
        for lang, words, _ in out:
            if words[-1] != 0:
                tail = [names[i] for i in words[-self.carry :]]
                self.add(lang, tail)
                self.carried[lang] = len(tail)
        self.n = 0
        return names, out


def shards(texts, carry: int, size: int):
    """Shards of (lang, text) pairs."""
    s = Shard(carry)
    for lang, text in texts:
        for words in tokens(text):
            s.add(lang, words)
            if s.n >= size:
                yield s.taken()
    if s.n:
        yield s.taken()


def places(words: np.ndarray, size: int, skip: int) -> np.ndarray:
    """Where phrases of a size end, without those counted before."""
    ok = np.ones(max(len(words) - size + 1, 0), bool)
    for k in range(size):
        ok &= words[k : len(words) - size + 1 + k] > 0
    ends = np.flatnonzero(ok) + size - 1
    return ends[ends >= skip]


def runs(words: np.ndarray, near: np.ndarray, skip: int) -> tuple[np.ndarray, int]:
    """Runs of words that pairs hold together, apart by breaks, and how much of it was counted before."""
    before, behind = np.concatenate(([False], near)), np.concatenate((near, [False]))
    kept = before | behind
    starts = kept & ~before  # a break goes in front of each run
    place = np.cumsum(kept.astype(np.int64) + starts) - 1
    out = np.zeros(int(place[-1]) + 1, np.int64)
    out[place[kept]] = words[kept]
    return out, int(place[skip - 1] + 1) if skip else 0


def frequent_hashes(docs: DataFrame, size: int, known: Frequent, least: int, text_col: str, lang_col: str, shard: int) -> DataFrame:
    """(h) of phrases of a size, by hash, that stand `least` times or more (and some more by chance), if those inside do."""
    held = docs.sparkSession.sparkContext.broadcast(known.maps)

    def run(batches):
        import pyarrow as pa

        known = Frequent(held.value)
        for names, parts in shards(rows(batches, "lang", "text"), size, shard):
            hashes, found = word_hashes(names), []
            for lang, words, skip in parts:
                ends = places(words, size, skip)
                found.append(gram_hashes(lang, hashes, words, ends[known.inside(lang, hashes, words, ends, size)], size))
            found = np.sort(np.concatenate(found))
            first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))[: len(found)])
            f = np.diff(np.append(first, len(found)))
            for i in range(0, len(first), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(found[first[i : i + (1 << 17)]].view(np.int64)), pa.array(f[i : i + (1 << 17)].astype(np.int64))], names=["h", "f"])

    counted = _texts(docs, text_col, lang_col).mapInArrow(run, "h long, f long").groupBy("h").agg(F.sum("f").alias("f"))
    return counted.where(F.col("f") >= least).select("h")


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UND)).alias("lang"), F.col(text_col).alias("text"))


def _bitmap(hashes: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Bits of hashes (h), and how many of a hash's first bits tell its place."""
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * max(n, 1) - 1).bit_length()))
    low = min(bits, 20)  # so many bits are a row

    def packed(batches):
        import pyarrow as pa

        held: dict[int, np.ndarray] = {}
        for b in batches:
            block, bit = (b.column(i).to_numpy() for i in (0, 1))
            for k in np.unique(block).tolist():
                held.setdefault(k, np.zeros(1 << low, bool))[bit[block == k]] = True
        for k, v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.packbits(v).tobytes()])], names=["block", "bits"])

    place = F.shiftrightunsigned("h", 64 - bits)
    spread = hashes.select(F.shiftright(place, low).alias("block"), place.bitwiseAND(F.lit((1 << low) - 1)).alias("bit"))
    spread = spread.repartition(max(1, (1 << (bits - low)) // 8), "block")
    out = np.zeros((1 << (bits - low), 1 << (low - 3)), np.uint8)
    for r in spread.mapInArrow(packed, "block long, bits binary").toLocalIterator():  # 32 MB at most
        out[r.block] |= np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1), bits


def counts(docs: DataFrame, longest: int, known: Frequent, text_col: str = "text", lang_col: str = "lang", shard: int = SHARD) -> DataFrame:
    """(lang, size, phrase, f) of words, and of longer phrases that may be frequent; size 0 is the language's number of words."""
    held = docs.sparkSession.sparkContext.broadcast(known.maps)

    def batch(lang, size, phrases, f):
        import pyarrow as pa

        for i in range(0, len(phrases), 1 << 16):
            some = phrases[i : i + (1 << 16)]
            columns = [pa.repeat(pa.scalar(lang), len(some)), pa.repeat(pa.scalar(size, pa.int32()), len(some)), pa.array(some, pa.string()), pa.array(f[i : i + (1 << 16)].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "size", "phrase", "f"])

    def run(batches):
        known = Frequent(held.value)
        for names, parts in shards(rows(batches, "lang", "text"), longest, shard):
            hashes = word_hashes(names)
            names = ["", *(w.decode("utf-8", "replace") for w in names[1:])]
            for lang, words, skip in parts:
                own = words[skip:]
                f = np.bincount(own)
                seen = np.flatnonzero(f[1:]) + 1
                yield from batch(lang, 0, [""], np.array([np.count_nonzero(own)]))
                yield from batch(lang, 1, [names[i] for i in seen.tolist()], f[seen])
                near = np.zeros(max(len(words) - 1, 0), bool)
                ends = places(words, 2, 0)
                near[ends[known.has(2, gram_hashes(lang, hashes, words, ends, 2))] - 1] = True
                apart, before = runs(words, near, skip)
                end, length, shortest, f = automaton(apart, longest, before)
                for size in range(2, longest + 1):
                    has = (shortest <= size) & (size <= length)
                    at, n = end[has], f[has]
                    if size > 2:
                        ok = known.has(size, gram_hashes(lang, hashes, apart, at, size)) if size in known.maps else known.inside(lang, hashes, apart, at, size)
                        at, n = at[ok], n[ok]
                    spelt = [map(names.__getitem__, apart[at - k].tolist()) for k in range(size - 1, -1, -1)]
                    yield from batch(lang, size, list(map(" ".join, zip(*spelt, strict=True))), n)

    made = _texts(docs, text_col, lang_col).mapInArrow(run, "lang string, size int, phrase string, f long")
    return made.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))


def _share(a, b) -> str:
    """floor(SCALE * a / b) of SQL expressions, exactly."""
    return f"cast({SCALE} as decimal(7,0)) * cast({a} as decimal(20,0)) div ({b})"


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang", shard: int | None = None) -> DataFrame:
    """(lang, size, phrase, f) of all phrases of up to longest words with f >= least, and of each language (size 0)."""
    known = Frequent({})
    for size in range(2, max(3, longest)):
        hashes = cut(frequent_hashes(docs, size, known, least, text_col, lang_col, shard or PAIRS))
        known.maps[size] = _bitmap(hashes, hashes.count())
    found = counts(docs, longest, known, text_col, lang_col, shard or SHARD)
    return cut(found.where((F.col("f") >= least) | (F.col("size") == 0)))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, cover: int = COVER, top: int = TOP, shard: int | None = None) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score."""
    known = frequent_phrases(docs, least, longest, text_col, lang_col, shard)
    n = known.where("size = 0").select("lang", F.col("f").alias("n"))
    words = F.split("phrase", " ")
    found = known.where("size >= 2")
    # suffix links from each longer phrase, with words cut from the right too: all that lies inside it
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
    covered = found.where("size >= 3").select("lang", F.explode(inside).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    free = found.join(covered, ["lang", "phrase"], "left")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    free = cut(free.where(F.col("longer").isNull() | (wide("longer") * 100 < wide("f") * cover)).select("lang", "phrase", "size", F.col("f").alias("a")))
    part = lambda start, size: F.array_join(F.slice(words, start, size), " ")
    cuts = free.select("lang", "phrase", "size", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    # a frequent word is a part of many phrases: parts of many cuts go to them, only the others are dealt out
    asked = cuts.select("lang", F.explode(F.array("first", "rest")).alias("phrase")).groupBy("lang", "phrase").agg(F.count("*").alias("times"))
    table = cut(asked.join(known.where("size > 0").select("lang", "phrase", "f"), ["lang", "phrase"]))
    rows_, most = table.agg(F.sum("times"), F.max("times")).first()
    limit = hot_limit(rows_ or 0)
    side = lambda name, f: table.select("lang", F.col("phrase").alias(name), F.col("f").alias(f), F.col("times").alias(f"_{f}"))
    both = met(cuts, side("first", "l"), ["lang", "first"], "_l", limit, most=most or 0)
    both = met(both, side("rest", "r"), ["lang", "rest"], "_r", limit, most=most or 0)
    score = F.expr(_share("a", "cast(l as decimal(20,0)) + cast(r as decimal(20,0))"))
    worst = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.score", "c.l", "c.r")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    group = F.pmod(F.xxhash64("phrase"), F.lit(GROUPS))
    first = worst.withColumn("_g", group).withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_g").orderBy(*order))).where(F.col("_n") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same in SQL.
ORACLE = r"""
with p as (
  select row_number() over () as d, coalesce(lang, 'und') as lang,
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as pieces
  from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from (select lang, unnest(pieces) as piece from p)),
g as (
  select lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) as phrase
  from w, (select unnest([1, 2, 3, 4]) as m) where len(w) >= m),
n as (select lang, count(*) as n from g where m = 1 group by lang),
f as (select lang, m, phrase, string_split(phrase, ' ') as w, count(*) as f from g group by lang, m, phrase having count(*) >= 30),
inside as (
  select lang, array_to_string(w[i:i + k - 1], ' ') as phrase, max(f) as longer
  from (select f.*, k, unnest(range(1, m - k + 2)) as i from f, (select unnest([2, 3]) as k) where k < m) group by 1, 2),
free as (select f.* from f left join inside using (lang, phrase) where m >= 2 and (longer is null or 100 * longer::hugeint < 80 * f.f::hugeint)),
cuts as (select lang, phrase, f as a, k, array_to_string(w[1:k], ' ') as x, array_to_string(w[k + 1:], ' ') as y from (select *, unnest(range(1, m)) as k from free)),
s as (
  select c.lang, c.phrase, a, k, l.f as l, r.f as r, (2000000 * a::hugeint) // (l.f::hugeint + r.f::hugeint) as score
  from cuts c join f l on l.lang = c.lang and l.phrase = x join f r on r.lang = c.lang and r.phrase = y),
worst as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, cast(row_number() over (partition by lang order by score desc, a desc, phrase) as bigint) as rank, phrase, cast(a as bigint) as a,
  cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n, cast(score as bigint) as score
from worst join n using (lang) qualify rank <= 2000
"""
