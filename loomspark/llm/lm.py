"""LM scoring by online logistic context mixing over bits.

A text is its lower-cased words and one end. Each token is coded by binary decisions, then drawn by counts or spelt:

1. Is it the word that followed the last place of the word before it, in this text? (where that word stood before)
2. Is it drawn from the text so far, by its count there? A word may come by this way or the next; both chances add up.
3. Is it a frequent word of training? Then it is drawn by its training count in texts of this class (below).
4. Otherwise it is a rare word of training, drawn by its count, or an unknown one, spelt bit by bit.

Every decision and every bit of a letter is predicted by several predictors that keep counts in hashed contexts (words
before, outcomes of the last decisions, place, rate of outcomes in this text; for letters the 1 to 4 bytes before, and
the word so far). Their stretched estimates are combined by logistic mixing with weights that a gate selects, learned
online by gradient steps as training texts stream by; an adaptive probability map refines the result. At scoring, words,
outcomes and the class of the text itself are learned as it goes by, and nothing of other texts, so scores don't depend
on order or retries. The class is the likeliest of CLASSES mixtures of the most frequent words, given the words so far;
the mixtures are fitted to how often two of these words stand in one text, over all training texts.

What is gathered: exact counts of all tokens, in a distributed table that grows with the input and that rare tokens are
joined with; the decisions' contexts and weights, from all training texts; spelling tables over all distinct training
words, each predicted without its own count. Spelling tables are sized from the number of distinct words up to a bound of
memory; a slot has a check byte, so that beyond the bound contexts compete for slots but are not blurred. Only these tables
of bounded size and at most FREQUENT counts come to the driver and go to the executors.

Defined cases: a null or empty text is its end alone; repeated rows are scored each for itself; a null doc_id counts as
empty text and is in training; without training rows all bits are even; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import LOWER, U64, cut, encoded, mix64, rows

ORDERS = (1, 2, 3, 4)
N_CTX = len(ORDERS) + 1
#: Least and most table bits of each spelling context (5.6 million slots in all), and of a block that tasks emit.
LEAST_BITS, MOST_BITS, BLOCK_BITS = 14, (16, 18, 20, 21, 21), 14
PAD = 4
END = b"\xff"
FOLDS, HELD = 5, 1
#: Tokens that tasks look up, their greatest length, and bytes of text in a batch.
FREQUENT, LONGEST, BATCH = 1 << 18, 64, 1 << 18
GATES = 8 * (N_CTX + 1)
APM_STEPS = 33
RATE = 0.12
_B = 0x9E3779B97F4A7C15 | 1
_BINV = pow(_B, -1, 2**64)
_END_TOKEN = b"\n"
_END_HASH = xxhash.xxh3_64_intdigest(_END_TOKEN)
#: Decisions, and the slots of each of a decision's contexts.
DECISIONS = 3
REGIONS = (128, 1024, 1 << 14, 1 << 16, 256, 1 << 14)
_REGION_AT = np.concatenate([[0], np.cumsum(REGIONS)])
_SLOTS = int(_REGION_AT[-1])
#: Classes of texts, words that tell them, words whose counts are kept by class, and the weight of their counts in all.
CLASSES, TELLING, CLASSED, PRIOR = 12, 64, 1 << 14, 5000.0


def fold(doc_id) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def tokens(text: str | None) -> list[bytes]:
    return encoded(text).translate(LOWER).split()


def slot_bits(n_words: int) -> tuple[int, ...]:
    """Table bits of each spelling context for so many distinct words."""
    need = max(n_words, 1).bit_length() + 2
    return tuple(min(b, max(LEAST_BITS, need)) for b in MOST_BITS)


class Contexts:
    """The distinct (contexts, byte) of a batch of words: bytes, context hashes, multiplicities, and where each place's is."""

    def __init__(self, words: list[bytes]):
        data = (END * PAD).join([b"", *(t + END for t in words)])
        b = np.frombuffer(data, np.uint8)
        lens = np.array([len(t) + 1 for t in words])
        self.starts = np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64)
        at = np.repeat(PAD * np.arange(1, len(words) + 1), lens) + np.arange(lens.sum())
        with np.errstate(over="ignore"):
            # the last bytes, packed
            wide, last = b.astype(U64), np.zeros(len(b), U64)
            for k in range(1, PAD + 1):
                last[k:] |= wide[:-k] << U64(8 * k - 8)
            # the word so far: a prefix hash taken back to the word's start
            power = np.cumprod(np.full(len(b) + 1, _B, U64))
            inverse = np.cumprod(np.full(len(b) + 1, _BINV, U64))
            prefix = np.zeros(len(b) + 1, U64)
            np.cumsum((wide + U64(1)) * power[:-1], out=prefix[1:])
            start = np.repeat(at[self.starts], lens)
            word = (prefix[at] - prefix[start]) * inverse[start]
            last = last[at]
            key = mix64(last * U64(_B) + mix64(word) + wide[at] * U64(0xD6E8FEB86659FD93))
            order = np.argsort(key)
            key = key[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            self.where = np.empty(len(key), np.int64)
            self.where[order] = np.cumsum(new) - 1
            self.times = np.diff(np.append(np.flatnonzero(new), len(key)))
            first = order[new]
            self.byte = wide[at[first]].astype(np.int64)
            last = last[first]
            self.ctx = [mix64((last & U64((1 << 8 * k) - 1)) + U64(k << 56)) for k in ORDERS]
            self.ctx.append(mix64(word[first] + U64(99 << 50)))

    def nodes(self, bits: tuple[int, ...]):
        """For each of the eight bits: its place, the node of bits so far, the bit, and each predictor's slots and checks."""
        offsets = [sum(1 << b for b in bits[:i]) for i in range(N_CTX)]
        for j in range(8):
            node = (1 << j) | (self.byte >> (8 - j))
            bit = (self.byte >> (7 - j)) & 1
            salt = mix64(node.astype(U64) * U64(0xA0761D6478BD642F))
            # contexts are mixed already: one multiplication spreads the node
            mixed = [(c ^ salt) * U64(_B) for c in self.ctx]
            yield j, node, bit, [((h >> U64(64 - n)).astype(np.int64) + at, (h & U64(255)).astype(np.uint8) | np.uint8(1)) for h, n, at in zip(mixed, bits, offsets, strict=True)]


def in_batches(pairs, most: int = BATCH):
    """Lists of (row, bytes) of bounded size."""
    out, size = [], 0
    for k, t in pairs:
        out.append((k, t))
        size += len(t) + 1
        if size >= most:
            yield out
            out, size = [], 0
    if out:
        yield out


def taken(weights, gate, x: list, err, spread) -> None:
    """One online step of the mixing weights of each gate, by the gradient of coding cost over its curvature."""
    for k, v in enumerate(x):
        curve = np.bincount(gate, spread * v**2, len(weights))
        weights[:, k] += RATE * np.bincount(gate, err * v, len(weights)) / (curve + 20)


def mixed(weights, gate, x: list) -> tuple[np.ndarray, np.ndarray]:
    """The mixed log odds, and its probability."""
    w = weights.astype(np.float32)
    z = w[gate, len(x)] * np.float32(0.3)
    for k, v in enumerate(x):
        z += w[:, k][gate] * v
    np.clip(z, -12, 12, out=z)
    return z, 1 / (1 + np.exp(-z))


def refined(apm, cell, p) -> np.ndarray:
    """p, half way to what the adaptive probability map has seen in its cell."""
    n = apm[cell]
    seen = (n[:, 1] + 8 * p) / (n[:, 0] + n[:, 1] + 8)
    return np.clip((p + seen) / 2, 1e-6, 1 - 1e-6)


def step_of(z) -> np.ndarray:
    return np.clip(np.rint((z + 8) * 2), 0, APM_STEPS - 1).astype(np.int64)


ALMOST = np.float32(0.2)


def odds(counts: np.ndarray) -> np.ndarray:
    """The estimate of each slot as log odds."""
    n = np.log(counts.astype(np.float32) + ALMOST)
    return n[:, 1] - n[:, 0]


class Model:
    """Spelling: tables, weights and map; predicts the bits of Contexts."""

    def __init__(self, bits: tuple[int, ...], counts: np.ndarray, checks: np.ndarray, weights=None, apm=None):
        self.layout, self.counts, self.checks = bits, counts, checks  # (slots of all contexts, 2), (slots,)
        self.weights = np.full((GATES, N_CTX + 1), 0.2) if weights is None else weights
        self.apm = np.zeros((256 * APM_STEPS, 2)) if apm is None else apm
        self.odds: np.ndarray | None = None

    def stretched(self, slot, check, own=None) -> np.ndarray:
        """The estimates as log odds, without the own bit if it is given; 0 where nothing was seen."""
        held = self.checks[slot] == check
        if own is None:
            if self.odds is None:
                self.odds = odds(self.counts)
            return self.odds[slot] * held
        n = self.counts[slot].astype(np.float32)
        return np.log((np.maximum(n[:, 1] - own, 0) + ALMOST) / (np.maximum(n[:, 0] - (1 - own), 0) + ALMOST)) * held

    def gate(self, j: int, x: list) -> np.ndarray:
        """Bit place and number of contexts with an estimate."""
        out = np.full(len(x[0]), j * (N_CTX + 1))
        for v in x:
            out += v != 0
        return out

    def bits(self, c: Contexts) -> np.ndarray:
        """Bits that each distinct byte costs."""
        cost = np.zeros(len(c.byte))
        for j, node, bit, slots in c.nodes(self.layout):
            x = [self.stretched(*s) for s in slots]
            z, p = mixed(self.weights, self.gate(j, x), x)
            p = refined(self.apm, node * APM_STEPS + step_of(z), p)
            cost -= np.log2(np.where(bit, p, 1 - p))
        return cost

    def learn(self, c: Contexts) -> None:
        """One online step for each bit place: weights, and the map's counts."""
        for j, node, bit, slots in c.nodes(self.layout):
            x = [self.stretched(*s, bit) for s in slots]
            gate = self.gate(j, x)
            z, p = mixed(self.weights, gate, x)
            taken(self.weights, gate, [*x, np.full(len(bit), 0.3)], (bit - p) * c.times, p * (1 - p) * c.times)
            cell = node * APM_STEPS + step_of(z)
            self.apm[:, 1] += np.bincount(cell, bit * c.times, len(self.apm))
            self.apm[:, 0] += np.bincount(cell, (1 - bit) * c.times, len(self.apm))


class Frequent:
    """The frequent tokens, by hash: counts, ranks, and the classes that the most frequent ones tell."""

    def __init__(self, hashes, counts, shares=None, telling=None):
        """hashes and counts from the most frequent on; shares and telling as from `classes`."""
        order = np.argsort(hashes)
        self.hashes, self.rank = hashes[order], order
        self.counts = np.append(counts.astype(np.float64), 0.0)
        self.total = max(float(self.counts.sum()), 1.0)
        self.rest = max(float(self.counts[CLASSED:].sum()), 1.0)
        self.shares = np.zeros(1) if shares is None else np.log(shares)
        self.telling = np.zeros((1, 0)) if telling is None else np.log(telling)

    def of(self, h: np.ndarray) -> np.ndarray:
        """Ranks of these hashes; of others the number of all."""
        n = len(self.hashes)
        if not n:
            return np.zeros(len(h), np.int64)
        i = np.minimum(np.searchsorted(self.hashes, h), n - 1)
        return np.where(self.hashes[i] == h, self.rank[i], n)


def classes(together: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shares, words of each class): mixtures under which two words of one text are drawn from one class, fitted to the
    weights of pairs by expectation and maximisation from a fixed start."""
    n = len(together)
    r = np.random.default_rng(0)
    words, shares = r.dirichlet(np.ones(n), CLASSES), np.full(CLASSES, 1 / CLASSES)
    for _ in range(200):
        pairs = shares[:, None, None] * words[:, :, None] * words[:, None, :]
        pairs *= together / np.maximum(pairs.sum(axis=0), 1e-30)
        shares, words = pairs.sum(axis=(1, 2)) + 1e-9, pairs.sum(axis=2) + pairs.sum(axis=1) + 1e-3
        shares, words = shares / shares.sum(), words / words.sum(axis=1, keepdims=True)
    return shares, words


def _bucket(n: np.ndarray, most: int) -> np.ndarray:
    return np.minimum(np.log2(n + 1).astype(np.int64), most)


class Stream:
    """The tokens of a batch of texts, each followed by an end, and what each has before it in its own text."""

    def __init__(self, words: list[list[bytes]], frequent: Frequent, least: int):
        """least: the training count from which a token is frequent (one more for a text that is in the counts)."""
        lens = np.array([len(w) + 1 for w in words])
        self.starts = np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64)
        n = int(lens.sum())
        h = np.empty(n, U64)
        is_end = np.zeros(n, bool)
        is_end[np.cumsum(lens) - 1] = True
        h[is_end] = _END_HASH
        h[~is_end] = np.fromiter((x for w in words for x in map(xxhash.xxh3_64_intdigest, w)), U64, n - len(words))
        self.hash = h
        unique, token = np.unique(h, return_inverse=True)
        text = np.repeat(np.arange(len(words)), lens)
        self.t = np.arange(n) - np.repeat(self.starts, lens)
        key = text * len(unique) + token
        order = np.argsort(key, kind="stable")
        same = np.zeros(n, bool)
        same[1:] = key[order[1:]] == key[order[:-1]]
        last = np.full(n, -1)
        last[order[1:]] = np.where(same[1:], order[:-1], -1)  # the place before of the same token in the text
        rank = np.arange(n)
        self.before = np.empty(n, np.int64)
        self.before[order] = rank - np.maximum.accumulate(np.where(same, 0, rank))
        self.rank = frequent.of(unique)[token]
        self.count = frequent.counts[self.rank]
        follows = np.full(n, -1)
        follows[1:] = np.where((self.t[1:] > 0) & (last[:-1] >= 0), last[:-1] + 1, -1)
        self.has = follows >= 0
        guess = np.maximum(follows, 0)
        self.guess = np.where(self.has, h[guess], U64(0))
        self.hit = self.has & (token[guess] == token)
        self.seen = self.before > 0
        self.often = self.count >= least
        status = np.where(self.hit, 0, np.where(self.seen, 1, np.where(self.often, 2, 3)))
        back = lambda v, k, none: np.concatenate([np.full(min(k, n), none, v.dtype), v[: max(0, n - k)]])
        past = [np.where(self.t >= k, back(status, k, 4), 4) for k in (1, 2, 3)]
        self.past = past[0]
        streak = np.arange(n) - 1 - back(np.maximum.accumulate(np.where(self.hit, -1, np.arange(n))), 1, -1)
        place = _bucket(self.t, 15)
        one = np.where(self.t >= 1, back(h, 1, 0), U64(1))
        two = np.where(self.t >= 2, back(h, 2, 0), U64(1))
        with np.errstate(over="ignore"):
            pair = mix64(one * U64(_B) + two)
            one, guessed = mix64(one), mix64(self.guess)
        self.shared = [place * 5 + past[0], (past[0] * 25 + past[1] * 5 + past[2]) * 8 + np.clip(streak, 0, 7), (one >> U64(50)).astype(np.int64), (pair >> U64(48)).astype(np.int64)]
        self.own = [(guessed >> U64(50)).astype(np.int64)] * 2 + [past[0] * 80 + past[1] * 16 + place]
        self.place = place
        self.lens = lens
        tells = np.flatnonzero(self.rank < frequent.telling.shape[1])
        likely = np.zeros((n, len(frequent.shares)), np.float32)
        likely[tells] = frequent.telling[:, self.rank[tells]].T
        self.kind = (self.inside(likely) + frequent.shares.astype(np.float32)).argmax(axis=1)
        self.of = [(np.flatnonzero(self.has), self.hit), (np.flatnonzero(~self.hit & (self.t > 0)), self.seen), (np.flatnonzero(~self.hit), self.often)]

    def inside(self, v: np.ndarray) -> np.ndarray:
        """Sums of v over the places before, in the same text."""
        total = np.cumsum(v, axis=0) - v
        return total - np.repeat(total[self.starts], self.lens, axis=0)

    def decisions(self):
        """For each decision: its number, where it is met, the outcomes, the slots of its contexts, its gate and its map row."""
        for d, (at, outcome) in enumerate(self.of):
            met = np.zeros(len(self.t), bool)
            met[at] = True
            yes, trials = self.inside((met & outcome).astype(np.int64))[at], self.inside(met.astype(np.int64))[at]
            rate = np.clip(np.rint(2 * np.log2((yes + 0.5) / (trials - yes + 0.5))), -8, 8).astype(np.int64) + 8
            local = rate * 8 + _bucket(trials, 7)
            contexts = [*(c[at] for c in self.shared), local, self.own[d][at]]
            slots = [d * _SLOTS + a + c for a, c in zip(_REGION_AT, contexts, strict=False)]
            yield d, at, outcome[at], slots, d * 16 + self.place[at], (d * 5 + self.past[at]) * APM_STEPS


class Decisions:
    """Counts, weights and map of the decisions, and counts of frequent words by class; learned online."""

    def __init__(self, counts=None, weights=None, apm=None, words=None):
        self.counts = np.zeros((DECISIONS * _SLOTS, 2), np.float32) if counts is None else counts
        self.weights = np.full((DECISIONS * 16, len(REGIONS) + 1), 0.3) if weights is None else weights
        self.apm = np.zeros((DECISIONS * 5 * APM_STEPS, 2)) if apm is None else apm
        self.words = np.zeros((CLASSES, CLASSED + 1), np.float32) if words is None else words
        self.odds: np.ndarray | None = None

    def predicted(self, slots, gate, row):
        if self.odds is None:
            self.odds = odds(self.counts)
        x = [self.odds[s] for s in slots]
        z, p = mixed(self.weights, gate, x)
        cell = row + step_of(z)
        return x, p, cell, refined(self.apm, cell, p)

    def drawn(self, s: Stream, frequent: Frequent) -> np.ndarray:
        """The chance of each frequent token among the frequent ones, in texts of its class; of others 0."""
        rank = np.minimum(s.rank, CLASSED)
        share = np.where(rank < CLASSED, s.count, frequent.rest) / frequent.total
        share = (self.words[s.kind, rank] + PRIOR * share) / (self.words.sum(axis=1, dtype=np.float64)[s.kind] + PRIOR)
        return np.where(rank < CLASSED, share, share * s.count / frequent.rest)

    def ways(self, s: Stream, frequent: Frequent):
        """What decisions() gives with its prediction, the chances of the ways of each token, and that of its draw from the text."""
        found = [(d, *self.predicted(*d[3:])) for d in s.decisions()]
        chance = [np.zeros(len(s.t)) for _ in found]
        for (d, at, *_), *_, p in found:
            chance[d][at] = p
        own = chance[1] * s.before / np.maximum(s.t, 1)
        other = (1 - chance[1]) * np.where(s.often, chance[2] * self.drawn(s, frequent), 1 - chance[2])
        return found, chance[0], own, other

    def learn(self, s: Stream, frequent: Frequent) -> None:
        """Each batch is predicted by what came before it, then weights, map and counts take it in. The second decision
        isn't seen: what is learned is its chance given the token. The third is learned by the chance that it is met."""
        found, _, own, other = self.ways(s, frequent)
        # a rare word that stands in the text is taken from there
        own = np.where(s.seen & ~s.often, 1.0, own / np.maximum(own + other, 1e-300))
        for (d, at, outcome, slots, gate, row), x, p, cell, _ in found:
            if not len(at):
                continue
            yes, times = (own[at], np.ones(len(at))) if d == 1 else (outcome.astype(np.float64), 1 - own[at] if d == 2 else np.ones(len(at)))
            taken(self.weights, gate, [*x, np.full(len(p), 0.3)], (yes - p) * times, p * (1 - p) * times)
            both = np.stack([(1 - yes) * times, yes * times], axis=1)
            for table, k in ((self.apm, cell), *((self.counts, k) for k in slots)):
                low, size = int(k.min()), int(k.max()) - int(k.min()) + 1
                for b in (0, 1):
                    table[low : low + size, b] += np.bincount(k - low, both[:, b], size).astype(table.dtype)
        self.odds = None
        np.add.at(self.words, (s.kind[s.often], np.minimum(s.rank[s.often], CLASSED)), 1)

    def bits(self, s: Stream, frequent: Frequent) -> np.ndarray:
        """Bits of each token of a stream, but for the draw of rare tokens that are new in their text."""
        _, hit, own, other = self.ways(s, frequent)
        other = np.where(s.seen & ~s.often, 0.0, other)
        return -np.log2(np.where(s.hit, hit, (1 - hit) * (own + other)))


def _texts(batches):
    return ((k, encoded(t)) for k, t in rows(batches, "id", "text"))


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, c) over the training rows of docs (id, text); partial counts per task."""
    import pyarrow as pa

    def run(batches):
        n: Counter = Counter()

        def flush():
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["token", "c"])
            n.clear()

        for k, t in rows(batches, "id", "text"):
            if fold(k) != HELD:
                n.update(tokens(t))
                n[_END_TOKEN] += 1
                if len(n) >= 1 << 18:
                    yield from flush()
        yield from flush()

    return docs.mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def tables(words: DataFrame, bits: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Counts and checks of the distinct words (token); tasks emit touched blocks, the driver gets sums of fixed size."""
    import pyarrow as pa

    per, slots = 1 << BLOCK_BITS, sum(1 << b for b in bits)
    kind = np.dtype([("at", "<u2"), ("check", "u1"), ("n0", "<u4"), ("n1", "<u4")])

    def count(batches):
        every, checks = np.zeros(slots * 2, np.uint32), np.zeros(slots, np.uint8)
        for batch in in_batches((None, t) for (t,) in rows(batches, "token")):
            c = Contexts([x for _, x in batch])
            times = c.times.astype(np.uint32)
            for _, _, bit, places in c.nodes(bits):
                for s, check in places:
                    free = checks[s] == 0
                    checks[s[free]] = check[free]
                    held = checks[s] == check
                    np.add.at(every, 2 * s[held] + bit[held], times[held])
        counts = every.reshape(-1, 2)
        for i in range(slots // per):
            at = np.flatnonzero(checks[i * per : (i + 1) * per])
            if len(at):
                out = np.empty(len(at), kind)
                out["at"], out["check"], out["n0"], out["n1"] = at, checks[i * per + at], counts[i * per + at, 0], counts[i * per + at, 1]
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["block", "packed"])

    def add(batches):
        parts: dict[int, list] = {}
        for b in batches:
            for i, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts.setdefault(i, []).append(np.frombuffer(packed, kind))
        for i, got in parts.items():
            got = np.concatenate(got)
            key, where = np.unique(got["at"].astype(np.int64) << 8 | got["check"], return_inverse=True)
            n = np.stack([np.bincount(where, got[c], len(key)) for c in ("n0", "n1")], axis=1)
            order = np.lexsort((key, -n.sum(axis=1), key >> 8))  # of a slot's contexts the most frequent has it
            order = order[np.unique(key[order] >> 8, return_index=True)[1]]
            key, n = key[order], n[order]
            down = n.max(axis=1, keepdims=True) // 65536 + 1  # both counts are scaled down together, kept over 0
            n = np.where(n > 0, np.maximum(1, n // down), 0).astype("<u2")
            block = np.zeros((per, 2), "<u2")
            block[key >> 8] = n
            check = np.zeros(per, np.uint8)
            check[key >> 8] = key & 255
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([block.tobytes()], pa.binary()), pa.array([check.tobytes()], pa.binary())], names=["block", "packed", "checks"])

    few = max(1, -(-words.rdd.getNumPartitions() // 3))
    parts = words.select("token").coalesce(few).mapInArrow(count, "block int, packed binary")
    counts, checks = np.zeros((slots, 2), np.uint16), np.zeros(slots, np.uint8)
    for r in parts.repartition("block").mapInArrow(add, "block int, packed binary, checks binary").toLocalIterator():
        counts[r.block * per : (r.block + 1) * per] = np.frombuffer(r.packed, "<u2").reshape(per, 2)
        checks[r.block * per : (r.block + 1) * per] = np.frombuffer(r.checks, np.uint8)
    return counts, checks


def averaged(df: DataFrame, shapes: list[tuple], run) -> list[np.ndarray] | None:
    """Weights averaged by n and other arrays added up over the tasks of run, which gives (n, [weights, arrays...]).

    Tasks emit the blocks that aren't zero; sums are by block, first for groups of tasks; the driver gets one sum of
    fixed size.
    """
    import pyarrow as pa

    sizes = [1, *(int(np.prod(x)) for x in shapes)]
    per, ends = 1 << BLOCK_BITS, np.cumsum(sizes)
    schema = "block long, turn long, packed binary"

    def batch(got):
        keys, turns, packed = zip(*got, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(turns, pa.int64()), pa.array([x.astype(np.float32).tobytes() for x in packed], pa.binary())],
            names=["block", "turn", "packed"],
        )

    def each(batches):
        from pyspark import TaskContext

        n, arrays = run(batches)
        if n:
            flat = np.concatenate([[n / 1e6], np.ravel(arrays[0]) * (n / 1e6), *map(np.ravel, arrays[1:])])
            parts = ((i, flat[i * per : (i + 1) * per]) for i in range(-(-len(flat) // per)))
            for i, x in parts:
                if x.any():
                    yield batch([(i, TaskContext.get().partitionId() % 64, x)])

    def add(batches):
        sums: dict = {}
        for b in batches:
            for key, turn, packed in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                x = np.frombuffer(packed, np.float32).astype(np.float64)
                sums[key, turn] = sums[key, turn] + x if (key, turn) in sums else x
        for (key, turn), x in sums.items():
            yield batch([(key, turn, x)])

    groups = df.mapInArrow(each, schema).repartition("block", "turn").mapInArrow(add, schema)
    got = groups.withColumn("turn", F.lit(0).cast("long")).repartition("block").mapInArrow(add, schema).collect()  # each block once
    flat = np.zeros(ends[-1])
    for r in got:
        x = np.frombuffer(r.packed, np.float32)
        flat[r.block * per : r.block * per + len(x)] = x
    if not flat[0]:
        return None
    out = [flat[a:b].reshape(s) for a, b, s in zip(ends[:-1], ends[1:], shapes, strict=True)]
    return [out[0] / flat[0], *out[1:]]


def tuned(words: DataFrame, held) -> Model:
    """Spelling weights averaged over tasks and map counts added up, from all distinct words."""

    def run(batches):
        m, n = Model(*held.value), 0
        for batch in in_batches(((None, t) for (t,) in rows(batches, "token")), BATCH // 8):
            c = Contexts([x for _, x in batch])
            m.learn(c)
            n += int(c.times.sum())
        return n, [m.weights, m.apm]

    start = Model(*held.value)
    got = averaged(words.select("token"), [start.weights.shape, start.apm.shape], run)
    return Model(*held.value, *(got or (None, None)))


def told(docs: DataFrame, common: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
    """The classes of texts, fitted to how these words stand together in all training rows."""
    place = {w: i for i, w in enumerate(common)}
    n = len(common)

    def run(batches):
        out, texts = np.zeros((n, n)), 0
        for k, t in rows(batches, "id", "text"):
            if fold(k) != HELD:
                found = np.bincount([place[w] for w in tokens(t) if w in place], minlength=n)
                out += np.outer(found, found) / max(found.sum(), 1)
                texts += 1
        return texts, [np.zeros(1), out]

    got = averaged(docs, [(1,), (n, n)], run) if n > 1 else None
    if not got:
        return None
    np.fill_diagonal(got[1], 0)
    return classes(got[1])


def decided(docs: DataFrame, frequent) -> Decisions:
    """The decisions learned from all training rows: weights averaged over tasks, counts and map added up."""

    def run(batches):
        d, n = Decisions(), 0
        for batch in in_batches((k, t) for k, t in _texts(batches) if fold(k) != HELD):
            s = Stream([t.translate(LOWER).split() for _, t in batch], frequent.value, 3)
            d.learn(s, frequent.value)
            n += len(s.t)
        return n, [d.weights, d.apm, d.counts, d.words]

    start = Decisions()
    got = averaged(docs, [start.weights.shape, start.apm.shape, start.counts.shape, start.words.shape], run)
    return Decisions(got[2].astype(np.float32), got[0], got[1], got[3].astype(np.float32)) if got else start


def spelt(words: DataFrame, held, learned) -> DataFrame:
    """(token, bits) of distinct words (token)."""
    import pyarrow as pa

    def run(batches):
        m = Model(*held.value, *learned.value)
        for batch in in_batches((None, t) for (t,) in rows(batches, "token")):
            c = Contexts([x for _, x in batch])
            bits = np.add.reduceat(m.bits(c)[c.where], c.starts)
            yield pa.RecordBatch.from_arrays([pa.array([x for _, x in batch], pa.binary()), pa.array(bits)], names=["token", "bits"])

    return words.select("token").mapInArrow(run, "token binary, bits double")


SCHEMA = "row long, doc_id long, held_out boolean, n_tokens long, n_bytes long, bits double, base double, known long, first string, again string"


def score(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row."""
    import pyarrow as pa

    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counts = cut(token_counts(docs))
    total, distinct, once, twice = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    below = math.log10(total + 0.5 * (distinct + 1))
    top = counts.where((F.col("c") >= 2) & (F.octet_length("token") <= LONGEST)).orderBy(F.desc("c"), "token").limit(FREQUENT)
    common = [(bytes(r.token), r.c) for r in top.toLocalIterator()]  # at most FREQUENT short tokens
    hashes, times = np.array([xxhash.xxh3_64_intdigest(w) for w, _ in common], U64), np.array([c for _, c in common], np.int64)
    kinds = told(docs, [w for w, _ in common if w != _END_TOKEN][:TELLING])
    if kinds:  # ranks count the end
        end = next((i for i, (w, _) in enumerate(common[:TELLING]) if w == _END_TOKEN), None)
        if end is not None:
            kinds = kinds[0], np.insert(kinds[1], end, 1.0, axis=1)
    frequent = spark.sparkContext.broadcast(Frequent(hashes, times, *(kinds or ())))
    del common
    bits = slot_bits(distinct)
    held = spark.sparkContext.broadcast((bits, *tables(counts, bits)))
    m = tuned(counts.where("c = 1"), held)  # words that would be unknown without their one place
    learned = spark.sparkContext.broadcast((m.weights, m.apm))
    decisions = spark.sparkContext.broadcast(decided(docs, frequent))
    # what a rare token is, by training tokens without themselves: unknown, or known in another place
    rare_total = total - int(times.sum())
    known_rare = 2 * twice + rare_total - once
    unknown = (once + 0.5) / (once + known_rare + 1)
    arrow = pa.schema(
        [
            ("row", pa.int64()),
            ("doc_id", pa.int64()),
            ("held_out", pa.bool_()),
            ("n_tokens", pa.int64()),
            ("n_bytes", pa.int64()),
            ("bits", pa.float64()),
            ("base", pa.float64()),
            ("known", pa.int64()),
            ("first", pa.string()),
            ("again", pa.string()),
        ]
    )

    def run(batches):
        from pyspark import TaskContext

        d, often, row = decisions.value, frequent.value, TaskContext.get().partitionId() << 40
        for batch in in_batches(_texts(batches)):
            words = [t.translate(LOWER).split() for _, t in batch]
            s = Stream(words, often, 2)
            cost = np.add.reduceat(d.bits(s, often), s.starts)
            base = np.add.reduceat(np.where(s.often, np.log10(s.count + 0.5) - below, 0.0), s.starts)
            known = np.add.reduceat(s.often.astype(np.int64), s.starts)
            rare = np.flatnonzero(~s.often)
            edge = np.searchsorted(rare, np.append(s.starts, len(s.t)))
            out = []
            for i, ((k, t), w) in enumerate(zip(batch, words, strict=True)):
                at = rare[edge[i] : edge[i + 1]]
                new = s.seen[at]
                at = (at - s.starts[i]).tolist()
                got: tuple[list, list] = ([], [])
                for p, again in zip(at, new.tolist(), strict=True):
                    got[again].append(w[p] if p < len(w) else _END_TOKEN)
                tails = [b" ".join(x).decode("utf-8", "replace") if x else None for x in got]
                out.append((row, k, fold(k) == HELD, len(w) + 1, len(t), float(cost[i]), float(base[i]), int(known[i]), *tails))
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    main = cut(docs.mapInArrow(run, SCHEMA))
    part = lambda c: main.where(F.col(c).isNotNull()).select("row", "held_out", F.lit(c == "first").alias("first"), F.explode(F.split(c, " ")).alias("token"))
    tail = part("first").unionByName(part("again")).withColumn("token", F.col("token").cast("binary"))
    # all words of training texts are known; those of held-out texts may not be, and are spelt once each
    odd = part("first").where("held_out").select(F.col("token").cast("binary").alias("token")).distinct().join(counts, "token", "left_anti")
    draws = F.lit(-math.log2(1 - unknown)) - F.log2(F.col("c") / F.lit(float(max(rare_total, 1))))
    prices = counts.select("token", "c", draws.alias("bits")).unionByName(
        spelt(odd, held, learned).select("token", F.lit(0).cast("long").alias("c"), (F.col("bits") + F.lit(-math.log2(unknown))).alias("bits"))
    )
    rest = tail.join(prices, "token").groupBy("row").agg(
        F.sum(F.log10(F.col("c") + 0.5) - F.lit(below)).alias("more"),
        F.count_if(F.col("c") > 0).alias("more_known"),
        F.sum(F.when(F.col("first"), F.col("bits")).otherwise(0.0)).alias("more_bits"),
    )
    out = main.drop("first", "again").join(rest, "row", "left")
    bits_ = F.col("bits") + F.coalesce("more_bits", F.lit(0.0))
    return out.select(
        F.col("doc_id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (-bits_ * math.log10(2)).alias("score"),
        (bits_ / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )
