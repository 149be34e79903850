"""Hierarchical multi-length packing.

Documents are routed to tiers of context sizes (powers of two). Each tier is packed in bounded windows of rows:
a sequence starts with the longest waiting piece of its tier, its gap is filled with the largest pieces of shorter
tiers that fit, and what is left with a cut of the shortest. Full sequences thus end at a power of two; only the last
of a partition may be padded. A piece is longer than half its tier (but in the shortest), so what fits its gap is of shorter
tiers. All that is local to a partition of the input, so there is no shuffle, and a lost task gives the same rows again.
Step groups hold sequences of one tier, whose number is as even as can be over the whole table: a sequence's place in its
tier is its place in its partition and the count of partitions before.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each for itself; an empty table
gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.llm.common import batches_of, bpe, cut, rows

TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Tokens that wait in a task before a window is packed, and tokens of a training step.
WINDOW_TOKENS, STEP_TOKENS = 1 << 20, 1 << 17
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, place long"


class Packer:
    """Packs pieces (document, first id, ids) into sequences; yields rows."""

    def __init__(self, base: int, tiers=TIERS):
        self.tiers, self.most = tuple(sorted(tiers)), max(tiers)
        self.waiting: list = []  # (length, arrival, doc, start, ids, doc_tokens) by length
        self.tokens = self.arrival = 0
        self.next, self.steps = base, dict.fromkeys(self.tiers, 0)

    def piece(self, p, size: int, offset: int, tier: int):
        ids = p[4][:size]
        return (p[2], p[3], len(ids), zlib.crc32(ids.astype("<u4").tobytes()), p[5], self.next, offset, tier, self.steps[tier])

    def sequence(self, parts: list, tier: int):
        offset = 0
        for p, size in parts:
            yield self.piece(p, size, offset, tier)
            offset += size
        self.steps[tier] += 1
        self.next += 1

    def wait(self, doc, start, ids, total) -> None:
        self.arrival += 1
        insort(self.waiting, (len(ids), self.arrival, doc, start, ids, total), key=lambda p: p[:2])
        self.tokens += len(ids)

    def add(self, doc, ids):
        """Whole windows of a long document go out at once; the rest waits."""
        at, total = 0, len(ids)
        while total - at >= self.most:
            p = (self.most, 0, doc, at, ids[at:], total)
            yield from self.sequence([(p, self.most)], self.most)
            at += self.most
        if at < total:
            self.wait(doc, at, ids[at:], total)
        if self.tokens >= WINDOW_TOKENS:
            yield from self.pack(False)

    def pack(self, last: bool):
        """Packs what waits; unless it is the last time, a rest of less than one longest window keeps waiting."""
        w = self.waiting
        while w and (last or self.tokens >= self.most):
            p = w.pop()
            tier = next(t for t in self.tiers if t >= p[0])
            parts, gap = [(p, p[0])], tier - p[0]
            while gap and w:
                k = bisect_right(w, gap, key=lambda x: x[0])
                if k:
                    q = w.pop(k - 1)
                    parts.append((q, q[0]))
                    gap -= q[0]
                else:
                    q = w.pop(0)
                    parts.append((q, gap))
                    self.arrival += 1
                    insort(w, (q[0] - gap, self.arrival, q[2], q[3] + gap, q[4][gap:], q[5]), key=lambda x: x[:2])
                    gap = 0
            self.tokens -= tier - gap
            yield from self.sequence(parts, tier)


def pack(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", vocabulary: str = "byte_bpe_50k.tiktoken", tiers=TIERS) -> DataFrame:
    """A row for each piece: where it comes from, its ids' checksum, and where it lies."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = docs.sparkSession.createDataFrame([], SCHEMA).schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        from pyspark import TaskContext

        enc = bpe(vocabulary)
        packer = Packer(TaskContext.get().partitionId() << 32, tiers)

        def out():
            for k, text in rows(batches, "id", "text"):
                ids = np.array([*enc.encode_ordinary(text or ""), END_ID], np.uint32)
                yield from packer.add(k, ids)
            yield from packer.pack(True)

        yield from batches_of(out(), arrow)

    pieces = cut(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema))
    return stepped(pieces)


def stepped(pieces: DataFrame) -> DataFrame:
    """pieces with step_group in place of place: groups of one tier of STEP_TOKENS at most, as even as can be."""
    pieces = pieces.withColumn("part", F.shiftright("sequence_id", 32))
    counts = pieces.groupBy("tier", "part").agg((F.max("place") + 1).alias("n"))
    before = Window.partitionBy("tier").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    counts = counts.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy("tier")))
    counts = counts.withColumn("groups", F.ceil(F.col("total") * F.col("tier") / F.lit(STEP_TOKENS)).cast("long")).drop("n")
    group = F.floor((F.col("earlier") + F.col("place")) * F.col("groups") / F.col("total")).cast("long")
    out = pieces.join(counts, ["tier", "part"])
    return out.select(*[c for c in pieces.columns if c not in ("place", "part")], (F.col("tier").cast("long") * F.lit(1 << 40) + group).alias("step_group"))
