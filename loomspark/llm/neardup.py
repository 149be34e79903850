"""MinHash near-dedup: universal hash minima, banding, signature check, exact check, and connected components.

Plan: one pass over the texts gives each document its set's key and signature. Equal sets are one class, of which
only the representative goes on. In each bucket every member is paired with one hub, the member that shares most
places with others, never with all others: first in a few bands, then, for members of other components, in all.
Pairs whose signatures agree too little are dropped, the rest is confirmed on full sets, and links are joined by
alternating large-star and small-star. Buckets whose members are still in several components are compared in full:
blocks of the members outside the largest component meet blocks of all members by their signatures. Groups that likely
pairs connect are dealt into blocks, each two of which meet once with full sets; a union-find skips pairs already joined,
so no link between components is lost and a task gives at most a row for each member, never all its pairs. Frequent
buckets and nodes are few and go to their rows by broadcast; only the others are dealt out by key.

With 40 bands of 4 rows a link of similarity 0.75 shares no bucket with probability 2.5e-7; five standard deviations
of the signature's estimate are allowed below the threshold.

Defined cases: a document without words has an empty set and is linked with nothing; with fewer than five words the
whole sequence is the one shingle; rows that repeat a doc_id are one document; rows without one are linked with nothing,
have no component and are kept; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.llm.common import LOWER, U64, batches_of, cut, encoded, fresh, hot_limit, met, mix64, rows

WORDS, BANDS, ROWS = 5, 40, 4
#: The threshold is PER_CENT of a hundred of the union.
PER_CENT = 75
#: Bands of the first turn of hubs; members, and shingles on average, of a block.
FIRST_BANDS, BLOCK, BLOCK_SHINGLES = 3, 1024, 1 << 18
#: Ids up to which they are broadcast (under 2 MB), and rows of a partition of links.
FEW_IDS, FEW_ROWS = 200_000, 50_000
#: Links that one task joins at most: 16 MB of Arrow, and about 100 MB of arrays at its peak.
FEW_LINKS = 1_000_000
#: Hubs whose sets are broadcast at most, and bytes of such a set (8 MB together).
HOT_HUBS, HOT_BYTES = 500, 1 << 14
_M = U64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a whole text's word shingles."""
    words = encoded(text).translate(LOWER).split()
    n = len(words)
    if not n:
        return np.empty(0, U64)
    h = xxhash.xxh3_64_intdigest
    w = np.fromiter(map(h, words), U64, n)
    k = min(WORDS, n)
    acc = np.zeros(n - k + 1, U64)
    with np.errstate(over="ignore"):
        for j in range(k):
            acc = acc * _M + w[j : n - k + 1 + j]
        return np.unique(mix64(acc + U64(k)))


def coefficients(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return (r.integers(0, 2**63, n, dtype=np.uint64) * U64(2) + U64(1))[:, None], r.integers(0, 2**63, n, dtype=np.uint64)[:, None]


def signature(s: np.ndarray, ab) -> np.ndarray:
    """Minima of the set under each universal hash, as 32 bits."""
    a, b = ab
    low = np.full(len(a), np.iinfo(np.uint64).max, U64)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 1024):
            np.minimum(low, (a * s[None, i : i + 1024] + b).min(axis=1), out=low)
    return (low >> U64(32)).astype("<u4")


def signed(docs: DataFrame, id_col: str, text_col: str, bands: int = BANDS, per_band: int = ROWS) -> DataFrame:
    """id, n_shingles, set_key, sig, and mini (a byte of each minimum) of every row."""
    import pyarrow as pa

    arrow = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("sig", pa.binary()), ("mini", pa.binary())])

    def run(batches):
        ab = coefficients(bands * per_band)

        def one():
            for k, t in rows(batches, "id", "text"):
                s = shingles(t)
                if not len(s):
                    yield k, 0, None, None, None
                    continue
                sig = signature(s, ab)
                yield k, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), sig.tobytes(), sig.astype(np.uint8).tobytes()

        yield from batches_of(one(), arrow)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_shingles long, set_key binary, sig binary, mini binary")


def banded(reps: DataFrame, bands: int = BANDS, per_band: int = ROWS) -> DataFrame:
    """A row (key, id, band) for each band of each representative."""
    import pyarrow as pa

    def run(batches):
        salt = mix64(np.arange(1, bands + 1, dtype=np.uint64))
        for b in batches:
            n = b.num_rows
            ids = b.column(0).to_numpy(zero_copy_only=False)
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u4").reshape(n, bands, per_band).astype(U64)
            key = np.tile(salt, (n, 1))
            with np.errstate(over="ignore"):
                for j in range(per_band):
                    key = mix64((key * _M + sig[:, :, j]).ravel()).reshape(n, bands)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(ids, bands)), pa.array(np.tile(np.arange(bands, dtype=np.int32), n))],
                names=["key", "id", "band"],
            )

    return reps.select("id", "sig").mapInArrow(run, "key long, id long, band int")


def _screened(pairs: DataFrame, sketch: DataFrame, n: int) -> DataFrame:
    """The pairs (id, hub) whose sizes and signatures allow the threshold."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, n) for i in (2, 3))
                agree = (x == y).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["id", "hub"]).filter(pa.array(agree >= _least(n)))

    side = lambda c, x: sketch.select(F.col("id").alias(c), F.col("n_shingles").alias("n" + x), F.col("mini").alias("s" + x))
    times, (_, total, most) = counted(pairs.groupBy("hub").agg(F.count("*").alias("times")), F.sum("times"), F.max("times"))
    hubs = cut(side("hub", "b").join(times, "hub"))
    both = met(pairs.join(side("id", "a"), "id"), hubs, ["hub"], "times", hot_limit(total or 0), most=most or 0)
    both = both.where(F.greatest("na", "nb") * PER_CENT <= F.least("na", "nb") * 100)
    return both.select("id", "hub", "sa", "sb").mapInArrow(run, "id long, hub long")


def _least(n: int) -> float:
    """Equal minima of a link, less five standard deviations; bytes agree by chance too, so this is on the safe side."""
    t = PER_CENT / 100
    return n * (t - 5 * math.sqrt(t * (1 - t) / n))


class Joined:
    """Union-find over places."""

    def __init__(self, labels):
        first: dict = {}
        self.up = [first.setdefault(c, i) for i, c in enumerate(labels)]

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether i and j were apart."""
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _likely(sides, n: int, by: str):
    """(i, places j, ids, Joined) for each place i of the first side that has any: the places j in the second side, counted
    behind the first, of other components whose sizes and signatures allow the threshold. Places of equal `by` begin joined."""
    ids, cs, sizes = ([np.array([r[k] for r in s], np.int64) for s in sides] for k in ("id", "c", "n_shingles"))
    x, y = (np.frombuffer(b"".join(r["mini"] for r in s), np.uint8).reshape(-1, n) for s in sides)
    joined = Joined([r[by] for s in sides for r in s])
    every = np.concatenate(ids)
    for i in range(len(x)):
        ok = (cs[0][i] != cs[1]) & (np.maximum(sizes[0][i], sizes[1]) * PER_CENT <= np.minimum(sizes[0][i], sizes[1]) * 100)
        j = np.flatnonzero(ok)
        if len(j):
            j = j[(x[i] == y[j]).sum(axis=1) >= _least(n)]
        if len(j):
            yield i, len(x) + j, every, joined


def _blocks(apart: DataFrame, sketch: DataFrame, n: int) -> DataFrame:
    """(a, b): a forest of the likely links in each pair of blocks of a bucket, between members of two components.

    apart has (key, id, c, hub_c, n_all, n_out): n_all members, of which n_out are outside the largest component
    hub_c. Blocks of the outsiders meet blocks of all members; a task holds two blocks of signatures, never a bucket,
    and gives at most a row for each member in it.
    """
    import pyarrow as pa

    def run(batches):
        for groups in batches:
            out: list = [[], []]
            for sides in zip(groups.column(0).to_pylist(), groups.column(1).to_pylist(), strict=True):
                if not all(sides):
                    continue
                for i, js, ids, joined in _likely(sides, n, "id"):
                    for j in js.tolist():
                        if joined.join(i, j):
                            out[0].append(min(ids[i], ids[j]))
                            out[1].append(max(ids[i], ids[j]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    block = lambda count, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.ceil(F.col(count) / BLOCK)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.ceil(F.col(count) / BLOCK).cast("int") - 1))
    known = apart.join(sketch, "id")
    one = F.struct("id", "c", "n_shingles", "mini")
    left = known.where("c <> hub_c").select("key", block("n_out", 1).alias("i"), every("n_all").alias("j"), one.alias("l"), F.lit(None).alias("r"))
    right = known.select("key", every("n_out").alias("i"), block("n_all", 2).alias("j"), F.lit(None).alias("l"), one.alias("r"))
    blocks = left.unionByName(right).groupBy("key", "i", "j").agg(F.collect_list("l").alias("l"), F.collect_list("r").alias("r"))  # about BLOCK rows a side
    return blocks.select("l", "r").mapInArrow(run, "a long, b long").distinct()


def _sets(docs: DataFrame, id_col: str, text_col: str, ids: DataFrame) -> DataFrame:
    """(id, s) with the full sets of these documents; a checked small number of ids goes to the texts."""
    import pyarrow as pa

    def sets(batches):
        yield from batches_of(((k, shingles(t).tobytes()) for k, t in rows(batches, "id", "text")), pa.schema([("id", pa.int64()), ("s", pa.binary())]), 512)

    ids = ids.distinct()
    some = F.broadcast(ids) if ids.count() <= FEW_IDS else ids
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(some, "id", "left_semi")
    return texts.mapInArrow(sets, "id long, s binary").dropDuplicates(["id"])


def _confirmed(docs: DataFrame, id_col: str, text_col: str, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of pairs (id, hub) that hold on full sets, which are made anew for these documents only.

    The sets of a few hubs that many meet, if they are small, go to their rows by broadcast; others are dealt out.
    """
    import pyarrow as pa

    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, U64), np.frombuffer(y, U64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * common >= PER_CENT * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    often, (n_hubs, n_pairs, most) = counted(pairs.groupBy("hub").agg(F.count("*").alias("n")), F.sum("n"), F.max("n"))
    if not n_hubs:
        return pairs.select(F.col("id").alias("a"), F.col("hub").alias("b"))
    hubs = cut(_sets(docs, id_col, text_col, often.select(F.col("hub").alias("id"))).select(F.col("id").alias("hub"), F.col("s").alias("sb")).join(often, "hub"))
    limit = max(256, n_pairs // HOT_HUBS)
    is_hot = (F.col("n") >= limit) & (F.octet_length("sb") <= HOT_BYTES)
    hot = hubs.where(is_hot).select("hub", "sb")

    def met_by(some, table):
        own = _sets(docs, id_col, text_col, some.select("id")).withColumnRenamed("s", "sa")
        return some.join(own, "id").join(table, "hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"), "sa", "sb").mapInArrow(run, "a long, b long")

    if most < limit or hot.isEmpty():
        return met_by(pairs, hubs.select("hub", "sb"))
    cold = met_by(pairs.join(F.broadcast(hot.select("hub")), "hub", "left_anti"), hubs.where(~is_hot).select("hub", "sb"))
    return cold.unionByName(met_by(pairs.join(F.broadcast(hot.select("hub")), "hub", "left_semi"), F.broadcast(hot)))


def _confirmed_in_blocks(docs: DataFrame, id_col: str, text_col: str, likely: DataFrame, found: DataFrame, sketch: DataFrame, n: int) -> DataFrame:
    """(a, b): links that join all components that links on full sets join, among documents that likely pairs connect.

    Each group that likely pairs connect is dealt into blocks of bounded shingles, and each two blocks meet once with
    their signatures and full sets. Pairs whose components are already joined there are skipped, so a task gives at most
    a row for each member in it, however many links they have.
    """
    import pyarrow as pa

    def run(batches):
        for groups in batches:
            out: list = [[], []]
            for i_block, j_block, members in zip(*(groups.column(k).to_pylist() for k in range(3)), strict=True):
                left = [r for r in members if r["block"] == i_block]
                right = [r for r in members if r["block"] == j_block] if i_block != j_block else left
                if not left or not right:
                    continue
                sets = [np.frombuffer(r["s"], U64) for r in [*left, *right]]
                for i, js, ids, joined in _likely((left, right), n, "c"):
                    root = joined.root(i)
                    js = [j for j in js.tolist() if joined.root(j) != root]
                    if not js:
                        continue
                    p = sets[i]
                    sizes = np.array([len(sets[j]) for j in js])
                    every = np.concatenate([sets[j] for j in js])
                    hit = p[np.minimum(np.searchsorted(p, every), len(p) - 1)] == every
                    common = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
                    for j, ok in zip(js, (100 * common >= PER_CENT * (len(p) + sizes - common)).tolist(), strict=True):
                        if ok and joined.join(i, j):
                            out[0].append(min(ids[i], ids[j]))
                            out[1].append(max(ids[i], ids[j]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    group = counted(components(likely).withColumnRenamed("component", "g").join(sketch.select("id", "n_shingles", "mini"), "id"))[0]
    group = _placed(group, found)
    per = F.least(F.greatest(F.col("n") / 8, F.lit(BLOCK // 4)), F.lit(BLOCK_SHINGLES) * F.col("n") / F.col("sum"))
    blocks = group.groupBy("g").agg(F.sum("n_shingles").alias("sum"), F.count("*").alias("n")).select("g", F.ceil(F.col("n") / per).cast("int").alias("blocks"))
    placed = group.join(blocks, "g").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    full = placed.join(_sets(docs, id_col, text_col, group.select("id")), "id")
    dealt = full.select("g", F.struct("id", "c", "n_shingles", "mini", "s", "block").alias("m"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    dealt = dealt.select("g", F.least("other", "m.block").alias("i"), F.greatest("other", "m.block").alias("j"), "m")
    both = dealt.groupBy("g", "i", "j").agg(F.collect_list("m").alias("members"))  # two blocks
    return both.select("i", "j", "members").mapInArrow(run, "a long, b long").distinct()


def counted(df: DataFrame, *more) -> tuple[DataFrame, tuple]:
    """df with its lineage cut, in as many partitions as its rows need, and (rows, *more), which the same job gathers."""
    seen = Observation()
    names = [f"m{i}" for i in range(len(more))]
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(x) for c, x in zip(more, names, strict=True))))
    got = seen.get
    return out.coalesce(1 + got["n"] // FEW_ROWS), (got["n"], *(got[x] for x in names))


def forest(batches):
    """(id, component) of every node of a bounded graph's edges (u, v) of one task; component is its least node.

    Roots hang on the least root that an edge leads them to, until no edge joins two of them.
    """
    import pyarrow as pa

    table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if not table:
        return
    ids, at = np.unique(np.concatenate([table.column(c).to_numpy() for c in ("u", "v")]), return_inverse=True)
    u, v = np.split(at, 2)
    up = np.arange(len(ids))
    while len(u):
        a, b = up[u], up[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]
    for i in range(0, len(ids), FEW_ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + FEW_ROWS]), pa.array(ids[up[i : i + FEW_ROWS]])], names=["id", "component"])


def components(edges: DataFrame, local: bool = True) -> DataFrame:
    """(id, component) of every node of edges (a, b) by alternating large-star and small-star; component is its least node.

    A turn takes several jobs, each of which costs the driver memory. Edges that one partition holds well (FEW_LINKS, counted)
    are joined by one task instead, with the same result, if local is set.
    """
    sum_ = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    edges, before = counted(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), sum_)
    if local and 0 < before[0] <= FEW_LINKS:
        kind = edges.schema["u"].dataType.simpleString()
        return edges.coalesce(1).mapInArrow(forest, f"id {kind}, component {kind}")
    while before[0]:
        few = 1 + before[0] // FEW_ROWS
        limit = hot_limit(2 * before[0])
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(few)
        low, (_, most) = counted(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), F.max("n"))
        large = met(both.where("v > u"), low, ["u"], "n", limit, most=most or 0).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(few)
        # after a large-star a node points down only, to the least ones of its neighbours, whose copies go first
        down = large.groupBy("u", "v").agg(F.lit(1).alias("one")).coalesce(few)
        small = down.select("u", "v", F.min("v").over(Window.partitionBy("u")).alias("m"))
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges, now = counted(small.select("e.u", "e.v").where("u <> v").coalesce(few).distinct(), sum_)
        if now == before:
            break
        before = now
    root = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    return root.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct().join(root.select("id"), "id", "left_anti"))


def _placed(members: DataFrame, found: DataFrame | None) -> DataFrame:
    """members with c, the component that each is in so far."""
    if found is None:
        return members.withColumn("c", F.col("id"))
    return members.join(found, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")


def _hubs(at: DataFrame) -> DataFrame:
    """(key, hub, hub_c, n_all, n_out) of the buckets whose members are apart: the most central member of the largest component."""
    parts = at.groupBy("key", "c").agg(F.count("*").alias("m"), F.max(F.struct("central", F.negative("id").alias("least"))).alias("h"))
    hubs = parts.groupBy("key").agg(
        F.count("*").alias("k"),
        F.sum("m").alias("n_all"),
        F.max(F.struct("m", F.col("h.central").alias("s"), F.col("h.least").alias("least"), "c")).alias("hub"),
    ).where("k > 1")
    return hubs.select("key", F.negative("hub.least").alias("hub"), F.col("hub.c").alias("hub_c"), "n_all", (F.col("n_all") - F.col("hub.m")).alias("n_out"))


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    n = BANDS * ROWS
    base = cut(signed(docs, id_col, text_col))
    keys = base.select("id", "n_shingles", "set_key")
    reps = base.where("n_shingles > 0 and id is not null").groupBy("set_key").agg(F.min_by(F.struct("id", "n_shingles", "sig", "mini"), "id").alias("x")).select("set_key", "x.*")
    bands = banded(reps)
    limit = hot_limit(BANDS * base.count())
    shared, (_, most) = counted(bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), F.max("n"))
    members = cut(met(bands, shared, ["key"], "n", limit, most=most or 0))
    # a document in the largest buckets is nearest the middle of its group, and the best hub
    central = members.groupBy("id").agg(F.sum("n").alias("central"))
    sketch = cut(reps.select("id", "n_shingles", "mini").join(central, "id"))
    members = members.select("key", "id", "band").join(sketch.select("id", "central"), "id")
    found = None

    def merged(links):
        """Components after these links (a, b)."""
        if found is not None:
            links = links.unionByName(found.select(F.col("id").alias("a"), F.col("component").alias("b")))
        return counted(components(links))[0]

    for some in (members.where(F.col("band") < FIRST_BANDS), members):
        at = _placed(some, found)
        hubs, (_, most) = counted(_hubs(at), F.max("n_all"))
        meeting = met(at, hubs, ["key"], "n_all", limit, most=most or 0).where("c <> hub_c")
        # of a component's hubs a member takes one
        pairs = meeting.groupBy("id", "hub_c").agg(F.min("hub").alias("hub")).select("id", "hub")
        found = merged(_confirmed(docs, id_col, text_col, counted(_screened(pairs, sketch, n))[0]))
    # what is still apart: all pairs across components, compared in blocks
    at = _placed(members.drop("band"), found)
    hubs, (_, most) = counted(_hubs(at), F.max("n_all"))
    rest, (n_rest,) = counted(_blocks(cut(met(at, hubs, ["key"], "n_all", limit, most=most or 0)), sketch, n))
    if n_rest:
        found = merged(_confirmed_in_blocks(docs, id_col, text_col, rest, found, sketch, n))
    classes = reps.select("set_key", "id").join(found, "id", "left").select("set_key", F.coalesce("component", "id").alias("component_id"))
    out = keys.join(classes, "set_key", "left").select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs, with their columns, that are the first of their group of near duplicates."""
    (name,) = fresh(docs, "_kept_id")
    kept = near_duplicates(docs, text_col, id_col).where(F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias(name)).distinct()
    return docs.join(kept, F.col(id_col) == F.col(name), "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
