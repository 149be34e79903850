"""Minimum-cost-flow resharding.

Old shards hold bytes, new shards have capacities. A minimum-cost flow moves the fewest bytes: bytes that stay
cost nothing, bytes that move cost one each. Large documents are dealt first and the rest fills what remains, so new
shards come out near equal. Each old shard's rows lie in blocks by a hash; the flow cuts that order, whole blocks go to one
new shard, and only blocks at a cut are split by a running sum inside the block. The driver holds a number for each
(shard, class, block), whose count is a parameter, never rows.

Rows with equal texts are a group of copies, not a unit: the law is on bytes, so the largest group may be cut between
shards as any other rows are.

Defined cases: a null text has size 1; equal sizes and repeated rows are ordered by hash, id and text checksum; an
empty table gives an empty result; other columns are ignored by `assign` and kept by `rewrite`.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.llm.common import cut, fresh

SHARDS, OLD_SHARDS, BLOCKS = 16, 12, 64


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> list[list[int]]:
    """Successive shortest paths with potentials on the bipartite graph of old and new shards; flow[i][j]."""
    n, m = len(supply), len(capacity)
    s, t = n + m, n + m + 1
    graph: list[list[list]] = [[] for _ in range(n + m + 2)]

    def edge(u, v, c, w):
        graph[u].append([v, c, w, len(graph[v])])
        graph[v].append([u, 0, -w, len(graph[u]) - 1])

    for i, x in enumerate(supply):
        edge(s, i, x, 0)
    for j, x in enumerate(capacity):
        edge(n + j, t, x, 0)
    for i in range(n):
        for j in range(m):
            edge(i, n + j, supply[i], cost(i, j))
    height = [0] * (n + m + 2)
    while True:
        dist, back, heap = {s: 0}, {}, [(0, s)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for k, (v, c, w, _) in enumerate(graph[u]):
                x = d + w + height[u] - height[v]
                if c > 0 and x < dist.get(v, 1 << 62):
                    dist[v], back[v] = x, (u, k)
                    heapq.heappush(heap, (x, v))
        if t not in dist:
            break
        for v, d in dist.items():
            height[v] += d
        push, v = 1 << 62, t
        while v != s:
            u, k = back[v]
            push, v = min(push, graph[u][k][1]), u
        v = t
        while v != s:
            u, k = back[v]
            graph[u][k][1] -= push
            graph[v][graph[u][k][3]][1] += push
            v = u
    flow = [[0] * m for _ in range(n)]
    for i in range(n):
        for v, _, _, r in graph[i]:
            if n <= v < n + m:
                flow[i][v - n] = graph[v][r][1]
    return flow


def capacities(total: int, shards: int) -> list[int]:
    """Capacities that differ by at most one."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def sized(docs: DataFrame, old_shards: int, text_col: str, id_col: str) -> DataFrame:
    """id, size, text_crc32 and the present shard of every row, which a hash of the id gives here."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(old_shards)).cast("int").alias("old_shard"),
    )


def assign(docs: DataFrame, shards: int = SHARDS, old_shards: int = OLD_SHARDS, blocks: int = BLOCKS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, old_shard, shard, slot, moved of every row."""
    spark = docs.sparkSession
    rows = cut(sized(docs, old_shards, text_col, id_col))
    total = rows.agg(F.sum("size")).first()[0] or 0
    # large rows: over a 200th of a new shard; they are dealt first
    limit = max(2, total // (200 * shards))
    rank = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(7)), 1)
    rows = rows.withColumn("small", F.col("size") <= limit).withColumn("rank", rank).withColumn("block", F.pmod("rank", F.lit(blocks)).cast("int"))
    sums = rows.groupBy("small", "old_shard", "block").agg(F.sum("size").alias("bytes")).collect()  # at most 2 * old_shards * blocks rows
    held = {(r.small, r.old_shard, r.block): r.bytes for r in sums}
    room, done = capacities(total, shards), None
    for small in (False, True):
        bytes_of = [[held.get((small, i, b), 0) for b in range(blocks)] for i in range(old_shards)]
        supply = [sum(x) for x in bytes_of]
        cap = room if small else capacities(sum(supply), shards)
        flow = min_cost_flow(supply, cap, lambda i, j: int(i != j))
        part = cut(_deal(rows.where(F.col("small") == small), bytes_of, flow))
        if not small:  # what the large rows really took
            took = {r.shard: r.b for r in part.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
            room = [max(0, x - took.get(j, 0)) for j, x in enumerate(room)]
        done = part if done is None else done.unionByName(part)
    out = slots(done, blocks)
    return out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int")).withColumn("moved", F.col("old_shard") != F.col("shard"))


def _cuts(sizes: list[int], flow: list[int]) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each block of one old shard: the bytes of the block from which on each new shard takes it."""
    turns = [(j, x) for j, x in enumerate(flow) if x]
    out, k, left = [], 0, turns[0][1] if turns else 0
    for b, size in enumerate(sizes):
        if not size:
            continue
        at, cuts = 0, []
        while True:
            if left == 0 and k + 1 < len(turns):
                k += 1
                left = turns[k][1]
            cuts.append((at, turns[k][0]))
            take = min(left, size - at)
            at, left = at + take, left - take
            if at >= size or (left == 0 and k + 1 == len(turns)):
                break
        out.append((b, cuts))
    return out


def _deal(rows: DataFrame, bytes_of: list[list[int]], flow: list[list[int]]) -> DataFrame:
    """rows with their new shard: whole blocks by a table, blocks at a cut by a running sum inside."""
    schema = "old_shard int, block int, cuts array<struct<at: long, to: int>>"
    table = [(i, b, cuts) for i, sizes in enumerate(bytes_of) for b, cuts in _cuts(sizes, flow[i])]
    joined = rows.join(F.broadcast(rows.sparkSession.createDataFrame(table, schema)), ["old_shard", "block"])
    whole = joined.where(F.size("cuts") == 1).withColumn("shard", F.col("cuts")[0]["to"])
    part = Window.partitionBy("old_shard", "block").orderBy("rank", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    split = joined.where(F.size("cuts") > 1).withColumn("middle", F.coalesce(F.sum("size").over(part), F.lit(0)) + F.expr("size div 2"))
    split = split.withColumn("shard", F.element_at(F.filter("cuts", lambda c: c["at"] <= F.col("middle")), -1)["to"])
    names = ("doc_id", "size", "text_crc32", "old_shard", "shard", "rank", "block")
    return whole.select(*names).unionByName(split.select(*names))


def slots(rows: DataFrame, blocks: int) -> DataFrame:
    """A gapless place in each shard: the place inside a (shard, block) plus the rows of earlier blocks."""
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("shard", "block").orderBy("rank", "doc_id", "text_crc32", "size"))
    return rows.withColumn("place", place).join(F.broadcast(start), ["shard", "block"]).withColumn("slot", (F.col("start") + F.col("place") - 1).cast("long")).drop("start", "place", "rank", "block")


def rewrite(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the shards that lose or gain rows, one folder each; untouched shards keep their files, and folders of old
    shards that are no more go. The n-th copy of a row goes where the n-th of its equals in placed does."""
    (n, size, crc, shard) = fresh(docs, "_n", "_size", "_crc", "shard")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({size: F.octet_length(text).cast("long") + 1, crc: F.crc32(F.encode(text, "UTF-8"))})
    copy = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.lit(0)))
    left = keyed.withColumn(n, copy(id_col, size, crc))
    right = placed.select(
        F.col("doc_id").alias("_id"),
        F.col("size").alias(size),
        F.col("text_crc32").alias(crc),
        F.col("shard").alias(shard),
        "old_shard",
        "moved",
        copy("doc_id", "size", "text_crc32").alias(n),
    )
    touched = placed.where("moved").select(F.explode(F.array("old_shard", "shard")).alias(shard)).distinct()
    rows = left.join(right.withColumnRenamed("_id", "_id_"), [F.col(id_col).eqNullSafe(F.col("_id_")), *(left[c] == right[c] for c in (size, crc, n))])
    rows = rows.select(*[left[c] for c in docs.columns], right[shard]).join(F.broadcast(touched), shard, "left_semi")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(shard).parquet(path)
    jvm = docs.sparkSession.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(docs.sparkSession.sparkContext._jsc.hadoopConfiguration())
    kept = {r[shard] for r in placed.select(F.col("shard").alias(shard)).distinct().collect()}  # at most one row a shard
    for r in placed.select("old_shard").distinct().collect():
        if r.old_shard not in kept:
            fs.delete(jvm.org.apache.hadoop.fs.Path(root, f"{shard}={r.old_shard}"), True)
