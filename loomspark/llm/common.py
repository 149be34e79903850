"""Shared pieces of the training-data operators."""

from __future__ import annotations

import base64
import functools
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z only, as bytes.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
U64 = np.uint64


def read(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def encoded(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty. Lone surrogates can't come from Spark."""
    return (text or "").encode("utf-8", "replace")


def ensure_checkpoint(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir. Only where Spark runs in this process alone (tests) a folder of its own will do."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="loomspark-"))


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint."""
    ensure_checkpoint(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, in any case of letters."""
    had = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in had:
            n += "_"
        out.append(n)
    return out


#: Hot keys at most (a few MB with short values), and rows from which a key may be one.
HOT_KEYS, HOT_ROWS = 50_000, 256


def hot_limit(rows: int) -> int:
    """Rows from which a key is hot, so that no more than HOT_KEYS are."""
    return max(HOT_ROWS, rows // HOT_KEYS)


def met(rows_: DataFrame, table: DataFrame, key: list[str], n: str, limit: int, short=None, most: int | None = None) -> DataFrame:
    """rows_ joined with table, which has a row for each key and n, the number of its rows (or about it).

    Keys with limit rows or more (that are short, if that is asked) are few and go to the rows by broadcast; only the
    others are dealt out, so no key is one task's. Where the greatest n is known (most) and under the limit, there are none.
    """
    if most is not None and most < limit:
        return rows_.join(table, key)
    is_hot = F.col(n) >= limit if short is None else (F.col(n) >= limit) & short
    hot = table.where(is_hot)
    cold = rows_.join(F.broadcast(hot.select(*key)), key, "left_anti")
    return rows_.join(F.broadcast(hot), key).unionByName(cold.join(table.where(~is_hot), key))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@functools.cache
def bpe(file: str):
    """A public byte-level BPE vocabulary as a tiktoken encoding, one for each worker process."""
    import public_tokenizers as P
    import tiktoken

    with open(P.path(file), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(file, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def rows(batches, *names):
    """Python tuples of the named columns of Arrow batches."""
    for b in batches:
        cols = [b.column(b.schema.get_field_index(n)).to_pylist() for n in names]
        yield from zip(*cols, strict=True)


def batches_of(it, schema, size: int = 4096):
    """Arrow batches of the tuples that an iterator yields."""
    import pyarrow as pa

    buf: list = []
    for r in it:
        buf.append(r)
        if len(buf) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*buf, strict=True), schema, strict=True)], schema=schema)
            buf = []
    if buf:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*buf, strict=True), schema, strict=True)], schema=schema)
