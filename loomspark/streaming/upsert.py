"""Metrics that arrive as a stream, upserted batch by batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomspark.operators.metrics import upsert
from loomspark.sources import versions


def upserted(spark: SparkSession, path: str) -> DataFrame | None:
    """The current version of an upserted table; null before the first batch."""
    note = versions.current(spark, path)
    return spark.read.parquet(versions.path_of(path, note)) if note else None


def upsert_stream(stream: DataFrame, path: str, keys: list[str], checkpoint: str, order: str):
    """Starts a query that keeps a table at the last row of each key, in `order` inside a batch.

    A batch writes a new version and then a note of it, with its number: readers see a whole version, a batch that is
    broken off leaves the one before, and one that comes again after its note changes nothing.
    """
    spark = stream.sparkSession

    def batch(df: DataFrame, epoch: int) -> None:
        note = versions.current(spark, path)
        if note and note["epoch"] >= epoch:
            return
        old = spark.read.parquet(versions.path_of(path, note)) if note else df.limit(0)
        version = f"v-{epoch}-{uuid.uuid4().hex}"
        upsert(old, df, keys, order).write.parquet(f"{path}/{version}")
        versions.commit(spark, path, version, epoch=epoch)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
