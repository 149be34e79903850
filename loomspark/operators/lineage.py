"""Results that are worked out once and read several times, and sides of joins of a checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides of joins up to so many rows are broadcast; others are joined by shuffles, or taken in blocks.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if its counted rows are within the bound."""
    return F.broadcast(df) if df.count() <= rows else df


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints, from spark.checkpoint.dir.

    Only where Spark runs in this process alone and no folder is set, one of its own will do.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="loomspark-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder, so that what reads it doesn't work it out anew."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
