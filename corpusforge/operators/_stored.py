"""Results written to the shared folder and read back, where a plan needs them more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that is broadcast at most.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name under ``spark.checkpoint.dir``, which every executor sees. Only a local
    session without that setting (a test) has one chosen for it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusforge-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once; a lost executor costs a reread and not a recomputation."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def beside(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` for a join: broadcast if it has been counted and is small, else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
