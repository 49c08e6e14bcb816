"""Cutting lineage, checked broadcasts and numbers a partition."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it has no more rows and bytes of keys than these.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of the cluster that driver and executors share (spark.checkpoint.dir); a temporary one only on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            shared = tempfile.mkdtemp(prefix="lexigrid-checkpoint-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def is_small(df: DataFrame, key: str, more: int = 0, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """Whether counting shows no more than `rows` rows and `most` bytes of keys and of `more` a row. df is computed once more, so settle it first."""
    size = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.col(key).cast("string"))), F.lit(0)).alias("bytes")).first()
    return size["n"] <= rows and size["bytes"] + more * size["n"] <= most


def broadcast_if_small(df: DataFrame, key: str, more: int = 0) -> DataFrame:
    """df, marked for broadcast if it is small; else as it is, and the join shuffles."""
    return F.broadcast(df) if is_small(df, key, more) else df


def by_number(values: dict[int, int], number: Column) -> Column:
    """The value of a small whole number (a partition's, say), looked up in one constant array."""
    listed = ",".join(str(values.get(k, 0)) for k in range(max(values) + 1))
    return F.element_at(F.split(F.lit(listed), ",").cast("array<bigint>"), number.cast("int") + 1)


def require_unique(df: DataFrame, *keys: str) -> None:
    """Raise if several rows share their keys, as their sums would merge."""
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"{', '.join(keys)} must tell rows apart")
