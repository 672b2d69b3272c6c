"""Session settings and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "refracta", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution.

    Shuffle width is left to the cluster's own setting plus AQE coalescing, so the
    same code serves a laptop and a large cluster.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own; a cluster without the
    setting is an error, since a machine-local folder is lost with its machine.
    """
    global _own_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="refracta-")
    return _own_dir


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so a lost executor does not replay what came before."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


#: Rows of at most some 100 bytes: a broadcast of this many stays below 64 MiB.
BROADCAST_ROWS = 500_000


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, written out, and hinted for broadcast only when its counted rows are few.

    For narrow tables. Beyond the bound the join is left to a shuffle; the rows are the same.
    """
    kept = cut_lineage(df)
    return F.broadcast(kept) if kept.count() <= rows else kept


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of all inputs of the plan, or None when the session cannot tell."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        return sum(
            int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())
        )
    except AttributeError:
        return None


def settled(df: DataFrame) -> DataFrame:
    """``df``, whose costly columns are computed here, once, whatever filters follow.

    A filter would else move below the projection or shuffle that ``df`` ends in and compute
    the columns that it names anew there. It stays above a condition on a column that is not
    deterministic; this one always holds. Filters on cheap columns belong before.
    """
    return df.withColumn("__part", F.spark_partition_id()).filter("__part >= 0").drop("__part")


def spread(df: DataFrame) -> DataFrame:
    """Give heavy per-row work enough partitions when the input is too small to have them.

    A small file arrives as one split and would keep one core busy. An input that fills
    the cores by itself is left where it is: moving it would cost a shuffle for nothing.
    Filters that follow stay behind the shuffle, since their columns may be the heavy work.
    """
    sc = df.sparkSession.sparkContext
    size = input_bytes(df)
    split = 16 * 1024 * 1024
    if size is None or size >= split * sc.defaultParallelism:
        return df
    return settled(df.repartition(sc.defaultParallelism))


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few constant rows as a plan of literals.

    Catalyst knows its size, so joins with it are broadcast on the optimizer's own check.
    """
    fields = [c.split() for c in schema.split(", ")]
    items = [
        F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, fields, strict=True)])
        for row in rows
    ]
    empty = ", ".join(f"{name}:{kind}" for name, kind in fields)
    table = F.array(*items).cast(f"array<struct<{empty}>>")
    return spark.range(1).select(F.inline(table))
