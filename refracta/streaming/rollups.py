"""Streaming forms of the daily roll-up, the monitors and the idempotent append.

Event time decides the day. Nothing here drops late rows: there is no watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from refracta.constants import NATURAL_KEY
from refracta.operators.cost import daily_rollup, latency_sketches, merged_sketches, total_of_rollups
from refracta.operators.monitor import merged_parts, monitor_parts, monitor_report
from refracta.schemas import COST_TRACKING, LATENCY_SKETCHES, MONITOR_PARTS
from refracta.sources.files import delete_path, matching_paths
from refracta.sources.writers import append_results

Reduce = Callable[[DataFrame], DataFrame]


def monitor_stream(stream: DataFrame) -> DataFrame:
    """Rows, pending scores and spend per model."""
    return stream.groupBy("model").agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if(F.col("se_score").isNull()).alias("pending"),
        F.sum("cost_usd").alias("cost_usd"),
    )


def write_part(batch: DataFrame, epoch: int, target: str, reduce: Reduce) -> None:
    """What one batch alone adds, in a folder of its own that a replay overwrites."""
    reduce(batch).write.mode("overwrite").parquet(f"{target}/part={epoch}")


def start_parts(stream: DataFrame, reduce: Reduce, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep ``reduce`` of a stream as one part per batch.

    There is no state and no watermark: a row of any age counts in the part of its batch, and
    readers merge the parts. One target belongs to one checkpoint.
    """
    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, epoch: write_part(batch, epoch, target, reduce))
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _part_folders(spark: SparkSession, target: str) -> tuple[dict[int, str], dict[int, str]]:
    """Complete folders by number: bases and parts."""
    found: dict[str, dict[int, str]] = {"base": {}, "part": {}}
    for kind, folders in found.items():
        for path in matching_paths(spark, f"{target}/{kind}=*/_SUCCESS"):
            folder = path.rsplit("/", 1)[0]
            folders[int(folder.rsplit("=", 1)[1])] = folder
    return found["base"], found["part"]


def _counting(bases: dict[int, str], parts: dict[int, str]) -> list[str]:
    """The last base and the parts it does not hold."""
    last = max(bases, default=-1)
    return [*([bases[last]] if bases else []), *[v for k, v in parts.items() if k > last]]


def read_parts(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """The rows of all parts so far, not merged; none before the first batch."""
    return _read(spark, _counting(*_part_folders(spark, target)), schema)


def _read(spark: SparkSession, folders: Sequence[str], schema: StructType) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def compact_parts(spark: SparkSession, target: str, schema: StructType, merge: Reduce) -> None:
    """Fold all parts so far into one base, so that the folders stay few.

    The base holds every part up to its number; a part that is replayed later is not counted
    again. What the base replaces is deleted after it is complete.
    """
    bases, parts = _part_folders(spark, target)
    kept = max(bases, default=-1)
    if max(parts, default=-1) > kept:
        kept = max(parts)
        merge(_read(spark, _counting(bases, parts), schema)).write.mode("overwrite").parquet(f"{target}/base={kept}")
    stale = [v for k, v in parts.items() if k <= kept] + [v for k, v in bases.items() if k < kept]
    for path in stale:
        delete_path(spark, path)


def write_rollup_part(batch: DataFrame, epoch: int, target: str) -> None:
    """The roll-up of one batch alone."""
    write_part(batch, epoch, target, daily_rollup)


def start_rollup(stream: DataFrame, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Calls, spend, latency and outcomes per (date, model), as one part per batch."""
    return start_parts(stream, daily_rollup, target, checkpoint, **trigger)


def read_rollup(spark: SparkSession, target: str) -> DataFrame:
    """Every group over all batches so far."""
    return total_of_rollups(read_parts(spark, target, COST_TRACKING))


def compact_rollup(spark: SparkSession, target: str) -> None:
    """Fold the parts of a roll-up."""
    compact_parts(spark, target, COST_TRACKING, total_of_rollups)


def start_latencies(stream: DataFrame, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Latency sketches per (date, model), as one part per batch."""
    return start_parts(stream, latency_sketches, target, checkpoint, **trigger)


def read_latencies(spark: SparkSession, target: str, group: Sequence[str] = ("date", "model")) -> DataFrame:
    """One sketch per group over all batches so far; ``operators.cost.sketched_percentiles`` reads it."""
    return merged_sketches(read_parts(spark, target, LATENCY_SKETCHES), group)


def compact_latencies(spark: SparkSession, target: str) -> None:
    """Fold the parts of a latency roll-up."""
    compact_parts(spark, target, LATENCY_SKETCHES, merged_sketches)


def start_monitor(stream: DataFrame, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """The whole monitor live: totals with distinct functions and models, the models, and the
    task x strategy cells, as one part per batch."""
    return start_parts(stream, monitor_parts, target, checkpoint, **trigger)


def read_monitor(spark: SparkSession, target: str) -> DataFrame:
    """All blocks of the monitor (``operators.monitor.monitor_report``) over all batches so far."""
    return monitor_report(merged_parts(read_parts(spark, target, MONITOR_PARTS)))


def compact_monitor(spark: SparkSession, target: str) -> None:
    """Fold the parts of a monitor; functions seen in many batches become one row each."""
    compact_parts(spark, target, MONITOR_PARTS, merged_parts)


def start_append_once(
    stream: DataFrame, path: str, checkpoint: str, arrival: Sequence[str],
    key: Sequence[str] = NATURAL_KEY, **trigger,
) -> StreamingQuery:
    """Append each key once, across batches and restarts.

    The anti-join against the table makes a replayed batch harmless.
    """

    def write(batch: DataFrame, _epoch: int) -> None:
        append_results(batch, path, arrival, key)

    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start_table(query: DataFrame, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep an aggregate as a table for a live monitor.

    Every batch writes all groups as a version of its own, which a replay overwrites; the
    version before it stays for readers that have begun, older ones go.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/version={epoch}")
        for version, folder in _versions(batch.sparkSession, target).items():
            if version < epoch - 1:
                delete_path(batch.sparkSession, folder)

    return (
        query.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _versions(spark: SparkSession, target: str) -> dict[int, str]:
    """Complete versions of a live table by number."""
    folders = [p.rsplit("/", 1)[0] for p in matching_paths(spark, f"{target}/version=*/_SUCCESS")]
    return {int(f.rsplit("=", 1)[1]): f for f in folders}


def read_table(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """The newest complete version of a live table; no rows before the first one."""
    versions = _versions(spark, target)
    return _read(spark, [versions[max(versions)]] if versions else [], schema)
