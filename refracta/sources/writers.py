"""Writers: exports, appends that respect the natural key, table versions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refracta.constants import NATURAL_KEY
from refracta.functions.domains import suite_file_name
from refracta.operators.corpus import keep_first
from refracta.operators.sampling import rows_of
from refracta.session import bounded_broadcast
from refracta.sources.files import exists


def write_function_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def new_results(
    new: DataFrame, facts: DataFrame, arrival: Sequence[str], key: Sequence[str] = NATURAL_KEY
) -> DataFrame:
    """Results whose key is new, first copy of each. NULLs in a key are equal.

    The stored keys are reduced to those of ``new`` where they are read; with few new keys
    nothing of ``facts`` is shuffled.
    """
    arriving = bounded_broadcast(new.select(*key).distinct())
    known = rows_of(facts.select(*key), arriving, key)
    renamed = known.select(*[F.col(k).alias(f"__known_{k}") for k in key])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__known_{k}")) for k in key])
    return keep_first(new, key, arrival).join(renamed, same, "left_anti")


def append_results(
    new: DataFrame, path: str, arrival: Sequence[str], key: Sequence[str] = NATURAL_KEY,
    partition_by: Sequence[str] = ("task",),
) -> None:
    """Append results that the table at ``path`` does not hold yet.

    Running it twice with the same input appends nothing the second time.
    """
    spark = new.sparkSession
    if exists(spark, path):
        fresh = new_results(new, spark.read.parquet(path), arrival, key)
    else:
        fresh = keep_first(new, key, arrival)
    fresh.write.mode("append").partitionBy(*partition_by).parquet(path)


def with_suite_path(functions: DataFrame, suites: DataFrame) -> DataFrame:
    """Next version of ``functions`` with the path of newly generated suites."""
    fresh = suites.groupBy(F.col("function_id").alias("id")).agg(F.max("file_name").alias("__path"))
    return (
        functions.join(fresh, "id", "left")
        .withColumn("test_suite_path", F.coalesce("__path", "test_suite_path"))
        .drop("__path")
        .select(*functions.columns)
    )


def suite_files(generated: DataFrame) -> DataFrame:
    """(language, function_id, file_name, test_code) of the suites that were generated."""
    return generated.filter(F.col("test_code").isNotNull()).select(
        "language",
        "function_id",
        suite_file_name(F.col("function_id"), F.col("language")).alias("file_name"),
        "test_code",
    )


def write_suites(generated: DataFrame, path: str, mode: str = "errorifexists") -> None:
    suite_files(generated).write.mode(mode).partitionBy("language").parquet(path)


def write_summary_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_tier_jsonl(facts_with_tier: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Full export, one folder per tier."""
    facts_with_tier.write.mode(mode).partitionBy("tier").json(path)
