"""Ranks, running totals and exact quantiles over groups of any size.

A window without a (small) partition key runs in one task, and a built-in
``percentile`` keeps all distinct values of a group in one. The operators here split
the work by range instead: rows are range-partitioned on the full order, each range
gets its totals, the few totals are prefix-summed, and only then does a window run
inside each range. A group holding a third of all rows is spread like any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refracta.session import cut_lineage

PART = "__part"


def ranged(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Range-partition on ``order`` and pin each row's range number as ``__part``.

    The order must be total: equal keys always share a range. The checkpoint fixes
    the range numbers; recomputing them could cut the ranges elsewhere.
    """
    return cut_lineage(df.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()))


def _offsets(parts: DataFrame, group: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """Per (group, range): totals of the ranges before. One row per group and range."""
    per_part = parts.groupBy(*group, PART).agg(*[v.alias(k) for k, v in totals.items()])
    before = (
        Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    )
    return per_part.select(
        *[F.col(g).alias(f"__key_{g}") for g in group],
        F.col(PART).alias("__key_part"),
        *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"__before_{k}") for k in totals],
    )


def _same_group(group: Sequence[str]) -> Column:
    cond = F.lit(True)
    for g in group:
        cond &= F.col(g).eqNullSafe(F.col(f"__key_{g}"))
    return cond


def _join_offsets(parts: DataFrame, offsets: DataFrame, group: Sequence[str]) -> DataFrame:
    cond = _same_group(group) & (F.col(PART) == F.col("__key_part"))
    return parts.join(offsets, cond, "left").drop("__key_part", *[f"__key_{g}" for g in group])


def running_totals(
    df: DataFrame, outs: Mapping[str, str], order: Sequence[str], group: Sequence[str] = ()
) -> DataFrame:
    """Sums over the rows before this one in ``order`` (within ``group``).

    ``outs`` names the sum of each value. All columns of ``df`` are written once on the way:
    select what is needed first.
    """
    parts = ranged(df, [*group, *order])
    offsets = _offsets(parts, group, {v: F.sum(F.coalesce(F.col(v), F.lit(0))) for v in outs})
    inside = (
        Window.partitionBy(*group, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    sums = {
        out: F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"__before_{v}") for v, out in outs.items()
    }
    return (
        _join_offsets(parts, offsets, group)
        .withColumns(sums)
        .drop(PART, *[f"__before_{v}" for v in outs])
    )


def running_total(
    df: DataFrame, value: str, order: Sequence[str], out: str, group: Sequence[str] = ()
) -> DataFrame:
    """Sum of ``value`` over the rows before this one in ``order`` (within ``group``)."""
    return running_totals(df, {value: out}, order, group)


def running_max(df: DataFrame, value: str, order: str, out: str) -> DataFrame:
    """Largest ``value`` over the rows before this one in ``order``, NULL for the first."""
    parts = ranged(df, [order])
    before = Window.orderBy("__key_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy(F.col(PART).alias("__key_part"))
        .agg(F.max(value).alias("__m"))
        .select("__key_part", F.max("__m").over(before).alias("__before_m"))
    )
    inside = Window.partitionBy(PART).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        _join_offsets(parts, offsets, ())
        .withColumn(out, F.greatest(F.max(value).over(inside), F.col("__before_m")))
        .drop(PART, "__before_m")
    )


def row_numbers(df: DataFrame, order: Sequence[str], out: str, group: Sequence[str] = ()) -> DataFrame:
    """1-based position in ``order`` within ``group``; the order must be total."""
    parts = ranged(df, [*group, *order])
    offsets = _offsets(parts, group, {"n": F.count(F.lit(1))})
    inside = Window.partitionBy(*group, PART).orderBy(*order)
    return (
        _join_offsets(parts, offsets, group)
        .withColumn(out, F.row_number().over(inside) + F.col("__before_n"))
        .drop(PART, "__before_n")
    )


def value_ranks(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Per distinct value: ``n`` rows, ``below`` rows under it and its average rank.

    Values are counted before anything is moved, so ties cost nothing.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(
        F.count(F.lit(1)).alias("n")
    )
    below = running_total(counts, "n", [value], "below", group)
    return below.withColumn("avg_rank", F.col("below") + (F.col("n") + 1) / 2)


def value_summary(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    sums: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Per group: ``n`` values, their ``mean`` and sample deviation ``std``, exact interpolated
    quantiles (one column per entry of ``probabilities``) and ``sums``.

    ``sums`` names aggregates that add up (sums and counts). One plan for inputs of any size,
    which reads the input once: rows are aggregated per (group, value), these are
    range-partitioned, and each range knows how many rows of its group come before it and how
    many there are in all. A group is never gathered. A NULL group is a group; a group without
    values gets NULLs; NaN is the largest value; infinities stay as the built-in has them.
    """
    sums = dict(sums or {})
    counts = df.groupBy(*group, value).agg(
        F.count(value).alias("n"), *[v.alias(f"__sum_{k}") for k, v in sums.items()]
    )
    parts = ranged(counts, [*group, value])
    number = F.col(value).cast("double")
    per_part = parts.groupBy(*group, PART).agg(
        F.sum("n").alias("__in_part"), F.sum(F.when(F.col("n") > 0, number * F.col("n"))).alias("__of_part")
    )
    whole = Window.partitionBy(*group)
    before = whole.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    rows = F.sum("__in_part").over(whole)
    offsets = per_part.select(
        *[F.col(g).alias(f"__key_{g}") for g in group],
        F.col(PART).alias("__key_part"),
        F.coalesce(F.sum("__in_part").over(before), F.lit(0)).alias("__before_n"),
        rows.alias("__rows"),
        F.try_divide(F.sum("__of_part").over(whole), rows).alias("__mean"),
    )
    inside = Window.partitionBy(*group, PART).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = _join_offsets(
        parts.withColumn("__local", F.coalesce(F.sum("n").over(inside), F.lit(0))), offsets, group
    ).withColumn("__below", F.col("__local") + F.col("__before_n"))
    picked = []
    for name, p in probabilities.items():
        position = (F.col("__rows") - 1) * F.lit(float(p))
        lower = F.floor(position)
        for suffix, at in (("lo", lower), ("hi", F.ceil(position))):
            hit = (F.col("__below") <= at) & (at < F.col("__below") + F.col("n"))
            picked.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"__{name}_{suffix}"))
        picked.append(F.max(position - lower).alias(f"__{name}_w"))
    away = number - F.col("__mean")
    found = ranked.groupBy(*group).agg(
        F.sum("n").alias("__n"),
        F.max("__mean").alias("__mean"),
        F.sum(F.when(F.col("n") > 0, away * away * F.col("n"))).alias("__squares"),
        *[F.sum(f"__sum_{k}").alias(f"__sum_{k}") for k in sums],
        *picked,
    )

    def between(name: str) -> Column:
        lo, hi, weight = (F.col(f"__{name}_{x}") for x in ("lo", "hi", "w"))
        return F.when(lo == hi, lo).otherwise(lo * (1 - weight) + hi * weight).alias(name)

    deviation = F.when(F.col("__n") > 1, F.sqrt(F.try_divide(F.col("__squares"), F.col("__n") - 1)))
    return found.select(
        *group,
        F.col("__n").alias("n"),
        F.col("__mean").alias("mean"),
        deviation.alias("std"),
        *[between(n) for n in probabilities],
        *[F.col(f"__sum_{k}").alias(k) for k in sums],
    )


def quantiles(
    df: DataFrame, group: Sequence[str], value: str, probabilities: dict[str, float]
) -> DataFrame:
    """Exact interpolated quantiles per group, as :func:`value_summary` finds them."""
    return value_summary(df, group, value, probabilities).select(*group, *probabilities)
