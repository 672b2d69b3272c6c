"""Reproducible random order, quotas and the stratified sample."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refracta.constants import SAMPLE_LANGUAGE_QUOTA, SAMPLE_TIER_SHARE
from refracta.functions.metrics import complexity_tier
from refracta.session import literal_rows

#: Parts in which the rows of a group are ranked before its final ranking.
SALTS = 32


def random_order(key: Column, seed: str) -> Column:
    """A shuffled but repeatable order, equal on every run and every cluster."""
    return F.md5(F.concat(key.cast("string"), F.lit(seed)))


def chosen_per_group(
    df: DataFrame, group: Sequence[str], quotas: dict[tuple, int], order: Sequence[str]
) -> DataFrame:
    """First ``quota`` rows of every group in ``order``, all columns of ``df``.

    Two stages: the rows of a group are ranked in SALTS parts, and what is left of the parts,
    at most SALTS quotas, is ranked as a whole. Spark cuts small quotas in every task
    already, before the shuffle.
    """
    limit = max(quotas.values(), default=0)
    kinds = dict(df.select(*group).dtypes)
    table = literal_rows(
        df.sparkSession,
        [(*values, quota) for values, quota in quotas.items() if quota > 0],
        ", ".join([*(f"{g} {kinds[g]}" for g in group), "__quota int"]),
    )
    salt = F.pmod(F.xxhash64(*order), F.lit(SALTS))
    in_part = F.row_number().over(Window.partitionBy(*group, salt).orderBy(*order))
    in_group = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return (
        df.join(table, list(group))
        .withColumn("__rn", in_part)
        .filter(F.col("__rn") <= limit)
        .withColumn("__rn", in_group)
        .filter(F.col("__rn") <= F.col("__quota"))
        .select(*df.columns)
    )


def rows_of(df: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose ``keys`` are among those of ``chosen``; NULLs are equal."""
    renamed = chosen.select(*[F.col(k).alias(f"__chosen_{k}") for k in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__chosen_{k}")) for k in keys])
    return df.join(renamed, same, "left_semi")


def take_per_group(
    df: DataFrame, group: Sequence[str], quotas: dict[tuple, int], order: Sequence[str]
) -> DataFrame:
    """First ``quota`` rows of every group in ``order``; groups without a quota give none.

    ``order`` must be total within a group. Only ``group`` and ``order`` are ranked; the
    other columns, texts among them, are read for the chosen rows alone.
    """
    keys = list(dict.fromkeys([*group, *order]))
    return rows_of(df, chosen_per_group(df.select(*keys), group, quotas, order), keys)


def stratum_quotas(
    language_quota: dict[str, int] | None = None, tier_share: dict[str, float] | None = None
) -> dict[tuple, int]:
    """Quota per (language, tier): truncated shares, the remainder goes to complex."""
    language_quota = SAMPLE_LANGUAGE_QUOTA if language_quota is None else language_quota
    tier_share = SAMPLE_TIER_SHARE if tier_share is None else tier_share
    quotas = {}
    for language, total in language_quota.items():
        parts = {tier: int(total * share) for tier, share in tier_share.items()}
        parts["complex"] = total - sum(parts.values())
        quotas |= {(language, tier): n for tier, n in parts.items()}
    return quotas


def stratified_sample(
    functions: DataFrame, seed: str = "0", quotas: dict[tuple, int] | None = None
) -> DataFrame:
    """Random sample with a fixed quota per (language, tier)."""
    quotas = stratum_quotas() if quotas is None else quotas
    keyed = functions.withColumns(
        {
            "tier": complexity_tier(F.col("cyclomatic_complexity")),
            "__order": random_order(F.col("id"), seed),
        }
    )
    return take_per_group(keyed, ["language", "tier"], quotas, ["__order", "id"]).drop("__order")


def sample_report(sample: DataFrame, quotas: dict[tuple, int] | None = None) -> DataFrame:
    """Sampled rows per stratum against the quota, with the shortfall."""
    quotas = stratum_quotas() if quotas is None else quotas
    targets = literal_rows(
        sample.sparkSession,
        [(*k, v) for k, v in quotas.items()], "language string, tier string, quota bigint"
    )
    actual = sample.groupBy("language", "tier").agg(F.count(F.lit(1)).alias("n"))
    return targets.join(actual, ["language", "tier"], "left").select(
        "language",
        "tier",
        "quota",
        F.coalesce("n", F.lit(0)).alias("sampled"),
        (F.col("quota") - F.coalesce("n", F.lit(0))).alias("shortfall"),
    )


def hardest(functions: DataFrame, above_cc: int = 20) -> DataFrame:
    return functions.filter(F.col("cyclomatic_complexity") > above_cc)


def best_combinations(facts: DataFrame, n: int = 5) -> DataFrame:
    """Top ``n`` (task, strategy) by mean score."""
    return (
        facts.filter(F.col("se_score").isNotNull())
        .groupBy("task", "strategy")
        .agg(F.avg("se_score").alias("mean_se"))
        .orderBy(F.desc("mean_se"), "task", "strategy")
        .limit(n)
    )


def feed_forward(facts: DataFrame, n: int = 5) -> DataFrame:
    """Rows of the best combinations; the combinations number at most ``n``."""
    best = best_combinations(facts, n).select("task", "strategy")
    return facts.join(F.broadcast(best), ["task", "strategy"], "left_semi")
