"""The model catalogue: a literal table of a few rows, tier by tier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refracta.constants import BUDGET_TIER_PCT, MODELS
from refracta.session import literal_rows

SCHEMA = "tier string, id string, name string, cost_per_1k_tokens double"


def models(spark: SparkSession, rows: Sequence[tuple] = MODELS) -> DataFrame:
    return literal_rows(spark, list(rows), SCHEMA)


def models_of_tier(catalogue: DataFrame, tier: str) -> DataFrame:
    if tier not in BUDGET_TIER_PCT:
        raise ValueError(f"unknown tier: {tier}")
    return catalogue.filter(F.col("tier") == tier)


def combine_tiers(parts: Sequence[DataFrame]) -> DataFrame:
    """Several tier lists as one; a model in two of them belongs to the lower tier."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def with_model_attributes(df: DataFrame, catalogue: DataFrame, strict: bool = False) -> DataFrame:
    """Tier and rate of each row's model; the first tier wins for a model listed twice.

    ``strict`` raises on a model the catalogue lacks instead of leaving NULLs.
    """
    first = catalogue.groupBy(F.col("id").alias("model")).agg(
        F.min_by(F.struct("tier", "cost_per_1k_tokens"), "tier").alias("m")
    )
    out = df.join(first, "model", "left")
    if strict:
        missing = out.filter(F.col("m").isNull()).select("model").limit(1).collect()
        if missing:
            raise ValueError(f"model not in catalogue: {missing[0]['model']}")
    return out.select(
        *df.columns,
        F.col("m.tier").alias("tier"),
        F.col("m.cost_per_1k_tokens").alias("cost_per_1k_tokens"),
    )
