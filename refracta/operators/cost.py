"""Spend: daily roll-up, totals, budgets and usage."""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refracta.constants import BUDGET_EXHAUSTED_AT, BUDGET_TIER_PCT, BUDGET_TOTAL_USD
from refracta.functions.attributes import ratio_or_zero
from refracta.functions.responses import estimated_cost
from refracta.sources.catalogue import models_of_tier
from refracta.session import literal_rows

#: Size of the latency sketches; see ``sketch_rank_error``.
SKETCH_K = 800

ROLLUP_AGGREGATES = {
    "total_calls": lambda: F.count(F.lit(1)),
    "total_cost_usd": lambda: F.sum(F.coalesce("cost_usd", F.lit(0.0))),
    "avg_latency_ms": lambda: F.avg(F.coalesce(F.col("latency_ms").cast("double"), F.lit(0.0))),
    "successful_calls": lambda: F.count_if(F.col("error_type").isNull()),
    "failed_calls": lambda: F.count_if(F.col("error_type").isNotNull()),
}


def rollup_columns() -> list[Column]:
    """The daily aggregate's measures."""
    return [make().alias(name) for name, make in ROLLUP_AGGREGATES.items()]


def daily_rollup(facts: DataFrame) -> DataFrame:
    """Calls, spend, latency and outcomes per (date, model). A missing latency counts as 0."""
    return facts.groupBy(F.to_date("timestamp").alias("date"), "model").agg(*rollup_columns())


def merge_rollups(old: DataFrame, new: DataFrame) -> DataFrame:
    """Roll-up of both inputs from their roll-ups alone."""
    return total_of_rollups(old.unionByName(new.select(*old.columns)))


def total_of_rollups(parts: DataFrame) -> DataFrame:
    """One roll-up of several over disjoint rows: sums add up, means weigh by calls."""
    calls = F.sum("total_calls")
    return parts.groupBy("date", "model").agg(
        calls.alias("total_calls"),
        F.sum("total_cost_usd").alias("total_cost_usd"),
        (F.sum(F.col("avg_latency_ms") * F.col("total_calls")) / calls).alias("avg_latency_ms"),
        F.sum("successful_calls").alias("successful_calls"),
        F.sum("failed_calls").alias("failed_calls"),
    )


def sketch_rank_error(k: int = SKETCH_K) -> float:
    """Share of the values by which a rank from a sketch may be off, in 99 of 100 sketches."""
    return 2.296 / k**0.9723


def latency_sketches(facts: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """One quantile sketch of the latencies per (date, model), of bounded size.

    Rows without latency are left out; a group of only such rows has no sketch. Sketches merge
    without loss of accuracy, so days add up to any span.
    """
    timed = facts.filter(F.col("latency_ms").isNotNull())
    return timed.groupBy(F.to_date("timestamp").alias("date"), "model").agg(
        F.kll_sketch_agg_double(F.col("latency_ms").cast("double"), k).alias("latencies")
    )


def merged_sketches(parts: DataFrame, group: Sequence[str] = ("date", "model"), k: int = SKETCH_K) -> DataFrame:
    """One sketch per group from the sketches of its parts."""
    return parts.groupBy(*group).agg(F.kll_merge_agg_double("latencies", k).alias("latencies"))


def sketched_percentiles(sketches: DataFrame, probabilities: Mapping[str, float]) -> DataFrame:
    """``n`` and the percentiles of each sketch, one column per entry of ``probabilities``."""
    found = {"n": F.kll_sketch_get_n_double("latencies")}
    found |= {name: F.kll_sketch_get_quantile_double("latencies", F.lit(float(p))) for name, p in probabilities.items()}
    return sketches.withColumns(found).drop("latencies")


def mean_parts(df: DataFrame, group: Sequence[str], value: Column) -> DataFrame:
    """Sum and count of ``value`` per group: what a running mean has to remember."""
    return df.groupBy(*group).agg(F.sum(value).alias("sum"), F.count(value).alias("n"))


def merged_means(parts: DataFrame, group: Sequence[str], out: str = "mean") -> DataFrame:
    """The mean over all parts, in whatever order and pieces the rows came; NULL without values."""
    return parts.groupBy(*group).agg(F.try_divide(F.sum("sum"), F.sum("n")).alias(out))


def with_rates(rollup: DataFrame) -> DataFrame:
    """Success rate in percent and cost per call of each roll-up row."""
    return rollup.withColumns(
        {
            "success_rate": ratio_or_zero(F.col("successful_calls"), F.col("total_calls")) * 100,
            "cost_per_call": ratio_or_zero(F.col("total_cost_usd"), F.col("total_calls")),
        }
    )


def _total(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.coalesce(F.sum(column), F.lit(0.0)).alias("total_cost_usd"))


def total_cost(rollup: DataFrame) -> DataFrame:
    return _total(rollup, "total_cost_usd")


def cost_of_tier(rollup: DataFrame, models: DataFrame, tier: str) -> DataFrame:
    members = models_of_tier(models, tier).select(F.col("id").alias("model"))
    per_model = rollup.groupBy("model").agg(F.sum("total_cost_usd").alias("total_cost_usd"))
    return _total(per_model.join(members, "model", "left_semi"), "total_cost_usd")


def cost_of_model(rollup: DataFrame, model: str) -> DataFrame:
    return _total(rollup.filter(F.col("model") == model), "total_cost_usd")


def cost_of_date(rollup: DataFrame, day: datetime.date | None = None) -> DataFrame:
    when = F.current_date() if day is None else F.lit(day)
    return _total(rollup.filter(F.col("date") == when), "total_cost_usd")


def cost_per_model(rollup: DataFrame) -> DataFrame:
    return rollup.groupBy("model").agg(F.sum("total_cost_usd").alias("total_cost_usd"))


def budget_report(
    rollup: DataFrame,
    models: DataFrame,
    total: float = BUDGET_TOTAL_USD,
    tier_pct: dict[str, float] | None = None,
    threshold: float = BUDGET_EXHAUSTED_AT,
) -> DataFrame:
    """Budget, spend, remainder and exhaustion for every tier and for ``total``.

    Spend of models outside the catalogue counts in the total only; a tier without
    spend keeps its whole budget.
    """
    pct = BUDGET_TIER_PCT if tier_pct is None else tier_pct
    budgets = literal_rows(
        rollup.sparkSession,
        [(tier, total * p / 100.0) for tier, p in pct.items()] + [("total", float(total))],
        "tier string, budget_usd double",
    )
    # After this aggregation there is one row per model.
    tiers = models.select(F.col("id").alias("model"), "tier")
    spent = (
        cost_per_model(rollup)
        .join(tiers, "model", "left")
        .select(F.explode(F.array_compact(F.array("tier", F.lit("total")))).alias("tier"), "total_cost_usd")
        .groupBy("tier")
        .agg(F.sum("total_cost_usd").alias("s"))
    )
    return (
        budgets.join(spent, "tier", "left")
        .withColumn("spent_usd", F.coalesce("s", F.lit(0.0)))
        .select(
            "tier",
            "budget_usd",
            "spent_usd",
            (F.col("budget_usd") - F.col("spent_usd")).alias("remaining_usd"),
            (F.col("spent_usd") / F.nullif("budget_usd", F.lit(0.0)) >= threshold).alias("exhausted"),
        )
    )


def with_estimated_cost(responses: DataFrame, models: DataFrame) -> DataFrame:
    """Token cost of each reply at its model's rate."""
    rates = models.select(
        F.col("id").alias("model"),
        F.col("cost_per_1k_tokens").alias("__rate"),
        F.lit(True).alias("__known"),
    )
    return (
        responses.join(rates, "model", "left")
        .withColumn(
            "cost_usd",
            estimated_cost(
                F.col("tokens_input"),
                F.col("tokens_output"),
                F.col("__rate"),
                F.coalesce("__known", F.lit(False)),
            ),
        )
        .drop("__rate", "__known")
    )


def usage_report(responses: DataFrame) -> DataFrame:
    """Requests, spend and tokens of all replies."""
    return responses.agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost_usd"),
        F.coalesce(F.sum("tokens_input"), F.lit(0)).alias("total_tokens_input"),
        F.coalesce(F.sum("tokens_output"), F.lit(0)).alias("total_tokens_output"),
        (
            F.coalesce(F.sum("tokens_input"), F.lit(0)) + F.coalesce(F.sum("tokens_output"), F.lit(0))
        ).alias("total_tokens"),
        (
            F.coalesce(F.sum("cost_usd"), F.lit(0.0)) / F.greatest(F.lit(1), F.count(F.lit(1)))
        ).alias("avg_cost_per_request"),
    )


def generation_report(generated: DataFrame) -> DataFrame:
    """Generated and failed test suites, spend, and spend per generated suite.

    Only the replies that yielded a suite count as spend.
    """
    ok = F.col("test_code").isNotNull()
    spend = F.coalesce(F.sum(F.when(ok, F.col("cost_usd"))), F.lit(0.0))
    return generated.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("generated"),
        F.count_if(~ok).alias("failed"),
        spend.alias("total_cost_usd"),
        (spend / F.greatest(F.lit(1), F.count_if(ok))).alias("avg_cost_usd"),
    )
