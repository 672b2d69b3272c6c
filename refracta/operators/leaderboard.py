"""The leaderboard and its relatives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refracta.functions.attributes import numeric_round
from refracta.operators.ordered import running_max, value_summary
from refracta.operators.stats import beside

GROUP = ("model", "task", "strategy")


def leaderboard(facts: DataFrame) -> DataFrame:
    """Scored rows aggregated per (model, task, strategy); a NULL is a group like any other.

    A missing preservation counts as a failure. The median is exact, found by range; the
    facts are read once.
    """
    scored = facts.filter(F.col("se_score").isNotNull())
    found = value_summary(
        scored, GROUP, "se_score", {"median": 0.5},
        {
            "successful": F.sum(F.when(F.col("preservation") == 1, 1).otherwise(0)),
            "total_cost_usd": F.sum("cost_usd"),
            "latency": F.sum("latency_ms"),
            "latencies": F.count("latency_ms"),
        },
    )
    return found.select(
        *GROUP,
        F.col("n").alias("total_transformations"),
        "successful",
        numeric_round(F.col("successful") / F.col("n") * 100, 2).alias("success_rate_pct"),
        numeric_round(F.col("mean"), 3).alias("mean_se"),
        numeric_round(F.col("median"), 3).alias("median_se"),
        numeric_round(F.col("std"), 3).alias("std_se"),
        "total_cost_usd",
        numeric_round(F.try_divide(F.col("latency"), F.col("latencies")), 0).alias("avg_latency_ms"),
    )


def top_leaderboard(
    facts: DataFrame,
    task: str | None = None,
    strategy: str | None = None,
    limit: int = 100,
) -> DataFrame:
    """Leaderboard rows by mean score, best first; the filters act before aggregation."""
    if task:
        facts = facts.filter(F.col("task") == task)
    if strategy:
        facts = facts.filter(F.col("strategy") == strategy)
    return (
        leaderboard(facts)
        .orderBy(F.desc_nulls_first("mean_se"), *GROUP)
        .limit(limit)
    )


def by_language(facts: DataFrame, functions: DataFrame) -> DataFrame:
    """Cells model x task x language: rows, success rate and mean score.

    Scores are totalled per function before the join, so a function with very many
    results is a few rows by the time it meets its language.
    """
    scored = facts.filter(F.col("se_score").isNotNull())
    partial = scored.groupBy("function_id", "model", "task").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("preservation") == 1).alias("ok"),
        F.sum("se_score").alias("se"),
    )
    return (
        partial.join(functions.select(F.col("id").alias("function_id"), "language"), "function_id")
        .groupBy("model", "task", "language")
        .agg(
            F.sum("n").alias("transformations"),
            (F.sum("ok") / F.sum("n") * 100).alias("success_rate_pct"),
            (F.sum("se") / F.sum("n")).alias("mean_se"),
        )
    )


def language_pivot(cells: DataFrame, languages) -> DataFrame:
    """One row per (model, task), one mean-score column per language."""
    return cells.groupBy("model", "task").agg(
        *[F.max(F.when(F.col("language") == x, F.col("mean_se"))).alias(x) for x in languages]
    )


def efficiency(facts: DataFrame, baseline: str) -> DataFrame:
    """Score per 1000 USD and return on investment against a baseline model."""
    per_model = (
        facts.filter(F.col("se_score").isNotNull())
        .groupBy("model")
        .agg(F.avg("se_score").alias("mean_se"), F.avg("cost_usd").alias("mean_cost"))
    )
    # one row per model from here on; the baseline's two numbers ride along
    base = F.col("model") == baseline
    numbers = {"base_se": F.max(F.when(base, F.col("mean_se"))), "base_cost": F.max(F.when(base, F.col("mean_cost")))}
    return beside(per_model, **numbers).select(
        "model",
        "mean_se",
        "mean_cost",
        (F.col("mean_se") / F.nullif("mean_cost", F.lit(0.0)) * 1000).alias("se_per_1000usd"),
        F.try_divide(F.col("mean_se") - F.col("base_se"), F.col("mean_cost") - F.col("base_cost")).alias("roi"),
    )


def pareto_front(per_model: DataFrame, score: str = "mean_se", cost: str = "mean_cost") -> DataFrame:
    """Models for which no other one has score >= and cost <= at once.

    Input is one row per model. Of rows with equal cost only a single best one can
    stay, and it must beat everything cheaper: a maximum per cost and a running maximum
    over the costs, no pairs.
    """
    steps = per_model.groupBy(cost).agg(F.max(score).alias("__best"))
    below = running_max(steps, "__best", cost, "__below")
    best = per_model.join(below, cost).filter(F.col(score) == F.col("__best"))
    single = best.groupBy(cost).agg(F.count(F.lit(1)).alias("__ties")).filter("__ties = 1")
    return (
        best.filter(F.col("__below").isNull() | (F.col(score) > F.col("__below")))
        .join(single, cost, "left_semi")
        .drop("__best", "__below")
    )
