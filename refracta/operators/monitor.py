"""Progress monitors over the fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refracta.constants import BUDGET_TOTAL_USD
from refracta.functions.attributes import numeric_round


def dataset_stats(
    functions: DataFrame, facts: DataFrame, rollup: DataFrame, budget: float = BUDGET_TOTAL_USD
) -> DataFrame:
    """Counts, success rate and budget as one row, one aggregation per table."""
    zero = F.lit(0).cast("bigint")

    def one_row(df: DataFrame, **columns) -> DataFrame:
        names = ("f", "v", "t", "s", "c")
        default = {"c": F.lit(0.0)}
        return df.agg(*[columns.get(n, default.get(n, zero)).alias(n) for n in names])

    rows = (
        one_row(functions, f=F.count(F.lit(1)), v=F.count_if("validated"))
        .union(one_row(facts, t=F.count(F.lit(1)), s=F.count_if(F.col("preservation") == 1)))
        .union(one_row(rollup, c=F.coalesce(F.sum("total_cost_usd"), F.lit(0.0))))
    )
    totals = rows.agg(*[F.sum(c).alias(c) for c in rows.columns])
    return totals.select(
        F.col("f").alias("total_functions"),
        F.col("v").alias("validated_functions"),
        F.col("t").alias("total_transformations"),
        F.col("s").alias("successful_transformations"),
        F.when(F.col("t") > 0, F.col("s") / F.nullif("t", F.lit(0)) * 100)
        .otherwise(0.0)
        .alias("success_rate"),
        F.col("c").alias("total_cost_usd"),
        (F.lit(float(budget)) - F.col("c")).alias("remaining_budget_usd"),
    )


def count_by_language(functions: DataFrame) -> DataFrame:
    return functions.groupBy("language").agg(F.count(F.lit(1)).alias("functions"))


def run_totals(facts: DataFrame, cost_places: int = 2) -> DataFrame:
    """Rows, rows without a score, distinct functions and models, spend, latency.

    The two distinct counts come from one pre-aggregation by (function, model), which
    avoids the row expansion of several DISTINCT aggregates over the raw table.
    """
    pairs = facts.groupBy("function_id", "model").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("se_score").isNull()).alias("pending"),
        F.sum("cost_usd").alias("cost"),
        F.sum("latency_ms").alias("lat"),
        F.count("latency_ms").alias("lat_n"),
    )
    return pairs.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_transformations"),
        F.coalesce(F.sum("pending"), F.lit(0)).alias("pending_se_calc"),
        F.count_distinct("function_id").alias("unique_functions"),
        F.count_distinct("model").alias("unique_models"),
        numeric_round(F.sum("cost"), cost_places).alias("total_cost_usd"),
        numeric_round(F.try_divide(F.sum("lat"), F.sum("lat_n")), 0).alias("avg_latency_ms"),
    )


def _sums() -> dict[str, Column]:
    """What every block of a report is made from; sums of parts add up."""
    return {
        "count": F.count(F.lit(1)),
        "pending": F.count_if(F.col("se_score").isNull()),
        "cost_usd": F.sum(F.col("cost_usd").cast("double")),
        "latency_ms": F.sum(F.col("latency_ms").cast("bigint")),
        "latencies": F.count("latency_ms"),
        "delta_cc": F.sum(F.col("delta_cc").cast("double")),
        "deltas": F.count("delta_cc"),
    }


def monitor_parts(facts: DataFrame) -> DataFrame:
    """The mergeable state behind all blocks of a monitor, from one read of ``facts``.

    Rows of two kinds: sums per (model, task, strategy), and one row per function, which
    keeps distinct functions exact across parts. NULL keys are keys.
    """
    keys = ("model", "task", "strategy", "function_id")
    parts = facts.groupingSets([keys[:3], keys[3:]], *keys).agg(
        F.grouping("function_id").alias("__cell"), *[v.alias(k) for k, v in _sums().items()]
    )
    is_cell = F.col("__cell") == 1
    return parts.select(
        is_cell.alias("is_cell"), *keys, *[F.when(is_cell, F.col(k)).alias(k) for k in _sums()]
    )


def merged_parts(parts: DataFrame) -> DataFrame:
    """The state of all rows from the states of disjoint sets of rows."""
    return parts.groupBy("is_cell", "model", "task", "strategy", "function_id").agg(
        *[F.sum(k).alias(k) for k in _sums()]
    )


def monitor_report(parts: DataFrame) -> DataFrame:
    """All blocks of the monitors from merged parts: ``totals``, ``model``, ``task_strategy``.

    Cells give the models and the task x strategy cells; the totals then add up the few
    models and the number of functions. Each measure is there in every block; the distinct
    counts are those of the totals.
    """
    names = ("block", "model", "task", "strategy")
    measures = [*_sums(), "functions", "models"]

    def entry(block: str, *keys: str) -> Column:
        return F.struct(
            F.lit(block).alias("block"),
            *[(F.col(k) if k in keys else F.lit(None).cast("string")).alias(k) for k in names[1:]],
        )

    def blocks(rows: DataFrame, targets: Column) -> DataFrame:
        spread = rows.select(F.explode(targets).alias("__to"), *measures)
        return spread.groupBy(*[F.col(f"__to.{n}").alias(n) for n in names]).agg(
            *[F.sum(k).alias(k) for k in measures]
        )

    zero = F.lit(0).cast("bigint")
    counted = parts.withColumns(
        {"functions": F.when(F.col("function_id").isNotNull(), F.lit(1).cast("bigint")), "models": zero}
    )
    of_cells = F.array(entry("model", "model"), entry("task_strategy", "task", "strategy"))
    first = blocks(counted, F.when(F.col("is_cell"), of_cells).otherwise(F.array(entry("functions"))))
    totals = F.array(entry("totals"))
    second = blocks(
        first.withColumn("models", F.when(F.col("model").isNotNull(), F.lit(1).cast("bigint"))),
        F.when(F.col("block") == "model", F.concat(F.array(entry("model", "model")), totals))
        .when(F.col("block") == "functions", totals)
        .otherwise(F.array(entry("task_strategy", "task", "strategy"))),
    )
    only_totals = F.col("block") == "totals"
    return second.select(
        *names,
        F.coalesce("count", zero).alias("count"),
        F.coalesce("pending", zero).alias("pending"),
        "cost_usd",
        F.try_divide("latency_ms", "latencies").alias("avg_latency_ms"),
        F.try_divide("delta_cc", "deltas").alias("avg_delta_cc"),
        F.when(only_totals, F.coalesce("functions", zero)).alias("functions"),
        F.when(only_totals, F.coalesce("models", zero)).alias("models"),
    )


def report_totals(report: DataFrame, cost_places: int = 2) -> DataFrame:
    """The totals block as :func:`run_totals` gives it; one row for an empty log too."""

    def one(column: str) -> Column:
        return F.max(column)

    zero = F.lit(0).cast("bigint")
    return report.filter(F.col("block") == "totals").agg(
        F.coalesce(one("count"), zero).alias("total_transformations"),
        F.coalesce(one("pending"), zero).alias("pending_se_calc"),
        F.coalesce(one("functions"), zero).alias("unique_functions"),
        F.coalesce(one("models"), zero).alias("unique_models"),
        numeric_round(one("cost_usd"), cost_places).alias("total_cost_usd"),
        numeric_round(one("avg_latency_ms"), 0).alias("avg_latency_ms"),
    )


def report_by_model(report: DataFrame) -> DataFrame:
    """The model block as :func:`by_model` gives it."""
    cost = numeric_round(F.col("cost_usd"), 2).alias("cost_usd")
    latency = numeric_round(F.col("avg_latency_ms"), 0).alias("avg_latency_ms")
    rows = report.filter(F.col("block") == "model").select("model", "count", cost, latency)
    return rows.orderBy(F.desc_nulls_first("cost_usd"), "model")


def report_by_task_strategy(report: DataFrame) -> DataFrame:
    """The task x strategy block as :func:`by_task_strategy` gives it, with the mean change."""
    delta = numeric_round(F.col("avg_delta_cc"), 2).alias("avg_delta_cc")
    rows = report.filter(F.col("block") == "task_strategy").select("task", "strategy", "count", delta)
    return rows.orderBy("task", "strategy")


def by_model(facts: DataFrame) -> DataFrame:
    """Most expensive models first."""
    return (
        facts.groupBy("model")
        .agg(
            F.count(F.lit(1)).alias("count"),
            numeric_round(F.sum("cost_usd"), 2).alias("cost_usd"),
            numeric_round(F.avg("latency_ms"), 0).alias("avg_latency_ms"),
        )
        .orderBy(F.desc_nulls_first("cost_usd"), "model")
    )


def by_model_detail(facts: DataFrame) -> DataFrame:
    """Busiest models first."""
    return (
        facts.groupBy("model")
        .agg(
            F.count(F.lit(1)).alias("count"),
            numeric_round(F.sum("cost_usd"), 4).alias("cost"),
            numeric_round(F.avg("delta_cc"), 2).alias("avg_delta_cc"),
        )
        .orderBy(F.desc("count"), "model")
    )


def by_task_strategy(facts: DataFrame, with_delta: bool = False) -> DataFrame:
    measures = [F.count(F.lit(1)).alias("count")]
    if with_delta:
        measures.append(numeric_round(F.avg("delta_cc"), 2).alias("avg_delta_cc"))
    return facts.groupBy("task", "strategy").agg(*measures).orderBy("task", "strategy")


def latest(facts: DataFrame, n: int = 5, tie_breakers=()) -> DataFrame:
    """Newest ``n`` results."""
    return (
        facts.orderBy(F.desc("timestamp"), *tie_breakers)
        .select(
            "function_id", "model", "task", "strategy", "delta_cc",
            numeric_round(F.col("cost_usd"), 6).alias("cost"), "timestamp",
        )
        .limit(n)
    )


def experiment_progress(facts: DataFrame, planned: int, by=("model",)) -> DataFrame:
    """Progress, success, score spread (population), rate per minute and time left.

    Scores count for successful rows only.
    """
    ok = F.col("preservation") == 1
    score = F.when(ok, F.col("se_score"))
    seconds = F.unix_timestamp(F.max("timestamp").cast("timestamp")) - F.unix_timestamp(
        F.min("timestamp").cast("timestamp")
    )
    raw = facts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("completed"),
        F.count_if(ok).alias("successful"),
        F.coalesce(F.avg(score), F.lit(0.0)).alias("avg_se"),
        F.when(F.count(score) < 2, 0.0).otherwise(F.stddev_pop(score)).alias("std_se"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost_usd"),
        seconds.alias("elapsed_s"),
    )
    done = F.col("completed")
    remaining = F.lit(planned) - done
    eta = F.floor(F.col("elapsed_s") / done * remaining)
    return raw.select(
        *by,
        "completed",
        "successful",
        (done - F.col("successful")).alias("failed"),
        (done / F.lit(float(planned)) * 100 if planned else F.lit(0.0)).alias("progress_pct"),
        (F.col("successful") / done * 100).alias("success_rate"),
        "avg_se",
        "std_se",
        "total_cost_usd",
        F.when(F.col("elapsed_s") > 0, done / F.nullif("elapsed_s", F.lit(0)) * 60)
        .otherwise(0.0)
        .alias("per_minute"),
        eta.cast("bigint").alias("eta_s"),
        F.concat(
            F.floor(eta / 3600).cast("string"), F.lit("h "),
            F.floor(F.pmod(eta, F.lit(3600)) / 60).cast("string"), F.lit("m"),
        ).alias("eta"),
    )
