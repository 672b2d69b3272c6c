"""The experiment grid, what of it is done already, and where the budget ends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refracta.constants import NATURAL_KEY
from refracta.operators.corpus import keep_first
from refracta.operators.ordered import running_total, running_totals


def _cells(models: Sequence[str], tasks: Sequence[str], strategies: Sequence[str]) -> Column:
    """All (model, task, strategy) as one literal array; its size is set by the caller's lists."""
    return F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.lit(t).alias("task"), F.lit(s).alias("strategy"))
            for m in models
            for t in tasks
            for s in strategies
        ]
    )


def grid(
    functions: DataFrame, models: Sequence[str], tasks: Sequence[str], strategies: Sequence[str]
) -> DataFrame:
    """One row per function and cell. Ids only: code is joined back by what needs it."""
    return functions.select(
        F.col("id").alias("function_id"), F.explode(_cells(models, tasks, strategies)).alias("c")
    ).select("function_id", "c.model", "c.task", "c.strategy")


def pending_grid(
    functions: DataFrame,
    done: DataFrame,
    models: Sequence[str],
    tasks: Sequence[str],
    strategies: Sequence[str],
    resume: bool = True,
) -> DataFrame:
    """Grid cells without a result yet.

    The finished cells are gathered per function first (never more than the grid has
    cells) and subtracted before the grid is expanded, so ids are shuffled once and the
    expanded grid not at all.
    """
    if not resume:
        return grid(functions, models, tasks, strategies)
    cells = _cells(models, tasks, strategies)
    finished = (
        done.filter(
            F.col("model").isin(*models)
            & F.col("task").isin(*tasks)
            & F.col("strategy").isin(*strategies)
        )
        .groupBy("function_id")
        .agg(F.collect_set(F.struct("model", "task", "strategy")).alias("done"))
    )
    left = functions.select(F.col("id").alias("function_id")).join(finished, "function_id", "left")
    todo = F.when(F.col("done").isNull(), cells).otherwise(F.array_except(cells, F.col("done")))
    return left.select("function_id", F.explode(todo).alias("c")).select(
        "function_id", "c.model", "c.task", "c.strategy"
    )


def resume_report(
    functions: DataFrame,
    done: DataFrame,
    models: Sequence[str],
    tasks: Sequence[str],
    strategies: Sequence[str],
) -> DataFrame:
    """total / queued / skipped cells of a resumed run."""
    size = len(models) * len(tasks) * len(strategies)
    queued = pending_grid(functions, done, models, tasks, strategies)
    counts = queued.agg(F.count(F.lit(1)).alias("queued"), F.lit(0).cast("bigint").alias("total")).unionByName(
        functions.agg(
            F.lit(0).cast("bigint").alias("queued"), (F.count(F.lit(1)) * size).alias("total")
        )
    )
    return counts.agg(F.sum("total").alias("total"), F.sum("queued").alias("queued")).withColumn(
        "skipped", F.col("total") - F.col("queued")
    )


def exists_in(keys: DataFrame, facts: DataFrame, key: Sequence[str] = NATURAL_KEY) -> DataFrame:
    """The keys that have a result."""
    return keys.join(facts.select(*key).distinct(), list(key), "left_semi")


def cached_results(keys: DataFrame, facts: DataFrame, key: Sequence[str] = NATURAL_KEY) -> DataFrame:
    """Stored results of the requested keys, however often a key is requested.

    A grid counts as small as the ids it is expanded from, so its size is no ground for a
    broadcast: both sides are sorted on the key.
    """
    found = facts.join(keys.select(*key).hint("merge"), list(key), "left_semi")
    return found.select(*key, *[c for c in facts.columns if c not in key])


def attach_templates(cells: DataFrame, templates: DataFrame) -> DataFrame:
    """Prompt template per (task, strategy).

    Templates are a handful of files; Spark broadcasts them when their size says so.
    """
    return cells.join(templates, ["task", "strategy"], "inner")


def missing_templates(cells: DataFrame, templates: DataFrame) -> DataFrame:
    """(task, strategy) pairs of the grid without a template."""
    return cells.select("task", "strategy").distinct().join(templates, ["task", "strategy"], "left_anti")


def within_budget(
    df: DataFrame, order: Sequence[str], limit: float, cost: str = "cost_usd", group: Sequence[str] = ()
) -> DataFrame:
    """Rows admitted while the spend before them is below ``limit``, with ``spent_before``.

    The row that crosses the limit is still admitted. ``order`` must be total. Money is
    summed as a decimal, so the cut does not move with the order of partial sums.
    """
    exact = df.withColumn("__cost", F.coalesce(F.col(cost), F.lit(0.0)).cast("decimal(38,12)"))
    spent = running_total(exact, "__cost", order, "__spent", group)
    return (
        spent.filter(F.col("__spent") < F.lit(limit))
        .withColumn("spent_before", F.col("__spent").cast("double"))
        .drop("__cost", "__spent")
    )


def admitted_in_flight(
    calls: DataFrame,
    order: Sequence[str],
    limit: float,
    started: str = "started",
    finished: str = "finished",
    cost: str = "cost_usd",
    group: Sequence[str] = (),
) -> DataFrame:
    """Calls admitted when several run at a time: what runs has not been paid for yet.

    A call is admitted when the calls that finished by its start cost less than ``limit``, so
    the spend may end above it by the calls in flight. Columns added: ``spent_before`` and
    ``in_flight``, the calls begun before this one and not finished by then. Calls that start
    together follow ``order``, which must tell all calls apart; one that also finishes at that
    time is paid for after them. Costs are not negative; NULL is 0. A call without a start is
    not admitted; one without a finish stays in flight and is never paid for. A finish before
    the start counts as one at the start.

    Spend only grows, so calls that are turned away all start later than the admitted ones and
    change nothing for them: one pass over starts and finishes in their order decides.
    """
    known = calls.filter(F.col(started).isNotNull())
    end = F.when(F.col(finished).isNotNull(), F.greatest(finished, started))
    price = F.coalesce(F.col(cost), F.lit(0.0)).cast("decimal(38,12)")
    free, begun = F.lit(0).cast("decimal(38,12)"), F.col(started)
    start_of = F.struct(begun.alias("__at"), F.lit(1).alias("__kind"), free.alias("__cost"), F.lit(1).alias("__runs"))
    end_of = F.struct(
        end.alias("__at"), F.when(end > begun, 0).otherwise(2).alias("__kind"), price.alias("__cost"), F.lit(-1).alias("__runs")
    )
    # One read: each call gives both events, and its columns travel with the start alone.
    keys = list(dict.fromkeys([*group, *order]))
    both = F.filter(F.array(start_of, end_of), lambda e: e["__at"].isNotNull())
    events = known.select(*keys, F.struct(*calls.columns).alias("__call"), F.inline(both)).withColumn(
        "__call", F.when(F.col("__kind") == 1, F.col("__call"))
    )
    placed = running_totals(
        events, {"__cost": "__spent", "__runs": "__running"}, ["__at", "__kind", *order], group
    )
    return placed.filter((F.col("__kind") == 1) & (F.col("__spent") < F.lit(limit))).select(
        "__call.*", F.col("__spent").cast("double").alias("spent_before"), F.col("__running").cast("bigint").alias("in_flight")
    )


def first_usable_attempt(
    attempts: DataFrame, key: Sequence[str], usable: Column, max_attempts: int = 3
) -> DataFrame:
    """First usable attempt per key among the first ``max_attempts``."""
    return keep_first(
        attempts.filter((F.col("attempt") <= max_attempts) & usable), key, ["attempt"]
    )


def outcome_report(outcomes: DataFrame) -> DataFrame:
    """Completed, failed and skipped cells and the cost of a run."""
    return outcomes.agg(
        *[
            F.count_if(F.col("outcome") == name).alias(name)
            for name in ("completed", "failed", "skipped")
        ],
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost_usd"),
    )
