"""Leaderboards, monitors, progress and ordered reports."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from refracta.operators import cost as O
from refracta.operators import leaderboard as B
from refracta.operators import monitor as N
from refracta.operators.sampling import random_order
from refracta.plans import fixtures as X
from refracta.plans.fixtures import ARRIVAL, CORPUS, RUN_LOG, rounded
from refracta.plans.registry import query


def _numeric(x: str, places) -> str:
    """Rounding as a decimal, the definition of these reports."""
    return f"CAST(round(CAST({x} AS DECIMAL(38, 12)), {places}) AS DOUBLE)"


BOARD_SQL = f"""SELECT model, task, strategy, CAST(count(*) AS BIGINT) AS total_transformations,
  CAST(sum(CASE WHEN preservation = 1 THEN 1 ELSE 0 END) AS BIGINT) AS successful,
  {_numeric("avg(CASE WHEN preservation = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100", 2)} AS success_rate_pct,
  {_numeric("avg(se_score)", 3)} AS mean_se, {_numeric("quantile_cont(se_score, 0.5)", 3)} AS median_se,
  {_numeric("stddev_samp(se_score)", 3)} AS std_se, round(sum(cost_usd), 6) AS total_cost_usd,
  {_numeric("avg(latency_ms)", 0)} AS avg_latency_ms FROM {RUN_LOG} WHERE se_score IS NOT NULL GROUP BY model, task, strategy"""


def _board(df):
    return df.withColumn("total_cost_usd", F.round("total_cost_usd", 6))


@query("a1_leaderboard", BOARD_SQL)
def _(spark, sf):
    return _board(B.leaderboard(X.run_log(spark, sf)))


def _positioned(df):
    """The place of every row in the delivered order; for the few rows of a report."""
    placed = df.withColumn("__id", F.monotonically_increasing_id())
    return placed.withColumn("position", F.row_number().over(Window.orderBy("__id"))).drop("__id")


_GAPS = "CASE WHEN strategy <> 'few_shot_k3' THEN strategy END"


@query(
    "a1_leaderboard_null_groups",
    BOARD_SQL.replace(RUN_LOG, f"(SELECT * REPLACE ({_GAPS} AS strategy) FROM {RUN_LOG})"),
)
def _(spark, sf):
    return _board(B.leaderboard(X.run_log(spark, sf).withColumn("strategy", F.expr(_GAPS))))


@query("a1_leaderboard_by_range", BOARD_SQL)
def _(spark, sf):
    return _board(B.leaderboard(X.run_log(spark, sf)))


@query(
    "a2_leaderboard_query",
    f"SELECT * FROM ({BOARD_SQL}) WHERE task = 'refactor' AND strategy = 'zero_shot' "
    "ORDER BY mean_se DESC NULLS FIRST, model, task, strategy LIMIT 5",
)
def _(spark, sf):
    return _board(B.top_leaderboard(X.run_log(spark, sf), "refactor", "zero_shot", 5))


@query(
    "o1_leaderboard_order",
    f"SELECT model, task, strategy, mean_se FROM ({BOARD_SQL}) ORDER BY mean_se DESC NULLS FIRST, model, task, strategy LIMIT 20",
)
def _(spark, sf):
    return B.top_leaderboard(X.run_log(spark, sf), limit=20).select("model", "task", "strategy", "mean_se")


@query(
    "a10_dataset_stats",
    f"""SELECT f.n AS total_functions, f.v AS validated_functions, t.n AS total_transformations,
    t.s AS successful_transformations, round(t.s * 100.0::DOUBLE / t.n, 6) AS success_rate, round(t.c, 6) AS total_cost_usd,
    round(2000.0::DOUBLE - t.c, 6) AS remaining_budget_usd
    FROM (SELECT count(*) AS n, count(*) FILTER (validated) AS v FROM {CORPUS}) f,
    (SELECT count(*) AS n, count(*) FILTER (preservation = 1) AS s, sum(cost_usd) AS c FROM {RUN_LOG}) t""",
)
def _(spark, sf):
    log = X.run_log(spark, sf)
    return rounded(N.dataset_stats(X.corpus(spark, sf), log, O.daily_rollup(log)))


@query(
    "a11_count_by_language",
    f"SELECT language, CAST(count(*) AS BIGINT) AS functions FROM {CORPUS} GROUP BY language",
)
def _(spark, sf):
    return N.count_by_language(X.corpus(spark, sf))


TOTALS_SQL = (
    "SELECT CAST(count(*) AS BIGINT) AS total_transformations, CAST(count(*) FILTER (se_score IS NULL) AS BIGINT) AS pending_se_calc, "
    "CAST(count(DISTINCT function_id) AS BIGINT) AS unique_functions, CAST(count(DISTINCT model) AS BIGINT) AS unique_models, "
    "CAST(round(CAST(sum(cost_usd) AS DECIMAL(38, 12)), {0}) AS DOUBLE) AS total_cost_usd, "
    "CAST(round(CAST(avg(latency_ms) AS DECIMAL(38, 12)), 0) AS DOUBLE) AS avg_latency_ms FROM " + RUN_LOG
)


@query("a14_monitor_totals", TOTALS_SQL.format(2))
def _(spark, sf):
    return N.run_totals(X.run_log(spark, sf))


@query("a17_pipeline_totals", TOTALS_SQL.format(4))
def _(spark, sf):
    return N.run_totals(X.run_log(spark, sf), cost_places=4)


BY_MODEL_SQL = (
    f"SELECT model, CAST(count(*) AS BIGINT) AS count, {_numeric('sum(cost_usd)', 2)} AS cost_usd, "
    f"{_numeric('avg(latency_ms)', 0)} AS avg_latency_ms FROM {RUN_LOG} GROUP BY model"
)
_DETAIL_SQL = (
    f"SELECT model, CAST(count(*) AS BIGINT) AS count, {_numeric('sum(cost_usd)', 4)} AS cost, "
    f"{_numeric('avg(delta_cc)', 2)} AS avg_delta_cc FROM {RUN_LOG} GROUP BY model"
)


@query(
    "a14_a19_monitor_report",
    f"""SELECT CASE WHEN grouping(model) = 0 THEN 'model' WHEN grouping(task) = 0 THEN 'task_strategy' ELSE 'totals' END AS block,
    model, task, strategy, CAST(count(*) AS BIGINT) AS count, CAST(count(*) FILTER (se_score IS NULL) AS BIGINT) AS pending,
    round(sum(cost_usd), 6) AS cost_usd, round(avg(latency_ms), 6) AS avg_latency_ms, round(avg(delta_cc), 6) AS avg_delta_cc,
    CASE WHEN grouping(model) = 1 AND grouping(task) = 1 THEN CAST(count(DISTINCT function_id) AS BIGINT) END AS functions,
    CASE WHEN grouping(model) = 1 AND grouping(task) = 1 THEN CAST(count(DISTINCT model) AS BIGINT) END AS models
    FROM {RUN_LOG} GROUP BY GROUPING SETS ((model), (task, strategy), ())""",
)
def _(spark, sf):
    return rounded(N.monitor_report(N.monitor_parts(X.run_log(spark, sf))))


@query("a15_by_model", BY_MODEL_SQL)
def _(spark, sf):
    return N.by_model(X.run_log(spark, sf))


@query("o2_models_by_cost", f"SELECT *, row_number() OVER (ORDER BY cost_usd DESC, model) AS position FROM ({BY_MODEL_SQL})")
def _(spark, sf):
    return _positioned(N.by_model(X.run_log(spark, sf)))


@query(
    "a16_by_task_strategy",
    f"SELECT task, strategy, CAST(count(*) AS BIGINT) AS count FROM {RUN_LOG} GROUP BY task, strategy",
)
def _(spark, sf):
    return N.by_task_strategy(X.run_log(spark, sf))


@query("a18_by_model_detail", _DETAIL_SQL)
def _(spark, sf):
    return N.by_model_detail(X.run_log(spark, sf))


@query("o3_models_by_count", f"SELECT *, row_number() OVER (ORDER BY count DESC, model) AS position FROM ({_DETAIL_SQL})")
def _(spark, sf):
    return _positioned(N.by_model_detail(X.run_log(spark, sf)))


TASK_SQL = (
    f"SELECT task, strategy, CAST(count(*) AS BIGINT) AS count, {_numeric('avg(delta_cc)', 2)} AS avg_delta_cc "
    f"FROM {RUN_LOG} GROUP BY task, strategy"
)


@query("a19_by_task_strategy_delta", TASK_SQL)
def _(spark, sf):
    return N.by_task_strategy(X.run_log(spark, sf), with_delta=True)


@query("o4_task_strategy_order", f"SELECT *, row_number() OVER (ORDER BY task, strategy) AS position FROM ({TASK_SQL})")
def _(spark, sf):
    return _positioned(N.by_task_strategy(X.run_log(spark, sf), with_delta=True))


@query(
    "o5_latest_results",
    f"SELECT function_id, model, task, strategy, delta_cc, {_numeric('cost_usd', 6)} AS cost, timestamp FROM {RUN_LOG} "
    "ORDER BY timestamp DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 5",
)
def _(spark, sf):
    return N.latest(X.run_log(spark, sf), 5, ARRIVAL[1:])


@query(
    "o6_random_order",
    f"SELECT id, CAST(row_number() OVER (ORDER BY md5(id || '7'), id) AS BIGINT) AS place FROM {CORPUS}",
)
def _(spark, sf):
    from refracta.operators.ordered import row_numbers

    shuffled = X.corpus(spark, sf).select("id", random_order(F.col("id"), "7").alias("k"))
    return row_numbers(shuffled, ["k", "id"], "place").select("id", "place")


_PROGRESS_SQL = f"""WITH p AS (SELECT model, count(*) AS completed, count(*) FILTER (preservation = 1) AS successful,
    coalesce(avg(se_score) FILTER (preservation = 1), 0.0::DOUBLE) AS avg_se,
    CASE WHEN count(se_score) FILTER (preservation = 1) < 2 THEN 0.0::DOUBLE ELSE stddev_pop(se_score) FILTER (preservation = 1) END AS std_se,
    sum(cost_usd) AS cost, date_diff('second', min(timestamp), max(timestamp)) AS s FROM {RUN_LOG} GROUP BY model)"""


@query(
    "a21_experiment_progress",
    f"""{_PROGRESS_SQL} SELECT model, completed, successful, completed - successful AS failed,
    round(completed / 20000.0::DOUBLE * 100, 6) AS progress_pct, round(successful * 100.0::DOUBLE / completed, 6) AS success_rate,
    round(avg_se, 6) AS avg_se, round(std_se, 6) AS std_se, round(cost, 6) AS total_cost_usd FROM p""",
)
def _(spark, sf):
    p = N.experiment_progress(X.run_log(spark, sf), planned=20000)
    return rounded(p.drop("per_minute", "eta_s", "eta"))


@query(
    "a22_throughput_and_eta",
    f"""{_PROGRESS_SQL} SELECT model, round(completed * 60.0::DOUBLE / s, 6) AS per_minute,
    CAST(floor(s::DOUBLE / completed * (200000 - completed)) AS BIGINT) AS eta_s FROM p""",
)
def _(spark, sf):
    p = N.experiment_progress(X.run_log(spark, sf), planned=200000)
    return rounded(p.select("model", "per_minute", "eta_s"))


@query(
    "a29_leaderboard_by_language",
    f"""SELECT r.model, r.task, c.language, CAST(count(*) AS BIGINT) AS transformations,
    round(count(*) FILTER (r.preservation = 1) * 100.0::DOUBLE / count(*), 6) AS success_rate_pct, round(avg(r.se_score), 6) AS mean_se
    FROM {RUN_LOG} r JOIN {CORPUS} c ON c.id = r.function_id WHERE r.se_score IS NOT NULL GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return rounded(B.by_language(X.run_log(spark, sf), X.corpus(spark, sf)))


@query(
    "a29_language_pivot",
    f"""SELECT model, task, {", ".join(f"round(avg(se_score) FILTER (language = '{x}'), 6) AS {x}" for x in X.LANGS)}
    FROM {RUN_LOG} r JOIN {CORPUS} c ON c.id = r.function_id WHERE se_score IS NOT NULL GROUP BY 1, 2""",
)
def _(spark, sf):
    cells = B.by_language(X.run_log(spark, sf), X.corpus(spark, sf))
    return rounded(B.language_pivot(cells, X.LANGS))


@query(
    "a33_efficiency",
    f"""WITH m AS (SELECT model, avg(se_score) AS se, avg(cost_usd) AS c FROM {RUN_LOG} WHERE se_score IS NOT NULL GROUP BY model),
    b AS (SELECT se AS se0, c AS c0 FROM m WHERE model = 'm0')
    SELECT model, round(se, 6) AS mean_se, round(c, 6) AS mean_cost, round(se / c * 1000, 2) AS se_per_1000usd,
    round(CASE WHEN c - c0 <> 0 THEN (se - se0) / (c - c0) END, 1) AS roi FROM m, b""",
)
def _(spark, sf):
    e = B.efficiency(X.run_log(spark, sf), "m0")
    return e.select(
        "model", F.round("mean_se", 6).alias("mean_se"), F.round("mean_cost", 6).alias("mean_cost"),
        F.round("se_per_1000usd", 2).alias("se_per_1000usd"), F.round("roi", 1).alias("roi"),
    )


_MODEL_MEANS = (
    f"(SELECT function_id AS model, avg(se_score) AS se, avg(cost_usd) AS c FROM {RUN_LOG} "
    "WHERE se_score IS NOT NULL GROUP BY 1)"
)


@query(
    "j12_pareto_front",
    f"""WITH m AS (SELECT model, round(se, 3) AS mean_se, round(c, 5) AS mean_cost FROM {_MODEL_MEANS})
    SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.model <> m.model AND o.mean_se >= m.mean_se AND o.mean_cost <= m.mean_cost)""",
)
def _(spark, sf):
    # Functions stand in for models: there are enough of them for ties and dominance.
    per = (
        X.run_log(spark, sf)
        .filter(F.col("se_score").isNotNull())
        .groupBy(F.col("function_id").alias("model"))
        .agg(F.round(F.avg("se_score"), 3).alias("mean_se"), F.round(F.avg("cost_usd"), 5).alias("mean_cost"))
    )
    return B.pareto_front(per).select("model", "mean_se", "mean_cost")


@query(
    "o8_tier_counts_sorted",
    f"SELECT tier, CAST(count(*) AS BIGINT) AS functions FROM (SELECT {X.sql_tier(X.sql_cc('code'))} AS tier FROM {CORPUS}) GROUP BY tier ORDER BY tier",
)
def _(spark, sf):
    from refracta.operators.corpus import counts_by_language_and_tier

    both = counts_by_language_and_tier(X.functions(spark, sf))
    return both.filter("dimension = 'tier'").select(F.col("value").alias("tier"), "functions").orderBy("tier")
