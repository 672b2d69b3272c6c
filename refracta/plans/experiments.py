"""Sampling, the grid, resuming, budgets and idempotent appends."""

from pyspark.sql import functions as F

from refracta.constants import NATURAL_KEY, TASKS
from refracta.operators import cost as Q
from refracta.operators import grid as G
from refracta.operators import sampling as M
from refracta.plans import fixtures as X
from refracta.plans.fixtures import ARRIVAL, ARRIVAL_SQL, CORPUS, MODELS_SQL, RUN_LOG
from refracta.plans.registry import query
from refracta.session import scratch_path, spread
from refracta.sources import catalogue as K
from refracta.sources import writers as W

CC = X.sql_cc("code")
_KEY = ", ".join(NATURAL_KEY)
_QUOTA = (
    "CASE WHEN language IN ('python', 'java') THEN CASE tier WHEN 'complex' THEN {0} ELSE {1} END "
    "ELSE CASE tier WHEN 'complex' THEN {2} ELSE {3} END END"
)


def _sample_sql(seed: str, quota: str) -> str:
    return (
        f"(SELECT id, language, tier FROM (SELECT id, language, {X.sql_tier(CC)} AS tier FROM {CORPUS}) "
        f"QUALIFY row_number() OVER (PARTITION BY language, tier ORDER BY md5(id || '{seed}'), id) <= {quota})"
    )


@query("w1_stratified_sample", _sample_sql("42", _QUOTA.format(6, 12, 4, 8))[1:-1])
def _(spark, sf):
    return M.stratified_sample(X.functions(spark, sf), "42").select("id", "language", "tier")


# Quotas past the group limit: the same sample through range ranking.
@query("w1_large_quota_sample", _sample_sql("42", "1500 * 1")[1:-1])
def _(spark, sf):
    quotas = {(lang, tier): 1500 for lang in X.LANGS for tier in ("simple", "medium", "complex")}
    return M.stratified_sample(X.functions(spark, sf), "42", quotas).select("id", "language", "tier")


@query(
    "a28_sample_report",
    f"""WITH q AS (SELECT l AS language, t AS tier FROM (SELECT unnest(['python', 'java', 'javascript', 'cpp']) AS l),
    (SELECT unnest(['simple', 'medium', 'complex']) AS t)), qq AS (SELECT *, {_QUOTA.format(6, 12, 4, 8)} AS quota FROM q),
    s AS (SELECT language, tier, count(*) AS n FROM {_sample_sql("42", _QUOTA.format(6, 12, 4, 8))} GROUP BY 1, 2)
    SELECT language, tier, CAST(quota AS BIGINT) AS quota, CAST(coalesce(n, 0) AS BIGINT) AS sampled,
    CAST(quota - coalesce(n, 0) AS BIGINT) AS shortfall FROM qq LEFT JOIN s USING (language, tier)""",
)
def _(spark, sf):
    return M.sample_report(M.stratified_sample(X.functions(spark, sf), "42"))


# --- the grid ---------------------------------------------------------------------------------

_MODELS = ("m0", "m3", "m6")
_STRATEGIES = ("zero_shot_light", "zero_shot_medium", "zero_shot_heavy")


def _values(column: str, values) -> str:
    return f"(SELECT unnest([{', '.join(repr(v) for v in values)}]) AS {column})"


_GRID_SQL = (
    f"(SELECT id AS function_id, model, task, strategy FROM (SELECT id FROM {CORPUS}), {_values('model', _MODELS)}, "
    f"{_values('task', TASKS)}, {_values('strategy', _STRATEGIES)})"
)
_QUEUE_SQL = f"(SELECT * FROM {_GRID_SQL} g ANTI JOIN {RUN_LOG} r USING ({_KEY}))"


@query(
    "j3_experiment_grid",
    f"SELECT model, task, strategy, CAST(count(DISTINCT function_id) AS BIGINT) AS functions FROM {_GRID_SQL} GROUP BY 1, 2, 3",
)
def _(spark, sf):
    # Ids are made distinct before they are expanded: the cells are then only counted.
    ids = spread(X.corpus(spark, sf).select("id").distinct())
    cells = G.grid(ids, _MODELS, TASKS, _STRATEGIES)
    return cells.groupBy("model", "task", "strategy").agg(F.count("function_id").alias("functions"))


@query("j4_pending_grid", f"SELECT {_KEY} FROM {_QUEUE_SQL}")
def _(spark, sf):
    return G.pending_grid(X.corpus(spark, sf), X.run_log(spark, sf), _MODELS, TASKS, _STRATEGIES)


@query(
    "j4_resume_report",
    f"SELECT (SELECT count(*) FROM {_GRID_SQL}) AS total, count(*) AS queued, (SELECT count(*) FROM {_GRID_SQL}) - count(*) AS skipped FROM {_QUEUE_SQL}",
)
def _(spark, sf):
    return G.resume_report(X.corpus(spark, sf), X.run_log(spark, sf), _MODELS, TASKS, _STRATEGIES)


@query("f6_existing_keys", f"SELECT g.* FROM {_GRID_SQL} g SEMI JOIN {RUN_LOG} r USING ({_KEY})")
def _(spark, sf):
    keys = G.grid(X.corpus(spark, sf), _MODELS, TASKS, _STRATEGIES)
    return G.exists_in(keys, X.run_log(spark, sf))


@query(
    "f7_cached_results",
    f"SELECT {_KEY}, l_orderkey, l_linenumber, se_score FROM {RUN_LOG} SEMI JOIN {_GRID_SQL} g USING ({_KEY})",
)
def _(spark, sf):
    keys = G.grid(spread(X.corpus(spark, sf)), _MODELS, TASKS, _STRATEGIES)
    return G.cached_results(keys, X.run_log(spark, sf)).select(
        *NATURAL_KEY, "l_orderkey", "l_linenumber", "se_score"
    )


@query(
    "j5_model_attributes",
    f"SELECT r.l_orderkey, r.l_linenumber, r.l_partkey, r.model, m.tier, m.cost_per_1k_tokens FROM {RUN_LOG} r LEFT JOIN {MODELS_SQL} m ON m.id = r.model",
)
def _(spark, sf):
    rows = X.run_log(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "model")
    return K.with_model_attributes(rows, X.catalogue(spark))


@query(
    "j6_tier_members",
    f"SELECT model, CAST(count(*) AS BIGINT) AS n FROM {RUN_LOG} WHERE model IN (SELECT id FROM {MODELS_SQL} WHERE tier = 'tier2') GROUP BY model",
)
def _(spark, sf):
    members = K.models_of_tier(X.catalogue(spark), "tier2").select(F.col("id").alias("model"))
    per_model = X.run_log(spark, sf).groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    return per_model.join(members, "model", "left_semi")


@query(
    "u2_all_models",
    f"SELECT m.tier, m.id, CAST(count(r.model) AS BIGINT) AS runs FROM {MODELS_SQL} m LEFT JOIN {RUN_LOG} r ON r.model = m.id GROUP BY 1, 2",
)
def _(spark, sf):
    models = X.catalogue(spark)
    parts = [K.models_of_tier(models, t) for t in ("tier1", "tier2", "tier3")]
    runs = X.run_log(spark, sf).groupBy(F.col("model").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return K.combine_tiers(parts).join(runs, "id", "left").select(
        "tier", "id", F.coalesce("n", F.lit(0)).alias("runs")
    )


# --- budget and append ---------------------------------------------------------------------------


@query(
    "w5_within_budget",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(spent, 0), 6)::DOUBLE AS spent_before FROM (SELECT *,
    sum(CAST(cost_usd AS DECIMAL(38,12))) OVER (ORDER BY {ARRIVAL_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spent
    FROM {RUN_LOG}) WHERE coalesce(spent, 0) < 5""",
)
def _(spark, sf):
    # Only what is needed: the rows are range-partitioned and written once.
    log = X.run_log(spark, sf).select(*ARRIVAL, "cost_usd")
    admitted = G.within_budget(log, ARRIVAL, 5.0)
    return admitted.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round("spent_before", 6).alias("spent_before")
    )


@query(
    "w5_within_budget_per_model",
    f"""SELECT model, CAST(count(*) AS BIGINT) AS admitted, round(max(coalesce(spent, 0)), 6)::DOUBLE AS spent_before_last FROM (SELECT *,
    sum(CAST(cost_usd AS DECIMAL(38,12))) OVER (PARTITION BY model ORDER BY {ARRIVAL_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spent
    FROM {RUN_LOG}) WHERE coalesce(spent, 0) < 1 GROUP BY model""",
)
def _(spark, sf):
    log = X.run_log(spark, sf).select("model", *ARRIVAL, "cost_usd")
    admitted = G.within_budget(log, ARRIVAL, 1.0, group=["model"])
    return admitted.groupBy("model").agg(
        F.count(F.lit(1)).alias("admitted"),
        F.round(F.max("spent_before"), 6).alias("spent_before_last"),
    )


# Calls that last minutes instead of milliseconds, so that several run at a time.
_CALLS = f"(SELECT *, timestamp AS s, timestamp + to_minutes(CAST(latency_ms AS BIGINT)) AS f FROM {RUN_LOG})"


def _in_flight_sql(group: str, limit: int) -> str:
    """Spend and number of finished calls by an ASOF join; starts before by their row number."""
    per = f"PARTITION BY {group} " if group else ""
    key = f"{group}, " if group else ""
    same = f"c.{group} = d.{group} AND " if group else ""
    return f"""(WITH c AS {_CALLS}, d AS (SELECT {key}f, sum(sum(CAST(cost_usd AS DECIMAL(38,12)))) OVER ({per}ORDER BY f) AS spent,
    sum(count(*)) OVER ({per}ORDER BY f) AS done FROM c WHERE f IS NOT NULL GROUP BY {key}f)
    SELECT c.*, coalesce(spent, 0) AS spent, n - 1 - coalesce(done, 0) AS running
    FROM (SELECT *, row_number() OVER ({per}ORDER BY s, {ARRIVAL_SQL}) AS n FROM c) c ASOF LEFT JOIN d ON {same}c.s >= d.f
    WHERE coalesce(spent, 0) < {limit})"""


def _calls(spark, sf):
    log = X.run_log(spark, sf).select("model", *ARRIVAL, "cost_usd", "latency_ms")
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), F.col("latency_ms"))
    return log.withColumn("finished", F.col("timestamp") + minutes).withColumn("started", F.col("timestamp"))


@query(
    "w5_budget_in_flight",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, round(spent, 6)::DOUBLE AS spent_before, CAST(running AS BIGINT) AS in_flight
    FROM {_in_flight_sql("", 5)}""",
)
def _(spark, sf):
    admitted = G.admitted_in_flight(_calls(spark, sf), ARRIVAL, 5.0)
    return admitted.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round("spent_before", 6).alias("spent_before"), "in_flight"
    )


@query(
    "w5_overshoot_per_model",
    f"""SELECT model, CAST(count(*) AS BIGINT) AS admitted, CAST(max(running) AS BIGINT) AS most_in_flight,
    round(sum(CAST(cost_usd AS DECIMAL(38,12))) - 1, 6)::DOUBLE AS over_budget FROM {_in_flight_sql("model", 1)} GROUP BY model""",
)
def _(spark, sf):
    admitted = G.admitted_in_flight(_calls(spark, sf), ARRIVAL, 1.0, group=["model"])
    return admitted.groupBy("model").agg(
        F.count(F.lit(1)).alias("admitted"),
        F.max("in_flight").alias("most_in_flight"),
        F.round((F.sum(F.col("cost_usd").cast("decimal(38,12)")) - 1).cast("double"), 6).alias("over_budget"),
    )


@query(
    "w7_running_mean",
    f"SELECT CAST(timestamp AS DATE) AS date, model, round(avg(coalesce(latency_ms, 0)), 6) AS avg_latency_ms FROM {RUN_LOG} GROUP BY 1, 2",
)
def _(spark, sf):
    # The row-by-row mean update is the mean: kept as (sum, count), merged over two halves.
    by = ["date", "model"]
    log = X.run_log(spark, sf).withColumn("date", F.to_date("timestamp"))
    latency = F.coalesce("latency_ms", F.lit(0))
    halves = [Q.mean_parts(log.filter(F.col("l_orderkey") % 2 == k), by, latency) for k in (0, 1)]
    means = Q.merged_means(halves[0].unionByName(halves[1]), by, "avg_latency_ms")
    return means.withColumn("avg_latency_ms", F.round("avg_latency_ms", 6))


_NEW = f"(SELECT * FROM {RUN_LOG} WHERE l_suppkey % 2 = 1)"
_OLD = f"(SELECT * FROM {RUN_LOG} WHERE l_suppkey % 2 = 0)"
_ONCE = f"QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY {ARRIVAL_SQL}) = 1"


@query(
    "s10_new_results",
    f"SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT * FROM {_NEW} {_ONCE}) n ANTI JOIN {_OLD} o USING ({_KEY})",
)
def _(spark, sf):
    log = X.run_log(spark, sf)
    new, old = log.filter(F.col("l_suppkey") % 2 == 1), log.filter(F.col("l_suppkey") % 2 == 0)
    return W.new_results(new, old, ARRIVAL).select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "s10_append_results",
    f"SELECT {_KEY}, l_orderkey, l_linenumber, l_partkey FROM (SELECT * FROM {_OLD} {_ONCE}) UNION ALL "
    f"SELECT {_KEY}, l_orderkey, l_linenumber, l_partkey FROM (SELECT * FROM {_NEW} {_ONCE}) n ANTI JOIN {_OLD} o USING ({_KEY})",
)
def _(spark, sf):
    path = scratch_path(spark, "facts")
    log = X.run_log(spark, sf).select(*NATURAL_KEY, "timestamp", *ARRIVAL[1:])
    W.append_results(log.filter(F.col("l_suppkey") % 2 == 0), path, ARRIVAL)
    for _attempt in range(2):  # the second append finds nothing new
        W.append_results(log.filter(F.col("l_suppkey") % 2 == 1), path, ARRIVAL)
    return spark.read.parquet(path).select(*NATURAL_KEY, "l_orderkey", "l_linenumber", "l_partkey")
