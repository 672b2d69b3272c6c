"""Streaming aggregates, run to the end of the given data and read back."""

from pyspark.sql import functions as F

from refracta.operators import monitor as N
from refracta.plans import fixtures as X
from refracta.plans.costs import ROLLUP_SQL
from refracta.plans.fixtures import RUN_LOG, rounded
from refracta.plans.leaderboards import BY_MODEL_SQL, TASK_SQL, TOTALS_SQL
from refracta.plans.registry import query
from refracta.plans.statistics import near_ranks
from refracta.session import scratch_path
from refracta.streaming import rollups as S


def event_stream(spark, sf):
    """The events table as a stream of results: an ``error`` event is a failed call."""
    # As a pattern, since a stream's plain path has to be a folder.
    return _as_results(_stream(spark, sf, f"{sf}/events.parque[t]"))


def _stream(spark, sf, path, files_per_batch=1000):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _as_results(events):
    return events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("function_id"),
        F.col("event_type").alias("model"),
        F.lit("refactor").alias("task"),
        F.lit("zero_shot").alias("strategy"),
        (F.col("value") / 100).alias("cost_usd"),
        F.when(F.col("event_id") % 3 != 0, F.floor("value").cast("int")).alias("latency_ms"),
        F.when(F.col("event_type") == "error", "request_error").alias("error_type"),
        F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("se_score"),
        F.col("ts").alias("timestamp"),
        (F.col("event_id") % 11).cast("double").alias("delta_cc"),
        "event_id",
    )


EVENTS_SQL = """(SELECT 'u' || user_id AS function_id, event_type AS model, value / 100 AS cost_usd,
  CASE WHEN event_id % 3 <> 0 THEN CAST(floor(value) AS INTEGER) END AS latency_ms,
  CASE WHEN event_type = 'error' THEN 'request_error' END AS error_type,
  CASE WHEN event_id % 4 <> 0 THEN value END AS se_score, ts AS timestamp,
  CAST(event_id % 11 AS DOUBLE) AS delta_cc, 'refactor' AS task, 'zero_shot' AS strategy, event_id FROM events)"""


def _table(spark, query_, label):
    target = scratch_path(spark, label)
    S.start_table(query_, target, scratch_path(spark, f"{label}-state")).awaitTermination()
    return S.read_table(spark, target, query_.schema)


_ROLLUP_FIELDS = """date, model, total_calls, round(total_cost_usd, 6) AS total_cost_usd, round(avg_latency_ms, 6) AS avg_latency_ms,
  successful_calls, failed_calls"""
_EVENT_ROLLUP = f"SELECT {_ROLLUP_FIELDS} FROM {ROLLUP_SQL.replace(RUN_LOG, EVENTS_SQL)}"


def _deliver_thirds(spark, sf, folder, run, thirds=range(3)):
    """Write the events in three ranges of time, the newest first, and call ``run`` after each:
    later batches are late. A range is as many files as its scan has tasks."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    first, last = events.agg(*[F.coalesce(F.unix_micros(end("ts").cast("timestamp")), F.lit(0)) for end in (F.min, F.max)]).first()
    age = F.lit(last) - F.unix_micros(F.col("ts").cast("timestamp"))
    third = F.least(F.floor(age * 3 / F.lit(max(1, last - first))), F.lit(2))
    for k in thirds:
        events.filter(third == k).write.mode("append").parquet(folder)
        run()


@query("t1_daily_rollup_stream", _EVENT_ROLLUP)
def _(spark, sf):
    # Three batches; the last rows are years behind the first.
    source, target = scratch_path(spark, "events"), scratch_path(spark, "rollup")
    state = scratch_path(spark, "rollup-state")
    _deliver_thirds(
        spark, sf, source, lambda: S.start_rollup(_as_results(_stream(spark, sf, source)), target, state).awaitTermination()
    )
    return rounded(S.read_rollup(spark, target))


@query("t2_upsert_rollup", _EVENT_ROLLUP)
def _(spark, sf):
    # A run, a compaction, a resumed run with late rows, and a batch that is replayed.
    source, target, state = (scratch_path(spark, n) for n in ("events", "upsert", "upsert-state"))

    def run():
        S.start_rollup(_as_results(_stream(spark, sf, source)), target, state).awaitTermination()

    _deliver_thirds(spark, sf, source, run, (0, 1))
    S.compact_rollup(spark, target)
    _deliver_thirds(spark, sf, source, run, (2,))
    once_more = _as_results(spark.read.parquet(f"{sf}/events.parquet"))
    S.write_rollup_part(once_more, 0, target)  # in the base already
    return rounded(S.read_rollup(spark, target))


@query(
    "t3_append_once",
    f"SELECT function_id, model, event_id FROM {EVENTS_SQL} QUALIFY row_number() OVER (PARTITION BY function_id, model ORDER BY timestamp, event_id) = 1",
)
def _(spark, sf):
    path = scratch_path(spark, "once")
    # Two runs with fresh checkpoints deliver everything twice; the table takes it once.
    for _run in range(2):
        S.start_append_once(
            event_stream(spark, sf), path, scratch_path(spark, "once-state"), ["timestamp", "event_id"]
        ).awaitTermination()
    return spark.read.parquet(path).select("function_id", "model", "event_id")


@query(
    "t3_once_per_key",
    f"SELECT CAST(count(DISTINCT (function_id, model)) AS BIGINT) AS n FROM {EVENTS_SQL}",
)
def _(spark, sf):
    # Three batches, the newest rows first; repeats of a key are days apart.
    source, path, state = (scratch_path(spark, n) for n in ("events", "once", "once-state"))

    def run():
        stream = _as_results(_stream(spark, sf, source))
        S.start_append_once(stream, path, state, ["timestamp", "event_id"]).awaitTermination()

    _deliver_thirds(spark, sf, source, run)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))


@query(
    "t4_live_monitor",
    f"SELECT model, CAST(count(*) AS BIGINT) AS count, CAST(count(*) FILTER (se_score IS NULL) AS BIGINT) AS pending, round(sum(cost_usd), 6) AS cost_usd FROM {EVENTS_SQL} GROUP BY model",
)
def _(spark, sf):
    return rounded(_table(spark, S.monitor_stream(event_stream(spark, sf)), "t4"))


def _live(spark, sf, start, compact):
    """The log in three runs on one checkpoint, compacted after the first: the folder of the parts."""
    source, target, state = (scratch_path(spark, n) for n in ("log", "live", "live-state"))
    log = X.run_log(spark, sf)
    third = F.pmod(F.xxhash64(*X.ARRIVAL), F.lit(3))
    for k in range(3):
        log.filter(third == k).write.mode("append").parquet(source)
        stream = spark.readStream.schema(log.schema).parquet(source)
        start(stream, target, state).awaitTermination()
        if k == 0:
            compact(spark, target)
    return target


def _live_report(spark, sf):
    return S.read_monitor(spark, _live(spark, sf, S.start_monitor, S.compact_monitor))


@query(
    "t4_live_percentiles",
    f"SELECT model, CAST(count(latency_ms) AS BIGINT) AS n, true AS p50_near, true AS p95_near, true AS p99_near FROM {RUN_LOG} GROUP BY model",
)
def _(spark, sf):
    parts = _live(spark, sf, S.start_latencies, S.compact_latencies)
    return near_ranks(X.run_log(spark, sf), S.read_latencies(spark, parts, ["model"]))


@query("t4_live_totals", TOTALS_SQL.format(2))
def _(spark, sf):
    return N.report_totals(_live_report(spark, sf))


@query("t4_live_by_model", BY_MODEL_SQL)
def _(spark, sf):
    return N.report_by_model(_live_report(spark, sf))


@query("t4_live_by_task_strategy", TASK_SQL)
def _(spark, sf):
    return N.report_by_task_strategy(_live_report(spark, sf))
