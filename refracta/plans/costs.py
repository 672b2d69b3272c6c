"""Spend: roll-ups, totals, budgets, usage and suite reports."""

import datetime

from pyspark.sql import functions as F

from refracta.operators import cost as O
from refracta.operators import quality as Q
from refracta.operators.astnodes import with_tree
from refracta.plans import fixtures as X
from refracta.plans.fixtures import MODELS_SQL, RESPONSES, RUN_LOG, SUITES, TEST_RESULTS, rounded
from refracta.plans.registry import query

ROLLUP_SQL = f"""(SELECT CAST(timestamp AS DATE) AS date, model, CAST(count(*) AS BIGINT) AS total_calls,
  sum(coalesce(cost_usd, 0.0)) AS total_cost_usd, avg(coalesce(latency_ms, 0)) AS avg_latency_ms,
  CAST(count(*) FILTER (error_type IS NULL) AS BIGINT) AS successful_calls,
  CAST(count(*) FILTER (error_type IS NOT NULL) AS BIGINT) AS failed_calls FROM {RUN_LOG} GROUP BY 1, 2)"""


def _rollup(spark, sf):
    return O.daily_rollup(X.run_log(spark, sf))


@query(
    "a3_daily_rollup",
    f"SELECT * REPLACE (round(total_cost_usd, 6) AS total_cost_usd, round(avg_latency_ms, 6) AS avg_latency_ms) FROM {ROLLUP_SQL}",
)
def _(spark, sf):
    return rounded(_rollup(spark, sf))


@query(
    "x1_incremental_rollup",
    f"SELECT * REPLACE (round(total_cost_usd, 6) AS total_cost_usd, round(avg_latency_ms, 6) AS avg_latency_ms) FROM {ROLLUP_SQL}",
)
def _(spark, sf):
    log = X.run_log(spark, sf)
    stored = O.daily_rollup(log.filter(F.col("l_orderkey") % 3 != 0))
    arriving = O.daily_rollup(log.filter(F.col("l_orderkey") % 3 == 0))
    return rounded(O.merge_rollups(stored, arriving))


@query(
    "a3_event_rollup",
    """SELECT CAST(ts AS DATE) AS date, event_type AS model, CAST(count(*) AS BIGINT) AS total_calls,
    round(sum(value), 4) AS total_cost_usd, CAST(count(*) FILTER (event_type <> 'error') AS BIGINT) AS successful_calls,
    CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS failed_calls FROM events GROUP BY 1, 2""",
)
def _(spark, sf):
    events = X.table(spark, sf, "events").select(
        F.col("ts").alias("timestamp"), F.col("event_type").alias("model"), F.col("value").alias("cost_usd"),
        F.lit(None).cast("int").alias("latency_ms"),
        F.when(F.col("event_type") == "error", "error").alias("error_type"),
    )
    return rounded(O.daily_rollup(events).drop("avg_latency_ms"), 4)


@query(
    "f17_rollup_rates",
    f"SELECT date, model, round(successful_calls * 100.0::DOUBLE / total_calls, 6) AS success_rate, "
    f"round(total_cost_usd / total_calls, 8) AS cost_per_call FROM {ROLLUP_SQL}",
)
def _(spark, sf):
    rates = O.with_rates(_rollup(spark, sf))
    return rates.select(
        "date", "model", F.round("success_rate", 6).alias("success_rate"),
        F.round("cost_per_call", 8).alias("cost_per_call"),
    )


@query("a4_total_cost", f"SELECT round(coalesce(sum(cost_usd), 0.0), 6) AS total_cost_usd FROM {RUN_LOG}")
def _(spark, sf):
    return rounded(O.total_cost(_rollup(spark, sf)))


@query(
    "a5_cost_of_tier",
    f"SELECT round(sum(cost_usd), 6) AS total_cost_usd FROM {RUN_LOG} WHERE model IN ('m0', 'm1', 'm2')",
)
def _(spark, sf):
    return rounded(O.cost_of_tier(_rollup(spark, sf), X.catalogue(spark), "tier1"))


@query("a6_cost_of_model", f"SELECT round(sum(cost_usd), 6) AS total_cost_usd FROM {RUN_LOG} WHERE model = 'm4'")
def _(spark, sf):
    return rounded(O.cost_of_model(_rollup(spark, sf), "m4"))


@query(
    "a7_cost_of_date",
    f"SELECT round(coalesce(sum(cost_usd), 0.0), 6) AS total_cost_usd FROM {RUN_LOG} WHERE CAST(timestamp AS DATE) = DATE '1998-06-15'",
)
def _(spark, sf):
    return rounded(O.cost_of_date(_rollup(spark, sf), datetime.date(1998, 6, 15)))


def _budget_sql(columns: str, total: float) -> str:
    return f"""WITH s AS (SELECT coalesce(m.tier, 'none') AS tier, sum(r.cost_usd) AS c FROM {RUN_LOG} r LEFT JOIN {MODELS_SQL} m ON m.id = r.model GROUP BY 1),
    b AS (SELECT * FROM (VALUES ('tier1', {total} * 0.6), ('tier2', {total} * 0.3), ('tier3', {total} * 0.1), ('total', {total} * 1.0)) t(tier, budget)),
    x AS (SELECT b.tier, b.budget::DOUBLE AS budget, CASE WHEN b.tier = 'total' THEN (SELECT sum(c) FROM s) ELSE coalesce(s.c, 0.0) END AS spent
    FROM b LEFT JOIN s ON s.tier = b.tier) SELECT {columns} FROM x"""


@query(
    "a8_remaining_budget",
    _budget_sql(
        "tier, round(budget, 6) AS budget_usd, round(spent, 6) AS spent_usd, round(budget - spent, 6) AS remaining_usd", 2000
    ),
)
def _(spark, sf):
    return rounded(O.budget_report(_rollup(spark, sf), X.catalogue(spark)).drop("exhausted"))


@query("a9_budget_exhausted", _budget_sql("tier, spent / budget >= 0.95::DOUBLE AS exhausted", 400))
def _(spark, sf):
    report = O.budget_report(_rollup(spark, sf), X.catalogue(spark), total=400.0)
    return report.select("tier", "exhausted")


_COSTED = f"""(SELECT r.*, (tokens_input + tokens_output) / 1000.0::DOUBLE * CASE WHEN m.id IS NULL THEN 0.002::DOUBLE
  ELSE coalesce(m.cost_per_1k_tokens, 0.001::DOUBLE) END AS cost_usd FROM {RESPONSES} r LEFT JOIN {MODELS_SQL} m ON m.id = r.model)"""


def _costed(spark, sf):
    return O.with_estimated_cost(X.responses(spark, sf), X.catalogue(spark))


@query("e21_estimated_cost", f"SELECT conv_id, turn, round(cost_usd, 9) AS cost_usd FROM {_COSTED}")
def _(spark, sf):
    return rounded(_costed(spark, sf).select("conv_id", "turn", "cost_usd"), 9)


@query(
    "a25_usage",
    f"""SELECT CAST(count(*) AS BIGINT) AS total_requests, round(sum(cost_usd), 6) AS total_cost_usd,
    CAST(sum(tokens_input) AS BIGINT) AS total_tokens_input, CAST(sum(tokens_output) AS BIGINT) AS total_tokens_output,
    CAST(sum(tokens_input) + sum(tokens_output) AS BIGINT) AS total_tokens, round(sum(cost_usd) / greatest(1, count(*)), 6) AS avg_cost_per_request
    FROM {_COSTED}""",
)
def _(spark, sf):
    return rounded(O.usage_report(_costed(spark, sf)))


# --- test suites --------------------------------------------------------------------------------

_STRUCT_SQL = f"""(SELECT function_id, language, doc_id, CASE language
  WHEN 'java' THEN contains(test_code, 'import org.junit') AND contains(test_code, '@Test')
  WHEN 'javascript' THEN contains(test_code, 'describe(') OR contains(test_code, 'test(') OR contains(test_code, 'it(')
  WHEN 'cpp' THEN contains(test_code, '#include <gtest/') AND contains(test_code, 'TEST(') ELSE doc_id % 9 <> 0 END AS syntax_valid
  FROM {SUITES})"""


def _structured(spark, sf):
    parsed = with_tree(X.suites(spark, sf), "test_code", "tree", F.col("language") == "python")
    return Q.suite_structure(parsed, F.col("tree.compile_ok")).drop("tree")


@query(
    "e14_suite_structure",
    f"""SELECT function_id, syntax_valid, syntax_valid AND language <> 'python' AS functional_valid,
    CASE WHEN syntax_valid THEN '' WHEN language = 'python' THEN 'Syntax error' WHEN language = 'java' THEN 'Missing JUnit test structure'
    WHEN language = 'javascript' THEN 'Missing Jest test structure' ELSE 'Missing GTest structure' END AS errors
    FROM {_STRUCT_SQL}""",
)
def _(spark, sf):
    return _structured(spark, sf).select(
        "function_id", "syntax_valid", "functional_valid", F.array_join("errors", ",").alias("errors")
    )


_VERDICT_SQL = f"""(SELECT s.*, s.language = 'python' AS py, s.syntax_valid AND t.passed IS NOT NULL AS ran,
  t.passed, t.coverage_pct AS cov, t.execution_time_ms AS ms FROM {_STRUCT_SQL} s LEFT JOIN {TEST_RESULTS} t USING (function_id))"""
_FLAGS_SQL = f"""(SELECT function_id, language, syntax_valid,
  CASE WHEN py THEN ran AND passed = 1 ELSE syntax_valid END AS functional_valid,
  py AND ran AND cov >= 80 AS coverage_valid,
  CASE WHEN py THEN ran AND ms < 100 ELSE syntax_valid END AS performance_valid,
  py AND ran AND passed = 1 AND cov >= 80 AND ms < 100 AS fully_valid FROM {_VERDICT_SQL})"""


def _verdicts(spark, sf):
    return Q.suite_verdicts(_structured(spark, sf), X.test_results(spark, sf))


@query(
    "e15_suite_verdicts",
    "SELECT function_id, " + ", ".join(
        f"coalesce({c}, false) AS {c}"
        for c in ("syntax_valid", "functional_valid", "coverage_valid", "performance_valid", "fully_valid")
    ) + f" FROM {_FLAGS_SQL}",
)
def _(spark, sf):
    return _verdicts(spark, sf).select(
        "function_id", "syntax_valid", "functional_valid", "coverage_valid", "performance_valid", "fully_valid"
    )


_KINDS = ("syntax", "functional", "coverage", "performance")


@query(
    "a24_suite_report",
    "SELECT CAST(count(*) AS BIGINT) AS total, "
    + ", ".join(f"count(*) FILTER ({k}_valid) AS {k}_passed" for k in _KINDS)
    + ", count(*) FILTER (fully_valid) AS fully_valid, "
    + ", ".join(f"round(count(*) FILTER ({k}_valid) * 100.0::DOUBLE / count(*), 6) AS {k}_pass_rate" for k in _KINDS)
    + f", round(count(*) FILTER (fully_valid) * 100.0::DOUBLE / count(*), 6) AS fully_valid_rate FROM {_FLAGS_SQL}",
)
def _(spark, sf):
    return rounded(Q.suite_report(_verdicts(spark, sf)))


@query(
    "f15_validated_functions",
    f"SELECT c.id, coalesce(f.fully_valid, false) AS validated FROM {X.CORPUS} c LEFT JOIN {_FLAGS_SQL} f ON f.function_id = c.id",
)
def _(spark, sf):
    marked = Q.mark_validated(X.corpus(spark, sf), _verdicts(spark, sf))
    return marked.select("id", "validated")
