"""Distributions, tests and fits over scores."""

from pyspark.sql import functions as F

from refracta.operators import cost as C
from refracta.operators import quality as Q
from refracta.operators import stats as T
from refracta.operators.ordered import value_ranks
from refracta.plans import fixtures as X
from refracta.plans.fixtures import CORPUS, FUNCTIONS, RUN_LOG, rounded
from refracta.plans.registry import query

CC = X.sql_cc("code")
SCORED = f"(SELECT * FROM {RUN_LOG} WHERE se_score IS NOT NULL)"


def with_functions(spark, sf):
    f = X.functions(spark, sf).select(
        F.col("id").alias("function_id"), "language", "cyclomatic_complexity", "halstead_volume", "lines_of_code"
    )
    return X.run_log(spark, sf).join(f, "function_id").filter(F.col("se_score").isNotNull())


JOINED = (
    f"(SELECT r.*, f.language, f.cyclomatic_complexity, f.halstead_volume, f.lines_of_code, f.complexity_tier AS tier "
    f"FROM {SCORED} r JOIN {FUNCTIONS} f ON f.id = r.function_id)"
)


def _distribution_sql(by: str, source: str) -> str:
    return f"""SELECT {by}, CAST(count(*) AS BIGINT) AS n, round(avg(se_score), 6) AS mean, round(stddev_samp(se_score), 6) AS std,
    round(quantile_cont(se_score, 0.25), 6) AS q1, round(quantile_cont(se_score, 0.5), 6) AS median,
    round(quantile_cont(se_score, 0.75), 6) AS q3, round(quantile_cont(se_score, 0.75) - quantile_cont(se_score, 0.25), 6) AS iqr
    FROM {source} GROUP BY {by}"""


@query("a30_distribution_by_language", _distribution_sql("language", JOINED))
def _(spark, sf):
    return rounded(T.distribution(with_functions(spark, sf), ["language"]))


@query("a30_distribution_by_range", _distribution_sql("task, strategy", SCORED))
def _(spark, sf):
    return rounded(T.distribution(X.run_log(spark, sf), ["task", "strategy"]))


_LATENCY_SQL = (
    f"SELECT model, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, "
    f"round(quantile_cont(latency_ms, 0.99), 6) AS p99 FROM {RUN_LOG} WHERE latency_ms IS NOT NULL GROUP BY model"
)


@query("a31_latency_percentiles", _LATENCY_SQL)
def _(spark, sf):
    return rounded(T.latency_percentiles(X.run_log(spark, sf), ["model"]))


_UNNAMED = "CASE WHEN model <> 'm3' THEN model END"


@query("a31_latency_percentiles_by_range", _LATENCY_SQL.replace(RUN_LOG, f"(SELECT * REPLACE ({_UNNAMED} AS model) FROM {RUN_LOG})"))
def _(spark, sf):
    # A NULL model is a group of its own.
    return rounded(T.latency_percentiles(X.run_log(spark, sf).withColumn("model", F.expr(_UNNAMED)), ["model"]))


@query(
    "a31_sketched_percentiles",
    f"""SELECT model, CAST(count(latency_ms) AS BIGINT) AS n, true AS p50_near, true AS p95_near, true AS p99_near,
    CAST(count(DISTINCT CAST(timestamp AS DATE)) AS BIGINT) AS days FROM {RUN_LOG} WHERE latency_ms IS NOT NULL GROUP BY model""",
)
def _(spark, sf):
    # Sketches per day, merged per model; their percentiles are held against the exact ranks.
    days = C.latency_sketches(X.run_log(spark, sf))
    counted = days.groupBy("model").agg(F.count(F.lit(1)).alias("days"))
    return near_ranks(X.run_log(spark, sf), C.merged_sketches(days, ["model"])).join(counted, "model")


def near_ranks(log, sketches):
    """Per model: rows in the sketch, and whether its percentiles lie at the ranks they claim."""
    at = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    found = C.sketched_percentiles(sketches, at).withColumnRenamed("n", "of")
    ranks = value_ranks(log, "latency_ms", ["model"]).join(found, "model")
    off = C.sketch_rank_error()

    def near(name, p):
        low, high = (p - off) * F.col("of"), (p + off) * F.col("of")
        return (F.col("latency_ms") == F.col(name)) & (F.col("below") <= high) & (F.col("below") + F.col("n") >= low)

    return ranks.groupBy("model").agg(F.max("of").alias("n"), *[F.bool_or(near(name, p)).alias(f"{name}_near") for name, p in at.items()])


@query(
    "a32_failure_taxonomy",
    f"""SELECT language, error_type, CAST(n AS BIGINT) AS failures, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY language), 6) AS pct FROM
    (SELECT c.language, coalesce(r.error_type, 'none') AS error_type, count(*) AS n FROM {RUN_LOG} r JOIN {CORPUS} c ON c.id = r.function_id
    WHERE r.preservation = 0 GROUP BY 1, 2)""",
)
def _(spark, sf):
    return rounded(T.failure_taxonomy(X.run_log(spark, sf), X.corpus(spark, sf)))


@query(
    "j10_tasks_in_languages",
    f"SELECT id, task FROM (SELECT id, split_part(task_name, ' ', 1) || p_size AS task, language FROM {CORPUS}) "
    f"WHERE task IN (SELECT split_part(task_name, ' ', 1) || p_size FROM {CORPUS} GROUP BY 1 HAVING count(DISTINCT language) >= 4)",
)
def _(spark, sf):
    c = X.corpus(spark, sf).select(
        "id", "language",
        F.concat(F.substring_index("task_name", " ", 1), F.col("p_size").cast("string")).alias("task_name"),
    )
    return T.tasks_in_languages(c).select("id", F.col("task_name").alias("task"))


PAIRED = f"""(WITH s AS (SELECT function_id, model, task, strategy, avg(se_score) AS se FROM {SCORED} GROUP BY 1, 2, 3, 4)
  SELECT b.function_id, b.model, b.task, s.strategy, s.se - b.se AS diff FROM s b JOIN s USING (function_id, model, task)
  WHERE b.strategy = 'zero_shot' AND s.strategy <> 'zero_shot')"""


@query(
    "j11_paired_differences",
    f"SELECT function_id, model, task, strategy, round(diff, 6) AS diff FROM {PAIRED}",
)
def _(spark, sf):
    return rounded(T.paired_differences(X.run_log(spark, sf)))


@query(
    "z3_paired_t",
    f"SELECT strategy, CAST(count(*) AS BIGINT) AS n, round(avg(diff), 6) AS mean_diff, round(avg(diff) / (stddev_samp(diff) / sqrt(count(*))), 6) AS t_statistic FROM {PAIRED} GROUP BY strategy",
)
def _(spark, sf):
    return rounded(T.paired_t(T.paired_differences(X.run_log(spark, sf))).drop("p_value", "p_bonferroni"))


def anova_sql(group: str, value: str, source: str, columns: str) -> str:
    return f"""WITH d AS (SELECT {group} AS g, {value} AS x FROM {source}), m AS (SELECT g, count(*) AS n, avg(x) AS mu, var_pop(x) * count(*) AS ssw FROM d GROUP BY g),
    t AS (SELECT avg(x) AS mu FROM d), a AS (SELECT sum(m.n * (m.mu - t.mu) ^ 2) AS ssb, sum(ssw) AS ssw, count(*) - 1 AS dfb, CAST(sum(n) - count(*) AS BIGINT) AS dfw FROM m, t)
    SELECT CAST(dfb AS BIGINT) AS df_between, dfw AS df_within, {columns} FROM a"""


@query(
    "z1_anova_by_model",
    anova_sql("model", "se_score", SCORED, "round((ssb / dfb) / (ssw / dfw), 6) AS f_statistic, round(ssb / (ssb + ssw), 9) AS eta_squared"),
)
def _(spark, sf):
    a = T.anova(X.run_log(spark, sf), "model", "se_score")
    return a.select(
        "df_between", "df_within", F.round("f_statistic", 6).alias("f_statistic"),
        F.round("eta_squared", 9).alias("eta_squared"),
    )


@query(
    "z2_cohens_d",
    f"""WITH m AS (SELECT strategy, count(*) AS n, avg(se_score) AS mu, var_samp(se_score) AS v FROM {SCORED} GROUP BY strategy), b AS (SELECT * FROM m WHERE strategy = 'zero_shot')
    SELECT m.strategy, CAST(m.n AS BIGINT) AS n, round(m.mu, 6) AS mean, round((m.mu - b.mu) / sqrt(((m.n - 1) * m.v + (b.n - 1) * b.v) / (m.n + b.n - 2)), 6) AS cohens_d
    FROM m, b WHERE m.strategy <> 'zero_shot'""",
)
def _(spark, sf):
    return rounded(T.cohens_d(X.run_log(spark, sf)))


RANKED = """(SELECT g, x, (count(*) OVER (ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  - count(*) OVER (PARTITION BY x)) + (count(*) OVER (PARTITION BY x) + 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY x) AS c FROM {0})"""


@query(
    "z4_kruskal_wallis",
    f"""WITH r AS (SELECT * FROM {RANKED.format(f"(SELECT language AS g, se_score AS x FROM {JOINED})")}), n AS (SELECT count(*)::DOUBLE AS n FROM r),
    q AS (SELECT sum(s * s / k) AS q, count(*) AS groups FROM (SELECT g, sum(r) AS s, count(*) AS k FROM r GROUP BY g)),
    t AS (SELECT sum(c::DOUBLE ^ 3 - c) AS t FROM (SELECT x, max(c) AS c FROM r GROUP BY x))
    SELECT CAST(n AS BIGINT) AS n, CAST(groups - 1 AS BIGINT) AS df, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n ^ 3 - n)), 4) AS h_statistic FROM n, q, t""",
)
def _(spark, sf):
    return rounded(T.kruskal_wallis(with_functions(spark, sf), "language", "se_score").drop("p_value"), 4)


@query(
    "z4_mann_whitney",
    f"""WITH r AS (SELECT * FROM {RANKED.format(f"(SELECT language AS g, se_score AS x FROM {JOINED} WHERE language IN ('python', 'cpp'))")}),
    s AS (SELECT count(*) FILTER (g = 'python') AS n1, count(*) FILTER (g = 'cpp') AS n2, sum(r) FILTER (g = 'python') AS r1 FROM r)
    SELECT n1, n2, r1 - n1 * (n1 + 1) / 2 AS u1, n1 * n2 - (r1 - n1 * (n1 + 1) / 2) AS u2 FROM s""",
)
def _(spark, sf):
    return T.mann_whitney(with_functions(spark, sf), "language", "se_score", "python", "cpp").drop("p_value")


@query(
    "z5_levene",
    anova_sql(
        "g", "abs(x - med)",
        f"(SELECT language AS g, se_score AS x, quantile_cont(se_score, 0.5) OVER (PARTITION BY language) AS med FROM {JOINED})",
        "round((ssb / dfb) / (ssw / dfw), 6) AS w_statistic",
    ),
)
def _(spark, sf):
    return rounded(T.levene(with_functions(spark, sf), "language", "se_score").drop("p_value"))


@query(
    "z6_correlation",
    f"SELECT CAST(count(*) AS BIGINT) AS n, round(corr(cyclomatic_complexity, se_score), 9) AS pearson_r FROM {JOINED}",
)
def _(spark, sf):
    return rounded(T.correlation(with_functions(spark, sf), "cyclomatic_complexity", "se_score").drop("p_value"), 9)


@query(
    "z6_correlation_volume",
    f"SELECT CAST(count(*) AS BIGINT) AS n, round(corr(halstead_volume, se_score), 9) AS pearson_r FROM {JOINED}",
)
def _(spark, sf):
    return rounded(T.correlation(with_functions(spark, sf), "halstead_volume", "se_score").drop("p_value"), 9)


@query(
    "z7_linear_fit",
    f"SELECT round(regr_slope(effort, l_extendedprice), 12) AS slope, round(regr_intercept(effort, l_extendedprice), 9) AS intercept, round(regr_r2(effort, l_extendedprice), 9) AS r2 FROM {SCORED}",
)
def _(spark, sf):
    fit = T.linear_fit(X.run_log(spark, sf).filter(F.col("se_score").isNotNull()), "l_extendedprice", "effort")
    return fit.select(
        F.round("slope", 12).alias("slope"), F.round("intercept", 9).alias("intercept"), F.round("r2", 9).alias("r2")
    )


_PREDICTORS = ("cyclomatic_complexity", "halstead_volume", "lines_of_code")


def _determinant(m: list[list[str]]) -> str:
    """The expression for a determinant, expanded along the first row."""
    if len(m) == 1:
        return m[0][0]
    minors = [_determinant([row[:j] + row[j + 1 :] for row in m[1:]]) for j in range(len(m))]
    return "(" + "".join(f" {'-' if j % 2 else '+'} {m[0][j]} * {minors[j]}" for j in range(len(m))) + ")"


def _fit_sql(predictors: dict[str, str], source: str) -> str:
    """Least squares on ``predictors`` (name: expression): normal equations by Cramer's rule."""
    n = len(predictors)
    moments = [f"covar_pop(x{i}, x{j}) AS s{i}{j}" for i in range(n) for j in range(i, n)]
    moments += [f"covar_pop(x{i}, y) AS t{i}, avg(x{i}) AS m{i}" for i in range(n)]

    def system(replaced: int | None) -> str:
        return _determinant(
            [[f"t{i}" if j == replaced else f"s{min(i, j)}{max(i, j)}" for j in range(n)] for i in range(n)]
        )

    columns = ", ".join(f"({p})::DOUBLE AS x{i}" for i, p in enumerate(predictors.values()))
    solved = ", ".join(f"{system(i)} / {system(None)} AS b{i}" for i in range(n))
    rows = " UNION ALL ".join(f"SELECT '{p}' AS term, round(b{i}, 6) AS coefficient FROM b" for i, p in enumerate(predictors))
    intercept = " ".join(f"- b{i} * m{i}" for i in range(n))
    explained = " + ".join(f"b{i} * t{i}" for i in range(n))
    return f"""WITH d AS (SELECT {columns}, se_score::DOUBLE AS y FROM {source} WHERE se_score IS NOT NULL),
    m AS (SELECT {", ".join(moments)}, avg(y) AS my, var_pop(y) AS vy FROM d), b AS (SELECT *, {solved} FROM m)
    {rows} UNION ALL SELECT 'intercept', round(my {intercept}, 6) FROM b
    UNION ALL SELECT 'r2', round(({explained}) / vy, 6) FROM b"""


_X = "cyclomatic_complexity"


@query("z7_quadratic_fit", _fit_sql({_X: _X, f"{_X}_squared": f"{_X} * {_X}"}, JOINED))
def _(spark, sf):
    return rounded(T.quadratic_fit(with_functions(spark, sf), _X, "se_score"))


@query("z7_multiple_fit", _fit_sql({p: p for p in _PREDICTORS}, JOINED))
def _(spark, sf):
    rows = with_functions(spark, sf)
    fit = T.multiple_fit(rows, list(_PREDICTORS), "se_score")
    return rounded(fit)


_PIECES = ("n", "sx", "sy", "sxx", "sxy", "syy")


@query(
    "z8_piecewise_fit",
    f"""WITH m AS (SELECT delta_cc AS bp, count(*)::DOUBLE AS n, sum(delta_cc) AS sx, sum(se_score) AS sy, sum(delta_cc * delta_cc) AS sxx,
    sum(delta_cc * se_score) AS sxy, sum(se_score * se_score) AS syy FROM {SCORED} GROUP BY 1),
    c AS (SELECT bp, {", ".join(f"sum({k}) OVER (ORDER BY bp) AS l{k}, sum({k}) OVER () - sum({k}) OVER (ORDER BY bp) AS r{k}" for k in _PIECES)} FROM m)
    SELECT bp AS breakpoint, round(
    (lsyy - lsy * lsy / ln) - CASE WHEN lsxx - lsx * lsx / ln > 0 THEN (lsxy - lsx * lsy / ln) ^ 2 / (lsxx - lsx * lsx / ln) ELSE 0 END
    + (rsyy - rsy * rsy / rn) - CASE WHEN rsxx - rsx * rsx / rn > 0 THEN (rsxy - rsx * rsy / rn) ^ 2 / (rsxx - rsx * rsx / rn) ELSE 0 END, 1) AS sse,
    CAST(ln AS BIGINT) AS rows_left, CAST(rn AS BIGINT) AS rows_right FROM c WHERE ln >= 3 AND rn >= 3 ORDER BY sse, breakpoint LIMIT 1""",
)
def _(spark, sf):
    return rounded(T.piecewise_fit(X.run_log(spark, sf), "delta_cc", "se_score"), 1)


@query(
    "z10_chi_square",
    f"""WITH o AS (SELECT language, count(*)::DOUBLE AS o FROM {JOINED} GROUP BY 1),
    s AS (SELECT * FROM (VALUES ('python', 0.3::DOUBLE), ('java', 0.3::DOUBLE), ('javascript', 0.2::DOUBLE), ('cpp', 0.2::DOUBLE)) t(language, share)),
    x AS (SELECT coalesce(o, 0) AS o, share * (SELECT sum(o) FROM o) AS e FROM s LEFT JOIN o USING (language))
    SELECT round(sum((o - e) ^ 2 / e), 6) AS chi_square, CAST(count(*) - 1 AS BIGINT) AS df FROM x""",
)
def _(spark, sf):
    rows = with_functions(spark, sf)
    targets = {"python": 150, "java": 150, "javascript": 100, "cpp": 100}
    return rounded(T.chi_square(rows, "language", targets).drop("p_value"))


@query(
    "z11_strategy_by_tier",
    f"""WITH c AS (SELECT strategy, tier, count(*) AS n, avg(se_score) AS mean FROM {JOINED} GROUP BY 1, 2)
    SELECT strategy, tier, CAST(n AS BIGINT) AS n, round(mean, 6) AS mean, round(mean - sum(mean * n) OVER (PARTITION BY strategy) / sum(n) OVER (PARTITION BY strategy)
    - sum(mean * n) OVER (PARTITION BY tier) / sum(n) OVER (PARTITION BY tier) + sum(mean * n) OVER () / sum(n) OVER (), 6) AS interaction FROM c""",
)
def _(spark, sf):
    from refracta.functions.metrics import complexity_tier

    rows = with_functions(spark, sf).withColumn("tier", complexity_tier(F.col("cyclomatic_complexity")))
    return rounded(T.cell_means(rows, "strategy", "tier"))


@query(
    "z12_acceptance",
    f"""WITH c AS (SELECT function_id, model, task, strategy, count(preservation) AS k, count(*) FILTER (preservation = 1) AS ok, sum(cost_usd) AS cost FROM {RUN_LOG} GROUP BY 1, 2, 3, 4),
    t AS (SELECT model, count(*) AS cells, sum(ok) * 100.0::DOUBLE / sum(k) AS p, sum(cost) AS spent FROM c GROUP BY model)
    SELECT model, CAST(cells AS BIGINT) AS cells, round(cells / 48000.0::DOUBLE * 100, 6) AS coverage_pct, round(p, 6) AS preservation_pct, p BETWEEN 60 AND 80 AS preservation_ok,
    round(spent, 6) AS spent_usd, spent BETWEEN 42.0 * 0.9 AND 42.0 * 1.1 AS cost_ok FROM t""",
)
def _(spark, sf):
    return rounded(
        Q.acceptance(
            X.run_log(spark, sf), 48000, 42.0, ["function_id", "model", "task", "strategy"], ["model"]
        )
    )


_RANK_SQL = f"""(WITH m AS (SELECT task, model, avg(se_score) AS se FROM {SCORED} GROUP BY 1, 2)
  SELECT task, model, rank() OVER (PARTITION BY task ORDER BY se DESC) + (count(*) OVER (PARTITION BY task, se) - 1) / 2.0::DOUBLE AS rank FROM m)"""


@query("w8_model_ranks", f"SELECT task, model, rank FROM {_RANK_SQL}")
def _(spark, sf):
    return T.model_ranks(X.run_log(spark, sf)).select("task", "model", "rank")


@query(
    "w8_rank_agreement",
    f"SELECT a.task AS task_a, b.task AS task_b, CAST(count(*) AS BIGINT) AS models, round(corr(a.rank, b.rank), 9) AS spearman FROM {_RANK_SQL} a JOIN {_RANK_SQL} b USING (model) WHERE a.task < b.task GROUP BY 1, 2",
)
def _(spark, sf):
    return rounded(T.rank_agreement(T.model_ranks(X.run_log(spark, sf))), 9)
