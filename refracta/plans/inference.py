"""P-values, analysis of variance with two factors, logistic regression, interval of a breakpoint.

SQL has no tail functions, so it sums their power series; sums of squares and coefficients come
from alternating fits and Newton rounds that are written out one after the other.
"""

from pyspark.sql import functions as F

from refracta.functions.metrics import complexity_tier
from refracta.operators import inference as I
from refracta.operators import stats as T
from refracta.plans import fixtures as X
from refracta.plans.fixtures import rounded
from refracta.plans.registry import query
from refracta.plans.statistics import (
    JOINED,
    PAIRED,
    RANKED,
    SCORED,
    anova_sql,
    with_functions,
)


def sql_f_tail(f: str, df1: str, df2: str) -> str:
    """P(F >= f), by the series of the incomplete beta function."""
    a, b = f"({df2} / 2.0::DOUBLE)", f"({df1} / 2.0::DOUBLE)"
    y = f"({df1} * ({f}) / ({df2} + {df1} * ({f})))"
    term = f"exp(lgamma({a} + {b} + i) - lgamma({a}) - lgamma({b} + 1 + i) + ({b} + i) * ln({y}) + {a} * ln(1 - {y}))"
    return f"greatest(0, 1 - list_sum(list_transform(range(0, 4000), lambda i: {term})))"


def sql_t_tail(t: str, df: str) -> str:
    """P(|T| >= |t|)."""
    return sql_f_tail(f"({t}) ^ 2", "1", df)


def sql_chi_square_tail(x: str, df: str) -> str:
    """P(X >= x), by the series of the incomplete gamma function."""
    s, h = f"({df} / 2.0::DOUBLE)", f"(({x}) / 2)"
    term = f"exp(({s} + i) * ln({h}) - {h} - lgamma({s} + 1 + i))"
    return f"greatest(0, 1 - list_sum(list_transform(range(0, 4000), lambda i: {term})))"


_F = "((ssb / dfb) / (ssw / dfw))"


@query("z1_anova_p", anova_sql("model", "se_score", SCORED, f"round({sql_f_tail(_F, 'dfb', 'dfw')}, 6) AS p_value"))
def _(spark, sf):
    a = T.anova(X.run_log(spark, sf), "model", "se_score")
    return rounded(a.select("df_between", "df_within", "p_value"))


@query(
    "z1_anova_p_by_language",
    anova_sql("language", "se_score", JOINED, f"round({sql_f_tail(_F, 'dfb', 'dfw')}, 6) AS p_value"),
)
def _(spark, sf):
    a = T.anova(with_functions(spark, sf), "language", "se_score")
    return rounded(a.select("df_between", "df_within", "p_value"))


@query(
    "z3_paired_t_p",
    f"""WITH t AS (SELECT strategy, count(*) AS n, avg(diff) / (stddev_samp(diff) / sqrt(count(*))) AS t FROM {PAIRED} GROUP BY strategy),
    p AS (SELECT strategy, n, {sql_t_tail("t", "(n - 1)")} AS p FROM t)
    SELECT strategy, CAST(n AS BIGINT) AS n, round(p, 6) AS p_value, round(least(1, p * (SELECT count(*) FROM p)), 6) AS p_bonferroni FROM p""",
)
def _(spark, sf):
    t = T.paired_t(T.paired_differences(X.run_log(spark, sf)))
    return rounded(t.select("strategy", "n", "p_value", "p_bonferroni"))


@query(
    "z4_kruskal_wallis_p",
    f"""WITH r AS (SELECT * FROM {RANKED.format(f"(SELECT language AS g, se_score AS x FROM {JOINED})")}), n AS (SELECT count(*)::DOUBLE AS n FROM r),
    q AS (SELECT sum(s * s / k) AS q, count(*) AS groups FROM (SELECT g, sum(r) AS s, count(*) AS k FROM r GROUP BY g)),
    t AS (SELECT sum(c::DOUBLE ^ 3 - c) AS t FROM (SELECT x, max(c) AS c FROM r GROUP BY x)),
    h AS (SELECT groups - 1 AS df, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n ^ 3 - n)) AS h FROM n, q, t)
    SELECT CAST(df AS BIGINT) AS df, round({sql_chi_square_tail("h", "df")}, 6) AS p_value FROM h""",
)
def _(spark, sf):
    return rounded(T.kruskal_wallis(with_functions(spark, sf), "language", "se_score").select("df", "p_value"))


@query(
    "z4_mann_whitney_p",
    f"""WITH r AS (SELECT * FROM {RANKED.format(f"(SELECT language AS g, se_score AS x FROM {JOINED} WHERE language IN ('python', 'cpp'))")}),
    s AS (SELECT count(*) FILTER (g = 'python')::DOUBLE AS n1, count(*) FILTER (g = 'cpp')::DOUBLE AS n2, sum(r) FILTER (g = 'python') AS r1 FROM r),
    t AS (SELECT sum(c::DOUBLE ^ 3 - c) AS t FROM (SELECT x, max(c) AS c FROM r GROUP BY x)),
    z AS (SELECT n1, n2, greatest(abs(r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) - 0.5, 0) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - t / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM s, t)
    SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round({sql_chi_square_tail("z * z", "1")}, 6) AS p_value FROM z""",
)
def _(spark, sf):
    u = T.mann_whitney(with_functions(spark, sf), "language", "se_score", "python", "cpp")
    return rounded(u.select("n1", "n2", "p_value"))


@query(
    "z5_levene_p",
    anova_sql(
        "g", "abs(x - med)",
        f"(SELECT language AS g, se_score AS x, quantile_cont(se_score, 0.5) OVER (PARTITION BY language) AS med FROM {JOINED})",
        f"round({sql_f_tail(_F, 'dfb', 'dfw')}, 6) AS p_value",
    ),
)
def _(spark, sf):
    return rounded(T.levene(with_functions(spark, sf), "language", "se_score").drop("w_statistic"))


@query(
    "z6_correlation_p",
    f"""WITH r AS (SELECT count(*) AS n, corr(cyclomatic_complexity, se_score) AS r FROM {JOINED})
    SELECT CAST(n AS BIGINT) AS n, round({sql_t_tail("r * sqrt((n - 2) / (1 - r * r))", "(n - 2)")}, 6) AS p_value FROM r""",
)
def _(spark, sf):
    c = T.correlation(with_functions(spark, sf), "cyclomatic_complexity", "se_score")
    return rounded(c.select("n", "p_value"))


#: Target shares close to those of the corpus, which is dealt to the languages in turn.
_SHARES = {"python": 1001, "java": 1000, "javascript": 999, "cpp": 1000}


@query(
    "z10_chi_square_p",
    f"""WITH o AS (SELECT language, count(*)::DOUBLE AS o FROM {X.CORPUS} GROUP BY 1),
    s AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v / 4000}::DOUBLE)" for k, v in _SHARES.items())}) t(language, share)),
    x AS (SELECT coalesce(o, 0) AS o, share * (SELECT sum(o) FROM o) AS e FROM s LEFT JOIN o USING (language)),
    c AS (SELECT sum((o - e) ^ 2 / e) AS c, count(*) - 1 AS df FROM x)
    SELECT CAST(df AS BIGINT) AS df, round({sql_chi_square_tail("c", "df")}, 6) AS p_value FROM c""",
)
def _(spark, sf):
    return rounded(T.chi_square(X.corpus(spark, sf), "language", _SHARES).select("df", "p_value"))


def _alternating(source: str, factors: dict[str, str], rounds: int) -> tuple[str, str]:
    """CTEs that fit an additive model to ``source`` (n, s and the factors) by fitting one factor
    after the other, and the join with its effects."""
    steps, last = [], {}
    for k in range(rounds):
        for name, key in factors.items():
            others = {o: at for o, at in last.items() if o != name}
            fitted = "".join(f" - {c}.n * {at}.e" for o, at in others.items() for c in ("c",))
            joins = " ".join(f"JOIN {at} ON c.{factors[o]} = {at}.{factors[o]}" for o, at in others.items())
            steps.append(
                f"{name}{k} AS MATERIALIZED (SELECT c.{key}, sum(c.s{fitted}) / sum(c.n) AS e FROM {source} c {joins} GROUP BY c.{key})"
            )
            last[name] = f"{name}{k}"
    joins = " ".join(f"JOIN {at} ON c.{factors[o]} = {at}.{factors[o]}" for o, at in last.items())
    effects = " + ".join(f"{at}.e" for at in last.values())
    return ", ".join(steps), f"(SELECT sum(c.q - 2 * c.s * ({effects}) + c.n * ({effects}) ^ 2) AS sse FROM {source} c {joins})"


_TERM_ROWS = (("a", "{0}"), ("b", "{1}"), ("ab", "{0}:{1}"))


def _two_way_sql(rows: str, first: str, second: str, subject: str | None, rounds: int) -> str:
    """Sequential sums of squares from the errors of nested additive fits."""
    base = {"u": "g"} if subject else {}
    fit_a, sse_a = _alternating("cell", {**base, "fa": "a"}, rounds if subject else 1)
    fit_ab, sse_ab = _alternating("cell", {**{f"{k}x": v for k, v in base.items()}, "xa": "a", "xb": "b"}, rounds)
    fit_all, sse_all = _alternating("cell", {**{f"{k}y": v for k, v in base.items()}, "yc": "ab"}, rounds if subject else 1)
    fa = "{0}".format
    tests = " UNION ALL ".join(
        f"SELECT '{name.format(first, second)}' AS term, df_{k} AS df, ss_{k} AS ss, (ss_{k} / df_{k}) / (ss_r / df_r) AS f, df_r FROM sums"
        for k, name in _TERM_ROWS
    )
    return f"""WITH cell AS MATERIALIZED (SELECT {subject or "1"} AS g, {first} AS a, {second} AS b, {first} || '/' || {second} AS ab,
      count(*)::DOUBLE AS n, sum(se_score) AS s, sum(se_score * se_score) AS q FROM {rows} GROUP BY ALL),
    {fit_a}, {fit_ab}, {fit_all},
    sums AS (SELECT w - sa AS ss_a, sa - sab AS ss_b, sab - sall AS ss_ab, sall AS ss_r, na - 1 AS df_a, nb - 1 AS df_b,
      nab - na - nb + 1 AS df_ab, (rows - ng - nab + 1)::BIGINT AS df_r
      FROM (SELECT sum(q - s * s / n) AS w, count(*) AS ng, sum(n) AS rows FROM (SELECT g, sum(q) AS q, sum(s) AS s, sum(n) AS n FROM cell GROUP BY g)),
      (SELECT count(DISTINCT a) AS na, count(DISTINCT b) AS nb, count(DISTINCT ab) AS nab FROM cell),
      (SELECT sse AS sa FROM {fa(sse_a)}), (SELECT sse AS sab FROM {sse_ab}), (SELECT sse AS sall FROM {sse_all}))
    SELECT term, CAST(df AS BIGINT) AS df, round(ss, 2) AS ss, round(f, 6) AS f_statistic, round({sql_f_tail("f", "df", "df_r")}, 6) AS p_value FROM ({tests})
    UNION ALL SELECT 'residual', df_r, round(ss_r, 2), NULL, NULL FROM sums"""


def _two_way(found):
    return found.select(
        "term", "df", F.round("ss", 2).alias("ss"), F.round("f_statistic", 6).alias("f_statistic"),
        F.round("p_value", 6).alias("p_value"),
    )


@query("z11_two_way_anova", _two_way_sql(JOINED, "strategy", "tier", None, 12))
def _(spark, sf):
    rows = with_functions(spark, sf).withColumn("tier", complexity_tier(F.col("cyclomatic_complexity")))
    return _two_way(I.two_way_anova(rows, "strategy", "tier"))


@query("z11_repeated_measures", _two_way_sql(SCORED, "strategy", "model", "function_id", 30))
def _(spark, sf):
    return _two_way(I.two_way_anova(X.run_log(spark, sf), "strategy", "model", subject=["function_id"]))


_NEWTON_ROUNDS = 12


def _logistic_sql(fields: str) -> str:
    """Newton rounds with an intercept per language; ``fields`` are taken from the terms."""
    steps = ["at0 AS (SELECT DISTINCT language, 0.0::DOUBLE AS alpha, 0.0::DOUBLE AS beta FROM pattern)"]
    for k in range(_NEWTON_ROUNDS):
        steps.append(
            f"""p{k} AS (SELECT p.language, x, n, k, 1 / (1 + exp(-(alpha + beta * x))) AS p FROM pattern p JOIN at{k} USING (language)),
            l{k} AS MATERIALIZED (SELECT language, sum(n * p * (1 - p)) AS w, sum(n * p * (1 - p) * x) AS s, sum(n * p * (1 - p) * x * x) AS q,
              sum(k - n * p) AS r, sum((k - n * p) * x) AS g FROM p{k} GROUP BY language),
            d{k} AS (SELECT (sum(g) - sum(s * r / w)) / (sum(q) - sum(s * s / w)) AS d, 1 / (sum(q) - sum(s * s / w)) AS v FROM l{k}),
            at{k + 1} AS MATERIALIZED (SELECT language, alpha + (r - s * d) / w AS alpha, beta + d AS beta FROM at{k} JOIN l{k} USING (language), d{k})"""
        )
    last, of = f"at{_NEWTON_ROUNDS}", f"l{_NEWTON_ROUNDS - 1}"
    return f"""WITH pattern AS MATERIALIZED (SELECT language, cyclomatic_complexity::DOUBLE AS x, count(*)::DOUBLE AS n, sum(preservation)::DOUBLE AS k
      FROM {JOINED} WHERE preservation IS NOT NULL GROUP BY ALL), {", ".join(steps)},
    fit AS (SELECT language, alpha, beta, w, s / w AS m, v FROM {last} JOIN {of} USING (language), d{_NEWTON_ROUNDS - 1}),
    reference AS (SELECT * FROM fit ORDER BY language LIMIT 1),
    terms AS (
      SELECT 'cyclomatic_complexity' AS term, beta AS coefficient, sqrt(v) AS std_error FROM reference
      UNION ALL SELECT 'intercept', alpha, sqrt(1 / w + m * m * v) FROM reference
      UNION ALL SELECT 'language=' || f.language, f.alpha - r.alpha, sqrt(1 / f.w + 1 / r.w + (f.m - r.m) ^ 2 * f.v)
        FROM fit f, reference r WHERE f.language <> r.language)
    SELECT {fields} FROM terms"""


def _logistic(spark, sf):
    return I.logistic_fit(with_functions(spark, sf), "preservation", ["cyclomatic_complexity"], "language")


@query("z9_logistic_fit", _logistic_sql("term, round(coefficient, 4) AS coefficient"))
def _(spark, sf):
    return rounded(_logistic(spark, sf).select("term", "coefficient"), 4)


@query(
    "z9_logistic_errors",
    _logistic_sql(
        "term, round(std_error, 6) AS std_error, round(coefficient / std_error, 4) AS z, "
        f"round({sql_chi_square_tail('(coefficient / std_error) ^ 2', '1')}, 6) AS p_value"
    ),
)
def _(spark, sf):
    fit = _logistic(spark, sf)
    return fit.select(
        "term", F.round("std_error", 6).alias("std_error"), F.round("z", 4).alias("z"), F.round("p_value", 6).alias("p_value")
    )


_REPLICATES, _BLOCKS = 200, 256


def _share(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 12))::BIGINT)"


_K = ("n", "sx", "sy", "sxx", "sxy", "syy")


def _error_sql(side: str) -> str:
    n, sx, sy, sxx, sxy, syy = (f"{side}_{k}" for k in _K)
    return (
        f"({syy} - {sy} * {sy} / {n} - CASE WHEN {sxx} - {sx} * {sx} / {n} > 0 "
        f"THEN ({sxy} - {sx} * {sy} / {n}) * ({sxy} - {sx} * {sy} / {n}) / ({sxx} - {sx} * {sx} / {n}) ELSE 0 END)"
    )


def _best_sql(moments: str, by: str) -> str:
    """Per value of ``by``: the split with the least error."""
    left = ", ".join(f"sum({k}) OVER (PARTITION BY {by} ORDER BY bp) AS l_{k}" for k in _K)
    whole = ", ".join(f"sum({k}) OVER (PARTITION BY {by}) AS t_{k}" for k in _K)
    right = ", ".join(f"t_{k} - l_{k} AS r_{k}" for k in _K)
    return f"""(SELECT {by}, bp FROM (SELECT {by}, bp, l_n, r_n, {_error_sql("l")} + {_error_sql("r")} AS sse
      FROM (SELECT *, {right} FROM (SELECT {by}, bp, {left}, {whole} FROM {moments}))
      WHERE l_n >= 3 AND r_n >= 3) QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY sse, bp) = 1)"""


@query(
    "z8_breakpoint_interval",
    f"""WITH d AS (SELECT delta_cc::DOUBLE AS x, se_score AS y, {_share("function_id")} % {_BLOCKS} AS block FROM {SCORED}),
    per_block AS MATERIALIZED (SELECT x AS bp, block, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy
      FROM d GROUP BY ALL),
    weight AS MATERIALIZED (SELECT block, replicate, ({" + ".join(f"(u >= {p!r})::INTEGER" for p in I.POISSON)}) AS w
      FROM (SELECT block, replicate, {_share("block || '|' || replicate")} / {float(16**12)!r} AS u
      FROM range({_BLOCKS}) b(block), range(1, {_REPLICATES + 1}) r(replicate))),
    drawn AS (SELECT replicate, bp, {", ".join(f"sum({k} * w) AS {k}" for k in _K)} FROM per_block JOIN weight USING (block) WHERE w > 0 GROUP BY ALL),
    whole AS (SELECT 0 AS replicate, bp, {", ".join(f"sum({k}) AS {k}" for k in _K)} FROM per_block GROUP BY bp),
    best AS (SELECT list_sort(list(bp)) AS found, count(*) AS n FROM {_best_sql("drawn", "replicate")})
    SELECT (SELECT bp FROM {_best_sql("whole", "replicate")}) AS breakpoint, found[ceil(n * 0.025::DOUBLE)::INTEGER] AS lower,
    found[ceil(n * 0.975::DOUBLE)::INTEGER] AS upper, CAST(n AS BIGINT) AS replicates FROM best""",
)
def _(spark, sf):
    return I.breakpoint_interval(
        X.run_log(spark, sf), "delta_cc", "se_score", ["function_id"], replicates=_REPLICATES, blocks=_BLOCKS
    )
