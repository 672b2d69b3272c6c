"""Statistics over scores as aggregations, with the p-values of the tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refracta.constants import STRATEGIES
from refracta.functions.distributions import chi_square_tail, f_tail, normal_two_sided, t_two_sided
from refracta.operators.ordered import quantiles, running_total, running_totals, value_summary
from refracta.session import cut_lineage, literal_rows


def distribution(facts: DataFrame, by: Sequence[str], value: str = "se_score") -> DataFrame:
    """n, mean, sample deviation, quartiles and interquartile range per group."""
    rows = facts.filter(F.col(value).isNotNull())
    cuts = value_summary(rows, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return cuts.withColumn("iqr", F.col("q3") - F.col("q1"))


def latency_percentiles(facts: DataFrame, by: Sequence[str]) -> DataFrame:
    return quantiles(
        facts.filter(F.col("latency_ms").isNotNull()), by, "latency_ms",
        {"p50": 0.5, "p95": 0.95, "p99": 0.99},
    )


def failure_taxonomy(facts: DataFrame, functions: DataFrame) -> DataFrame:
    """Share of each error type among the failures of a language."""
    failed = (
        facts.filter(F.col("preservation") == 0)
        .groupBy("function_id", F.coalesce("error_type", F.lit("none")).alias("error_type"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    per = (
        failed.join(functions.select(F.col("id").alias("function_id"), "language"), "function_id")
        .groupBy("language", "error_type")
        .agg(F.sum("n").alias("failures"))
    )
    total = F.sum("failures").over(Window.partitionBy("language"))
    return per.withColumn("pct", F.col("failures") / total * 100)


def beside(rows: DataFrame, **totals: Column) -> DataFrame:
    """``rows``, written out, with totals over all of them on each: a one-row join."""
    kept = cut_lineage(rows)
    return kept.join(F.broadcast(kept.agg(*[v.alias(k) for k, v in totals.items()])))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way analysis of variance: F, degrees of freedom, eta squared, p-value."""
    cells = (
        df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
        .groupBy(group)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(value).alias("m"),
            (F.var_pop(value) * F.count(F.lit(1))).alias("within"),
        )
    )
    # One row per group from here on.
    grand = F.try_divide(F.sum(F.col("n") * F.col("m")), F.sum("n"))
    parts = beside(cells, grand=grand).withColumn("between", F.col("n") * F.pow(F.col("m") - F.col("grand"), F.lit(2)))
    sums = parts.agg(
        F.sum("between").alias("ss_between"),
        F.sum("within").alias("ss_within"),
        (F.count(F.lit(1)) - 1).alias("df_between"),
        (F.sum("n") - F.count(F.lit(1))).alias("df_within"),
    )
    return sums.select(
        "df_between",
        "df_within",
        F.try_divide(
            F.try_divide(F.col("ss_between"), F.col("df_between")),
            F.try_divide(F.col("ss_within"), F.col("df_within")),
        ).alias("f_statistic"),
        F.try_divide(F.col("ss_between"), F.col("ss_between") + F.col("ss_within")).alias("eta_squared"),
    ).withColumn("p_value", f_tail(F.col("f_statistic"), F.col("df_between"), F.col("df_within")))


def paired_differences(
    facts: DataFrame,
    baseline: str = "zero_shot",
    key: Sequence[str] = ("function_id", "model", "task"),
    strategies: Sequence[str] = STRATEGIES,
) -> DataFrame:
    """Score of each strategy minus the baseline's on the same key.

    All strategies of a key sit in one aggregated row, so nothing is joined to itself.
    """
    others = [s for s in strategies if s != baseline]

    def mean_of(strategy: str) -> Column:
        return F.avg(F.when(F.col("strategy") == strategy, F.col("se_score")))

    wide = (
        facts.filter(F.col("se_score").isNotNull() & F.col("strategy").isin(*strategies))
        .groupBy(*key)
        .agg(mean_of(baseline).alias("__base"), *[mean_of(s).alias(f"__{s}") for s in others])
        .filter(F.col("__base").isNotNull())
    )
    pairs = F.array(
        *[
            F.struct(F.lit(s).alias("strategy"), (F.col(f"__{s}") - F.col("__base")).alias("diff"))
            for s in others
        ]
    )
    return (
        wide.select(*key, F.explode(pairs).alias("p"))
        .select(*key, "p.strategy", "p.diff")
        .filter(F.col("diff").isNotNull())
    )


def paired_t(differences: DataFrame) -> DataFrame:
    """Mean difference, paired t statistic and p-values per strategy; ``p_bonferroni`` is
    corrected for the number of strategies compared."""
    d = differences.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("diff").alias("mean_diff"),
        F.stddev_samp("diff").alias("sd"),
    )
    tested = d.select(
        "strategy",
        "n",
        "mean_diff",
        F.try_divide(F.col("mean_diff"), F.col("sd") / F.sqrt("n")).alias("t_statistic"),
    ).withColumn("p_value", t_two_sided(F.col("t_statistic"), F.col("n") - 1))
    corrected = F.least(F.col("p_value") * F.col("comparisons"), F.lit(1.0))
    return (
        beside(tested, comparisons=F.count(F.lit(1)))
        .withColumn("p_bonferroni", F.when(F.col("p_value").isNotNull(), corrected))
        .drop("comparisons")
    )


def cohens_d(facts: DataFrame, baseline: str = "zero_shot") -> DataFrame:
    """Effect size of each strategy against the baseline, pooled deviation."""
    m = (
        facts.filter(F.col("se_score").isNotNull())
        .groupBy("strategy")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("se_score").alias("mean"),
            F.var_samp("se_score").alias("var"),
        )
    )
    # One row per strategy from here on; the baseline's numbers ride along.
    is_base = F.col("strategy") == baseline
    base = {k: F.max(F.when(is_base, F.col(c))) for k, c in (("n0", "n"), ("m0", "mean"), ("v0", "var"))}
    both = beside(m, **base).filter(~is_base)
    pooled = F.sqrt(
        ((F.col("n") - 1) * F.col("var") + (F.col("n0") - 1) * F.col("v0"))
        / (F.col("n") + F.col("n0") - 2)
    )
    return both.select(
        "strategy", "n", "mean", F.try_divide(F.col("mean") - F.col("m0"), pooled).alias("cohens_d")
    )


def _ranked_groups(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, rank_sum) rows plus one row without a group that carries the tie term.

    Ranks are average ranks over the whole table. Rows are counted per (value, group)
    first and ranked per distinct value.
    """
    counts = (
        df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
        .groupBy(value, group)
        .agg(F.count(F.lit(1)).alias("c"))
    )
    per_value = counts.groupBy(value).agg(F.sum("c").alias("n"))
    ranked = running_total(per_value, "n", [value], "below").select(
        value,
        (F.col("below") + (F.col("n") + 1) / 2).alias("rank"),
        (F.pow(F.col("n"), F.lit(3)) - F.col("n")).alias("t"),
    )
    sums = (
        counts.join(ranked, value)
        .groupBy(group)
        .agg(F.sum("c").alias("n"), F.sum(F.col("rank") * F.col("c")).alias("rank_sum"))
        .withColumn("ties", F.lit(0.0))
    )
    ties = ranked.agg(F.sum("t").alias("ties"))
    return sums.unionByName(ties, allowMissingColumns=True)


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """H statistic, corrected for ties, and its p-value."""
    sums = _ranked_groups(df, group, value).agg(
        F.sum("n").alias("rows"),
        F.sum(F.pow("rank_sum", F.lit(2)) / F.col("n")).alias("q"),
        F.sum("ties").alias("ties"),
        (F.count(group) - 1).alias("df"),
    )
    n = F.col("rows").cast("double")
    h = F.lit(12.0) / (n * (n + 1)) * F.col("q") - 3 * (n + 1)
    return sums.select(
        F.col("rows").alias("n"),
        "df",
        F.try_divide(h, 1 - F.col("ties") / (F.pow(n, F.lit(3)) - n)).alias("h_statistic"),
    ).withColumn("p_value", chi_square_tail(F.col("h_statistic"), F.col("df")))


def mann_whitney(df: DataFrame, group: str, value: str, first: str, second: str) -> DataFrame:
    """U statistics of two groups; two-sided p-value by the normal approximation, corrected
    for ties and continuity."""
    pair = df.filter(F.col(group).isin(first, second))
    r = _ranked_groups(pair, group, value).agg(
        *[
            F.coalesce(F.sum(F.when(F.col(group) == g, F.col(c).cast("double"))), F.lit(0.0)).alias(f"{c}{i}")
            for i, g in enumerate((first, second), 1)
            for c in ("n", "rank_sum")
        ],
        F.sum("ties").alias("ties"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    u1 = F.col("rank_sum1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    away = F.greatest(F.abs(u1 - n1 * n2 / 2) - 0.5, F.lit(0.0))
    return r.select(
        n1.cast("bigint").alias("n1"),
        n2.cast("bigint").alias("n2"),
        u1.alias("u1"),
        (n1 * n2 - u1).alias("u2"),
        normal_two_sided(F.try_divide(away, spread)).alias("p_value"),
    )


def levene(df: DataFrame, group: str, value: str) -> DataFrame:
    """Homogeneity of variance: analysis of variance over distances from the group median."""
    rows = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).select(group, value)
    medians = quantiles(rows, [group], value, {"__median": 0.5})
    # One row per group; Spark broadcasts it when it is small, which it is for labels.
    spread = rows.join(medians, group).withColumn("__dist", F.abs(F.col(value) - F.col("__median")))
    return anova(spread, group, "__dist").select(
        "df_between", "df_within", F.col("f_statistic").alias("w_statistic"), "p_value"
    )


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson's r and the two-sided p-value of no correlation."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    found = df.filter(both).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("pearson_r"))
    r, free = F.col("pearson_r"), F.col("n") - 2
    t = r * F.sqrt(F.try_divide(free.cast("double"), 1 - r * r))
    perfect = (F.abs(r) >= 1) & (free > 0)
    return found.withColumn("p_value", F.when(perfect, F.lit(0.0)).otherwise(t_two_sided(t, free)))


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return df.filter(a.isNotNull() & b.isNotNull()).agg(
        F.regr_slope(b, a).alias("slope"),
        F.regr_intercept(b, a).alias("intercept"),
        F.regr_r2(b, a).alias("r2"),
    )


def multiple_fit(df: DataFrame, predictors: Sequence[str], y: str) -> DataFrame:
    """Least squares on several predictors by distributed normal equations.

    Returns (term, coefficient) rows and an ``r2`` row; what reaches the driver is the
    coefficient vector.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = df.select(*[F.col(c).cast("double").alias(c) for c in (*predictors, y)]).dropna()
    features = VectorAssembler(inputCols=list(predictors), outputCol="features").transform(rows)
    fit = LinearRegression(labelCol=y, solver="normal", standardization=True).fit(features)
    out = [(p, float(c)) for p, c in zip(predictors, fit.coefficients, strict=True)]
    out += [("intercept", float(fit.intercept)), ("r2", float(fit.summary.r2))]
    return literal_rows(df.sparkSession, out, "term string, coefficient double")


def quadratic_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    squared = df.select(F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))
    return multiple_fit(squared.withColumn(f"{x}_squared", F.col(x) * F.col(x)), [x, f"{x}_squared"], y)


#: Moments of the rows on one side of a split.
_MOMENTS = ("n", "sx", "sy", "sxx", "sxy", "syy")


def split_error(side: str) -> Column:
    """Squared error of the line through the rows of one side, from its moment columns."""
    n, sx, sy, sxx, sxy, syy = (F.col(f"{side}_{k}") for k in _MOMENTS)
    rows = F.nullif(n, F.lit(0.0))
    sxx = sxx - sx * sx / rows
    sxy = sxy - sx * sy / rows
    return syy - sy * sy / rows - F.when(sxx > 0, sxy * sxy / F.nullif(sxx, F.lit(0.0))).otherwise(0.0)


def piecewise_fit(df: DataFrame, x: str, y: str, min_rows: int = 3) -> DataFrame:
    """Breakpoint that minimises the squared error of two separate lines.

    Rows are reduced to moments per distinct ``x`` first, so a candidate split is a prefix of
    moments, summed by range; of the totals there is one row.
    """
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    moments = {
        "n": F.count(F.lit(1)).cast("double"), "sx": F.sum(a), "sy": F.sum(b),
        "sxx": F.sum(a * a), "sxy": F.sum(a * b), "syy": F.sum(b * b),
    }
    per_x = df.filter(a.isNotNull() & b.isNotNull()).groupBy(a.alias("breakpoint")).agg(
        *[m.alias(k) for k, m in moments.items()]
    )
    upto = running_totals(per_x, {k: f"b_{k}" for k in moments}, ["breakpoint"])
    left = upto.select("breakpoint", *[(F.col(f"b_{k}") + F.col(k)).alias(f"l_{k}") for k in moments])
    # The sums up to the largest ``x`` are those of all rows.
    total = left.agg(*[F.max_by(f"l_{k}", "breakpoint").alias(k) for k in moments]).first()
    sides = left.select(
        "*", *[(F.lit(total[k]).cast("double") - F.col(f"l_{k}")).alias(f"r_{k}") for k in moments]
    )

    return (
        sides.filter((F.col("l_n") >= min_rows) & (F.col("r_n") >= min_rows))
        .select(
            "breakpoint",
            (split_error("l") + split_error("r")).alias("sse"),
            F.col("l_n").cast("bigint").alias("rows_left"),
            F.col("r_n").cast("bigint").alias("rows_right"),
        )
        .orderBy("sse", "breakpoint")
        .limit(1)
    )


def chi_square(counts: DataFrame, group: str, targets: dict[str, float]) -> DataFrame:
    """Goodness of fit of the counts per group against target shares."""
    total = sum(targets.values())
    shares = literal_rows(
        counts.sparkSession,
        [(k, v / total) for k, v in targets.items()], f"{group} string, share double"
    )
    observed = counts.groupBy(group).agg(F.count(F.lit(1)).alias("o"))
    cells = shares.join(observed, group, "left").withColumn("o", F.coalesce("o", F.lit(0)))
    expected = beside(cells, total=F.sum("o")).withColumn("e", F.col("share") * F.col("total"))
    return expected.agg(
        F.sum(F.pow(F.col("o") - F.col("e"), F.lit(2)) / F.nullif("e", F.lit(0.0))).alias("chi_square"),
        (F.count(F.lit(1)) - 1).alias("df"),
    ).withColumn("p_value", chi_square_tail(F.col("chi_square"), F.col("df")))


def cell_means(facts: DataFrame, first: str, second: str, value: str = "se_score") -> DataFrame:
    """Two-way table of means with row, column and interaction effect."""
    cells = (
        facts.filter(F.col(value).isNotNull())
        .groupBy(first, second)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    )

    def margin(by: str) -> Column:
        w = Window.partitionBy(by)
        return F.sum(F.col("mean") * F.col("n")).over(w) / F.sum("n").over(w)

    both = beside(cells, grand=F.try_divide(F.sum(F.col("mean") * F.col("n")), F.sum("n")))
    return both.withColumn(
        "interaction", F.col("mean") - margin(first) - margin(second) + F.col("grand")
    ).drop("grand")


def model_ranks(facts: DataFrame) -> DataFrame:
    """Average rank of each model's mean score per task, best first."""
    means = (
        facts.filter(F.col("se_score").isNotNull())
        .groupBy("task", "model")
        .agg(F.avg("se_score").alias("mean_se"))
    )
    by_score = Window.partitionBy("task").orderBy(F.desc("mean_se"))
    ties = Window.partitionBy("task", "mean_se")
    return means.withColumn(
        "rank", F.rank().over(by_score) + (F.count(F.lit(1)).over(ties) - 1) / 2
    )


def rank_agreement(ranks: DataFrame) -> DataFrame:
    """Spearman correlation of the model ranking for every pair of tasks."""
    # One row per (task, model); a model's tasks are paired inside its own row.
    per_model = ranks.groupBy("model").agg(F.sort_array(F.collect_list(F.struct("task", "rank"))).alias("tasks"))
    pairs = per_model.select("model", F.posexplode("tasks").alias("at", "a"), "tasks").select(
        F.explode(F.slice("tasks", F.col("at") + 2, F.size("tasks"))).alias("b"), "a"
    )
    return (
        pairs.select(
            F.col("a.task").alias("task_a"), F.col("a.rank").alias("rank_a"),
            F.col("b.task").alias("task_b"), F.col("b.rank").alias("rank_b"),
        )
        .groupBy("task_a", "task_b")
        .agg(F.count(F.lit(1)).alias("models"), F.corr("rank_a", "rank_b").alias("spearman"))
    )


def tasks_in_languages(functions: DataFrame, minimum: int = 4) -> DataFrame:
    """Functions whose task exists in at least ``minimum`` languages."""
    wide = (
        functions.groupBy("task_name")
        .agg(F.count_distinct("language").alias("n"))
        .filter(F.col("n") >= minimum)
        .select("task_name")
    )
    return functions.join(wide, "task_name", "left_semi")
