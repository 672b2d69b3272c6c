"""Tail probabilities and fitted models against exact values and plain least squares."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from refracta.functions import distributions as D
from refracta.operators import inference, stats


def tails(spark, rows, schema, p):
    return [r["p"] for r in spark.createDataFrame(rows, schema).select(p.alias("p")).collect()]


def test_incomplete_beta_is_exact_for_whole_parameters(spark):
    rows = [(a, b, x) for a in (1, 3, 10, 100) for b in (1, 3, 40) for x in (1e-6, 0.01, 0.3, 0.5, 0.9, 0.9999)]
    p = D.incomplete_beta(F.col("a"), F.col("b"), F.col("x"), 1 - F.col("x"))
    for (a, b, x), got in zip(rows, tails(spark, rows, "a int, b int, x double", p)):
        n, share = a + b - 1, Fraction(x)
        exact = sum(math.comb(n, j) * share**j * (1 - share) ** (n - j) for j in range(a, n + 1))
        assert got == pytest.approx(float(exact), abs=1e-12)


# Critical values of printed tables, statistic, degrees of freedom, probability.
TABLED_T = [(12.706204736432095, 1, 0.05), (2.2281388519649385, 10, 0.05), (2.750, 30, 0.01), (3.2906, 10**7, 0.001)]
TABLED_F = [(4.066180551, 3, 8, 0.05), (3.098391212, 3, 20, 0.05), (161.4476388, 1, 1, 0.05)]
TABLED_CHI = [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (18.307038053275146, 10, 0.05), (124.342113404, 100, 0.05)]


def test_tabled_tails(spark):
    t = tails(spark, [r[:2] for r in TABLED_T], "t double, d long", D.t_two_sided(F.col("t"), F.col("d")))
    assert t[:2] == pytest.approx([0.05, 0.05], abs=1e-9) and t[2:] == pytest.approx([0.01, 0.001], rel=1e-3)
    f = tails(spark, [r[:3] for r in TABLED_F], "f double, a int, b int", D.f_tail(F.col("f"), F.col("a"), F.col("b")))
    assert f == pytest.approx([0.05] * 3, abs=1e-9)
    chi = tails(spark, [r[:2] for r in TABLED_CHI], "x double, d int", D.chi_square_tail(F.col("x"), F.col("d")))
    assert chi == pytest.approx([0.05] * 4, abs=1e-9)
    z = tails(spark, [(1.959963984540054,), (0.0,), (8.0,)], "z double", D.normal_two_sided(F.col("z")))
    assert z == pytest.approx([0.05, 1.0, math.erfc(8 / math.sqrt(2))], rel=1e-9)


def test_tails_far_out_and_of_nothing(spark):
    nan = float("nan")
    rows = [(None, 3), (nan, 3), (1.0, 0), (1.0, None), (0.0, 4), (4000.0, 4)]
    assert tails(spark, rows, "x double, d int", D.chi_square_tail(F.col("x"), F.col("d"))) == [None, None, None, None, 1.0, 0.0]
    x = [0.1, 3.0, 40.0, 300.0]
    got = tails(spark, [(v,) for v in x], "x double", D.chi_square_tail(F.col("x"), F.lit(4)))
    assert got == pytest.approx([math.exp(-v / 2) * (1 + v / 2) for v in x], rel=1e-12)
    lg = tails(spark, [(v,) for v in (0.5, 1.0, 7.3, 15.0, 1e6)], "x double", D.log_gamma(F.col("x")))
    assert lg == pytest.approx([math.lgamma(v) for v in (0.5, 1.0, 7.3, 15.0, 1e6)], rel=1e-13, abs=1e-13)


def test_tests_have_p_values(spark):
    rows = [("a", x) for x in (1.0, 2.0, 3.0)] + [("b", x) for x in (2.0, 4.0, 6.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    # with two groups F is t squared; t on 4 degrees of freedom has a closed form
    t = math.sqrt(2.4)
    w = t / math.sqrt(4 + t * t)
    assert stats.anova(df, "g", "x").first()["p_value"] == pytest.approx(1 - w * (1 + (1 - w * w) / 2), abs=1e-12)
    h = stats.kruskal_wallis(df, "g", "x").first()
    assert h["p_value"] == pytest.approx(math.erfc(math.sqrt(h["h_statistic"] / 2)), abs=1e-12)
    u = stats.mann_whitney(df, "g", "x", "a", "b").first()
    z = (abs(u["u1"] - 4.5) - 0.5) / math.sqrt(9 / 12 * (7 - 6 / 30))
    assert u["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-12)
    line = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "x double, y double")
    assert stats.correlation(line, "x", "y").first()["p_value"] == pytest.approx(0.0, abs=1e-7)
    assert stats.anova(df.limit(0), "g", "x").first()["p_value"] is None
    assert stats.correlation(line.limit(0), "x", "y").first()["p_value"] is None


def test_bonferroni_counts_the_comparisons(spark):
    rng = random.Random(4)
    rows = [(f"s{k}", rng.gauss(0.2 * k, 1)) for k in range(3) for _ in range(30)] + [("alone", 1.0)]
    got = {r["strategy"]: r for r in stats.paired_t(spark.createDataFrame(rows, "strategy string, diff double")).collect()}
    assert got["alone"]["p_value"] is None and got["alone"]["p_bonferroni"] is None
    for k in range(3):
        r = got[f"s{k}"]
        assert r["p_bonferroni"] == pytest.approx(min(1.0, 4 * r["p_value"]))


def least_squares_error(columns, y):
    x = np.column_stack(columns)
    fit = np.linalg.lstsq(x, y, rcond=None)[0]
    return float(((y - x @ fit) ** 2).sum()), int(np.linalg.matrix_rank(x))


def indicators(keys):
    return [np.array([k == v for k in keys], float) for v in sorted(set(keys))]


@pytest.mark.parametrize("repeated", [False, True])
def test_two_way_anova_matches_nested_least_squares(spark, repeated):
    rng = random.Random(11)
    rows = []
    for i in range(180):
        a, b, s = rng.choice("pqr"), rng.choice("wxyz"), f"f{rng.randrange(12)}"
        if (a, b) != ("p", "w"):  # an empty cell
            rows.append((a, b, s, "pqr".index(a) * 1.5 + "wxyz".index(b) + int(s[1:]) * 0.7 + rng.gauss(0, 1)))
    awkward = [(None, "w", "f1", 1.0), ("p", None, "f1", 1.0), ("p", "x", "f1", None)]
    df = spark.createDataFrame(rows + awkward, "a string, b string, s string, y double")
    got = {r["term"]: r for r in inference.two_way_anova(df, "a", "b", "y", ["s"] if repeated else []).collect()}
    a, b, s, y = ([r[k] for r in rows] for k in range(4))
    y = np.array(y)
    base = indicators(s) if repeated else [np.ones(len(y))]
    cells = indicators([f"{p}{q}" for p, q in zip(a, b)])
    errors = [least_squares_error(c, y) for c in (base, base + indicators(a), base + indicators(a) + indicators(b), base + cells)]
    left = len(y) - errors[-1][1]
    for term, (before, r0), (after, r1) in zip(("a", "b", "a:b"), errors, errors[1:]):
        f = (before - after) / (r1 - r0) / (errors[-1][0] / left)
        assert got[term]["df"] == r1 - r0
        assert got[term]["ss"] == pytest.approx(before - after, rel=1e-8)
        assert got[term]["f_statistic"] == pytest.approx(f, rel=1e-8)
    assert (got["residual"]["df"], got["residual"]["p_value"]) == (left, None)
    for term in ("a", "b", "a:b"):
        f = [(got[term]["f_statistic"], got[term]["df"], left)]
        tail = tails(spark, f, "f double, a long, b long", D.f_tail(F.col("f"), F.col("a"), F.col("b")))
        assert [got[term]["p_value"]] == pytest.approx(tail, rel=1e-9)
    assert got["a"]["p_value"] < 0.001 < got["a:b"]["p_value"]


def test_two_way_anova_of_little(spark):
    df = spark.createDataFrame([("p", "w", 1.0)], "a string, b string, y double")
    assert [(r["df"], r["ss"], r["p_value"]) for r in inference.two_way_anova(df, "a", "b", "y").collect()] == [(0, 0.0, None)] * 4
    assert [r["df"] for r in inference.two_way_anova(df.limit(0), "a", "b", "y").collect()] == [0] * 4


def test_logistic_fit_solves_its_score_equations(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(600):
        g, x = rng.choice("abc"), rng.randrange(20)
        p = 1 / (1 + math.exp(-(0.15 * x - 1 + {"a": 0, "b": 1, "c": -0.5}[g])))
        rows.append((int(rng.random() < p), g, float(x)))
    df = spark.createDataFrame(rows + [(None, "a", 1.0), (1, None, 1.0), (1, "a", None)], "p int, g string, x double")
    fit = {r["term"]: r for r in inference.logistic_fit(df, "p", ["x"], "g").collect()}
    assert set(fit) == {"x", "g=b", "g=c", "intercept"}
    design = np.array([[x, g == "b", g == "c", 1.0] for _, g, x in rows], float)
    at = np.array([fit[t]["coefficient"] for t in ("x", "g=b", "g=c", "intercept")])
    p = 1 / (1 + np.exp(-design @ at))
    assert np.abs(design.T @ (np.array([r[0] for r in rows]) - p)).max() < 1e-7
    errors = np.sqrt(np.diag(np.linalg.inv(design.T @ (design * (p * (1 - p))[:, None]))))
    assert [fit[t]["std_error"] for t in ("x", "g=b", "g=c", "intercept")] == pytest.approx(errors.tolist(), rel=1e-6)
    z = fit["x"]["coefficient"] / fit["x"]["std_error"]
    assert fit["x"]["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-9)


def test_logistic_fit_of_separated_and_no_rows(spark):
    rows = spark.createDataFrame([(int(i >= 10), "a", float(i)) for i in range(20)], "p int, g string, x double")
    fit = {r["term"]: r["coefficient"] for r in inference.logistic_fit(rows, "p", ["x"], "g").collect()}
    assert fit["x"] > 1 and math.isfinite(fit["intercept"])
    assert inference.logistic_fit(rows.limit(0), "p", ["x"], "g").collect() == []
    with pytest.raises(ValueError):
        inference.logistic_fit(rows.withColumn("g", F.col("x").cast("string")), "p", [], "g", most_levels=5)


def test_breakpoint_interval_holds_a_known_break(spark):
    rng = random.Random(8)
    rows = [(f"f{i % 300}", float(x), (x if x <= 12 else 24 - x) + rng.gauss(0, 1.0)) for i, x in enumerate(rng.choices(range(25), k=3000))]
    df = spark.createDataFrame(rows + [("f", None, 1.0), ("f", 1.0, None), (None, 3.0, 3.0)], "u string, x double, y double")
    first = inference.breakpoint_interval(df, "x", "y", ["u"]).collect()
    (r,) = first
    assert 11 <= r["lower"] <= r["breakpoint"] <= r["upper"] <= 13 and r["replicates"] == 200
    assert inference.breakpoint_interval(df.repartition(5), "x", "y", ["u"]).collect() == first
    assert inference.breakpoint_interval(df.limit(0), "x", "y", ["u"]).collect() == []


def test_poisson_weights_have_mean_and_variance_one(spark):
    w = spark.range(20000).select(inference.poisson_weight(F.col("id"), F.lit("x")).alias("w"))
    r = w.agg(F.avg("w").alias("m"), F.var_pop("w").alias("v"), F.max("w").alias("most")).first()
    assert abs(r["m"] - 1) < 0.03 and abs(r["v"] - 1) < 0.05 and 6 <= r["most"] <= 9
