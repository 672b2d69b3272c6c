"""Models of scores with their tests: analysis of variance with two factors (and repeated
measures), logistic regression with standard errors, the interval of a breakpoint.

Rows are reduced to a table of a few labels first; only matrices as wide as the labels are
solved on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refracta.functions.distributions import f_tail, normal_two_sided
from refracta.operators.stats import piecewise_fit, split_error
from refracta.session import cut_lineage, literal_rows

#: Cells (level x level) that the matrix of a two-way analysis may have.
MOST_CELLS = 2000


def _gram(cells: DataFrame, subject: Sequence[str]) -> tuple[list[tuple], np.ndarray, np.ndarray, float, int, int]:
    """Cells, the matrix of their indicators centred within subjects, its products with the
    values, the sum of squares within subjects, and how many rows and subjects there are."""
    cell = F.struct("a", "b")
    per_subject = cells.groupBy(*subject).agg(
        F.collect_list(F.struct(cell.alias("cell"), "n", "s")).alias("cells"),
        F.sum("n").alias("rows"),
        F.sum("s").alias("total"),
        F.sum("q").alias("squares"),
    )
    kept = cut_lineage(per_subject)
    sums = kept.agg(
        F.sum(F.col("squares") - F.col("total") * F.col("total") / F.col("rows")),
        F.sum("rows"),
        F.count(F.lit(1)),
    ).first()
    left = kept.select(F.explode("cells").alias("x"), "cells", "rows", "total")
    products = (
        left.select("x", F.explode("cells").alias("y"), "rows")
        .select(
            F.col("x.cell").alias("x"),
            F.col("y.cell").alias("y"),
            (
                F.when(F.col("x.cell") == F.col("y.cell"), F.col("x.n").cast("double")).otherwise(0.0)
                - F.col("x.n") * F.col("y.n") / F.col("rows")
            ).alias("g"),
        )
        .groupBy("x", "y")
        .agg(F.sum("g").alias("g"))
    )
    values = left.groupBy(F.col("x.cell").alias("x")).agg(
        F.sum(F.col("x.s") - F.col("x.n") * F.col("total") / F.col("rows")).alias("b")
    )
    found = values.limit(MOST_CELLS + 1).collect()  # one row per cell
    if len(found) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells: the factors have to be labels")
    names = sorted(tuple(r["x"]) for r in found)
    place = {c: i for i, c in enumerate(names)}
    gram, products_with = np.zeros((len(names), len(names))), np.zeros(len(names))
    for r in found:
        products_with[place[tuple(r["x"])]] = r["b"]
    for r in products.collect():  # cells squared
        gram[place[tuple(r["x"])], place[tuple(r["y"])]] = r["g"]
    return names, gram, products_with, float(sums[0] or 0.0), int(sums[1] or 0), int(sums[2])


def _swept(matrix: np.ndarray, blocks: Sequence[Sequence[int]]) -> list[tuple[int, float]]:
    """Degrees of freedom and sum of squares that each block of columns adds, in order; the
    values are the last column. Columns that depend on earlier ones add nothing."""
    m, first = matrix.copy(), np.diag(matrix).copy()
    out = []
    for block in blocks:
        before, rank = m[-1, -1], 0
        for k in block:
            if m[k, k] > 1e-9 * max(first[k], 1e-300):
                m -= np.outer(m[:, k], m[k, :]) / m[k, k]
                rank += 1
            m[k, :] = m[:, k] = 0.0
        out.append((rank, float(before - m[-1, -1])))
    return out


def two_way_anova(
    facts: DataFrame, first: str, second: str, value: str = "se_score", subject: Sequence[str] = ()
) -> DataFrame:
    """Analysis of variance of ``value ~ first + second + first:second``, terms in this order.

    With ``subject`` columns the measures are repeated: differences between subjects are taken
    out first. Cells need not be balanced nor all present; sums of squares are sequential.
    Rows are (term, df, ss, f_statistic, p_value), the last term is ``residual``. One aggregate
    gives a row per subject and cell; of the products of a subject's cells, only the sums over
    subjects are kept. Rows with a NULL value, factor or subject are left out.
    """
    spark = facts.sparkSession
    subjects_by = [f"subject_{i}" for i in range(len(subject))]
    known = facts.select(
        *[F.col(c).alias(name) for c, name in zip(subject, subjects_by)], F.col(first).cast("string").alias("a"), F.col(second).cast("string").alias("b"),
        F.col(value).cast("double").alias("v"),
    )
    cells = known.dropna().groupBy(*subjects_by, "a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")
    )
    names, gram, with_values, within, rows, subjects = _gram(cells, subjects_by)
    columns = [[c for c, name in enumerate(names) if name[k] == level] for k in (0, 1) for level in sorted({n[k] for n in names})]
    columns += [[c] for c in range(len(names))]
    design = np.zeros((len(names), len(columns)))
    for j, members in enumerate(columns):
        design[members, j] = 1.0
    matrix = np.zeros((len(columns) + 1, len(columns) + 1))
    matrix[:-1, :-1] = design.T @ gram @ design
    matrix[:-1, -1] = matrix[-1, :-1] = design.T @ with_values
    matrix[-1, -1] = within
    n_a, n_b = len({n[0] for n in names}), len({n[1] for n in names})
    blocks = (range(n_a), range(n_a, n_a + n_b), range(n_a + n_b, len(columns)))
    found = _swept(matrix, blocks)
    left = rows - subjects - sum(df for df, _ in found)
    residual = max(within - sum(ss for _, ss in found), 0.0)
    terms = (first, second, f"{first}:{second}")
    table = [(t, df, ss) for t, (df, ss) in zip(terms, found)] + [("residual", max(left, 0), residual)]
    out = literal_rows(spark, table, "term string, df bigint, ss double")
    mean_residual = F.lit(residual / left if left > 0 else None).cast("double")
    f = F.when(F.col("term") != "residual", F.try_divide(F.try_divide(F.col("ss"), F.col("df")), mean_residual))
    return out.withColumn("f_statistic", f).withColumn(
        "p_value", f_tail(F.col("f_statistic"), F.col("df"), F.lit(max(left, 0)))
    )


def logistic_fit(
    df: DataFrame, label: str, numeric: Sequence[str], category: str, rounds: int = 50, most_levels: int = 1000
) -> DataFrame:
    """Logistic regression on numeric columns and one category (first value = reference).

    Rows are counted per distinct predictors; every Newton round is one aggregate over these
    counts, with one row per category. Returns (term, coefficient, std_error, z, p_value).
    Where the data do not bound a coefficient, ``rounds`` ends the climb, and the standard error
    tells. Rows with a NULL are left out; more than ``most_levels`` categories are an error.
    """
    numbers = [f"x{i}" for i in range(len(numeric))]
    rows = df.select(
        F.col(label).cast("double").alias("y"),
        F.col(category).cast("string").alias("level"),
        *[F.col(c).cast("double").alias(x) for c, x in zip(numeric, numbers)],
    ).dropna()
    patterns = cut_lineage(
        rows.groupBy("level", *numbers).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("k"))
    )
    levels = sorted(r["level"] for r in patterns.select("level").distinct().limit(most_levels + 1).collect())
    if len(levels) > most_levels:
        raise ValueError(f"{category} has more than {most_levels} values")
    terms = [*numeric, *[f"{category}={v}" for v in levels[1:]], "intercept"]
    schema = "term string, coefficient double, std_error double"
    if not levels:
        return _tested(df.sparkSession.createDataFrame([], schema))
    at = previous = np.zeros(len(terms))
    best = -math.inf
    information = np.eye(len(terms))
    for _round in range(rounds):
        likelihood, gradient, information = _logistic_round(patterns, numbers, levels, at)
        if likelihood < best - 1e-9 * abs(best):
            at = (at + previous) / 2  # the step was too long
            continue
        step = np.linalg.lstsq(information, gradient, rcond=None)[0]
        best, previous, at = likelihood, at, at + step
        if np.abs(step).max() <= 1e-10 * max(1.0, np.abs(at).max()):
            break
    errors = np.sqrt(np.maximum(np.diag(np.linalg.pinv(information)), 0.0))
    fitted = [(t, float(c), float(e)) for t, c, e in zip(terms, at, errors)]
    return _tested(literal_rows(df.sparkSession, fitted, schema))


def _tested(fitted: DataFrame) -> DataFrame:
    z = F.try_divide(F.col("coefficient"), F.col("std_error"))
    return fitted.withColumn("z", z).withColumn("p_value", normal_two_sided(F.col("z")))


def _logistic_round(
    patterns: DataFrame, numbers: Sequence[str], levels: Sequence[str], at: np.ndarray
) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood, gradient and information at the coefficients ``at`` (numeric ones, one
    per level but the first, intercept), from one row of sums per level."""
    m = len(numbers)
    offsets = F.create_map(*[F.lit(x) for k, v in enumerate(levels) for x in (v, float(at[m + k - 1]) if k else 0.0)])
    eta = F.lit(float(at[-1])) + offsets[F.col("level")]
    for x, c in zip(numbers, at):
        eta += F.col(x) * F.lit(float(c))
    p = 1 / (1 + F.exp(-F.col("eta")))
    # ln(1 + e ** eta) without overflow
    log_sum = F.greatest(F.col("eta"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("eta")))
    with_eta = patterns.withColumn("eta", eta).withColumns({"w": F.col("n") * p * (1 - p), "r": F.col("k") - F.col("n") * p})
    every = [F.lit(1.0), *[F.col(x) for x in numbers]]
    pairs = [(i, j) for i in range(m + 1) for j in range(i, m + 1)]
    sums = with_eta.groupBy("level").agg(
        F.sum(F.col("k") * F.col("eta") - F.col("n") * log_sum).alias("likelihood"),
        *[F.sum(F.col("r") * x).alias(f"g{i}") for i, x in enumerate(every)],
        *[F.sum(F.col("w") * every[i] * every[j]).alias(f"h{i}_{j}") for i, j in pairs],
    )
    size = m + len(levels)
    likelihood, gradient, information = 0.0, np.zeros(size), np.zeros((size, size))
    for r in sums.collect():  # one row per level
        k = levels.index(r["level"])
        # the places of the constant: the intercept, and the level's own unless it is the first
        own = [size - 1, *([m + k - 1] if k else [])]
        likelihood += r["likelihood"]
        for i in range(m + 1):
            rows = own if i == 0 else [i - 1]
            gradient[rows] += r[f"g{i}"]
            for j in range(m + 1):
                columns = own if j == 0 else [j - 1]
                information[np.ix_(rows, columns)] += r[f"h{min(i, j)}_{max(i, j)}"]
    return likelihood, gradient, information


#: Cumulative probabilities of a Poisson variable with mean 1, for 0, 1, 2, ...
POISSON = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(9))


def poisson_weight(*key: Column) -> Column:
    """A repeatable Poisson(1) draw by the MD5 of the key."""
    text = F.concat_ws("|", *[k.cast("string") for k in key])
    share = F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("bigint") / F.lit(float(16**12))
    draws = F.lit(0)
    for bound in POISSON:
        draws += F.when(share >= bound, 1).otherwise(0)
    return draws


def breakpoint_interval(
    df: DataFrame,
    x: str,
    y: str,
    unit: Sequence[str],
    replicates: int = 200,
    level: float = 0.95,
    blocks: int = 1024,
    min_rows: int = 3,
) -> DataFrame:
    """Breakpoint of two lines with its bootstrap interval: breakpoint, lower, upper, replicates.

    Units (rows equal in ``unit``) are hashed into ``blocks``, and a replicate weighs each block
    by a Poisson draw, so one aggregate of the rows serves all replicates and reruns agree. The
    bounds are order statistics of the replicates' breakpoints. ``x`` should have few distinct
    values (a complexity, a length in classes): a replicate is that many rows.
    """
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    block = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in unit])
    numbered = F.pmod(F.conv(F.substring(F.md5(block.cast("binary")), 1, 12), 16, 10).cast("bigint"), F.lit(blocks))
    moments = {
        "n": F.count(F.lit(1)).cast("double"), "sx": F.sum(a), "sy": F.sum(b),
        "sxx": F.sum(a * a), "sxy": F.sum(a * b), "syy": F.sum(b * b),
    }
    known = df.filter(a.isNotNull() & b.isNotNull())
    per_block = known.groupBy(a.alias("breakpoint"), numbered.alias("block")).agg(*[m.alias(k) for k, m in moments.items()])
    drawn = (
        per_block.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
        .withColumn("weight", poisson_weight(F.col("block"), F.col("replicate")))
        .filter("weight > 0")
        .groupBy("replicate", "breakpoint")
        .agg(*[F.sum(F.col(k) * F.col("weight")).alias(k) for k in moments])
    )
    whole = Window.partitionBy("replicate")
    upto = whole.orderBy("breakpoint").rowsBetween(Window.unboundedPreceding, 0)
    sides = drawn.select(
        "replicate", "breakpoint",
        *[F.sum(k).over(upto).alias(f"l_{k}") for k in moments],
        *[F.sum(k).over(whole).alias(f"t_{k}") for k in moments],
    )
    sides = sides.select("*", *[(F.col(f"t_{k}") - F.col(f"l_{k}")).alias(f"r_{k}") for k in moments])
    best = (
        sides.filter((F.col("l_n") >= min_rows) & (F.col("r_n") >= min_rows))
        .groupBy("replicate")
        .agg(F.min(F.struct((split_error("l") + split_error("r")).alias("sse"), "breakpoint"))["breakpoint"].alias("at"))
    )
    tail = (1 - level) / 2
    # one value per replicate
    ordered = best.agg(F.sort_array(F.collect_list("at")).alias("at"), F.count(F.lit(1)).alias("replicates"))

    def quantile(q: float) -> Column:
        return F.get("at", F.greatest(F.ceil(F.col("replicates") * F.lit(q)), F.lit(1)).cast("int") - 1)

    point = piecewise_fit(df, x, y, min_rows).select("breakpoint")
    bounds = ordered.select(quantile(tail).alias("lower"), quantile(1 - tail).alias("upper"), "replicates")
    return point.join(F.broadcast(bounds))
