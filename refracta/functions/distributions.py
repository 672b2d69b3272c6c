"""Tail probabilities of the usual test statistics as column expressions.

The incomplete beta and gamma functions are evaluated by continued fraction or power series,
as an aggregate over a sequence of steps whose length follows from the parameters. Meant for
the few rows that hold test results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from refracta.functions.text import let

#: Coefficients of Stirling's series, of x ** -1, x ** -3, and so on.
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)
#: From here on the series above is exact to rounding.
_LARGE = 15
_TINY = 1e-300


def _stirling_rest(x: Column) -> Column:
    """What log gamma is above (x - 1/2) ln x - x + ln(2 pi) / 2."""

    def rest(at: Column) -> Column:
        # below _LARGE, the logarithm of x (x + 1) ... carries the argument up to where the series holds
        steps = F.sequence(F.lit(0), F.lit(_LARGE - 1))
        product = F.aggregate(steps, F.lit(0.0), lambda total, k: total + F.log(at + k))
        moved = (at + (_LARGE - 0.5)) * F.log(at + _LARGE) - product - (at - 0.5) * F.log(at) - F.lit(float(_LARGE))
        small = at < _LARGE
        return _series(F.when(small, at + _LARGE).otherwise(at)) + F.when(small, moved).otherwise(0.0)

    return let(x.cast("double"), rest)


def _series(x: Column) -> Column:
    coefficients = F.lit(list(reversed(_STIRLING)))

    def horner(inverse: Column) -> Column:
        return F.aggregate(coefficients, F.lit(0.0), lambda total, c: total * inverse * inverse + c) * inverse

    return let(1 / x, horner)


def log_gamma(x: Column) -> Column:
    """Natural logarithm of the gamma function, x > 0."""
    return let(
        x.cast("double"),
        lambda at: (at - 0.5) * F.log(at) - at + F.lit(0.5 * math.log(2 * math.pi)) + _stirling_rest(at),
    )


def _nonzero(x: Column) -> Column:
    return F.when(F.abs(x) < _TINY, F.lit(_TINY)).otherwise(x)


def _steps(size: Column) -> Column:
    """Step numbers from 1; convergence takes some multiple of the root of the parameters."""
    return F.sequence(F.lit(1), (F.lit(120) + F.sqrt(size) * 6).cast("int"))


def _log_power(x: Column, mean: Column) -> Column:
    """ln(x / mean), 0 powers aside: x = 0 gives a factor of 0."""
    return F.log(F.greatest(x, F.lit(_TINY)) / mean)


def _beta_fraction(a: Column, b: Column, x: Column, y: Column) -> Column:
    """I_x(a, b) left of the mean by the modified Lentz method; y is 1 - x."""
    n = a + b
    rests = F.transform(F.array(n, a, b), _stirling_rest)
    scale = (
        a * _log_power(x, a / n)
        + b * _log_power(y, b / n)
        + F.log(a * b / n) / 2
        - F.lit(0.5 * math.log(2 * math.pi))
        + let(rests, lambda r: r[0] - r[1] - r[2])
    )

    def advanced(state: Column, term: Column) -> Column:
        d = 1 / _nonzero(1 + term * state["d"])
        c = _nonzero(1 + term / state["c"])
        return let(
            F.struct(c.alias("c"), d.alias("d")),
            lambda s: F.struct(s["c"].alias("c"), s["d"].alias("d"), (state["h"] * s["c"] * s["d"]).alias("h")),
        )

    def step(state: Column, k: Column) -> Column:
        # even terms m (b - m) x / ..., odd ones -(a + m) (a + b + m) x / ..., m counting both
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (n + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return advanced(state, F.when(k % 2 == 0, even).otherwise(odd))

    start = F.struct(F.lit(1 / _TINY).alias("c"), F.lit(1.0).alias("d"), F.lit(1.0).alias("h"))
    # the first odd term is that of m = 0
    fraction = F.aggregate(_steps(F.greatest(a, b) * 4), start, step)["h"]
    return F.when(x <= 0, 0.0).otherwise(F.exp(scale) * fraction / a)


def incomplete_beta(a: Column, b: Column, x: Column, y: Column) -> Column:
    """Regularised I_x(a, b) for 0 <= x <= 1, with y = 1 - x given by the caller, who can
    compute it without loss when x is close to 1."""

    def turned(p: Column) -> Column:
        left = p["x"] < (p["a"] + 1) / (p["a"] + p["b"] + 2)
        other = {"a": "b", "b": "a", "x": "y", "y": "x"}
        sides = [F.when(left, p[k]).otherwise(p[o]).alias(k) for k, o in other.items()]
        return let(F.struct(*sides, left.alias("left")), of)

    def of(p: Column) -> Column:
        value = _beta_fraction(p["a"], p["b"], p["x"], p["y"])
        return let(value, lambda v: F.when(p["left"], v).otherwise(1 - v))

    named = {"a": a, "b": b, "x": x, "y": y}
    return let(F.struct(*[v.cast("double").alias(k) for k, v in named.items()]), turned)


def upper_gamma(a: Column, x: Column) -> Column:
    """Regularised Q(a, x) for x >= 0: a power series left of the mean, else a fraction."""

    def of(p: Column) -> Column:
        k, at = p["a"], p["x"]
        scale = F.exp(
            k * _log_power(at, k) + k - at + F.log(k) / 2 - F.lit(0.5 * math.log(2 * math.pi)) - _stirling_rest(k)
        )

        def term(state: Column, i: Column) -> Column:
            grown = state["term"] * at / (k + i)
            return F.struct(grown.alias("term"), (state["sum"] + grown).alias("sum"))

        first = F.struct((1 / k).alias("term"), (1 / k).alias("sum"))
        series = F.aggregate(_steps(k), first, term)["sum"]

        def step(state: Column, i: Column) -> Column:
            m = i.cast("double")
            numerator, base = -m * (m - k), at + 2 * m + 1 - k
            d = 1 / _nonzero(numerator * state["d"] + base)
            c = _nonzero(base + numerator / state["c"])
            return F.struct(c.alias("c"), d.alias("d"), (state["h"] * c * d).alias("h"))

        d = 1 / _nonzero(at + 1 - k)
        start = F.struct(F.lit(1 / _TINY).alias("c"), d.alias("d"), d.alias("h"))
        fraction = F.aggregate(_steps(k), start, step)["h"]
        return (
            F.when(at <= 0, 1.0).when(at < k + 1, 1 - scale * series).otherwise(scale * fraction)
        )

    return let(F.struct(a.cast("double").alias("a"), x.cast("double").alias("x")), of)


def _defined(p: Column, *needed: Column) -> Column:
    """NULL where a statistic is NULL or not a number, or has no degrees of freedom left."""
    ok = F.lit(True)
    for n in needed:
        ok &= n.isNotNull() & ~F.isnan(n.cast("double"))
    return F.when(ok, F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def f_tail(f: Column, df1: Column, df2: Column) -> Column:
    """P(F >= f) with df1 and df2 degrees of freedom."""
    f, df1, df2 = (c.cast("double") for c in (f, df1, df2))
    total = df2 + df1 * f
    p = incomplete_beta(df2 / 2, df1 / 2, df2 / total, df1 * f / total)
    return F.when((df1 > 0) & (df2 > 0), _defined(p, f, df1, df2))


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) with df degrees of freedom."""
    return f_tail(t * t, F.lit(1.0), df)


def chi_square_tail(x: Column, df: Column) -> Column:
    """P(X >= x) with df degrees of freedom."""
    p = upper_gamma(df.cast("double") / 2, x.cast("double") / 2)
    return F.when(df > 0, _defined(p, x, df))


def normal_two_sided(z: Column) -> Column:
    """P(|Z| >= |z|)."""
    return _defined(upper_gamma(F.lit(0.5), z * z / 2), z)
