"""Small text expressions shared by the other modules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Unicode-aware string stripping understands it; the JVM's own ``\s``
# and ``trim`` know only a part of it. Single Latin-1 characters and one guarded range
# keep the class cheap for the usual ASCII input.
_WIDE_SPACES = (
    r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
)
WS_NOT_NL = r"\t\x0B\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0" + _WIDE_SPACES
WS = rf"[\n{WS_NOT_NL}]"
WORD = r"[\p{L}\p{N}_]"
# The characters of WS one by one, for what takes a set of characters.
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Remove whitespace at both ends."""
    return F.btrim(text, F.lit(WS_CHARS))


def without_whitespace(text: Column) -> Column:
    return F.translate(text, WS_CHARS, "")


def any_of(text: Column, markers) -> Column:
    """True when the text holds at least one of the literal markers."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in markers])


def all_of(text: Column, markers) -> Column:
    return reduce(lambda a, b: a & b, [F.contains(text, F.lit(m)) for m in markers])


def by_language(language: Column, branches: dict[str, Column], otherwise: Column) -> Column:
    """CASE over the language; each branch may be a different expression."""
    expr = F
    for name, value in branches.items():
        expr = expr.when(language == name, value)
    return expr.otherwise(otherwise)


def longest(items: Column) -> Column:
    """Longest string of an array, the first one on ties, '' for an empty array."""
    return F.aggregate(
        items,
        F.lit(""),
        lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best),
    )


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def common_prefix_length(a: Column, b: Column) -> Column:
    """Length of the common prefix, by halving steps; found up to two million characters.

    A longer common prefix is reported as shorter, which its callers tolerate.
    """
    strides = F.array(*[F.lit(1 << k) for k in range(20, -1, -1)])

    def search(limit: Column) -> Column:
        def extend(p: Column, stride: Column) -> Column:
            # The part up to p is known to be equal, so only the next stretch is compared.
            fits = (p + stride <= limit) & (
                F.substring(a, p + 1, stride) == F.substring(b, p + 1, stride)
            )
            return F.when(fits, p + stride).otherwise(p)

        return F.aggregate(F.filter(strides, lambda s: s <= limit), F.lit(0), extend)

    return let(F.least(F.length(a), F.length(b)), search)


#: Widths that are tried in turn, each for texts that are several times as long.
_BANDS = (16, 128)


def _banded(a: Column, b: Column) -> Column:
    """Levenshtein distance by the narrowest band that holds it."""
    shorter = F.least(F.length(a), F.length(b))
    out = F.levenshtein(a, b)
    for width in reversed(_BANDS):
        within = F.nullif(F.levenshtein(a, b, width), F.lit(-1))
        out = F.when(shorter > 4 * width, F.coalesce(within, out)).otherwise(out)
    return out


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance. Shared ends are cut off first: they never change the distance.

    The rest is measured within bands of growing width, which is linear for near texts; only
    texts further apart than the widest band cost quadratic time."""

    def without_prefix(p: Column) -> Column:
        rest = F.struct(
            F.substring(p["a"], p["n"] + 1, F.length(p["a"])).alias("a"),
            F.substring(p["b"], p["n"] + 1, F.length(p["b"])).alias("b"),
        )
        return let(rest, without_suffix)

    def without_suffix(r: Column) -> Column:
        shared = common_prefix_length(F.reverse(r["a"]), F.reverse(r["b"]))
        def trimmed(n: Column) -> Column:
            sides = [F.left(r[k], F.length(r[k]) - n).alias(k) for k in ("a", "b")]
            return let(F.struct(*sides), lambda t: _banded(t["a"], t["b"]))

        return let(shared, trimmed)

    pair = F.struct(a.alias("a"), b.alias("b"), common_prefix_length(a, b).alias("n"))
    return let(pair, without_prefix)
