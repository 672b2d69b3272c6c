"""Code metrics as column expressions: normal form, hash, size, complexity, volume."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from refracta.constants import BRANCH_SYMBOLS, BRANCH_WORDS, MEDIUM_MAX_CC, SIMPLE_MAX_CC
from refracta.functions.text import WORD, WS, WS_NOT_NL, let, strip
from refracta.session import settled

_WORDS = "|".join(sorted(BRANCH_WORDS, key=len, reverse=True))
_SYMBOLS = "|".join(re.escape(s) for s in BRANCH_SYMBOLS)
# Keywords stand alone; operators count only when squeezed between word characters.
# The look-ahead on first characters rejects most positions before anything else runs.
_FIRST = "".join(sorted({re.escape(w[0]) for w in (*BRANCH_WORDS, *BRANCH_SYMBOLS)}))
_BRANCH = (
    rf"(?=[{_FIRST}])(?:(?<!{WORD})(?:{_WORDS})(?!{WORD})|(?<={WORD})(?:{_SYMBOLS})(?={WORD}))"
)


def normalize_code(code: Column) -> Column:
    """Comments and docstrings out, lines stripped, blank lines dropped.

    The comment steps know nothing of string literals and run in a fixed order; that
    is part of the definition, since the hash depends on it.
    """
    text = code
    for pattern in (
        r"//[^\n]*",
        r"#[^\n]*",
        r"(?s)/\*.*?\*/",
        r"(?s)'''.*?'''",
        r'(?s)""".*?"""',
    ):
        text = F.regexp_replace(text, pattern, "")
    # A whitespace run holding a line end becomes one line end: that strips the lines
    # on both sides and removes blank ones in a single pass.
    text = F.regexp_replace(text, rf"(?<!{WS})[{WS_NOT_NL}]*+\n{WS}*+", "\n")
    return strip(text)


def code_hash(code: Column) -> Column:
    return F.sha2(normalize_code(code), 256)


def line_count(normalized: Column) -> Column:
    """Lines of an already normalised text; 0 when nothing is left."""
    breaks = F.length(normalized) - F.length(F.replace(normalized, F.lit("\n"), F.lit("")))
    return F.when(normalized == "", 0).otherwise(breaks + 1).cast("int")


def lines_of_code(code: Column) -> Column:
    return let(normalize_code(code), line_count)


def keyword_complexity(code: Column) -> Column:
    """1 + branch keywords in the raw text, comments and strings included."""
    return (F.regexp_count(code, F.lit(_BRANCH)) + 1).cast("int")


def token_count(code: Column) -> Column:
    return F.regexp_count(code, F.lit(rf"{WORD}+"))


def halstead_volume(code: Column) -> Column:
    """n * log2(n) over word tokens, rounded to two places."""

    def volume(n: Column) -> Column:
        return F.when(n == 0, 0.0).otherwise(F.round(n * F.log2(n), 2))

    return let(token_count(code).cast("double"), volume)


def complexity_tier(cc: Column) -> Column:
    return (
        F.when(cc <= SIMPLE_MAX_CC, "simple").when(cc <= MEDIUM_MAX_CC, "medium").otherwise("complex")
    )


def with_metrics(df, code: str = "code", cc: Column | None = None):
    """Add hash, complexity, volume, line count and tier, normalising the text once.

    ``cc`` replaces the keyword complexity, e.g. with the syntax-tree count for
    Python rows. Each step is a separate projection so Catalyst keeps the expensive
    intermediate instead of inlining it twice, and filters on the metrics don't compute them anew.
    """
    text = F.col(code)
    return settled(
        df.withColumn("__norm", normalize_code(text))
        .withColumns(
            {
                "code_hash": F.sha2(F.col("__norm"), 256),
                "lines_of_code": line_count(F.col("__norm")),
                "cyclomatic_complexity": keyword_complexity(text) if cc is None else cc,
                "halstead_volume": halstead_volume(text),
            }
        )
        .withColumn("complexity_tier", complexity_tier(F.col("cyclomatic_complexity")))
        .drop("__norm")
    )


def sorted_import_hash(code: Column) -> Column:
    """Hash of the stripped lines with the import lines sorted to the front."""

    def imports_first(lines: Column) -> Column:
        imports = F.array_sort(F.filter(lines, _is_import))
        return F.array_join(F.concat(imports, F.filter(lines, lambda x: ~_is_import(x))), "\n")

    return F.sha2(let(F.split(normalize_code(code), "\n"), imports_first), 256)


def _is_import(line: Column) -> Column:
    return F.startswith(line, F.lit("import ")) | F.startswith(line, F.lit("from "))
