"""Derived attributes of stored rows."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def success(preservation: Column) -> Column:
    return F.coalesce(preservation == 1, F.lit(False))


def total_tokens(tokens_input: Column, tokens_output: Column) -> Column:
    return F.coalesce(tokens_input, F.lit(0)) + F.coalesce(tokens_output, F.lit(0))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, 0.0 over an empty denominator."""
    return F.when(denominator == 0, 0.0).otherwise(
        numerator.cast("double") / F.nullif(denominator, F.lit(0))
    )


def numeric_round(value: Column, places: int) -> Column:
    """Round half up as a decimal, so that float noise cannot tip a tie."""
    return F.round(value.cast("decimal(38,12)"), places).cast("double")
