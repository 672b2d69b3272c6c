"""Point lookups and range filters, all of them pushed down to the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refracta.constants import MEDIUM_MAX_CC, SIMPLE_MAX_CC


def function_by_id(functions: DataFrame, function_id: str) -> DataFrame:
    return functions.filter(F.col("id") == function_id).limit(1)


def all_functions(functions: DataFrame, validated_only: bool = True) -> DataFrame:
    return functions.filter("validated") if validated_only else functions


def functions_by_language(functions: DataFrame, language: str, validated_only: bool = True) -> DataFrame:
    return all_functions(functions, validated_only).filter(F.col("language") == language)


def functions_by_tier(functions: DataFrame, tier: str, validated_only: bool = True) -> DataFrame:
    cc = F.col("cyclomatic_complexity")
    ranges = {
        "simple": cc <= SIMPLE_MAX_CC,
        "medium": (cc > SIMPLE_MAX_CC) & (cc <= MEDIUM_MAX_CC),
        "complex": cc > MEDIUM_MAX_CC,
    }
    if tier not in ranges:
        raise ValueError(f"unknown complexity tier: {tier}")
    return all_functions(functions, validated_only).filter(ranges[tier])


def grid_input(functions: DataFrame) -> DataFrame:
    """The four columns an experiment needs; the rest is not read."""
    return functions.select("id", "language", "code", "cyclomatic_complexity")


def transformation_by_key(
    facts: DataFrame, function_id: str, model: str, task: str, strategy: str
) -> DataFrame:
    """The stored result of one cell; empty when it does not exist."""
    return facts.filter(
        (F.col("function_id") == function_id)
        & (F.col("model") == model)
        & (F.col("task") == task)
        & (F.col("strategy") == strategy)
    )


def transformation_exists(
    facts: DataFrame, function_id: str, model: str, task: str, strategy: str
) -> bool:
    return not transformation_by_key(facts, function_id, model, task, strategy).isEmpty()


def transformations_of(facts: DataFrame, function_id: str) -> DataFrame:
    return facts.filter(F.col("function_id") == function_id)


def pending_scores(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("se_score").isNull())


def scored(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("se_score").isNotNull())


def matching(facts: DataFrame, **equals) -> DataFrame:
    """Equality filters for the arguments that are given; None means no restriction."""
    for column, value in equals.items():
        if value is not None:
            facts = facts.filter(F.col(column) == value)
    return facts
