"""Contracts, anomalies, suite checks and acceptance rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refracta.constants import (
    ANOMALY_COST_USD,
    ANOMALY_LATENCY_MS,
    ANOMALY_SE,
    INTENSITY_RULES,
    LANGUAGES,
    STRATEGIES,
    SUITE_ALL_OF,
    SUITE_ANY_OF,
    SUITE_ERRORS,
    SUITE_MIN_COVERAGE_PCT,
    SUITE_TIME_LIMIT_MS,
    TASKS,
)
from refracta.functions.text import all_of, any_of, by_language
from refracta.session import literal_rows

# --- row rules -----------------------------------------------------------------------


def function_rules() -> dict[str, Column]:
    """Rule name -> condition a good row meets. A NULL is allowed where a check would pass it."""
    rules = {f"{c}_not_null": F.col(c).isNotNull() for c in ("id", "language", "code", "code_hash", "source")}
    return rules | {
        "language_domain": F.col("language").isin(*LANGUAGES),
        "cc_at_least_1": F.col("cyclomatic_complexity") >= 1,
        "loc_positive": F.col("lines_of_code") > 0,
    }


def transformation_rules() -> dict[str, Column]:
    return {
        "function_id_not_null": F.col("function_id").isNotNull(),
        "model_not_null": F.col("model").isNotNull(),
        "task_domain": F.col("task").isin(*TASKS),
        "strategy_domain": F.col("strategy").isin(*STRATEGIES),
        "preservation_0_or_1": F.col("preservation").isin(0, 1),
    }


def rule_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations per rule from one pass over the table."""
    counts = df.agg(
        *[F.count_if(~F.coalesce(ok, F.lit(True))).alias(name) for name, ok in rules.items()]
    )
    pairs = F.array(
        *[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules]
    )
    return counts.select(F.inline(pairs))


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with the names of the broken rules)."""
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(n)) for n, ok in rules.items()])
    )
    flagged = df.withColumn("broken_rules", broken)
    bad = F.size("broken_rules") > 0
    return flagged.filter(~bad).drop("broken_rules"), flagged.filter(bad)


def orphans(facts: DataFrame, functions: DataFrame) -> DataFrame:
    """Results whose function does not exist."""
    return facts.join(functions.select(F.col("id").alias("function_id")).distinct(), "function_id", "left_anti")


def cascade_delete(facts: DataFrame, kept_functions: DataFrame) -> DataFrame:
    """Results that survive when only ``kept_functions`` remain."""
    return facts.join(
        kept_functions.select(F.col("id").alias("function_id")).distinct(), "function_id", "left_semi"
    )


def schema_gaps(tables: dict[str, DataFrame], expected: dict[str, T.StructType]) -> DataFrame:
    """(table, column, type) that the contract asks for and the tables lack."""

    def rows(schemas: dict[str, T.StructType]) -> set[tuple]:
        return {(t, f.name, f.dataType.simpleString()) for t, s in schemas.items() for f in s.fields}

    gaps = sorted(rows(expected) - rows({t: d.schema for t, d in tables.items()}))
    spark = next(iter(tables.values())).sparkSession
    return literal_rows(spark, gaps, "table string, column string, type string")


def contract_report(tables: dict[str, DataFrame], expected: dict[str, T.StructType]) -> DataFrame:
    """Per column of the contract: whether its table has it, with the right type, and its NULLs.

    ``rows`` counts the table's rows, ``nulls`` those without a value (all of them for a column
    that is not there) and ``broken`` says that the contract is not met: the column is missing,
    has another type, or holds NULLs where it must not. One aggregate per table, which reads
    the columns of the contract alone. A table that is not given lacks all of its columns.
    """
    spark = next(iter(tables.values())).sparkSession
    parts = []
    for name, wanted in expected.items():
        held = {f.name: f.dataType for f in tables[name].schema.fields} if name in tables else {}
        source = tables.get(name, spark.createDataFrame([], "none int"))
        entries = [
            F.struct(
                F.lit(name).alias("table"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                F.lit(f.name in held).alias("present"), F.lit(held.get(f.name) == f.dataType).alias("right_type"),
                F.lit(f.nullable).alias("nullable"), F.count(F.lit(1)).alias("rows"),
                (F.count(F.lit(1)) - (F.count(F.col(f.name)) if f.name in held else F.lit(0))).alias("nulls"),
            )
            for f in wanted.fields
        ]
        parts.append(source.agg(F.array(*entries).alias("found")).select(F.inline("found")))
    broken = ~F.col("present") | ~F.col("right_type") | (~F.col("nullable") & (F.col("nulls") > 0))
    return reduce(DataFrame.unionByName, parts).withColumn("broken", broken).drop("nullable")


# --- anomalies ---------------------------------------------------------------------------


def anomalies(facts: DataFrame) -> DataFrame:
    """Rows that break a plausibility limit, with the names of the limits."""
    checks = {
        "se_too_high": F.col("se_score") > ANOMALY_SE,
        "cost_too_high": F.col("cost_usd") > ANOMALY_COST_USD,
        "latency_too_high": F.col("latency_ms") > ANOMALY_LATENCY_MS,
    }
    flags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return facts.withColumn("anomalies", flags).filter(F.size("anomalies") > 0)


def groups_without_success(facts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Groups in which every outcome that is known is a failure."""
    return (
        facts.filter(F.col("preservation").isNotNull())
        .groupBy(*group)
        .agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("preservation") == 0).alias("all_failed"))
        .filter("all_failed")
        .drop("all_failed")
    )


# --- generated test suites ------------------------------------------------------------------


def suite_structure(df: DataFrame, compiles: Column | None = None) -> DataFrame:
    """syntax_valid, functional_valid and errors from the look of a test suite.

    Python suites need a compile flag and, for functional validity, an executed result.
    """
    code, language = F.col("test_code"), F.col("language")
    marks = {k: all_of(code, v) for k, v in SUITE_ALL_OF.items()}
    marks |= {k: any_of(code, v) for k, v in SUITE_ANY_OF.items()}
    syntax = dict(marks)
    if compiles is not None:
        syntax["python"] = F.coalesce(compiles, F.lit(False))
    messages = {k: F.lit(v) for k, v in SUITE_ERRORS.items()} | {"python": F.lit("Syntax error")}
    return df.withColumns(
        {
            "syntax_valid": by_language(language, syntax, F.lit(False)),
            "functional_valid": by_language(language, marks, F.lit(False)),
        }
    ).withColumn(
        "errors",
        F.array_compact(F.array(F.when(~F.col("syntax_valid"), by_language(language, messages, F.lit(None))))),
    )


def suite_verdicts(suites: DataFrame, results: DataFrame) -> DataFrame:
    """Structure flags joined with executed results of Python suites, and the final verdict.

    Fully valid needs all four criteria; only executed (Python) suites can meet them.
    """
    run = results.select("function_id", "passed", "coverage_pct", "execution_time_ms")
    python = F.col("language") == "python"
    # An outcome of a suite that does not compile is ignored: it cannot have run.
    ran = python & F.col("passed").isNotNull() & F.col("syntax_valid")
    fast = F.when(python, ran & (F.col("execution_time_ms") < SUITE_TIME_LIMIT_MS)).otherwise(
        F.col("syntax_valid")
    )
    covered = ran & (F.col("coverage_pct") >= SUITE_MIN_COVERAGE_PCT)
    return (
        suites.join(run, "function_id", "left")
        .withColumn(
            "functional_valid",
            F.when(python, F.coalesce(ran & (F.col("passed") == 1), F.lit(False)))
            .otherwise(F.col("functional_valid")),
        )
        .withColumns(
            {
                "performance_valid": F.coalesce(fast, F.lit(False)),
                "coverage_valid": F.coalesce(covered, F.lit(False)),
            }
        )
        .withColumn(
            "fully_valid",
            python
            & F.col("syntax_valid")
            & F.col("functional_valid")
            & F.col("coverage_valid")
            & F.col("performance_valid"),
        )
    )


def suite_report(verdicts: DataFrame) -> DataFrame:
    """Totals and pass rates in percent."""
    kinds = ("syntax", "functional", "coverage", "performance")
    flags = {f"{k}_passed": f"{k}_valid" for k in kinds} | {"fully_valid": "fully_valid"}
    total = F.count(F.lit(1))
    base = F.greatest(F.lit(1), total)
    rates = {f"{k}_pass_rate": f"{k}_valid" for k in kinds} | {"fully_valid_rate": "fully_valid"}
    return verdicts.agg(
        total.alias("total"),
        *[F.count_if(flag).alias(name) for name, flag in flags.items()],
        *[(F.count_if(flag) / base * 100).alias(name) for name, flag in rates.items()],
    )


def mark_validated(functions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Set ``validated`` where the function's suite is fully valid."""
    good = verdicts.filter("fully_valid").select(F.col("function_id").alias("id")).distinct()
    return (
        functions.drop("validated")
        .join(good.withColumn("__ok", F.lit(True)), "id", "left")
        .withColumn("validated", F.coalesce("__ok", F.lit(False)))
        .drop("__ok")
    )


# --- intensity and acceptance ------------------------------------------------------------------


def intensity_conformance(pairs: DataFrame) -> DataFrame:
    """Does a result keep to the line and complexity limits of its task and intensity?

    Needs task, intensity, loc_before/after, cc_before/after.
    """
    rules = literal_rows(
        pairs.sparkSession,
        list(INTENSITY_RULES),
        "task string, intensity string, loc_lo double, loc_hi double, cc_lo double, cc_hi double",
    )

    def within(kind: str) -> Column:
        before, after = F.col(f"{kind}_before").cast("double"), F.col(f"{kind}_after").cast("double")
        low, high = F.col(f"{kind}_lo"), F.col(f"{kind}_hi")
        return F.coalesce(after >= before * low, F.lit(True)) & F.coalesce(
            after <= before * high, F.lit(True)
        )

    return (
        pairs.join(rules, ["task", "intensity"])
        .withColumns({"loc_ok": within("loc"), "cc_ok": within("cc")})
        .withColumn("conforms", F.col("loc_ok") & F.col("cc_ok"))
        .drop("loc_lo", "loc_hi", "cc_lo", "cc_hi")
    )


def acceptance(
    facts: DataFrame, planned_cells: int, budget: float, key: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Coverage of the plan, preservation between 60 and 80 %, spend within 10 % of budget.

    Distinct cells are counted on a pre-aggregation by the key.
    """
    cells = facts.groupBy(*key).agg(
        F.count("preservation").alias("known"),
        F.count_if(F.col("preservation") == 1).alias("ok"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost"),
    )
    totals = cells.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cells"),
        (F.try_divide(F.sum("ok"), F.sum("known")) * 100).alias("preservation_pct"),
        F.sum("cost").alias("spent_usd"),
    )
    return totals.select(
        *by,
        "cells",
        (F.col("cells") / F.lit(float(planned_cells)) * 100).alias("coverage_pct"),
        "preservation_pct",
        F.col("preservation_pct").between(60, 80).alias("preservation_ok"),
        "spent_usd",
        F.col("spent_usd").between(budget * 0.9, budget * 1.1).alias("cost_ok"),
    )
