"""Scoring stored transformations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refracta.constants import NATURAL_KEY
from refracta.functions.distance import edit_shares
from refracta.functions.metrics import halstead_volume, keyword_complexity
from refracta.functions.scoring import (
    delta_cc, diversity_of_parts, effort, se_score, structure_count,
)
from refracta.functions.text import without_whitespace
from refracta.operators.astnodes import pair_parts, tree_sketch
from refracta.session import spread


def with_preservation(df: DataFrame, results: DataFrame, key=NATURAL_KEY) -> DataFrame:
    """Join test outcomes; no outcome counts as preserved, a failed run as not.

    Only Python suites are executed, so every other language counts as preserved.
    """
    outcome = results.groupBy(*key).agg(F.min("passed").alias("__passed"))
    return (
        df.join(outcome, list(key), "left")
        .withColumn(
            "preservation",
            F.when(F.col("language") != "python", 1).otherwise(F.coalesce("__passed", F.lit(1))),
        )
        .drop("__passed")
    )


def with_text_parts(df: DataFrame, code: str, structure: str) -> DataFrame:
    """``code`` without whitespace, with its count of structural characters: what diversity reads."""
    return df.withColumns({structure: structure_count(F.col(code)), code: without_whitespace(F.col(code))})


def score(
    pending: DataFrame, functions: DataFrame, results: DataFrame | None = None, use_trees: bool = False
) -> DataFrame:
    """Fill delta_cc, preservation, diversity, effort and se_score of the given rows.

    Complexity and volume of the result are computed here from ``transformed_code``.
    Rows without a function keep NULL scores and count as failed. ``use_trees`` takes
    Python diversity and complexity from syntax trees.
    """
    originals = spread(
        functions.select(
            F.col("id").alias("function_id"), "language", "code", F.col("cyclomatic_complexity").alias("__cc_before")
        )
    )
    if use_trees:
        # A function is parsed once, not once per result.
        own = tree_sketch(F.when(F.col("language") == "python", F.col("code")))
        originals = originals.withColumn("__sketch", own)
    originals = with_text_parts(originals, "code", "__structure_a")
    components = {"delta_cc", "preservation", "diversity", "effort", "se_score"}
    bare = pending.select(*[c for c in pending.columns if c not in components])
    # With their texts and trees functions are too wide for a broadcast, whatever size it is planned with.
    joined = bare.join(originals.hint("merge"), "function_id", "left")
    result_text = F.col("transformed_code")
    if use_trees:
        python = F.col("language") == "python"
        parts = pair_parts(F.col("__sketch"), F.col("code"), result_text, python)
        staged = joined.withColumn("__parts", parts)
        bound, share = F.col("__parts.bound"), F.col("__parts.share")
        cc_after = F.coalesce(F.col("__parts.complexity"), keyword_complexity(result_text))
    else:
        staged = joined
        bound, share = F.lit(None).cast("double"), edit_shares(F.col("code"), without_whitespace(result_text))
        cc_after = keyword_complexity(result_text)
    # A column of its own: below, it is used several times on a branch, and would be counted anew each time.
    staged = staged.withColumn("__structure_b", F.when(bound.isNull(), structure_count(result_text)))
    by_text = diversity_of_parts(share, F.col("__structure_a"), F.col("__structure_b"))
    staged = staged.withColumns(
        {
            "delta_cc": delta_cc(F.col("__cc_before"), cc_after).cast("double"),
            "diversity": F.coalesce(bound, by_text),
            "effort": effort(halstead_volume(result_text)),
            "__found": F.col("code").isNotNull(),
        }
    )
    # Outcomes come last: without the texts, rows are narrow when they are shuffled again.
    if results is None:
        staged = staged.withColumn("preservation", F.lit(1))
    else:
        staged = with_preservation(staged, results)
    return (
        staged.withColumn(
            "se_score",
            se_score(F.col("delta_cc"), F.col("preservation"), F.col("diversity"), F.col("effort")),
        )
        .withColumn("preservation", F.when(F.col("__found"), F.col("preservation")))
        .select(
            *bare.columns, "language", "delta_cc", "preservation", "diversity", "effort", "se_score"
        )
    )


def score_report(scored: DataFrame) -> DataFrame:
    """success / failed / total of a scoring run."""
    return scored.agg(
        F.count_if(F.col("se_score").isNotNull()).alias("success"),
        F.count_if(F.col("se_score").isNull()).alias("failed"),
        F.count(F.lit(1)).alias("total"),
    )


def merge_scores(facts: DataFrame, newly_scored: DataFrame) -> DataFrame:
    """The fact table with the pending rows replaced by their scored form."""
    done = facts.filter(F.col("se_score").isNotNull())
    return done.unionByName(newly_scored.select(*facts.columns))
