"""The score of one transformation: complexity change, diversity, effort, elasticity."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from refracta.constants import STRUCTURE_CHARS
from refracta.functions.text import edit_distance, let, without_whitespace

_STRUCTURE = "[" + re.escape(STRUCTURE_CHARS) + "]"


def delta_cc(cc_before: Column, cc_after: Column) -> Column:
    return F.abs(cc_after - cc_before)


def structure_count(code: Column) -> Column:
    return F.regexp_count(code, F.lit(_STRUCTURE))


def _structure_weight(s1: Column, s2: Column) -> Column:
    return F.when(F.abs(s1 - s2) > F.greatest(s1, s2) * F.lit(0.2), 1.2).otherwise(1.0)


def diversity_of_parts(share: Column, structure_before: Column, structure_after: Column) -> Column:
    """``text_diversity`` from the share of edits between the bare texts and both structure counts.

    For many pairs: a function's part is found once, and ``distance.edit_shares`` takes the
    distances of a batch together.
    """
    weighted = share * _structure_weight(structure_before, structure_after)
    return F.when(weighted > 1, 1.0).otherwise(weighted)


def text_diversity(before: Column, after: Column) -> Column:
    """Edit distance over longer length, up-weighted when the structure moved, in 0..1."""
    weight = _structure_weight(structure_count(before), structure_count(after))

    def score(t: Column) -> Column:
        longest = F.greatest(F.length(t["a"]), F.length(t["b"])).cast("double")
        share = edit_distance(t["a"], t["b"]) / F.nullif(longest, F.lit(0.0))
        return F.when(t["a"] == t["b"], 0.0).otherwise(F.least(F.lit(1.0), share * t["w"]))

    bare = F.struct(
        without_whitespace(before).alias("a"), without_whitespace(after).alias("b"), weight.alias("w")
    )
    return F.when(before.isNotNull() & after.isNotNull(), let(bare, score))


def effort(volume: Column) -> Column:
    """1 / (1 + volume/1000); NULL volume stays NULL."""
    return F.when(volume <= 0, 1.0).when(volume.isNotNull(), 1.0 / (1.0 + volume / 1000.0))


def se_score(delta: Column, preservation: Column, diversity: Column, effort_: Column) -> Column:
    return F.when(effort_ == 0, 0.0).otherwise(
        delta * preservation * preservation * diversity / F.nullif(effort_, F.lit(0.0))
    )
