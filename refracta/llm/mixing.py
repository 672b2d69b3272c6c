"""Mix sources to target weights: hash-random order, distributed prefix sums, an exact cut.

Every source gets a budget of words. Its documents are put in hash-random order, range-sorted
within the source, and word counts are prefix-summed over the ranges. Whole rounds over a
source are taken as often as its budget holds them; the last, partial round ends at the
word where the prefix sum meets what is left of the budget.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refracta.llm.common import hash_number, packed, small_side, text_or_empty
from refracta.operators.ordered import row_numbers, running_total
from refracta.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST = (5, 2, 1), 3
SEED = 17


def words(text: str = "text") -> Column:
    """Number of maximal runs without ASCII white space; 0 for NULL."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("bigint")


def _key(seed: int) -> Column:
    return hash_number(F.lit(seed), F.col("doc_id"), F.col("text"))


def budgets(
    totals: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST
) -> DataFrame:
    """``totals`` (source, source_size) with ``target``.

    Sources in code-point order, NULL last, get the weights in turn. Together they share the
    sum of all sizes by weight; none gets over ``most`` times its size, and what is cut off
    is shared by the others. In order of most * size / weight the cut-off sources come first,
    so running sums over that order give the share of the rest.
    """
    ordered = totals.withColumn("null_source", F.col("source").isNull())
    placed = row_numbers(ordered, ["null_source", "source"], "place")
    turn = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int")
    )
    weighed = placed.select(
        "source", "source_size", "place", turn.alias("weight"), (F.col("source_size") * float(most)).alias("bound")
    ).withColumn("ratio", F.col("bound") / F.col("weight"))
    weighed = cut_lineage(weighed)
    total = weighed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    order = ["ratio", "place"]
    run = running_total(weighed, "bound", order, "bound_before")
    run = running_total(run, "weight", order, "weight_before")
    left = F.lit(float(total["size"] or 0)) - F.col("bound_before")
    share = left / (F.lit(float(total["weight"] or 0)) - F.col("weight_before"))
    judged = cut_lineage(run.withColumn("share", share).withColumn("bounded", F.col("ratio") <= share))
    first = judged.filter("NOT bounded").agg(F.min_by("share", F.struct("ratio", "place"))).first()[0]
    target = F.when(F.col("bounded"), F.col("bound")).otherwise(F.col("weight") * F.lit(first).cast("double"))
    return judged.select("source", "source_size", target.alias("target"))


def _cuts(docs: DataFrame, weights: Sequence[float], most: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Per document its size and key, and per source the budget, whole rounds and the cut."""
    sized = cut_lineage(docs.select("doc_id", "source", words().alias("size"), _key(seed).alias("key")))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    facts = cut_lineage(
        budgets(totals, weights, most)
        .withColumn("rounds", rounds.cast("int"))
        .withColumn("rest", F.col("target") - F.col("rounds") * F.col("source_size"))
        .withColumnRenamed("source", "of_source")
    )
    at_row = running_total(
        sized.withColumn("row", F.monotonically_increasing_id()), "size", ["key", "doc_id", "row"], "before", ["source"]
    ).join(small_side(facts), F.col("source").eqNullSafe(F.col("of_source")))
    cut = (
        at_row.filter(F.col("before") + F.col("size") > F.col("rest"))
        .groupBy(F.col("source").alias("cut_source"))
        .agg(F.min(F.struct("key", "doc_id")).alias("cut"))
    )
    cut = small_side(cut)
    equal = F.col("source").eqNullSafe(F.col("cut_source")) & (F.struct("key", "doc_id") == F.col("cut"))
    share = (F.max("rest") - F.min("before")) / F.count(F.lit(1))
    parts = (
        at_row.join(cut, equal)
        .groupBy("cut_source")
        .agg(F.first("cut").alias("cut"), F.floor(share).cast("bigint").alias("part"))
    )
    joined = facts.join(parts, F.col("of_source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source")
    return sized, small_side(joined)


def mix_plan(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, seed: int = SEED
) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per row of ``docs``.

    ``taken`` is the number of words the mix takes of the document, repeats counted. The
    document at the cut gives the words that are left of the budget, so a source misses its
    target by less than a word, or less than n words if n equal rows are at the cut. NULL text has no words; NULL is a source of its own, the
    last. Rows equal in doc_id and text are treated alike: at the cut each gives the same
    number of words. A source without words has target 0. Other columns are ignored, whatever their names. An empty table
    gives an empty table. The order depends on ``seed``, doc_id and text alone.
    """
    sized, facts = _cuts(docs, weights, most, seed)
    joined = sized.join(facts, F.col("source").eqNullSafe(F.col("of_source")))
    own = F.struct("key", "doc_id")
    last = F.when(own < F.col("cut"), F.col("size")).when(own == F.col("cut"), F.col("part"))
    taken = F.col("size") * F.col("rounds") + F.coalesce(last, F.lit(0))
    return joined.select("doc_id", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, seed: int = SEED
) -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as ``mix_plan`` takes it, all columns.

    The last copy of a document at the cut holds its first words only, joined by single
    spaces; ``n_chars``, where it is a column, follows. Documents without words are taken
    with the whole rounds alone. NULL texts, NULL sources and repeated rows: as in
    :func:`mix_plan`. Other columns stay, whatever their names; an empty table gives an
    empty table.
    """
    _, facts = _cuts(docs, weights, most, seed)
    counted = [n for n in docs.columns if n == "n_chars"]
    rows, unpacked = packed(docs, "doc_id", "text", "source", *counted)
    side = facts.select(F.col("of_source").alias("__source"), F.struct("rounds", "cut", "part").alias("__plan"))
    keyed = rows.join(side, F.col("source").eqNullSafe(F.col("__source")))
    own = F.struct(_key(seed).alias("key"), F.col("doc_id").alias("doc_id"))
    cut, rounds = F.col("__plan.cut"), F.col("__plan.rounds")
    at_cut = F.coalesce((own == cut) & (F.col("__plan.part") > 0), F.lit(False))
    copies = rounds + F.coalesce((own < cut) | at_cut, F.lit(False)).cast("int")
    taken = keyed.withColumns({"__copies": copies, "__at_cut": at_cut}).filter("__copies > 0")
    taken = taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies")))
    partial = F.col("__at_cut") & (F.col("__copy") > rounds)
    begun = F.concat_ws(" ", F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("__plan.part").cast("int")))
    out = taken.withColumn("text", F.when(partial, begun).otherwise(F.col("text")))
    if counted:
        out = out.withColumn("n_chars", F.when(partial, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return unpacked(out)
