"""Connected components of an edge table, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refracta.session import cut_lineage


def _roots(parents: DataFrame) -> DataFrame:
    """Follow ``parent < id`` pointers to their ends; the length of a walk halves per round."""
    roots = cut_lineage(parents)
    while True:
        up = roots.select(F.col("id").alias("parent"), F.col("parent").alias("above"))
        joined = roots.join(up, "parent", "left")
        roots = cut_lineage(
            joined.select(
                "id",
                F.coalesce("above", "parent").alias("parent"),
                F.col("above").isNotNull().alias("moved"),
            )
        )
        if not roots.filter("moved").limit(1).count():
            return roots.select("id", "parent")
        roots = roots.select("id", "parent")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every end of an edge (``a``, ``b``); root is the smallest id reached.

    Each round hooks every node to its smallest neighbour below it, follows the pointers to
    their ends and contracts the edges to those ends. At most half of the joined nodes are
    left after a round, so the rounds grow with the logarithm of the nodes. Edges are grouped
    by their larger end alone: a node that thousands of others point to is never gathered.
    NULL ends and loops are ignored; an empty table gives an empty table.
    """
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    rest = cut_lineage(ordered.filter("a > b").distinct())
    nodes = cut_lineage(rest.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    found = nodes.select("id", F.col("id").alias("root"))
    while rest.limit(1).count():
        step = _roots(rest.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("parent")))
        found = cut_lineage(
            found.join(step.select(F.col("id").alias("root"), "parent"), "root", "left").select(
                "id", F.coalesce("parent", "root").alias("root")
            )
        )
        for end in ("a", "b"):
            to = step.select(F.col("id").alias(end), "parent")
            rest = rest.join(to, end, "left").withColumn(end, F.coalesce("parent", end)).drop("parent")
        rest = cut_lineage(
            rest.filter("a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .distinct()
        )
    return found
