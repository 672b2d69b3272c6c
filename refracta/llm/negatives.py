"""Hard negatives of anchors, scored with Kronecker-packed products.

Components become whole numbers. Within a task the components of several candidates are
biased to be non-negative and laid side by side into fields of one wide number; one product
with a component of the anchor multiplies them all, and since no field can overflow into the
next, sums of products are unpacked into exact inner products. Anchors and candidates meet in
blocks: every block of anchors with every block of candidates, each pair of blocks in a group
of its own, which reports its best few rows per anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refracta.llm.whitening import is_finite, scaled
from refracta.session import cut_lineage

SCALE = 256
#: Rows of a block; a group holds one block of either side.
ANCHOR_BLOCK = 2048
CANDIDATE_BLOCK = 4096
#: Anchors scored against a block at a time.
STRIP = 128


def packed_products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products (anchors x candidates) of whole numbers, by packed fields.

    The fields are as wide as the largest biased sum. As many as fit are packed into one 64-bit
    number; where two do not fit, into a Python integer, which is as wide as it has to be.
    """
    dims = anchors.shape[1]
    if not dims or not len(anchors) or not len(candidates):
        return np.zeros((len(anchors), len(candidates)), np.int64)
    low_a, low_c = int(anchors.min()), int(candidates.min())
    most_a, most_c = int(anchors.max()) - low_a, int(candidates.max()) - low_c
    width = max(1, (dims * most_a * most_c).bit_length())
    narrow = 2 * width <= 64
    fields, kind = (64 // width, np.uint64) if narrow else (8, object)
    biased_a, biased_c = _biased(anchors, low_a, kind), _biased(candidates, low_c, kind)
    per_field = -(-len(candidates) // fields)
    packed = np.zeros((dims, per_field), kind)
    for f in range(fields):
        part = biased_c[f * per_field : (f + 1) * per_field]
        packed[:, : len(part)] |= part.T << kind(f * width) if narrow else part.T * (1 << (f * width))
    sums = biased_a @ packed
    mask = kind((1 << width) - 1) if narrow else (1 << width) - 1
    unpacked = [(sums >> kind(f * width) if narrow else sums >> (f * width)) & mask for f in range(fields)]
    biased = np.concatenate(unpacked, axis=1)[:, : len(candidates)]
    # (a - la)(c - lc) summed is a.c - lc * sum(a) - la * sum(c) + dims * la * lc
    of_a, of_c = _sums(anchors), _sums(candidates)
    largest = max(abs(low_a), abs(int(anchors.max()))) * max(abs(low_c), abs(int(candidates.max()))) * dims
    kind = np.int64 if narrow and largest < 2**60 else object
    shift = dims * low_a * low_c
    return biased.astype(kind) + (of_a.astype(kind) * low_c)[:, None] + (of_c.astype(kind) * low_a)[None, :] - shift


def _biased(values: np.ndarray, low: int, kind) -> np.ndarray:
    if kind is object:
        return values.astype(object) - low
    return (values - np.int64(low)).astype(np.uint64)


def _sums(values: np.ndarray) -> np.ndarray:
    wide = max(abs(int(values.max())), abs(int(values.min()))) * values.shape[1] >= 2**62
    return (values.astype(object) if wide else values).sum(axis=1)


def _ordered(scores: np.ndarray, allowed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per anchor the allowed candidates by falling score, earlier ones first on ties:
    (candidate, score)."""
    places = np.arange(scores.shape[1])
    for row, ok in zip(scores, allowed):
        at = places[ok]
        order = np.argsort(-row[at], kind="stable")
        yield at[order], row[at][order]


def _by_length(anchors: pa.Table, candidates: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray, pa.Table, np.ndarray]]:
    """Both sides cut by vector length (an anchor scores vectors of its own length only),
    with their matrices; candidates by rising id."""
    import pyarrow.compute as pc

    candidates = candidates.sort_by("vec_id")
    sides = [(t, pc.list_value_length(t.column("x")).to_numpy(zero_copy_only=False)) for t in (anchors, candidates)]
    for dims in np.intersect1d(*[lengths for _, lengths in sides]).tolist():
        found = []
        for table, lengths in sides:
            own = table.filter(pa.array(lengths == dims)).combine_chunks()
            flat = own.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            found += [own, flat.reshape(own.num_rows, dims)]
        yield tuple(found)


def _long(values: list) -> pa.Array:
    """Scores that do not fit a long, which take components beyond some 2 ** 28, become its ends."""
    ends = 2**63 - 1
    return pa.array([max(-ends - 1, min(ends, int(v))) for v in values], pa.int64())


def _positives(k: int):
    """The best ``k`` candidates of a block with the label of the anchor."""

    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        for own, x, others, y in _by_length(anchors, candidates):
            label_a, label_c = own.column("label").to_numpy(), others.column("label").to_numpy()
            id_a, id_c, numbers = own.column("vec_id").to_numpy(), others.column("vec_id").to_numpy(), own.column("anchor").to_pylist()
            for label in np.intersect1d(label_a, label_c):
                mine, theirs = np.flatnonzero(label_a == label), np.flatnonzero(label_c == label)
                for start in range(0, len(mine), STRIP):
                    strip = mine[start : start + STRIP]
                    scores = packed_products(x[strip], y[theirs])
                    other = id_a[strip][:, None] != id_c[theirs][None, :]
                    for a, (at, score) in zip(strip.tolist(), _ordered(scores, other)):
                        out += [(numbers[a], c, s) for c, s in zip(id_c[theirs[at[:k]]].tolist(), score[:k].tolist())]
        a, c, s = zip(*out) if out else ((), (), ())
        return pa.table({"anchor": pa.array(a, pa.int64()), "vec_id": pa.array(c, pa.int64()), "score": _long(s)})

    return run


def _negatives(k: int, low: int, high: int):
    """For each positive, the best ``k`` candidates of a block with another label whose score
    is between ``low`` and ``high`` percent of the positive's."""

    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        for own, x, others, y in _by_length(anchors, candidates):
            label_a, label_c = own.column("label").to_numpy(), others.column("label").to_numpy()
            id_c, numbers = others.column("vec_id").to_numpy(), own.column("anchor").to_pylist()
            positives = own.column("positive_scores").to_pylist()
            for start in range(0, own.num_rows, STRIP):
                scores = packed_products(x[start : start + STRIP], y)
                least = [min([-(-low * p // 100) for p in ps], default=1) for ps in positives[start : start + STRIP]]
                most = [max([high * p // 100 for p in ps], default=0) for ps in positives[start : start + STRIP]]
                kind = scores.dtype
                allowed = label_a[start : start + STRIP, None] != label_c[None, :]
                allowed &= (scores >= np.array(least, kind)[:, None]) & (scores <= np.array(most, kind)[:, None])
                for a, (at, score) in enumerate(_ordered(scores, allowed), start):
                    falling = -score
                    for place, p in enumerate(positives[a]):
                        first = int(np.searchsorted(falling, -(high * p // 100), side="left"))
                        last = int(np.searchsorted(falling, -(-(-low * p // 100)), side="right"))
                        chosen = slice(first, min(last, first + k))
                        out += [
                            (numbers[a], place, c, s)
                            for c, s in zip(id_c[at[chosen]].tolist(), score[chosen].tolist())
                        ]
        a, p, c, s = zip(*out) if out else ((), (), (), ())
        return pa.table(
            {
                "anchor": pa.array(a, pa.int64()),
                "place": pa.array(p, pa.int32()),
                "vec_id": pa.array(c, pa.int64()),
                "score": _long(s),
            }
        )

    return run


def _meet(anchors: DataFrame, rows: DataFrame, blocks: tuple[int, int], run, schema: str) -> DataFrame:
    """Every block of anchors with every block of rows, one group for each pair of blocks."""
    of_anchors, of_rows = blocks

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = anchors.withColumn("row_block", every(of_rows))
    right = rows.withColumn("anchor_block", every(of_anchors))
    keys = ("anchor_block", "row_block")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _first(rows: DataFrame, group: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
) -> DataFrame:
    """Hard negatives for anchors among ``rows`` (vec_id, label, embedding).

    ``is_anchor`` is a condition on these columns. An anchor's positives are the first
    ``positives`` rows of its label, its own id aside; for each, the first ``negatives`` rows of
    another label whose score is ``low`` to ``high`` percent of the positive's are returned:

    anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score

    Scores are inner products of floor(256 * entry); higher ones come first, ties by smaller id.
    Rows whose id, label or vector is NULL, or holds NULL or non-finite entries, take no part;
    only vectors of one length are compared. Repeated rows each count, though an anchor that is
    repeated entirely is one anchor. Entries beyond 2 ** 62 / 256 count as that, and scores
    beyond a long as its ends. Other columns are ignored, whatever their names; an empty table
    gives an empty table. The work is anchors times rows, in groups of bounded size.
    """
    usable = rows.filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & is_finite(F.col("embedding"))
    ).select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").cast("bigint").alias("label"),
        scaled(F.col("embedding"), SCALE).alias("x"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    )
    # written once, so that the block of a row is the same however often a task runs
    whole = cut_lineage(usable)
    n_rows = whole.count()
    chosen = cut_lineage(whole.filter("is_anchor").select("vec_id", "label", "x").distinct())
    of_anchors = max(1, -(-chosen.count() // ANCHOR_BLOCK))
    of_rows = max(1, -(-n_rows // CANDIDATE_BLOCK))
    numbered = chosen.withColumn("anchor", F.monotonically_increasing_id())
    anchors = numbered.withColumn("anchor_block", F.pmod(F.xxhash64("anchor"), F.lit(of_anchors)).cast("int"))
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(of_rows)).cast("int")
    candidates = whole.select("vec_id", "label", "x", place.alias("row_block"))
    blocks = (of_anchors, of_rows)
    found = _meet(anchors, candidates, blocks, _positives(positives), "anchor bigint, vec_id bigint, score bigint")
    best = cut_lineage(_first(found, ["anchor"], positives))
    listed = best.groupBy("anchor").agg(
        F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("best")
    )
    with_best = cut_lineage(anchors.join(listed, "anchor"))
    scored = with_best.withColumn("positive_scores", F.transform("best", lambda b: b["score"])).drop("best")
    schema = "anchor bigint, place int, vec_id bigint, score bigint"
    kept = _first(_meet(scored, candidates, blocks, _negatives(negatives, low, high), schema), ["anchor", "place"], negatives)
    names = with_best.select("anchor", F.col("vec_id").alias("anchor_id"), "best")
    pair = F.element_at("best", F.col("place") + 1)
    return kept.join(names, "anchor").select(
        "anchor_id",
        pair["vec_id"].alias("positive_id"),
        "rank",
        F.col("vec_id").alias("negative_id"),
        pair["score"].alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
