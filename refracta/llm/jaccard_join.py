"""All documents whose word shingles overlap by at least a threshold, with Bayesian pruning.

1. Every text becomes the set of its five-word shingles, a MinHash signature and band keys.
   Texts with equal sets collapse into one node, so copies cost nothing further.
2. Nodes that share a band are candidates. A crowded bucket is cut into blocks and handled
   block against block; inside, the MinHash values are compared a few at a time, and a pair
   is dropped when the posterior probability of reaching the threshold falls below the
   tolerance. A block reports a spanning forest of the pairs that stay, never the pairs.
3. The components of that forest hold all links. Each is cut into blocks again, with the
   shingles at hand, and every pair that survives the same pruning is verified exactly.
   A block reports the number of links per node, and a spanning forest of the links.
4. The components of the exact links are the classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refracta.llm import wordhash
from refracta.llm.common import groups, packed, pieces, small_side, text_key
from refracta.llm.components import components
from refracta.session import cut_lineage

HASHES, BAND, STEP = 128, 4, 16  # MinHash values; per band; compared at a time
BLOCK = 256  # nodes of a block
SALTS = 256


def least_matches(threshold: float, tolerance: float, hashes: int = HASHES, step: int = STEP) -> list[int]:
    """For n = step, 2 step, ...: the fewest equal MinHash values that keep a pair.

    With a uniform prior the similarity given m matches of n is Beta(m + 1, n - m + 1), and
    P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    bounds = []
    for n in range(step, hashes + 1, step):
        below, m = 0.0, -1
        while below < tolerance and m < n:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        bounds.append(m)
    return bounds


def surviving(left: np.ndarray, right: np.ndarray, bounds: list[int], within: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (left, right) that no step drops; ``within``: one block, each pair once."""
    first = np.zeros((len(left), len(right)), np.int16)
    for k in range(STEP):
        first += left[:, k, None] == right[None, :, k]
    alive = first >= bounds[0]
    a, b = np.nonzero(np.triu(alive, 1) if within else alive)
    matches = first[a, b]
    for n, bound in enumerate(bounds[1:], start=1):
        if not len(a):
            break
        part = slice(n * STEP, (n + 1) * STEP)
        matches = matches + (left[a, part] == right[b, part]).sum(axis=1, dtype=np.int16)
        keep = matches >= bound
        a, b, matches = a[keep], b[keep], matches[keep]
    return a, b


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index linked with each of n nodes, itself if none."""
    low = np.arange(n)
    while True:
        least = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _sketch(width: int, hashes: int):
    family = wordhash.minhash_family(hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            nodes, signs, bands = [], [], []
            for text in wordhash.as_bytes(batch.column("text")):
                items = wordhash.shingles(wordhash.word_hashes(text), width)
                if not len(items):
                    nodes.append(None), signs.append(None), bands.append(None)
                    continue
                sign = wordhash.minhash(items, family)
                nodes.append(hashlib.md5(items.tobytes()).digest())
                signs.append(sign.tobytes())
                bands.append(_band_keys(sign))
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array(nodes, pa.binary()),
                    pa.array(signs, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_key", "node", "sign", "bands"],
            )

    return run


def _band_keys(sign: np.ndarray) -> np.ndarray:
    rows = sign.reshape(-1, BAND).astype(np.uint64)
    keys = np.arange(1, len(rows) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(BAND):
        keys = wordhash.mixed(keys ^ (rows[:, k] + np.uint64(k << 40)))
    return keys.view(np.int64)


def _shingled(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = [
                wordhash.shingles(wordhash.word_hashes(t), width).tobytes()
                for t in wordhash.as_bytes(batch.column("text"))
            ]
            yield pa.record_batch(
                [batch.column("node"), pa.array(sets, pa.binary())], names=["node", "items"]
            )

    return run


def _signs(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sign").to_pylist()), np.uint32).reshape(table.num_rows, -1)


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Row numbers of the two blocks of a group; equal when it is one block by itself."""
    mine = table.column("mine").to_numpy()
    low, high = mine.min(), mine.max()
    if table.column("single")[0].as_py():
        every = np.arange(len(mine))
        return every, every, True
    if low == high:  # the other block is empty
        return np.flatnonzero(mine == low), np.empty(0, np.int64), False
    return np.flatnonzero(mine == low), np.flatnonzero(mine == high), False


def _prune(bounds: list[int]):
    """Spanning forest of each group's surviving pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "place"):
            sign = _signs(table)
            left, right, within = _sides(table)
            a, b = surviving(sign[left], sign[right], bounds, within)
            if not len(a):
                continue
            low = _forest(table.num_rows, left[a], right[b])
            moved = np.flatnonzero(low != np.arange(len(low)))
            nodes = table.column("node")
            yield pa.record_batch(
                [nodes.take(pa.array(moved)).combine_chunks(), nodes.take(pa.array(low[moved])).combine_chunks()],
                names=["a", "b"],
            )

    return run


def _verify(bounds: list[int], threshold: float):
    """Exact links of each group: per node their number, and a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "place"):
            sign = _signs(table)
            left, right, within = _sides(table)
            a, b = surviving(sign[left], sign[right], bounds, within)
            a, b = left[a], right[b]
            linked = _linked(table.column("items").to_pylist(), a, b, threshold)
            a, b = a[linked], b[linked]
            n = table.num_rows
            weight = table.column("documents").to_numpy()
            links, sets = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for x, y in ((a, b), (b, a)):
                np.add.at(links, x, weight[y])
                np.add.at(sets, x, 1)
            low = _forest(n, a, b)
            some = np.flatnonzero(sets)
            nodes = table.column("node")
            if len(some):
                yield pa.record_batch(
                    [
                        nodes.take(pa.array(some)).combine_chunks(),
                        nodes.take(pa.array(low[some])).combine_chunks(),
                        pa.array(links[some]),
                        pa.array(sets[some]),
                    ],
                    names=["a", "b", "links", "sets"],
                )

    return run


def _linked(items: list[bytes], a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs (a, b) reach the threshold, by their sets."""
    out = np.zeros(len(a), bool)
    if not len(a):
        return out
    sets = [np.frombuffer(x, np.uint64) for x in items]
    sizes = np.array([len(s) for s in sets])
    for x in np.unique(a):
        pairs = np.flatnonzero(a == x)
        others = b[pairs]
        flat = np.concatenate([sets[y] for y in others])
        at = np.searchsorted(sets[x], flat)
        at[at == sizes[x]] = 0
        starts = np.concatenate([[0], np.cumsum(sizes[others])[:-1]])
        common = np.add.reduceat(sets[x][at] == flat, starts, dtype=np.int64)
        union = sizes[x] + sizes[others] - common
        out[pairs] = common >= threshold * union - 1e-9
    return out


def _in_blocks(members: DataFrame, key: str, *payload: str) -> DataFrame:
    """Each member once per pair of blocks it takes part in, sorted by the pair.

    ``size`` is the number of members of ``key``: with at most BLOCK there is one block.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = members.select(key, "node", *payload, blocks.alias("blocks")).withColumn(
        "mine", F.pmod(F.xxhash64("node"), "blocks").cast("int")
    )
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = F.concat_ws("/", F.col(key).cast("string") if key == "bucket" else F.hex(key), F.least("mine", "other"), F.greatest("mine", "other"))
    dealt = pairs.select(place.alias("place"), "node", "mine", (F.col("mine") == F.col("other")).alias("single"), *payload)
    return dealt.repartition("place").sortWithinPartitions("place")


def _candidates(sets: DataFrame) -> DataFrame:
    """(bucket, size, node): the buckets of two or more nodes, one of those with equal members."""
    bands = sets.select(F.explode("bands").alias("bucket"), "node")
    print_a, print_b = F.bit_xor(F.xxhash64("node")), F.bit_xor(F.xxhash64(F.lit(7), "node"))
    crowded = bands.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("size"), print_a.alias("pa"), print_b.alias("pb")
    ).filter("size > 1")
    kept = crowded.groupBy("size", "pa", "pb").agg(F.min("bucket").alias("bucket"))
    return bands.join(cut_lineage(kept.select("bucket", "size")), "bucket")


def jaccard_classes(
    docs: DataFrame, threshold: float = 0.8, width: int = 5, tolerance: float = 1e-6
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its class and its links.

    class_id  smallest doc_id of the documents reached over links of similarity >= threshold
    links     other documents linked directly, copies included
    linked_texts  other shingle sets linked directly
    copies    documents with the same shingle set, itself included
    text_key  16-byte digest of the text
    class_root  16 bytes that stand for the class; NULL for a text without a word. Classes may
                share a class_id (NULL, or an id that repeats), but never the root

    A text of fewer than ``width`` words is one shingle. NULL and texts without a word are
    linked to nothing: their class is their own doc_id, with 0 links. Rows that repeat count
    as copies. A NULL doc_id stays NULL and never names a class that has another id. Other
    columns are ignored, whatever their names. An empty table gives an empty table.
    """
    bounds = least_matches(threshold, tolerance)
    read = docs.select("doc_id", text_key().alias("text_key"), "text")
    kind = dict(read.dtypes)["doc_id"]
    sketch = cut_lineage(
        read.mapInArrow(_sketch(width, HASHES), f"doc_id {kind}, text_key binary, node binary, sign binary, bands array<bigint>")
    )
    sets = cut_lineage(
        sketch.filter("node IS NOT NULL")
        .groupBy("node")
        .agg(
            F.first("sign").alias("sign"),
            F.first("bands").alias("bands"),
            F.min("text_key").alias("text_key"),
            F.min("doc_id").alias("least_id"),
            F.count(F.lit(1)).alias("documents"),
        )
    )
    held = _candidates(sets).groupBy("node").agg(F.collect_list(F.struct("bucket", "size")).alias("in"))
    signed = held.join(sets.select("node", "sign"), "node").select("node", "sign", F.inline("in"))
    kept = _in_blocks(signed, "bucket", "sign").mapInArrow(_prune(bounds), "a binary, b binary")
    near = cut_lineage(components(kept))

    # Only the texts of nodes that are near another are read again.
    sizes = near.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    members = cut_lineage(
        near.join(sizes, "root").withColumnRenamed("id", "node").join(sets.select("node", "sign", "text_key", "documents"), "node")
    )
    wanted = small_side(members.select("text_key", "node"))
    texts = read.select("text_key", "text").join(wanted, "text_key").dropDuplicates(["text_key"])
    items = texts.select("node", "text").mapInArrow(_shingled(width), "node binary, items binary")
    found = cut_lineage(
        _in_blocks(members.join(items, "node"), "root", "sign", "documents", "items").mapInArrow(
            _verify(bounds, threshold), "a binary, b binary, links bigint, sets bigint"
        )
    )
    counted = found.groupBy(F.col("a").alias("node")).agg(
        F.sum("links").alias("links"), F.sum("sets").alias("linked_texts")
    )
    rooted = components(found.select("a", "b")).withColumnRenamed("id", "node")
    described = (
        sets.select("node", "least_id", "documents")
        .join(rooted, "node", "left")
        .join(counted, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    named = described.filter("links IS NOT NULL").groupBy("root").agg(F.min("least_id").alias("class_id"))
    facts = cut_lineage(
        described.join(named, "root", "left").select(
            "node",
            "root",
            F.coalesce("class_id", "least_id").alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.col("documents") - 1).alias("links"),
            F.coalesce("linked_texts", F.lit(0)).alias("linked_texts"),
            F.col("documents").alias("copies"),
        )
    )
    lonely = F.col("node").isNull()
    return sketch.select("doc_id", "text_key", "node").join(facts, "node", "left").select(
        "doc_id",
        F.when(lonely, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("links"),
        F.coalesce("linked_texts", F.lit(0)).cast("bigint").alias("linked_texts"),
        F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"),
        "text_key",
        F.col("root").alias("class_root"),
    )


def _same(*pairs: tuple[Column, Column]) -> Column:
    condition = F.lit(True)
    for left, right in pairs:
        condition &= left.eqNullSafe(right)
    return condition


def one_of_each_class(docs: DataFrame, threshold: float = 0.8, **options: float) -> DataFrame:
    """``docs`` without all but one row of each class: the smallest doc_id stays.

    Texts that are linked to nothing stay, repeated or not. Ties in doc_id go to the smallest
    text digest, and of rows equal in both one stays. NULL and empty texts are linked to
    nothing. All columns are kept, whatever their names; an empty table gives an empty table.
    """
    found = cut_lineage(jaccard_classes(docs, threshold, **options).filter("links > 0"))
    order = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("first")
    # a class that holds a third of all rows is dealt over SALTS keys
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALTS)).cast("int"))
    rows = salted.groupBy("class_root", "salt", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("rows"))
    rows = cut_lineage(rows)
    part = rows.groupBy("class_root", "salt").agg(order)
    firsts = part.groupBy("class_root").agg(F.min("first").alias("first"), F.collect_list("salt").alias("salts"))
    dealt = firsts.select("class_root", "first", F.explode("salts").alias("salt"))
    judged = rows.join(dealt, ["class_root", "salt"]).select(
        F.col("doc_id").alias("__id"),
        F.col("text_key").alias("__key"),
        _same((F.col("doc_id"), F.col("first.doc_id")), (F.col("text_key"), F.col("first.text_key"))).alias("__first"),
        F.col("rows").alias("__rows"),
    )
    special = small_side(judged.filter("NOT __first OR __rows > 1"))
    carried, unpacked = packed(docs, "doc_id", "text")
    keyed = carried.withColumn("__own_key", text_key())
    same = _same((F.col("doc_id"), F.col("__id"))) & (F.col("__own_key") == F.col("__key"))
    joined = keyed.join(special, same, "left").filter("__first IS NULL OR __first")
    once = joined.filter("__first IS NULL")
    repeated = joined.filter("__first").dropDuplicates(["doc_id", "__own_key"])
    return unpacked(once.unionByName(repeated))
