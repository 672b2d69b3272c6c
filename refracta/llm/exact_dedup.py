"""Exact de-duplication: a Bloom filter of repeated digests decides which rows are shuffled.

Pass one counts digests per filter slot and sets the bit of every slot that was hit more than
once. Pass two probes the filter: a row with a clear bit is certainly the only one with its
text and passes straight through; only the others are grouped by digest, exactly. The texts
are read once; everything after works on digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refracta.llm.common import text_or_empty
from refracta.session import cut_lineage

BITS_PER_ROW = 16
#: 64 MiB: the bound of the broadcast filter. Beyond some 34 million rows it only gets fuller,
#: so more rows are grouped exactly; the result stays the same.
MAX_BITS = 1 << 29
SEGMENT = 32768  # bits of one built-in bitmap
SALTS = 256


def _slots(bits: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(F.lit(k), "digest"), F.lit(bits)) for k in (1, 2)])


def _repeated_slots(digests: DataFrame, bits: int) -> DataFrame:
    """(segment, bitmap) of the slots that more than one row hits: at most bits / 8 bytes."""
    hit = digests.select(F.explode(_slots(bits)).alias("slot")).groupBy("slot").count()
    again = hit.filter("count > 1")
    return again.groupBy(F.expr(f"slot div {SEGMENT}").alias("segment")).agg(
        F.bitmap_construct_agg(F.col("slot") % SEGMENT).alias("bitmap")
    )


def _bit(bitmap: Column, slot: Column) -> Column:
    at = (slot % SEGMENT).cast("int")
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False))


def _probed(digests: DataFrame, bits: int) -> DataFrame:
    """``digests`` with ``again``: whether both bits of the row are set."""
    filter_rows = F.broadcast(cut_lineage(_repeated_slots(digests, bits)))
    out = digests.withColumn("slots", _slots(bits))
    for k in (0, 1):
        side = filter_rows.select(F.col("segment").alias(f"segment_{k}"), F.col("bitmap").alias(f"bitmap_{k}"))
        out = out.join(side, F.expr(f"slots[{k}] div {SEGMENT}") == F.col(f"segment_{k}"), "left")
    bits_set = [_bit(F.col(f"bitmap_{k}"), F.col("slots")[k]) for k in (0, 1)]
    return out.select("row", "doc_id", "digest", (bits_set[0] & bits_set[1]).alias("again"))


def exact_dedup(docs: DataFrame, normalised: Column | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text), dropped ones included.

    keep_id      doc_id of the row that stays: the largest of the group
    group_size   rows with the same normalised text
    kept         whether this row stays; exactly one row of a group does
    text_sha256  lowercase hex of the normalised text in UTF-8

    ``normalised`` is the text to compare, by default the text itself. NULL is the empty
    text. A NULL doc_id is smaller than any other; of rows equal in doc_id and text one
    stays. Other columns are ignored, whatever their names. An empty table gives an empty
    table. A group that holds a third of all rows is dealt over SALTS keys.
    """
    text = text_or_empty() if normalised is None else F.coalesce(normalised, F.lit(""))
    digests = cut_lineage(
        docs.select("doc_id", F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")).withColumn(
            "row", F.monotonically_increasing_id()
        )
    )
    bits = 1 << 16
    rows = digests.count()
    while bits < MAX_BITS and bits < BITS_PER_ROW * rows:
        bits *= 2
    probed = _probed(digests, bits)
    alone = probed.filter("NOT again").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"),
        "digest",
    )
    maybe = probed.filter("again").withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    part = maybe.groupBy("digest", "salt").agg(
        F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("n")
    )
    whole = part.groupBy("digest").agg(
        F.max("best").alias("best"), F.sum("n").alias("group_size"), F.collect_list("salt").alias("salts")
    )
    dealt = whole.select("digest", "best", "group_size", F.explode("salts").alias("salt"))
    grouped = maybe.join(dealt, ["digest", "salt"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "digest",
    )
    return alone.unionByName(grouped).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )
