"""Small helpers that several of the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refracta.session import cut_lineage

#: Rows of at most some 50 bytes: a broadcast of this many stays below 64 MiB.
BROADCAST_ROWS = 500_000


def text_or_empty(text: str = "text") -> Column:
    """The text, NULL read as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def text_key(text: str = "text") -> Column:
    """16 bytes that stand for a whole text."""
    return F.unhex(F.md5(text_or_empty(text).cast("binary")))


def hash_number(*parts: Column) -> Column:
    """A number below 2 ** 60 that depends on the parts as texts alone: the first digits of
    their MD5. NULL is the empty text. Other engines find the same number."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 15), 16, 10).cast("bigint")


def fold(id_column: str = "doc_id", parts: int = 3) -> Column:
    """The fixed part (0 .. parts - 1) a row belongs to: CRC-32 of its id as text."""
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(parts))


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, written out; hinted for broadcast only when its counted rows are few.

    Beyond the bound the join is left to a shuffle, which gives the same rows. Only for
    narrow tables (ids, keys and numbers).
    """
    kept = cut_lineage(df)
    return F.broadcast(kept) if kept.count() <= rows else kept


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, *apart: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but ``apart`` in one struct, and the way back.

    Columns that an operator adds on the way can then not clash with any of the caller's.
    """
    others = {name: f"c{i}" for i, name in enumerate(n for n in docs.columns if n not in apart)}
    struct = F.struct(*[quoted(n).alias(c) for n, c in others.items()], F.lit(0).alias("end"))
    rows = docs.select(struct.alias("carried"), *[quoted(n).alias(n) for n in apart])

    def unpacked(out: DataFrame) -> DataFrame:
        columns = [F.col("carried")[others[n]] if n in others else F.col(n) for n in docs.columns]
        return out.select(*[c.alias(n) for c, n in zip(columns, docs.columns)])

    return rows, unpacked


#: Rows of texts that are turned into Python objects at a time.
PIECE_ROWS = 500


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Consecutive rows with one value of ``key``, for input that is sorted by it."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        keys = table.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), table.num_rows]
        for start, end in zip(cuts[:-2], cuts[1:-1]):
            yield table.slice(start, end - start)
        held = table.slice(cuts[-2]).combine_chunks()
    if held is not None and held.num_rows:
        yield held


#: Bytes of text that are turned into Python objects at a time; one larger text is a piece alone.
PIECE_BYTES = 4_000_000


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches by the bytes of a text column, so that memory follows neither the
    number of rows in a batch nor their length (but for a single text)."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            held = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, held + PIECE_BYTES, side="right"))
            stop = min(max(stop, start + 1), start + PIECE_ROWS)
            yield batch.slice(start, stop - start)
            start = stop
