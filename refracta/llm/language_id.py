"""Language identification with error-correcting output codes.

Every language has a codeword of bits. For each bit one binary classifier on hashed byte
3-grams tells the languages with a one from those with a zero. A text's margins are decoded to
the codeword with the smallest loss, each bit weighted by how well its classifier separates;
where two codewords are close, the text is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from refracta.llm.common import fold, packed, pieces
from refracta.llm.wordhash import FOLD

BUCKETS = 1 << 13
#: Bound of the training sample: about so many rows of each language, chosen by text hash.
ROWS_PER_LANGUAGE = 4000
UNKNOWN = "und"
AMBIGUOUS = 0.05  # smallest lead of the best language over the next


@dataclass
class Model:
    """languages: names; code: languages x bits of +1/-1; weights: buckets x bits;
    gap: bits, the mean margin; trust: bits, weights of the loss."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    gap: np.ndarray
    trust: np.ndarray


def grams(text: str) -> np.ndarray:
    """Counts of hashed 3-grams of the lower-cased text; white space, digits and signs are one."""
    raw = b" ".join([b"", *text.lower().encode("utf-8", "replace").translate(_LETTERS).split(), b""])
    codes = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(codes) < 3:
        return np.zeros(BUCKETS, np.int64)
    mixed = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    return np.bincount(mixed >> np.uint32(19), minlength=BUCKETS)


_LETTERS = bytes(0x20 if 0x30 <= c <= 0x39 else FOLD[c] for c in range(256))


def codewords(n: int) -> np.ndarray:
    """n rows of +1/-1 bits: all splits for few languages, else the best of random codes."""
    if n <= 1:
        return np.zeros((n, 0), np.float32)
    if n <= 5:
        bits = [[1 if (split >> k) & 1 else -1 for k in range(n)] for split in range(1, 1 << (n - 1))]
        return np.array(bits, np.float32).T
    width, rng = int(np.ceil(10 * np.log2(n))), np.random.Generator(np.random.PCG64(5))
    best, least = None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.float32), (n, width))
        code[:, np.abs(code.sum(axis=0)) == n] *= np.where(np.arange(n) % 2, 1, -1)[:, None]
        apart = ((width - code @ code.T) / 2 + np.eye(n) * width).min()
        if apart > least:
            best, least = code, apart
    return best


def fitted(languages: list[str], counts: np.ndarray) -> Model:
    """The bit classifiers from the 3-gram counts of each language (languages x buckets)."""
    code = codewords(len(languages))
    share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
    weights, gap = np.zeros((BUCKETS, code.shape[1]), np.float32), np.ones(code.shape[1], np.float32)
    for bit in range(code.shape[1]):
        one, zero = share[code[:, bit] > 0].mean(axis=0), share[code[:, bit] < 0].mean(axis=0)
        ratio = np.log(one / zero)
        up, down = float(one @ ratio), float(zero @ ratio)
        weights[:, bit] = ratio - (up + down) / 2
        gap[bit] = max((up - down) / 2, 1e-6)
    return Model(languages, code, weights, gap, gap / max(gap.sum(), 1e-6))


def decoded(model: Model, counts: np.ndarray) -> tuple[int, float, float]:
    """(language, its probability, its lead) by the loss-weighted distance to the codewords."""
    if len(model.languages) == 1:
        return 0, 1.0, 1.0
    n = counts.sum()
    margin = (counts @ model.weights) / max(n, 1) / model.gap
    # The margins of short texts vary more: they count for less.
    sure = min(1.0, (n / 100) ** 0.5)
    losses = np.logaddexp(0, -4 * sure * model.code * margin) @ model.trust
    odds = np.exp(-4 * (losses - losses.min()))
    odds /= odds.sum()
    first, second = np.argsort(-odds, kind="stable")[:2]
    return int(first), float(odds[first]), float(odds[first] - odds[second])


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in pieces(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            total.setdefault(lang, np.zeros(BUCKETS, np.int64))
            total[lang] += grams(text or "")
    for lang, counts in total.items():
        some = np.flatnonzero(counts)
        yield pa.record_batch(
            [pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(counts[some])],
            names=["lang", "bucket", "n"],
        )


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Learn from text and non-NULL lang of the rows whose fold is not the held-out one."""
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").filter(fold() != 1).select("lang", "text")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], codewords(0), np.zeros((BUCKETS, 0), np.float32), np.ones(0), np.ones(0))
    limit = F.create_map(
        *[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, rows_per_language / n))]
    )[F.col("lang")]
    chosen = known.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < limit * (1 << 20))
    parts = chosen.mapInArrow(_gram_counts, "lang string, bucket int, n bigint")
    languages = sorted(sizes)
    counts = np.zeros((len(languages), BUCKETS))
    for r in parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[languages.index(r["lang"]), r["bucket"]] = r["n"]
    return fitted(languages, counts)


def _predict(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        for batch in pieces(batches):
            found = []
            for text in batch.column("text").to_pylist():
                if not text or not any(map(str.isalpha, text)):
                    found.append((UNKNOWN, 0.0, False))
                elif not model.languages:
                    found.append((UNKNOWN, 0.0, True))
                else:
                    at, score, lead = decoded(model, grams(text))
                    found.append((model.languages[at], score, lead < AMBIGUOUS))
            names, scores, unsure = zip(*found) if found else ((), (), ())
            kept = [n for n in batch.schema.names]
            yield pa.record_batch(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())],
                names=[*kept, "__lang", "__score", "__unsure"],
            )

    return run


def _predicted(docs: DataFrame, model: Model) -> DataFrame:
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    found = StructType.fromDDL("__lang string, __score double, __unsure boolean")
    return docs.mapInArrow(_predict(broadcast), StructType(docs.schema.fields + found.fields))


def languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): the language of its whole text.

    held_out   whether the row is one that training leaves out
    lang_pred  a learned language, or ``und`` where the text is NULL or has no letter
    score      0 to 1, the decoded probability; 0 for ``und``
    ambiguous  whether another language is nearly as near

    A prediction depends on the text alone. Where nothing can be learned (no rows, no
    labels) every row is ``und``. Repeated rows are judged each; a NULL doc_id belongs to no
    fold, so its row is neither learned from nor held out. Other columns are ignored,
    whatever their names.
    """
    fit = train(docs) if model is None else model
    return _predicted(docs.select("doc_id", "text"), fit).select(
        "doc_id",
        F.coalesce(fold() == 1, F.lit(False)).alias("held_out"),
        F.col("__lang").alias("lang_pred"),
        F.col("__score").alias("score"),
        F.col("__unsure").alias("ambiguous"),
    )


def identified(docs: DataFrame, model: Model | None = None, least: float = 0.0) -> DataFrame:
    """``docs`` without the rows that have no language: no letter, or a score under ``least``.

    All columns stay as they are, whatever their names. Where nothing can be learned, texts
    with a letter stay. NULL and empty texts go, repeated rows are judged each, an empty
    table gives an empty table.
    """
    fit = train(docs) if model is None else model
    rows, unpacked = packed(docs, "text")
    judged = _predicted(rows, fit)
    has = F.col("__unsure") if not fit.languages else (F.col("__lang") != UNKNOWN) & (F.col("__score") >= least)
    return unpacked(judged.filter(has))
