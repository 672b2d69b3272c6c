"""Words and word shingles of whole text batches as 64-bit hashes, without a loop over words.

A word is a maximal run of digits, a-z (A-Z are lower-cased first) and non-ASCII characters.
The hash of a word depends on its bytes alone, so every text, task and run agrees on it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]


def _fold_table() -> bytes:
    table = bytearray(range(256))
    for code in _SEPARATORS:
        table[code] = 0x20
    for code in range(0x41, 0x5B):
        table[code] = code + 0x20
    return bytes(table)


FOLD = _fold_table()
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHINGLE = _RANDOM.integers(1, 2**63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word (in place)."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def word_hashes(text: bytes) -> np.ndarray:
    """One hash per word of one UTF-8 text, in order."""
    folded = np.frombuffer(text.translate(FOLD), dtype=np.uint8)
    inside = folded != 0x20
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts = edges[::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    places = np.arange(len(folded), dtype=np.int32)
    begin = np.zeros(len(folded), np.int32)
    begin[starts] = starts
    places -= np.maximum.accumulate(begin)
    values = _BYTE[folded] * _PLACE[places & 63]
    # Behind 64 bytes a word goes on through the places again with the block number mixed in.
    # Those bytes alone: no other word's hash may change with it.
    far = np.flatnonzero(inside & (places >= 64))
    if len(far):
        block = (places[far] >> 6).astype(np.uint64)
        values[far] = mixed(values[far] ^ block * np.uint64(0x9E3779B97F4A7C15))
    values *= inside
    return mixed(np.add.reduceat(values, starts))


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; a shorter text is one run."""
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    total = np.zeros(n, np.uint64)
    for i in range(min(width, len(words))):
        total += words[i : i + n] * _SHINGLE[i]
    return np.unique(mixed(total))


def minhash_family(size: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of ``size`` 32-bit hash functions."""
    rng = np.random.Generator(np.random.PCG64(seed))
    a = rng.integers(0, 2**31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return a, rng.integers(0, 2**32, size, dtype=np.uint32)


def minhash(items: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The smallest value of every hash function over non-empty ``items``."""
    a, b = family
    low = (items >> np.uint64(32)).astype(np.uint32)
    step = max(1, 65536 // len(a))
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), step):
        block = low[None, at : at + step] * a[:, None]
        block += b[:, None]
        block ^= block >> np.uint32(15)
        block *= np.uint32(0x2C1B3C6D)
        np.minimum(best, block.min(axis=1), out=best)
    return best


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 of every text of an Arrow string column; NULL is empty."""
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
