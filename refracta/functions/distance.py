"""Levenshtein distances of many pairs of texts at once.

Myers' bit vectors: a column of the distance table is two words of bits per 64 characters of
the shorter text, and a step of a few word operations moves on by one character of the longer
one. The steps of all pairs of a block are taken together. A block is bounded in memory; pairs
too long or too few for one are followed one by one in integers of any length, by the same steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pairs of a block, its padded characters and its words of match bits.
_BLOCK_PAIRS, _BLOCK_CHARS, _BLOCK_WORDS = 2048, 1 << 21, 1 << 22
#: A block pays from so many pairs per word on.
_PAIRS_PER_WORD = 8


def _shared(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def _trimmed(a: str, b: str) -> tuple[str, str]:
    """The shorter and the longer text without the ends they share, which never count."""
    if len(a) > len(b):
        a, b = b, a
    n = _shared(a, b)
    a, b = a[n:], b[n:]
    n = _shared(a[::-1], b[::-1]) if a and a[-1] == b[-1] else 0
    return a[: len(a) - n], b[: len(b) - n]


def _one_distance(pattern: str, text: str) -> int:
    """The distance of a single pair; the whole column is one integer."""
    match: dict[str, int] = {}
    for i, char in enumerate(pattern):
        match[char] = match.get(char, 0) | (1 << i)
    full = (1 << len(pattern)) - 1
    more, less = full, 0
    for char in text:
        equal = match.get(char, 0)
        down = equal | less
        across = (((equal & more) + more) ^ more) | equal
        up = less | (full & ~(across | more))
        low = more & across
        up = ((up << 1) | 1) & full
        low = (low << 1) & full
        more = low | (full & ~(down | up))
        less = up & down
    return len(text) + more.bit_count() - less.bit_count()


def _code_points(texts: Sequence[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _places(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, position in it) of every character of texts laid end to end."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _block_distances(patterns: Sequence[str], texts: Sequence[str]) -> np.ndarray:
    """The distances of pairs that are ordered by falling length of their texts."""
    n = len(texts)
    short, long = (np.array([len(t) for t in side]) for side in (patterns, texts))
    words = -(-int(short.max()) // 64)
    points, others = _code_points(patterns), _code_points(texts)
    # Characters of the patterns are numbered from 1; all others match nothing. A place in a word's
    # match bits is the number of the character times the pairs, plus the pair.
    numbers = np.zeros(int(max(points.max(), others.max())) + 1, np.int64)
    numbers[points] = 1
    alphabet = int(numbers.sum()) + 1
    numbers[numbers == 1] = np.arange(n, alphabet * n, n)
    owner, at = _places(short)
    match = np.zeros(words * alphabet * n, np.uint64)
    # Flat places: only for those does ``at`` have a fast path.
    np.add.at(match, (at >> 6) * (alphabet * n) + numbers[points] + owner, np.uint64(1) << (at & 63).astype(np.uint64))
    match = match.reshape(words, alphabet * n)
    owner, at = _places(long)
    # Steps behind the end of a text stay empty; they are never taken.
    steps = np.empty(int(long[0]) * n, np.int64)
    steps[at * n + owner] = numbers[others] + owner
    steps = steps.reshape(-1, n)
    # Pairs still running at each step: a leading part, as the longest texts come first.
    running = n - np.searchsorted(long[::-1], np.arange(len(steps)), side="right")
    more, less = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), np.uint64)
    one, last = np.uint64(1), np.uint64(63)
    buffers = np.empty((9, n), np.uint64)
    for step, k in zip(steps, running, strict=True):
        equal, down, across, up, low, up_in, low_in, up_out, low_out = buffers[:, :k]
        place = step[:k]
        for w in range(words):
            p, m = more[w, :k], less[w, :k]
            np.take(match[w], place, out=equal, mode="clip")
            np.bitwise_or(equal, m, out=down)
            if w:
                np.bitwise_or(equal, low_in, out=equal)
            np.bitwise_and(equal, p, out=across)
            np.add(across, p, out=across)
            np.bitwise_xor(across, p, out=across)
            np.bitwise_or(across, equal, out=across)
            np.bitwise_or(across, p, out=up)
            np.invert(up, out=up)
            np.bitwise_or(up, m, out=up)
            np.bitwise_and(p, across, out=low)
            if w < words - 1:  # what the next word takes over
                np.right_shift(up, last, out=up_out)
                np.right_shift(low, last, out=low_out)
            np.left_shift(up, one, out=up)
            np.bitwise_or(up, up_in if w else one, out=up)
            np.left_shift(low, one, out=low)
            if w:
                np.bitwise_or(low, low_in, out=low)
            up_in, low_in, up_out, low_out = up_out, low_out, up_in, low_in
            np.bitwise_and(up, down, out=m)
            np.bitwise_or(up, down, out=up)
            np.invert(up, out=up)
            np.bitwise_or(low, up, out=p)
    out = long.copy()
    for w in range(words):
        bits = np.clip(short - 64 * w, 0, 64)
        held = np.where(bits == 64, ~np.uint64(0), (one << (bits & 63).astype(np.uint64)) - one)
        out += np.bitwise_count(more[w] & held).astype(np.int64) - np.bitwise_count(less[w] & held)
    return out


def _blocks(pairs: Sequence[tuple[str, str, int]]) -> Iterator[list[tuple[str, str, int]]]:
    """Pairs of like lengths in parts of bounded memory."""
    block, words, longest, alphabet = [], 0, 0, 0
    for pair in sorted(pairs, key=lambda p: (len(p[0]) >> 6, len(p[1])), reverse=True):
        n = len(block) + 1
        # The alphabet of a block has at most as many characters as its longest patterns hold.
        if block and (n > _BLOCK_PAIRS or n * max(longest, len(pair[1])) > _BLOCK_CHARS or n * words * alphabet > _BLOCK_WORDS):
            yield block
            block = []
        if not block:
            words, longest, alphabet, seen = len(pair[0]) // 64 + 1, 0, 0, set()
        block.append(pair)
        seen.update(pair[0])
        longest, alphabet = max(longest, len(pair[1])), len(seen) + 1
    if block:
        yield block


def distances(before: Sequence[str], after: Sequence[str]) -> np.ndarray:
    """The Levenshtein distance of every pair, in characters."""
    out = np.zeros(len(before), np.int64)
    open_pairs = []
    for i, (a, b) in enumerate(zip(before, after, strict=True)):
        short, long = _trimmed(a, b)
        out[i] = len(long)
        if short:
            open_pairs.append((short, long, i))
    for block in _blocks(open_pairs):
        if len(block) < _PAIRS_PER_WORD * (len(block[0][0]) // 64 + 1):
            for short, long, i in block:
                out[i] = _one_distance(short, long)
        else:
            block.sort(key=lambda p: len(p[1]), reverse=True)
            patterns, texts, at = zip(*block, strict=True)
            out[list(at)] = _block_distances(patterns, texts)
    return out


def shares(before: Sequence[str | None], after: Sequence[str | None]) -> np.ndarray:
    """Distance over longer length per pair: 0 for two empty texts, NaN when one is missing."""
    out = np.full(len(before), np.nan)
    at = [i for i, (a, b) in enumerate(zip(before, after, strict=True)) if a is not None and b is not None]
    longest = np.array([max(len(before[i]), len(after[i]), 1) for i in at], np.float64)
    out[at] = distances([before[i] for i in at], [after[i] for i in at]) / longest
    return out


@F.pandas_udf(T.DoubleType())
def edit_shares(before: pd.Series, after: pd.Series) -> pd.Series:
    """The share per row, NULL where a text is."""
    return pd.Series(shares(before.tolist(), after.tolist()))
