"""Name similarity.

The score is 100 * 2 * LCS / (len a + len b), LCS being the length of the longest common
subsequence. Spark has no LCS, so it is computed on Arrow batches, for all pairs of a batch at
once; pairs that cannot reach the threshold are dropped before, in the JVM.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

_WORD = 64
#: Characters of the longer texts that a block of pairs is filled up to.
_BLOCK_CHARS = 1 << 20


def _codes(texts: list[str], width: int) -> np.ndarray:
    """Code points of the texts, one row each, filled up with zeros."""
    padded = "".join(t.ljust(width, "\0") for t in texts)
    flat = np.frombuffer(padded.encode("utf-32-le"), dtype=np.uint32)
    return flat.reshape(len(texts), width)


def _lcs_words(a: list[str], b: list[str]) -> np.ndarray:
    """LCS of pairs whose first text fits a machine word, by the bit-vector recurrence of
    Hyyrö (2004): a zero bit of the vector marks a position where the LCS grows."""
    wide_a, wide_b = max(map(len, a)), max(map(len, b))
    left, right = _codes(a, wide_a), _codes(b, wide_b)
    weights = np.left_shift(np.uint64(1), np.arange(wide_a, dtype=np.uint64))
    vector = np.full(len(a), ~np.uint64(0), dtype=np.uint64)
    for j in range(wide_b):
        same = left == right[:, j : j + 1]
        match = (same * weights).sum(axis=1, dtype=np.uint64)
        match[right[:, j] == 0] = 0
        hit = vector & match
        vector = (vector + hit) | (vector - hit)
    size = np.array([len(t) for t in a], dtype=np.uint64)
    full = np.where(size == _WORD, ~np.uint64(0), np.left_shift(np.uint64(1), size % _WORD) - np.uint64(1))
    return np.bitwise_count(~vector & full).astype(np.int64)


def _lcs_long(a: str, b: str) -> int:
    """The same recurrence on an integer of any width."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    vector = full
    for ch in b:
        hit = vector & where.get(ch, 0)
        vector = ((vector + hit) | (vector - hit)) & full
    return len(a) - vector.bit_count()


def lcs_lengths(a: pd.Series, b: pd.Series) -> pd.Series:
    """LCS length of each pair; null where a text is null, which costs nothing."""
    given = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    out = pd.Series(np.zeros(len(a)), dtype="Int64")
    out[:] = pd.NA
    if not len(given):
        return out
    both = zip(a.iloc[given].tolist(), b.iloc[given].tolist())
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in both]
    sizes = np.zeros(len(pairs), dtype=np.int64)
    short = [i for i, (x, y) in enumerate(pairs) if x and len(x) <= _WORD and "\0" not in x + y]
    # Texts of similar size share a block, so that little is spent on filling up; the longest
    # text of a block decides how many it holds.
    short.sort(key=lambda i: len(pairs[i][1]))
    start = 0
    while start < len(short):
        stop = min(start + 4096, len(short))
        while stop > start + 1 and (stop - start) * len(pairs[short[stop - 1]][1]) > _BLOCK_CHARS:
            stop = start + (stop - start) // 2
        block = short[start:stop]
        sizes[block] = _lcs_words([pairs[i][0] for i in block], [pairs[i][1] for i in block])
        start = stop
    for i in set(range(len(pairs))) - set(short):
        sizes[i] = _lcs_long(*pairs[i])
    out.iloc[given] = sizes
    return out


_lcs_udf = F.pandas_udf(lcs_lengths, LongType())


def lcs_length(a: Column, b: Column) -> Column:
    return _lcs_udf(a, b)


def reaches(matched: Column, total: Column, threshold: float) -> Column:
    """Whether the score 100 * 2 * matched / total is at least the threshold, without division."""
    return matched * 200 >= total * F.lit(float(threshold))


def distance_budget(total: Column, threshold: float) -> Column:
    """Largest number of single-letter insertions and deletions a pair may differ by.

    ``total`` is the sum of both lengths. The small allowance keeps a pair exactly on the
    threshold; pairs it lets through too many are rejected by the exact test."""
    return F.floor(total * F.lit((100.0 - threshold) / 100.0) + 1e-9).cast("int")


def similarity(a: Column, b: Column, scorer: str = "indel") -> Column:
    """Score from 0 to 100 of two names without their legal forms; 0 if either is empty.

    ``levenshtein`` gives 100 * (total - distance) / total and needs no Python."""
    total = F.length(a) + F.length(b)
    if scorer == "levenshtein":
        matched = total - F.levenshtein(a, b)
    else:
        matched = 2 * lcs_length(a, b)
    return (
        F.when((a == "") | (b == "") | a.isNull() | b.isNull(), 0.0)
        .when(a == b, 100.0)
        .otherwise(matched / total * 100.0)
    )
