"""Similarity by longest common subsequence, as Arrow functions.

Only pairs that survive an exact, Spark-side candidate step reach these.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence by bit vectors over `a`."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        u = row & masks.get(ch, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * lcs_length(a, b) / total


def partial_reaches(a: str, b: str, threshold: float) -> bool:
    """Whether the shorter text aligns with some stretch of the longer at `threshold` or better.

    Shared character counts bound the subsequence from above, so most stretches
    are ruled out by arithmetic on whole arrays; the rest are measured exactly.
    """
    short, long_ = (a, b) if len(a) <= len(b) else (b, a)
    m, n = len(short), len(long_)
    if m == 0:
        return n == 0
    if short in long_:
        return True
    codes = np.frombuffer(long_.encode("utf-32-le"), dtype=np.uint32)
    starts = np.arange(-(m - 1), n)
    lo, hi = np.maximum(starts, 0), np.minimum(starts + m, n)
    shared = np.zeros(len(starts), dtype=np.int64)
    for ch in set(short):
        seen = np.concatenate(([0], np.cumsum(codes == ord(ch))))
        shared += np.minimum(seen[hi] - seen[lo], short.count(ch))
    width = hi - lo
    for i in np.nonzero(200.0 * shared >= threshold * (m + width))[0]:
        if indel_ratio(short, long_[lo[i]:hi[i]]) >= threshold:
            return True
    return False


@F.pandas_udf(T.DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """0-100 similarity of two names with their words put in order."""
    return pd.Series([indel_ratio(" ".join(sorted(x.split())), " ".join(sorted(y.split()))) for x, y in zip(a, b)],
                     dtype=float)


def partial_match(threshold: float = 90.0):
    """Column function: partial similarity of quote and text reaches the threshold. Null where either is null."""
    @F.pandas_udf(T.BooleanType())
    def reaches(quote: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([None if q is None or t is None else partial_reaches(q, t, threshold)
                          for q, t in zip(quote, text)], dtype=object)
    return reaches
