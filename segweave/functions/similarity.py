"""Matching-blocks similarity of two texts (Ratcliff and Obershelp), in Arrow batches."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def ratio(a: str | None, b: str | None) -> float:
    return SequenceMatcher(None, a or "", b or "").ratio()


def upper_bound(a, b):
    """No ratio exceeds twice the shorter length over the sum of both: a filter before the UDF."""
    la, lb = F.char_length(a), F.char_length(b)
    return F.when(la + lb > 0, 2 * F.least(la, lb) / (la + lb)).otherwise(1.0)


def letters(text: str) -> np.ndarray:
    """Counts of the characters, by code point modulo 64."""
    return np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") & 63, minlength=64)


def places(text: str) -> dict[str, int]:
    """For each character the bits of its places."""
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def common_subsequence(where: dict[str, int], size: int, b: str) -> int:
    """Length of the longest common subsequence of a text of ``size`` characters, given by ``places``, and b."""
    full = (1 << size) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def close_ratio(a, b, least: float):
    """The ratio of two columns where it is at least ``least``, else null, as a pandas UDF.

    The matching blocks are a common subsequence, and that is no longer than what the texts share as bags of characters:
    both bound the ratio, and the blocks themselves are sought only where neither bound is below ``least``.
    """

    @F.pandas_udf("double")
    def ratios(x: pd.Series, y: pd.Series) -> pd.Series:
        known = {p: (letters(p), places(p)) for p in set(x)}
        bags = {q: letters(q) for q in set(y)}

        def one(p: str, q: str) -> float | None:
            bag, where = known[p]
            both = len(p) + len(q)
            if both and (2.0 * int(np.minimum(bag, bags[q]).sum()) / both < least or 2.0 * common_subsequence(where, len(p), q) / both < least):
                return None
            found = ratio(p, q)
            return found if found >= least else None

        return pd.Series([one(p, q) for p, q in zip(x, y)], dtype="object")

    # else the optimizer would copy it into the filter and run it twice
    return ratios.asNondeterministic()(a, b)
