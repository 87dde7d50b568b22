"""Pairwise string similarities in [0, 1].

``ratio`` is the normalized Indel similarity, 2 LCS / (len a + len b), with the
longest common subsequence found bit-parallel (Hyyro 2004) on Python integers.
Our rules for empty texts: two empty texts are equal (1.0) for ratio, token sort,
partial and Jaro-Winkler; a token set without words scores 0.0.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & every
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    if a == b:
        return 1.0
    return 2 * lcs(a, b) / (len(a) + len(b))


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """Best of the differences and of each side against the shared words."""
    own, other = set(a.split()), set(b.split())
    if not own or not other:
        return 0.0
    shared = own & other
    left, right = " ".join(sorted(own - other)), " ".join(sorted(other - own))
    if shared and (not left or not right):
        return 1.0
    common = len(" ".join(sorted(shared)))
    gap = 1 if common else 0
    whole = 2 * (common + gap) + len(left) + len(right)
    best = 1 - (len(left) + len(right) - 2 * lcs(left, right)) / whole
    if common:
        best = max(best, *(1 - (gap + len(x)) / (2 * common + gap + len(x)) for x in (left, right)))
    return best


def partial(a: str, b: str) -> float:
    """Best ratio of the shorter text with a window of the longer, also with windows cut off at its ends."""
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if not n:
        return 1.0 if not m else 0.0
    if a in b:
        return 1.0
    letters = set(a)
    best = 0.0
    windows = [b[max(0, i) : i + n] for i in range(1 - n, m) if i + n > 0]
    for window in windows:
        # A best window ends or starts with a letter that both have.
        if window[-1] not in letters and window[0] not in letters:
            continue
        if 2 * min(n, len(window)) / (n + len(window)) > best:
            best = max(best, ratio(a, window))
    if n == m:
        for window in (a[max(0, i) : i + m] for i in range(1 - m, n) if i + m > 0):
            if 2 * min(m, len(window)) / (m + len(window)) > best:
                best = max(best, ratio(window, b))
    return best


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used) if u]
    swapped = sum(x != y for x, y in zip(left, right)) // 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    score = jaro(a, b)
    if score > 0.7:
        prefix = 0
        for x, y in zip(a[:4], b[:4]):
            if x != y:
                break
            prefix += 1
        score += 0.1 * prefix * (1 - score)
    return score


def _memoized(scorer: Callable[[str, str], float]) -> Callable[[pd.Series, pd.Series], pd.Series]:
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(a.fillna(""), b.fillna("")):
            if pair not in seen:
                seen[pair] = scorer(*pair)
            out.append(seen[pair])
        return pd.Series(out, dtype="float64")

    return score


SCORERS: dict[str, Callable[[str, str], float]] = {"ratio": ratio, "token_set": token_set, "token_sort": token_sort, "partial": partial, "jaro_winkler": jaro_winkler}


def similarity(name: str, a: Column, b: Column) -> Column:
    """One of ``SCORERS`` as a column, by Arrow batches; equal pairs of a batch are scored once."""
    scorer = _memoized(SCORERS[name])

    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return scorer(x, y)

    return run(a, b)


def ternary(a: Column, b: Column) -> Column:
    """1 equal, -1 different, 0 if either is empty."""
    return F.when((a == "") | (b == ""), 0).when(a == b, 1).otherwise(-1)


def number_overlap(a: Column, b: Column) -> Column:
    """1 if two word lists share a word, -1 if not, 0 if either is empty."""
    return F.when((a == "") | (b == ""), 0).when(F.arrays_overlap(F.split(a, " "), F.split(b, " ")), 1).otherwise(-1)


def equal_flag(a: Column, b: Column) -> Column:
    return (a == b).cast("int")


def first_token_equal(a: Column, b: Column) -> Column:
    first = lambda c: F.split_part(c, F.lit(" "), F.lit(1))
    return (first(a) == first(b)).cast("int")
