"""Name similarity: token-sorted Indel ratio and best-window ratio, evaluated per Arrow batch.

Spark has no longest-common-subsequence function, so the score of a pair is a small Arrow
function; which pairs are compared is decided by joins (``operators.matching``).
"""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def token_sort(col: Column) -> Column:
    """Lower-case, blank-separated tokens in sorted order."""
    tokens = F.filter(F.split(F.lower(F.trim(col)), r"\s+"), lambda t: t != "")
    return F.array_join(F.array_sort(tokens), " ")


def _lcs_long(a: str, b: str) -> int:
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _codes(strings: np.ndarray, fill: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter((len(s) for s in strings), dtype=np.int64, count=len(strings))
    width = max(int(lengths.max()) if len(lengths) else 0, 1)
    grid = np.full((len(strings), width), fill, dtype=np.int64)
    flat = np.frombuffer("".join(strings).encode("utf-32-le"), dtype="<u4")
    grid[np.arange(width) < lengths[:, None]] = flat
    return grid, lengths


def _lcs_steps(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """After each character of ``right``: the LCS length of ``left`` and that prefix, whole batch at once.

    ``left`` texts have at most 63 characters, so a row of the recurrence is one machine word.
    """
    a, a_len = _codes(left, -1)
    b, _ = _codes(right, -2)
    bits = np.uint64(1) << np.arange(a.shape[1], dtype=np.uint64)
    full = (np.uint64(1) << a_len.astype(np.uint64)) - np.uint64(1)
    row = full.copy()
    for j in range(b.shape[1]):
        mask = np.where(a == b[:, j][:, None], bits, np.uint64(0)).sum(axis=1, dtype=np.uint64)
        hit = row & mask
        row = ((row + hit) | (row - hit)) & full
        yield j + 1, a_len - np.bitwise_count(row).astype(np.int64)


def lcs_lengths(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """LCS length of each (left, right) pair."""
    out = np.zeros(len(left), dtype=np.int64)
    long = np.fromiter((len(s) > 63 for s in left), dtype=bool, count=len(left))
    for i in np.flatnonzero(long):
        out[i] = _lcs_long(left[i], right[i])
    short = np.flatnonzero(~long)
    if len(short):
        for _, lcs in _lcs_steps(left[short], right[short]):
            out[short] = lcs
    return out


def _letter_bits(texts: np.ndarray) -> np.ndarray:
    """126-bit signatures of short texts as two words each: the k-th 'a' of a text is its own letter."""
    grid, lengths = _codes(texts, -1)
    marks = grid.copy()
    for j in range(grid.shape[1]):
        marks[:, j] = (grid[:, j] + 40 * (grid[:, :j] == grid[:, j][:, None]).sum(axis=1)) % 126
    bits = np.where(np.arange(grid.shape[1]) < lengths[:, None], np.int64(1) << (marks % 63), np.int64(0))
    return np.stack([np.bitwise_or.reduce(np.where(marks // 63 == half, bits, 0), axis=1) for half in (0, 1)], axis=1)


@F.pandas_udf(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]))
def letters_of(texts: pd.Series) -> pd.DataFrame:
    """126-bit signature of a text's letters, counting repeats.

    Letters of a that b lacks are at most the characters a has to lose, so comparing two
    signatures is an exact filter (two letters that share a bit only weaken it).
    """
    values, out = _texts(texts), np.zeros((len(texts), 2), dtype=np.int64)
    long = np.fromiter((len(s) > 63 for s in values), dtype=bool, count=len(values))
    short = np.flatnonzero(~long)
    if len(short):
        out[short] = _letter_bits(values[short])
    for i in np.flatnonzero(long):
        seen = Counter()
        for ch in values[i]:
            mark = (ord(ch) + 40 * seen[ch]) % 126
            out[i, mark // 63] |= 1 << (mark % 63)
            seen[ch] += 1
    return pd.DataFrame(out, columns=["lo", "hi"])


def _ratio(lcs: np.ndarray, total: np.ndarray, both: np.ndarray) -> np.ndarray:
    return np.where(both, 2.0 * lcs / np.maximum(total, 1), 0.0)


def indel_ratio(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """2*LCS/(|a|+|b|); a blank side scores 0."""
    la = np.fromiter(map(len, left), dtype=np.int64, count=len(left))
    lb = np.fromiter(map(len, right), dtype=np.int64, count=len(right))
    return _ratio(lcs_lengths(left, right), la + lb, (la > 0) & (lb > 0))


def _edge_windows(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Best ratio of ``short`` against the proper prefixes of ``long`` that are shorter than it."""
    m = np.fromiter(map(len, short), dtype=np.int64, count=len(short))
    best = np.zeros(len(short))
    clipped = np.array([b[:max(len(a) - 1, 0)] for a, b in zip(short, long)], dtype=object)
    width = np.fromiter(map(len, clipped), dtype=np.int64, count=len(short))
    for i, lcs in _lcs_steps(short, clipped):
        best = np.maximum(best, np.where(i <= width, 2.0 * lcs / (m + i), 0.0))
    return best


def _partial_long(short: str, long: str) -> float:
    m, n = len(short), len(long)
    windows = [long[i:i + m] for i in range(n - m + 1)]
    windows += [long[:i] for i in range(1, m)] + [long[n - i:] for i in range(1, m)]
    return max(2.0 * _lcs_long(short, w) / (m + len(w)) for w in windows)


def partial_ratio(left: np.ndarray, right: np.ndarray, floor: float = 0.0) -> np.ndarray:
    """Best Indel ratio of the shorter text against any window of the longer one.

    Windows are as long as the shorter text, or cut off at an end of the longer one. Pairs whose
    best possible window score stays below ``floor`` are reported as 0: a window cannot share
    more characters with the shorter text than the whole longer text does.
    """
    out = np.zeros(len(left))
    if len(left) == 0:
        return out
    la = np.fromiter(map(len, left), dtype=np.int64, count=len(left))
    lb = np.fromiter(map(len, right), dtype=np.int64, count=len(right))
    shorter = np.minimum(la, lb)
    whole = lcs_lengths(left, right)
    bound = _ratio(whole, shorter + whole, shorter > 0)
    todo = (bound >= floor) & (bound > 0)
    for i in np.flatnonzero(todo & (shorter > 63)):
        out[i] = max(_partial_long(*p) for p in ((left[i], right[i]), (right[i], left[i])) if len(p[0]) <= len(p[1]))
    todo &= shorter <= 63
    # (pair, needle, hay); texts of equal length are tried both ways round
    rows = np.concatenate([np.flatnonzero(todo & (la <= lb)), np.flatnonzero(todo & (lb <= la))])
    if len(rows) == 0:
        return out
    first = np.count_nonzero(todo & (la <= lb))
    needle = np.concatenate([left[rows[:first]], right[rows[first:]]])
    hay = np.concatenate([right[rows[:first]], left[rows[first:]]])
    np.maximum.at(out, rows, _edge_windows(needle, hay))
    backwards = [np.array([t[::-1] for t in side], dtype=object) for side in (needle, hay)]
    np.maximum.at(out, rows, _edge_windows(*backwards))
    shifts = [len(b) - len(a) + 1 for a, b in zip(needle, hay)]
    owner = np.repeat(np.arange(len(rows)), shifts)
    pieces = np.array([b[i:i + len(a)] for a, b, n in zip(needle, hay, shifts) for i in range(n)], dtype=object)
    for start in range(0, len(owner), 20_000):
        part = owner[start:start + 20_000]
        np.maximum.at(out, rows[part], indel_ratio(needle[part], pieces[start:start + 20_000]))
    return out


def _texts(series: pd.Series) -> np.ndarray:
    return series.fillna("").to_numpy(dtype=object)


@F.pandas_udf(T.DoubleType())
def _ratio_of_sorted(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(indel_ratio(_texts(left), _texts(right)))


# Indel ratio of two already token-sorted, lower-case texts. Declared non-deterministic so that a
# filter on the score is not pushed below it, which would score every pair twice.
ratio_of_sorted = _ratio_of_sorted.asNondeterministic()


def token_sort_ratio(left: Column, right: Column) -> Column:
    return ratio_of_sorted(token_sort(left), token_sort(right))


def variant_score_udf(partial_weight: float, floor: float):
    """max(token-sorted ratio, weight * best-window ratio) of two lower-case names."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b, a_sorted, b_sorted in batches:
            whole = indel_ratio(_texts(a_sorted), _texts(b_sorted))
            window = partial_ratio(_texts(a), _texts(b), floor / partial_weight - 1e-9)
            yield pd.Series(np.maximum(whole, partial_weight * window))

    return score.asNondeterministic()


@F.pandas_udf(T.DoubleType())
def matching_block_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Gestalt (matching block) ratio of two short texts, one pair per record."""
    return pd.Series([difflib.SequenceMatcher(None, a or "", b or "").ratio() for a, b in zip(left, right)])
