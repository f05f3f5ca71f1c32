"""Similarity of names."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from limpid.functions.text import comparison, token_sorted


def jaro(a: str, b: str) -> float:
    """Matches within half the longer text; halves of transpositions count."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, mine = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                mine.append(x)
                break
    if not mine:
        return 0.0
    theirs = [y for y, t in zip(b, taken, strict=True) if t]
    swapped = sum(x != y for x, y in zip(mine, theirs, strict=True)) / 2
    m = len(mine)
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro with a bonus for up to four equal first characters, whatever the score."""
    j, n = jaro(a, b), 0
    while n < min(4, len(a), len(b)) and a[n] == b[n]:
        n += 1
    return j + 0.1 * n * (1 - j)


#: Characters of padded texts that are compared at once.
TOGETHER = 1 << 20


def jaro_many(a: list[str], b: list[str], winkler: bool) -> np.ndarray:
    """jaro() or jaro_winkler() of many pairs, those of similar lengths together."""
    x, y = np.array([len(v) for v in a], np.int64), np.array([len(v) for v in b], np.int64)
    out, order, lo = np.zeros(len(a)), np.lexsort((x, y)), 0
    while lo < len(order):
        width = int(max(y[order[lo]], 1))
        hi = lo + max(1, TOGETHER // (4 * width))
        own = order[lo : min(hi, int(np.searchsorted(y[order], 2 * width, side="right")))]
        out[own] = _jaro([a[i] for i in own], [b[i] for i in own], x[own], y[own], winkler)
        lo += len(own)
    return out


def codes(texts: list[str], width: int) -> np.ndarray:
    return np.array(texts, f"<U{width}").view(np.uint32).reshape(len(texts), width)


def _jaro(a: list[str], b: list[str], x: np.ndarray, y: np.ndarray, winkler: bool) -> np.ndarray:
    return jaro_coded(codes(a, max(1, int(x.max()))), codes(b, max(1, int(y.max()))), x, y, winkler)


def jaro_coded(p: np.ndarray, q: np.ndarray, x: np.ndarray, y: np.ndarray, winkler: bool) -> np.ndarray:
    """jaro() or jaro_winkler() of pairs of texts of x and y letters, which are rows of codes()."""
    n, at = np.arange(len(p)), np.arange(q.shape[1])
    reach = np.maximum(0, np.maximum(x, y) // 2 - 1)[:, None]
    free, mine = at < y[:, None], np.zeros(p.shape, bool)
    for i in range(p.shape[1]):
        same = free & (q == p[:, i, None]) & (np.abs(at - i) <= reach) & (i < x)[:, None]
        first = same.argmax(1)
        mine[:, i] = hit = same[n, first]
        free[n[hit], first[hit]] = False
    theirs, m = (at < y[:, None]) & ~free, mine.sum(1)
    inorder = lambda v, chosen: np.take_along_axis(v, np.argsort(~chosen, axis=1, kind="stable"), 1)[:, : min(p.shape[1], q.shape[1])]
    left, right = inorder(p, mine), inorder(q, theirs)
    swapped = ((left != right) & (np.arange(left.shape[1]) < m[:, None])).sum(1) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        j = np.where(m > 0, (m / x + m / y + (m - swapped) / m) / 3, np.where((x == 0) & (y == 0), 1.0, 0.0))
    if not winkler:
        return j
    k = min(4, p.shape[1], q.shape[1])
    alike = (p[:, :k] == q[:, :k]) & (np.arange(k) < np.minimum(x, y)[:, None])
    return j + 0.1 * np.cumprod(alike, axis=1).sum(1) * (1 - j)


def levenshtein_many(a: list[str], b: list[str]) -> np.ndarray:
    """Edits between the texts of many pairs, those of similar lengths together."""
    x, y = np.array([len(v) for v in a], np.int64), np.array([len(v) for v in b], np.int64)
    out, order, lo = np.zeros(len(a), np.int64), np.lexsort((x, y)), 0
    while lo < len(order):
        width = int(max(y[order[lo]], 1))
        hi = lo + max(1, TOGETHER // (4 * width))
        own = order[lo : min(hi, int(np.searchsorted(y[order], 2 * width, side="right")))]
        out[own] = _levenshtein([a[i] for i in own], [b[i] for i in own], x[own], y[own])
        lo += len(own)
    return out


def _levenshtein(a: list[str], b: list[str], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    p, q = codes(a, max(1, int(x.max()))), codes(b, max(1, int(y.max())))
    at = np.arange(q.shape[1] + 1, dtype=np.int32)
    row = np.tile(at, (len(a), 1))
    out = np.where(x == 0, y, 0)
    for i in range(int(x.max())):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (q != p[:, i, None]), out=new[:, 1:])
        row = np.minimum.accumulate(new - at, axis=1) + at  # insertions from the left
        done = np.flatnonzero(x == i + 1)
        out[done] = row[done, y[done]]
    return out


def levenshtein_all(a: list[str], b: list[str]) -> np.ndarray:
    """Edits between each of a, of 64 letters at most, and each of b, by bits: a column of the table of edits is two words,
    of where it rises and where it falls."""
    letters = {c: k for k, c in enumerate(sorted(set("".join(a))))}
    x, y = np.array([len(v) for v in a]), np.array([len(v) for v in b])
    where = np.zeros((len(a), len(letters) + 1), np.uint64)
    for k, v in enumerate(a):
        for i, c in enumerate(v):
            where[k, letters[c]] |= np.uint64(1 << i)
    codes = np.full((len(b), max(1, int(y.max(initial=0)))), len(letters))
    for k, v in enumerate(b):
        codes[k, : len(v)] = [letters.get(c, len(letters)) for c in v]
    one, last = np.uint64(1), np.where(x > 0, np.uint64(1) << (np.maximum(x, 1) - 1).astype(np.uint64), np.uint64(0))[:, None]
    rises, falls = np.full((len(a), len(b)), ~np.uint64(0)), np.zeros((len(a), len(b)), np.uint64)
    edits = np.repeat(x[:, None], len(b), axis=1)
    for j in range(int(y.max(initial=0))):
        match = where[:, codes[:, j]] | falls
        same = (((match & rises) + rises) ^ rises) | match
        down, up = rises & same, falls | ~(rises | same)
        edits += np.where(j < y, ((up & last) > 0).astype(np.int64) - ((down & last) > 0), 0)
        up = up << one | one
        falls, rises = up & same, down << one | ~(up | same)
    return np.where(x[:, None] > 0, edits, y)


def score_by(jaro: np.ndarray, edits: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """score() from its parts."""
    return np.floor(100 * (jaro + np.where(longest == 0, 1.0, 1 - edits / np.maximum(longest, 1))) / 2 + 0.5).astype(np.int64)


def score_most(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Scores that score() of each of a with each of b can't exceed: no more letters match than both have. And the edits
    between them; letters that both don't have are edits at least, which stands for texts of a over 64 letters."""
    kinds, x, y = 64, *(np.array([len(v) for v in t], float) for t in (a, b))
    n = [np.zeros((len(t), kinds), np.int16) for t in (a, b)]
    for t, own in zip((a, b), n, strict=True):
        for k, v in enumerate(t):  # letters of one kind are held for the same: that only adds to what both have
            own[k] = np.bincount(np.frombuffer(v.encode("utf-32-le"), np.uint32) % kinds, minlength=kinds)
    both = np.zeros((len(a), len(b)), np.int16)
    for k in range(kinds):
        some, other = np.flatnonzero(n[0][:, k]), np.flatnonzero(n[1][:, k])
        if len(some) and len(other):
            both[np.ix_(some, other)] += np.minimum(n[0][some, k, None], n[1][other, k])
    short, x, y = x <= 64, x[:, None], y[None]
    longest = np.maximum(x, y)
    edits = (longest - both).astype(np.int64)
    if short.any():
        edits[short] = levenshtein_all([v for v, s in zip(a, short, strict=True) if s], b)
    with np.errstate(divide="ignore", invalid="ignore"):
        j = np.where(both > 0, (both / x + both / y + 1) / 3, 0.0)
    p, q = codes([v[:4] for v in a], 4), codes([v[:4] for v in b], 4)
    same, prefix = np.ones(both.shape, bool), np.zeros(both.shape, np.int8)
    for k in range(4):
        same &= (p[:, k, None] == q[None, :, k]) & (p[:, k, None] != 0)
        prefix += same
    j = np.where(longest > 0, j + 0.1 * prefix * (1 - j), 1.0)
    return score_by(j + 1e-11, edits, longest), edits


@F.pandas_udf(DoubleType())
def jaro_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(jaro_many(a.tolist(), b.tolist(), False), dtype="float64")


@F.pandas_udf(DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(jaro_many(a.tolist(), b.tolist(), True), dtype="float64")


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def compared(c: Column, tokens: bool) -> Column:
    return token_sorted(c) if tokens else comparison(c)


def score(a: Column, b: Column) -> Column:
    """0 to 100 for two texts in compared() form."""
    return F.floor(100 * (jaro_winkler_udf(a, b) + levenshtein_similarity(a, b)) / 2 + 0.5).cast("int")
