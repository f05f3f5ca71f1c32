"""Periodic stretches of words, found in the grammar of a text.

Re-Pair replaces pairs of neighbouring symbols that occur more than once in a text, the most frequent first, by new
symbols, until no pair is left that does. A stretch of period q is a run if it holds two periods or more. Each run of a
text is inside the shortest part of the derivation that holds all of it, and crosses the boundary between that part's
two halves. So runs across the boundary are worked out once for every symbol, by the longest common extensions to both
sides of the boundary and of the place a period away, and are then carried to all places that derive from the symbol.
The text's last sequence, in which no pair recurs, is halved again and again in the same way. What an end of a part cut
short is inside a run that a larger part holds in full; so of the stretches of one period those inside another go.

A pair of words that occurs once in a text never enters a rule, and a run holds one such pair at most, between two equal
halves. So only stretches that are long enough with one such pair in them are looked at. All texts of a slice are
handled at once, as arrays: a round replaces all pairs that are more frequent than every pair they overlap. Extensions
are exact: they compare the ranks of all stretches of 1, 2, 4, .. words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from limpid.llm.arrow import add_columns, blobs
from limpid.llm.words import PLAIN, U, Words, mix, slices

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("kept", T.StringType())])
#: Boundaries and periods looked at at once.
BATCH = 1 << 20


@dataclass
class Parts:
    """Parts [lo, hi) of a sequence with the boundary at mid between their two halves."""

    lo: np.ndarray
    mid: np.ndarray
    hi: np.ndarray


@dataclass
class Grammar:
    """Rules by symbol, in the order they were made; symbols below `words` are words. A rule's expansion is found at
    first .. first + length - 1. The last sequence's symbols lie at `start`."""

    words: int
    left: np.ndarray
    right: np.ndarray
    first: np.ndarray
    length: np.ndarray
    rounds: np.ndarray
    sequence: np.ndarray
    start: np.ndarray


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key its number among the different ones, and how often each of these occurs."""
    _, own, n = np.unique(keys, return_inverse=True, return_counts=True)
    return own, n


def repeated_stretches(w: Words, least: int) -> np.ndarray:
    """Which words may be in a run: those of stretches of `least` words with at most one pair that occurs once."""
    n = len(w)
    owner = np.repeat(np.arange(w.hi - w.lo), w.counts)
    last = np.zeros(n, bool)
    last[w.first[1:][w.counts > 0] - 1] = True
    pair = mix(w.hash * U(0x9E3779B97F4A7C15) + np.roll(w.hash, -1) + owner.astype(U) * U(0xC2B2AE3D27D4EB4F))
    own, count = counted(pair)
    edge = np.flatnonzero(last | (count[own] == 1))  # a stretch ends after each of these words
    size = np.diff(edge, prepend=-1)
    joined = np.zeros(len(edge), bool)
    joined[:-1] = ~last[edge[:-1]] & (size[:-1] + size[1:] >= least)
    long = (size >= least) | joined
    long[1:] |= joined[:-1]
    return np.repeat(long, size)


def re_pair(symbols: np.ndarray, together: np.ndarray) -> Grammar:
    """symbols: words, numbered from 0 and apart for each text; together: whether the next word is of the same stretch."""
    n = words = int(symbols.max(initial=-1)) + 1
    sym, start, length = symbols.astype(np.int64), np.arange(len(symbols)), np.ones(len(symbols), np.int64)
    link = together.copy()  # the pair that begins here may be replaced
    rules: list[tuple[np.ndarray, ...]] = []
    while True:
        at = np.flatnonzero(link)
        own, count = counted(sym[at] * n + sym[at + 1])
        once = count[own] < 2
        link[at[once]] = False  # for good: a pair that occurs once is in no pair that occurs more often
        at, own = at[~once], own[~once]
        if not len(at):
            break
        priority = np.empty(len(count), np.int64)
        priority[np.lexsort((-np.arange(len(count)), count))] = np.arange(len(count))
        follows = np.flatnonzero(np.diff(at) == 1)  # of pairs that overlap, these are the first
        a, b = own[follows], own[follows + 1]
        chosen = np.ones(len(count), bool)
        chosen[np.where(priority[a] < priority[b], a, b)[a != b]] = False
        # Of a pair that overlaps itself every second one is replaced.
        same = np.zeros(len(at), bool)
        same[follows[a == b] + 1] = True
        place = np.arange(len(at))
        chain = place - np.maximum.accumulate(np.where(same, 0, place))
        take = chosen[own] & (chain % 2 == 0)
        often = np.bincount(own[take], minlength=len(count))
        link[at[chosen[own] & (often[own] < 2)]] = False
        take &= often[own] >= 2
        if not take.any():
            continue
        i = at[take]
        number, first, kind = np.unique(own[take], return_index=True, return_inverse=True)
        f = i[first]
        rules.append((sym[f], sym[f + 1], start[f], length[f] + length[f + 1], np.full(len(number), len(rules))))
        sym[i] = n + kind
        length[i] += length[i + 1]
        link[i] = link[i + 1]
        n += len(number)
        left = np.ones(len(sym), bool)
        left[i + 1] = False
        # A new pair begins before or after each replaced one, unless it was cut.
        sym, start, length, link = sym[left], start[left], length[left], link[left]
    made = [np.concatenate(x) if rules else np.zeros(0, np.int64) for x in (zip(*rules, strict=True) if rules else [[]] * 5)]
    return Grammar(words, *made, sym, start)


class Extensions:
    """Longest common extensions of two places, by the ranks of all stretches of 1, 2, 4, .. symbols."""

    def __init__(self, symbols: np.ndarray, longest: int):
        self.n, self.ranks = len(symbols), [symbols.astype(np.int32)]
        while 1 << len(self.ranks) <= longest:
            r, k = self.ranks[-1], 1 << (len(self.ranks) - 1)
            key = r[:-k].astype(np.int64) * (int(r.max(initial=0)) + 1) + r[k:]
            self.ranks.append(counted(key)[0].astype(np.int32) if len(key) else np.zeros(0, np.int32))

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i and from j > i on are equal."""
        i, j, begin = i.copy(), j.copy(), i
        for k in reversed(range(len(self.ranks))):
            r, step = self.ranks[k], 1 << k
            fits = np.flatnonzero(j + step <= self.n)
            same = fits[r[i[fits]] == r[j[fits]]]
            i[same] += step
            j[same] += step
        return i - begin

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols before i < j and before j are equal."""
        i, j, begin = i.copy(), j.copy(), i
        for k in reversed(range(len(self.ranks))):
            r, step = self.ranks[k], 1 << k
            fits = np.flatnonzero(i >= step)
            same = fits[r[i[fits] - step] == r[j[fits] - step]]
            i[same] -= step
            j[same] -= step
        return begin - i


def crossing(symbols: np.ndarray, ext: Extensions, parts: Parts, least: int) -> tuple[np.ndarray, ...]:
    """(part, from, to, period) of all stretches across a part's boundary that hold two periods and `least` words and
    that no neighbour within the part extends; each with its smallest period."""
    found: list[tuple[np.ndarray, ...]] = []
    sizes = (parts.hi - parts.lo) // 2
    sizes[parts.hi - parts.lo < least] = 0
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BATCH, side="right")))
        part = np.repeat(np.arange(lo, hi), sizes[lo:hi])
        q = np.arange(len(part)) - np.repeat(ends[lo:hi] - sizes[lo:hi] - (ends[lo - 1] if lo else 0), sizes[lo:hi]) + 1
        for ahead in (True, False):  # whether the period from the boundary on is looked at, or that before it
            begin, end = parts.lo[part], parts.hi[part]
            i = parts.mid[part] - (0 if ahead else q)
            j = i + q
            inside = np.flatnonzero((j <= end) & (i >= begin))
            i, j, begin, end = i[inside], j[inside], begin[inside], end[inside]
            near = (j < end) & (symbols[i] == symbols[np.minimum(j, len(symbols) - 1)]) | (i > begin) & (symbols[i - 1] == symbols[j - 1])
            some = inside[near]
            i, j, begin, end, own = i[near], j[near], begin[near], end[near], q[some]
            s, e = i - np.minimum(ext.backward(i, j), i - begin), j + np.minimum(ext.forward(i, j), end - j)
            good = e - s >= np.maximum(2 * own, least)
            found.append((part[some][good], s[good], e[good], own[good]))
        lo = hi
    p, s, e, q = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else [[]] * 4))
    order = np.lexsort((q, e, s, p))
    p, s, e, q = p[order], s[order], e[order], q[order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    return p[new], s[new], e[new], q[new]


def halves(start: np.ndarray, stretch: np.ndarray, ends: np.ndarray) -> Iterator[Parts]:
    """Parts of the last sequence, level by level: whole stretches, their halves, and so on. start: where symbols begin;
    stretch: the number of each symbol's stretch; ends: where stretches end."""
    first = np.searchsorted(stretch, np.arange(len(ends)))
    a, b = first, np.append(first[1:], len(start))
    edge = np.append(start, ends[-1] if len(ends) else 0)
    while len(a):
        more = b - a > 1
        a, b = a[more], b[more]
        mid = (a + b) // 2
        yield Parts(edge[a], edge[mid], edge[b])
        a, b = np.concatenate([a, mid]), np.concatenate([mid, b])


def carried(g: Grammar, rule: np.ndarray, s: np.ndarray, e: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Stretches (from, to, period) of rules' first places, at all places that derive from the rules."""
    begin = np.searchsorted(rule, np.arange(len(g.first) + 1))
    many = np.diff(begin)
    symbol, at = g.sequence, g.start
    for k in reversed(range(int(g.rounds.max(initial=-1)) + 1)):
        derived = symbol >= g.words
        now = derived & (g.rounds[np.where(derived, symbol - g.words, 0)] == k)
        r, place = symbol[now] - g.words, at[now]
        copies = many[r]
        which = np.repeat(begin[r], copies) + np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        shift = np.repeat(place - g.first[r], copies)
        yield s[which] + shift, e[which] + shift, q[which]
        half = g.left[r]
        size = np.where(half < g.words, 1, g.length[np.maximum(half - g.words, 0)])
        symbol = np.concatenate([symbol[derived & ~now], half, g.right[r]])
        at = np.concatenate([at[derived & ~now], place, place + size])


def maximal(s: np.ndarray, e: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches that are in no other of their period, each once."""
    order = np.lexsort((-e, s, q))
    s, e, q = s[order], e[order], q[order]
    new = np.ones(len(s), bool)
    if len(s):
        apart = np.cumsum(np.diff(q, prepend=q[0]) != 0) * (int(e.max()) + 1)
        far = np.maximum.accumulate(e + apart)
        new[1:] = (e + apart)[1:] > far[:-1]
    s, e, q = s[new], e[new], q[new]
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])  # of one stretch the smallest period counts
    return s[new], e[new], q[new]


def find_runs(w: Words, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, length, period) of all runs in a slice's texts, by words of the slice, in order of start and period."""
    none = (np.zeros(0, np.int64),) * 3
    if not len(w):
        return none
    at = np.flatnonzero(repeated_stretches(w, least))
    if not len(at):
        return none
    owner = w.owner(at)
    together = np.append((np.diff(at) == 1) & (owner[1:] == owner[:-1]), False)
    word = counted(w.hash[at])[0]
    own = counted(word * (int(owner.max()) + 1) + owner)[0]  # words of different texts are different symbols
    g = re_pair(own, together)
    ends = np.flatnonzero(~together) + 1
    ext = Extensions(own, int(np.diff(ends, prepend=0).max()))
    mid = g.first + np.where(g.left < g.words, 1, g.length[np.maximum(g.left - g.words, 0)] if len(g.left) else 0)
    rule, s, e, q = crossing(own, ext, Parts(g.first, mid, g.first + g.length), least)
    every = list(carried(g, rule, s, e, q))
    every += [crossing(own, ext, p, least)[1:] for p in halves(g.start, np.searchsorted(ends, g.start, side="right"), ends)]
    s, e, q = maximal(*(np.concatenate(x) for x in zip(*every, strict=True))) if every else none
    order = np.lexsort((q, s))
    return at[s[order]], (e - s)[order], q[order]


def collapse_runs(docs: DataFrame, text_col: str = "text", least: int = 12) -> DataFrame:
    """docs with n_words, runs and kept.

    runs: array of (start, length, period), by start and then period: each stretch of `least` words or more that holds
    its smallest period twice or more and that no neighbouring word extends with that period. Words count from 0; they
    are what white space parts. kept: the words, joined by one space, but those of a run after its first period.
    Null and empty texts have no words, an empty list of runs and an empty text. Rows, repeated ones too, are handled one
    by one, so ids and other columns may hold anything; columns of the results' names are replaced. A text is handled
    whole, with some 200 bytes for each word of its stretches that recur.
    """

    def make(b: pa.RecordBatch) -> list:
        total, offsets, runs, kept = [], [0], [], []
        texts = blobs(b.column(text_col))
        for w in slices(b.column(text_col), PLAIN):
            s, n, q = find_runs(w, least)
            owner = w.owner(s)
            gone = np.zeros(len(w) + 1, np.int64)
            np.add.at(gone, s + q, 1)
            np.add.at(gone, s + n, -1)
            gone = np.cumsum(gone) > 0
            has = np.zeros(w.hi - w.lo, bool)
            has[owner] = True
            for d, text in enumerate(texts[w.lo : w.hi]):
                own = (text or b"").split()
                if has[d]:
                    lo = int(w.first[d])
                    own = [own[k] for k in np.flatnonzero(~gone[lo : lo + len(own)]).tolist()]
                kept.append(b" ".join(own))
            total.append(w.counts)
            runs.append(np.stack([s - w.first[owner], n, q]))
            offsets += (offsets[-1] + np.cumsum(np.bincount(owner, minlength=w.hi - w.lo))).tolist()
        flat = np.concatenate(runs, axis=1) if runs else np.zeros((3, 0), np.int64)
        values = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in flat], RUN.names)
        return [pa.array(np.concatenate(total) if total else np.zeros(0, np.int64)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), pa.array(kept, pa.binary()).cast(pa.string())]

    return add_columns(docs, RESULT, make)
