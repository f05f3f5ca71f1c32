"""Words of many texts at once, as NumPy arrays over the UTF-8 bytes of an Arrow column.

Each text is cut into words by the class of its bytes; words get 64-bit hashes, and so does any run of words, in
constant time, from prefix sums of a polynomial. Hashes find candidates; operators confirm them on the words
themselves where a contract asks for exact results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes handled at once; a longer text is handled alone.
SLICE_BYTES = 1 << 19

SPACES = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Alphabet:
    """Which bytes belong to words, and whether A-Z count as a-z."""

    word: bytes
    fold: bool

    @property
    def is_word(self) -> np.ndarray:
        return _is_word(self.word)

    @property
    def codes(self) -> np.ndarray:
        return _codes(self.fold)


@cache
def _is_word(word: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(word)] = True
    return out


@cache
def _codes(fold: bool) -> np.ndarray:
    codes = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
    if fold:
        codes[65:91] = codes[97:123]
    return codes


NON_SPACE = bytes(b for b in range(256) if b not in SPACES)
#: Words between white space, unchanged.
PLAIN = Alphabet(NON_SPACE, False)
#: Words between white space, A-Z lower-cased.
FOLDED = Alphabet(NON_SPACE, True)
#: Runs of letters, digits and non-ASCII characters, A-Z lower-cased.
ALNUM = Alphabet(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]), True)

_BASE = {"byte": 0x9E3779B97F4A7C15, "word": 0xD6E8FEB86659FD93}


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 2**64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, min(2 * self.n, self.n + (1 << 18)), 1 << 16)
            self.p, self.q = (np.cumprod(np.concatenate([[U(1)], np.full(self.n - 1, x, U)])) for x in (U(self.base), U(self.inverse)))
        return self.p[:n], self.q[:n]


@cache
def _powers(kind: str) -> _Powers:
    return _Powers(_BASE[kind])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads all bits."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


@dataclass
class Words:
    """Words of the texts lo..hi-1 of a column. Word w covers data[start[w]:end[w]]; text d has words first[d]..first[d+1]-1."""

    lo: int
    hi: int
    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    _sums: np.ndarray | None = field(default=None, repr=False)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def runs(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Hashes of the runs of `length` words that start at the words `at`."""
        _, q = _powers("word").upto(len(self) + 1)
        if self._sums is None:
            p, _ = _powers("word").upto(len(self) + 1)
            self._sums = np.zeros(len(self) + 1, U)
            np.cumsum(self.hash * p[:-1], out=self._sums[1:])
        h = (self._sums[at + length] - self._sums[at]) * q[at]
        h += np.asarray(length).astype(U) * U(0x2545F4914F6CDD1D)
        return mix(h)

    def starts_of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of k words start, text by text, and the first of them for each text (hi - lo + 1 numbers)."""
        n = np.maximum(self.counts - (k - 1), 0)
        first = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(first[-1]) + np.repeat(self.first[:-1] - first[:-1], n)
        return at, first

    def text(self, w: int, n: int = 1, fold: bool = False) -> bytes:
        """Words w..w+n-1, joined by one space."""
        out = b" ".join([self.data[a:b].tobytes() for a, b in zip(self.start[w : w + n], self.end[w : w + n], strict=True)])
        return out.lower() if fold else out

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The texts (from lo on) that hold the words `at`."""
        return np.searchsorted(self.first, at, side="right") - 1


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array | pa.ChunkedArray, alphabet: Alphabet, limit: int = SLICE_BYTES) -> Iterator[Words]:
    """The words of a column, a few texts at a time, in order."""
    data, off = utf8(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield cut(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], alphabet, lo)
        lo = hi


def cut(data: np.ndarray, bounds: np.ndarray, alphabet: Alphabet, lo: int = 0) -> Words:
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = alphabet.is_word[data]
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edge = bounds[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begins[edge] = inside[edge + 1]  # a text's end also ends its last word
    ends[edge - 1] = inside[edge]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    p, q = _powers("byte").upto(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(alphabet.codes[data] * p[:n], out=sums[1:])
    h = mix((sums[end] - sums[start]) * q[start] + (end - start).astype(U) * U(0x2545F4914F6CDD1D))
    return Words(lo, lo + len(bounds) - 1, data, bounds, start, end, np.searchsorted(start, bounds), h)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each i up to len - width: the leftmost place of the least of values[i:i+width]."""
    at, value, span = np.arange(len(values)), values, 1
    while 2 * span <= width:
        right = value[span:] < value[:-span]
        at, value = np.where(right, at[span:], at[:-span]), np.where(right, value[span:], value[:-span])
        span *= 2
    if rest := width - span:
        at = np.where(value[rest:] < value[:-rest], at[rest:], at[:-rest])
    return at
