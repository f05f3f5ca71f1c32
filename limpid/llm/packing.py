"""Best-fit packing: bounded-space online best-fit over tokenised documents.

Pieces of documents arrive one by one; a fixed number of bins is open, their free spaces in a bitset. A piece goes to
the open bin that it fills best; if it fits none, a bin is opened, and if too many are open the fullest closes first.
Every task packs its own, equal share of the pieces, some 100,000, so a task's open bins at its end are few beside
those it filled. The packer never looks ahead nor moves a piece. Only the order in which pieces reach it is chosen: a
task reads its share in the order of ids, so that a task run again packs alike, and hands over blocks of it, the longest
pieces first, which best-fit packs better.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.llm.arrow import expand, stream
from limpid.llm.spark import materialise, partitions_for
from limpid.llm.words import PLAIN, Words, slices

#: Words whose ids a worker remembers; beyond, it forgets all and begins anew.
REMEMBERED = 800_000
#: How a word is preceded, mixed into its key: by nothing, a space, a line break.
BEFORE = {"": np.uint64(0), " ": np.uint64(0x6A09E667F3BCC908), "\n": np.uint64(0xBB67AE8584CAA73B)}
#: White space beyond ASCII, in UTF-8, by its first byte. Fixed values of Unicode.
WIDE_SPACE = {
    0xC2: (b"\xc2\x85", b"\xc2\xa0"),
    0xE1: (b"\xe1\x9a\x80",),
    0xE2: (*(bytes((0xE2, 0x80, x)) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), b"\xe2\x81\x9f"),
    0xE3: (b"\xe3\x80\x80",),
}


class Encoder:
    """Token ids of many texts at once.

    The tokenizer's own library sets what is right; its vocabulary as ranks gives the same ids sooner. In a text whose
    words are parted by single spaces and line breaks alone, a token never reaches over such a space and a lone line
    break is a token of its own, so ids follow word by word: each different word is encoded once and remembered. Other
    texts are encoded whole, and texts with the string of a special token by the library itself.
    """

    def __init__(self, path: str, ranks_path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            self.path, self.library, self.special = path, None, [x["content"].encode() for x in json.load(f).get("added_tokens", [])]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(n) for a, n in map(bytes.split, f)}
        core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.plain, self.single = core.encode_ordinary, core._core_bpe.encode_single_piece
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.n, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def whole(self, text: bytes) -> np.ndarray:
        if not any(x in text for x in self.special):
            return np.array(self.plain(text.decode()), np.uint32)
        if self.library is None:  # loaded when first needed, as it is large
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return np.array(self.library.encode(text.decode(), add_special_tokens=False).ids, np.uint32)

    def _word(self, before: str, word: str) -> list[int]:
        if before != "\n" and word.isalpha():
            return self.single((before + word).encode())
        return self.plain(before + word)

    def _learn(self, keys: np.ndarray, words: list[tuple[str, str]]) -> None:
        if len(self.keys) + len(keys) > REMEMBERED:
            self._forget()
        ids = [self._word(*x) for x in words]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        at = len(self.ids) + np.cumsum(n) - n
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum()))])
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.n = np.insert(self.keys, place, keys), np.insert(self.at, place, at), np.insert(self.n, place, n)

    def _irregular(self, w: Words, gap: np.ndarray, first: np.ndarray) -> set[int]:
        """Texts that must be encoded whole."""
        b = w.data
        bad = np.flatnonzero(~first & ((gap != 1) | ~np.isin(b[np.maximum(w.start - 1, 0)], (32, 10))))
        out = set(w.owner(bad).tolist())
        some = w.counts > 0
        lo, hi = w.first[:-1][some], w.first[1:][some] - 1
        out |= set(np.flatnonzero(some)[(w.start[lo] != w.bounds[:-1][some]) | (w.end[hi] != w.bounds[1:][some])].tolist())
        out |= set(np.flatnonzero(~some & (np.diff(w.bounds) > 0)).tolist())
        raw = b.tobytes()
        for x, codes in WIDE_SPACE.items():
            for i in np.flatnonzero(b == x).tolist():
                if raw[i : i + 3].startswith(codes):
                    out.add(int(np.searchsorted(w.bounds, i, side="right")) - 1)
        for x in self.special:
            i = raw.find(x)
            while i >= 0:
                out.add(int(np.searchsorted(w.bounds, i, side="right")) - 1)
                i = raw.find(x, i + 1)
        return out

    def __call__(self, w: Words) -> Iterator[np.ndarray]:
        """The ids of each text of w, which has words between ASCII white space."""
        first = np.zeros(len(w), bool)
        first[w.first[:-1][w.counts > 0]] = True
        before = np.where(first, 0, w.data[np.maximum(w.start - 1, 0)]) if len(w) else np.zeros(0, np.uint8)
        gap = np.r_[1, w.start[1:] - w.end[:-1]] if len(w) else before
        odd = self._irregular(w, gap, first)
        key = w.hash.copy()
        for c, mark in BEFORE.items():
            if c:
                key[before == ord(c)] ^= mark
        key, sample, which = np.unique(key, return_index=True, return_inverse=True)

        def place() -> tuple[np.ndarray, np.ndarray]:
            i = np.searchsorted(self.keys, key)
            i[i == len(self.keys)] = 0
            return i, self.keys[i] == key if len(self.keys) else np.zeros(len(key), bool)

        i, known = place()
        if not known.all():
            if len(self.keys) + int((~known).sum()) > REMEMBERED:
                self._forget()
                known[:] = False
            new = sample[~known].tolist()
            self._learn(key[~known], [(chr(before[j]) if before[j] in (10, 32) else "", w.data[w.start[j] : w.end[j]].tobytes().decode()) for j in new])
            i, _ = place()
        n = self.n[i][which]
        ends = np.cumsum(n)
        flat = self.ids[np.repeat(self.at[i][which] - (ends - n), n) + np.arange(ends[-1])] if len(n) else self.ids[:0]
        edge = np.r_[0, ends]
        for d in range(w.hi - w.lo):
            if d in odd:
                yield self.whole(w.data[w.bounds[d] : w.bounds[d + 1]].tobytes())
            else:
                yield flat[edge[w.first[d]] : edge[w.first[d + 1]]]


@cache
def encoder(path: str, ranks_path: str, pattern: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path, ranks_path, pattern)


PIECES = T.StructType([T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]])


def pieces(docs: DataFrame, id_col: str, text_col: str, size: int, path: str, ranks_path: str, pattern: str, end_id: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32): documents as pieces of at most `size` tokens; of longer ones the first is short."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *PIECES])
    last = end_id.to_bytes(4, "little")

    def make(b: pa.RecordBatch):
        encode = encoder(path, ranks_path, pattern)
        doc = b.column(0).to_pylist()
        for w in slices(b.column(1), PLAIN, 1 << 20):
            out = {k: [] for k in schema.names}
            for d, found in zip(doc[w.lo : w.hi], encode(w), strict=True):
                ids = found.tobytes() + last
                n = len(ids) // 4
                cuts = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
                for k, (a, e) in enumerate(zip(cuts, cuts[1:])):  # noqa: B905
                    for c, v in zip(out, (d, k, a, e - a, zlib.crc32(ids[4 * a : 4 * e])), strict=True):
                        out[c].append(v)
            yield out

    return expand(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), schema, make)


class OpenBins:
    """At most `most` open bins; bit f of `free` is set if an open bin has f tokens left."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.open, self.made, self.free = size, most, 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, f: int) -> int:
        own = self.bins[f]
        x = own.pop()
        if not own:
            self.free ^= 1 << f
        self.open -= 1
        return x

    def _put(self, x: int, f: int) -> None:
        if f:
            self.bins[f].append(x)
            self.free |= 1 << f
            self.open += 1

    def place(self, n: int) -> tuple[int, int]:
        """The bin and the offset for a piece of n tokens."""
        if fits := self.free >> n:
            f = n + (fits & -fits).bit_length() - 1
            x = self._take(f)
        else:
            if self.open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            x, f = self.made, self.size
            self.made += 1
        self._put(x, f - n)
        return x, self.size - f


def pack(docs: DataFrame, path: str, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, most_open: int = 4096, block: int = 1 << 16, per_task: int = 1 << 17) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row.

    A null or empty text is the end id alone. Repeated rows and rows without an id are packed like any other. Sequences
    are numbered by task and order, gapless within, with no meaning beyond that.
    """
    cut = materialise(pieces(docs, id_col, text_col, size, path, ranks_path, pattern), "pieces")
    tasks = partitions_for(cut.count(), per_task)
    schema = T.StructType([T.StructField(id_col, cut.schema["id"].dataType), *PIECES, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base, held = OpenBins(size, most_open), TaskContext.get().partitionId() << 40, []

        def place() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).sort_by([("length", "descending"), ("ids_crc32", "ascending")]).combine_chunks()
            put = [bins.place(n) for n in t["length"].to_pylist()]
            t = t.append_column("sequence_id", pa.array([base + x for x, _ in put], pa.int64())).append_column("offset", pa.array([o for _, o in put], pa.int64()))
            yield from t.rename_columns(schema.names).to_batches()

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= block:
                yield from place()
                held = []
        if held and sum(x.num_rows for x in held):
            yield from place()

    return stream(cut.repartition(tasks).sortWithinPartitions("id", "piece", "ids_crc32"), step, schema)
