"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window of an item is the set of its shingles at their places. Shingles are ordered by how many documents hold them,
counted over all documents; as containment must be whole, one prefix token is enough: the rarest shingle of each
window. Documents are joined on these tokens alone; a match is then bounded by position and length (the window must lie
inside the document) and confirmed word by word over the window.

The items are the small side. Spark cuts them into windows, makes these distinct and measures what each takes; they are
taken in blocks of at most `block_bytes`, so that what is collected and broadcast at once never exceeds that bound,
however long the benchmark or one of its items is. Every block meets all documents.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.llm.arrow import add_columns, expand
from limpid.llm.spark import materialise
from limpid.llm.words import ALNUM, Words, cut, slices

#: Words in the shingles whose rarity is counted.
SHINGLE = 3
#: Bytes that a window takes in a block beside its words and its item's id: hashes, places, prefixes and counts.
EACH = 160
WINDOW = T.StructType([T.StructField("id", T.StringType()), T.StructField("words", T.BinaryType())])

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("hit_items", T.ArrayType(T.StringType())),
        T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)


def windows(items: DataFrame, window: int) -> DataFrame:
    """(id, words): the different windows of each item (id, text), words joined by one space."""

    def make(b: pa.RecordBatch):
        item, out = b.column(0).to_pylist(), {"id": [], "words": []}
        for w in slices(b.column(1), ALNUM):
            for d in range(w.hi - w.lo):
                lo, hi = int(w.first[d]), int(w.first[d + 1])
                n = min(window, hi - lo)
                own = {w.text(at, n, fold=True) for at in range(lo, hi - n + 1)} if n else set()
                out["id"] += [item[w.lo + d]] * len(own)
                out["words"] += own
        yield out

    return expand(items.distinct(), WINDOW, make).distinct()


def blocks_of(rows: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """rows with a block each, and how many blocks there are: as many as it takes that none is over `block_bytes`. A
    window that is longer by itself may be."""
    cost = F.octet_length("words") + F.octet_length("id") + EACH
    n = max(1, -(-(rows.agg(F.sum(cost).alias("n")).first().n or 0) // max(1, block_bytes // 2)))
    while True:
        out = rows.withColumn("block", F.pmod(F.xxhash64("id", "words"), F.lit(n)))
        most = out.groupBy("block").agg(F.sum(cost).alias("bytes"), F.count("*").alias("n")).filter(f"bytes > {block_bytes} and n > 1").head(1)
        if not most:
            return out, n
        n *= 2


class Items:
    """Windows of one block as arrays: their hashes, words and shingles, and the items that have each."""

    def __init__(self, rows: list[tuple[str, bytes]]):
        rows = sorted(rows, key=lambda r: (r[1], r[0]))
        words = sorted({x for _, x in rows})
        self.names = sorted({i for i, _ in rows})
        code, place = {x: k for k, x in enumerate(self.names)}, {x: k for k, x in enumerate(words)}
        self.codes = np.array([code[i] for i, _ in rows], np.int32)
        self.own = np.searchsorted([place[x] for _, x in rows], np.arange(len(words) + 1)) if rows else np.zeros(1, np.int64)
        self.blob, self.edge = b"".join(words), np.concatenate([[0], np.cumsum([len(x) for x in words])]).astype(np.int64)
        w = cut(np.frombuffer(self.blob, np.uint8), self.edge, ALNUM)
        self.n = w.counts
        at = w.first[:-1]
        self.hash = w.runs(at, self.n) if len(at) else np.zeros(0, np.uint64)
        #: For each size of shingle: (window, place in it, hash) of every shingle of the windows that use this size.
        self.shingles = {}
        for k in range(1, SHINGLE + 1):
            own = np.flatnonzero(np.minimum(self.n, SHINGLE) == k)
            count = self.n[own] - k + 1
            which = np.repeat(own, count)
            place = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            if len(which):
                self.shingles[k] = which, place, w.runs(at[which] + place, k)

    def words(self, v: int) -> bytes:
        return self.blob[self.edge[v] : self.edge[v + 1]]

    def items(self, v: int) -> set[str]:
        return {self.names[c] for c in self.codes[self.own[v] : self.own[v + 1]].tolist()}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "shingles"}  # the driver's alone

    def wanted(self) -> dict[int, np.ndarray]:
        return {k: np.unique(h) for k, (_, _, h) in self.shingles.items()}

    def prefixes(self, df: dict[tuple[int, int], int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each size of shingle, sorted by hash: the rarest shingle of each window, the window and its place there."""
        out = {}
        for k, (which, place, h) in self.shingles.items():
            rarity = np.array([df.get((k, int(x)), 0) for x in h.view(np.int64)], np.int64)
            order = np.lexsort((place, h, rarity, which))
            first = order[np.r_[True, np.diff(which[order]) > 0]]
            first = first[np.argsort(h[first], kind="stable")]
            out[k] = h[first], which[first], place[first]
        return out


def frequencies(docs: DataFrame, text_col: str, items: Items) -> dict[tuple[int, int], int]:
    """In how many documents each of the items' shingles occurs; no more rows than the items have shingles."""
    wanted = docs.sparkSession.sparkContext.broadcast(items.wanted())

    def count(b: pa.RecordBatch):
        for w in slices(b.column(0), ALNUM):
            for k, hashes in wanted.value.items():
                at, first = w.starts_of(k)
                h = w.runs(at, k)
                i = np.searchsorted(hashes, h)
                i[i == len(hashes)] = 0
                hit = np.flatnonzero(hashes[i] == h)
                owner = np.searchsorted(first, hit, side="right") - 1
                pairs = np.unique(owner.astype(np.int64) * len(hashes) + i[hit])
                got, n = np.unique(pairs % len(hashes), return_counts=True)
                yield {"k": np.full(len(got), k, np.int32), "h": hashes[got].view(np.int64), "n": n}

    rows = expand(docs.select(text_col), T.StructType([T.StructField("k", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("n", T.LongType())]), count)
    return {(r.k, r.h): r.n for r in rows.groupBy("k", "h").agg(F.sum("n").alias("n")).collect()}


def find(w: Words, items: Items, prefixes: dict) -> tuple[np.ndarray, np.ndarray]:
    """Places in w and windows of the items that occur there."""
    starts, windows = [], []
    for k, (token, window, place) in prefixes.items():
        at, first = w.starts_of(k)
        if not len(at):
            continue
        h = w.runs(at, k)
        left = np.searchsorted(token, h, side="left")
        some = np.flatnonzero(token[np.minimum(left, len(token) - 1)] == h)
        n = np.searchsorted(token, h[some], side="right") - left[some]
        row = np.repeat(some, n)
        j = np.repeat(left[some], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        doc = np.searchsorted(first, row, side="right") - 1
        s, v = at[row] - place[j], window[j]
        inside = (s >= w.first[doc]) & (s + items.n[v] <= w.first[doc + 1])  # position and length bounds
        s, v = s[inside], v[inside]
        same = w.runs(s, items.n[v]) == items.hash[v] if len(s) else np.zeros(0, bool)
        starts.append(s[same])
        windows.append(v[same])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s, v = np.concatenate(starts), np.concatenate(windows)
    real = np.array([w.text(a, items.n[x], fold=True) == items.words(x) for a, x in zip(s.tolist(), v.tolist(), strict=True)], bool)
    return s[real], v[real]


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 64 << 20) -> DataFrame:
    """docs with n_words, n_hit (words inside an occurrence of an item window), hit_items (sorted ids, as strings) and
    hit_spans (maximal runs of hit words, [from, to) in words).

    Null and empty texts have no words. Items of fewer than `window` words are one window; those without words, or
    with a null text, have none. An item with a null id counts under the id 'null'. Repeated rows get a result each;
    repeated items count once. Columns of the results' names are replaced, all others are kept.
    """
    spark = docs.sparkSession
    own = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    rows, blocks = blocks_of(materialise(windows(own, window), "windows"), block_bytes)
    out, begun = docs, False
    for k in range(blocks):
        block = Items([(r.id, bytes(r.words)) for r in rows.filter(F.col("block") == k).collect()])
        if not len(block.n):
            continue
        shared = spark.sparkContext.broadcast((block, block.prefixes(frequencies(docs, text_col, block))))
        out = add_columns(out, RESULT, lambda b, shared=shared, begun=begun: extend(b, text_col, *shared.value, begun))
        begun = True
    return out if begun else add_columns(docs, RESULT, lambda b: start(b, text_col))


def start(b: pa.RecordBatch, text_col: str) -> list:
    n = [w.counts for w in slices(b.column(text_col), ALNUM)]
    rows = b.num_rows
    return [pa.array(np.concatenate(n) if n else np.zeros(0, np.int64), pa.int64()), [0] * rows, [[]] * rows, [[]] * rows]


def extend(b: pa.RecordBatch, text_col: str, items: Items, prefixes: dict, begun: bool) -> list:
    """The results of earlier blocks of items, if there were any, and what one block adds."""
    hit, names, spans, words = [], [], [], []
    had_items, had_spans = (b.column(c).to_pylist() if begun else [()] * b.num_rows for c in ("hit_items", "hit_spans"))
    for w in slices(b.column(text_col), ALNUM):
        s, v = find(w, items, prefixes)
        got = defaultdict(set)
        for d, x in zip(w.owner(s).tolist(), v.tolist(), strict=True):
            got[d] |= items.items(x)
        cover = np.zeros(len(w) + 1, np.int64)
        np.add.at(cover, s, 1)
        np.add.at(cover, s + items.n[v], -1)
        for d in range(w.hi - w.lo):
            for a, e in had_spans[w.lo + d]:
                cover[w.first[d] + a] += 1
                cover[w.first[d] + e] -= 1
        inside = np.r_[0, np.cumsum(cover[:-1]) > 0].astype(np.int64)
        words += w.counts.tolist()
        total = np.concatenate([[0], np.cumsum(inside[1:])])
        n = total[w.first[1:]] - total[w.first[:-1]]
        for d in range(w.hi - w.lo):
            names.append(sorted({*had_items[w.lo + d], *got.get(d, ())}))
            edge = np.flatnonzero(np.diff(np.r_[0, inside[1 + w.first[d] : 1 + w.first[d + 1]], 0])).reshape(-1, 2).tolist() if n[d] else []
            spans.append(edge)
            hit.append(int(n[d]))
    return [words, hit, names, spans]
