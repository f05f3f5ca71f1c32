"""Language-model scoring with a log-frequency Bloom filter.

Unigrams and bigrams are counted over the training texts. A count c is kept as the level 1 + floor(log2 c); the filter
holds an n-gram once for each level up to its own, so a count is read back by probing level after level until one is
missing. The filter is cut into segments by the leading bits of a key. A segment has `bits_per_entry` bits for each of
its entries, however many there are, and is never gathered: texts are dealt into chunks, a chunk's different n-grams
travel to their segments, and the levels travel back as a byte each. Probabilities are smoothed from these. The base
score uses exact counts instead: the frequent words, at most `frequent` of them by a share of all tokens, are broadcast,
and the rest are joined.

Counts travel as sorted arrays of hashes by hash range, so a shuffled row is a block of n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from limpid.llm.arrow import expand, give_back, stream
from limpid.llm.langid import fold_of
from limpid.llm.spark import id_key, materialise, partitions_for, shuffle_partitions
from limpid.llm.words import FOLDED, Words, mix, slices

U = np.uint64
END, BEGIN = U(0x452821E638D01377), U(0xBE5466CF34E90C6C)
#: Bytes of text in a chunk, about.
CHUNK = 1 << 23
#: Bytes of text for each segment of the filter, about.
SEGMENT = 1 << 24
#: What is taken off a bigram's count, so that one seen once says less than one seen twice.
DISCOUNT = 0.75
HASHES = 4
#: Stands for a chunk in blocks of exact counts.
EXACT = -1

L = T.LongType()
#: keys and counts of a chunk's n-grams; or their levels, one byte each in the order of the keys, which are left out.
BLOCKS = T.StructType([T.StructField("chunk", L), T.StructField("order", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("keys", T.BinaryType()), T.StructField("counts", T.BinaryType())])
BLOCKS_ARROW = to_arrow_schema(BLOCKS)


def pairs(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * U(0x9E3779B97F4A7C15) + word * U(0xC2B2AE3D27D4EB4F) + U(2))


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A slice's tokens with the end of each text, what stands before each, and the first token of each text."""
    first = w.first + np.arange(len(w.first))
    word = np.insert(w.hash, w.first[1:], END)
    before = np.r_[BEGIN, word[:-1]]
    before[first[:-1]] = BEGIN
    return word, before, first


def grams(text: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of all texts, the pair that ends at each, and the first token of each text."""
    words, two, first, n = [np.zeros(0, U)], [np.zeros(0, U)], [np.zeros(1, np.int64)], 0
    for w in slices(text, FOLDED):
        word, before, own = tokens(w)
        words.append(word)
        two.append(pairs(before, word))
        first.append(own[1:] + n)
        n += len(word)
    return np.concatenate(words), np.concatenate(two), np.concatenate(first)


def _blocks(chunk: int, order: int, keys: np.ndarray, counts: np.ndarray, parts: int) -> pa.Table:
    """Sorted keys, cut into parts by their leading bits."""
    edge = np.searchsorted(keys >> U(32), np.arange(parts + 1, dtype=U) * U(2**32) // U(parts))
    some = np.flatnonzero(np.diff(edge))
    cut = lambda x: [x[edge[p] : edge[p + 1]].tobytes() for p in some]
    return pa.table([[chunk] * len(some), [order] * len(some), some, cut(keys), cut(counts.astype(np.int64))], schema=BLOCKS_ARROW)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def ngram_levels(own: DataFrame, size: int, bits_per_entry: int) -> DataFrame:
    """BLOCKS of own (chunk, held_out, text), `size` bytes of text: the exact counts of all unigrams (BEGIN counts texts), and for each chunk
    the levels of its different n-grams in a filter of all n-grams of the training texts."""
    n = shuffle_partitions(own.sparkSession)
    parts = max(4 * n, partitions_for(size, SEGMENT))

    def count(t: pa.Table) -> pa.Table:
        chunk, train = t["chunk"][0].as_py(), ~t["held_out"].to_numpy()
        word, two, first = grams(t["text"])
        used = np.repeat(train, np.diff(first))
        out = []
        for order, keys, times in ((1, np.r_[word, np.full(len(train), BEGIN)], np.r_[used, train]), (2, two, used)):
            keys, which = np.unique(keys, return_inverse=True)
            out.append(_blocks(chunk, order, keys, np.bincount(which, times), parts))
        give_back()
        return pa.concat_tables(out)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(*x) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(x, BLOCKS_ARROW, strict=True)], schema=BLOCKS_ARROW)

        def close(part: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            entries = []
            for order in (1, 2):
                some = [x for x in rows if x[1] == order]
                if some:
                    k, c = _merged([np.frombuffer(x[2], U) for x in some], [np.frombuffer(x[3], np.int64) for x in some])
                    keep = c > 0  # others are in held-out texts only
                    entries.append((k[keep], level(c[keep])))
                    if order == 1:
                        yield block(EXACT, 1, part, k[keep].tobytes(), c[keep].tobytes())
            segment = LogFrequencyFilter(*(np.concatenate(x) for x in zip(*entries, strict=True)), bits_per_entry)
            for chunk, order, k, _ in rows:
                yield block(chunk, order, part, None, segment.levels(np.frombuffer(k, U)).astype(np.uint8).tobytes())

        at, held = None, []
        for b in batches:  # by part
            for chunk, order, part, k, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if part != at and held:
                    yield from close(at, held)
                    held = []
                at = part
                held.append((chunk, order, k, c))
        if held:
            yield from close(at, held)

    counts = own.select("chunk", "held_out", "text").groupBy("chunk").applyInArrow(count, BLOCKS)
    return stream(counts.repartition(max(n, parts // 4), "part").sortWithinPartitions("part"), answer, BLOCKS)


def unigrams(blocks: DataFrame) -> DataFrame:
    """(h, c) for each different token."""

    def rows(b: pa.RecordBatch):
        for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            k, c = np.frombuffer(k, U), np.frombuffer(c, np.int64)
            yield {"h": k[k != BEGIN].view(np.int64), "c": c[k != BEGIN]}

    return expand(blocks.filter(F.col("chunk") == EXACT).select("keys", "counts"), T.StructType([T.StructField("h", L), T.StructField("c", L)]), rows)


def level(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(float))[1].astype(np.int64)


def probability(word: np.ndarray, pair: np.ndarray, before: np.ndarray, n: int, v: int, weight: float) -> np.ndarray:
    """Of a word after a context, by the levels of the word, the pair and the context. A level tells that a count is
    2**(level - 1) at least and 2**level - 1 at most. Words and pairs count for the least, contexts for the most, so that the
    pairs of a context never add up to more than it, nor words to more than all tokens: no more than 1 is given away."""
    least = lambda x: np.where(x > 0, 2.0 ** (x - 1), 0.0)
    alone = (least(word) + 0.1) / (n + 0.1 * (v + 1))
    after = np.maximum(least(pair) - DISCOUNT, 0) / np.maximum(2.0**before - 1, 1)
    return np.where(before > 0, weight * after + (1 - weight) * alone, alone)


class LogFrequencyFilter:
    """Levels of n-grams in one bit array, with bits_per_entry bits or more for each level of each key."""

    def __init__(self, keys: np.ndarray, levels: np.ndarray, bits_per_entry: int):
        self.bits = 1 << 13
        while self.bits < bits_per_entry * int(levels.sum()):
            self.bits *= 2
        flags = np.zeros(self.bits, bool)
        for j in range(1, int(levels.max(initial=0)) + 1):
            for p in self.places(keys[levels >= j], j):
                flags[p] = True
        self.data = np.packbits(flags, bitorder="little")

    def places(self, keys: np.ndarray, step: int) -> Iterator[np.ndarray]:
        """The bits of each key for one level."""
        h = mix(keys + U(step * 0x9E3779B97F4A7C15 % 2**64))
        a, b = h & U(0xFFFFFFFF), (h >> U(32)) | U(1)
        for _ in range(HASHES):
            yield (a & U(self.bits - 1)).astype(np.int64)
            a = a + b

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key, 0 if it isn't held; never below the true one."""
        out, left, j = np.zeros(len(keys), np.int64), np.arange(len(keys)), 1
        while len(left) and j < 64:
            own, hit = keys[left], np.ones(len(left), bool)
            for p in self.places(own, j):
                hit &= (self.data[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0
            left = left[hit]
            out[left] = j
            j += 1
        return out


RESULT = T.StructType([T.StructField(c, L) for c in ("n_tokens", "n_known", "rare")] + [T.StructField(c, T.DoubleType()) for c in ("base", "score")])


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, weight: float = 0.5, frequent: int = 1 << 20, bits_per_entry: int = 12) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    Fold 0 by crc32 of the id is held out of training. A null or empty text is one end token. Repeated rows train as
    often as they stand and are scored alike. Without training texts all counts are 0.

    score: log10 of probability(), summed over tokens: weight * (count(before, word) - DISCOUNT) / count(before) + (1 -
    weight) * (count(word) + 0.1) / (N + 0.1 (V + 1)), by the levels that the filter gives; the latter alone after a word that
    it doesn't hold. It holds all bigrams, those seen once too. Of those that it doesn't hold some are found at level 1, with
    12 bits an entry one in 150 at most. Ids are whole numbers or null.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text) + 1).alias("n")).first().n or 0
    chunks = partitions_for(size, CHUNK)
    own = docs.select(F.col(id_col).alias("id"), id_key(id_col).alias("doc"), F.xxhash64(id_col, text_col).alias("dk"), (fold_of(id_col, folds) == 0).alias("held_out"), text.alias("text"))
    own = own.withColumn("chunk", F.pmod("dk", F.lit(chunks)))
    blocks = materialise(ngram_levels(own, size, bits_per_entry), "ngrams")
    known = unigrams(blocks)
    stats = known.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = int(stats.n), int(stats.v)
    often = known.filter(F.col("c") >= max(1, n / frequent)).toArrow().sort_by("h")  # at most `frequent` words
    top_h, top_c = often["h"].to_numpy(), often["c"].to_numpy()
    order = np.argsort(top_h.astype(U))
    shared = spark.sparkContext.broadcast((top_h.astype(U)[order], top_c[order]))
    del often

    def exact(word: np.ndarray) -> np.ndarray:
        """Counts of the frequent words, 0 for all others."""
        h, c = shared.value
        if not len(h):
            return np.zeros(len(word), np.int64)
        i = np.minimum(np.searchsorted(h, word), len(h) - 1)
        return np.where(h[i] == word, c[i], 0)

    scored = T.StructType([f for f in own.schema if f.name not in ("text", "chunk")] + list(RESULT))

    def make(texts: pa.Table, levels: pa.Table) -> pa.Table:
        """The rows of a chunk, given the levels of its different n-grams."""
        levels = levels.sort_by([("order", "ascending"), ("part", "ascending")])
        q = [np.frombuffer(b"".join(x for x, o in zip(levels["counts"].to_pylist(), levels["order"].to_pylist(), strict=True) if o == order), np.uint8).astype(np.int64) for order in (1, 2)]
        word, two, first = grams(texts["text"])
        one, which = np.unique(np.r_[word, BEGIN], return_inverse=True)
        pair = np.unique(two, return_inverse=True)[1]
        begin, which = which[-1], which[:-1]
        before = np.r_[begin, which[:-1]]
        before[first[:-1]] = begin
        c, p = exact(one)[which], probability(q[0][which], q[1][pair], q[0][before], n, v, weight)
        add = lambda x: np.add.reduceat(x, first[:-1])
        new = (np.diff(first), add((c > 0).astype(np.int64)), add((c == 0).astype(np.int64)), add(np.where(c > 0, np.log10(c + 0.1), 0.0)), add(np.log10(p)))
        give_back()
        return pa.table([*(texts[f.name] for f in scored if f.name in texts.column_names), *map(pa.array, new)], names=scored.names)

    def rest(b: pa.RecordBatch):
        dk = b.column(0).to_numpy()
        for w in slices(b.column(1), FOLDED):
            word, _, first = tokens(w)
            one, which = np.unique(word, return_inverse=True)
            rare = np.flatnonzero((exact(one) == 0)[which])
            yield {"dk": dk[w.lo + np.searchsorted(first, rare, side="right") - 1], "h": word[rare].view(np.int64)}

    levels = blocks.filter(F.col("chunk") != EXACT).select("chunk", "order", "part", "counts")
    tasks = max(chunks, shuffle_partitions(spark))  # so that a task has about a chunk, however many there are
    dealt = [x.repartition(tasks, "chunk").groupBy("chunk") for x in (own, levels)]
    per_row = materialise(dealt[0].cogroup(dealt[1]).applyInArrow(make, scored), "scores")
    rare = expand(own.select("dk", "text"), T.StructType([T.StructField("dk", L), T.StructField("h", L)]), rest)
    log = F.log10(F.coalesce("c", F.lit(0)) + 0.1)
    more = rare.join(known.hint("shuffle_hash"), "h", "left").groupBy("dk").agg(F.sum(log).alias("more"), F.count("c").alias("found"), F.count("*").alias("all"))
    share = F.col("rare") / F.col("all")  # rows equal in id and text added theirs, too
    full = per_row.join(more, "dk", "left")
    return full.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce(F.round(F.col("found") * share), F.lit(0)).cast("long")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce(F.col("more") * share, F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(n + 0.1 * (v + 1)))).alias("base_score"),
        "score",
    )
