"""Substring dedup with repeated-phrase automata.

1. Sampling. Every window of `window` words chooses the least hash among its `GRAM`-word grams. Equal windows choose
   the same gram at the same place, so windows are filed by that gram: a document becomes segments, runs of windows
   that chose the same gram, and only grams chosen twice in the corpus can hold recurring windows.
2. Confirmation. The words of such segments, equal ones counted together, are dealt to shards by gram. All occurrences
   of a window meet in its shard; runs of windows that occur twice or more are the recurring passages, its phrases.
3. Automata. Each shard compiles its phrases to an Aho-Corasick automaton, and the segments of all documents filed
   there stream through it: what matches is removed. A shard with very many segments is salted: its phrases are copied
   to several tasks that share its segments.

Shards hold a bounded number of segments, their number grows with the corpus. A gram with very many different segments
is not kept together: its windows are dealt singly, by their own hash. Hashes only decide where words meet; counts and
matches are of the words themselves.
"""

from __future__ import annotations

from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.llm.arrow import add_columns, expand, used
from limpid.llm.spark import discard, exact, free_name, id_key, materialise, partitions_for, shuffle_partitions
from limpid.llm.words import PLAIN, Words, sliding_argmin, slices

GRAM = 8
#: Different segments of one gram beyond which its windows are dealt singly.
WIDE = 2000
#: Different segments in a shard, about; and how many segments of documents a task streams through its automaton.
SHARD = 2_000
STREAM = 4 * SHARD

L, I, B = T.LongType(), T.IntegerType(), T.BinaryType()


def _schema(**kinds) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


SEGMENT = _schema(gram=L, seg=L, doc=L, dk=L, at=I, n=I)
UNIT = _schema(route=L, text=B, doc=L, dk=L, at=I)
PHRASE = _schema(shard=L, phrase=B)
PLACE = _schema(doc=L, dk=L, spans=T.ArrayType(I))
RESULT = _schema(n_words=L, n_removed=L, kept=T.StringType())


def segments_of(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a slice: first window, number of windows, gram."""
    gram = min(GRAM, window)
    if len(w) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    every = w.runs(np.arange(len(w) - gram + 1), gram)
    at, _ = w.starts_of(window)
    chosen = sliding_argmin(every, window - gram + 1)[at]
    first = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else np.zeros(0, np.int64)
    return at[first], np.diff(np.r_[first, len(at)]), every[chosen[first]]


def segments(own: DataFrame, window: int) -> DataFrame:
    def make(b: pa.RecordBatch):
        doc, dk = b.column(0).to_numpy(), b.column(1).to_numpy()
        for w in slices(b.column(2), PLAIN):
            at, n, gram = segments_of(w, window)
            if len(at):
                d = w.owner(at)
                yield {"gram": gram.view(np.int64), "seg": w.runs(at, n + window - 1).view(np.int64), "doc": doc[w.lo + d], "dk": dk[w.lo + d], "at": (at - w.first[d]).astype(np.int32), "n": n.astype(np.int32)}

    return expand(own.select("doc", "dk", "text"), SEGMENT, make)


def units(own: DataFrame, asked: DataFrame, window: int) -> DataFrame:
    """The words of the segments asked for (doc, dk, list of (gram, at, n, wide)); of wide grams, of each window."""

    def make(b: pa.RecordBatch):
        doc, dk, lists = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3)
        edge, entry = lists.offsets.to_numpy(), lists.values
        gram, at, n, wide = (entry.field(i).to_numpy(zero_copy_only=False) for i in range(4))
        for w in slices(b.column(2), PLAIN):
            own = slice(edge[w.lo], edge[w.hi])
            d = np.repeat(np.arange(w.hi - w.lo), np.diff(edge[w.lo : w.hi + 1]))
            # A segment of a wide gram becomes as many units of one window as it has windows.
            times = np.where(wide[own], n[own], 1)
            each = np.repeat(np.arange(len(times)), times)
            start = at[own][each] + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
            size = np.where(wide[own], 1, n[own])[each] + window - 1
            first = w.first[d[each]] + start
            single = wide[own][each]
            route = gram[own][each]
            route[single] = w.runs(first[single], window).view(np.int64)
            raw = w.data.tobytes()
            text = [b" ".join(raw[x:y].split()) for x, y in zip(w.start[first].tolist(), w.end[first + size - 1].tolist(), strict=True)]
            yield {"route": route, "text": text, "doc": doc[w.lo + d[each]], "dk": dk[w.lo + d[each]], "at": start.astype(np.int32)}

    asked = asked.select("doc", "dk", "asked").hint("shuffle_hash")
    return expand(own.join(asked, ["doc", "dk"]).select("doc", "dk", "text", "asked"), UNIT, make)


class Codes(dict):
    """Words as three characters each, from three alphabets, the first two of 100: automata stay narrow and matches
    whole words."""

    def __missing__(self, word: bytes) -> str:
        n = len(self)
        self[word] = code = chr(1 + n % 100) + chr(101 + n // 100 % 100) + chr(201 + n // 10_000)
        return code


def recurring(texts: list[bytes], counts: list[int], window: int) -> list[bytes]:
    """The passages of different texts, each with its count, that runs of recurring windows make up."""
    codes, size = Codes(), 3 * window
    words = [t.split(b" ") for t in texts]
    coded = ["".join([codes[x] for x in w]) for w in words]
    seen: Counter[str] = Counter()
    for t, n in zip(coded, counts, strict=True):
        for i in range(0, len(t) - size + 1, 3):
            seen[t[i : i + size]] += n
    found = set()
    for w, t in zip(words, coded, strict=True):
        begin = None
        for i in range(0, len(t) - size + 4, 3):
            if i + size <= len(t) and seen[t[i : i + size]] > 1:
                begin = i if begin is None else begin
            elif begin is not None:
                found.add(b" ".join(w[begin // 3 : (i + size) // 3 - 1]))
                begin = None
    return sorted(found)


def locate(phrases: list[bytes], texts: list[bytes]) -> list[list[int]]:
    """For each text the words that phrases cover, as flat [from, to, ...) lists."""
    if not phrases:
        return [[] for _ in texts]
    codes, automaton = Codes(), ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for p in phrases:
        automaton.add_word("".join([codes[x] for x in p.split(b" ")]))
    automaton.make_automaton()
    out, code = {}, codes.get
    for t in set(texts):
        spans: list[int] = []
        for end, n in automaton.iter("".join([code(x, "\0\0\0") for x in t.split(b" ")])):  # by their ends
            a, e = (end + 1 - n) // 3, (end + 1) // 3
            while spans and a <= spans[-1]:
                e, a = max(e, spans.pop()), min(a, spans.pop())
            spans += [a, e]
        out[t] = spans
    return [out[t] for t in texts]


def confirmed(got: DataFrame, window: int, tasks: int) -> DataFrame:
    """(shard, phrase) of the segments (shard, route, text, ..) of all documents."""

    def step(t: pa.Table) -> pa.Table:
        found = recurring(t["text"].to_pylist(), t["n"].to_pylist(), window)
        out = pa.table([pa.array([t["shard"][0].as_py()] * len(found), pa.int64()), pa.array(found, pa.binary())], PHRASE.names)
        used(t.num_rows)
        return out

    return got.groupBy("shard", "route", "text").agg(F.count("*").alias("n")).repartition(tasks, "shard").groupBy("shard").applyInArrow(step, PHRASE)


def located(got: DataFrame, phrases: DataFrame, most: int, tasks: int) -> DataFrame:
    """(doc, dk, spans): the words of documents that their segments' shard has phrases for. A task gets a shard's
    phrases and at most some `most` segments."""
    kinds = phrases.select("shard").distinct()
    shares = materialise(got.groupBy("shard").agg(F.ceil(F.count("*") / most).alias("k")).join(kinds, "shard"), "shares")
    salted = got.join(shares, "shard").withColumn("salt", F.pmod(F.xxhash64("doc", "at"), "k")).select("shard", "salt", "doc", "dk", "at", "text")
    copied = phrases.join(shares, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("salt"), "phrase")

    def step(segments: pa.Table, own: pa.Table) -> pa.Table:
        spans = locate(own["phrase"].to_pylist(), segments["text"].to_pylist())
        spans = [[x + a for x in s] for s, a in zip(spans, segments["at"].to_pylist(), strict=True)]
        out = segments.select(["doc", "dk"]).append_column("spans", pa.array(spans, pa.list_(pa.int32()))).filter(pa.array([bool(s) for s in spans], pa.bool_()))
        used(segments.num_rows)
        return out

    own, theirs = (x.repartition(tasks, "shard", "salt").groupBy("shard", "salt") for x in (salted, copied))
    return own.cogroup(theirs).applyInArrow(step, PLACE)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, wide: int = WIDE, shard: int = SHARD, most: int = STREAM) -> DataFrame:
    """docs with n_words, n_removed and kept: the words, joined by one space, that no recurring window covers.

    A window is `window` consecutive words; it recurs if its words also start anywhere else, in any row, the same one
    included. Null and empty texts have no words; shorter texts have no window. Ids are whole numbers or null. Repeated
    rows repeat each other. Columns of the results' names are replaced, all others are kept.
    """
    spark = docs.sparkSession
    own = docs.select(id_key(id_col).alias("doc"), F.xxhash64(id_col, text_col).alias("dk"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    every = materialise(segments(own, window), "segments")
    # Grams to join on are written first: with an exchange of its own on both sides, Spark can split a very common gram.
    twice = materialise(every.groupBy("gram").agg(F.count("*").alias("m")).filter("m > 1").select("gram"), "twice")
    again = materialise(every.join(twice, "gram"), "recurring")
    discard(spark, every, twice)
    different = materialise(again.groupBy("gram", "seg").agg(F.min("n").alias("n")).groupBy("gram").agg(F.count("*").alias("m"), F.sum("n").alias("n")), "different")
    broad = materialise(different.filter(F.col("m") > wide).select("gram", F.lit(True).alias("wide")), "broad")
    dealt = different.agg(F.coalesce(F.sum(F.when(F.col("m") > wide, F.col("n")).otherwise(F.col("m"))), F.lit(0)).alias("n")).first().n
    shards = max(partitions_for(dealt, shard), shuffle_partitions(spark))
    tasks = max(shards // 4, shuffle_partitions(spark))  # grow with the corpus

    entry = F.struct("gram", "at", "n", F.coalesce("wide", F.lit(False)).alias("wide"))
    asked = again.join(broad, "gram", "left").groupBy("doc", "dk").agg(F.collect_set(entry).alias("asked"))
    got = materialise(units(own, asked, window).withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards))), "units")
    discard(spark, again, different, broad)
    phrases = materialise(confirmed(got, window, tasks), "phrases")
    places = materialise(located(got, phrases, most, tasks), "places")
    discard(spark, got, phrases)
    doc, dk, spans = (free_name(docs, c) for c in ("phrase_doc", "phrase_row", "phrase_spans"))
    covered = places.groupBy("doc", "dk").agg(F.flatten(F.collect_set("spans")).alias("spans")).toDF(doc, dk, spans)
    base = docs.select(*[exact(c) for c in docs.columns if c not in RESULT.names], id_key(id_col).alias(doc), F.xxhash64(id_col, text_col).alias(dk))
    joined = base.join(covered.hint("shuffle_hash"), [doc, dk], "left")

    def keep(b: pa.RecordBatch) -> list:
        total, removed, kept = [], [], []
        found = b.column(spans)
        for w in slices(b.column(text_col), PLAIN):
            for d in range(w.hi - w.lo):
                lo, hi = int(w.first[d]), int(w.first[d + 1])
                gone = np.zeros(hi - lo + 1, np.int32)
                if (s := found[w.lo + d]).is_valid:
                    edges = np.asarray(s.values.to_numpy(zero_copy_only=False))
                    np.add.at(gone, edges[0::2], 1)
                    np.add.at(gone, edges[1::2], -1)
                left = np.flatnonzero(np.cumsum(gone[:-1]) == 0) + lo
                total.append(hi - lo)
                removed.append(hi - lo - len(left))
                kept.append(b" ".join([w.data[a:e].tobytes() for a, e in zip(w.start[left].tolist(), w.end[left].tolist(), strict=True)]).decode())
        return [total, removed, kept]

    return add_columns(joined, RESULT, keep).drop(doc, dk, spans)
