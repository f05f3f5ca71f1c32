"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is compiled. A text is parsed against each: the longest match
from where the last phrase ended is the next phrase. The fewer phrases a text needs, the lower its cross entropy,
phrases * log2(training bytes) / length, under that language; the least wins.

Only letters tell languages apart: whatever lies between them counts as one space. Texts are parsed in segments of
`SEGMENT` symbols, each from the automaton's root, which adds at most a phrase for each; many segments advance together
through the automata as tables.
"""

from __future__ import annotations

from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.llm.arrow import add_columns, blobs
from limpid.llm.spark import id_key
from limpid.llm.words import utf8

SEGMENT = 512
#: Bytes parsed together.
TOGETHER = 1 << 21
UNKNOWN = "und"
#: Symbols: A-Z as a-z, bytes beyond ASCII as they are, all else as a space.
SYMBOL = np.arange(256, dtype=np.int32)
SYMBOL[:128] = ord(" ")
SYMBOL[97:123] = SYMBOL[65:91] = np.arange(97, 123)

RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def fold_of(col: str, folds: int) -> Column:
    """crc32 of an id as text, by folds; a null id is an empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % folds


def symbols(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of texts, several spaces in a row as one, and where each text begins among them."""
    s = SYMBOL[data]
    gap = s == ord(" ")
    keep = np.ones(len(s), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    return s[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]


def suffix_automaton(text: list[int], width: int) -> array:
    """The transitions of the automaton of all substrings of a text, flat by state and symbol, -1 where there is none;
    state 0 is the root."""
    none = array("i", [-1]) * width
    go, link, length, last = array("i", none), [-1], [0], 0
    for c in text:
        new = len(link)
        go += none
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and go[p * width + c] < 0:
            go[p * width + c] = new
            p = link[p]
        if p >= 0:
            q = go[p * width + c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(link)
                go += go[q * width : (q + 1) * width]
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p * width + c] == q:
                    go[p * width + c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return go


class Automata:
    """All languages' automata in one table: step[state * width + symbol] is twice the next state's row, plus one if
    the phrase ended before the symbol."""

    def __init__(self, samples: tuple[tuple[str, bytes], ...]):
        self.langs = [lang for lang, _ in samples]
        texts = [symbols(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0].tolist() for _, x in samples]
        known = sorted({c for t in texts for c in t})
        code = {c: 1 + i for i, c in enumerate(known)}
        self.code = np.array([code.get(c, 0) for c in range(256)], np.int32)
        self.width, self.bits, tables, roots, base = len(known) + 1, np.log2([len(t) + 1 for t in texts]), [], [], 0
        for t in texts:
            table = np.frombuffer(suffix_automaton([code[c] for c in t], self.width), np.int32).reshape(-1, self.width)
            # One more state, after a symbol that the sample lacks, which is a phrase of its own.
            again = np.where(table[0] < 0, len(table), table[0])  # the phrase ends; the symbol begins the next
            ends = 2 * self.width * (base + again[None, :]) + 1
            table = np.concatenate([np.where(table < 0, ends, 2 * self.width * (base + table)), ends])
            table[0] = ends[0] - 1  # no phrase has begun
            roots.append(base * self.width)
            tables.append(table.astype(np.int32))
            base += len(table)
        self.step, self.roots = np.concatenate(tables).ravel(), np.array(roots, np.int32)

    def phrases(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """How many phrases each text needs in each language: texts by languages."""
        data, bounds = symbols(data, bounds)
        out = np.zeros((len(bounds) - 1, len(self.langs)), np.int64)
        size = np.diff(bounds)
        n = -(-size // SEGMENT)
        text = np.repeat(np.arange(len(size)), n)
        at = bounds[text] + SEGMENT * (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n))
        length = np.minimum(SEGMENT, bounds[text + 1] - at)
        order = np.argsort(-length, kind="stable")
        text, at, length = text[order], at[order], length[order]
        codes = self.code[data]
        lanes = np.repeat(self.roots[:, None], len(at), axis=1)
        ended = np.zeros(lanes.shape, np.int32)
        live = np.searchsorted(-length, -np.arange(SEGMENT), side="left")  # lanes that have a symbol at this step
        for k in range(int(length[0]) if len(length) else 0):
            m = live[k]
            nxt = self.step.take(lanes[:, :m] + codes[at[:m] + k])
            ended[:, :m] += nxt & 1
            lanes[:, :m] = nxt >> 1
        np.add.at(out, text, ended.T + 1)
        return out

    def judge(self, data: np.ndarray, bounds: np.ndarray) -> tuple[list[str], np.ndarray]:
        cost = self.phrases(data, bounds) * self.bits
        best = cost.argmin(axis=1)
        if len(self.langs) == 1:
            return [self.langs[0]] * len(best), np.ones(len(best))
        two = np.partition(cost, 1, axis=1)[:, :2]
        return [self.langs[i] for i in best], np.clip(1 - two[:, 0] / np.maximum(two[:, 1], 1e-9), 0, 1)


@cache
def automata(samples: tuple[tuple[str, bytes], ...]) -> Automata:
    """Compiled once for each worker process."""
    return Automata(samples)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, lang_bytes: int = 32_000, all_bytes: int = 400_000, rows: int = 400) -> tuple[tuple[str, bytes], ...]:
    """Labelled text by language, sorted, from rows outside fold 0.

    A bounded sample: by the order of a hash of the id, at most `rows` texts of a language whose total stays within
    lang_bytes, or within its share of all_bytes if there are many languages; the shortest text of a language that has
    only longer ones, cut to that size. Only rows whose hash lies in the first part of its range, where some 4 * `rows`
    of a language are expected, are ranked at all. The driver holds the languages' names and this sample.
    """
    known = docs.filter((fold_of(id_col, folds) != 0) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    known = known.select(F.col(lang_col).cast("string").alias("lang"), id_key(id_col).alias("doc"), F.octet_length(text_col).alias("n"), F.col(text_col).alias("text"))
    many = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not many:
        return ()
    size = max(1, min(lang_bytes, all_bytes // len(many)))
    hashed = F.xxhash64("doc", "n")
    upto = F.create_map(*[F.lit(x) for k, m in many.items() for x in (k, int(-(2**63) + min(1.0, 4 * rows / m) * (2**64 - 2**12)))])
    some = known.filter(hashed <= F.element_at(upto, F.col("lang"))).select("lang", "doc", "n").distinct()
    order = Window.partitionBy("lang").orderBy(F.when(F.col("n") > size, F.col("n")).otherwise(0), hashed, "doc", "n")
    ranked = some.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rows)
    within = Window.partitionBy("lang").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    ids = ranked.withColumn("total", F.sum("n").over(within)).filter((F.col("total") <= size) | (F.col("rank") == 1)).select("lang", "doc", "n", "rank")
    got = known.join(F.broadcast(ids), ["lang", "doc", "n"]).select("lang", "rank", F.substring("text", 1, size).alias("text")).dropDuplicates(["lang", "rank"]).collect()
    texts: dict[str, list] = {}
    for r in sorted(got, key=lambda r: (r.lang, r.rank)):
        texts.setdefault(r.lang, []).append(r.text.encode())
    return tuple((k, b"\n".join(v)[:size]) for k, v in sorted(texts.items()))


def identify(docs: DataFrame, samples: tuple[tuple[str, bytes], ...], text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (0: two languages are as near, 1: no other is near).

    A null text, one without a letter (of Unicode's categories L), and any text if nothing was learned, are `und` with
    score 0. Ties go to the language first in order. Columns of the results' names are replaced, all others are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(samples)

    def make(b: pa.RecordBatch) -> list:
        known = automata(shared.value) if shared.value else None
        column = b.column(text_col)
        data, off = utf8(column)
        langs, scores, lo, n = [], [], 0, len(off) - 1
        while lo < n and known:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + TOGETHER, side="right")) - 1)
            a, s = known.judge(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            langs += a
            scores += s.tolist()
            lo = hi
        for i, t in enumerate(blobs(column)):
            if not known:
                langs.append(UNKNOWN)
                scores.append(0.0)
            elif not t or not any(map(str.isalpha, t.decode())):
                langs[i], scores[i] = UNKNOWN, 0.0
        return [langs, scores]

    return add_columns(docs, RESULT, make)
