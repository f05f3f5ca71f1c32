"""The most similar text of a block for each text, without scoring all pairs of the block.

First an index of segments tells near texts. Of two texts with at most k edits between them, one of k + 1 segments of the
one is in the other, unchanged and at most k places off. So texts of the right side are filed under their segments, by
block, length, number of the segment and its letters, and left texts look up the pieces of themselves that a near text's
segments may be. What is found is scored. A text that wasn't found has more than k edits, which bounds its score; a left
text whose best score is over that bound is settled, and so are nearly all that have a real partner.

The others meet the texts of their block in cells of a bounded number of both, dealt by hash, so that a block of any size
is spread over tasks. In a cell, counts of letters bound the score of each pair: the letters two texts share are all that
can match, and those they don't share have to be edited. Pairs are scored from the highest bound on, until no bound is
over the best score, or equal to it for a text that comes before the best. So the best is exact, the first of equals.
Cells of many texts are searched by a tree of their letters (limpid.functions.nearest), which bounds whole subtrees.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.functions.fuzzy import jaro_many, levenshtein_many, score, score_by, score_most
from limpid.functions.nearest import DEEP, nearest
from limpid.storage import discard, written

#: Texts of a cell, of either side, and letters a text that they may have on average.
LEFT, RIGHT, LONG = 4096, 32768, 64
#: Right texts from which on the tree pays, and texts of either side that search() takes at once.
MANY, FEW, SOME = 512, 512, 2048
#: Edits that the index finds at most, one for so many letters; segments with more texts than this are left to cells.
EDITS, LETTERS, WIDE = 3, 6, 32
#: Pairs scored at first for each text of a cell.
FIRST = 1


def edits(length: Column) -> Column:
    return F.least(F.floor(length / LETTERS), F.lit(EDITS)).cast("int")


def _segment(n: Column, k: Column, i: Column) -> tuple[Column, Column]:
    """Where the i-th of k + 1 segments of n letters begins (from 0) and how long it is; the last ones are the longest."""
    size, longer = F.floor(n / (k + 1)), n % (k + 1)
    first_long = k + 1 - longer
    return (i * size + F.greatest(i - first_long, F.lit(0))).cast("int"), (size + F.when(i >= first_long, 1).otherwise(0)).cast("int")


def segments(texts: DataFrame, on: list[str]) -> DataFrame:
    """(*on, n, i, piece, b): the segments of right texts, for as many edits as texts of their length may have."""
    n = F.length("b")
    k = edits(n)
    i = F.explode(F.sequence(F.lit(0), k)).alias("i")
    rows = texts.select(*on, "b", n.alias("n"), k.alias("k"), i)
    at, size = _segment(F.col("n"), F.col("k"), F.col("i"))
    return rows.select(*on, "n", "i", F.substring("b", at + 1, size).alias("piece"), "b")


def lookups(left: DataFrame, on: list[str]) -> DataFrame:
    """(*on, n, i, piece, a): pieces of left texts that may be segments of texts of n letters. With k edits in all there is
    an i-th segment with at most i of them before it and k - i after it, which tells how far it can have moved."""
    x = F.length("a")
    rows = left.select(*on, "a", x.alias("x"), F.explode(F.sequence(F.greatest(x - EDITS, F.lit(0)), x + EDITS)).alias("n"))
    rows = rows.withColumn("k", edits(F.col("n"))).filter(F.abs(F.col("n") - F.col("x")) <= F.col("k"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
    at, size = _segment(F.col("n"), F.col("k"), F.col("i"))
    after, moved = F.col("k") - F.col("i"), F.col("x") - F.col("n")
    first = F.greatest(at - F.col("i"), at + moved - after, F.lit(0))
    last = F.least(at + F.col("i"), at + moved + after, F.col("x") - size)
    rows = rows.withColumn("size", size).withColumn("from", F.when(last >= first, F.sequence(first, last)))
    return rows.select(*on, "a", "n", "i", "size", F.explode("from").alias("at")).select(*on, "n", "i", F.substring("a", F.col("at") + 1, F.col("size")).alias("piece"), "a").distinct()


def _bound(a: Column) -> Column:
    """The highest score with a text that lookups() of `a` can't find: of each length, more edits than it may have."""
    x = F.length(a)
    # A text of n letters has more than edits(n) edits to `a`, and more than the lengths differ by.
    at_most = lambda n: F.floor(100 * (1 + F.greatest(1 - F.greatest(edits(n) + 1, F.abs(n - x)) / F.greatest(n, x, F.lit(1)), F.lit(0))) / 2 + 0.5 + 1e-9)
    # Lengths that differ by more score less than those that differ by EDITS + 1.
    return F.array_max(F.transform(F.sequence(F.greatest(x - EDITS - 1, F.lit(0)), x + EDITS + 1), at_most)).cast("int")


def looked_up(left: DataFrame, texts: DataFrame, on: list[str]) -> DataFrame:
    """(*on, a, found (score, ord, b, r), settled, scored): what the index tells of each left text."""
    filed = written(segments(texts, on), "segments")
    key = [*on, "n", "i", "piece"]
    wide = filed.groupBy(*key).count().filter(F.col("count") > WIDE).select(*key, F.lit(True).alias("wide"))
    asked = written(lookups(left, on).join(wide, key, "left"), "lookups")
    pairs = asked.filter("wide IS NULL").join(filed, key).select(*on, "a", "b").distinct()
    near = pairs.filter(F.levenshtein("a", "b") <= edits(F.length("b"))).withColumn("score", score(F.col("a"), F.col("b")))
    near = near.join(texts, [*on, "b"])
    best = near.groupBy(*on, "a").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("r.ord").alias("o"), "b", "r")).alias("x"), F.count("*").alias("scored"))
    blurred = asked.filter("wide").select(*on, "a", F.lit(True).alias("blurred")).distinct()
    out = left.join(best, [*on, "a"], "left").join(blurred, [*on, "a"], "left")
    settled = F.coalesce(F.col("blurred").isNull() & (-F.col("x.s") > _bound(F.col("a"))), F.lit(False))
    out = written(out.select(*on, "a", "x", F.coalesce("scored", F.lit(0)).alias("scored"), settled.alias("settled")), "looked")
    discard(left.sparkSession, filed, asked)
    return out


def search(a: list[str], b: list[str], over: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of a: the best score over `over`, the number in b of the first text that has it (-1: none), and how many
    pairs were scored."""
    x, y = np.array([len(v) for v in a]), np.array([len(v) for v in b])
    bound, edits = score_most(a, b)
    order = np.argsort(-bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, 1)
    best, where, scored = over.astype(np.int64), np.full(len(a), -1), np.zeros(len(a), np.int64)
    left, lo, step = np.arange(len(a)), 0, FIRST
    while lo < len(b) and len(left):
        u, c = bound[left, lo : lo + step], order[left, lo : lo + step]
        i, j = np.nonzero((u > best[left, None]) | (u == best[left, None]) & (c < where[left, None]))
        i, j = left[i], c[i, j]
        mine, theirs, d = [a[k] for k in i.tolist()], [b[k] for k in j.tolist()], edits[i, j]
        if len(long := np.flatnonzero(x[i] > 64)):
            d[long] = levenshtein_many([mine[k] for k in long.tolist()], [theirs[k] for k in long.tolist()])
        s = score_by(jaro_many(mine, theirs, True), d, np.maximum(x[i], y[j]))
        np.add.at(scored, i, 1)
        top = np.lexsort((j, -s, i))
        i, j, s = i[top], j[top], s[top]
        first = np.diff(i, prepend=-1) != 0
        i, j, s = i[first], j[first], s[first]
        better = (s > best[i]) | (s == best[i]) & (j < where[i])
        best[i[better]], where[i[better]] = s[better], j[better]
        left = left[u[:, -1] >= best[left]]  # bounds only fall
        lo, step = lo + step, 2 * step
    return best, where, scored


def best_of(a: list[str], b: list[str], over: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As search(), for any number of texts; b are all different. Of many texts, those that a tree takes are searched so."""
    best, where, scored = over.astype(np.int64), np.full(len(a), -1), np.zeros(len(a), np.int64)

    def found(how, mine: np.ndarray, theirs: np.ndarray) -> None:
        if len(mine) and len(theirs):
            s, j, n = how([a[k] for k in mine.tolist()], [b[k] for k in theirs.tolist()], best[mine])
            j = np.where(j >= 0, theirs[j], -1)
            # Scores over what was known, or as high and of a text that comes before.
            better = (j >= 0) & ((s > best[mine]) | (where[mine] >= 0) & (j < where[mine]))
            best[mine[better]], where[mine[better]] = s[better], j[better]
            scored[mine] += n

    def in_parts(mine: np.ndarray, theirs: np.ndarray) -> None:
        for lo in range(0, len(theirs), SOME):
            for i in range(0, len(mine), FEW):
                found(again, mine[i : i + FEW], theirs[lo : lo + SOME])

    # A text found before may be beaten by an equal one that comes before it, so what scores as high is looked for as well.
    again = lambda x, y, known: search(x, y, known - 1)
    x, y = (np.array([len(v) for v in t], np.int64) for t in (a, b))
    mine, theirs = (x > 0) & (x <= DEEP), (y > 0) & (y <= DEEP)
    if theirs.sum() < MANY:
        mine[:] = False
    found(nearest, np.flatnonzero(mine), np.flatnonzero(theirs))
    in_parts(np.flatnonzero(mine), np.flatnonzero(~theirs))
    in_parts(np.flatnonzero(~mine), np.arange(len(b)))
    return best, where, scored


def in_cells(left: DataFrame, texts: DataFrame, on: list[str], shares: DataFrame, cells: int) -> DataFrame:
    """(*on, a, s, b, scored) for each cell of a left text (*on, a, over): its best text there that scores more than `over`;
    b is null if there is none. shares: (*on, lefts, rights), the cells of a block; cells: how many there are in all."""
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    tasks, key = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), cells // 4), [*on, "lp", "rp"]
    mine = left.join(shares, on).select(*on, dealt("a", "lefts").alias("lp"), spread("rights").alias("rp"), "a", "over").repartition(tasks, *key)
    theirs = texts.join(shares, on).select(*on, spread("lefts").alias("lp"), dealt("b", "rights").alias("rp"), "b", F.col("r.ord").alias("ord")).repartition(tasks, *key)
    theirs = theirs.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ord", "b")))["b"].alias("b"))  # in the order of rows
    schema = T.StructType([*[left.schema[c] for c in on], left.schema["a"], T.StructField("s", T.IntegerType()), T.StructField("b", T.StringType()), T.StructField("scored", T.LongType())])

    def step(lefts: pa.Table, rights: pa.Table) -> pa.Table:
        if not lefts.num_rows or not rights.num_rows:
            return schema_none.slice(0, 0)
        b = rights["b"][0].as_py()
        best, where, scored = best_of(lefts["a"].to_pylist(), b, lefts["over"].to_numpy())
        told = [pa.array(best, pa.int32()), pa.array([b[k] if k >= 0 else None for k in where.tolist()], pa.string()), pa.array(scored, pa.int64())]
        return pa.table([*[lefts[c] for c in [*on, "a"]], *told], schema.names)

    schema_none = pa.table([pa.array([], pa.string())] * (len(on) + 1) + [pa.array([], pa.int32()), pa.array([], pa.string()), pa.array([], pa.int64())], schema.names)
    return mine.groupBy(*key).cogroup(theirs.groupBy(*key)).applyInArrow(step, schema)


def most_similar(left: DataFrame, texts: DataFrame, on: list[str]) -> DataFrame:
    """(*on, a, score, b, r, scored) for each left text (*on, a), all different, with texts in its block: the right text
    (*on, b, r), all different, that scores highest, the one with the least r.ord of equals; scored: pairs scored for it.
    Only blocks of more texts than a cell holds are worth the index.

    on: the columns that make blocks, texts themselves, never null; their names begin with __."""
    left, texts = written(left, "left"), written(texts, "texts")
    size = lambda c, most: F.greatest(F.count("*") / most, F.sum(F.length(c)) / (most * LONG))
    parts = lambda df, c, most, name: df.groupBy(*on).agg(F.ceil(size(c, most)).cast("int").alias(name))
    shares = written(parts(left, "a", LEFT, "lefts").join(parts(texts, "b", RIGHT, "rights"), on), "shares")
    cells, most = shares.agg(F.coalesce(F.sum(F.col("lefts") * F.col("rights")), F.lit(0)), F.coalesce(F.max("rights"), F.lit(0))).first()
    rest, looked = left.select(*on, "a", F.lit(-1).alias("over")), None
    if most > 1:
        large = shares.filter("rights > 1").select(*on)
        looked = looked_up(left.join(large, on, "left_semi"), texts.join(large, on, "left_semi"), on)
        rest = rest.join(large, on, "left_anti").unionByName(looked.filter("NOT settled").select(*on, "a", F.coalesce(-F.col("x.s") - 1, F.lit(-1)).alias("over")))
    found = in_cells(rest, texts, on, shares, cells).join(texts, [*on, "b"], "left")
    every = found.select(*on, "a", F.when(F.col("b").isNotNull(), F.struct((-F.col("s")).alias("s"), F.col("r.ord").alias("o"), "b", "r")).alias("x"), "scored")
    if looked is not None:
        every = every.unionByName(looked.select(*on, "a", "x", "scored"))
    best = every.groupBy(*on, "a").agg(F.min("x").alias("x"), F.sum("scored").alias("scored")).filter("x IS NOT NULL")
    # Written, so that Spark can split a text that very many left rows have.
    out = written(best.select(*on, "a", (-F.col("x.s")).cast("int").alias("score"), F.col("x.b").alias("b"), F.col("x.r").alias("r"), "scored"), "candidates")
    discard(left.sparkSession, left, texts, shares, *([looked] if looked is not None else []))
    return out
