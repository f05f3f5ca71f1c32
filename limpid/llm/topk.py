"""Exact search for the largest inner products, block by block.

Vectors of whole numbers are laid out so that neighbours are alike: a tree of splits, fitted on a bounded sample, gives
each a code, and the order by code and id is cut into ranges, the blocks, some hundreds of which form a group. A block
keeps its vectors, as its forward index, and the largest and smallest value of each term, that is, dimension. The sum
over a query's terms of what the term adds at most bounds the scores of a block's vectors.

A query takes blocks in the order of that bound and scores their vectors until the bound falls below the last of its best
so far. It begins in its own group, while that is built; its last best is where it starts from elsewhere. Then all
queries' bounds are worked out for the blocks of all groups, from the terms' extremes alone, and a query is sent only to
groups with a block that it has to see. Cells of one group and a bounded number of queries are joined by Spark. A block
whose bound equals the last best is left out if all its ids are larger, so that many equal vectors cost little.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.llm.ann import best_of, matrix
from limpid.llm.arrow import add_columns, stream, used
from limpid.llm.spark import discard, materialise, partitions_for, shuffle_partitions

#: Rows of a block, and of a group at least and at most.
BLOCK, LEAST_GROUP, MOST_GROUP = 128, 1024, 65536
#: Groups whose bounds are worked out together; queries sent together.
SHARD, BUCKET = 16, 8192
#: Queries scored at once.
AT_ONCE = 1024
#: Below every score, and above every id.
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max

FOUND = T.StructType([T.StructField(n, T.LongType()) for n in ("query_id", "vec_id", "score")])
#: Blocks (kind 0): the least id, the ids, vectors and extremes. Queries (kind 1): ids, vectors, floors and their ids.
LAID = "kind int, grp long, block int, least long, ids binary, vectors binary, low binary, high binary"
SENT = "grp long, bucket long, ids binary, vectors binary, low binary, high binary"


@dataclass
class Numbers:
    """How vectors are kept and scored: in the smallest type that holds them, by one in which all sums are exact."""

    dim: int
    largest: int

    def __post_init__(self):
        most = self.dim * self.largest**2
        if most >= 2**63:
            raise ArithmeticError(f"inner products of {self.dim} components up to {self.largest} don't fit a long")
        self.kept = np.dtype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if self.largest <= np.iinfo(t).max))
        self.scored = np.dtype(np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64)

    def pack(self, v: np.ndarray) -> bytes:
        return v.astype(self.kept).tobytes()

    def unpack(self, blobs: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(blobs), self.kept).reshape(-1, self.dim).astype(self.scored)


def longs(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.int64)


class Tree:
    """Splits space in halves of a sample, again and again, across the direction in which it spreads most."""

    def __init__(self, x: np.ndarray, depth: int):
        self.ways, self.cuts = [], []
        own = np.zeros(len(x), np.int64)
        for level in range(depth):
            way, cut = np.zeros((1 << level, x.shape[1])), np.zeros(1 << level)
            order = np.argsort(own, kind="stable")
            edges = np.searchsorted(own[order], np.arange((1 << level) + 1))
            for k in range(1 << level):
                part = x[order[edges[k] : edges[k + 1]]]
                if len(part) > 1:
                    apart = part - part.mean(0)
                    d = apart[np.abs(apart).sum(1).argmax()]
                    for _ in range(4):  # power iteration
                        d = apart.T @ (apart @ d)
                        d /= max(np.sqrt((d * d).sum()), 1e-300)
                    way[k], cut[k] = d, np.median(part @ d)
            self.ways.append(way)
            self.cuts.append(cut)
            own = self._down(x, own, level)

    def _down(self, x: np.ndarray, own: np.ndarray, level: int) -> np.ndarray:
        return 2 * own + ((x * self.ways[level][own]).sum(1) > self.cuts[level][own])

    def codes(self, x: np.ndarray) -> np.ndarray:
        own = np.zeros(len(x), np.int64)
        for level in range(len(self.ways)):
            own = self._down(x, own, level)
        return own


@dataclass
class Blocks:
    """Blocks in the order of their least ids; vectors and ids only where they are scored."""

    least: np.ndarray
    low: np.ndarray
    high: np.ndarray
    vectors: list[np.ndarray] | None = None
    ids: list[np.ndarray] | None = None

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """What queries can score in blocks at most: the summed maxima of terms."""
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T


def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, top: int) -> tuple[np.ndarray, ...]:
    """The best `top` different ids of each query, best first, ties by id."""
    order = np.lexsort((-score, ids, query))
    query, ids, score = query[order], ids[order], score[order]
    new = np.ones(len(query), bool)
    new[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])
    query, ids, score = query[new], ids[new], score[new]
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    good = rank < top
    return query[good], ids[good], score[good]


def search(q: np.ndarray, own: np.ndarray, floor: np.ndarray, floor_id: np.ndarray, blocks: Blocks, top: int) -> tuple[np.ndarray, ...]:
    """(query's number, id, score): what blocks hold that is better than a query's floor, the best `top` of each; and the
    floors that follow. own: the queries' ids; floor, floor_id: score and id that others have to beat."""
    floor, floor_id = floor.copy(), floor_id.copy()
    bounds = blocks.bounds(q).astype(np.int64)
    order = np.argsort(-bounds, axis=1, kind="stable")
    bounds = np.take_along_axis(bounds, order, 1)
    found = (np.zeros(0, np.int64),) * 3
    lo, step, left = 0, 1, np.arange(len(q))
    while lo < order.shape[1] and len(left):
        hi = min(lo + step, order.shape[1])
        b, u, f = order[left, lo:hi], bounds[left, lo:hi], floor[left, None]
        see = (u > f) | (u == f) & (blocks.least[b] < floor_id[left, None])
        some, column = np.nonzero(see)
        block, who = b[some, column], left[some]
        by = np.argsort(block, kind="stable")
        block, who = block[by], who[by]
        kinds = np.unique(block)
        new = [found]
        for k, x, y in zip(kinds.tolist(), np.searchsorted(block, kinds), np.searchsorted(block, kinds, side="right"), strict=True):
            w, ids = who[x:y], blocks.ids[k]
            score = (q[w] @ blocks.vectors[k].T).astype(np.int64)
            f, g = floor[w, None], floor_id[w, None]
            r, c = np.nonzero(((score > f) | (score == f) & (ids < g)) & (ids != own[w, None]))
            new.append((w[r], ids[c], score[r, c]))
        found = best(*(np.concatenate(x) for x in zip(*new, strict=True)), top)
        full = np.flatnonzero(np.bincount(found[0], minlength=len(q)) == top)
        last = np.searchsorted(found[0], full, side="right") - 1
        floor[full], floor_id[full] = found[2][last], found[1][last]
        left = left[see[:, -1]]  # bounds only fall: a query that left one block out needs no more
        lo, step = hi, 2 * step
    return *found, floor, floor_id


def laid_out(rows: DataFrame, numbers: Numbers, chosen: str, group: int, top: int, parts: int) -> DataFrame:
    """Blocks and queries (LAID), and what queries find in their own group, as rows of kind 2: the ids of queries, of
    found vectors (vectors), and scores (low)."""

    def flush(grp: int, ids: np.ndarray, v: np.ndarray, asks: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = [*range(0, len(ids), BLOCK), len(ids)]
        cut = sorted(((a, b) for a, b in zip(edges, edges[1:], strict=False)), key=lambda x: int(ids[x[0] : x[1]].min()))
        exact = v.astype(numbers.scored)
        blocks = Blocks(*(np.stack([f(a, b) for a, b in cut]) for f in (lambda a, b: ids[a:b].min(), lambda a, b: exact[a:b].min(0), lambda a, b: exact[a:b].max(0))), [exact[a:b] for a, b in cut], [ids[a:b] for a, b in cut])
        lines = [(0, grp, k, int(blocks.least[k]), blocks.ids[k].tobytes(), numbers.pack(blocks.vectors[k]), numbers.pack(blocks.low[k]), numbers.pack(blocks.high[k])) for k in range(len(cut))]
        asking = np.flatnonzero(asks)
        for k in range(0, len(asking), AT_ONCE):
            some = asking[k : k + AT_ONCE]
            who, found, score, floor, floor_id = search(exact[some], ids[some], np.full(len(some), LOW), np.full(len(some), HIGH), blocks, top)
            lines.append((1, grp, k, 0, ids[some].tobytes(), numbers.pack(exact[some]), floor.tobytes(), floor_id.tobytes()))
            lines.append((2, grp, k, 0, ids[some][who].tobytes(), found.tobytes(), score.tobytes(), b""))
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in lines], t) for k, t in enumerate(types)], [x.split()[0] for x in LAID.split(", ")])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, held, n = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            if b.num_rows:
                held.append((b.column(0).to_numpy(), matrix(b.column(1)).astype(np.int64), b.column(2).to_numpy(zero_copy_only=False)))
                n += b.num_rows
            if n >= group:
                yield from flush(grp, *(np.concatenate(x) for x in zip(*held, strict=True)))
                grp, held, n = grp + 1, [], 0
        if held:
            yield from flush(grp, *(np.concatenate(x) for x in zip(*held, strict=True)))

    dealt = rows.repartitionByRange(parts, "code", "vec_id").sortWithinPartitions("code", "vec_id")
    return materialise(stream(dealt.select("vec_id", "v", F.expr(chosen).alias("asks")), step, LAID), "laid", ["kind"])


def whole_numbers(vectors: DataFrame, id_col: str, vec_col: str, factor: int) -> DataFrame:
    """(vec_id, v): rows with an id and a finite vector, each component times `factor`, rounded down."""
    x = F.col(vec_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    return vectors.filter(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * factor)).alias("v"))


def top_products(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", factor: int = 64, every: int = 20, top: int = 20, where: Column | None = None, sample: int = 32768) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every` (or for which `where`, a condition on
    vec_id, holds), the `top` largest inner products with other rows, of vectors times `factor`, rounded down.

    Rows whose vector is null, empty, of another length than most, or holds a null or non-finite component take no part,
    nor do rows without an id, a whole number; rows of the query's own id are no candidates. Ties go to the smaller id. An
    id in several rows asks with each of its vectors, and is told once, with its best score. Products that don't fit a
    long are an error. The tree that orders vectors is fitted on at most `sample` of them, by the order of a hash of the
    id; it decides which vectors lie together, never what is found.
    """
    spark = vectors.sparkSession
    rows = whole_numbers(vectors, id_col, vec_col, factor).filter(F.size("v") > 0)
    sizes = F.greatest(F.array_max("v"), -F.array_min("v"))
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(sizes).alias("m")).orderBy(F.desc("n"), "d").first()
    dim, total, largest = (common.d, common.n, max(common.m, 1)) if common else (1, 0, 1)
    numbers = Numbers(dim, largest)
    rows = rows.filter(F.size("v") == dim)
    some = np.array([r.v for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()], float).reshape(-1, dim)
    depth = max(0, min(len(some) // 16, partitions_for(total, BLOCK)).bit_length() - 1)
    tree = spark.sparkContext.broadcast(Tree(some, depth))
    coded = add_columns(rows, T.StructType([T.StructField("code", T.LongType())]), lambda b: [tree.value.codes(matrix(b.column("v")).astype(float)) if b.num_rows else []])
    group = min(max(partitions_for(total, 64), LEAST_GROUP), MOST_GROUP)
    parts = partitions_for(total, group)
    chosen = F.col("vec_id") % every == 0 if where is None else where
    asked = coded.withColumn("asks", F.coalesce(chosen, F.lit(False)))
    laid = laid_out(asked, numbers, "asks", group, top, parts)

    blocks, queries, seeds = (laid.filter(F.col("kind") == k).drop("kind") for k in range(3))
    number = F.shiftright("grp", 32)  # groups that follow each other hold vectors that are alike
    bucket = F.floor(number / max(1, BUCKET * every // group)).alias("bucket")
    shards, buckets = partitions_for(parts, SHARD), partitions_for(parts, max(1, BUCKET * every // group))
    tasks = max(shuffle_partitions(spark), shards * buckets // 8)
    copies = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    extremes = blocks.select(F.floor(number / SHARD).alias("shard"), copies(buckets).alias("bucket"), "grp", "least", "low", "high")
    asking = queries.select(copies(shards).alias("shard"), bucket, "grp", "ids", "vectors", "low", "high")

    def send(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        """The queries that have to see a block, for each group but their own."""
        out = []
        if queries.num_rows and blocks.num_rows:
            grp, least = blocks["grp"].to_numpy(), blocks["least"].to_numpy()
            order = np.argsort(grp, kind="stable")
            every = Blocks(least[order], *(numbers.unpack(blocks[c].to_pylist())[order] for c in ("low", "high")))
            kinds, begin = np.unique(grp[order], return_index=True)
            for r in queries.to_pylist():
                q, ids, floor, floor_id = numbers.unpack([r["vectors"]]), *(longs([r[c]]) for c in ("ids", "low", "high"))
                u = every.bounds(q).astype(np.int64)
                see = np.logical_or.reduceat((u > floor[:, None]) | (u == floor[:, None]) & (every.least < floor_id[:, None]), begin, axis=1)
                for k, g in enumerate(kinds.tolist()):
                    if g != r["grp"] and len(w := np.flatnonzero(see[:, k])):
                        out.append((g, r["bucket"], ids[w].tobytes(), numbers.pack(q[w]), floor[w].tobytes(), floor_id[w].tobytes()))
        used(queries.num_rows * AT_ONCE)
        return pa.table([pa.array([x[k] for x in out], pa.int64() if k < 2 else pa.binary()) for k in range(6)], [x.split()[0] for x in SENT.split(", ")])

    key = ["shard", "bucket"]
    sent = materialise(asking.repartition(tasks, *key).groupBy(*key).cogroup(extremes.repartition(tasks, *key).groupBy(*key)).applyInArrow(send, SENT), "sent")
    cells = materialise(sent.groupBy("grp", "bucket").count(), "cells")
    tasks = max(shuffle_partitions(spark), cells.count() // 4)
    there = blocks.join(cells.select("grp", "bucket"), "grp").select("grp", "bucket", "block", "least", "ids", "vectors", "low", "high")

    def score(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 3]
        if queries.num_rows and blocks.num_rows:
            blocks = blocks.sort_by("least")
            own = Blocks(blocks["least"].to_numpy(), *(numbers.unpack(blocks[c].to_pylist()) for c in ("low", "high")), [numbers.unpack([x]) for x in blocks["vectors"].to_pylist()], [longs([x]) for x in blocks["ids"].to_pylist()])
            q, (ids, floor, floor_id) = numbers.unpack(queries["vectors"].to_pylist()), (longs(queries[c].to_pylist()) for c in ("ids", "low", "high"))
            for k in range(0, len(ids), AT_ONCE):
                who, found, scores, *_ = search(q[k : k + AT_ONCE], ids[k : k + AT_ONCE], floor[k : k + AT_ONCE], floor_id[k : k + AT_ONCE], own, top)
                out.append((ids[k : k + AT_ONCE][who], found, scores))
        used(queries.num_rows * AT_ONCE)
        return pa.table([np.concatenate(x) for x in zip(*out, strict=True)], FOUND.names)

    key = ["grp", "bucket"]
    found = sent.repartition(tasks, *key).groupBy(*key).cogroup(there.repartition(tasks, *key).groupBy(*key)).applyInArrow(score, FOUND)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(longs(b.column(k).to_pylist())) for k in range(3)], FOUND.names)

    first = stream(seeds.select("ids", "vectors", "low"), unpacked, FOUND)
    out = materialise(best_of(first.unionByName(found), top), "top")
    discard(spark, laid, sent, cells)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
