"""Approximate nearest neighbours with score-aware (anisotropic) four-bit quantisation.

Vectors are scaled to unit length and split into pairs of dimensions, each coded by one of 16 codewords. As nearness is
an inner product, an error along the vector moves scores of near queries most; the loss weighs it `eta` times as much
as error across it. Codes are chosen by coordinate descent on that loss, codewords by its normal equations over a
bounded sample. The index files each vector under the nearest of some centres, in a list.

A query is first sent to its nearest lists, then to all others that may hold a vector as near as the last of the best so
far: no member is nearer than the angle to the list's centre less the list's radius. Lists are cut into cells of a
bounded number of rows and queries, which Spark joins. In a cell a scan adds up table entries by code; rows are reranked
by their exact cosine if they may be among the best: the index holds the angle between each vector and its coded form,
by which the angle to a query can be less than it seems. So nothing is missed, and the bound leaves the less to rerank
the more has been seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.llm.arrow import add_columns, expand, used
from limpid.llm.spark import discard, materialise

WORDS = 16
#: The list and the angle to its centre; codes, the length of the coded vector, and its cosine with the vector.
CODED = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("angle", T.DoubleType()), T.StructField("code", T.BinaryType()), T.StructField("length", T.DoubleType()), T.StructField("cosine", T.DoubleType())])
#: A query and a list it is sent to; floor: the score that a row must reach.
SENT = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("q", T.ArrayType(T.DoubleType())), T.StructField("floor", T.DoubleType()), T.StructField("list", T.IntegerType())])
FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
#: Rows scanned at once.
BATCH = 2048
#: More than rounding changes an approximate cosine.
ROUNDING = 1e-5


def eta_for(dim: int, threshold: float = 0.2) -> float:
    """How much more error along the vector weighs, for queries with a cosine over the threshold."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def encode(x: np.ndarray, book: np.ndarray, eta: float, rounds: int = 2) -> np.ndarray:
    """Codes of unit vectors x (n, d) by codewords (m, 16, d / m)."""
    m, _, w = book.shape
    parts = x.reshape(len(x), m, w)
    codes = ((parts[:, :, None, :] - book[None]) ** 2).sum(-1).argmin(-1)
    own = np.arange(m)
    along = (parts * (parts - book[own, codes])).sum(-1)  # of each part's error, along the vector
    total = along.sum(1)
    for _ in range(rounds):
        for k in range(m):
            error = parts[:, k, None, :] - book[k][None]
            a = (parts[:, k, None, :] * error).sum(-1)
            loss = (error**2).sum(-1) + (eta - 1) * (total[:, None] - along[:, k, None] + a) ** 2
            codes[:, k] = best = loss.argmin(1)
            new = a[np.arange(len(x)), best]
            total += new - along[:, k]
            along[:, k] = new
    return codes


def train(x: np.ndarray, eta: float, rounds: int = 4, seed: int = 1) -> np.ndarray:
    """Codewords for unit vectors x (n, d), d even: alternates codes and the least loss for given codes."""
    n, d = x.shape
    m, rng = d // 2, np.random.default_rng(seed)
    book = np.stack([x[rng.choice(n, WORDS, replace=n < WORDS)].reshape(WORDS, m, 2)[:, k] for k in range(m)])
    parts = x.reshape(n, m, 2)
    for _ in range(rounds):
        codes = encode(x, book, eta, 1)
        columns = (np.arange(m) * WORDS + codes)[:, :, None] * 2 + np.arange(2)
        g = np.zeros((n, m * WORDS * 2))
        np.put_along_axis(g, columns.reshape(n, -1), parts.reshape(n, -1), 1)
        left = (eta - 1) * (g.T @ g)
        left[np.diag_indices(len(left))] += np.repeat(np.bincount((np.arange(m) * WORDS + codes).ravel(), minlength=m * WORDS), 2) + 1e-3
        right = eta * g.sum(0) + 1e-3 * book.ravel()
        book = np.linalg.solve(left, right).reshape(m, WORDS, 2)
    return book


def scaled(v: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that their largest component is about 1 and no square overflows."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1]) if len(v) else v


def units(v: np.ndarray) -> np.ndarray:
    """Of scaled vectors."""
    x = v / np.linalg.norm(v, axis=1, keepdims=True)
    return np.pad(x, ((0, 0), (0, x.shape[1] % 2)))


def centres_of(x: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    """n directions that unit vectors x gather round."""
    own = x[np.random.default_rng(2).choice(len(x), n, replace=False)]
    for _ in range(rounds):
        near = (x @ own.T).argmax(1)
        total = np.zeros_like(own)
        np.add.at(total, near, x)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        own = np.where(length > 1e-12, total / np.maximum(length, 1e-12), own)
    return own


@dataclass
class Coarse:
    """What is fitted on the sample: codewords and centres; and how many rows a list has and how wide it is."""

    dim: int
    book: np.ndarray
    centres: np.ndarray
    rows: np.ndarray | None = None
    radius: np.ndarray | None = None

    def reach(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For unit vectors x and each list: the rank of the list by nearness, and the largest cosine a member can have."""
        angle = np.arccos(np.clip(x @ self.centres.T, -1, 1))
        rank = np.argsort(np.argsort(angle, axis=1, kind="stable"), axis=1, kind="stable")
        return rank, np.cos(np.maximum(angle - self.radius - ROUNDING, 0)) + ROUNDING


def good_rows(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): rows with an id and a vector of the usual length that is finite and not zero."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    return vectors.filter(fine).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def build(rows: DataFrame, lists: int, per_list: int, sample: int = 32768, codes: int = 8192) -> tuple[DataFrame, Coarse]:
    """The index: each good row with its list and its codes, two to a byte. Centres, one for `per_list` rows and at most
    `lists`, are fitted on at most `sample` rows taken by the order of a hash of the id, codewords on `codes` of these."""
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d, total = (common.d, common["count"]) if common else (2, 0)
    rows = rows.filter(F.size("v") == d)
    some = np.array([r.v for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()], float).reshape(-1, d)
    x = units(scaled(some))
    n = max(1, min(lists, len(some) // 8, -(-total // per_list)))
    book = train(x[:codes], eta_for(d)) if len(some) else np.zeros((max(1, -(-d // 2)), WORDS, 2))
    coarse = Coarse(d, book, centres_of(x, n) if len(some) else np.zeros((1, 2 * len(book))))
    shared = rows.sparkSession.sparkContext.broadcast(coarse)

    def make(b: pa.RecordBatch) -> list:
        if not b.num_rows:
            return [[] for _ in CODED]
        book, x = shared.value.book, units(scaled(matrix(b.column("v"))))
        near = x @ shared.value.centres.T
        own = near.argmax(1)
        codes = encode(x, book, eta_for(d)).astype(np.uint8)
        coded = book[np.arange(codes.shape[1]), codes].reshape(x.shape)
        length = np.linalg.norm(coded, axis=1)
        cosine = np.clip((x * coded).sum(1) / np.where(length > 0, length, 1), -1, 1)
        codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
        packed = [c.tobytes() for c in codes[:, 0::2] | codes[:, 1::2] << 4]
        return [pa.array(own.astype(np.int32)), pa.array(np.arccos(np.clip(near[np.arange(len(x)), own], -1, 1))), packed, pa.array(length), pa.array(cosine)]

    index = materialise(add_columns(rows, CODED, make), "index")
    coarse.rows, coarse.radius = np.zeros(n, np.int64), np.zeros(n)
    for r in index.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect():  # a row a list
        coarse.rows[r.list], coarse.radius[r.list] = r.n, r.angle
    return index, coarse


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def table_of(q: np.ndarray, book: np.ndarray) -> np.ndarray:
    """For a unit vector, its inner product with every pair of codewords that a byte can name, by bytes."""
    four = np.einsum("md,mcd->mc", q.reshape(len(book), 2), book).astype(np.float32)
    four = np.pad(four, ((0, len(four) % 2), (0, 0)))
    return (four[1::2, :, None] + four[0::2, None, :]).reshape(len(four) // 2, 256)


def most(near: np.ndarray, cosine: np.ndarray) -> np.ndarray:
    """The largest cosine that vectors can have with a query, given that of their coded forms with it and with them."""
    t, s = np.clip(near + ROUNDING, -1, 1), np.clip(cosine - ROUNDING, -1, 1)
    return np.where(t < s, t * s + np.sqrt((1 - t * t) * (1 - s * s)), 1.0) + ROUNDING


def search(rows: pa.Table, asked: pa.Table, book: np.ndarray, top: int, keep: int) -> pa.Table:
    """The best `top` rows of a cell for each of its queries, by exact cosine, if they reach the query's floor."""
    ids, v = rows["vec_id"].to_numpy(), scaled(matrix(rows["v"]))
    # Equal vectors are looked at once; of their ids, which come sorted, the first few are enough.
    order = np.argsort(ids, kind="stable")
    _, first, kind = np.unique(np.ascontiguousarray(v[order]).view(np.dtype((np.void, v.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
    by = np.argsort(kind, kind="stable")
    begin = np.searchsorted(kind[by], np.arange(len(first) + 1))
    ids, one = ids[order][by], order[first]
    v, norm = v[one], np.sqrt((v[one] ** 2).sum(1))
    codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(order), -1)[one]
    flat = codes.T.astype(np.intp) + 256 * np.arange(codes.shape[1])[:, None]
    length, cosine = rows["length"].to_numpy()[one], rows["cosine"].to_numpy()[one]
    length = np.where(length > 0, length, 1)
    own, queries, floors = asked["query_id"].to_pylist(), scaled(matrix(asked["q"])), asked["floor"].to_numpy()
    out: list[tuple[int, int, float]] = []
    for i, q, floor in zip(own, queries, floors.tolist(), strict=True):
        table, size, best = table_of(units(q[None])[0], book).ravel(), np.sqrt((q * q).sum()), {}

        def rank(at: np.ndarray) -> None:
            """Takes the rows `at` into the best so far."""
            score = (v[at] * q).sum(1) / (size * norm[at])
            for k in np.flatnonzero(score >= floor).tolist():
                members = ids[begin[at[k]] : min(begin[at[k] + 1], begin[at[k]] + 2 * top)].tolist()
                for x in dict.fromkeys(members) if len(members) < 2 * top else distinct(ids, begin[at[k]], begin[at[k] + 1], top + 1):
                    if x != i:
                        best[x] = max(best.get(x, -2.0), float(score[k]))

        for lo in range(0, len(v), BATCH):
            hi = min(lo + BATCH, len(v))
            near = table.take(flat[:, lo:hi]).sum(0) / length[lo:hi]
            left = np.ones(hi - lo, bool)
            if len(best) < top:
                some = np.argpartition(-near, keep - 1)[:keep] if hi - lo > keep else np.arange(hi - lo)
                rank(lo + some)
                left[some] = False
                best, floor = trimmed(best, top, floor)
            more = np.flatnonzero(left & (most(near, cosine[lo:hi]) >= floor))
            if len(more):
                rank(lo + more)
                best, floor = trimmed(best, top, floor)
        out += [(i, x, s) for x, s in best.items()]
    used(rows.num_rows)
    return pa.table([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], FOUND.names)


def distinct(ids: np.ndarray, lo: int, hi: int, n: int) -> list[int]:
    return np.unique(ids[lo:hi])[:n].tolist()


def trimmed(best: dict[int, float], top: int, floor: float) -> tuple[dict[int, float], float]:
    """The best `top`, and the score that others must reach."""
    kept = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:top]
    return dict(kept), max(floor, kept[-1][1]) if len(kept) == top else floor


def searched(index: DataFrame, sent: DataFrame, coarse: Coarse, top: int, keep: int, cell: int, block: int) -> DataFrame:
    """FOUND of all lists that queries are sent to (SENT), in cells of some `cell` rows and `block` queries."""
    n = len(coarse.centres)
    many = {r.list: r["count"] for r in sent.groupBy("list").count().collect()}  # a row a list
    of = lambda counts, most: F.element_at(F.array(*[F.lit(max(1, -(-int(c) // most))) for c in counts]), F.col("list") + 1)
    parts, blocks = of(coarse.rows, cell), of([many.get(k, 0) for k in range(n)], block)
    copies = lambda k: F.explode(F.sequence(F.lit(0), k - 1))
    rows = index.filter(F.col("list").isin([*many])).select("list", F.pmod(F.xxhash64("vec_id", "v"), parts).cast("int").alias("part"), copies(blocks).alias("block"), "vec_id", "v", "code", "length", "cosine")
    asked = sent.select("list", copies(parts).alias("part"), F.pmod(F.xxhash64("query_id"), blocks).cast("int").alias("block"), "query_id", "q", "floor")
    shared = index.sparkSession.sparkContext.broadcast(coarse.book)

    def step(a: pa.Table, b: pa.Table) -> pa.Table:
        return search(a, b, shared.value, top, keep) if a.num_rows and b.num_rows else FOUND_NONE

    key = ["list", "part", "block"]
    return rows.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(step, FOUND)


FOUND_NONE = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], FOUND.names)


def best_of(found: DataFrame, top: int) -> DataFrame:
    """The best `top` of each query with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return one.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, top: int = 5, keep: int = 96, lists: int = 1024, per_list: int = 8192, probes: int = 4, cell: int = 16384, block: int = 1024, where: Column | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every` (or for which `where`, a condition on
    vec_id, holds), the `top` rows nearest by cosine.

    Rows whose vector is null, zero, of an unusual length or holds a null or non-finite component take no part, nor do
    rows without an id, a whole number; rows of the query's own id are no candidates. Ties go to the smaller id. An id in
    several rows is told once, with its best score, and asks with the smallest of its vectors.
    """
    index, coarse = build(good_rows(vectors, id_col, vec_col), lists, per_list)
    spark = vectors.sparkSession
    chosen = F.col("vec_id") % every == 0 if where is None else where
    asked = index.filter(chosen).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"))
    shared = spark.sparkContext.broadcast(coarse)

    def send(queries: DataFrame, first: bool) -> DataFrame:
        def make(b: pa.RecordBatch):
            if not b.num_rows:
                return
            rank, reach = shared.value.reach(units(scaled(matrix(b.column(1)))))
            floor = b.column(2).to_numpy()
            q, which = np.nonzero(rank < probes if first else (rank >= probes) & (reach >= floor[:, None]))
            q = pa.array(q)
            yield {"query_id": b.column(0).take(q), "q": b.column(1).take(q), "floor": b.column(2).take(q), "list": which.astype(np.int32)}

        return materialise(expand(queries.select("query_id", "q", "floor"), SENT, make), "sent")

    sent = send(asked.withColumn("floor", F.lit(-2.0)), True)
    found = materialise(best_of(searched(index, sent, coarse, top, keep, cell, block), top), "found")
    if len(coarse.centres) > probes:
        floors = found.filter(F.col("rank") == top).select("query_id", F.col("score").alias("floor"))
        again = send(asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0))), False)
        found = best_of(found.select("query_id", "vec_id", "score").unionByName(searched(index, again, coarse, top, keep, cell, block)), top)
    discard(spark, sent)
    return found.select("query_id", "rank", "vec_id", "score")
