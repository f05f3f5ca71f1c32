"""Largest inner products against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from limpid.llm import topk
from limpid.llm.topk import Blocks, Numbers, Tree, best, search, top_products


def brute(rows, every=20, top=20, factor=64, dim=8):
    good = [(i, np.floor(np.array(v, float) * factor).astype(np.int64)) for i, v in rows if i is not None and v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % every == 0}):
        score = {}
        for i, a in good:
            if i == q:
                for j, b in good:
                    if j != q:
                        score[j] = max(score.get(j, -(10**18)), int(a @ b))
        out += [(q, r + 1, j, s) for r, (j, s) in enumerate(sorted(score.items(), key=lambda x: (-x[1], x[0]))[:top])]
    return out


def vectors(n, seed=1, dim=8):
    """Clusters, a third of all rows equal, another part near copies, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + 0.1 * rng.normal(size=(n, dim))
    x[: n // 3] = centres[0]
    x[n // 3 : n // 2] = centres[1] + 0.001 * rng.normal(size=(n // 2 - n // 3, dim))
    ids = rng.permutation(n)
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]
    return rows + [(None, x[0].tolist()), (n, None), (n + 20, [1.0, None, *[0.0] * 6]), (2 * n, [float("nan")] * 8), (3 * n, [float("inf")] * 8), (4 * n, [1.0]), (5 * n, []), (20, [9.0] * 8), (20, [-9.0] * 8), (7, [9.0] * 8), (7, [9.0] * 8), (40, [0.0] * 8)]


@pytest.mark.parametrize("group", [64, 1024])
def test_top_products(spark, monkeypatch, group):
    monkeypatch.setattr(topk, "LEAST_GROUP", group)
    monkeypatch.setattr(topk, "SHARD", 3)
    monkeypatch.setattr(topk, "BUCKET", 16)
    rows = vectors(1500)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "code": F.lit("x"), "rank": F.lit(0)}).repartition(5)
    got = [tuple(r) for r in top_products(df).collect()]
    assert sorted(got) == brute(rows) and len(got) == 20 * 75


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = [(0, [0.5, -0.25]), (20, [1.0, 0.0]), (3, [0.5, -0.25])]
    got = [tuple(r) for r in top_products(spark.createDataFrame(few, schema)).collect()]
    assert sorted(got) == [(0, 1, 20, 2048), (0, 2, 3, 1280), (20, 1, 0, 2048), (20, 2, 3, 2048)]
    assert top_products(spark.createDataFrame([(20, [1.0])], schema)).collect() == []
    assert top_products(spark.createDataFrame([], schema)).collect() == []
    assert top_products(spark.createDataFrame([(None, None), (20, None)], schema)).collect() == []


def test_large_numbers(spark):
    """Sums that floating point would round, and sums that fit no long."""
    rows = [(i, [float(2**30 + i), float(-(2**29) + i)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in top_products(df, factor=1, top=5).collect()]
    assert sorted(got) == brute(rows, top=5, factor=1, dim=2)
    with pytest.raises(ArithmeticError):
        top_products(df, factor=64)


def test_pruning():
    """In clustered blocks most are left out; equal vectors cost one block, as their ids ascend."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(64, 16)) * 50
    x = np.floor(np.repeat(centres, 128, 0) + rng.normal(size=(8192, 16)))
    seen = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            seen.append(other.shape[1])
            return np.asarray(self) @ other

    def asked(x):
        cut = [x[k : k + 128] for k in range(0, len(x), 128)]
        ids = [np.arange(k, k + 128) for k in range(0, len(x), 128)]
        blocks = Blocks(np.array([i[0] for i in ids]), np.stack([c.min(0) for c in cut]), np.stack([c.max(0) for c in cut]), cut, ids)
        q = x[[5]].view(Counted)
        seen.clear()
        who, found, score, *_ = search(q, np.array([5]), np.array([topk.LOW]), np.array([topk.HIGH]), blocks, 20)
        every = np.delete(np.asarray(x) @ np.asarray(q)[0], 5)
        order = np.lexsort((np.delete(np.arange(len(x)), 5), -every))[:20]
        assert found.tolist() == np.delete(np.arange(len(x)), 5)[order].tolist() and score.tolist() == every[order].tolist()
        return sum(n for n in seen if n == 128) // 128

    assert asked(x) <= 8
    assert asked(np.repeat(x[:1], 8192, 0)) == 1


def test_parts():
    assert [x.tolist() for x in best(np.array([1, 0, 0, 0, 0]), np.array([5, 9, 3, 3, 2]), np.array([1, 7, 7, 8, 7]), 2)] == [[0, 0, 1], [3, 2, 5], [8, 7, 1]]
    x = np.random.default_rng(1).normal(size=(512, 4))
    n = np.bincount(Tree(x, 4).codes(x), minlength=16)
    assert n.min() >= 30 and n.max() <= 34
    numbers = Numbers(2, 300)
    assert numbers.kept == np.int16 and numbers.scored == np.float32 and numbers.unpack([numbers.pack(np.array([[1, -300]]))]).tolist() == [[1, -300]]
