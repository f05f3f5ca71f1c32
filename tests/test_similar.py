"""Fuzzy matching against a score of all pairs."""

import random
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from limpid.functions.fuzzy import jaro_many, jaro_winkler, levenshtein_all, levenshtein_many, score_most
from limpid.operators import similar
from limpid.operators.similar import most_similar, search

LETTERS = "ABCDÉ 1é𝒳"


def edits(a, b):
    row = [*range(len(b) + 1)]
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def scored(a, b):
    longest = max(len(a), len(b))
    return floor(100 * (jaro_winkler(a, b) + (1 - edits(a, b) / longest if longest else 1.0)) / 2 + 0.5)


def texts(rng, n, sizes=(0, 1, 2, 5, 8, 20, 70)):
    return ["".join(rng.choice(LETTERS) for _ in range(rng.choice(sizes))) for _ in range(n)]


def changed(rng, text):
    out = list(text)
    for _ in range(rng.randrange(4)):
        k = rng.randrange(len(out) + 1)
        out[k : k + rng.randrange(2)] = rng.choice(["", "Z", "A"])
    return "".join(out)


def test_scores():
    rng = random.Random(1)
    a = texts(rng, 120)
    b = texts(rng, 60) + [changed(rng, x) for x in a[:60]]
    pairs = [(x, y) for x in a for y in b]
    want = np.array([edits(x, y) for x, y in pairs])
    assert levenshtein_many(*map(list, zip(*pairs, strict=True))).tolist() == want.tolist()
    short = [x for x in a if len(x) <= 64]
    assert levenshtein_all(short, b).tolist() == [[edits(x, y) for y in b] for x in short]
    most, least = score_most(a, b)
    full = np.array([scored(x, y) for x, y in pairs]).reshape(most.shape)
    assert (most >= full).all() and (least <= want.reshape(most.shape)).all()
    best, where, n = search(a, b, np.full(len(a), -1))
    assert best.tolist() == full.max(1).tolist() and where.tolist() == full.argmax(1).tolist() and n.sum() < full.size / 5
    best, where, _ = search(a, b, full.max(1))
    assert (where == -1).all() and jaro_many(["", "A"], ["", ""], True).tolist() == [1.0, 0.0]


@pytest.mark.parametrize("right, wide", [(2048, 32), (16, 32), (16, 2)])
def test_most_similar(spark, monkeypatch, right, wide):
    """Without the index, with it, and with segments that too many texts share."""
    for name, value in (("RIGHT", right), ("LEFT", 8), ("WIDE", wide)):
        monkeypatch.setattr(similar, name, value)
    rng = random.Random(right + wide)
    names = texts(rng, 60, (0, 3, 6, 12, 18, 30)) + [f"CUSTOMER{k:06}" for k in range(40)]
    theirs = [(k, "x" if k % 3 else "y", b) for k, b in enumerate(rng.sample(names, 90) + [changed(rng, rng.choice(names)) for _ in range(60)])]
    mine = [("x" if k % 2 else "y", a) for k, a in enumerate(names + [changed(rng, rng.choice(names)) for _ in range(60)])] + [("z", "ALONE")]
    left = spark.createDataFrame(mine, "__k0 string, a string").distinct()
    rows = spark.createDataFrame(theirs, "ord long, __k0 string, b string").groupBy("__k0", "b").agg(F.min(F.struct("ord")).alias("r"))
    expected = set()
    for k, a in set(mine):
        own = [(-scored(a, b), o, b) for o, block, b in theirs if block == k]
        if own:
            s, o, b = min(own)
            expected.add((k, a, -s, b, o))
    out = most_similar(left, rows, ["__k0"]).collect()
    assert {(r["__k0"], r.a, r.score, r.b, r.r.ord) for r in out} == expected and len(out) == len(expected)
    pairs = sum(block == k for k, _ in set(mine) for _, block, _ in theirs)
    assert sum(r.scored for r in out) < pairs / 4


def test_hot_block(spark, monkeypatch):
    """A block with most rows is spread over cells of a bounded number of texts."""
    for name, value in (("RIGHT", 64), ("LEFT", 32)):
        monkeypatch.setattr(similar, name, value)
    left = spark.range(400).select(F.lit("hot").alias("__k0"), F.concat(F.lit("NAME "), F.col("id").cast("string")).alias("a"))
    right = spark.range(600).select(F.lit("hot").alias("__k0"), F.concat(F.lit("NOM "), (F.col("id") * 7).cast("string")).alias("b"), F.struct(F.col("id").alias("ord")).alias("r"))
    shares = spark.createDataFrame([("hot", 13, 10)], "__k0 string, lefts int, rights int")
    seen = similar.in_cells(left.withColumn("over", F.lit(-1)), right, ["__k0"], shares, 130).groupBy("a").count()
    assert {r["count"] for r in seen.collect()} == {10}
    assert most_similar(left, right, ["__k0"]).count() == 400
