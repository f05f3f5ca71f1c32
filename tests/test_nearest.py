"""The tree of letters against the search of all pairs."""

import random

import numpy as np
import pytest
from test_similar import changed, scored, texts

from limpid.functions import nearest
from limpid.operators import similar
from limpid.operators.similar import best_of, most_similar, search


@pytest.mark.parametrize("pairs", [1 << 16, 40])
def test_nearest(monkeypatch, pairs):
    monkeypatch.setattr(nearest, "PAIRS", pairs)
    rng = random.Random(pairs)
    a = texts(rng, 150, (1, 2, 3, 5, 8, 20, 60)) + [f"CUSTOMER{k:06}" for k in range(30)]
    b = [t for t in dict.fromkeys(texts(rng, 90, (1, 2, 5, 8, 20, 60)) + [changed(rng, x) for x in a]) if 0 < len(t) <= nearest.DEEP]
    full = np.array([[scored(x, y) for y in b] for x in a])
    for over in (np.full(len(a), -1), np.array([rng.choice([-1, 50, 75, 99]) for _ in a])):
        best, where, _ = nearest.nearest(a, b, over)
        most = full.max(1)
        assert best.tolist() == np.maximum(most, over).tolist()
        assert where.tolist() == np.where(most > over, full.argmax(1), -1).tolist()


def test_texts_of_any_length(monkeypatch):
    """Empty and long texts don't go through the tree; the first of equals wins wherever it was found."""
    for name, value in (("MANY", 1), ("FEW", 7), ("SOME", 5)):
        monkeypatch.setattr(similar, name, value)
    rng = random.Random(8)
    a = texts(rng, 60, (0, 1, 3, 8, 63, 64, 65, 90))
    b = [*dict.fromkeys(texts(rng, 60, (0, 1, 3, 8, 63, 64, 65, 90)) + [changed(rng, x) for x in a])]
    full = np.array([[scored(x, y) for y in b] for x in a])
    for over in (np.full(len(a), -1), np.array([rng.choice([-1, 40, 70]) for _ in a])):
        best, where, _ = best_of(a, b, over)
        assert best.tolist() == np.maximum(full.max(1), over).tolist()
        assert where.tolist() == np.where(full.max(1) > over, full.argmax(1), -1).tolist()


def test_work_grows_less_than_texts(monkeypatch):
    """Ten times as many texts, none of them within a few edits, are far less than ten times the nodes to look at."""
    looked, down = [], nearest._Lefts.down

    def counted(self, d, *pairs):
        looked.append(int(self.levels[d].children[pairs[1]].sum()))
        return down(self, d, *pairs)

    monkeypatch.setattr(nearest._Lefts, "down", counted)
    rng, seen = random.Random(3), []
    for n in (600, 6000):
        a, b = [f"CUSTOMER{rng.randrange(375 * n):09}" for _ in range(60)], [f"SUPPLIER{k:09}" for k in sorted(rng.sample(range(25 * n), n))]
        looked.clear()
        best, where, _ = best_of(a, b, np.full(60, -1))
        seen.append(sum(looked))
        want = search(a, b, np.full(60, -1))
        assert best.tolist() == want[0].tolist() and where.tolist() == want[1].tolist()
    assert 60 < seen[0] and seen[1] < 5 * seen[0] and seen[1] < 60 * 6000 / 2


def test_large_block(spark):
    """A block of more texts than search() takes at once is one cell, and needs no index."""
    names = [f"SUPPLIER{k:09}" for k in range(2500)]
    texts_ = spark.createDataFrame([("x", b, (k,)) for k, b in enumerate(names)], "__k0 string, b string, r struct<ord: long>")
    mine = [f"CUSTOMER{k * 977:09}" for k in range(40)]
    out = most_similar(spark.createDataFrame([("x", a) for a in mine], "__k0 string, a string"), texts_, ["__k0"]).collect()
    best, where, _ = search(mine, names, np.full(40, -1))
    assert {r.a: (r.score, r.r.ord) for r in out} == {a: (s, j) for a, s, j in zip(mine, best.tolist(), where.tolist(), strict=True)}
