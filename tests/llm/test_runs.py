"""Runs of words against a search of all places and periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from limpid.llm.queries import op13_periodic_runs
from limpid.llm.runs import Extensions, collapse_runs, find_runs, re_pair
from limpid.llm.words import PLAIN, slices

SPACE = re.compile("[^ \t-\r]+")


def brute(ws, least=12):
    """All runs: for each period, the stretches in which words a period apart are equal."""
    found = {}
    for q in range(1, len(ws) // 2 + 1):
        i = 0
        while i + q < len(ws):
            if ws[i] == ws[i + q]:
                j = i
                while j + q < len(ws) and ws[j] == ws[j + q]:
                    j += 1
                if j + q - i >= max(least, 2 * q):
                    found.setdefault((i, j + q), q)
                i = j
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def text(rng):
    n, v = rng.randrange(160), rng.choice([1, 2, 2, 3, 5, 20, 300])
    ws = [f"w{rng.randrange(v)}" for _ in range(n)]
    kind = rng.random()
    if kind < 0.5 and n:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.choice([3, 4, 7, 10])
        ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
    elif kind < 0.6:  # Fibonacci words hold the most runs
        a, b = "a", "ab"
        for _ in range(rng.randrange(9)):
            a, b = b, b + a
        ws = list(b)
    elif kind < 0.7:  # Thue-Morse words deceive many hashes
        t = "a"
        for _ in range(rng.randrange(8)):
            t += t.translate(str.maketrans("ab", "ba"))
        ws = list(t)
    return ws


def test_find_runs():
    rng, many = random.Random(7), 0
    for _ in range(150):
        docs = [text(rng) for _ in range(rng.randrange(1, 10))]
        for least in (12, 4):
            for w in slices(pa.array([" ".join(d) for d in docs]), PLAIN):
                s, n, q = find_runs(w, least)
                own = w.owner(s)
                for d, ws in enumerate(docs):
                    got = list(zip((s[own == d] - w.first[d]).tolist(), n[own == d].tolist(), q[own == d].tolist(), strict=True))
                    assert sorted(got) == brute(ws, least)
                    many += len(got)
    assert many > 3000


def test_grammar():
    """Rules derive the text, no pair of the last sequence recurs, and a long power needs few rules."""
    for ws in ([0] * 1000, [*range(50)] * 20, [k % 7 * (k % 3) for k in range(500)]):
        x = np.array(ws)
        g = re_pair(x, np.append(np.ones(len(x) - 1, bool), False))

        def derive(s, g=g):
            return [s] if s < g.words else derive(g.left[s - g.words]) + derive(g.right[s - g.words])

        assert [y for s in g.sequence for y in derive(int(s))] == ws
        pairs = list(zip(g.sequence[:-1], g.sequence[1:], strict=True))
        assert all(a == b for a, b in pairs if pairs.count((a, b)) > 1)
        assert all(derive(g.words + k) == ws[f : f + n] for k, (f, n) in enumerate(zip(g.first, g.length, strict=True)))
    assert len(re_pair(np.zeros(1 << 14, np.int64), np.arange(1 << 14) < (1 << 14) - 1).left) == 13


def test_extensions():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2, 400)
    i = rng.integers(0, 399, 300)
    j = np.minimum(i + rng.integers(1, 50, 300), 399)
    ext = Extensions(x, 400)
    ahead = [next((k for k in range(400 - b) if x[a + k] != x[b + k]), 400 - b) for a, b in zip(i, j, strict=True)]
    back = [next((k for k in range(a) if x[a - 1 - k] != x[b - 1 - k]), a) for a, b in zip(i, j, strict=True)]
    assert ext.forward(i, j).tolist() == ahead and ext.backward(i, j).tolist() == back


def test_collapse(spark):
    rows = [(1, "a b c " * 5 + "d", "x"), (1, "a b c " * 5 + "d", "x"), (2, None, "y"), (None, "same " * 30000, "y"), (3, "", None), (4, "é\tü\x0bé x ü " * 9, "z"), (5, "no run at all", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = collapse_runs(docs)
    assert got.columns == ["doc_id", "text", "n_words", "runs", "kept"]
    for r in got.collect():
        ws = SPACE.findall(r.text or "")
        runs = [(x.start, x.length, x.period) for x in r.runs]
        assert r.n_words == len(ws) and (runs == [(0, 30000, 1)] if len(ws) == 30000 else runs == brute(ws))
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert r.kept == " ".join(x for i, x in enumerate(ws) if i not in gone)
    assert sum(len(r.runs) for r in got.collect()) == 4
    assert collapse_runs(docs.limit(0)).collect() == []


def test_query(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i if i % 50 else None, " ".join(text(rng)) if i % 40 else None) for i in range(1, 400)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(str(tmp_path / "documents.parquet"))
    expected = []
    for d, t in rows:
        ws = SPACE.findall(t or "")
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        if h % 10 == 0 and ws:
            a = h // 10 % len(ws)
            p = 1 + (len(ws) - a) // (3 + h // 10 % 8)
            ws = [x if i < a else ws[a + (i - a) % p] for i, x in enumerate(ws)]
        runs = brute(ws)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = " ".join(x for i, x in enumerate(ws) if i not in gone)
        expected.append((d, len(runs), *best, runs and best[1] * 1000 // best[2] or None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr) and sum(r[1] for r in got) > 100
