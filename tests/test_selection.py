"""Medians by selection against sorting."""

import random
import statistics
import struct

import pytest
from pyspark.sql import functions as F

from limpid.operators import REGISTRY, Context
from limpid.operators.selection import as_ordered, from_ordered, medians
from limpid.plans import report
from limpid.table import Table


def doubles(n, seed=3):
    """Of all sizes and both signs, with ties and numbers that differ in their last bits only."""
    rng = random.Random(seed)
    some = [0.0, -0.0, 1.0, 1.0000000000000002, 5e-324, -1e300, float("inf"), float("-inf")]
    wild = lambda: struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0]
    out = [rng.choice([rng.choice(some), wild(), rng.gauss(0, 100), float(rng.randrange(9))]) for _ in range(n)]
    return [x if x == x and abs(x) < 1e307 or x in some else 7.0 for x in out]


def test_order_and_back(spark):
    xs = doubles(400)
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", as_ordered("x").alias("b")).select("x", "b", from_ordered("b").alias("y")).collect()
    assert all(r.x == r.y for r in got)
    assert [r.x for r in sorted(got, key=lambda r: r.b)] == sorted(xs)


@pytest.mark.parametrize("keys", [["g"], []])
def test_against_sorting(spark, keys):
    rng, xs = random.Random(1), [x for x in doubles(900) if abs(x) < 1e307]
    rows = [(rng.choice(["hot"] * 9 + ["a", "b", None]), x if rng.random() < 0.9 else None, 1.0 * (i % 5) if i % 3 else None) for i, x in enumerate(xs)]
    rows += [("none", None, None), ("one", 4.0, None), ("two", 1.0, 2.0), ("two", 4.0, 2.0)]
    own = {}
    for g, x, y in rows:
        a, b = own.setdefault((g,) if keys else (), ([], []))
        a += [x] if x is not None else []
        b += [y] if y is not None else []
    want = {g: (statistics.median(a) if a else None, statistics.median(b) if b else None) for g, (a, b) in own.items() if a or b}
    got = medians(spark.createDataFrame(rows, "g string, x double, y double").repartition(5), keys, {"x": F.col("x"), "y": F.col("y")}).collect()
    assert {tuple(r["__group"])[1:]: (r.x, r.y) for r in got} == want


def test_no_value(spark):
    none = spark.createDataFrame([("a", None)], "g string, x double")
    assert medians(none, ["g"], {"x": F.col("x")}).collect() == []
    out = REGISTRY["summarize"](Table.of(none, ["g"]), {"group_by": [{"column": "g"}], "aggregates": [{"fn": "median", "column": "x", "name": "m"}]}, Context())
    assert out.collect() == [("a", "")]
    assert REGISTRY["summarize"](Table.of(none.limit(0), ["g"]), {"group_by": [], "aggregates": [{"fn": "median", "column": "x", "name": "m"}]}, Context()).collect() == []


def test_with_bins_and_conditions(spark):
    rows = [(i, "ab"[i % 2], float(i)) for i in range(21)]
    t = Table.of(spark.createDataFrame(rows, "i long, g string, x double"), ["i"])
    bins = {"kind": "explicit_boundaries", "boundaries": [0, 10, 20, 30]}
    aggs = [{"fn": "median", "column": "x", "name": "all"}, {"fn": "count", "name": "n"}, {"fn": "median", "column": "x", "name": "a", "where": {"column": "g", "operator": "eq", "value": "a"}}]
    out = REGISTRY["summarize"](t, {"group_by": [{"column": "x", "binning": bins}], "aggregates": aggs}, Context())
    assert "median(" not in out.df._jdf.queryExecution().toString() and "percentile" not in out.df._jdf.queryExecution().toString()
    assert out.collect() == [("0–10", "4.5", "10", "4"), ("10–20", "14.5", "10", "14"), ("20–30", "20", "1", "20")]


def test_in_reports(spark):
    t = Table.of(spark.createDataFrame([(i, "ab"[i > 6], float(i * i)) for i in range(9)], "i long, g string, x double"), ["i"])
    spec = {"formatVersion": 1, "kind": "report", "title": "t", "expectedColumns": ["g", "x"], "blocks": [{"type": "kpi_row", "items": [{"label": "m", "aggregate": {"fn": "median", "column": "x"}}]}]}
    assert [x["value"] for x in report.compute(spec, t)[0]["items"]] == ["16"]
