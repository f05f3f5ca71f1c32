"""Streams of files in any order, stopped and started again, against the same rows at once."""

import random
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from limpid.operators import REGISTRY, Context
from limpid.plans import catalogue, catalogue_rules  # noqa: F401
from limpid.streaming.keyed import deduplicate_stream, late_rows, summarize_stream
from limpid.table import Table

SCHEMA = "id long, ts timestamp, user string, kind string, value double"
BEGIN = datetime(2024, 1, 1)
SIDE = {"event_time": "ts", "delay": "300 days"}


def events(n=240, seed=4):
    rng = random.Random(seed)
    return [(i, BEGIN + timedelta(minutes=rng.randrange(60 * 24 * 20)), rng.choice(["A", " a", "b", "C"]) + str(rng.randrange(4)), rng.choice(["x", "y", ""]), float(rng.randrange(100))) for i in range(n)]


@pytest.fixture
def files(spark, tmp_path):
    """Each file a few rows of any time; the last one ends all windows."""
    rows = events()
    for k in range(6):
        spark.createDataFrame(rows[k::6], SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"all/{k}"))
    spark.createDataFrame([(10**6, BEGIN + timedelta(days=3000), "end", "end", 0.0)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "all/9"))
    return tmp_path, rows


def streamed(spark, tmp_path, make):
    """What a stream writes that first sees half of the files and then, started again, the rest."""
    (tmp_path / "seen").mkdir()
    for part in ([4, 0, 2], [5, 1, 3], [9]):
        for k in part:
            shutil.copytree(tmp_path / f"all/{k}", tmp_path / f"seen/{k}")
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "seen"))
        query = make(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
        assert late_rows(query) == 0
    return spark.read.parquet(str(tmp_path / "out"))


@pytest.mark.parametrize("action", ["keep_first", "keep_last", "keep_most_complete", "merge_first_nonempty"])
def test_deduplicate(spark, files, action):
    tmp_path, rows = files
    how = {"columns": ["user"], "action": action, "mode": "normalized", "gap": "9000 minutes", "order_by": ["id"], **SIDE}
    got = streamed(spark, tmp_path, lambda df: deduplicate_stream(df, **how)).filter("user <> 'end'")
    static = deduplicate_stream(spark.createDataFrame(rows, SCHEMA), **how)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, static.collect())) and got.count() >= 12
    if action != "keep_first":
        return
    # With a gap that all rows are within, a group is what the operator on tables makes of it.
    one = deduplicate_stream(spark.createDataFrame(rows, SCHEMA), **{**how, "gap": "400 days"})
    table = REGISTRY["deduplicate"](Table.of(spark.createDataFrame(rows, SCHEMA), ["id"]), {"columns": ["user"], "mode": "normalized", "action": action}, Context())
    assert sorted(map(tuple, one.collect())) == sorted(table.collect())


def test_summarize(spark, files):
    tmp_path, rows = files
    aggs = [{"fn": "count", "name": "n"}, {"fn": "sum", "column": "value", "name": "s"}, {"fn": "first", "column": "kind", "name": "f"}, {"fn": "concat", "column": "kind", "name": "c"}, {"fn": "max", "column": "value", "name": "m"}]
    how = {"group_by": [{"column": "user", "normalization": "text"}], "aggregates": aggs, "window": "3 days", "order_by": ["id"], **SIDE}
    got = streamed(spark, tmp_path, lambda df: summarize_stream(df, **how)).filter("user <> 'end'")
    static = summarize_stream(spark.createDataFrame(rows, SCHEMA), **how)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, static.collect())) and sum(int(r.n) for r in got.collect()) == len(rows)
    slid = summarize_stream(spark.createDataFrame(rows, SCHEMA), **{**how, "slide": "1 day"})
    assert sum(int(r.n) for r in slid.collect()) == 3 * len(rows)


def test_late_rows_and_refusals(spark, files):
    tmp_path, _ = files
    (tmp_path / "seen").mkdir()
    make = lambda df: summarize_stream(df, [{"column": "user"}], [{"fn": "count", "name": "n"}], "ts", "1 hour", "1 minute")
    for part in (9, 0):
        shutil.copytree(tmp_path / f"all/{part}", tmp_path / f"seen/{part}")
        source = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "seen"))
        query = make(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
    assert late_rows(query) > 30
    df = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        deduplicate_stream(df, ["user"], "ts", "1 hour", "1 hour", action="flag_only")
    with pytest.raises(ValueError):
        summarize_stream(df, [], [{"fn": "countDistinct", "column": "user", "name": "n"}], "ts", "1 hour", "1 hour")
    assert deduplicate_stream(df, ["user"], "ts", "1 hour", "1 hour").collect() == [] and F.lit(1) is not None


def test_windows_of_rounded_seconds(spark, tmp_path):
    """The query's days are those of times to the nearest second, halves to the even one, as in its SQL."""
    late = datetime(2024, 1, 1, 23, 59, 59)
    times = [BEGIN, late + timedelta(microseconds=499_999), late + timedelta(microseconds=500_000), late - timedelta(microseconds=500_000), late + timedelta(days=1, microseconds=999_999)]
    rows = [(i, ts, "x", 1.0) for i, ts in enumerate(times)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = catalogue.QUERIES["stream_windows"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(19723, "x", "3", "0"), (19724, "x", "1", "2"), (19725, "x", "1", "4")]
