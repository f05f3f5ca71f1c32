"""Quoted line breaks read in ranges, and CSV written as one file."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from limpid.sources import csv as source
from limpid.sources import one_file
from limpid.sources.quoted import ends_inside
from limpid.table import Table


@pytest.fixture
def small_ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def cell(rng):
    return rng.choice(["plain", "", "a,b", 'say "hi"', "two\nlines", "three\r\n\r\nlines", '"', '"\n"', ",\n,", "é\n" * rng.randrange(60), "x" * rng.randrange(200)])


def written(rng, n, end):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end)
    w.writerow(["a", "b", "c"])
    rows = [[cell(rng) for _ in range(3)] for _ in range(n)]
    w.writerows(rows)
    return out.getvalue(), [r for r in rows if any(x.strip() for x in r)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_ranges_equal_one_task(spark, small_ranges, tmp_path, end):
    rng = random.Random(len(end))
    expected = []
    for k in range(3):
        text, rows = written(rng, 300, end)
        (tmp_path / f"{k}.csv").write_text("﻿" * (k == 1) + text, newline="")
        expected += rows
    got = source.read_csv(spark, str(tmp_path), ",")
    assert got.columns == ("a", "b", "c") and [list(r) for r in got.collect()] == expected
    raw, *_ = source.raw_rows(spark, str(tmp_path), ",")
    ranges = raw.groupBy("file", "block").count().count()
    assert ranges > 30  # of a file of some 30,000 bytes each, none is one task
    # Spark's own reader of whole files turns line ends in cells into line feeds.
    one = spark.read.csv(str(tmp_path / "0.csv"), header=True, multiLine=True, quote='"', escape='"')
    mine = source.read_csv(spark, str(tmp_path / "0.csv"), ",").output()
    assert sorted(tuple(x.replace("\r\n", "\n") for x in r) for r in mine.collect()) == sorted(tuple((x or "").replace("\r\n", "\n") for x in r) for r in one.collect() if any((x or "").strip() for x in r))


def test_long_cell_and_open_quote(spark, small_ranges, tmp_path):
    """A cell longer than many ranges, lines without quotes in it; a quote that never ends."""
    long = "\n".join(f"line {i}" for i in range(3000))
    file = tmp_path / "x.csv"
    file.write_text(f'a,b\n1,"{long}"\n2,z\n3,"open\nto the\nend', newline="")
    assert source.read_csv(spark, str(file), ",").collect() == [("1", long), ("2", "z"), ("3", "open\nto the\nend")]


def files(folder):
    return sorted(x.name for x in folder.iterdir())


def test_one_file(spark, tmp_path, monkeypatch):
    """One file with one header and one mark, written and joined by many tasks, in the rows' order."""
    monkeypatch.setattr(one_file, "PIECE", 1000)
    rng = random.Random(5)
    rows = [(str(i), cell(rng), cell(rng)) for i in range(2000)]
    df = spark.createDataFrame([(int(a), b, c) for a, b, c in rows], "i long, `b;c` string, d string").repartition(7)
    t = Table.of(df, ["i"])
    path = tmp_path / "out.csv"
    source.write_csv(t, str(path), single=True)
    raw = path.read_bytes()
    assert path.is_file() and files(tmp_path) == ["out.csv"]
    assert raw.startswith("\ufeffi;\"b;c\";d\n".encode()) and raw.count("\ufeff".encode()) == 1
    got = list(csv.reader(io.StringIO(raw.decode("utf-8-sig"), newline=""), delimiter=";"))
    assert [tuple(r) for r in got] == [("i", "b;c", "d"), *rows]
    with pytest.raises(Exception, match="out.csv"):
        source.write_csv(t, str(path), single=True)
    source.write_csv(t.select({"i": "i"}), str(path), single=True, overwrite=True, bom=False)
    assert path.read_text() == "i\n" + "".join(f"{i}\n" for i in range(2000))
    assert source.read_csv(spark, str(path)).columns == ("i",)


def test_one_file_of_none_and_failure(spark, tmp_path):
    t = Table.rows(spark, ["a", "b"], [])
    source.write_csv(t, str(tmp_path / "none.csv"), single=True, bom=False)
    assert (tmp_path / "none.csv").read_text() == "a;b\n" and files(tmp_path) == ["none.csv"]
    bad = Table.of(spark.range(100).select("id", F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise("x").alias("b")), ["id"])
    with pytest.raises(Exception, match="no"):
        source.write_csv(bad, str(tmp_path / "bad.csv"), single=True)
    assert files(tmp_path) == ["none.csv"]


def test_joined_by_the_driver(spark, tmp_path, monkeypatch):
    """Where a store lets tasks write to no offset, parts go through the driver, some bytes at a time."""
    monkeypatch.setattr(one_file, "AT_OFFSETS", ())
    t = Table.of(spark.range(500).repartition(5), ["id"])
    source.write_csv(t, str(tmp_path / "x.csv"), single=True, bom=False)
    assert (tmp_path / "x.csv").read_text() == "id\n" + "".join(f"{i}\n" for i in range(500)) and files(tmp_path) == ["x.csv"]


def test_ends_inside():
    for line, outside, inside in (("a,b", False, True), ('a,"b', True, False), ('"a"', False, True), ('a""', False, True), ('"a""', True, False), ('5" pipe,x', False, False), ('"a"x,"b', True, False), ('","', False, False), ("", False, True), ('"', True, False), ('a,""', False, True)):
        assert ends_inside(line, False, ",") == outside, line
    assert not ends_inside('b""c",d', True, ",") and ends_inside('b""c', True, ",") and ends_inside('b",d,"e', True, ",")


def test_carriage_returns_alone(spark, tmp_path):
    file = tmp_path / "x.csv"
    file.write_text('a,b\r1,"x\ry"\r2,z\r', newline="")
    assert [r[0] for r in source.read_csv(spark, str(file), ",").collect()] == ["1", "2"]
