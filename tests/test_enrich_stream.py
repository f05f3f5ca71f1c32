"""A stream joined to partners that change while it runs, stopped, started again and run twice."""

import shutil

import pytest

from limpid.operators import REGISTRY, Context
from limpid.streaming.enrich import Partners, enrich_stream, results
from limpid.table import Table

JOIN = {"pairs": [{"left": "k", "right": "ref", "normalize": "text"}], "copied": ["n", "k"], "multiple": "aggregate", "rules": {"n": "sum"}}


def right(spark, n):
    return Table.rows(spark, ["ref", "n", "k"], [("A", n, "x"), (" a", n, "y"), ("b", n, "z"), ("b ", "?", "")])


def wanted(spark, rows, n, **how):
    out = REGISTRY["enrich_join"](Table.rows(spark, ["id", "k"], rows), {**JOIN, "table": "r", **how}, Context({"r": right(spark, n)}))
    return sorted(out.collect())


def test_versions_and_replay(spark, tmp_path):
    rows = [(str(i), "aAbc "[i % 5]) for i in range(20)]
    partners = Partners(spark, str(tmp_path / "partners"), JOIN)
    assert partners.versions() == []

    def run(part):
        for i in part:
            spark.createDataFrame(rows[10 * i : 10 * i + 10], "id string, k string").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        source = spark.readStream.schema("id string, k string").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        enrich_stream(source, partners, str(tmp_path / "out"), str(tmp_path / "state"), "q").awaitTermination()
        return sorted(map(tuple, results(spark, str(tmp_path / "out")).select("id", "k", "n", "k_droite", "partners_version", "batch").collect()))

    told = lambda got, batch, version: [r[:4] for r in got if r[4:] == (version, batch)]
    assert partners.publish(right(spark, "2")) == 1
    got = run([0])
    assert told(got, 0, 1) == wanted(spark, rows[:10], "2") and len(got) == 10
    assert partners.publish(right(spark, "5")) == 2
    got = run([1])
    assert told(got, 0, 1) == wanted(spark, rows[:10], "2") and told(got, 1, 2) == wanted(spark, rows[10:], "5") and len(got) == 20
    # The second batch has written its rows, but its end isn't noted: it runs again, when there is a newer version.
    partners.publish(right(spark, "9"))
    for f in (tmp_path / "state/commits").glob("*1*"):
        f.unlink()
    shutil.rmtree(tmp_path / "out/batch=1")
    assert run([]) == got
    partners.forget(keep=[2])
    assert partners.versions() == [2, 3]


def test_inner_and_refusals(spark, tmp_path):
    partners = Partners(spark, str(tmp_path / "partners"), {**JOIN, "type": "inner"})
    with pytest.raises(LookupError):
        partners.pinned("q", 0)
    (tmp_path / "partners/v7").mkdir(parents=True)  # a version that never got complete
    assert partners.versions() == [] and partners.publish(right(spark, "3")) == 1
    rows = [("1", "a"), ("2", "c")]
    spark.createDataFrame(rows, "id string, k string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id string, k string").parquet(str(tmp_path / "in"))
    enrich_stream(source, partners, str(tmp_path / "out"), str(tmp_path / "state"), "q").awaitTermination()
    assert sorted(map(tuple, results(spark, str(tmp_path / "out")).select("id", "k", "n", "k_droite").collect())) == wanted(spark, rows, "3", type="inner")
    with pytest.raises(ValueError, match="equal keys"):
        Partners(spark, str(tmp_path), {**JOIN, "fuzzy": {}} | {"fuzzy": {"low": 0.5}})
    with pytest.raises(ValueError, match="batch"):
        enrich_stream(source.withColumnRenamed("id", "batch"), partners, "", "", "q")
