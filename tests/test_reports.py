"""Reports from one scan, their limits, checks and the format's own names."""

import json

import pytest
from pyspark.sql import functions as F

from limpid import api
from limpid.operators import REGISTRY, Context
from limpid.operators.summarize import summarize_many
from limpid.plans import report
from limpid.table import Table

ROWS = [("Fotso", "15", "Admis"), ("Kamga", "8", "Recalé"), ("Ngo", "12,5", "admis"), ("Mballa", "", "Admis"), ("Abena", "x", "")]
COLUMNS = ["nom", "note", "decision"]
#: A spec as files of the format name things.
SPEC = {
    "formatVersion": 1,
    "kind": "report",
    "title": "t",
    "subtitle": "s",
    "expectedColumns": COLUMNS,
    "blocks": [
        {"type": "text", "content": "c"},
        {"type": "kpi_row", "items": [{"label": "n", "agg": {"fn": "count"}}, {"label": "mean", "agg": {"fn": "avg", "column": "note"}, "format": "number"}, {"label": "n", "agg": {"fn": "countDistinct", "column": "decision"}}]},
        {"type": "chart", "chartType": "bar", "title": "x", "summarize": {"groupBy": [{"column": "decision", "normalization": "text"}], "aggregates": [{"fn": "count", "asName": "effectif"}, {"fn": "concat", "column": "nom", "asName": "who", "separator": "+"}]}, "x": "decision", "series": [{"column": "effectif", "label": "Candidats"}, {"column": "who"}], "caption": "y"},
        {"type": "chart", "chartType": "histogram", "summarize": {"groupBy": [{"column": "note", "normalization": "raw", "binning": {"kind": "explicit_boundaries", "boundaries": [0, 10, 20]}}], "aggregates": [{"fn": "count", "asName": "effectif"}]}, "x": "note", "series": [{"column": "effectif"}]},
        {"type": "page_break"},
        {"type": "table", "columns": ["nom"], "filter": {"kind": "group", "operator": "or", "conditions": [{"kind": "condition", "columnId": "decision", "operator": "eq", "value": "Admis"}, {"kind": "condition", "columnId": "nom", "operator": "starts_with", "value": "K"}]}, "maxRows": 2},
        {"type": "table", "columns": ["nom", "note"]},
    ],
}


def test_own_names(spark, tmp_path):
    assert report.validate(SPEC) == []
    t = Table.rows(spark, COLUMNS, ROWS)
    text, kpis, bar, histogram, _, some, every = report.compute(SPEC, t)
    assert text == {"kind": "text", "text": "c"} and [x["value"] for x in kpis["items"]] == ["5", "11.8333", "3"]
    assert bar["categories"] == ["Admis", "Recalé", ""] and bar["series"] == {"effectif": ["3", "1", "1"], "who": ["Fotso+Ngo+Mballa", "Kamga", "Abena"]} and bar["labels"] == {"effectif": "Candidats"} and bar["caption"] == "y"
    assert histogram["categories"] == ["0–10", "10–20", "(non numérique)"] and histogram["series"]["effectif"] == ["1", "2", "2"]
    assert some["rows"] == [["Fotso"], ["Kamga"]] and some["totalMatching"] == 3 and some["truncated"]
    assert every["rows"] == [list(r[:2]) for r in ROWS] and not every["truncated"]
    (tmp_path / "x.csv").write_text("Nom,Note,Decision\nA,1,Admis\n")
    got = api.import_report(spark, json.dumps(SPEC), str(tmp_path / "x.csv"))
    assert got["errors"] == [] and got["mapping"] == {"nom": "Nom", "note": "Note", "decision": "Decision"}
    assert api.build_report(spark, str(tmp_path / "x.csv"), got["spec"], got["mapping"])[6]["rows"] == [["A", "1"]]


def test_one_scan(spark):
    """All numbers, charts and totals come of one scan, as the same summaries do one by one."""
    df = spark.range(500).select("id", (F.col("id") % 7).cast("string").alias("a"), F.concat(F.lit(" v"), F.col("id") % 3).alias("b"), (F.col("id") * 37 % 101).alias("c"))
    t = Table.of(df, ["id"])
    fns = ("count", "countDistinct", "countNonEmpty", "sum", "avg", "min", "max", "median", "first", "concat")
    aggs = [{"fn": f, "column": "c", "name": f} for f in fns]
    where = {"column": "a", "operator": "eq", "value": "3"}
    every = [{"aggregates": [*aggs, {"fn": "count", "where": where, "name": "threes"}]}, {"group_by": [{"column": "a"}], "aggregates": aggs}, {"group_by": [{"column": "b", "normalization": "text"}, {"column": "c", "binning": {"kind": "fixed_count", "count": 5}}], "aggregates": aggs[:3]}]
    many = summarize_many(t, every)
    for p, got in zip(every, many, strict=True):
        assert got.collect() == REGISTRY["summarize"](t, p, Context()).collect()
    assert many[0].output().first().threes == "71"
    source = Table.of(spark.range(9).withColumn("x", F.lit("1")).select("id", "x"), ["id"])
    seen = []
    keep = report.summarize_many
    report.summarize_many = lambda table, ps: seen.append(len(ps)) or keep(table, ps)
    try:
        report.compute({"version": 1, "title": "t", "blocks": [{"kind": "kpi_row", "items": [{"aggregate": {"fn": "count"}}]}, {"kind": "chart", "chart": "bar", "x": "x", "series": ["n"], "summarize": {"group_by": [{"column": "x"}], "aggregates": [{"fn": "count", "name": "n"}]}}]}, source)
    finally:
        report.summarize_many = keep
    assert seen == [2]


def test_empty_table(spark):
    t = Table.rows(spark, COLUMNS, [])
    _, kpis, bar, _, _, some, every = report.compute(SPEC, t)
    assert [x["value"] for x in kpis["items"]] == ["", "", ""] and bar["categories"] == [] and some["rows"] == every["rows"] == [] and every["totalMatching"] == 0


def test_tables_without_limit(spark, monkeypatch):
    t = Table.of(spark.range(100), ["id"])
    block = {"version": 1, "title": "t", "blocks": [{"kind": "table", "columns": ["id"]}]}
    assert len(report.compute(block, t)[0]["rows"]) == 100
    monkeypatch.setattr(report, "COLLECTED", 50)
    own = report.compute(block, t)[0]
    assert "rows" not in own and own["frame"].count() == 100 and not own["truncated"]


@pytest.mark.parametrize("block", [
    {"kind": "chart", "chart": "bar", "summarize": {"group_by": ["a"], "aggregates": ["x"]}}, {"kind": "chart", "chart": "bar", "summarize": {"group_by": "a", "aggregates": 3}}, {"kind": "chart", "summarize": []},
    {"kind": "table", "filter": "x"}, {"kind": "table", "filter": {"conditions": "x"}}, {"kind": "table", "columns": "a", "max_rows": "2"}, {"kind": "table", "filter": {"operator": [], "column": {}}},
    {"kind": "kpi_row", "items": ["x"]}, {"kind": "kpi_row", "items": {}}, {"kind": "kpi_row", "items": [{"aggregate": "x"}]}, {"kind": "kpi_row"}, {"kind": "kpi_row", "items": [{"aggregate": {"fn": "count"}, "format": "x"}]}, {"kind": []}, "x", None, {"kind": "text", "text": 1},
    {"kind": "chart", "chart": "bar", "x": "a", "series": [{}], "summarize": {"group_by": [{"column": "a", "binning": {"kind": "explicit_boundaries", "boundaries": ["x"]}}], "aggregates": [{"fn": "count", "name": "n"}]}},
    {"kind": "chart", "chart": "bar", "x": "a", "series": 5, "summarize": {"group_by": [{"column": "a", "binning": "x"}], "aggregates": [{"fn": {}, "name": "n"}]}},
])
def test_checks_never_raise(block):
    assert report.validate({"version": 1, "title": "t", "blocks": [block]}) != []


def test_checks():
    for part in ({"kind": "x"}, {"subtitle": 1}, {"expectedColumns": ["a", 1]}, {"expectedColumns": "a"}, {"title": None}, {"formatVersion": 2}, {"blocks": {}}):
        assert report.validate({**SPEC, **part}) != [], part
    wrong = {**SPEC, "expectedColumns": ["nom"]}
    assert [e.split(":")[0] for e in report.validate(wrong)] == ["$.blocks[1].items[1].aggregate.column", "$.blocks[1].items[2].aggregate.column", "$.blocks[2].summarize.group_by[0].column", "$.blocks[3].summarize.group_by[0].column", "$.blocks[5].filter.conditions[0].column", "$.blocks[6].columns[1]"]
