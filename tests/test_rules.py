"""Counters told by the job that writes, patterns as Java reads them, bins without limits."""

import pytest
from pyspark.sql import functions as F

from limpid import api
from limpid.functions.patterns import groups_of, pattern
from limpid.operators import REGISTRY, Context
from limpid.plans.pipeline import Pipeline
from limpid.table import Table

ROWS = [("1", "Fotso", "15"), ("2", " kamga ", "8"), ("3", "FOTSO", ""), ("4", "Ngo", "12"), ("5", "Fotso", "15")]


def run(t, name, /, **params):
    return REGISTRY[name](t, params, Context())


def jobs(spark, group, f):
    spark.sparkContext.setJobGroup(group, group)
    try:
        return f(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def history():
    p = Pipeline().add("set_value_where", target="note", where={"column": "note", "operator": "is_empty"}, match_value="0").add("normalize_columns", columns=["nom"], steps=["trim", "upper"])
    p = p.add("filter_rows", where={"column": "nom", "operator": "neq", "value": "NGO"})
    off = p.add("drop_columns", columns=["note"])
    return off.enable(off.steps[-1].id, False)


def test_counters_come_with_the_rows(spark):
    t = Table.rows(spark, ["id", "nom", "note"], ROWS)
    (out, steps), n = jobs(spark, "one-job", lambda: history().run(t))
    assert n == 1 and out.collect() == [("1", "FOTSO", "15"), ("2", "KAMGA", "8"), ("3", "FOTSO", "0"), ("5", "FOTSO", "15")]
    assert [(s["type"], s["rowsIn"], s["rowsOut"], s["rowsRemoved"], s.get("rowsModified")) for s in steps] == [("set_value_where", 5, 5, 0, 1), ("normalize_columns", 5, 5, 0, 4), ("filter_rows", 5, 4, 1, None)]
    assert steps == history_ids(history().reports(t), steps)


def history_ids(reports, steps):
    """The same reports with the ids of other steps."""
    return [{**r, "step": s["step"]} for r, s in zip(reports, steps, strict=True)]


@pytest.mark.parametrize("kind", ["left", "inner"])
def test_counters_of_joins_and_groups(spark, kind):
    t = Table.rows(spark, ["id", "nom", "note"], ROWS)
    right = Table.rows(spark, ["ref", "x"], [("1", "a"), ("1", "b"), ("2", "c"), ("9", "d")])
    p = Pipeline().add("deduplicate", columns=["nom"], action="keep_first", overrides={"Fotso": "flag_only"}).add("append_rows", table="more", mapping={"id": "id"})
    p = p.add("enrich_join", table="right", pairs=[{"left": "id", "right": "ref"}], copied=["x"], type=kind).add("summarize", group_by=[{"column": "x"}], aggregates=[{"fn": "count", "name": "n"}])
    tables = {"right": right, "more": Table.rows(spark, ["id"], [("7",), ("8",)])}
    out, steps = p.run(t, tables)
    assert steps == p.reports(t, tables)
    assert steps[0]["duplicateRows"] == 2 and steps[1]["rowsAdded"] == 2
    assert {k: steps[2][k] for k in ("unmatched", "ambiguous", "matchedAuto")} == {"unmatched": 5, "ambiguous": 1, "matchedAuto": 2}
    assert sorted(out.collect()) == ([("", "5")] if kind == "left" else []) + [("a", "1"), ("c", "1")]


def test_states_of_steps_that_are_off(spark):
    p = history()
    states = p.states(Table.rows(spark, ["id", "nom", "note"], ROWS))
    assert len(states) == 4 and states[3][2] is states[3][1] and states[3][3] == {} and states[3][2].columns == ("id", "nom", "note")
    assert len(Pipeline().run(Table.rows(spark, ["a"], [("1",)]))[1]) == 0


def test_apply_to_one_file(spark, tmp_path):
    (tmp_path / "in.csv").write_text("nom\n a \nb\n a \n")
    got = api.apply_pipeline(spark, str(tmp_path / "in.csv"), [{"type": "normalize_columns", "params": {"columns": ["nom"], "steps": ["trim"]}}], str(tmp_path / "out.csv"), single=True)
    assert (tmp_path / "out.csv").read_text() == "﻿nom\na\nb\na\n" and got["steps"][0]["rowsModified"] == 2 and got["totalCount"] == 3


def test_patterns(spark):
    t = Table.rows(spark, ["a"], [("2020-x",), ("x",), ("aa_aa",)])
    kept = lambda v: [r[0] for r in run(t, "filter_rows", where={"column": "a", "operator": "regex", "value": v}).collect()]
    taken = lambda v: [r[1] for r in run(t, "add_extract_column", column="a", name="b", mode="regex_group", arg=v).collect()]
    assert kept(r"(?<y>\d{4})") == ["2020-x"] and taken(r"(?<y>\d{4})") == ["2020", "", ""]
    assert kept(r"(?<my_w>a+)_\k<my_w>") == ["aa_aa"] and taken(r"(?<my_w>a+)_\k<my_w>") == ["", "", "aa"]
    for bad in (r"(?P<y>\d{4})", "(", "[", r"(?<a>x)\k<b>"):
        assert groups_of(bad) is None and kept(bad) == [] and taken(bad) == ["", "", ""]
    assert pattern(r"\(?<x>") == r"\(?<x>" and taken("x") == ["", "", ""] and groups_of("(a)(?:b)(c)") == 2


def test_many_bins(spark):
    import time

    df = spark.range(1000).select("id", (F.col("id") % 200).alias("a"), (F.col("id") * 7 % 211).alias("b"))
    t, n = Table.of(df, ["id"]), [{"fn": "count", "name": "n"}]
    by = [{"column": c, "binning": {"kind": "fixed_count", "count": 200}} for c in ("a", "b")]
    run(t, "summarize", group_by=by, aggregates=n).output().count()
    begin = time.time()
    out = run(t, "summarize", group_by=by, aggregates=n)
    assert time.time() - begin < 3
    rows = out.collect()
    assert len(rows) == 40_000 and sum(int(r[2]) for r in rows) == 1000 and rows[0][:2] == ("0–0.995", "0–1.05")
    fine = run(t, "summarize", group_by=[{"column": "id", "binning": {"kind": "fixed_width", "width": 0.05}}], aggregates=n).collect()
    assert len(fine) > 19_000 and sum(int(r[1]) for r in fine) == 1000 and fine[0] == ("0–0.05", "1")
    with pytest.raises(ValueError, match="too small"):
        run(t, "summarize", group_by=[{"column": "id", "binning": {"kind": "fixed_width", "width": 1e-300}}], aggregates=n)


def test_bins_found_in_executors(spark):
    """Edges, beyond them, no number, and more bins than are tried one by one; against the same bins in few."""
    values = ["0", "100", "99.999", "100.001", "-1", "50", "", "x", "33"]
    t = Table.rows(spark, ["v"], [(v,) for v in values])
    many = {"kind": "explicit_boundaries", "boundaries": [*range(101)]}
    got = dict(run(t, "summarize", group_by=[{"column": "v", "binning": many}], aggregates=[{"fn": "count", "name": "n"}]).collect())
    assert {k: v for k, v in got.items() if v != "0"} == {"0–1": "1", "33–34": "1", "50–51": "1", "99–100": "2", "(non numérique)": "2", "hors plage": "2"} and len(got) == 102
