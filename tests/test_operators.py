from datetime import datetime

import pytest
from pyspark.sql import functions as F

from limpid import Pipeline, Table
from limpid.operators import REGISTRY, Context
from limpid.operators.dedup import diverging_columns, find_duplicates
from limpid.operators.join import match_counts, names_for, resolve, unmatched, unmatched_right


def run(t, op, tables=None, **p):
    return REGISTRY[op](t, p, Context(dict(tables or {}))).collect()


def last(rows):
    return [r[-1] for r in rows]


@pytest.fixture
def people(spark):
    return Table.rows(spark, ["nom", "prenom", "naissance"], [("Fotso", "Bonito", "15/03/1998"), ("Kamga", "Alice", "02/11/2000")])


def test_columns(spark, people):
    assert last(run(people, "add_extract_column", name="x", column="naissance", mode="year")) == ["1998", "2000"]
    assert last(run(people, "add_extract_column", name="x", column="nom", mode="first_n", arg="3")) == ["Fot", "Kam"]
    assert last(run(people, "add_extract_column", name="x", column="nom", mode="regex_group", arg="([")) == ["", ""]
    assert last(run(people, "add_sequence_column", name="x", start=1, step=2)) == ["1", "3"]
    assert last(run(people, "add_concat_column", name="x", columns=["prenom", "nom"], separator=" ")) == ["Bonito Fotso", "Alice Kamga"]
    swapped = REGISTRY["rename_columns"](people, {"renames": {"nom": "prenom", "prenom": "nom"}}, Context())
    assert swapped.columns == ("prenom", "nom", "naissance") and swapped.collect()[0][0] == "Fotso"
    assert REGISTRY["reorder_columns"](people, {"order": ["naissance", "zzz"]}, Context()).columns == ("naissance", "nom", "prenom")
    with pytest.raises(KeyError, match="columns: nom"):
        run(people, "duplicate_column", column="zzz", name="x")


def test_expressions(spark):
    t = Table.rows(spark, ["a", "b"], [("2", "3"), ("10", "5"), ("Bon", "ito"), ("1", "")])
    node = lambda op: {"op": op, "left": {"column": "a"}, "right": {"column": "b"}}
    assert last(run(t, "add_expression_column", name="x", expression=node("+"))) == ["5", "15", "Bonito", "1"]
    assert last(run(t, "add_expression_column", name="x", expression=node("/")))[1:] == ["2", "", ""]


def test_normalise(spark):
    t = Table.rows(spark, ["nom"], [("  Fotso  ",), ("KAMGA",), ("déjà propre",), ("jean-paul o'neil (abc",)])
    assert last(run(t, "normalize_columns", columns=["nom"], steps=["trim", "upper"]))[:3] == ["FOTSO", "KAMGA", "DÉJÀ PROPRE"]
    assert last(run(t, "normalize_columns", columns=["nom"], steps=["strip_accents", "title"]))[2:] == ["Deja Propre", "Jean-paul O'neil (Abc"]


def test_filters(spark):
    t = Table.rows(spark, ["nom", "note"], [("Fotso", "15"), ("Kamga", "8"), ("Ngo", "")])
    where = lambda op, **x: {"column": "note", "operator": op, **x}
    names = lambda w, **p: [r[0] for r in run(t, "filter_rows", where=w, **p)]
    assert names(where("is_not_empty")) == ["Fotso", "Kamga"]
    assert names(where("is_not_empty"), action="delete") == ["Ngo"]
    assert names({"combinator": "or", "conditions": []}) == ["Fotso", "Kamga", "Ngo"]
    assert names(where("regex", value="(")) == []
    assert names(where("between", min="9", max="20")) == ["Fotso"]
    assert names({"column": "nom", "operator": "in_list"}) == []
    marked = run(t, "set_value_where", where=where("between", min="10"), target="d", match_value="A")
    assert last(marked) == ["A", "", ""]


def test_deduplicate(spark):
    t = Table.rows(spark, ["nom", "tel"], [("Fotso", ""), ("Fotso", "699"), ("Kamga", "677")])
    tel = lambda **p: last(run(t, "deduplicate", columns=["nom"], **p))
    assert tel(action="keep_first") == ["", "677"]
    assert tel(action="keep_last") == tel(action="keep_most_complete") == tel(action="merge_first_nonempty") == ["699", "677"]
    assert tel(action="flag_only") == ["oui", "oui", ""]
    assert tel(overrides={"Fotso": "keep_last"}) == ["699", "677"]
    mixed = [r for r in run(t, "deduplicate", columns=["nom"], overrides={"Fotso": "flag_only"})]
    assert mixed == [("Fotso", "", "oui"), ("Fotso", "699", "oui"), ("Kamga", "677", "")]
    again = Table.rows(spark, ["nom", "tel"], [("a", "1"), ("a", "2"), ("b", "3"), ("b", "4"), ("c", "5")])
    assert run(again, "deduplicate", columns=["nom"], action="flag_only", overrides={"b": "keep_last"}) == [("a", "1", "oui"), ("a", "2", "oui"), ("b", "4", ""), ("c", "5", "")]
    assert run(t, "deduplicate", columns=[]) == t.collect()
    assert [tuple(r) for r in find_duplicates(Table.rows(spark, ["nom"], [("Alice",), ("  alice  ",), ("Bob",)]), ["nom"]).collect()] == [("ALICE", 2)]
    assert diverging_columns(t, ["nom"]).first()["columns"] == ["tel"]


def test_exact_join(spark):
    left = Table.rows(spark, ["id", "nom"], [("1", "Fotso"), ("2", "Kamga"), ("3", "Ngo")])
    right = Table.rows(spark, ["ref", "nb"], [("1", "10"), ("2", "8"), ("1", "5"), ("1", "abc")])
    pair = [{"left": "id", "right": "ref"}]
    nb = lambda **p: last(run(left, "enrich_join", {"r": right}, table="r", pairs=pair, copied=["nb"], **p))
    assert nb() == ["10", "8", ""] and nb(type="inner") == ["10", "8"]
    assert nb(multiple="aggregate", rules={"nb": "sum"}) == ["15", "8", ""]
    assert nb(multiple="aggregate") == ["10, 5, abc", "8", ""] and nb(multiple="flag_conflict") == ["", "8", ""]
    assert match_counts(left, right, pair).first().asDict() == {"matched": 1, "ambiguous": 1, "unmatched_left": 1, "unmatched_right": 0}
    assert unmatched(left, right, pair).collect() == [("3", "Ngo")]
    assert names_for(("a", "b"), ["b", "c"], "suffix", "_droite") == {"b": "b_droite", "c": "c"}
    assert names_for(("a", "b"), ["b"], "skip", "") == {"b": None}


def test_fuzzy(spark):
    left = Table.rows(spark, ["nom", "annee"], [("FOTSO BONITO", "1998"), ("Alice Kamga", "2000"), ("Jean Dupont", "1995"), ("X", "1900")])
    right = Table.rows(spark, ["nom", "annee", "nb"], [("Bonito Fotso", "1998", "12"), ("Alice Kamgaa", "2000", "5"), ("Paul Ngo", "1995", "3")])
    p = {"pairs": [{"left": "annee", "right": "annee"}], "fuzzy": {"left": ["nom"], "right": ["nom"], "high": 90, "low": 60}}
    status = lambda p: [r.status for r in resolve(left, right, p).orderBy("left_ord").collect()]
    assert status(p) == ["auto", "auto", "rejected", "no_candidate"]
    assert last(run(left, "enrich_join", {"r": right}, table="r", copied=["nb"], **p)) == ["12", "5", "", ""]
    assert [r[0] for r in unmatched_right(left, right, p).collect()] == ["Paul Ngo"]
    own = {**p, "fuzzy": {**p["fuzzy"], "high": 99, "decisions": [{"left": "Alice Kamga", "right": "Alice Kamgaa", "decision": "validated"}], "forced": [{"left": "X", "right": "Paul Ngo"}]}}
    assert status(own) == ["auto", "manual", "rejected", "forced"]


def test_append(spark, people):
    other = Table.rows(spark, ["a", "b"], [("Ngo", "Paul")])
    rows = run(people, "append_rows", {"o": other}, table="o", mapping={"nom": "a", "prenom": "b"})
    assert rows[-1] == ("Ngo", "Paul", "") and len(rows) == 3


def test_summarize(spark):
    t = Table.rows(spark, ["ville", "note"], [("Douala", "10"), (" douala ", ""), ("Yaoundé", "1 234,56"), ("DOUALA", "20")])
    fns = ("count", "countDistinct", "countNonEmpty", "first", "concat", "sum", "avg", "min", "max", "median")
    rows = run(t, "summarize", group_by=[{"column": "ville", "normalization": "text"}], aggregates=[{"fn": f, "column": "note", "name": f} for f in fns])
    assert rows[0] == ("Douala", "3", "2", "2", "10", "10, 20", "30", "15", "10", "20", "15") and rows[1][0] == "Yaoundé"
    b = Table.rows(spark, ["v"], [("3",), ("12",), ("15",), ("x",), ("99",)])
    bins = lambda **how: run(b, "summarize", group_by=[{"column": "v", "binning": how}], aggregates=[{"fn": "count", "name": "n"}])
    assert bins(kind="explicit_boundaries", boundaries=[0, 10, 12, 16]) == [("0–10", "1"), ("10–12", "0"), ("12–16", "2"), ("(non numérique)", "1"), ("hors plage", "1")]
    assert bins(kind="fixed_width", width=50, start=0) == [("0–50", "3"), ("50–100", "1"), ("(non numérique)", "1")]
    assert run(Table.rows(spark, ["a"], []), "summarize", aggregates=[{"fn": "count", "name": "n"}]) == []
    with pytest.raises(ValueError):
        bins(kind="fixed_width", width=0)


def test_pipeline(spark, people):
    p = Pipeline().add("drop_columns", columns=["naissance"]).add("add_constant_column", name="x", value="1")
    assert p.apply(people).columns == ("nom", "prenom", "x") and p.undo().apply(people).columns == ("nom", "prenom")
    assert not p.can_redo and p.undo().can_redo and p.undo().redo() == p
    assert len(p.undo().add("drop_columns", columns=["nom"]).steps) == 2
    assert p.enable(p.steps[0].id, False).apply(people).columns == ("nom", "prenom", "naissance", "x")
    assert [r["rowsOut"] for r in p.reports(people)] == [2, 2]
    with pytest.raises(KeyError):
        p.add("nothing")


@pytest.mark.parametrize(("partitions", "adaptive", "advisory"), [(4, "true", "64m"), (200, "true", "64m"), (60, "true", "64k"), (60, "false", "64m")])
def test_dedup_of_sorted_tables(spark, partitions, adaptive, advisory):
    """No group is lost, whatever the partitions: rows aren't looked up by a place that a sort gave them."""
    new = {"spark.sql.shuffle.partitions": partitions, "spark.sql.adaptive.enabled": adaptive, "spark.sql.adaptive.advisoryPartitionSizeInBytes": advisory, "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in new}
    try:
        for k, v in new.items():
            spark.conf.set(k, v)
        df = spark.range(20_000).select((F.col("id") % 97).alias("a"), F.xxhash64("id").alias("b"), (F.col("id") % 4_000).cast("string").alias("k"), "id")
        t = Table.of(df.repartition(7), ["a", "b"])
        first = {r.k: r.id for r in df.groupBy("k").agg(F.min_by("id", F.struct("a", "b")).alias("id")).collect()}
        got = REGISTRY["deduplicate"](t, {"columns": ["k"], "action": "keep_first"}, Context()).output().collect()
        assert {r.k: int(r.id) for r in got} == first and len(got) == 4_000
        numbers = REGISTRY["add_sequence_column"](t, {"name": "n"}, Context()).output().collect()
        assert sorted(int(r.n) for r in numbers) == [*range(1, 20_001)]
        assert [int(r.id) for r in sorted(numbers, key=lambda r: int(r.n))] == [r.id for r in df.orderBy("a", "b").collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_order_of_files(spark, tmp_path):
    """Rows of Parquet files are in the order of the files and of their rows; filters reach the files."""
    spark.range(50).coalesce(1).write.parquet(f"{tmp_path}/t/a")
    spark.range(50, 90).coalesce(1).write.parquet(f"{tmp_path}/t/b")
    t = Table.parquet(spark, f"{tmp_path}/t/*")
    assert [int(r[0]) for r in t.collect()] == [*range(90)]
    kept = REGISTRY["filter_rows"](t, {"where": {"column": "id", "operator": "between", "min": "10", "max": "60"}}, Context())
    assert [int(r[0]) for r in kept.collect()] == [*range(10, 61)]
    assert "GreaterThanOrEqual(id" in kept.df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_types_under_the_text(spark):
    """Numbers, dates and nulls with a type of their own filter, add up and print as their texts would."""
    import datetime as dt

    rows = [(1, 12345678.5, "a", dt.date(2020, 1, 5)), (2, 0.0002, None, None), (3, None, "", dt.date(2021, 2, 3)), (4, float("nan"), "b", dt.date(1999, 12, 31)), (5, 1e22, "c", None), (6, -3.0, "A", None), (7, 1e-7, "z", None), (8, float("inf"), "i", None), (9, float("-inf"), "j", None)]
    t = Table.of(spark.createDataFrame(rows, "i int, x double, s string, d date"), ["i"])
    plain = Table.rows(spark, t.columns, t.collect())
    assert last([r[:2] for r in t.collect()]) == ["12345678.5", "0.0002", "", "NaN", "1e+22", "-3", "1e-7", "Infinity", "-Infinity"]
    wheres = [{"column": "x", "operator": "between", "min": lo, "max": hi} for lo, hi in ((None, "1"), ("-5", "0"), ("0.0001", None), ("1", "x"), ("-Infinity", "0x10"), ("5", "Infinity"), (None, "-1"))]
    wheres += [{"column": "d", "operator": "between", "min": lo, "max": hi} for lo, hi in (("2020", None), (None, "2020-06"), ("1990", "2000"), ("2020-01-05", "2021-02-03"))]
    wheres += [{"column": "s", "operator": op, "value": v, "values": ["a", v]} for op in ("eq", "neq", "contains", "starts_with", "is_empty", "is_not_empty", "in_list") for v in ("a", "")]
    for w in [*wheres, {"combinator": "or", "conditions": wheres[:2]}, {"conditions": wheres[11:13]}]:
        for action in ("keep", "delete"):
            assert run(t, "filter_rows", where=w, action=action) == run(plain, "filter_rows", where=w, action=action), w
    node = {"op": "+", "left": {"column": "x"}, "right": {"op": "*", "left": {"column": "i"}, "right": {"literal": "0.5"}}}
    assert last(run(t, "add_expression_column", name="y", expression=node)) == last(run(plain, "add_expression_column", name="y", expression=node))
    aggs = [{"fn": f, "column": "x", "name": f} for f in ("sum", "min", "max", "median", "countDistinct", "first")]
    assert run(t, "summarize", aggregates=aggs) == run(plain, "summarize", aggregates=aggs)


def test_bins(spark):
    """Edges in any order, on the edges, and too many bins."""
    t = Table.rows(spark, ["v"], [(str(x),) for x in (-1, 0, 0.5, 1, 2, 3, 4)] + [("x",)])
    of = lambda **how: run(t, "summarize", group_by=[{"column": "v", "binning": how}], aggregates=[{"fn": "count", "name": "n"}])
    for n in (1, 2, 3, 7, 8, 65, 100):
        edges = [i * 4 / n for i in range(n + 1)]
        got = dict(of(kind="explicit_boundaries", boundaries=edges))
        assert sum(int(v) for v in got.values()) == 8 and got["hors plage"] == "1" and len(got) == n + 2
    assert of(kind="explicit_boundaries", boundaries=[2, 0, 4])[:2] == [("2–0", "0"), ("0–4", "6")]
    with pytest.raises(ValueError, match="bins"):
        of(kind="fixed_width", width=1e-9)


def test_accents(spark):
    """Every character by its canonical decomposition, without the marks of U+0300 to U+036F."""
    import re
    import unicodedata

    chars = [chr(i) for i in range(0x20, 0x30000) if not 0xD800 <= i < 0xE000]
    texts = ["άλφα Ёлка й", "Ünïcôdé ḉ ﬁ", "e\u0301", "각 가나 힣", *["".join(chars[i : i + 500]) for i in range(0, len(chars), 500)]]
    t = Table.rows(spark, ["v"], [(x,) for x in texts])
    bare = lambda x: re.sub("[\u0300-\u036f]", "", "".join(unicodedata.normalize("NFD", c) for c in x))
    assert last(run(t, "normalize_columns", columns=["v"], steps=["strip_accents"])) == [bare(x) for x in texts]


def test_appended_orders(spark):
    """Appended rows come last whatever orders the two tables."""
    a = Table.of(spark.createDataFrame([(2, "b"), (1, "a")], "x int, y string"), ["x", "y"])
    b = Table.rows(spark, ["z"], [("c",), ("d",)])
    both = REGISTRY["append_rows"](a, {"table": "b", "mapping": {"y": "z"}}, Context({"b": b}))
    twice = REGISTRY["append_rows"](both, {"table": "a", "mapping": {"x": "x", "y": "y"}}, Context({"a": a}))
    assert twice.collect() == [("1", "a"), ("2", "b"), ("", "c"), ("", "d"), ("1", "a"), ("2", "b")]
    assert run(twice, "deduplicate", columns=["y"]) == [("1", "a"), ("2", "b"), ("", "c"), ("", "d")]


def test_any_column_names(spark):
    """Dots, spaces and backticks in names."""
    t = Table.of(spark.createDataFrame([(1, "x", 2.5), (2, "x", 3.0), (3, "y", None)], "`a.id` int, `my name` string, `b``c` double"), ["a.id"])
    assert run(t, "deduplicate", columns=["my name"], overrides={"x": "flag_only"}) == [("1", "x", "2.5", "oui"), ("2", "x", "3", "oui"), ("3", "y", "", "")]
    assert run(t, "filter_rows", where={"column": "b`c", "operator": "between", "min": "3"}) == [("2", "x", "3")]
    fuzzy = {"left": ["my name"], "right": ["my name"]}
    assert run(t, "enrich_join", {"t": t}, table="t", pairs=[{"left": "a.id", "right": "a.id"}], copied=["b`c"], fuzzy=fuzzy)[1] == ("2", "x", "3", "3")
    assert run(t, "enrich_join", {"t": t}, table="t", pairs=[{"left": "my name", "right": "my name"}], copied=["b`c"], multiple="aggregate", rules={"b`c": "sum"})[0] == ("1", "x", "2.5", "5.5")
    assert run(t, "summarize", group_by=[{"column": "my name"}], aggregates=[{"fn": "max", "column": "b`c", "name": "m.x"}]) == [("x", "3"), ("y", "")]
    assert run(t, "append_rows", {"t": t}, table="t", mapping={"a.id": "a.id", "my name": "b`c"})[-1] == ("3", "", "")
    assert last(run(t, "add_sequence_column", name="n.o")) == ["1", "2", "3"]


def test_deduplication_carries_values(spark, tmp_path):
    """Rows go through the aggregate with their numbers and times as such, and come out with the same texts."""
    rows = [(k, 9 - k, k % 3 if k % 4 else None, None if k % 2 else k / 8, "" if k < 3 else f"t{k}", datetime(2024, 1, 1 + k), datetime(2024, 1, 2, k, 0, 1)) for k in range(9)]
    schema = "a long, b int, g long, x double, s string, d timestamp, e timestamp_ntz"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "t"))
    t = Table.of(spark.read.parquet(str(tmp_path / "t")), ["a", "b"])
    texts = Table(t.df.drop(*[n for n, _ in t.native.values()]), t.columns)
    for action in ("keep_first", "keep_last", "keep_most_complete", "merge_first_nonempty"):
        for overrides in ({}, {"1": "keep_last"}):
            got, want = (run(x, "deduplicate", columns=["g"], action=action, overrides=overrides) for x in (t, texts))
            assert got == want and len(got) == 4
    plan = REGISTRY["deduplicate"](t, {"columns": ["g"], "action": "keep_first"}, Context()).output()._jdf.queryExecution().executedPlan().toString()
    assert " as string)" not in plan[plan.index("Exchange") :]
