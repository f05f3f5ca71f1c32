import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from limpid import Pipeline, Table, api
from limpid.functions import numbers
from limpid.functions.fuzzy import jaro, jaro_many, jaro_winkler
from limpid.plans import anonymise, recipe, report
from limpid.plans.profile import anomaly_examples, odd_case, profile, top_values
from limpid.sources import read_csv, table_from_text, write_csv
from limpid.streaming import apply_steps


def test_numbers(spark):
    texts = ["1 234,56", "1 234,56", "1.234,56", "1,234.56", "", "12abc", "-", "0,0", "1f", "nan", "1,2,3", "0x1F", "0b101", "0O17", "+Infinity", "-Infinity", "-0x1", "0xg", "infinity"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.x for r in df.select("i", numbers.tolerant(df.t).alias("x")).orderBy("i").collect()]
    assert got == [1234.56] * 4 + [None] * 3 + [0.0] + [None] * 3 + [31.0, 5.0, 15.0, float("inf"), float("-inf"), None, None, None]
    plain = ["0x1F", "0b101", "-Infinity", " 5 ", "", "x", "1e3", "-0x1"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(plain)], "i int, t string").select("i", numbers.strict(F.col("t")).alias("x")).orderBy("i").collect()
    assert [r.x for r in rows] == [numbers.parsed(t) for t in plain] == [31.0, 5.0, float("-inf"), 5.0, 0.0, None, 1000.0, None]
    df = spark.createDataFrame([(0, 15.0), (1, 1e7), (2, 0.0002), (3, 11.66666), (4, -0.00001), (5, None)], "i int, x double")
    assert [r.s for r in df.select("i", numbers.written(df.x).alias("s")).orderBy("i").collect()] == ["15", "10000000", "0.0002", "11.6667", "0", ""]


def test_jaro_winkler():
    assert jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.9611, abs=1e-4)
    assert jaro_winkler("", "A") == 0 and jaro_winkler("", "") == 1
    import random

    rng = random.Random(3)
    pairs = [("".join(rng.choices("ABCDÉ 😀", k=rng.randrange(25))), "".join(rng.choices("ABCDÉ 😀", k=rng.choice([0, 3, 20, 90])))) for _ in range(2000)]
    for winkler, one in ((False, jaro), (True, jaro_winkler)):
        assert jaro_many([a for a, _ in pairs], [b for _, b in pairs], winkler).tolist() == [one(a, b) for a, b in pairs]
    assert jaro_many([], [], True).tolist() == []


def test_profile(spark):
    t = Table.rows(spark, ["a", "b", "c"], [("007", "oui", "DUPONT"), ("042", "non", "Durand"), ("123", "oui", "Petit  x"), ("", "", "YaoundÃ© ")])
    own = {r["column"]: r for r in profile(t).collect()}
    assert [own[c]["type"] for c in "abc"] == ["integer", "boolean", "text"] and own["a"]["fill_rate"] == 0.75
    assert (own["c"]["outer_spaces"], own["c"]["double_spaces"], own["c"]["broken_encoding"]) == (1, 1, 1)
    assert top_values(t).filter("column = 'b' and rank = 1").first()["value"] == "oui"
    assert odd_case(t).count() >= 1
    for r in anonymise.sample(t):
        assert r["a"] == "" or (len(r["a"]) == 3 and r["a"].isdigit())
    assert "DUPONT" not in anonymise.assistant_export(t)


def test_recipe(spark):
    t = Table.rows(spark, ["nom"], [("  fotso  ",), ("KAMGA",)])
    p = Pipeline().add("normalize_columns", columns=["nom"], steps=["trim", "upper"])
    r = recipe.Recipe.from_json(recipe.build("r", p, t).to_json())
    names = recipe.suggest(r.expected, ("x", "Nom"))
    assert names == {"nom": "Nom"} and recipe.suggest(("ref",), ("reference",)) == {"ref": None}
    assert recipe.instantiate(r, names).apply(Table.rows(spark, ["x", "Nom"], [("1", " a ")])).collect() == [("1", "A")]
    with pytest.raises(KeyError):
        recipe.instantiate(r, {"nom": None})


def test_report(spark):
    t = Table.rows(spark, ["note", "decision"], [("15", "Admis"), ("8", "Recalé"), ("12", "Admis"), ("", "Admis")])
    spec = {"version": 1, "title": "t", "blocks": [
        {"kind": "kpi_row", "items": [{"label": "n", "aggregate": {"fn": "count"}}, {"label": "m", "aggregate": {"fn": "avg", "column": "note"}}]},
        {"kind": "chart", "chart": "bar", "x": "decision", "series": ["n"], "summarize": {"group_by": [{"column": "decision"}], "aggregates": [{"fn": "count", "name": "n"}]}},
        {"kind": "table", "columns": ["note"], "filter": {"column": "decision", "operator": "eq", "value": "Admis"}, "max_rows": 2},
    ]}
    k, c, b = report.compute(spec, t)
    assert [x["value"] for x in k["items"]] == ["4", "11.6667"]
    assert c["categories"] == ["Admis", "Recalé"] and c["series"] == {"n": ["3", "1"]}
    assert b["totalMatching"] == 3 and len(b["rows"]) == 2 and b["truncated"]
    assert report.validate({"version": 2, "blocks": [{"kind": "x"}]}) == ["$.title: a text is needed", "$.version: 1 is needed", "$.blocks[0].kind: unknown"]


def test_csv(spark, tmp_path):
    t = table_from_text(spark, '﻿a;b;a;\n1;"x;y";3;4\n;;;\n5;6')
    assert t.columns == ("a", "b", "a (2)", "Colonne 4") and t.collect() == [("1", "x;y", "3", "4"), ("5", "6", "", "")]
    write_csv(t, str(tmp_path / "o"), single=True)
    assert read_csv(spark, str(tmp_path / "o")).collect() == t.collect()
    with pytest.raises(Exception, match="(?i)exists"):
        write_csv(t, str(tmp_path / "o"))
    (tmp_path / "a.csv").write_text("nom\nAlice\nBob\nAlice\n")
    (tmp_path / "b.csv").write_text("nom_complet\nAlice\nDave\n")
    got = api.match_files(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"), [{"left": "nom", "right": "nom_complet"}])
    assert (got["matched"], got["unmatched_left"], got["unmatched_right"]) == (2, 1, 1)
    assert api.find_duplicates(spark, str(tmp_path / "a.csv"), ["nom"]) == [{"key": "ALICE", "rows": 2}]
    assert api.preview_pipeline(spark, str(tmp_path / "a.csv"), [{"type": "deduplicate", "params": {"columns": ["nom"]}}])["totalCount"] == 2
    with pytest.raises(ValueError, match="second table"):
        api.preview_pipeline(spark, str(tmp_path / "a.csv"), [{"type": "append_rows", "params": {}}])


def test_streaming_steps(spark):
    df = spark.createDataFrame([("a",)], "x string")
    assert apply_steps(df, [{"type": "add_constant_column", "params": {"name": "y", "value": "1"}}]).collect()[0].y == "1"
    with pytest.raises(ValueError):
        apply_steps(df, [{"type": "deduplicate", "params": {"columns": ["x"]}}])


def test_entry():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    json.dumps(__spark_entry__.oracle_sql())


def test_whole_answers(spark, tmp_path):
    """Totals beside a cut list of groups, examples of anomalies, and files of unmatched rows."""
    (tmp_path / "a.csv").write_text("nom\n" + "".join(f"n{i}\nn{i}\n" for i in range(250)) + "Zoe  X\n")
    (tmp_path / "b.csv").write_text("nom\nn0\nother\n")
    a, b = str(tmp_path / "a.csv"), str(tmp_path / "b.csv")
    got = api.find_duplicates(spark, a, ["nom"])
    assert (len(got), got.total_rows, got.total_groups, got.total_duplicate_rows, got.truncated) == (200, 501, 250, 500, True)
    assert got.rows[got[0]["key"]] == [{"nom": "n0"}] * 2
    assert api.profile_csv(spark, a)["columns"][0]["examples"]["double_spaces"] == ["Zoe  X"]
    out = {side: str(tmp_path / side) for side in ("left", "right")}
    api.match_files(spark, a, b, [{"left": "nom", "right": "nom"}], unmatched_output=out)
    assert len(read_csv(spark, out["left"]).collect()) == 499 and read_csv(spark, out["right"]).collect() == [("other",)]
    fuzzy = {side: str(tmp_path / f"fuzzy_{side}") for side in ("left", "right")}
    got = api.match_files(spark, b, a, [{"left": "nom", "right": "nom"}], {"tokens": False, "high": 90, "low": 80}, unmatched_output=fuzzy)
    assert sum(got["status"].values()) == 2 and read_csv(spark, fuzzy["left"]).collect() == [("other",)] and len(read_csv(spark, fuzzy["right"]).collect()) == 500


def test_csv_parts(spark, tmp_path):
    """Headers and preambles of each part, blank lines, quoted line breaks, split files, byte order marks."""
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "a.csv").write_text("k,v\n1,x\n2,y\n")
    (tmp_path / "two" / "b.csv").write_text("\ufeffk,v\n3,z\n")
    assert read_csv(spark, str(tmp_path / "two")).collect() == [("1", "x"), ("2", "y"), ("3", "z")]
    (tmp_path / "pre.csv").write_text("a report\n\n  \nk,v\n\n1,x\n ,\n2,y\n")
    assert read_csv(spark, str(tmp_path / "pre.csv"), header_row=1).collect() == [("1", "x"), ("2", "y")]
    assert read_csv(spark, str(tmp_path / "pre.csv"), header_row=1, multi_line=True).collect() == [("1", "x"), ("2", "y")]
    got = api.preview_csv(spark, "pre.csv", header_row=1, root=str(tmp_path))
    assert (got["rawRowCount"], got["columns"], got["preview"][0][0]) == (4, ["k", "v"], "a report")
    (tmp_path / "odd.csv").write_text('k;v\n1;"two\nlines; ""quoted"""\n2;\n3\n')
    assert read_csv(spark, str(tmp_path / "odd.csv")).collect() == [("1", 'two\nlines; "quoted"'), ("2", ""), ("3", "")]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        rows = [(str(i), f"value {i}") for i in range(20_000)]
        (tmp_path / "big.csv").write_text("k,v\n" + "".join(f"{a},{b}\n" for a, b in rows))
        t = read_csv(spark, str(tmp_path / "big.csv"))
        assert t.df.rdd.getNumPartitions() > 3 and t.collect() == rows
        write_csv(t, str(tmp_path / "out"))
        assert read_csv(spark, str(tmp_path / "out")).collect() == rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    (tmp_path / "none.csv").write_text("")
    assert read_csv(spark, str(tmp_path / "none.csv")).collect() == []


def test_confined(spark):
    assert api.confined("a/../b.csv", "/data") == "/data/b.csv" and api.confined("/data/x", "/data/") == "/data/x" and api.confined("x", "hdfs://h/d") == "hdfs://h/d/x"
    for bad in ("../x", "/etc/passwd", "a/../../x", "/database/x", "file:///etc/passwd"):
        with pytest.raises(api.OutsideRoot):
            api.confined(bad, "/data")
    assert api.confined("../x", None) == "../x"


def test_report_of_a_pipeline(spark):
    from datetime import datetime

    t = Table.rows(spark, ["nom"], [("a",), ("b",), ("a",)], name="people")
    p = Pipeline().add("deduplicate", columns=["nom"]).add("filter_rows", where={"column": "nom", "operator": "eq", "value": "a"}).add("drop_columns", columns=["nom"])
    p = p.enable(p.steps[1].id, False).undo()
    text = p.report_text(t, at=datetime(2024, 5, 6, 7, 8, 9)).split("\n")
    assert text[:4] == ["Rapport du pipeline — people", "Généré le 06/05/2024 07:08:09", "", "Étape 0 — Source : 3 lignes, 1 colonnes"]
    assert text[5:9] == ["Étape 1 — Dédoublonner", "  lignes en entrée : 3", "  lignes en sortie : 2", "  supprimées : 1"] and text[10:] == ["Étape 2 — Filtrer des lignes (désactivée)", "  (non exécutée)", "", "Étape 3 — Supprimer des colonnes", "  (non exécutée)"]
    x = report.traceability(p, t, recipe="r")
    assert [s["enabled"] for s in x["steps"]] == [True, False] and x["sourceFiles"] == [{"name": "people", "rowCount": 3}] and len(x["fingerprint"]) == 8


def test_profile_rules(spark):
    """Types by the exact forms, cases by words, examples in the order of rows."""
    kinds = {"integer": ["-5", "12"], "text": ["+5"], "decimal": ["1,5", "2"], "date": ["2020-01-02", "03/04/2021", "03-04-2021"], "boolean": ["OUI", "0"]}
    for kind, cells in kinds.items():
        assert profile(Table.rows(spark, ["c"], [(c,) for c in cells])).first()["type"] == kind
    for cell in (" 5", "1/2/20", "01.02.2020", "5 "):
        assert profile(Table.rows(spark, ["c"], [(cell,)])).first()["type"] == "text"
    t = Table.rows(spark, ["c"], [(c,) for c in ("Ab Cd", "x ", "AB", "x ", "y  z", "Éa", "É1 b", "1")])
    assert [r.value for r in odd_case(t).orderBy("rank").collect()] == ["Ab Cd", "AB", "Éa"]
    got = anomaly_examples(t)
    assert [r.value for r in got.filter("anomaly = 'outer_spaces'").orderBy("rank").collect()] == ["x ", "x "]


def test_report_import(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Notes,nom\n1,a\n3,b\n")
    spec = {"version": 1, "title": "t", "expectedColumns": ["note"], "blocks": [{"kind": "kpi_row", "items": [{"label": "s", "aggregate": {"fn": "sum", "column": "note"}}]}]}
    got = api.import_report(spark, json.dumps(spec), "a.csv", root=str(tmp_path))
    assert got["mapping"] == {"note": "Notes"} and api.build_report(spark, "a.csv", got["spec"], got["mapping"], root=str(tmp_path))[0]["items"][0]["value"] == "4"
    assert api.import_report(spark, "{", "a.csv")["errors"] and api.import_report(spark, "{}", "a.csv")["errors"]


def test_entry_without_the_corpus_operators(tmp_path):
    """The entry module imports when a library of the corpus operators is missing."""
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).parents[1])
    code = "import sys; sys.modules['limpid.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 60 and 'pipeline' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=120).returncode == 0


def test_file_name():
    from datetime import date

    from limpid.sources.csv import file_name

    assert file_name("Clients & Co", date(2024, 5, 6)) == "clients-co-2024-05-06.csv"
