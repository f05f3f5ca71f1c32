"""Recipes in the interchange format, and helpers that order columns."""

import json

import pytest

from limpid.operators import REGISTRY, Context
from limpid.operators.columns import moved, visible_reordered
from limpid.operators.join import names_for
from limpid.plans.interchange import recipe_from_json
from limpid.plans.recipe import Recipe, instantiate
from limpid.table import Table


def recipe(*steps, **more):
    return json.dumps({"formatVersion": 1, "name": "r", "expectedColumns": ["nom", "x"], "steps": [{"label": "l", "enabled": True, **s} for s in steps], **more})


def test_steps(spark):
    text = recipe(
        {"type": "normalize_columns", "params": {"columnNames": ["nom"], "steps": ["upper"], "mode": "new_column", "newColumnSuffix": "_u"}},
        {"type": "add_expression_column", "params": {"name": "y", "expression": {"kind": "binary", "op": "*", "left": {"kind": "column", "name": "x"}, "right": {"kind": "literal", "value": "2"}}}},
        {"type": "set_value_where", "params": {"root": {"kind": "group", "operator": "or", "conditions": [{"kind": "condition", "columnId": "x", "operator": "between", "min": "2", "max": "3"}]}, "target": {"kind": "new", "name": "mid"}, "matchValue": "oui"}},
        {"type": "drop_columns", "enabled": False, "params": {"columnNames": ["nom"]}},
        {"type": "append_rows", "params": {"columnMapping": [{"targetName": "nom", "sourceName": "n"}]}, "secondary": {"tableName": "more", "expectedColumns": ["n"]}},
        {"type": "deduplicate", "params": {"keyColumnNames": ["nom"], "mode": "normalized", "action": "keep_first", "groupOverrides": [{"groupKey": "B", "action": "keep_last"}]}},
        {"type": "rename_columns", "params": {"renames": [{"name": "nom", "newName": "name"}]}},
    )
    r = recipe_from_json(text)
    assert (r.name, r.expected, r.secondary, len(r.steps)) == ("r", ("nom", "x"), ("more",), 6) and Recipe.from_json(r.to_json()).steps[0]["label"] == "l"
    tables = {"more": Table.rows(spark, ["n"], [("B",), ("c",)])}
    out = instantiate(r, {"nom": "nom", "x": "x"}, tables).apply(Table.rows(spark, ["nom", "x"], [("a", "1"), ("b", "2"), ("A ", "3")]), tables)
    assert out.columns == ("name", "x", "nom_u", "y", "mid") and sorted(out.collect()) == [("B", "", "", "", ""), ("a", "1", "A", "2", ""), ("c", "", "", "", "")]
    with pytest.raises(KeyError, match="more"):
        instantiate(r, {"nom": "nom", "x": "x"})


def test_fuzzy_parameters():
    p = {"matchStrategy": "fuzzy", "keyPairs": [], "copyColumns": [{"rightName": "n", "asName": "m"}], "collision": "prefix", "collisionText": "r_", "joinType": "inner", "multiMatch": "aggregate", "aggregate": [{"rightName": "n", "fn": "concat", "separator": "/"}]}
    p["fuzzy"] = {"leftKeyNames": ["a"], "rightKeyNames": ["b"], "blockingPairs": [{"leftName": "k", "rightName": "j", "normalization": "text"}], "tokenized": False, "thresholdHigh": 80, "thresholdLow": 50, "manualDecisions": [{"leftKeyNormalized": "u", "rightKeyNormalized": "v", "decision": "accepted"}]}
    (step,) = recipe_from_json(recipe({"type": "enrich_join", "params": p, "secondary": {"tableName": "t"}})).steps
    assert step["params"]["fuzzy"] == {"left": ["a"], "right": ["b"], "tokens": False, "high": 80, "low": 50, "decisions": [{"left": "u", "right": "v", "decision": "accepted"}], "forced": []}
    assert step["params"]["pairs"] == [{"left": "k", "right": "j", "normalize": "text"}] and step["params"]["separator"] == "/" and step["params"]["names"] == {"n": "m"}


@pytest.mark.parametrize("text", ["[]", "{}", '{"formatVersion": 2, "steps": []}', recipe({"type": "nothing", "params": {}}), recipe({"type": "drop_columns", "params": {}}), recipe({"type": "append_rows", "params": {"columnMapping": []}})])
def test_refused(text):
    with pytest.raises(ValueError):
        recipe_from_json(text)


def test_names_and_orders(spark):
    assert names_for(("a", "b"), ["x", "a"], "suffix", "_r", {"x": "a", "a": "c"}) == {"x": "a_r", "a": "c"}
    t = Table(Table.rows(spark, ["a", "b", "c", "d"], []).df, ("a", "b", "c", "d"), hidden=frozenset({"b"}))
    assert visible_reordered(t, ["d", "a", "c"]) == ["d", "b", "a", "c"] and visible_reordered(t, []) == ["a", "b", "c", "d"]
    assert moved(["a", "b", "c"], 0, 2) == ["b", "c", "a"] and moved(["a", "b", "c"], 2, 0) == ["c", "a", "b"]


def test_default_mapping(spark):
    t, other = Table.rows(spark, ["reference", "nom", "x"], [("1", "a", "z")]), Table.rows(spark, ["Nom ", "references", "y"], [("b", "2", "q")])
    out = REGISTRY["append_rows"](t, {"table": "o"}, Context({"o": other}))
    assert out.collect()[1] == ("2", "b", "")
