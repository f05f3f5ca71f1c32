"""Recipes in the interchange format: `formatVersion`, `expectedColumns`, and steps with camel-case parameters."""

from __future__ import annotations

import json

from limpid.plans.recipe import Recipe
from limpid.plans.report import loaded


def _known(**x) -> dict:
    """Without what isn't given."""
    return {k: v for k, v in x.items() if v is not None}


def _node(x: dict) -> dict:
    match x.get("kind"):
        case "literal":
            return {"literal": x["value"]}
        case "column":
            return {"column": x["name"]}
        case "binary":
            return {"op": x["op"], "left": _node(x["left"]), "right": _node(x["right"])}
    raise ValueError(f"unknown expression {x.get('kind')!r}")


def _pairs(every: list[dict]) -> list[dict]:
    return [_known(left=x["leftName"], right=x["rightName"], normalize=x.get("normalization")) for x in every]


def _join(p: dict) -> dict:
    copies, rules = p["copyColumns"], p.get("aggregate") or []
    out = _known(copied=[c["rightName"] for c in copies], names={c["rightName"]: c["asName"] for c in copies if c.get("asName")} or None,
                 collision=p.get("collision"), affix=p.get("collisionText"), type=p.get("joinType"), multiple=p.get("multiMatch"),
                 rules={r["rightName"]: r["fn"] for r in rules} or None, separator=next((r["separator"] for r in rules if r.get("separator") is not None), None))
    if p.get("matchStrategy") != "fuzzy":
        return out | {"pairs": _pairs(p["keyPairs"])}
    f, keys = p["fuzzy"], lambda d: {"left": d["leftKeyNormalized"], "right": d["rightKeyNormalized"]}
    fuzzy = _known(left=f["leftKeyNames"], right=f["rightKeyNames"], tokens=f.get("tokenized"), high=f.get("thresholdHigh"), low=f.get("thresholdLow"))
    fuzzy |= {"decisions": [{**keys(d), "decision": d["decision"]} for d in f.get("manualDecisions") or []], "forced": [keys(d) for d in f.get("forcedPairs") or []]}
    return out | {"pairs": _pairs(f["blockingPairs"]), "fuzzy": fuzzy}


def _group(g: dict) -> dict:
    return _known(column=g["name"], normalization=g.get("normalization"), binning=g.get("binning"))


def _aggregate(a: dict) -> dict:
    return _known(fn=a["fn"], column=a.get("name"), name=a["asName"], separator=a.get("separator"))


#: What each type's parameters are here.
PARAMS = {
    "rename_columns": lambda p: {"renames": {r["name"]: r["newName"] for r in p["renames"]}},
    "reorder_columns": lambda p: {"order": p["order"]},
    "drop_columns": lambda p: {"columns": p["columnNames"]},
    "hide_columns": lambda p: _known(columns=p["columnNames"], hidden=p.get("hidden")),
    "duplicate_column": lambda p: {"column": p["name"], "name": p["newName"]},
    "add_constant_column": lambda p: p,
    "add_concat_column": lambda p: _known(name=p["name"], columns=p["columnNames"], separator=p.get("separator")),
    "add_extract_column": lambda p: _known(name=p["name"], column=p["sourceName"], mode=p["mode"], arg=p.get("arg")),
    "add_sequence_column": lambda p: p,
    "add_expression_column": lambda p: {"name": p["name"], "expression": _node(p["expression"])},
    "normalize_columns": lambda p: _known(columns=p["columnNames"], steps=p["steps"], mode=p.get("mode"), suffix=p.get("newColumnSuffix")),
    "filter_rows": lambda p: _known(where=loaded(p["root"]), action=p.get("action"), name=p.get("newTableName")),
    "set_value_where": lambda p: _known(where=loaded(p["root"]), target=p["target"]["name"], match_value=p.get("matchValue"), other_value=p.get("nonMatchValue")),
    "deduplicate": lambda p: _known(columns=p["keyColumnNames"], mode=p.get("mode"), action=p.get("action"), flag_column=p.get("flagColumnName"), overrides={o["groupKey"]: o["action"] for o in p.get("groupOverrides") or []} or None),
    "enrich_join": _join,
    "append_rows": lambda p: {"mapping": {m["targetName"]: m["sourceName"] for m in p["columnMapping"]}},
    "summarize": lambda p: {"group_by": [_group(g) for g in p["groupBy"]], "aggregates": [_aggregate(a) for a in p["aggregates"]]},
}


def recipe_from_json(text: str) -> Recipe:
    """The recipe of a file in the interchange format. Steps that are off there are left out; a step's other table is known
    by its name. Anything that isn't such a recipe raises ValueError."""
    d = json.loads(text)
    if not isinstance(d, dict) or d.get("formatVersion") != 1 or not isinstance(d.get("steps"), list):
        raise ValueError("this is no recipe of format version 1")
    steps, tables = [], []
    for i, s in enumerate(d["steps"], 1):
        if s.get("type") not in PARAMS:
            raise ValueError(f"step {i}: unknown operator {s.get('type')!r}")
        if s.get("enabled") is False:
            continue
        try:
            params = dict(PARAMS[s["type"]](s["params"]))
        except (KeyError, TypeError, AttributeError) as e:
            raise ValueError(f"step {i}: bad parameters of {s['type']}: {e}") from e
        if s["type"] in ("enrich_join", "append_rows"):
            if not s.get("secondary"):
                raise ValueError(f"step {i}: {s['type']} names no table")
            params["table"] = s["secondary"]["tableName"]
            tables.append(params["table"])
        steps.append({"type": s["type"], "params": params, "label": s.get("label") or ""})
    return Recipe(d.get("name", ""), tuple(steps), tuple(d.get("expectedColumns") or ()), tuple(dict.fromkeys(tables)))
