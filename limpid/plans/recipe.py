"""Recipes: pipelines without data, by column names, that can be bound to other tables."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from limpid.functions.names import similarity, suggest  # noqa: F401
from limpid.plans.pipeline import Pipeline, Step
from limpid.table import Table

VERSION = 1
#: Where operators name columns of the main table: keys whose value is a name, a list of names or a dict by name.
NAMED = ("column", "columns", "order", "renames", "left", "target")


@dataclass(frozen=True)
class Recipe:
    name: str
    steps: tuple[dict, ...]
    expected: tuple[str, ...]
    secondary: tuple[str, ...] = ()
    version: int = VERSION

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Recipe:
        d = json.loads(text)
        if d.get("version") != VERSION or not isinstance(d.get("steps"), list):
            raise ValueError("this is no recipe of this version")
        return cls(d["name"], tuple(d["steps"]), tuple(d["expected"]), tuple(d.get("secondary", ())), d["version"])


def _names(x, found: set[str]) -> set[str]:
    if isinstance(x, dict):
        for k, v in x.items():
            if k in NAMED:
                found |= {v} if isinstance(v, str) else {c for c in v if isinstance(c, str)}
            if k not in ("rules", "overrides", "mapping"):
                _names(v, found)
    elif isinstance(x, list | tuple):
        for v in x:
            _names(v, found)
    return found


def _renamed(x, names: dict[str, str]):
    if isinstance(x, dict):
        out = {}
        for k, v in x.items():
            if k in NAMED and isinstance(v, str):
                out[k] = names.get(v, v)
            elif k in NAMED and isinstance(v, dict):
                out[k] = {names.get(c, c): w for c, w in v.items()}
            elif k in NAMED and all(isinstance(c, str) for c in v):
                out[k] = [names.get(c, c) for c in v]
            else:
                out[k] = _renamed(v, names)
        return out
    return [_renamed(v, names) for v in x] if isinstance(x, list | tuple) else x


def build(name: str, pipeline: Pipeline, source: Table) -> Recipe:
    """Of the active steps. Expected are the source's columns that they name."""
    steps = [{"type": s.type, "params": s.params, "label": s.label} for s in pipeline.active()]
    used = _names([s["params"] for s in steps], set())
    return Recipe(name, tuple(steps), tuple(c for c in source.columns if c in used), tuple(dict.fromkeys(s["params"]["table"] for s in steps if "table" in s["params"])))


def instantiate(recipe: Recipe, mapping: dict[str, str | None], tables: dict[str, Table] | None = None) -> Pipeline:
    """The pipeline for a table whose columns the mapping names."""
    if gone := [c for c in recipe.expected if not mapping.get(c)]:
        raise KeyError(f"no column for {', '.join(gone)}")
    if gone := [x for x in recipe.secondary if x not in (tables or {})]:
        raise KeyError(f"no table {', '.join(gone)}")
    steps = tuple(Step(s["type"], _renamed(s["params"], {k: v for k, v in mapping.items() if v}), label=s.get("label", "")) for s in recipe.steps)
    return Pipeline(steps, len(steps))
