"""Operators on columns: all are projections, but for numbering."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import functions as F

from limpid.functions import text
from limpid.functions.patterns import groups_of, pattern
from limpid.functions.predicates import expression
from limpid.operators.registry import Context, operator
from limpid.table import Table, numbered, q


@operator("rename_columns")
def rename_columns(t: Table, p: dict, _: Context) -> Table:
    """renames {old: new}, all at once; hidden columns stay hidden."""
    new = p["renames"]
    t.need(*new)
    names = [new.get(c, c) for c in t.columns]
    if len(set(names)) < len(names):
        raise ValueError("two columns would have one name")
    return replace(t.select(dict(zip(names, t.columns, strict=True))), hidden=frozenset(new.get(c, c) for c in t.hidden))


@operator("reorder_columns")
def reorder_columns(t: Table, p: dict, _: Context) -> Table:
    """order first, unknown names ignored; the rest follows as it was."""
    first = [c for c in dict.fromkeys(p["order"]) if c in t.columns]
    return t.select({c: c for c in [*first, *[c for c in t.columns if c not in first]]})


@operator("drop_columns")
def drop_columns(t: Table, p: dict, _: Context) -> Table:
    return t.select({c: c for c in t.columns if c not in p["columns"]})


@operator("hide_columns")
def hide_columns(t: Table, p: dict, _: Context) -> Table:
    """Marks columns hidden, or shown if hidden is false; they still take part in all that follows."""
    own = frozenset(p["columns"])
    return replace(t, hidden=t.hidden | own if p.get("hidden", True) else t.hidden - own)


@operator("duplicate_column")
def duplicate_column(t: Table, p: dict, _: Context) -> Table:
    """A copy right after its source."""
    t.need(p["column"])
    return t.select({n: p["column"] if n == p["name"] else n for c in t.columns for n in ([c, p["name"]] if c == p["column"] else [c])})


@operator("add_constant_column")
def add_constant_column(t: Table, p: dict, _: Context) -> Table:
    return t.with_column(p["name"], F.lit(p.get("value", "")))


@operator("add_concat_column")
def add_concat_column(t: Table, p: dict, _: Context) -> Table:
    """Cells joined by a separator, empty ones too."""
    t.need(*p["columns"])
    return t.with_column(p["name"], F.concat_ws(p.get("separator", ""), *map(q, p["columns"])))


@operator("add_extract_column")
def add_extract_column(t: Table, p: dict, _: Context) -> Table:
    """mode: year, first_n, last_n, before_sep, after_sep or regex_group, with arg."""
    t.need(p["column"])
    c, arg = q(p["column"]), str(p.get("arg", ""))
    number = int(arg) if re.fullmatch(r"-?\d+", arg) else 0
    match p["mode"]:
        case "year":
            out = F.regexp_extract(c, r"\b(\d{4})\b", 1)
        case "first_n":
            out = F.substring(c, 1, number) if number > 0 else F.lit("")
        case "last_n":
            out = F.right(c, F.lit(number)) if number > 0 else F.lit("")
        case "before_sep":
            out = F.substring_index(c, arg, 1) if arg else c
        case "after_sep":
            out = F.when(F.instr(c, arg) > 0, c.substr(F.instr(c, arg) + len(arg), F.length(c))).otherwise("") if arg else F.lit("")
        case "regex_group":
            out = F.regexp_extract(c, pattern(arg), 1) if groups_of(arg) else F.lit("")
        case _:
            raise ValueError(f"unknown extraction {p['mode']!r}")
    return t.with_column(p["name"], out)


@operator("add_sequence_column")
def add_sequence_column(t: Table, p: dict, _: Context) -> Table:
    """start, start + step, ... in the rows' order."""
    df = numbered(t.df, "__n")
    value = (F.lit(int(p.get("start", 1))) + F.col("__n") * int(p.get("step", 1))).cast("string")
    return replace(t, df=df).select({**t.cells(), p["name"]: value})


@operator("add_expression_column")
def add_expression_column(t: Table, p: dict, _: Context) -> Table:
    return t.with_column(p["name"], expression(t, p["expression"]))


@operator("normalize_columns")
def normalize_columns(t: Table, p: dict, ctx: Context) -> Table:
    """steps, in order, over columns; in place, or to new columns with a suffix."""
    t.need(*p["columns"])
    new = {c: text.normalise(q(c), p["steps"]) for c in p["columns"]}
    changed = F.lit(False)
    for c, x in new.items():
        changed = changed | (q(c) != x)
    t = replace(t, df=ctx.count(t.df, rowsModified=F.count_if(changed)))
    if p.get("mode", "overwrite") == "overwrite":
        return t.select({c: new.get(c, c) for c in t.columns})
    suffix = p.get("suffix", " (normalisé)")
    return t.select({**t.cells(), **{c + suffix: x for c, x in new.items()}})


def visible_reordered(t: Table, order: list[str]) -> list[str]:
    """All columns in a new order of the visible ones; hidden ones keep their places."""
    new = iter(order)
    return [c if c in t.hidden else next(new, c) for c in t.columns]


def moved(items: list[str], at: int, to: int) -> list[str]:
    """The items with the one at a place moved to another."""
    rest = items[:at] + items[at + 1 :]
    return rest[:to] + items[at : at + 1] + rest[to:]
