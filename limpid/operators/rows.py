"""Operators on rows: filters, conditional values, appending."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from limpid.functions.names import suggest
from limpid.functions.predicates import predicate, pushable
from limpid.operators.registry import Context, operator
from limpid.table import ORD, Table, q


@operator("filter_rows")
def filter_rows(t: Table, p: dict, ctx: Context) -> Table:
    """where: a condition group. action: keep or delete the rows, or extract them as the context's table `name`."""
    holds, sure = predicate(t, p["where"]), pushable(t, p["where"])
    kept = t.df.filter(holds) if sure is None else t.df.filter(sure).filter(holds)
    match p.get("action", "keep"):
        case "keep":
            return replace(t, df=kept)
        case "delete":
            return replace(t, df=t.df.filter(~holds))
        case "extract_to_new_table":
            ctx.tables[p.get("name") or "extract"] = replace(t, df=kept)
            return t
    raise ValueError(f"unknown action {p['action']!r}")


@operator("set_value_where")
def set_value_where(t: Table, p: dict, ctx: Context) -> Table:
    """target column, there or new: match_value where the condition holds, other_value elsewhere; a value that isn't
    given leaves cells as they are, or empty in a new column."""
    name = p["target"]
    old = q(name) if name in t.columns else F.lit("")
    value = lambda v: old if v is None else F.lit(v)
    new = F.when(predicate(t, p["where"]), value(p.get("match_value"))).otherwise(value(p.get("other_value")))
    return replace(t, df=ctx.count(t.df, rowsModified=F.count_if(old != new))).with_column(name, new)


@operator("append_rows")
def append_rows(t: Table, p: dict, ctx: Context) -> Table:
    """The rows of another table after these: mapping {column here: column there}; columns that aren't mapped are empty.
    Without a mapping each column takes the one of its name there, or the most similar one."""
    other = ctx.table(p["table"])
    mapping = p["mapping"] if p.get("mapping") is not None else suggest(t.columns, other.columns)
    other.need(*[c for c in mapping.values() if c])
    order = lambda part, here, there: F.struct(F.lit(part).alias("part"), here.alias("here"), there.alias("there")).alias(ORD)
    mine, theirs = (x.df.schema[ORD].dataType for x in (t, other))
    cells = [(q(mapping[c]) if mapping.get(c) else F.lit("")).alias(c) for c in t.columns]
    first = t.df.select(order(0, F.col(ORD), F.lit(None).cast(theirs)), *map(q, t.columns))
    other = replace(other, df=ctx.count(other.df, rowsAdded=F.count("*")))
    return replace(t, df=first.unionByName(other.df.select(order(1, F.lit(None).cast(mine), F.col(ORD)), *cells)), native={})
