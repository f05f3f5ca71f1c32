"""Nested conditions and expression trees as Columns, open to pushdown."""

from __future__ import annotations

import re
from datetime import datetime
from functools import reduce
from math import ceil, floor

from pyspark.sql import Column
from pyspark.sql import functions as F

from limpid.functions import numbers
from limpid.functions.patterns import groups_of, pattern
from limpid.table import DAYS, WHOLE, Table, plain, q

ISO = r"^\d{4}(-\d{2}(-\d{2}(T\d{2}:\d{2}(:\d{2})?)?)?)?$"


def _iso(c: Column) -> Column:
    padded = F.rpad(c, 4, " ")
    whole = F.when(F.length(c) == 4, F.concat(padded, F.lit("-01-01"))).when(F.length(c) == 7, F.concat(c, F.lit("-01"))).otherwise(c)
    return F.when(c.rlike(ISO), whole.try_cast("timestamp"))


def _date(v: str) -> datetime | None:
    if not re.match(ISO, v):
        return None
    try:
        return datetime.fromisoformat(v if len(v) > 7 else v + "-01-01"[-3 * ((10 - len(v)) // 3) :])
    except ValueError:
        return None


def _within(x: Column, a, b) -> Column:
    return reduce(lambda p, y: p & y, [x >= F.lit(a)] * (a is not None) + [x <= F.lit(b)] * (b is not None), F.lit(True))


def between(c: Column, low: str | None, high: str | None, number: Column | None = None, day: Column | None = None) -> Column:
    """Inclusive, open where a bound is None: as numbers if cell and bounds are, else as ISO dates if the cell is one
    (bounds that are none don't count), else as texts. number, day: the cell by its own type, which saves parsing it."""
    given = [v for v in (low, high) if v is not None]
    parsed = [None if v is None else numbers.parsed(v) for v in (low, high)]
    dates = [None if v is None else _date(v) for v in (low, high)]
    numeric = all(numbers.parsed(v) is not None for v in given)
    if number is not None:  # a cell of digits is no date but for four of them; blank is 0
        x = F.when(c == "", F.lit(0.0)).otherwise(number)
        if numeric:
            return F.when(x.isNotNull(), _within(x, *parsed)).otherwise(_within(c, low, high))
    date = _iso(c) if day is None else day.cast("timestamp")
    out = F.when(date.isNotNull(), _within(date, *dates)).otherwise(_within(c, low, high))
    if numeric:
        x = F.when(c == "", F.lit(0.0)) if day is not None else numbers.strict(c)
        out = F.when(x.isNotNull(), _within(x, *parsed)).otherwise(out)
    return out


def pushable(table: Table, group: dict) -> Column | None:
    """A condition on columns of their own types that holds for all rows of a group, and maybe more; files can answer it
    without reading them. None: no such condition."""
    if "conditions" in group:
        parts = [pushable(table, g) for g in group["conditions"]]
        if group.get("combinator", "and") == "or":
            return reduce(lambda a, b: a | b, parts) if parts and all(x is not None for x in parts) else None
        known = [x for x in parts if x is not None]
        return reduce(lambda a, b: a & b, known) if known else None
    how, v = group["operator"], group.get("value") or ""
    if (c := table.typed(group["column"], "string")) is not None:
        blank = c.isNull() | (c == "")
        match how:
            case "eq":
                return c == v if v else blank
            case "neq":
                return (c != v) | c.isNull() if v else c.isNotNull()
            case "contains":
                return c.contains(v) if v else None
            case "starts_with":
                return c.startswith(v) if v else None
            case "is_empty":
                return blank
            case "is_not_empty":
                return c.isNotNull()
            case "in_list" if group.get("values"):
                some = c.isin(*group["values"])
                return some | c.isNull() if "" in group["values"] else some
        return None
    bounds = [group.get("min"), group.get("max")]
    if (c := table.typed(group["column"], *DAYS)) is not None:
        days = [None if x is None else _date(x) for x in bounds]
        if how != "between" or [x is None for x in bounds] != [x is None for x in days] or all(x is None or numbers.parsed(x) is not None for x in bounds):
            return None
        kind = table.native[group["column"]][1]
        out = _within(c, *[None if x is None else F.lit(x).cast(kind) for x in days])
        return out | c.isNull() if days[0] is None else out
    c = table.typed(group["column"], *WHOLE, "double")
    if c is None or how != "between" or bounds == [None, None] or any(x is not None and numbers.parsed(x) is None for x in bounds):
        return None
    low, high = (None if x is None else numbers.parsed(x) for x in bounds)
    if table.native[group["column"]][1] in WHOLE:  # whole bounds, as a file can't compare its whole numbers with others
        if any(x is not None and abs(x) >= 2**53 for x in (low, high)):
            return None
        low, high = None if low is None else ceil(low), None if high is None else floor(high)
    out = _within(c, low, high)
    if (low is None or low <= 0) and (high is None or high >= 0):
        out = out | c.isNull()
    return out


def condition(c: Column, how: str, x: dict, number: Column | None = None, day: Column | None = None) -> Column:
    v = x.get("value") or ""
    match how:
        case "eq":
            return c == F.lit(v)
        case "neq":
            return c != F.lit(v)
        case "contains":
            return c.contains(v)
        case "starts_with":
            return c.startswith(v)
        case "regex":
            return c.rlike(pattern(v)) if groups_of(v) is not None else F.lit(False)
        case "is_empty":
            return c == ""
        case "is_not_empty":
            return c != ""
        case "in_list":
            return c.isin(*x["values"]) if x.get("values") else F.lit(False)
        case "between":
            return between(c, x.get("min"), x.get("max"), number, day)
    raise ValueError(f"unknown filter operator {how!r}")


def predicate(table: Table, group: dict) -> Column:
    """A condition {column, operator, ...} or a group {combinator, conditions}; an empty group holds."""
    if "conditions" in group:
        parts = [predicate(table, g) for g in group["conditions"]]
        if not parts:
            return F.lit(True)
        return reduce(lambda a, b: a | b if group.get("combinator", "and") == "or" else a & b, parts)
    name = group["column"]
    table.need(name)
    return condition(q(name), group["operator"], group, table.number(name), table.typed(name, *DAYS))


def mentioned(group: dict) -> set[str]:
    """Columns that a condition group reads."""
    return set().union(*map(mentioned, group["conditions"])) if "conditions" in group else {group["column"]}


def expression(table: Table, node: dict) -> Column:
    """Text of {literal}, {column} or {op, left, right}. + of two numbers adds, else joins the texts; others need
    numbers and are "" without, or if the divisor is 0."""
    return _value(table, node)["t"]


def _value(table: Table, node: dict) -> Column:
    """A struct of a node's text t and its number x, null if it is none."""
    number = lambda v: F.when(numbers.trim(v) != "", numbers.strict(v))
    pair = lambda t, x: F.struct(t.alias("t"), x.alias("x"))
    if "literal" in node:
        return pair(F.lit(str(node["literal"])), number(F.lit(str(node["literal"]))))
    if "column" in node:
        table.need(node["column"])
        x = table.number(node["column"])
        return pair(q(node["column"]), number(q(node["column"])) if x is None else x)
    if node["op"] not in ("+", "-", "*", "/"):
        raise ValueError(f"unknown operator {node['op']!r}")
    # Each side is bound once: plain nesting would copy it for every use, and grow as a power of the depth.
    sides = F.struct(_value(table, node["left"]).alias("a"), _value(table, node["right"]).alias("b"))
    return _bound(sides, lambda v: _result(node["op"], v))


def _bound(value: Column, f) -> Column:
    return F.transform(F.array(value), f)[0]


def _result(op: str, v: Column) -> Column:
    x, y = v["a"]["x"], v["b"]["x"]
    z = F.when(x.isNotNull() & y.isNotNull(), {"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y)}[op])
    text, z = F.when(z.isNull(), "").otherwise(plain(z)), F.when(~F.isnan(z), z)
    if op != "+":
        return F.struct(text.alias("t"), z.alias("x"))
    joined = F.concat(v["a"]["t"], v["b"]["t"])
    both = x.isNotNull() & y.isNotNull()
    return F.struct(F.when(both, text).otherwise(joined).alias("t"), F.when(both, z).when(numbers.trim(joined) != "", numbers.strict(joined)).alias("x"))
