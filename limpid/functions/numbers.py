"""Numbers in text: the parsers that operators use, and how results are written."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from limpid.functions.text import SPACE, trim
from limpid.table import plain

PLAIN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: Other ways to write a number: without end, or by the base that its second letter tells.
OTHER = r"^([+-]?Infinity|0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+)$"
BASES = {"x": 16, "o": 8, "b": 2}


def _double(c: Column) -> Column:
    kind, digits = F.lower(F.substring(c, 2, 1)), F.substring(c, 3, 1 << 30)
    other = F.when(c.endswith("y"), F.regexp_replace(c, r"^\+", "").try_cast("double"))
    for name, base in BASES.items():
        other = other.when(kind == name, F.conv(digits, base, 10).cast("double"))
    return F.when(c.rlike(PLAIN), c.try_cast("double")).when(c.rlike(OTHER), other)


def parsed(text: str) -> float | None:
    """strict() of a text at hand."""
    t = text.strip()
    if not t:
        return 0.0
    if re.match(OTHER, t):
        return float(t) if t.endswith("y") else float(int(t[2:], BASES[t[1].lower()]))
    return float(t) if re.match(PLAIN, t) else None


def strict(c: Column) -> Column:
    """A number with a decimal point; outer space is ignored and blank is 0, as filters and expressions read it."""
    t = trim(c)
    return F.when(t == "", F.lit(0.0)).otherwise(_double(t))


def tolerant(c: Column) -> Column:
    """A number with any white space, and comma or point for decimals: of both, the last one is. Blank is no number."""
    t = F.regexp_replace(c, f"{SPACE}+", "")
    comma, point = F.length(t) - F.instr(F.reverse(t), ","), F.length(t) - F.instr(F.reverse(t), ".")
    has = t.contains(",")
    with_comma = F.regexp_replace(t, r"^([^,]*),", "$1.")
    both = F.when(comma > point, F.regexp_replace(F.regexp_replace(t, r"\.", ""), r"^([^,]*),", "$1.")).otherwise(F.regexp_replace(t, ",", ""))
    return _double(F.when(has & t.contains("."), both).when(has, with_comma).otherwise(t))


def written(x: Column) -> Column:
    """A whole number without decimals, else at most four, halves up; null is ""."""
    whole = x.cast("decimal(38,0)").cast("string")
    four = F.regexp_replace((F.floor(x * 10000 + 0.5) / 10000).cast("decimal(38,4)").cast("string"), r"\.?0+$", "")
    return F.when(x.isNull() | F.isnan(x), F.lit("")).when(F.abs(x) == float("inf"), x.cast("string")).when(x == F.floor(x), whole).otherwise(F.when(four.isin("-0", ""), "0").otherwise(four))


def exact(x: Column) -> Column:
    """All digits of a number, whole ones without decimals; null is ""."""
    return F.when(x.isNull() | F.isnan(x), F.lit("")).otherwise(plain(x))
