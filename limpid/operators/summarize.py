"""Grouped summaries with tolerant numbers, first-appearance order and zero-filled bins."""

from __future__ import annotations

from dataclasses import dataclass
from math import isfinite

import numpy as np
import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limpid.functions import numbers
from limpid.functions.predicates import predicate
from limpid.functions.text import key
from limpid.operators.registry import Context, operator
from limpid.operators.selection import group_of, medians
from limpid.storage import written
from limpid.table import ORD, Table, q

NOT_NUMBER, OUTSIDE = "(non numérique)", "hors plage"


#: Bins that are tried one after the other; among more, sorted edges tell the right one.
FEW_BINS = 64


def number_of(t: Table, name: str) -> Column:
    """A column's numbers: its own, or those in its text, read tolerantly."""
    x = t.number(name)
    return numbers.tolerant(q(name)) if x is None else x


def _counted(t: Table, a: dict, on: Column | None) -> Column | None:
    """Which rows an aggregate looks at: those for which `on` and its condition group `where` hold; None: all."""
    if not a.get("where"):
        return on
    holds = predicate(t, a["where"])
    return holds if on is None else on & holds


def aggregate(t: Table, a: dict, on: Column | None = None) -> Column:
    """One aggregate {fn, column, separator, where} over the rows of a group for which `on`, and the condition group
    `where`, hold; as a typed value."""
    on = _counted(t, a, on)
    own = lambda x: x if on is None else F.when(on, x)
    fn = a["fn"]
    if fn == "count":
        return F.count(own(F.lit(1)))
    c = q(a["column"])
    full, number = own(F.when(c != "", c)), own(number_of(t, a["column"]))
    match fn:
        case "countDistinct":
            return F.count_distinct(full)
        case "countNonEmpty":
            return F.count(full)
        case "first":
            return F.coalesce(F.min_by(full, F.when(full.isNotNull(), F.col(ORD))), F.lit(""))
        case "concat":
            every = F.array_sort(F.collect_list(F.when(full.isNotNull(), F.struct(F.col(ORD).alias("o"), c.alias("v")))))
            return F.array_join(F.transform(every, lambda x: x["v"]), a.get("separator", ", "))
        case "sum":
            return F.coalesce(F.sum(number), F.lit(0.0))
        case "avg" | "min" | "max" | "median":
            return {"avg": F.avg, "min": F.min, "max": F.max, "median": F.median}[fn](number)
    raise ValueError(f"unknown aggregate {fn!r}")


def shown(a: dict, x: Column) -> Column:
    return x if a["fn"] in ("first", "concat") else x.cast("string") if a["fn"].startswith("count") else numbers.written(x)


def empty(a: dict) -> str:
    return "0" if a["fn"].startswith("count") or a["fn"] == "sum" else ""


def _label(x: float) -> str:
    return str(int(x)) if x == int(x) else f"{int(x * 10000 + (0.5 if x >= 0 else -0.5)) / 10000:.4f}".rstrip("0").rstrip(".")


@dataclass(frozen=True)
class Bins:
    edges: tuple[float, ...]

    @property
    def labels(self) -> list[str]:
        return [f"{_label(a)}–{_label(b)}" for a, b in zip(self.edges, self.edges[1:])]  # noqa: B905

    def of(self, x: Column) -> Column:
        """[a, b) but for the last, which is closed; the first of bins that overlap, as edges may be in any order."""
        n = len(self.edges) - 1
        if n < 1:
            return F.when(x.isNull(), NOT_NUMBER).otherwise(OUTSIDE)
        if n > FEW_BINS and (np.diff(self.edges) > 0).all():
            return F.coalesce(self._looked_up(x), F.when(x.isNull(), NOT_NUMBER).otherwise(OUTSIDE))
        out = F.when(x.isNull(), NOT_NUMBER)
        for k, (name, a, b) in enumerate(zip(self.labels, self.edges, self.edges[1:], strict=False)):
            out = out.when((x >= a) & ((x <= b) if k == n - 1 else (x < b)), name)
        return out.otherwise(OUTSIDE)

    def _looked_up(self, x: Column) -> Column:
        """The label of x's bin, found among all edges, of which each executor gets one copy; null outside."""
        shared = SparkContext.getOrCreate().broadcast((np.array(self.edges), np.array([*self.labels, None], object)))

        @F.pandas_udf("string")
        def find(values: pd.Series) -> pd.Series:
            edges, labels = shared.value
            v = values.to_numpy(np.float64, na_value=np.nan)
            k = np.searchsorted(edges, v, side="right") - 1
            k[v == edges[-1]] = len(edges) - 2
            k[np.isnan(v) | (v > edges[-1])] = -1
            return pd.Series(labels[k], dtype=object)

        return find(x)

    def at(self, k: Column) -> Column:
        """The label of the bin of number k; one constant holds them all."""
        return F.element_at(F.split(F.lit("\n".join(self.labels)), "\n"), (k + 1).cast("int"))


def bins_for(t: Table, column: str, how: dict) -> Bins:
    """explicit_boundaries {boundaries}, fixed_width {width, start} or fixed_count {count}; the last two look up the
    least and the greatest number, the only job that planning runs."""
    if how["kind"] == "explicit_boundaries":
        return Bins(tuple(float(x) for x in how["boundaries"]))
    if how["kind"] not in ("fixed_width", "fixed_count"):
        raise ValueError(f"unknown bins {how['kind']!r}")
    x = number_of(t, column)
    r = t.df.agg(F.min(x).alias("a"), F.max(x).alias("b")).first()
    if r.a is None:
        return Bins(())
    if not (isfinite(r.a) and isfinite(r.b)):
        raise ValueError(f"no bins of equal width from {r.a} to {r.b}")
    if how["kind"] == "fixed_width":
        width = float(how["width"])
        if width <= 0:
            raise ValueError("the width of bins must be positive")
        start = float(r.a if how.get("start") is None else how["start"])
        if start + width == start or r.b + width == r.b:
            raise ValueError(f"a width of {how['width']} is too small to tell {start} or {r.b} from the next edge")
        edges = [start]
        while len(edges) < 2 or edges[-1] < r.b:
            edges.append(edges[-1] + width)
        return Bins(tuple(edges))
    n = max(1, int(how["count"]))
    width = (r.b - r.a) / n or 1.0
    return Bins((*[r.a + i * width for i in range(n)], r.b if r.b > r.a else r.a + n * width))


class Grouping:
    """What a summary {group_by, aggregates} groups a table by, and what it takes of each group."""

    def __init__(self, t: Table, p: dict):
        self.t, self.by, self.aggs = t, p.get("group_by") or [], p["aggregates"]
        t.need(*[g["column"] for g in self.by], *[a["column"] for a in self.aggs if a["fn"] != "count"])
        self.bins = {i: bins_for(t, g["column"], g["binning"]) for i, g in enumerate(self.by) if g.get("binning")}
        raw = {i for i, g in enumerate(self.by) if (g.get("normalization") or "none") in ("none", "raw")}
        self.same = raw - self.bins.keys()  # a group's cells are alike

    @property
    def keys(self) -> list[Column]:
        return [self.bins[i].of(number_of(self.t, g["column"])) if i in self.bins else key(q(g["column"]), g.get("normalization")) for i, g in enumerate(self.by)]

    def measures(self, on: Column | None = None) -> dict[str, Column]:
        """By name, aggregates of a group's rows for which `on` holds; without medians."""
        own = lambda x: x if on is None else F.when(on, x)
        out = {"__first": F.min(own(F.col(ORD))), "__n": F.count(own(F.lit(1)))}
        out |= {f"__d{i}": F.min_by(own(q(g["column"])), own(F.col(ORD))) for i, g in enumerate(self.by) if i not in self.bins and i not in self.same}
        return out | {f"__a{i}": shown(a, aggregate(self.t, a, on)) for i, a in enumerate(self.aggs) if a["fn"] != "median"}

    def middles(self, on: Column | None = None) -> dict[str, Column]:
        """By name, the numbers whose medians are wanted, of rows for which `on` holds."""
        out = {}
        for i, a in enumerate(self.aggs):
            if a["fn"] == "median":
                x, holds = number_of(self.t, a["column"]).cast("double"), _counted(self.t, a, on)
                out[f"__a{i}"] = x if holds is None else F.when(holds, x)
        return out

    def finished(self, out: DataFrame) -> Table:
        """The summary, from a row of keys (`__k<i>`) and measures for each group."""
        t, by, aggs, bins, names = self.t, self.by, self.aggs, self.bins, [f"__k{i}" for i in range(len(self.by))]
        out = out.filter("__n > 0").withColumns({f"__d{i}": F.col(f"__k{i}") for i in self.same}) if self.same else out.filter("__n > 0")
        order = [F.col("__first")]
        if bins:
            others = [i for i in range(len(by)) if i not in bins]
            own = [f"__k{i}" for i in others]
            combos = out.groupBy(*own).agg(F.min("__first").alias("__lead"), *[F.min_by(f"__d{i}", "__first").alias(f"__e{i}") for i in others])
            if not others:
                combos = combos.filter("__lead is not null")
            if all(len(b.edges) > 1 for b in bins.values()):
                frame, slot = combos, F.lit(0).cast("long")
                for i, b in bins.items():  # one after the other, so that no array holds all combinations
                    frame = frame.withColumn(f"__j{i}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(b.edges) - 2).cast("long"))))
                    slot = slot * (len(b.edges) - 1) + F.col(f"__j{i}")
                frame = frame.select(*own, "__lead", *[f"__e{i}" for i in others], slot.alias("slot"), *[b.at(F.col(f"__j{i}")).alias(f"__k{i}") for i, b in bins.items()])
                out = frame.join(out, names, "full")
            else:
                out = out.select("*", F.lit(None).cast("long").alias("slot"), F.lit(None).cast(t.df.schema[ORD].dataType).alias("__lead"), *[F.lit("").alias(f"__e{i}") for i in others])
            out = out.select("*", *[F.coalesce(f"__d{i}", f"__e{i}").alias(f"__f{i}") for i in others])
            order = [F.col("slot").isNull(), F.coalesce("__lead", "__first"), F.coalesce("slot", F.lit(0))]
        cells = {g["column"]: F.col(f"__k{i}") if i in bins else F.col(f"__f{i}" if bins else f"__d{i}") for i, g in enumerate(by)}
        cells |= {a["name"]: F.coalesce(F.col(f"__a{i}"), F.lit(empty(a))) for i, a in enumerate(aggs)}
        df = out.select(F.struct(*[x.alias(f"o{i}") for i, x in enumerate(order)]).alias(ORD), *[c.alias(n) for n, c in cells.items()])
        return Table(df, tuple(cells), name=t.name)


@operator("summarize")
def summarize(t: Table, p: dict, _: Context) -> Table:
    """group_by [{column, normalization, binning}], aggregates [{fn, column, name, separator, where}].

    Groups show the cell of their first row and come in the order of these. Bins without rows are filled in for each
    combination of the other columns, in order, those of no number or outside last. An empty table has no groups.
    """
    g = Grouping(t, p)
    keys = {f"__k{i}": k for i, k in enumerate(g.keys)}
    rows = t.df.select("*", *[k.alias(n) for n, k in keys.items()])
    groups = rows.groupBy(*keys).agg(*[m.alias(n) for n, m in g.measures().items()])
    return g.finished(_with_medians(groups, rows, list(keys), g.middles()))


def _with_medians(groups: DataFrame, rows: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """A row for each group, with the medians of its rows."""
    if not values:
        return groups
    found = medians(rows, keys, values)
    out = groups.withColumn("__group", group_of(keys)).join(found, "__group", "left").drop("__group")
    return out.withColumns({n: numbers.written(F.col(n)) for n in values})


def summarize_many(t: Table, every: list[dict]) -> list[Table]:
    """Several summaries of a table from one scan of it: each row counts once for each grouping, and a grouping's measures
    look at its own rows alone. What comes of it, a row a group, is written. Bins of equal width take a look before, medians
    of all summaries one scan more."""
    groupings = [Grouping(t, p) for p in every]
    width = max((len(g.by) for g in groupings), default=0)
    rows = t.df.select("*", *[k.alias(f"__g{b}_{i}") for b, g in enumerate(groupings) for i, k in enumerate(g.keys)])
    key_of = lambda b, g, i: F.col(f"__g{b}_{i}") if i < len(g.by) else F.lit(None).cast("string")
    sets = F.array(*[F.struct(F.lit(b).alias("g"), *[key_of(b, g, i).alias(f"k{i}") for i in range(width)]) for b, g in enumerate(groupings)])
    rows = rows.withColumn("__set", F.explode(sets)).select("*", F.col("__set.g").alias("__g"), *[F.col(f"__set.k{i}").alias(f"__k{i}") for i in range(width)])
    measures = [m.alias(f"__m{b}{n}") for b, g in enumerate(groupings) for n, m in g.measures(F.col("__g") == b).items()]
    keys = ["__g", *[f"__k{i}" for i in range(width)]]
    values = {f"__m{b}{n}": v for b, g in enumerate(groupings) for n, v in g.middles(F.col("__g") == b).items()}
    groups = written(_with_medians(rows.groupBy(*keys).agg(*measures), rows, keys, values), "groups")
    return [g.finished(groups.filter(F.col("__g") == b).select(*[f"__k{i}" for i in range(len(g.by))], *[F.col(f"__m{b}{n}").alias(n) for n in [*g.measures(), *g.middles()]])) for b, g in enumerate(groupings)]
