"""Deduplication. A group becomes its row by one aggregate over whole rows, which map tasks begin: a very large group needs
neither a window nor a join, and no row is looked up by its place a second time. Aggregates over whole rows sort them, so
tables carry numbers and times as such, a few bytes each; their texts are made of the rows that stay."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limpid.functions.text import comparison
from limpid.operators.registry import Context, operator
from limpid.storage import written
from limpid.table import DAYS, ORD, WHOLE, Table, as_text, q

ACTIONS = ("keep_first", "keep_last", "keep_most_complete", "merge_first_nonempty", "flag_only")
JOINT = "\u0001"


def group_key(columns: list[str], mode: str) -> Column:
    return F.concat_ws(JOINT, *[comparison(q(c)) if mode == "normalized" else q(c) for c in columns])


def groups(t: Table, columns: list[str], mode: str) -> DataFrame:
    """(__key, __count, __first): groups of two rows or more."""
    own = t.df.withColumn("__key", group_key(columns, mode))
    return own.groupBy("__key").agg(F.count("*").alias("__count"), F.min(ORD).alias("__first")).filter("__count > 1")


def _chosen(t: Table, actions: set[str], cells: dict[str, Column] | None = None) -> dict[str, Column]:
    """For each action the group's row, as a struct of its order and cells, which are texts or as given; null stands for "" in
    those given."""
    own, cells = cells, cells or {c: q(c) for c in t.columns}
    row = F.struct(ORD, *[x.alias(c) for c, x in cells.items()])
    has = lambda x: F.coalesce(x.cast("string") != "", F.lit(False)) if own else x != ""
    first_of = lambda x: F.min_by(x, F.when(has(x), F.col(ORD))) if own else F.coalesce(F.min_by(x, F.when(has(x), F.col(ORD))), F.lit(""))
    filled = reduce(lambda a, b: a + b, [has(x).cast("int") for x in cells.values()])
    make = {
        # The order is a row's first field: the least row is the first one and needs no second copy of its order. The state
        # of streams, which has texts, stays as it is.
        "keep_first": lambda: F.min(row) if own else F.min_by(row, F.col(ORD)),
        "keep_last": lambda: F.max(row) if own else F.max_by(row, F.col(ORD)),
        "keep_most_complete": lambda: F.min_by(row, F.struct(-filled, F.col(ORD))),
        "merge_first_nonempty": lambda: F.struct(F.min(ORD).alias(ORD), *[first_of(x).alias(c) for c, x in cells.items()]),
    }
    return {a: make[a]() for a in ACTIONS if a in actions and a in make}


def _carried(t: Table) -> dict[str, Column]:
    """The cells as aggregates carry them: in a type of their own that is shorter than its text, else as text."""
    own = {c: t.typed(c, *WHOLE, "double", *DAYS) for c in t.columns}
    return {c: q(c) if x is None else x for c, x in own.items()}


@operator("deduplicate")
def deduplicate(t: Table, p: dict, ctx: Context) -> Table:
    """columns, mode (exact or normalized), action, overrides {key: action}; keys of several columns are joined by U+0001.

    Flagged rows get `oui` in flag_column, a column that is there whenever a group may be flagged. Without columns there
    are no groups.
    """
    columns, action, overrides, mode = p["columns"], p.get("action", "keep_first"), p.get("overrides") or {}, p.get("mode", "exact")
    if bad := {action, *overrides.values()} - {*ACTIONS}:
        raise ValueError(f"unknown action {min(bad)!r}")
    t.need(*columns)
    actions, flag = {action, *overrides.values()}, p.get("flag_column") or "_doublon"
    flags = "flag_only" in actions
    if not columns:
        return t.with_column(flag, F.lit("")) if flags else t
    own = replace(t, df=t.df.withColumn("__key", group_key(columns, mode)))
    what = F.lit(action)
    if overrides:
        table = F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair])
        what = F.coalesce(F.try_element_at(table, F.col("__key")), what)
    cells = t.cells() | ({flag: flag if flag in t.columns else F.lit("")} if flags else {})
    parts = []
    if actions - {"flag_only"}:
        whole = t.typed(columns[0], *WHOLE) if len(columns) == 1 and mode == "exact" else None
        by = F.col("__key") if overrides or whole is None else whole  # equal texts are equal numbers
        one = own.df.filter(what != "flag_only").groupBy(by.alias("__key")).agg(F.count("*").alias("__count"), *[x.alias(a) for a, x in _chosen(t, actions, _carried(t)).items()])
        one = ctx.count(one, duplicateRows=F.sum(F.when(F.col("__count") > 1, F.col("__count"))))
        choice = F.coalesce(*[F.when(what == a, F.col(a)) for a in ACTIONS if a in actions and a != "flag_only"])
        rows = one.select(choice.alias("x")).select("x.*")
        parts.append(replace(t, df=rows.select(ORD, *[as_text(rows, c).alias(c) for c in t.columns]), native={}).select(cells))
    if flags:
        # Written, so that Spark can split a very large group in the join.
        often = written(groups(t, columns, mode).filter(what == "flag_only").select("__key", "__count"), "duplicates")
        marked = own.df.filter(what == "flag_only").join(often, "__key", "left")
        marked = ctx.count(marked, duplicateRows=F.count("__count"))
        cells[flag] = F.when(F.col("__count").isNotNull(), "oui").otherwise(q(flag) if flag in t.columns else "")
        parts.append(replace(t, df=marked).select(cells))
    if len(parts) == 1:
        return parts[0]
    return replace(parts[0], df=parts[0].df.unionByName(parts[1].df.select(*map(q, parts[0].df.columns))))


def find_duplicates(t: Table, columns: list[str], mode: str = "normalized") -> DataFrame:
    """(key, rows) for each group, in the order of its first row."""
    return groups(t, columns, mode).orderBy("__first").select(F.col("__key").alias("key"), F.col("__count").alias("rows"))


def diverging_columns(t: Table, columns: list[str], mode: str = "normalized") -> DataFrame:
    """(key, columns): for each group the columns whose cells differ."""
    own = t.df.withColumn("__key", group_key(columns, mode))
    differ = F.filter(F.array(*[F.when(F.min(q(c)) != F.max(q(c)), F.lit(c)) for c in t.columns]), lambda x: x.isNotNull())
    return own.groupBy("__key").agg(F.count("*").alias("__n"), differ.alias("columns")).filter("__n > 1").select(F.col("__key").alias("key"), "columns")
