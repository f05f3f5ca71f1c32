"""Deduplication and summaries of streams, with state that expires by event time.

Both are the aggregates of the batch operators, grouped by an event-time window besides: a group of duplicates is a session
of rows with equal keys, which ends when none came for a while; a summary's groups are those of each window. State is
Spark's own and goes when the watermark passes the window's end, at which the window's row is written. Rows later than
that are left out; a query's progress counts them (`late_rows`). Over a frame that is no stream the same functions give what
a stream gives in the end, when none of its rows is late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from limpid.functions.text import key
from limpid.operators.dedup import ACTIONS, _chosen, group_key
from limpid.operators.summarize import aggregate, shown
from limpid.table import ORD, Table, q


def _table(df: DataFrame, event_time: str, delay: str, order_by: list[str] | None) -> Table:
    """A time without a zone counts as one of the session's."""
    if df.schema[event_time].dataType.simpleString() == "timestamp_ntz":
        df = df.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return Table.of(df.withWatermark(event_time, delay), order_by or [event_time])


def deduplicate_stream(df: DataFrame, columns: list[str], event_time: str, gap: str, delay: str, action: str = "keep_first", mode: str = "exact", order_by: list[str] | None = None) -> DataFrame:
    """One row for each group of rows equal in `columns` and each at most `gap` apart in event time from another.

    action: keep_first, keep_last, keep_most_complete or merge_first_nonempty. order_by: what orders rows and tells them
    apart, event_time if it isn't given. delay: how late rows may come. All cells are texts, as operators have them."""
    if action not in ACTIONS or action == "flag_only":
        raise ValueError(f"a stream's groups can't be kept by {action!r}")
    t = _table(df, event_time, delay, order_by)
    t.need(*columns, event_time)
    own = t.df.withColumn("__key", group_key(columns, mode))
    groups = own.groupBy("__key", F.session_window(q(t.native[event_time][0]), gap)).agg(_chosen(t, {action})[action].alias("x"))
    return groups.select(*[F.col("x").getField(c).alias(c) for c in t.columns])


def summarize_stream(df: DataFrame, group_by: list[dict], aggregates: list[dict], event_time: str, window: str, delay: str, slide: str | None = None, order_by: list[str] | None = None) -> DataFrame:
    """(window_start, window_end, groups, aggregates) for each event-time window and group [{column, normalization}], whose
    cells are those of its first row. aggregates are those of summarize but countDistinct, whose values no state bounds."""
    if bad := [a["fn"] for a in aggregates if a["fn"] == "countDistinct"]:
        raise ValueError(f"a stream has no {bad[0]}")
    t = _table(df, event_time, delay, order_by)
    t.need(event_time, *[g["column"] for g in group_by], *[a["column"] for a in aggregates if a["fn"] != "count"])
    keys = [key(q(g["column"]), g.get("normalization")).alias(f"__k{i}") for i, g in enumerate(group_by)]
    span = F.window(q(t.native[event_time][0]), window, slide) if slide else F.window(q(t.native[event_time][0]), window)
    first = [F.min_by(q(g["column"]), F.col(ORD)).alias(f"__d{i}") for i, g in enumerate(group_by)]
    values = [shown(a, aggregate(t, a)).alias(f"__a{i}") for i, a in enumerate(aggregates)]
    out = t.df.select("*", *keys).groupBy(span.alias("__w"), *[f"__k{i}" for i in range(len(group_by))]).agg(*first, *values)
    return out.select(
        F.col("__w.start").alias("window_start"),
        F.col("__w.end").alias("window_end"),
        *[F.col(f"__d{i}").alias(g["column"]) for i, g in enumerate(group_by)],
        *[F.col(f"__a{i}").alias(a["name"]) for i, a in enumerate(aggregates)],
    )


def late_rows(stream: StreamingQuery) -> int:
    """How many rows came too late for their window, by what the query's progress still tells."""
    return sum(int(s.get("numRowsDroppedByWatermark", 0)) for p in stream.recentProgress for s in p["stateOperators"])
