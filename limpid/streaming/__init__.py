"""Row-wise operators over streams. The batch operators that only project or filter run on a streaming frame as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limpid.operators.registry import Context, find
from limpid.table import ORD, Table, as_text

#: Operators that need no other row.
ROW_WISE = frozenset({"rename_columns", "reorder_columns", "drop_columns", "hide_columns", "duplicate_column", "add_constant_column", "add_concat_column", "add_extract_column", "add_expression_column", "normalize_columns", "filter_rows", "set_value_where"})


def apply_steps(stream: DataFrame, steps: list[dict]) -> DataFrame:
    """A stream (or a batch) after steps {type, params}; those that need other rows are refused."""
    t = Table(stream.select(F.lit(0).cast("bigint").alias(ORD), *[as_text(stream, c).alias(c) for c in stream.columns]), tuple(stream.columns))
    for s in steps:
        if s["type"] not in ROW_WISE:
            raise ValueError(f"{s['type']} needs other rows than its own and can't run on a stream")
        t = find(s["type"])(t, s["params"], Context())
    return t.output()
