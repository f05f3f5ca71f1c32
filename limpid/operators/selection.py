"""Exact medians of many groups at once, by selection: no task holds a group's values.

A double becomes an integer of the same order. Three passes settle its bits from the first on: each counts a group's
values by their next bits, begun by map tasks, and goes on with the one or two counts that hold the middle. A group never
has more than 2^22 counts in a pass; its values are neither sorted nor brought together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from limpid.storage import written

#: How many of the last bits each pass leaves open.
OPEN = (42, 21, 0)
_MAGNITUDE = np.int64(0x7FFF_FFFF_FFFF_FFFF)


def _flipped(bits: np.ndarray) -> np.ndarray:
    """Negative numbers order their bits the other way round; its own inverse."""
    return np.where(bits < 0, bits ^ _MAGNITUDE, bits)


@F.pandas_udf(LongType())
def as_ordered(x: pd.Series) -> pd.Series:
    """Doubles as integers of the same order; both zeros become one."""
    return pd.Series(_flipped((x.to_numpy(np.float64) + 0.0).view(np.int64)))


@F.pandas_udf(DoubleType())
def from_ordered(x: pd.Series) -> pd.Series:
    return pd.Series(_flipped(x.to_numpy(np.int64)).view(np.float64))


def group_of(keys: list[str]) -> Column:
    """A group's keys as one value, which is equal to another even where keys are null, and there without keys."""
    return F.struct(F.lit(0).alias("all"), *keys)


def medians(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """(__group, names): for each group of keys the median of each column of doubles, null where it has no value. Values
    that are null don't count; of an even number it is the mean of the two in the middle. The different values of each
    group are written once with their numbers, dealt by group and value, so that a frequent group lies in all tasks."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), v.alias("v")) for i, v in enumerate(values.values())]))
    rows = df.select(group_of(keys).alias("__group"), each.alias("x")).filter("x.v is not null")
    rows = rows.groupBy("__group", "x").agg(F.count("*").alias("c"))
    rows = written(rows.select("__group", F.col("x.m").alias("m"), as_ordered("x.v").alias("b"), "c"), "selection")
    counts = rows.groupBy("__group", "m", F.shiftright("b", OPEN[0]).alias("bits")).agg(F.sum("c").alias("c"))
    every = Window.partitionBy("__group", "m")
    counts = counts.withColumn("n", F.sum("c").over(every)).selectExpr("*", "(n - 1) div 2 AS low", "n div 2 AS high")
    chosen = _holding(counts, every)
    for before, now in zip(OPEN, OPEN[1:], strict=False):
        own = rows.withColumn("before", F.shiftright("b", before)).join(chosen.withColumnRenamed("bits", "before"), ["__group", "m", "before"])
        counts = own.groupBy("__group", "m", "before", F.shiftright("b", now).alias("bits")).agg(F.sum("c").alias("c"), F.max("low").alias("low"), F.max("high").alias("high"))
        chosen = _holding(counts, Window.partitionBy("__group", "m", "before"))
    middle = chosen.groupBy("__group", "m").agg(*[F.max(F.when(F.col(r).isNotNull(), F.col("bits"))).alias(r) for r in ("low", "high")])
    middle = middle.select("__group", "m", (from_ordered("low") * 0.5 + from_ordered("high") * 0.5).alias("v"))
    return middle.groupBy("__group").agg(*[F.max(F.when(F.col("m") == i, F.col("v"))).alias(n) for i, n in enumerate(values)])


def _holding(counts: DataFrame, within: Window) -> DataFrame:
    """(__group, m, bits, low, high): the counts that hold the ranks `low` or `high`, which are told from 0 within them;
    null where a count doesn't hold that rank."""
    own = counts.withColumn("past", F.sum("c").over(within.orderBy("bits").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c"))
    rank = lambda r: F.when((F.col(r) >= F.col("past")) & (F.col(r) < F.col("past") + F.col("c")), F.col(r) - F.col("past")).alias(r)
    return own.select("__group", "m", "bits", rank("low"), rank("high")).filter("low is not null or high is not null")
