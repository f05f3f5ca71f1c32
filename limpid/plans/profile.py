"""Profiles of columns: filling, distinct values, types, anomalies and the most frequent values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limpid.functions.text import SPACE
from limpid.table import ORD, Table, q

#: Words that stand for truth values.
BOOLEANS = ("true", "false", "vrai", "faux", "oui", "non", "yes", "no", "0", "1")
#: The forms of numbers and dates, and of broken encoding.
INTEGER, DECIMAL = r"^-?[0-9]+$", r"^-?[0-9]+[.,][0-9]+$"
DATE = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4})$"
OUTER, DOUBLE, MOJIBAKE = rf"\A{SPACE}|{SPACE}\z", rf"{SPACE}{{2,}}", "Ã.|Â.|â€.|�"


def case_of(c: Column) -> Column:
    """upper, lower, title (each word begins with no small letter and has none but small ones behind) or other; null
    without a letter of A-Z, a-z or U+00C0 to U+00FF."""
    words = F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")
    rest = lambda w: F.substring(w, 2, 1 << 30)
    titled = F.forall(words, lambda w: (F.left(w, F.lit(1)) == F.upper(F.left(w, F.lit(1)))) & (rest(w) == F.lower(rest(w))))
    upper, lower = c == F.upper(c), c == F.lower(c)
    return F.when(~c.rlike("[a-zA-ZÀ-ÿ]"), None).when(upper & ~lower, "upper").when(lower & ~upper, "lower").when(titled, "title").otherwise("other")


def _long(t: Table) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), q(c).alias("value")) for i, c in enumerate(t.columns)]))
    return t.df.select(ORD, pairs.alias("x")).select(ORD, "x.*")


def values(t: Table) -> DataFrame:
    """(i, column, value, n, first): the different cells that aren't empty. All profiles start from these, so a column's
    copies are counted before anything else is done with them."""
    return _long(t).filter("value <> ''").groupBy("i", "column", "value").agg(F.count("*").alias("n"), F.min(ORD).alias("first"))


def profile(t: Table) -> DataFrame:
    """(column, total, filled, fill_rate, distinct, type, and how many cells have outer spaces, several spaces in a row
    or broken encoding), a row for each column."""
    v = F.col("value")
    every = lambda p: F.bool_and(p)
    own = values(t).groupBy("column").agg(
        F.sum("n").alias("filled"), F.count("*").alias("distinct"),
        every(F.lower(v).isin(*BOOLEANS)).alias("b"), every(v.rlike(INTEGER)).alias("z"),
        every(v.rlike(INTEGER) | v.rlike(DECIMAL)).alias("r"), every(v.rlike(DATE)).alias("d"),
        *[F.sum(F.when(v.rlike(p), F.col("n")).otherwise(0)).alias(name) for name, p in (("outer_spaces", OUTER), ("double_spaces", DOUBLE), ("broken_encoding", MOJIBAKE))],
    )
    total = t.df.agg(F.count("*").alias("total"))
    heads = total.select(F.explode(F.array(*map(F.lit, t.columns))).alias("column"), "total")
    kind = (
        F.when(F.col("filled").isNull(), "empty").when(F.col("b") & (F.col("distinct") <= 2), "boolean").when(F.col("z"), "integer")
        .when(F.col("r"), "decimal").when(F.col("d"), "date").otherwise("text")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return heads.join(own, "column", "left").select("column", "total", zero("filled"), F.when(F.col("total") > 0, F.coalesce("filled", F.lit(0)) / F.col("total")).otherwise(0.0).alias("fill_rate"), zero("distinct"), kind.alias("type"), zero("outer_spaces"), zero("double_spaces"), zero("broken_encoding"))


def top_values(t: Table, k: int = 5) -> DataFrame:
    """(column, rank, value, n): the most frequent cells, the first of equals."""
    w = Window.partitionBy("column").orderBy(F.desc("n"), "first")
    return values(t).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("column", "rank", "value", "n")


def odd_case(t: Table, k: int = 3) -> DataFrame:
    """(column, rank, value): the first cells whose case isn't the column's most frequent one, the first of equals."""
    case = case_of(F.col("value"))
    sums = values(t).withColumn("case", case).filter("case is not null").groupBy("column", "case").agg(F.sum("n").alias("m"), F.min("first").alias("f"))
    main = sums.groupBy("column").agg(F.min(F.struct(-F.col("m"), "f", "case"))["case"].alias("main"))  # a row for each column
    own = _long(t).filter("value <> ''").withColumn("case", case).filter("case is not null")
    return _first(own.join(F.broadcast(main), "column").filter("case <> main"), k, "column").select("column", "rank", "value")


def anomaly_examples(t: Table, k: int = 3) -> DataFrame:
    """(column, anomaly, rank, value): the first cells with each anomaly that profile() counts, and of odd case."""
    kinds = F.explode(F.array_compact(F.array(*[F.when(F.col("value").rlike(p), name) for name, p in (("outer_spaces", OUTER), ("double_spaces", DOUBLE), ("broken_encoding", MOJIBAKE))])))
    own = _first(_long(t).filter("value <> ''").withColumn("anomaly", kinds), k, "column", "anomaly")
    return own.select("column", "anomaly", "rank", "value").unionByName(odd_case(t, k).withColumn("anomaly", F.lit("odd_case")))


def _first(cells: DataFrame, k: int, *by: str) -> DataFrame:
    """The first k cells of each group with their rank; each task keeps k of a group before any are moved."""
    return cells.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(ORD))).filter(F.col("rank") <= k)


def bounded(t: Table, cap: int = 30, most: int = 200) -> dict:
    """The first rows, at most `most` of them: {totalCount, sample, truncated}."""
    total, n = t.df.count(), max(0, min(cap, most))
    rows = [dict(zip(t.columns, r, strict=True)) for r in (tuple(x) for x in t.ordered().limit(n).collect())]
    return {"totalCount": total, "sample": rows, "truncated": total > len(rows)}
