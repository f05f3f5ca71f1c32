"""Ordered text tables over DataFrames.

Every cell is a string, "" stands for missing. Columns that came with a type of their own also keep it, unseen, so that
filters reach the files and numbers needn't be parsed. `__ord` gives the rows' order, which first, last, concat and
numbering follow: a value that is read off the row, such as its key or its place in its file, never a position that a
sort gives it, as that may differ from one evaluation to the next.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from limpid.storage import written

ORD = "__ord"
WHOLE = ("tinyint", "smallint", "int", "bigint")
NUMERIC = (*WHOLE, "float", "double")
DAYS = ("date", "timestamp", "timestamp_ntz")
#: Types whose values are kept beside their text.
KEPT = (*WHOLE, "double", "string", *DAYS)


def q(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def plain(x: Column) -> Column:
    """A double as text, all its digits and no exponent from 1e-6 up to 1e21; whole numbers without decimals."""
    t, size = x.cast("string"), F.abs(x)
    short = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\.0E", "E"), r"E(\d)", "e+$1"), "E-", "e-")
    full = F.when(size < 1, t.try_cast("decimal(38,30)").cast("string")).otherwise(t.try_cast("decimal(38,16)").cast("string"))
    return (
        F.when(~t.contains("E"), F.regexp_replace(t, r"\.0$", ""))
        .when((size >= 1e21) | (size < 1e-6), short)
        .otherwise(F.regexp_replace(full, r"\.?0+$", ""))
    )


def as_text(df: DataFrame, name: str) -> Column:
    """Any value as text: whole numbers without decimals, dates as yyyy-MM-dd, null as ""."""
    kind, c = df.schema[name].dataType.simpleString(), q(name)
    if kind in ("double", "float"):
        c = plain(c)
    elif kind.startswith("timestamp"):
        c = F.when(c == F.date_trunc("day", c), F.date_format(c, "yyyy-MM-dd")).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"))
    return F.coalesce(c.cast("string"), F.lit(""))


@dataclass(frozen=True)
class Table:
    df: DataFrame
    columns: tuple[str, ...]
    hidden: frozenset[str] = frozenset()
    name: str = ""
    #: Visible column -> (column of df with its own type, that type); only where the text is that value's.
    native: dict[str, tuple[str, str]] = field(default_factory=dict)

    @classmethod
    def of(cls, df: DataFrame, order_by: Iterable[str] | None = None, name: str = "") -> Table:
        """From any DataFrame. order_by: columns that tell rows apart and order them; rows equal in all of them are in no
        order. Without it, the order in which partitions deliver rows: then df must deliver them alike each time, as a
        scan of files does."""
        keys = list(order_by or ())
        if not keys:
            return cls._from(df, F.monotonically_increasing_id(), name)
        whole = len(keys) == 1 and df.schema[keys[0]].dataType.simpleString() in WHOLE
        return cls._from(df, q(keys[0]).cast("bigint") if whole else F.struct(*map(q, keys)), name)

    @classmethod
    def parquet(cls, spark: SparkSession, path: str, columns: Iterable[str] | None = None, name: str = "") -> Table:
        """From Parquet files, in the order of their rows; of several files, by their paths."""
        df = spark.read.parquet(path)
        single = len(df.inputFiles()) == 1
        order = F.col("_metadata.row_index") if single else F.struct("_metadata.file_path", "_metadata.row_index")
        return cls._from(df, order, name, columns)

    @classmethod
    def _from(cls, df: DataFrame, order: Column, name: str, columns: Iterable[str] | None = None) -> Table:
        names = tuple(columns or df.columns)
        kinds = {c: df.schema[c].dataType.simpleString() for c in names}
        native = {c: (f"__native{i}", kinds[c]) for i, c in enumerate(names) if kinds[c] in KEPT}
        own = [q(c).alias(n) for c, (n, _) in native.items()]
        return cls(df.select(order.alias(ORD), *[as_text(df, c).alias(c) for c in names], *own), names, name=name, native=native)

    @classmethod
    def rows(cls, spark: SparkSession, columns: Iterable[str], rows: Iterable[Iterable[str]], name: str = "") -> Table:
        """From rows in memory; None is ""."""
        columns = tuple(columns)
        data = [(i, *["" if x is None else str(x) for x in r]) for i, r in enumerate(rows)]
        schema = ", ".join([f"{ORD} bigint", *[f"`{c}` string" for c in columns]])
        return cls(spark.createDataFrame(data, schema), columns, name=name)

    def need(self, *names: str) -> None:
        """Raises if a column is missing, telling those there are."""
        if gone := [n for n in names if n not in self.columns]:
            raise KeyError(f"no column {', '.join(map(repr, gone))}; columns: {', '.join(self.columns)}")

    def select(self, cells: dict[str, Column | str]) -> Table:
        """A table of these columns, in one projection; a string takes a column over as it is, with its own type."""
        native = {n: self.native[c] for n, c in cells.items() if isinstance(c, str) and c in self.native}
        text = [(q(c) if isinstance(c, str) else c).alias(n) for n, c in cells.items()]
        return replace(self, df=self.df.select(ORD, *text, *sorted({x for x, _ in native.values()})), columns=tuple(cells), hidden=self.hidden & cells.keys(), native=native)

    def cells(self) -> dict[str, Column | str]:
        return {c: c for c in self.columns}

    def with_column(self, name: str, value: Column | str) -> Table:
        """With a column added or, if it is there, replaced."""
        return self.select({**self.cells(), name: value})

    def typed(self, name: str, *kinds: str) -> Column | None:
        """A column with its own type, if it is one of these; null stands for "" as well as for itself."""
        own, kind = self.native.get(name, ("", ""))
        return q(own) if kind in kinds else None

    def number(self, name: str) -> Column | None:
        """A column's numbers as doubles, null where it has none, if it has a type of numbers."""
        x = self.typed(name, *NUMERIC)
        return None if x is None else F.when(~F.isnan(x.cast("double")), x.cast("double"))

    def output(self) -> DataFrame:
        """The columns alone, in no order."""
        return self.df.select(*map(q, self.columns))

    def ordered(self) -> DataFrame:
        return self.df.orderBy(ORD).select(*map(q, self.columns))

    def collect(self) -> list[tuple[str, ...]]:
        return [tuple(r) for r in self.ordered().collect()]


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Adds the rows' gapless number from 0 in the order of ORD, without moving all rows to one task.

    The sorted rows are written once with their partition and their place in it, so that both are settled; how many rows
    lie before a partition is a sum over one row for each.
    """
    place = F.monotonically_increasing_id()
    rows = written(df.orderBy(ORD).withColumn("__p", F.shiftright(place, 33)).withColumn("__i", place.bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    sizes = rows.groupBy("__p").agg(F.count("*").alias("__c"))  # a row for each partition
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__s"))
    return rows.join(F.broadcast(starts), "__p").withColumn(name, F.col("__s") + F.col("__i")).drop("__p", "__i", "__s")
