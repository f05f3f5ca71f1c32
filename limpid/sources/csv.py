"""Delimited text in and out. Reading is Spark's; only the head of a file is looked at by the driver."""

from __future__ import annotations

import csv
import io
import re
from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.functions.text import trim
from limpid.sources.one_file import write_one_file
from limpid.sources.quoted import records
from limpid.table import ORD, Table, q

DELIMITERS = (",", ";", "\t", "|")


def headers(names: list[str]) -> list[str]:
    """Trimmed names; blank ones are numbered, repeated ones get ` (2)`, ` (3)`, never a name that is there."""
    out: list[str] = []
    trimmed = [n.lstrip("\ufeff").strip() or f"Colonne {i + 1}" for i, n in enumerate(names)]
    for n in trimmed:
        name, k = n, 1
        while name in out or (k > 1 and name in trimmed):
            k += 1
            name = f"{n} ({k})"
        out.append(name)
    return out


def delimiter_of(text: str) -> str:
    """The delimiter that cuts the first lines into most columns alike; a comma if none does."""
    rows = [x for x in text.splitlines() if x.strip()][:10]
    best = max(DELIMITERS, key=lambda d: (lambda n: (n[0] > 1, n.count(n[0]), n[0]))([len(next(csv.reader([x], delimiter=d))) for x in rows] or [0]))
    return best


def _records(text: str, sep: str) -> list[list[str]]:
    """The rows of a text, but for blank ones."""
    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if any(x.strip() for x in r)]


def _returns_alone(spark: SparkSession, path: str) -> bool:
    first = spark.read.text(path, lineSep="\n").head()
    return first is not None and "\r" in first.value[:-1]


def raw_rows(spark: SparkSession, path: str, delimiter: str | None = None, header_row: int = 0, multi_line: bool | None = None) -> tuple[DataFrame, list[str], str]:
    """(file, block, place, c0, c1, ..) for all rows of all files that aren't blank, the names in the header row, and the
    delimiter. Rows are ordered by file, block and place.

    multi_line: whether quoted cells may hold line breaks; None finds out, by one look at all lines: a line that opens such
    a cell has an odd number of quotes. Such files are read in ranges as others are, see quoted.records(); only one whose
    lines end in carriage returns alone is a task.
    """
    lines = spark.read.text(path)
    head = [r.value.lstrip("\ufeff") for r in lines.filter(F.trim("value") != "").limit(header_row + 50).collect()]
    sep = delimiter or delimiter_of("\n".join(head[header_row:]))
    if multi_line is None:
        odd = F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1
        multi_line = bool(lines.filter(odd).head(1))
    rows = _records("\n".join(head), sep)
    names = rows[header_row] if header_row < len(rows) else []
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(max(1, len(names)))])
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    cells = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in schema.names]
    if multi_line and not _returns_alone(spark, path):
        parsed = F.from_csv("value", schema.simpleString()[len("struct<") : -1].replace(":", " "), {**options, "multiLine": "true"})
        raw = records(spark, path, sep).select("file", "block", "place", parsed.alias("r")).select("file", "block", "place", "r.*").select("file", "block", "place", *cells)
    else:
        raw = spark.read.csv(path, schema=schema, header=False, multiLine=multi_line, enforceSchema=True, **options)
        raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), *cells)
    some = F.lit(False)
    for c in schema.names:
        some = some | (trim(F.col(c)) != "")
    return raw.filter(some), names, sep


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, header_row: int = 0, name: str = "", multi_line: bool | None = None) -> Table:
    """A table from a CSV file, or a folder of files that each have their header. Blank rows don't count; those before the
    header row are left out, short rows are filled up, further cells are ignored. See raw_rows()."""
    raw, found, _ = raw_rows(spark, path, delimiter, header_row, multi_line)
    names = headers(found)
    if not names:
        return Table.rows(spark, [], [], name=name)
    first = raw.filter("block = 0").groupBy("file")
    if header_row == 0:
        heads = first.agg(F.min("place").alias("head"))
    else:  # the row of that number in each file; a task keeps no more rows of a file than it takes
        number = F.row_number().over(Window.partitionBy("file").orderBy("place"))
        heads = raw.filter("block = 0").select("file", "place").withColumn("n", number).filter(F.col("n") <= header_row + 1).groupBy("file").agg(F.max("place").alias("head"))
    body = raw.join(heads, "file").filter((F.col("block") > 0) | (F.col("place") > F.col("head")))
    df = body.select(F.struct("file", "block", "place").alias(ORD), *[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
    return Table(df, tuple(names), name=name or path.rstrip("/").rpartition("/")[2])


def preview(spark: SparkSession, path: str, delimiter: str | None = None, header_row: int = 0, rows: int = 5) -> dict:
    """The first rows as they are, those before the header too, how many rows there are, the delimiter and the names."""
    raw, found, sep = raw_rows(spark, path, delimiter, header_row)
    some = raw.orderBy("file", "block", "place").limit(rows).drop("file", "block", "place").collect()
    return {"rawRowCount": raw.count(), "preview": [list(r) for r in some], "delimiter": sep, "columns": headers(found)}


def table_from_text(spark: SparkSession, text: str, delimiter: str | None = None, header_row: int = 0, name: str = "") -> Table:
    """A table from pasted text."""
    text = text.lstrip("\ufeff")
    rows = _records(text, delimiter or delimiter_of(text))[header_row:]
    names = headers(rows[0]) if rows else []
    body = [(r + [""] * len(names))[: len(names)] for r in rows[1:] if any(x.strip() for x in r)]
    return replace(Table.rows(spark, names, body), name=name)


def write_csv(t: Table, path: str, delimiter: str = ";", columns: list[str] | None = None, overwrite: bool = False, single: bool = False, bom: bool = True) -> None:
    """A folder of CSV parts in the rows' order, each with its header and, if bom, a byte order mark before it; or, if
    `single`, one file with one header, see write_one_file(). Refuses a path that is there unless told to overwrite."""
    t.need(*(columns or ()))
    names = list(columns or t.columns)
    own = t.ordered().select(*map(q, names))
    form = {"sep": delimiter, "quote": '"', "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    mark = "\ufeff" if bom else ""
    if single:
        head = io.StringIO()
        csv.writer(head, delimiter=delimiter, lineterminator="\n").writerow(names)
        write_one_file(own, path, mark + head.getvalue(), overwrite, **form)
    else:
        own.toDF(*([mark + names[0], *names[1:]] if names else [])).write.mode("overwrite" if overwrite else "errorifexists").csv(path, header=True, **form)


def to_text(t: Table, delimiter: str = ";", bom: bool = True, most: int = 100_000) -> str:
    """A small table as one text; raises beyond `most` rows."""
    rows = t.ordered().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; use write_csv")
    out = io.StringIO()
    w = csv.writer(out, delimiter=delimiter, lineterminator="\r\n")
    w.writerow(t.columns)
    w.writerows(rows)
    return ("\ufeff" if bom else "") + out.getvalue()


def file_name(name: str, on: date) -> str:
    """name-yyyy-mm-dd.csv, in plain letters."""
    return f"{re.sub(r'[^a-z0-9]+', '-', name.lower()).strip('-') or 'table'}-{on.isoformat()}.csv"
