"""CSV records that span lines, read in parallel.

Files are cut into ranges by Spark, as lines. Whether a range begins inside of a quoted cell depends on all before it. But
what a line does to that is a function of two states, and so is what a range's lines do together: one look at the lines
that hold a quote gives each range's function, a row a range, and applying them one after the other tells where each
range begins. Then every range makes its records alone. Only a record that crosses ranges is left in pieces, at most two
a range, which are put together afterwards.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: From within a quoted cell: up to the quote that ends it; two quotes stand for one.
REST = re.compile(r'(?:[^"]|"")*+"(?!")')


def ends_inside(line: str, inside: bool, sep: str) -> bool:
    """Whether a line leaves a quoted cell open. A quote opens a cell at its very begin only; what follows the quote that
    ends it, up to the next delimiter, is not looked at."""
    at = 0
    while True:
        if not inside:
            if line[at : at + 1] != '"':
                at = line.find(sep, at) + 1
                if not at:
                    return False
                continue
            at += 1
        end = REST.match(line, at)
        if not end:
            return True
        at, inside = line.find(sep, end.end()) + 1, False
        if not at:
            return False


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Batches cut where the file or the range changes."""
    for b in batches:
        if b.num_rows:
            same = [pc.equal(c.slice(1), c.slice(0, b.num_rows - 1)) for c in b.columns[:2]]
            cuts = [0, *(np.flatnonzero(~pc.and_(*same).to_numpy(zero_copy_only=False)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                yield b.column(0)[lo].as_py(), b.column(1)[lo].as_py(), b.slice(lo, hi - lo)


def _functions(sep: str):
    """(file, block, outside, inside): what a range that begins outside, or inside, of a quoted cell leaves open."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], tuple[bool, bool]] = {}
        for file, block, b in _runs(batches):
            out, into = found.get((file, block), (False, True))
            for line in b.column(2).to_pylist():
                new = {s: ends_inside(line, s, sep) for s in {out, into}}
                out, into = new[out], new[into]
            found[file, block] = out, into
        rows = [(*k, *v) for k, v in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.bool_(), pa.bool_()))], ["file", "block", "outside", "inside"])

    return step


class Ranges:
    """Which ranges begin inside of a quoted cell: for each file the ranges after which that changes."""

    def __init__(self, rows: list):
        by_file: dict[str, list] = defaultdict(list)
        for r in rows:
            by_file[r.file].append(r)
        self.changes: dict[str, list[int]] = {}
        for file, own in by_file.items():
            state, changes = False, []
            for r in sorted(own, key=lambda r: r.block):
                new = r.inside if state else r.outside
                if new != state:
                    changes.append(r.block)
                state = new
            if changes:
                self.changes[file] = changes

    def opens(self, file: str, block: int) -> bool:
        return bisect_left(self.changes.get(file, ()), block) % 2 == 1

    @classmethod
    def of(cls, lines: DataFrame, sep: str) -> Ranges:
        """A row for each range with a quote comes to the driver."""
        return cls(lines.filter(F.col("value").contains('"')).mapInArrow(_functions(sep), "file string, block long, outside boolean, inside boolean").collect())


def _records(ranges: Broadcast, sep: str):
    """(file, block, place, kind, value): kind 0: a whole record, 1: one that its range leaves open, 2: what goes on from
    the range before."""
    names, types = ["file", "block", "place", "kind", "value"], (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, place, inside, begun, parts = None, 0, False, 0, []

        def told() -> list[tuple]:
            """The record that is open when its range ends."""
            return [(*at, begun, 2 if begun < 0 else 1, "\n".join(parts))] if at is not None and parts else []

        for file, block, b in _runs(batches):
            rows = []
            if at != (file, block):
                rows += told()
                at, place, inside, parts = (file, block), 0, ranges.value.opens(file, block), []
                begun = -1 if inside else 0
            values = b.column(2)
            if not inside and not pc.any(pc.match_substring(values, '"')).as_py():  # each line is a record
                n = b.num_rows
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(range(place, place + n), pa.int64()), pa.array([0] * n, pa.int32()), values.cast(pa.string())], names)
                place += n
                continue
            for line in values.to_pylist():
                if not parts and not inside:
                    begun = place
                parts.append(line)
                place += 1
                inside = ends_inside(line, inside, sep) if '"' in line else inside
                if not inside:
                    rows.append((*at, begun, 2 if begun < 0 else 0, "\n".join(parts)))
                    parts = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)
        if rows := told():
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return step


def _joined(pieces: DataFrame) -> DataFrame:
    """Records from the pieces that ranges left of them: one that is left open, and all that goes on from it."""
    order = Window.partitionBy("file").orderBy("block", F.desc("kind"))  # two rows a range at most
    own = pieces.withColumn("record", F.count_if(F.col("kind") == 1).over(order)).groupBy("file", "record")
    every = F.array_sort(F.collect_list(F.struct("block", "value")))
    return own.agg(F.min("block").alias("block"), F.max("place").alias("place"), F.array_join(every["value"], "\n").alias("value")).select("file", "block", "place", "value")


def records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(file, block, place, value): the records of all files, line breaks in quoted cells and all, in the order of file, block
    and place. A record is held whole by a task; a quote that is never closed makes the rest of its file one record."""
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    ranges = Ranges.of(lines, sep)
    made = lines.mapInArrow(_records(spark.sparkContext.broadcast(ranges), sep), "file string, block long, place long, kind int, value string")
    out = made.filter("kind = 0").select("file", "block", "place", "value")
    if ranges.changes:
        out = out.unionByName(_joined(made.filter("kind > 0")))
    return out.withColumn("value", F.regexp_replace("value", "\r\\z", ""))
