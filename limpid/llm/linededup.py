"""Line dedup with levelled sorted runs of line hashes.

Batches of documents arrive one after the other. A batch's line hashes are counted, which is its only exchange, and
written in buckets by hash, sorted. The batch is then merge-anti-joined with each run there is, the newest first: a key
that a run holds takes over what the run knows of it, in how many documents it was and which the largest is; what no
run holds is new. Both together are the batch's own run. When a level holds `fanout` runs they are compacted into one
of the next level. All runs have the same buckets, so merging them moves no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limpid.llm.arrow import add_columns, blobs, expand
from limpid.llm.spark import bucketed, discard, exact, free_name, id_key, materialise, ordered_buckets, shuffle_partitions
from limpid.llm.words import SPACES

LINES = T.StructType([T.StructField("doc", T.LongType()), T.StructField("row", T.LongType()), T.StructField("key", T.BinaryType())])
KEPT = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 128-bit hash of a line's key: white space at both ends off, A-Z lower-cased. None if the key is too short."""
    key = line.strip(SPACES).lower()  # of bytes: A-Z only
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, row, key) for each row and each different key of its lines; row is a hash of the row's text."""

    def keys(b: pa.RecordBatch) -> Iterator[dict]:
        out = {c: [] for c in LINES.names}
        for d, r, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), blobs(b.column(2)), strict=True):
            own = {line_key(x, min_chars) for x in (text or b"").split(b"\n")} - {None}
            out["doc"] += [d] * len(own)
            out["row"] += [r] * len(own)
            out["key"] += own
        yield out

    return expand(docs.select(id_key(id_col).alias("doc"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text")), LINES, keys)


class LineRuns:
    """Sorted runs (key, n_docs, last_doc) by level, the newest of a level last; level l+1 holds what `fanout` runs of
    level l became. A key's newest row tells its numbers over all batches so far."""

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout, self.buckets = spark, fanout, shuffle_partitions(spark)
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        """The newest first."""
        return [r for level in self.levels for r in reversed(level)]

    @staticmethod
    def unseen(own: DataFrame, run: DataFrame) -> DataFrame:
        """The merge-anti-join: rows whose key the run doesn't hold."""
        return own.join(run.select("key").hint("merge"), "key", "left_anti")

    @staticmethod
    def carried(own: DataFrame, run: DataFrame) -> DataFrame:
        """Rows whose key the run holds, with what it knows added."""
        old = run.select("key", F.col("n_docs").alias("had"), F.col("last_doc").alias("was")).hint("merge")
        return own.join(old, "key").select("key", (F.col("n_docs") + F.col("had")).alias("n_docs"), F.greatest("last_doc", "was").alias("last_doc"))

    def add(self, batch: DataFrame) -> None:
        """Adds a batch's (doc, key) rows, each pair once; a document's rows must all come in one batch."""
        own = bucketed(batch.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc").alias("last_doc")), "line-batch", self.buckets, "key")
        rest, parts = own, []
        for run in self.runs():
            parts.append(self.carried(rest, run))
            rest = self.unseen(rest, run)
        self._write(reduce(DataFrame.unionByName, parts, rest), 0)
        discard(self.spark, own)
        self._compact()

    def _write(self, rows: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        with ordered_buckets(self.spark):
            self.levels[level].append(bucketed(rows, f"line-run-{level}", self.buckets, "key"))

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                old, self.levels[level] = self.levels[level], []
                self._write(self._merged(old), level + 1)
                discard(self.spark, *old)
            level += 1

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """One row for each key. Numbers only grow from run to run, so the newest are the greatest."""
        rows = reduce(DataFrame.unionByName, runs)
        return rows if len(runs) == 1 else rows.groupBy("key").agg(F.max("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def totals(self) -> DataFrame:
        """One row for each key: in how many documents, and the largest of these."""
        return self._merged(self.runs())


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3) -> DataFrame:
    """docs with n_lines, n_dropped and kept: the text without lines that recur.

    A line whose key has at least min_chars characters and is found in at least min_docs documents goes, but for the
    document with the largest id that holds it, where all its lines stay. A null or empty text is one empty line and
    stays empty. Ids are whole numbers. Rows of the same id count as one document, and each gets its own result; a null
    id is one document, smaller than all others. Columns of the results' names are replaced, all others are kept.
    """
    spark = docs.sparkSession
    lines = line_hashes(docs, id_col, text_col, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int"))
    lines = materialise(lines, "lines", ["batch"])
    repeated = bool(docs.groupBy(id_key(id_col)).count().filter("count > 1").head(1))
    runs = LineRuns(spark, fanout)
    for k in range(batches):
        own = lines.filter(F.col("batch") == k).select("doc", "key")
        runs.add(own.distinct() if repeated else own)
    # Written, so that the join has an exchange of its own on both sides and Spark can split a key that very many lines have.
    gone = materialise(runs.totals().filter(F.col("n_docs") >= min_docs).select("key", "last_doc"), "recurring-lines")
    discard(spark, *runs.runs())
    per_row = lines.join(gone, "key").filter(F.col("doc") < F.col("last_doc")).groupBy("doc", "row").agg(F.collect_set("key").alias("gone"))
    doc, row, bad = (free_name(docs, c) for c in ("line_doc", "line_row", "line_gone"))
    base = docs.select(*[exact(c) for c in docs.columns if c not in KEPT.names], id_key(id_col).alias(doc), F.xxhash64(text_col).alias(row))
    joined = base.join(per_row.toDF(doc, row, bad).hint("shuffle_hash"), [doc, row], "left")

    def keep(b: pa.RecordBatch) -> list:
        total, dropped, kept = [], [], []
        for text, gone in zip(blobs(b.column(text_col)), b.column(bad).to_pylist(), strict=True):
            own, gone = (text or b"").split(b"\n"), set(gone or ())
            left = [x for x in own if line_key(x, min_chars) not in gone] if gone else own
            total.append(len(own))
            dropped.append(len(own) - len(left))
            kept.append(b"\n".join(left).decode())
        return [total, dropped, kept]

    return add_columns(joined, KEPT, keep).drop(doc, row, bad)
