"""Many parts as one file, without one task that holds all rows.

Spark writes the parts beside the file, so that a task that fails or runs twice leaves nothing of its own. Their sizes tell
where each belongs. Where tasks can write to a place of a file, they copy pieces of parts to their offsets; a piece that is
copied twice is the same. Elsewhere the parts are joined by the store if it can, or else pass through the driver, some
bytes at a time. The file gets its name last: whoever looks sees all of it or nothing.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from limpid.storage import new_name

#: Bytes that a task copies at once.
PIECE = 1 << 26
#: Stores whose files tasks can write to at any place.
AT_OFFSETS = ("file",)


def _copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for source, target, begin, to, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
            with open(source, "rb") as f, open(target, "r+b") as g:
                f.seek(begin)
                g.seek(to)
                while size:
                    data = f.read(min(size, 1 << 20))
                    g.write(data)
                    size -= len(data)
        yield b.slice(0, 0)


def _at_offsets(spark: SparkSession, parts: list[tuple[str, int]], target: str, head: bytes) -> None:
    local = lambda p: unquote(urlparse(p).path)
    with open(local(target), "xb") as f:
        f.write(head)
        f.truncate(len(head) + sum(n for _, n in parts))
    rows, at = [], len(head)
    for path, size in parts:
        rows += [(local(path), local(target), k, at + k, min(PIECE, size - k)) for k in range(0, size, PIECE)]
        at += size
    if rows:
        schema = "source string, target string, begin long, place long, size long"
        spark.createDataFrame(rows, schema).repartition(len(rows)).mapInArrow(_copy, schema).write.format("noop").mode("overwrite").save()
    if os.path.getsize(local(target)) != at:
        raise OSError(f"{target} isn't as long as its parts")


def _appended(spark: SparkSession, fs, parts: list[tuple[str, int]], target: str, head: bytes) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    out = fs.create(path(target), False)
    try:
        out.write(bytearray(head))
        if fs.getScheme() != "hdfs":
            for p, _ in parts:
                source = fs.open(path(p))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
                finally:
                    source.close()
    finally:
        out.close()
    if fs.getScheme() == "hdfs" and parts:  # a matter of names there
        own = spark.sparkContext._gateway.new_array(path, len(parts))
        for k, (p, _) in enumerate(parts):
            own[k] = path(p)
        fs.concat(path(target), own)


def write_one_file(df: DataFrame, path: str, head: str, overwrite: bool, **options: str) -> None:
    """df's rows as one CSV file at `path`, after `head`; in the order of its partitions. Refuses a path that is there unless
    told to overwrite, which takes place when all is written."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    goal = jvm.org.apache.hadoop.fs.Path(path)
    fs = goal.getFileSystem(conf)
    goal = fs.makeQualified(goal)
    if fs.exists(goal) and not overwrite:
        raise FileExistsError(f"{path} is there already")
    staged = jvm.org.apache.hadoop.fs.Path(goal.getParent(), f".{new_name('limpid')}")
    try:
        df.write.csv(staged.toString(), header=False, **options)
        found = sorted((f.getPath().toString(), f.getLen()) for f in fs.listStatus(staged) if f.getPath().getName().startswith("part-"))
        parts, target = [(p, n) for p, n in found if n], f"{staged.toString()}/joined"
        if fs.getScheme() in AT_OFFSETS:
            _at_offsets(spark, parts, target, head.encode())
        else:
            _appended(spark, fs, parts, target, head.encode())
        for old in (goal,) if overwrite and fs.exists(goal) else ():
            fs.delete(old, True)
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(target), goal):
            raise OSError(f"{path} can't be given its name")
    finally:
        fs.delete(staged, True)
        mark = jvm.org.apache.hadoop.fs.Path(goal.getParent(), f".{goal.getName()}.crc")
        if fs.getScheme() == "file" and fs.exists(mark):  # of an earlier file of that name
            fs.delete(mark, False)
