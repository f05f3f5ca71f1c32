"""Frames written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Where written frames lie: (path, table name or None).
_places: WeakKeyDictionary[DataFrame, tuple[str, str | None]] = WeakKeyDictionary()
#: The places written within each scratch() that is open in this thread, the innermost last.
_scopes: ContextVar[tuple[list[tuple[str, str | None]], ...]] = ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Local runs may leave it unset and get a
    temporary one; a cluster may not, as its machines can't see each other's folders."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="limpid-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_name(name: str) -> str:
    return f"{name}-{uuid.uuid4().hex}"


def placed(df: DataFrame, path: str, table: str | None = None) -> DataFrame:
    """Remembers where a written frame lies, for discard() and scratch()."""
    _places[df] = (path, table)
    noted(path, table)
    return df


def noted(path: str, table: str | None = None) -> None:
    """Has the scratch() that is open, if one is, delete a place at its end."""
    if open_ := _scopes.get():
        open_[-1].append((path, table))


def written(df: DataFrame, name: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """df, written once as Parquet and read again: a cut of the lineage that survives lost executors. Later steps see the
    same rows, and joins to it have an exchange of their own, so that Spark can split a very frequent key."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{new_name(name)}"
    df.write.partitionBy(*partition_by).parquet(path)
    return placed(spark.read.schema(df.schema).parquet(path), path)


def delete(spark: SparkSession, path: str, table: str | None = None) -> None:
    if table:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes the files of written frames that no later step reads."""
    for df in frames:
        if place := _places.pop(df, None):
            delete(spark, *place)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, all that operators wrote within it. Results must have been used or written by then."""
    own: list[tuple[str, str | None]] = []
    before = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(before)
        for place in own:
            delete(spark, *place)
