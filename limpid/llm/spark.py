"""Small helpers around the session: written tables and safe internal column names."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limpid.storage import discard, new_name, placed, scratch, shared_dir
from limpid.storage import written as materialise

__all__ = ["bucketed", "discard", "exact", "free_name", "id_key", "materialise", "ordered_buckets", "partitions_for", "scratch", "shared_dir", "shuffle_partitions"]

#: Stands for a null id in keys, so that rows without an id can be grouped and joined.
NO_ID = -(2**63)


def bucketed(df: DataFrame, name: str, buckets: int, key: str) -> DataFrame:
    """Like materialise(), in buckets by the hash of a key and sorted by it: joins and groupings by that key of tables
    with as many buckets need no exchange. df should be dealt by the key, so that a bucket is one sorted file."""
    spark = df.sparkSession
    table = f"limpid_{new_name(name)}".replace("-", "_")
    path = f"{shared_dir(spark)}/{table}"
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table, format="parquet")
    return placed(spark.table(table), path, table)


@contextmanager
def ordered_buckets(spark: SparkSession) -> Iterator[None]:
    """Plans made within it trust that buckets of one file each are sorted as they were written, and sort them no more."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def id_key(col: str | Column) -> Column:
    """A never-null long for an id column, which holds whole numbers."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("long"), F.lit(NO_ID))


def exact(name: str) -> Column:
    """A column by its name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions_for(rows: int, per_task: int) -> int:
    return max(1, -(-rows // per_task))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
