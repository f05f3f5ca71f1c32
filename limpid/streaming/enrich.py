"""Enriching joins of streams: a stream's rows against the aggregated partners of a table, which are kept by version.

Partners are published as whole versions, numbered folders that never change. A micro-batch takes the newest version when
it first runs and writes that down under its own number before it reads; when it runs again, after a failure, it reads the
same version and puts its rows in the place of those it wrote before. So all rows of a batch see one version, and a
replay gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from limpid.operators.join import join_partners, partners_of
from limpid.operators.registry import Context
from limpid.table import Table


class Partners:
    """The versions of a join's partners under one folder, which driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, join: dict):
        """join: the params of an exact enrich_join but `table`, which name the keys, copied columns and rules."""
        if join.get("fuzzy"):
            raise ValueError("a stream's rows are joined by equal keys only")
        self.spark, self.path, self.join = spark, path.rstrip("/"), join
        self._root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self._files = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        """Those that are complete, the oldest first."""
        found = self._files.listStatus(self._root) if self._files.exists(self._root) else []
        names = [s.getPath().getName() for s in found]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and self._files.exists(self._at(f"{n}/_SUCCESS")))

    def publish(self, right: Table) -> int:
        """Writes the partners that a table gives as the next version; it counts once it is complete. One writer at a time."""
        version = max(self.versions(), default=0) + 1
        partners_of(right, self.join).write.mode("overwrite").parquet(f"{self.path}/v{version}")
        return version

    def pinned(self, query: str, batch: int) -> int:
        """The version of a batch: the newest when it is first asked for, the same ever after."""
        pin = self._at(f"pins/{query}/{batch}")
        if not self._files.exists(pin):
            if not (known := self.versions()):
                raise LookupError(f"no version of the partners in {self.path}")
            # Complete under a name of its own first, so that a pin that is there can be read.
            draft = self._at(f"pins/{query}/.{batch}")
            out = self._files.create(draft, True)
            out.writeInt(known[-1])
            out.close()
            try:
                self._files.rename(draft, pin)
            except Py4JJavaError:  # another attempt of this batch was first
                if not self._files.exists(pin):
                    raise
        into = self._files.open(pin)
        try:
            return into.readInt()
        finally:
            into.close()

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{version}")

    def forget(self, keep: Iterable[int]) -> None:
        """Deletes versions but these and the newest. Keep those of batches that may run again."""
        known = self.versions()
        for v in {*known[:-1]} - {*keep}:
            self._files.delete(self._at(f"v{v}"), True)


def enrich_stream(stream: DataFrame, partners: Partners, out: str, checkpoint: str, name: str, available_now: bool = True) -> StreamingQuery:
    """Starts a query that writes the stream's rows with their partners' cells below `out`, a folder `batch=<n>` for each
    micro-batch; see results(). As the operator does, a left join keeps rows without a partner, whose copied cells are
    empty. name tells the query from others over the same partners and stays the same when it starts again."""

    if taken := {"batch", "partners_version"} & {*stream.columns, *partners.join["copied"]}:
        raise ValueError(f"{min(taken)} is a name of the result's own")

    def each(df: DataFrame, batch: int) -> None:
        version = partners.pinned(name, batch)
        t = join_partners(Table.of(df), partners.join, partners.read(version), Context())
        t.output().withColumn("partners_version", F.lit(version)).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def results(spark: SparkSession, out: str) -> DataFrame:
    """All rows that a query has written, with the number of their batch and the version of the partners it saw."""
    return spark.read.parquet(out)
