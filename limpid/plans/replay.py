"""Histories that are edited again and again, without working out again what an edit leaves alone.

What a step makes is written to the shared folder under a hash of the source and of all steps up to it that are on. So a
step that is added or edited reads what the step before it made; undoing, redoing, and turning a step off and on again
find what is there. The size of all that is kept has a bound; what was used longest ago goes first.
"""

from __future__ import annotations

import json
import uuid
from collections import OrderedDict
from dataclasses import dataclass, replace
from hashlib import sha256

from pyspark.sql import functions as F

from limpid.operators import REGISTRY, Context
from limpid.plans.pipeline import Pipeline, Step, observed, report_of
from limpid.storage import delete, new_name, noted, shared_dir
from limpid.table import Table


@dataclass
class Kept:
    """What a step made: its table, the tables that steps extracted so far, its report, and where its files lie."""

    table: Table
    tables: dict[str, Table]
    rows: int
    report: dict
    paths: tuple[str, ...] = ()
    size: int = 0


class Replay:
    """States of a pipeline over one source and the other tables of its steps.

    most_bytes: files kept at most, but for those of the state that was asked for last; tables of states that had to go
    can't be read any more. close() deletes all.
    """

    def __init__(self, source: Table, tables: dict[str, Table] | None = None, most_bytes: int = 10 << 30):
        self.source, self.tables, self.most_bytes = source, dict(tables or {}), most_bytes
        self.spark = source.df.sparkSession
        self.folder = f"{shared_dir(self.spark)}/{new_name('replay')}"
        noted(self.folder)
        self.kept: OrderedDict[str, Kept] = OrderedDict()
        self.first: Kept | None = None

    def __enter__(self) -> Replay:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.kept.clear()
        delete(self.spark, self.folder)

    def _written(self, t: Table) -> tuple[Table, str, int]:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        t.df.write.parquet(path)
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        size = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
        return replace(t, df=self.spark.read.schema(t.df.schema).parquet(path)), path, size

    def _made(self, before: Kept, step: Step) -> Kept:
        """A step's result, written, with its counters from the same job."""
        context = Context(dict(before.tables), observe=True)
        new = REGISTRY[step.type](before.table, step.params, context)
        new = replace(new, df=context.count(new.df, rowsOut=F.count("*")))
        table, path, size = self._written(new)
        told = observed(context.told())
        tables, paths = dict(before.tables), [path]
        for name, t in context.tables.items():
            if before.tables.get(name) is not t:  # extracted by this step
                tables[name], more, n = self._written(t)
                paths.append(more)
                size += n
        rows = told.pop("rowsOut")
        return Kept(table, tables, rows, report_of(step, before.rows, rows, told), tuple(paths), size)

    def _walk(self, pipeline: Pipeline) -> list[tuple[Step, Kept]]:
        """Each step up to the cursor with what it made; a step that is off made what the one before it did."""
        if self.first is None:
            self.first = Kept(self.source, self.tables, self.source.df.count(), {})
        now, done, out, used = self.first, [], [], []
        for s in pipeline.steps[: pipeline.cursor]:
            if s.enabled:
                done.append([s.type, s.params])
                key = sha256(json.dumps(done, sort_keys=True, default=str).encode()).hexdigest()
                if key not in self.kept:
                    self.kept[key] = self._made(now, s)
                self.kept.move_to_end(key)
                used.append(key)
                now = self.kept[key]
            out.append((s, now))
        self._drop(set(used[-1:]))
        return out

    def _drop(self, needed: set[str]) -> None:
        total = sum(k.size for k in self.kept.values())
        for key in [k for k in self.kept if k not in needed]:
            if total <= self.most_bytes:
                break
            old = self.kept.pop(key)
            total -= old.size
            for path in old.paths:
                delete(self.spark, path)

    def table(self, pipeline: Pipeline) -> Table:
        """The state at the cursor. Runs the steps whose results aren't there, from the last one that is."""
        states = self._walk(pipeline)
        return states[-1][1].table if states else self.source

    def states(self, pipeline: Pipeline) -> list[Table]:
        """The table after each step up to the cursor."""
        return [k.table for _, k in self._walk(pipeline)]

    def reports(self, pipeline: Pipeline) -> list[dict]:
        """Counters of each step that is on, as Pipeline.reports() tells them."""
        return [{**k.report, "step": s.id} for s, k in self._walk(pipeline) if s.enabled]
