"""Operators by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from limpid.table import Table


@dataclass
class Context:
    """The other tables of a pipeline by id, and what operators tell about their step."""

    tables: dict[str, Table] = field(default_factory=dict)
    #: Counters of a step: name -> (frame, aggregate), or (observation, name in it); what a name has several of adds up.
    counters: dict[str, list] = field(default_factory=dict)
    #: Whether counters are observed by the job that makes the step's rows, or worked out on request by one of their own.
    observe: bool = False

    def count(self, df: DataFrame, **aggregates: Column) -> DataFrame:
        """df, to go on with, whose rows these counters are aggregates of."""
        if self.observe:
            seen = Observation(f"limpid-{uuid.uuid4().hex}")
            df = df.observe(seen, *[F.coalesce(a, F.lit(0)).cast("long").alias(n) for n, a in aggregates.items()])
        for n, a in aggregates.items():
            self.counters.setdefault(n, []).append((seen, n) if self.observe else (df, a))
        return df

    def told(self) -> dict[str, list]:
        """The counters since the last call."""
        out, self.counters = self.counters, {}
        return out

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise KeyError(f"no table {name!r}; tables: {', '.join(self.tables) or 'none'}")
        return self.tables[name]


REGISTRY: dict[str, Callable[[Table, dict, Context], Table]] = {}


def operator(name: str):
    def add(f):
        REGISTRY[name] = f
        return f

    return add


def find(name: str):
    if name not in REGISTRY:
        raise KeyError(f"unknown operator {name!r}")
    return REGISTRY[name]
