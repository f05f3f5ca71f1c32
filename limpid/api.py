"""The entry points over files: profile, preview, apply, match, duplicates and report.

Each takes `root`, a folder that its paths are taken from and may not leave; without it paths are used as they are.
"""

from __future__ import annotations

import json
import posixpath
from dataclasses import replace
from functools import wraps

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from limpid.operators.dedup import find_duplicates as duplicate_groups
from limpid.operators.dedup import group_key
from limpid.operators.join import MATCHED, match_counts, never_given, resolved, unmatched
from limpid.plans.pipeline import Pipeline, Step
from limpid.plans.profile import anomaly_examples, bounded, profile, top_values
from limpid.plans.recipe import suggest
from limpid.plans.report import compute, loaded, validate
from limpid.sources import preview, read_csv, write_csv
from limpid.storage import scratch, written
from limpid.table import ORD, Table, q

def tidy(f):
    """Deletes what an entry point had operators write, once it has told its results."""

    @wraps(f)
    def run(spark: SparkSession, *args, **kwargs):
        with scratch(spark):
            return f(spark, *args, **kwargs)

    return run


TWO_TABLES = ("enrich_join", "append_rows")


class OutsideRoot(ValueError):
    """A path that leaves the folder it must stay in."""


def confined(path: str, root: str | None) -> str:
    """The path under root, with `.` and `..` resolved."""
    if root is None:
        return path
    scheme, _, folder = root.rpartition("://")
    folder = posixpath.normpath(folder)
    whole = posixpath.normpath(posixpath.join(folder, path.removeprefix(f"{scheme}://") if scheme else path))
    if ("://" in path and not (scheme and path.startswith(f"{scheme}://"))) or (whole != folder and not whole.startswith(folder.rstrip("/") + "/")):
        raise OutsideRoot(f"{path!r} leaves {root!r}")
    return f"{scheme}://{whole}" if scheme else whole


def _pipeline(steps: list[dict]) -> Pipeline:
    if two := [s["type"] for s in steps if s["type"] in TWO_TABLES]:
        raise ValueError(f"{two[0]} needs a second table and can't run here")
    own = tuple(Step(s["type"], s["params"], enabled=s.get("enabled", True)) for s in steps)
    return Pipeline(own, len(own))


@tidy
def profile_csv(spark: SparkSession, path: str, sample_rows: int = 30, root: str | None = None) -> dict:
    t = read_csv(spark, confined(path, root))
    top: dict[str, list] = {}
    for r in top_values(t).orderBy("column", "rank").collect():
        top.setdefault(r["column"], []).append((r["value"], r["n"]))
    odd: dict[str, dict] = {}
    for r in anomaly_examples(t).orderBy("column", "anomaly", "rank").collect():
        odd.setdefault(r["column"], {}).setdefault(r["anomaly"], []).append(r["value"])
    return {"columns": [{**r.asDict(), "top": top.get(r["column"], []), "examples": odd.get(r["column"], {})} for r in profile(t).collect()]} | bounded(t, sample_rows)


@tidy
def preview_csv(spark: SparkSession, path: str, delimiter: str | None = None, header_row: int = 0, rows: int = 5, root: str | None = None) -> dict:
    """What a file looks like before it is read as a table."""
    return preview(spark, confined(path, root), delimiter, header_row, rows)


@tidy
def preview_pipeline(spark: SparkSession, path: str, steps: list[dict], sample_rows: int = 30, root: str | None = None) -> dict:
    t, p = read_csv(spark, confined(path, root)), _pipeline(steps)
    out, steps = p.run(t)
    return {"steps": steps} | bounded(out, sample_rows)


@tidy
def apply_pipeline(spark: SparkSession, path: str, steps: list[dict], output: str, overwrite: bool = False, sample_rows: int = 30, root: str | None = None, single: bool = False) -> dict:
    """Runs a pipeline from file to file; its steps' counters come with the job that makes the rows. single: one file
    instead of a folder of parts."""
    t, p = read_csv(spark, confined(path, root)), _pipeline(steps)
    out, steps = p.run(t)
    write_csv(out, confined(output, root), ",", overwrite=overwrite, single=single)
    return {"steps": steps, "output": output} | bounded(out, sample_rows)


@tidy
def match_files(spark: SparkSession, left: str, right: str, pairs: list[dict], fuzzy: dict | None = None, sample_rows: int = 30, unmatched_output: dict[str, str] | None = None, overwrite: bool = False, root: str | None = None) -> dict:
    """How many left rows are matched, ambiguous or unmatched, and the unmatched rows of both sides; of a fuzzy match also
    the matches and the pending pairs with their scores. unmatched_output: a path for the unmatched rows of "left", of
    "right" or of both."""
    a, b = read_csv(spark, confined(left, root)), read_csv(spark, confined(right, root))
    pairs = [{"normalize": "text", **p} for p in pairs]
    out: dict = {"strategy": "exact" if fuzzy is None else "fuzzy"}
    if fuzzy is None:
        rest = {side: unmatched(a, b, pairs, side) for side in ("left", "right")}
        out |= match_counts(a, b, pairs).first().asDict()
    else:
        own = {"left": [p["left"] for p in pairs], "right": [p["right"] for p in pairs], **fuzzy}
        p = {"pairs": pairs, "fuzzy": own}
        found = written(resolved(a, b, p, b.columns), "resolved")  # all that follows reads it
        is_open = F.col("status").isin("rejected", "no_candidate")
        rest = {"left": replace(a, df=found.filter(is_open).select(*map(q, a.df.columns))), "right": never_given(b, found)}
        status = {r["status"]: r["count"] for r in found.groupBy("status").count().collect()}
        out |= {"status": status, "matched": sum(status.get(s, 0) for s in MATCHED), "ambiguous": status.get("pending", 0), "unmatched_left": sum(status.get(s, 0) for s in ("rejected", "no_candidate")), "unmatched_right": rest["right"].df.count()}

        def some(statuses: tuple[str, ...]) -> list[dict]:
            rows = found.filter(F.col("status").isin(*statuses)).orderBy(ORD).limit(max(0, min(sample_rows, 200)))
            cells = [F.struct(*map(q, a.columns)).alias("left"), F.struct(*[F.col(f"__v{i}").alias(c) for i, c in enumerate(b.columns)]).alias("right")]
            return [{"left": r.left.asDict(), "right": r.right.asDict(), "score": r.score, "status": r.status} for r in rows.select(*cells, "score", "status").collect()]

        out |= {"matches": some(MATCHED), "pending": some(("pending",))}
    out |= {f"unmatched_{side}_sample": bounded(t, sample_rows) for side, t in rest.items()}
    for side, path in (unmatched_output or {}).items():
        write_csv(rest[side], confined(path, root), ",", overwrite=overwrite)
    return out


class Groups(list):
    """The first groups, each with its key and number of rows; what all groups come to; and the first rows by key."""

    total_rows: int
    total_groups: int
    total_duplicate_rows: int
    truncated: bool
    rows: dict[str, list[dict]]


def _first_rows(t: Table, columns: list[str], mode: str, keys: list[str], most: int = 10) -> dict[str, list[dict]]:
    some = t.df.withColumn("__key", group_key(columns, mode)).filter(F.col("__key").isin(keys))
    some = some.withColumn("__n", F.row_number().over(Window.partitionBy("__key").orderBy(ORD))).filter(F.col("__n") <= most)
    out: dict[str, list[dict]] = {}
    for key, *cells in some.orderBy("__key", "__n").select("__key", *map(q, t.columns)).collect():
        out.setdefault(key, []).append(dict(zip(t.columns, cells, strict=True)))
    return out


@tidy
def find_duplicates(spark: SparkSession, path: str, columns: list[str], mode: str = "normalized", most: int = 200, root: str | None = None) -> Groups:
    t = read_csv(spark, confined(path, root))
    t.need(*columns)
    every = duplicate_groups(t, columns, mode)
    out = Groups(r.asDict() for r in every.limit(most).collect())
    total = every.agg(F.count("*").alias("n"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    out.total_rows, out.total_groups, out.total_duplicate_rows, out.truncated = t.df.count(), total["n"], total["rows"], total["n"] > len(out)
    out.rows = _first_rows(t, columns, mode, [g["key"] for g in out]) if out else {}
    return out


@tidy
def import_report(spark: SparkSession, text: str, path: str, root: str | None = None) -> dict:
    """A report's spec from JSON with, for a file, the mapping of expected columns to its own that names suggest; or all
    that is wrong with the spec."""
    try:
        spec = json.loads(text)
    except ValueError as e:
        return {"errors": [f"$: no JSON: {e}"]}
    if errors := validate(spec):
        return {"errors": errors}
    spec = loaded(spec)
    return {"errors": [], "spec": spec, "mapping": suggest(tuple(spec.get("expectedColumns", ())), read_csv(spark, confined(path, root)).columns)}


@tidy
def build_report(spark: SparkSession, path: str, spec: dict, mapping: dict[str, str] | None = None, root: str | None = None) -> list[dict]:
    t = read_csv(spark, confined(path, root))
    if mapping:
        t = t.select({next((k for k, v in mapping.items() if v == c), c): x for c, x in t.cells().items()})
    t.need(*spec.get("expectedColumns", []))
    return compute(spec, t)
