"""Declarative reports: text, KPI, chart, table and page-break blocks over a table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from limpid.operators.registry import Context
from limpid.operators.rows import filter_rows
from limpid.operators.summarize import summarize, summarize_many
from limpid.plans.pipeline import Pipeline
from limpid.table import Table, q

BLOCKS = ("text", "kpi_row", "chart", "table", "page_break")
CHARTS = ("bar", "bar_stacked", "line", "pie", "donut", "histogram")
FNS = ("count", "countDistinct", "countNonEmpty", "first", "concat", "sum", "avg", "min", "max", "median")
FILTERS = ("eq", "neq", "contains", "starts_with", "regex", "is_empty", "is_not_empty", "in_list", "between")


#: How other files of this kind name what is named otherwise here: fixed names of the format.
OTHER_NAMES = {"formatVersion": "version", "type": "kind", "content": "text", "agg": "aggregate", "chartType": "chart", "groupBy": "group_by", "asName": "name", "maxRows": "max_rows", "columnId": "column"}


def loaded(spec):
    """A spec with the names used here, from one with the format's own (`formatVersion`, `type`, ..), of whatever shape it
    is. Conditions name how they combine by `operator` there; a series may have a label."""
    if isinstance(spec, list):
        return [loaded(x) for x in spec]
    if not isinstance(spec, dict):
        return spec
    out = {OTHER_NAMES.get(k, k): loaded(v) for k, v in spec.items()}
    if "conditions" in out and "combinator" not in out:
        out = {("combinator" if k == "operator" else k): v for k, v in out.items() if k != "kind"}
    elif "column" in out and out.get("kind") == "condition":
        del out["kind"]
    if isinstance(series := out.get("series"), list) and any(isinstance(x, dict) for x in series):
        named = [x for x in series if isinstance(x, dict)]
        out["series"] = [x.get("column") if isinstance(x, dict) else x for x in series]
        out["labels"] = {x["column"]: x["label"] for x in named if isinstance(x.get("column"), str) and "label" in x}
    return out


class Checked:
    """Errors found so far, each with its path, and the columns that a spec may name."""

    def __init__(self, columns: list[str] | None):
        self.errors: list[str] = []
        self.columns = columns

    def need(self, good: bool, at: str, what: str) -> bool:
        if not good:
            self.errors.append(f"{at}: {what}")
        return good

    def object(self, x, at: str) -> bool:
        return self.need(isinstance(x, dict), at, "an object is needed")

    def list(self, x, at: str) -> list:
        return x if self.need(isinstance(x, list), at, "a list is needed") else []

    def one_of(self, x, known: tuple, at: str) -> bool:
        return self.need(isinstance(x, str) and x in known, at, "unknown")

    def column(self, x, at: str) -> None:
        if self.need(isinstance(x, str), at, "a name is needed") and self.columns is not None:
            self.need(x in self.columns, at, f"{x!r} is no expected column")

    def aggregate(self, a, at: str) -> None:
        if self.object(a, at) and self.one_of(a.get("fn"), FNS, f"{at}.fn") and a["fn"] != "count":
            self.column(a.get("column"), f"{at}.column")

    def summary(self, s, at: str) -> None:
        if not self.object(s, at):
            return
        for i, g in enumerate(self.list(s.get("group_by") or [], f"{at}.group_by")):
            if self.object(g, f"{at}.group_by[{i}]"):
                self.column(g.get("column"), f"{at}.group_by[{i}].column")
                if g.get("binning") is not None:
                    self.binning(g["binning"], f"{at}.group_by[{i}].binning")
        own = self.list(s.get("aggregates") or [], f"{at}.aggregates")
        self.need(bool(own), f"{at}.aggregates", "one is needed at least")
        for i, a in enumerate(own):
            self.aggregate(a, f"{at}.aggregates[{i}]")

    def binning(self, b, at: str) -> None:
        number = lambda x: isinstance(x, int | float) and not isinstance(x, bool)
        if not self.object(b, at) or not self.one_of(b.get("kind"), ("explicit_boundaries", "fixed_width", "fixed_count"), f"{at}.kind"):
            return
        if b["kind"] == "fixed_width":
            self.need(number(b.get("width")) and b["width"] > 0, f"{at}.width", "a positive number is needed")
        elif b["kind"] == "fixed_count":
            self.need(number(b.get("count")) and b["count"] > 0, f"{at}.count", "a positive number is needed")
        else:
            edges = self.list(b.get("boundaries"), f"{at}.boundaries")
            self.need(len(edges) > 1 and all(map(number, edges)), f"{at}.boundaries", "two numbers are needed at least")

    def filter(self, f, at: str) -> None:
        if not self.object(f, at):
            return
        if "conditions" in f:
            if "combinator" in f:
                self.one_of(f["combinator"], ("and", "or"), f"{at}.combinator")
            for i, c in enumerate(self.list(f["conditions"], f"{at}.conditions")):
                self.filter(c, f"{at}.conditions[{i}]")
        elif self.one_of(f.get("operator"), FILTERS, f"{at}.operator"):
            self.column(f.get("column"), f"{at}.column")

    def block(self, b, at: str) -> None:
        if not self.object(b, at) or not self.one_of(b.get("kind"), BLOCKS, f"{at}.kind"):
            return
        match b["kind"]:
            case "text":
                self.need(isinstance(b.get("text"), str), f"{at}.text", "a text is needed")
            case "kpi_row":
                items = self.list(b.get("items"), f"{at}.items")
                self.need(bool(items), f"{at}.items", "one is needed at least")
                for i, item in enumerate(items):
                    if self.object(item, f"{at}.items[{i}]"):
                        self.aggregate(item.get("aggregate"), f"{at}.items[{i}].aggregate")
                        self.need(item.get("format", "number") in ("number", "percent"), f"{at}.items[{i}].format", "number or percent is needed")
            case "chart":
                self.one_of(b.get("chart"), CHARTS, f"{at}.chart")
                self.summary(b.get("summarize"), f"{at}.summarize")
                own = b.get("summarize") if isinstance(b.get("summarize"), dict) else {}
                names = lambda k, n: [x.get(n) for x in own.get(k) or [] if isinstance(x, dict)] if isinstance(own.get(k), list) else []
                self.need(b.get("x") in names("group_by", "column"), f"{at}.x", "not a group")
                for j, x in enumerate(self.list(b.get("series") or [], f"{at}.series")):
                    self.need(x in names("aggregates", "name"), f"{at}.series[{j}]", "not an aggregate")
            case "table":
                for i, c in enumerate(self.list(b.get("columns") or [], f"{at}.columns")):
                    self.column(c, f"{at}.columns[{i}]")
                if b.get("filter") is not None:
                    self.filter(b["filter"], f"{at}.filter")
                most = b.get("max_rows")
                self.need(most is None or isinstance(most, int) and most >= 0, f"{at}.max_rows", "a whole number is needed")


def validate(spec) -> list[str]:
    """All that is wrong with a report's spec, each with its path; never raises."""
    if not isinstance(spec, dict):
        return ["$: an object is needed"]
    spec = loaded(spec)
    expected = spec.get("expectedColumns")
    named = expected if isinstance(expected, list) and all(isinstance(c, str) for c in expected) else None
    c = Checked(named)
    c.need(isinstance(spec.get("title"), str), "$.title", "a text is needed")
    c.need(spec.get("version") == 1, "$.version", "1 is needed")
    c.need(spec.get("kind", "report") == "report", "$.kind", "report is needed")
    c.need(isinstance(spec.get("subtitle", ""), str), "$.subtitle", "a text is needed")
    c.need(expected is None or named is not None, "$.expectedColumns", "a list of names is needed")
    for i, b in enumerate(c.list(spec.get("blocks"), "$.blocks")):
        c.block(b, f"$.blocks[{i}]")
    return c.errors


def kpis(t: Table, items: list[dict]) -> DataFrame:
    """One row with the value of each item's aggregate, in one pass."""
    own = [{**x["aggregate"], "name": x.get("label") or f"kpi{i}"} for i, x in enumerate(items)]
    return summarize(t, {"aggregates": own}, Context()).output()


def chart(t: Table, block: dict) -> DataFrame:
    """Categories and series of a chart, in order."""
    return summarize(t, block["summarize"], Context()).ordered().select(block["x"], *block["series"])


def table_block(t: Table, block: dict) -> Table:
    """The rows and columns that a table block shows, before its limit."""
    own = filter_rows(t, {"where": block["filter"]}, Context()) if block.get("filter") else t
    own.need(*(block.get("columns") or ()))
    return own.select({c: c for c in block.get("columns") or t.columns})


#: Rows of a table block that come to the driver; what shows more is a frame.
COLLECTED = 100_000


def compute(spec: dict, t: Table) -> list[dict]:
    """Each block with its values. One scan of the table gives all numbers, charts and totals; each table block then reads
    its rows. A table block shows all rows but for its max_rows; if these are over COLLECTED, they are a `frame`, in
    their order, in place of `rows`."""
    if errors := validate(spec):
        raise ValueError("; ".join(errors))
    blocks = loaded(spec)["blocks"]
    single, charts = [], {}  # aggregates over all rows; summaries by block
    for i, b in enumerate(blocks):
        if b["kind"] == "kpi_row":
            single += [{**x["aggregate"], "name": f"{i}.{j}"} for j, x in enumerate(b["items"])]
        elif b["kind"] == "table":
            single.append({"fn": "count", "where": b.get("filter"), "name": f"{i}"})
        elif b["kind"] == "chart":
            charts[i] = {**b["summarize"], "group_by": [{**g, "normalization": g.get("normalization") or "none"} for g in b["summarize"]["group_by"]]}
    summaries = [*([{"aggregates": single}] if single else []), *charts.values()]
    made = iter(summarize_many(t, summaries) if summaries else [])
    first = next(made).output().first() if single else None
    value = lambda name: first[name] if first else ""
    own = dict(zip(charts, made, strict=True))
    return [_block(t, b, lambda j, i=i: value(f"{i}.{j}" if j is not None else f"{i}"), own.get(i)) for i, b in enumerate(blocks)]


def _block(t: Table, b: dict, value, made: Table | None) -> dict:
    match b["kind"]:
        case "kpi_row":
            return {"kind": "kpi_row", "items": [{"label": x.get("label", ""), "format": x.get("format", "number"), "value": value(j)} for j, x in enumerate(b["items"])]}
        case "chart":
            rows = made.ordered().select(q(b["x"]), *map(q, b["series"])).collect()
            about = {k: b[k] for k in ("title", "orientation", "caption", "labels") if k in b}
            return {"kind": "chart", "chart": b["chart"], "categories": [r[0] for r in rows], "series": {s: [r[1 + j] for r in rows] for j, s in enumerate(b["series"])}, **about}
        case "table":
            own, total = table_block(t, b), int(value(None) or 0)
            n = total if b.get("max_rows") is None else min(total, b["max_rows"])
            out = {"kind": "table", "columns": list(own.columns), "totalMatching": total, "truncated": total > n}
            frame = own.ordered() if n == total else own.ordered().limit(n)
            return {**out, "frame": frame} if n > COLLECTED else {**out, "rows": [list(r) for r in frame.collect()]}
    return dict(b)


def fingerprint(text: str) -> str:
    """Eight hex digits of a text, to trace a pipeline by."""
    h = 5381
    for c in text:
        h = (h * 33 ^ ord(c)) & 0xFFFFFFFF
    return f"{h:08x}"


def traceability(pipeline: Pipeline, source: Table, tables: dict[str, Table] | None = None, recipe: str | None = None) -> dict:
    """Where a report's numbers come from: the files with their rows, the steps with theirs, what joins matched in all,
    and a fingerprint of the pipeline, which runs once."""
    reports = {r["step"]: r for r in pipeline.run(source, tables)[1]}
    steps = []
    for i, s in enumerate(pipeline.steps[: pipeline.cursor]):
        r = reports.get(s.id, {})
        steps.append({"index": i, "label": s.label or s.type, "enabled": s.enabled, "rowsIn": r.get("rowsIn", 0), "rowsOut": r.get("rowsOut", 0)} | {k: r[k] for k in ("unmatched", "ambiguous") if k in r})
    total = lambda k: sum(r.get(k, 0) for r in reports.values())
    every = [source, *(tables or {}).values()]
    return {
        "sourceFiles": [{"name": t.name, "rowCount": t.df.count()} for t in every],
        "recipe": recipe,
        "steps": steps,
        "totalAutoMatched": total("matchedAuto"),
        "totalManualMatched": total("matchedManual"),
        "totalUnmatched": total("unmatched"),
        "fingerprint": fingerprint("|".join(f"{s.type}:{json.dumps(s.params, ensure_ascii=False, separators=(',', ':'))}" for s in pipeline.steps[: pipeline.cursor])),
    }
