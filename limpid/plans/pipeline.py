"""Pipelines: an ordered history of steps that folds to one lazy plan."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import functions as F

from limpid.operators import REGISTRY, Context
from limpid.operators.registry import find
from limpid.storage import written
from limpid.table import Table

#: Seconds in which counters come in once a job is done.
WAIT = 60


#: The names of counters and of operators in a pipeline's report.
TOLD = {"rowsRemoved": "supprimées", "rowsAdded": "ajoutées", "rowsModified": "modifiées", "unmatched": "non appariées", "ambiguous": "ambiguës"}
LABELS = {
    "rename_columns": "Renommer des colonnes",
    "reorder_columns": "Réordonner des colonnes",
    "drop_columns": "Supprimer des colonnes",
    "hide_columns": "Masquer des colonnes",
    "duplicate_column": "Dupliquer une colonne",
    "add_constant_column": "Ajouter une colonne constante",
    "add_concat_column": "Ajouter une colonne concaténée",
    "add_extract_column": "Ajouter une colonne extraite",
    "add_sequence_column": "Ajouter une colonne séquence",
    "add_expression_column": "Ajouter une colonne (expression)",
    "normalize_columns": "Normaliser des colonnes",
    "filter_rows": "Filtrer des lignes",
    "deduplicate": "Dédoublonner",
    "enrich_join": "Rapprocher / enrichir",
    "append_rows": "Ajouter des lignes depuis un fichier",
    "summarize": "Résumer (regrouper / agréger)",
}


@dataclass(frozen=True)
class Step:
    type: str
    params: dict
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    enabled: bool = True
    label: str = ""


@dataclass(frozen=True)
class Pipeline:
    """Steps and a cursor; steps behind the cursor are undone."""

    steps: tuple[Step, ...] = ()
    cursor: int = 0

    def add(self, type: str, /, **params) -> Pipeline:
        find(type)
        kept = self.steps[: self.cursor]
        return Pipeline((*kept, Step(type, params)), len(kept) + 1)

    def _edit(self, step_id: str, **new) -> Pipeline:
        return replace(self, steps=tuple(replace(s, **new) if s.id == step_id else s for s in self.steps))

    def update(self, step_id: str, params: dict) -> Pipeline:
        return self._edit(step_id, params=params)

    def enable(self, step_id: str, on: bool) -> Pipeline:
        return self._edit(step_id, enabled=on)

    def remove(self, step_id: str) -> Pipeline:
        before = sum(s.id == step_id for s in self.steps[: self.cursor])
        return Pipeline(tuple(s for s in self.steps if s.id != step_id), self.cursor - before)

    def move(self, cursor: int) -> Pipeline:
        return replace(self, cursor=max(0, min(len(self.steps), cursor)))

    def undo(self) -> Pipeline:
        return self.move(self.cursor - 1)

    def redo(self) -> Pipeline:
        return self.move(self.cursor + 1)

    @property
    def can_undo(self) -> bool:
        return self.cursor > 0

    @property
    def can_redo(self) -> bool:
        return self.cursor < len(self.steps)

    def active(self) -> list[Step]:
        return [s for s in self.steps[: self.cursor] if s.enabled]

    def states(self, source: Table, tables: dict[str, Table] | None = None) -> list[tuple[Step, Table, Table, dict]]:
        """For each step up to the cursor: itself, the table before, the table after and its counters, all lazy. A step that
        is off leaves the table as it is and counts nothing."""
        return self._folded(source, Context(dict(tables or {})))

    def _folded(self, t: Table, context: Context) -> list[tuple[Step, Table, Table, dict]]:
        out = []
        for s in self.steps[: self.cursor]:
            new = REGISTRY[s.type](t, s.params, context) if s.enabled else t
            if context.observe and s.enabled:
                new = replace(new, df=context.count(new.df, rowsOut=F.count("*")))
            out.append((s, t, new, context.told()))
            t = new
        return out

    def run(self, source: Table, tables: dict[str, Table] | None = None) -> tuple[Table, list[dict]]:
        """The last table, written, and the counters of each active step, which the same job tells as it writes. A stage that
        has to run again, after executors were lost, may be counted twice; reports() is not."""
        context = Context(dict(tables or {}), observe=True)
        first = replace(source, df=context.count(source.df, rowsOut=F.count("*")))
        seen = [context.told()]
        states = self._folded(first, context)
        seen += [counters for s, *_, counters in states if s.enabled]
        last = states[-1][2] if states else first
        out = replace(last, df=written(last.df, "result"))
        told = [observed(counters) for counters in seen]
        rows = [x.pop("rowsOut") for x in told]
        return out, [report_of(s, a, b, own) for s, a, b, own in zip(self.active(), rows[:-1], rows[1:], told[1:], strict=True)]

    def apply(self, source: Table, tables: dict[str, Table] | None = None) -> Table:
        states = self.states(source, tables)
        return states[-1][2] if states else source

    def reports(self, source: Table, tables: dict[str, Table] | None = None) -> list[dict]:
        """Counters of each active step; runs a small aggregate for each."""
        out, rows = [], source.df.count()
        for s, _, after, counters in self.states(source, tables):
            if s.enabled:
                before, rows = rows, after.df.count()
                out.append(report_of(s, before, rows, {k: sum(df.agg(F.coalesce(c, F.lit(0)).alias("x")).first().x for df, c in own) for k, own in counters.items()}))
        return out

    def report_text(self, source: Table, tables: dict[str, Table] | None = None, at: datetime | None = None) -> str:
        """What each step did, as a text to file with the data; steps that are off or undone weren't run."""
        ran = {r["step"]: r for r in self.run(source, tables)[1]}
        lines = [f"Rapport du pipeline — {source.name}", f"Généré le {(at or datetime.now()).strftime('%d/%m/%Y %H:%M:%S')}", ""]
        lines.append(f"Étape 0 — Source : {source.df.count()} lignes, {len(source.columns)} colonnes")
        for i, s in enumerate(self.steps, 1):
            lines += ["", f"Étape {i} — {s.label or LABELS.get(s.type, s.type)}{'' if s.enabled else ' (désactivée)'}"]
            if s.id not in ran:
                lines.append("  (non exécutée)")
                continue
            r = ran[s.id]
            lines += [f"  lignes en entrée : {r['rowsIn']}", f"  lignes en sortie : {r['rowsOut']}"]
            lines += [f"  {name} : {r[k]}" for k, name in TOLD.items() if r.get(k) or (k in r and k in ("unmatched", "ambiguous"))]
        return "\n".join(lines)


def observed(counters: dict[str, list]) -> dict[str, int]:
    """The counters of a Context that observes, once a job has told them."""
    with ThreadPoolExecutor(1) as pool:
        get = lambda o: pool.submit(lambda: o.get).result(WAIT)
        return {n: sum(get(o)[k] for o, k in own) for n, own in counters.items()}


def report_of(s: Step, rows_in: int, rows_out: int, counters: dict) -> dict:
    counted = {"rowsIn": rows_in, "rowsOut": rows_out, "rowsRemoved": max(0, rows_in - rows_out), "rowsAdded": max(0, rows_out - rows_in)}
    return {"step": s.id, "type": s.type, **counted, **counters}
