"""The filter audit against a count of every document in every order."""

from itertools import permutations

import pytest

from limpid.llm import audit
from limpid.llm.audit import Document, audit_filters
from limpid.llm.queries import AUDITED

NAMES = "ABCDE"
SCHEMA = "doc_id long, text string, lang string, part int"
LONG = " ".join(f"word{i}" for i in range(120))
TEXTS = [LONG, LONG + " #", LONG.upper(), "short", "", None, "x " * 200, LONG + " é & é", LONG + " \x0b" + LONG, "AB " * 40]


def judge(rows, labels):
    """One dict of failed letters, part and labels for each row."""
    out, strip = [], " \t\n\x0b\x0c\r"
    for d, t, lang, _ in rows:
        t = t or ""
        for c in strip:
            t = t.replace(c, " ")
        w = [x for x in t.split(" ") if x]
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t)}
        fails["E"] = d is not None and any(o is not None and o < d and (s or "") == (rows[k][1] or "") for k in [len(out)] for o, s, _, _ in rows)
        own = [x for x in labels if x[0] == d and d is not None]
        out.append(({k for k, v in fails.items() if v}, lang or "", any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    return out


def brute(rows, labels):
    docs, out = judge(rows, labels), {}
    for order in permutations(NAMES):
        for part in {d[1] for d in docs}:
            own = [d for d in docs if d[1] == part]
            for step, f in enumerate(order):
                before = set(order[:step])
                here = [d for d in own if f in d[0] and not d[0] & before]
                kept = [d for d in own if not d[0] & (before | {f})]
                redundant = [d for d in own if f in d[0] and d[0] & before]
                out[part, "".join(order), step + 1] = [len(kept), len(here), len(redundant), sum(d[0] == {f} for d in own), sum(d[2] for d in here), sum(d[3] for d in here), f]
    shapley = {}
    for (part, _, _), v in out.items():
        shapley[part, v[6]] = shapley.get((part, v[6]), 0) + v[1]
    return {k: (*v[:6], shapley[k[0], v[6]]) for k, v in out.items()}


def run(spark, path, labels):
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit_filters(spark, path, marks, AUDITED, "E")
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got.collect()}


@pytest.mark.parametrize("files, memory", [(1, 1 << 22), (7, 1 << 22), (7, 0)])
def test_audit(spark, tmp_path, monkeypatch, files, memory):
    """Smaller ids come last, so that masks have to be taken back; texts, ids and whole rows repeat."""
    monkeypatch.setattr(audit, "IN_MEMORY", memory)
    rows = [(1000 - i if i % 9 else None, TEXTS[(i * i + i // 7) % 10], ["en", "fr", None][i % 3], 1) for i in range(90)]
    rows += [rows[5], (500, LONG, "en", 2), (500, LONG, "fr", 2), (500, "other " + LONG, "fr", 2)]
    labels = [(i, i % 2, i % 3 == 0) for i in range(900, 1000)] + [(500, 0, 0), (500, 1, None), (None, 1, 1)]
    labels = [(a, b, None if c is None else int(c)) for a, b, c in labels]
    path = str(tmp_path / "documents.parquet")
    for k in range(files):
        spark.createDataFrame(rows[k::files] if files == 1 else rows[k * 15 : (k + 1) * 15], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    assert run(spark, path, labels) == brute(rows, labels)


def test_single_file_and_none(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = [(2, LONG, "en", 1), (1, LONG, "en", 1)]
    file = str(tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": [2, 1], "text": [LONG] * 2, "lang": ["en"] * 2}), file)
    assert run(spark, file, []) == brute(rows, [])
    empty = str(tmp_path / "none.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(empty)
    assert run(spark, empty, []) == {}


def test_takes_back(spark, tmp_path):
    """Counters of micro-batches: a smaller id takes back what was counted for the earlier one; a batch that runs again
    replaces its counters."""
    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    import pandas as pd

    state, step = State(), audit.smallest_first(16)
    frame = lambda *rows: pd.DataFrame(rows, columns=["text", "id", "part", "code", "n", "sure"])
    told = lambda *rows: sorted(tuple(x) for d in step((0,), iter([frame(*rows)]), state) for x in d.itertuples(index=False))
    assert told((b"t", 9, "en", 1, 1, False)) == [("en", 1, 1)]
    assert told((b"t", 12, "fr", 1, 1, False), (b"u", 3, "fr", 2, 1, False)) == [("fr", 2, 1), ("fr", 17, 1)]
    assert told((b"t", 4, "fr", 1, 1, False), (b"t", 4, "en", 1, 2, False)) == [("en", 1, 1), ("en", 17, 1), ("fr", 1, 1)]
    assert told((b"t", 0, "fr", 17, 5, True), (b"t", -(2**62) - 1, "en", 1, 1, False)) == [("en", 1, -1), ("en", 17, 2), ("fr", 1, -1), ("fr", 17, 6)]


def test_document():
    d = Document("Ä b\x0bC x  ".encode())
    assert d.words == ["Ä".encode(), b"b", "C x".encode()] and len(d) == 9 and d.count(b"BC") == 1
