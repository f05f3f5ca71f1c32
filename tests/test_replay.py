"""Edited histories against fresh replays."""

import random
import threading

from limpid.plans.pipeline import Pipeline
from limpid.plans.replay import Replay
from limpid.storage import scratch, shared_dir, written
from limpid.table import Table

COLUMNS = ["id", "nom", "note"]
ROWS = [(str(i), f" nom {i % 7} ", str(i % 5)) for i in range(60)]


def jobs(spark, f):
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        return f(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def history():
    p = Pipeline().add("normalize_columns", columns=["nom"], steps=["trim", "upper"]).add("filter_rows", where={"column": "note", "operator": "neq", "value": "4"})
    return p.add("add_constant_column", name="c", value="1").add("set_value_where", target="note", where={"column": "note", "operator": "eq", "value": "0"}, match_value="zero")


def test_edits_read_what_is_there(spark):
    t, p = Table.rows(spark, COLUMNS, ROWS), history()
    with Replay(t) as r:
        assert r.table(p).collect() == p.apply(t).collect()
        assert jobs(spark, lambda: r.table(p))[1] == 0
        for other in (p.undo(), p.undo().undo(), p.redo(), p.enable(p.steps[3].id, False), p.move(0)):
            got, n = jobs(spark, lambda other=other: r.table(other))
            assert n == 0 and got.collect() == other.apply(t).collect()
        edited = p.update(p.steps[2].id, {"name": "d", "value": "2"})
        got, n = jobs(spark, lambda: r.table(edited))
        assert n == 2 and got.collect() == edited.apply(t).collect()  # a job for the edited step, one for that after it
        assert jobs(spark, lambda: r.table(p))[1] == 0
        assert r.reports(p) == p.reports(t) and r.reports(edited) == edited.reports(t)
        assert [x.collect() for x in r.states(p)] == [after.collect() for _, _, after, _ in p.states(t)]


def test_random_edits(spark):
    rng, t = random.Random(3), Table.rows(spark, COLUMNS, ROWS)
    p = history()
    with Replay(t, most_bytes=6000) as r:  # so small that results have to go
        for _ in range(14):
            s = rng.choice(p.steps)
            match rng.randrange(4):
                case 0:
                    p = p.enable(s.id, not s.enabled)
                case 1:
                    p = p.move(rng.randrange(len(p.steps) + 1))
                case 2:
                    p = p.add("filter_rows", where={"column": "note", "operator": "neq", "value": str(rng.randrange(4))})
                case 3 if len(p.steps) > 2:
                    p = p.remove(s.id)
            assert r.table(p).collect() == p.apply(t).collect()
        assert sum(k.size for k in list(r.kept.values())[:-1]) <= 6000


def test_extracted_tables_and_joins(spark):
    t, other = Table.rows(spark, COLUMNS, ROWS), Table.rows(spark, ["ref", "x"], [(str(i), f"x{i}") for i in range(0, 60, 2)])
    p = Pipeline().add("filter_rows", where={"column": "note", "operator": "eq", "value": "1"}, action="extract_to_new_table", name="ones")
    p = p.add("enrich_join", table="o", pairs=[{"left": "id", "right": "ref"}], copied=["x"]).add("append_rows", table="ones", mapping={"id": "id"})
    with Replay(t, {"o": other}) as r:
        assert r.table(p).collect() == p.apply(t, {"o": other}).collect()
        q = p.undo().add("append_rows", table="ones", mapping={"nom": "nom"})
        got, n = jobs(spark, lambda: r.table(q))
        assert n == 1 and got.collect() == q.apply(t, {"o": other}).collect()
        assert r.reports(p)[2]["rowsAdded"] == 12


def test_scopes_of_threads(spark):
    """What one thread's scope deletes is its own."""
    seen, ready, done = {}, threading.Event(), threading.Event()

    def other():
        with scratch(spark):
            seen["frame"] = written(spark.range(5), "other")
            ready.set()
            done.wait(60)
            seen["count"] = seen["frame"].count()

    thread = threading.Thread(target=other)
    with scratch(spark):
        thread.start()
        ready.wait(60)
        mine = written(spark.range(7), "mine")
        assert mine.count() == 7
    done.set()
    thread.join()
    assert seen["count"] == 5 and shared_dir(spark)
