"""More queries of the catalogue: files in and out, recipes, reports, replayed histories, and what the entry points tell.

Files are written by Spark from the given tables to the shared folder and read again.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limpid import api
from limpid.functions.fuzzy import jaro_udf
from limpid.operators import REGISTRY, Context
from limpid.operators.dedup import find_duplicates
from limpid.operators.join import fuzzy_keys, resolve
from limpid.plans import anonymise, recipe, report
from limpid.plans.catalogue import do, op, query
from limpid.plans.pipeline import Pipeline
from limpid.sources import preview, read_csv, table_from_text, write_csv
from limpid.sources.csv import to_text
from limpid.storage import shared_dir
from limpid.table import Table, q


def place(t: Table, name: str) -> str:
    return f"{shared_dir(t.df.sparkSession)}/{name}-{uuid.uuid4().hex}"


def exported(t: Table, **how) -> str:
    path = place(t, "export")
    write_csv(t, path, **how)
    return path


def lines(t: Table, *rows: DataFrame) -> str:
    """A folder with one text file: rows of one column `value`, in order."""
    path, every = place(t, "lines"), None
    for i, r in enumerate(rows):
        part = r.select(F.lit(i).alias("part"), "value")
        every = part if every is None else every.unionByName(part)
    every.orderBy("part", "value").coalesce(1).select("value").write.text(path)
    return path


def literal(t: Table, *values: str) -> DataFrame:
    return t.df.sparkSession.createDataFrame([(v,) for v in values], "value string")


def told(t: Table, rows: list[dict], schema: str) -> DataFrame:
    """What an entry point told, as rows."""
    return t.df.sparkSession.createDataFrame([tuple(r.values()) for r in rows], schema)


_TEXT = "c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey, c_mktsegment"
_CUSTOMER = "customer:c_custkey,c_name,c_nationkey,c_mktsegment"


@query("csv_round_trip", _CUSTOMER, sql=f"SELECT {_TEXT} FROM customer")
def csv_round_trip(t: Table) -> DataFrame:
    """A folder of several parts, each with its header and byte order mark."""
    parts = place(t, "parts")
    for k in range(3):
        write_csv(Table(t.df.filter(F.col("__ord") % 3 == k), t.columns), f"{parts}/k={k}")
    return read_csv(t.df.sparkSession, f"{parts}/*").output()


@query("csv_column_choice", _CUSTOMER, sql="SELECT c_name, c_custkey::VARCHAR AS c_custkey FROM customer")
def csv_column_choice(t: Table) -> DataFrame:
    return read_csv(t.df.sparkSession, exported(t, delimiter=",", columns=["c_name", "c_custkey"], bom=False)).output()


@query("csv_line_breaks", "conversations:conv_id,turn,text", sql="SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, md5(coalesce(text, '') || chr(10) || '\"x\"; y') AS h FROM conversations")
def csv_line_breaks(t: Table) -> DataFrame:
    """Quoted cells with quotes, delimiters and line breaks."""
    broken = t.with_column("text", F.concat(q("text"), F.lit('\n"x"; y')))
    return read_csv(t.df.sparkSession, exported(broken)).output().select("conv_id", "turn", F.md5("text").alias("h"))


@query("csv_one_file", "conversations:conv_id,turn,text", sql="SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, md5(coalesce(text, '') || chr(10) || '\"x\"; y') AS h FROM conversations")
def csv_one_file(t: Table) -> DataFrame:
    """All rows as one file, whose quoted line breaks are read again in ranges."""
    broken = t.with_column("text", F.concat(q("text"), F.lit('\n"x"; y')))
    file = place(t, "one") + ".csv"
    write_csv(broken, file, single=True)
    return read_csv(t.df.sparkSession, file).output().select("conv_id", "turn", F.md5("text").alias("h"))


@query("csv_delimiter", "orders:o_orderkey,o_orderstatus,o_orderpriority", sql="SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def csv_delimiter(t: Table) -> DataFrame:
    return read_csv(t.df.sparkSession, exported(t, delimiter="|")).output()


def _nations(t: Table) -> DataFrame:
    return t.df.select(F.concat_ws(";", "n_nationkey", "n_name").alias("value"))


@query("csv_header_row", "nation:n_nationkey,n_name", sql="SELECT n_nationkey::VARCHAR AS key, n_name AS name FROM nation")
def csv_header_row(t: Table) -> DataFrame:
    """Rows and blank lines before the header, a blank row behind it."""
    path = lines(t, literal(t, "export of nations"), literal(t, ""), literal(t, "key;name"), literal(t, " ; "), _nations(t))
    return read_csv(t.df.sparkSession, path, header_row=1).output()


@query("csv_header_names", "nation:n_nationkey,n_name", sql="SELECT n_nationkey::VARCHAR AS a, n_name AS \"a (2)\", '' AS \"Colonne 3\" FROM nation")
def csv_header_names(t: Table) -> DataFrame:
    """Repeated and blank names; rows shorter than the header."""
    return read_csv(t.df.sparkSession, lines(t, literal(t, " a ;a;;"), _nations(t))).output().select("a", "`a (2)`", "`Colonne 3`")


@query("csv_preview", "nation:n_nationkey,n_name", sql="SELECT count(*) + 2 AS rows, ';' AS delimiter, 'key,name' AS names, 'export of nations' AS first FROM nation")
def csv_preview(t: Table) -> DataFrame:
    path = lines(t, literal(t, "export of nations"), literal(t, "key;name"), _nations(t))
    x = preview(t.df.sparkSession, path, header_row=1)
    return told(t, [{"rows": x["rawRowCount"], "delimiter": x["delimiter"], "names": ",".join(x["columns"]), "first": x["preview"][0][0]}], "rows long, delimiter string, names string, first string")


@query("pasted_text", "nation:n_nationkey,n_name", sql="SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation")
def pasted_text(t: Table) -> DataFrame:
    return table_from_text(t.df.sparkSession, to_text(t)).output()


@query("rows_in_memory", "region:r_regionkey,r_name", sql="SELECT r_regionkey::VARCHAR AS r_regionkey, r_name FROM region")
def rows_in_memory(t: Table) -> DataFrame:
    return Table.rows(t.df.sparkSession, t.columns, t.collect()).output()


@query("recipe_on_other_names", "part:p_partkey,p_name", "supplier:s_suppkey,s_name", sql="SELECT s_suppkey::VARCHAR AS s_suppkey, upper(trim(s_name)) AS s_name FROM supplier WHERE s_name LIKE '%1%'")
def recipe_on_other_names(p: Table, s: Table) -> DataFrame:
    """A pipeline over parts as JSON, bound to suppliers."""
    steps = Pipeline().add("normalize_columns", columns=["p_name"], steps=["trim", "upper"]).add("filter_rows", where={"column": "p_name", "operator": "contains", "value": "1"})
    made = recipe.Recipe.from_json(recipe.build("r", steps, p).to_json())
    return recipe.instantiate(made, recipe.suggest(made.expected, s.columns)).apply(s).output()


@query("history_replay", _CUSTOMER, sql="SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment, 'b' AS x FROM customer")
def history_replay(t: Table) -> DataFrame:
    """Steps added, changed, switched off, undone and done again."""
    p = Pipeline().add("drop_columns", columns=["c_nationkey"]).add("add_constant_column", name="x", value="a").add("filter_rows", where={"column": "c_mktsegment", "operator": "eq", "value": "none"})
    p = p.enable(p.steps[2].id, False).update(p.steps[1].id, {"name": "x", "value": "b"}).add("drop_columns", columns=["x"]).undo()
    return p.undo().redo().apply(t).output()


_STEPS = (("filter_rows", {"where": {"column": "o_totalprice", "operator": "between", "min": "100000"}}), ("enrich_join", {"table": "c", "pairs": [{"left": "o_custkey", "right": "c_custkey"}], "copied": ["c_name"], "type": "inner"}), ("set_value_where", {"where": {"column": "c_name", "operator": "contains", "value": "1"}, "target": "c_name", "match_value": "one"}))
_COUNTED = "WITH a AS (SELECT * FROM orders WHERE o_totalprice >= 100000), b AS (SELECT c_name FROM a JOIN customer ON c_custkey = o_custkey)"


def _history() -> Pipeline:
    p = Pipeline()
    for kind, params in _STEPS:
        p = p.add(kind, **params)
    return p


@query("pipeline_reports", "orders:o_orderkey,o_custkey,o_totalprice", "customer:c_custkey,c_name", sql=f"{_COUNTED} SELECT 'filter_rows' AS type, (SELECT count(*) FROM orders) AS rows_in, (SELECT count(*) FROM a) AS rows_out, NULL::BIGINT AS matched, NULL::BIGINT AS modified UNION ALL SELECT 'enrich_join', (SELECT count(*) FROM a), (SELECT count(*) FROM b), (SELECT count(*) FROM b), NULL UNION ALL SELECT 'set_value_where', (SELECT count(*) FROM b), (SELECT count(*) FROM b), NULL, (SELECT count(*) FROM b WHERE c_name LIKE '%1%')")
def pipeline_reports(o: Table, c: Table) -> DataFrame:
    rows = [{"type": r["type"], "rows_in": r["rowsIn"], "rows_out": r["rowsOut"], "matched": r.get("matchedAuto"), "modified": r.get("rowsModified")} for r in _history().reports(o, {"c": c})]
    return told(o, rows, "type string, rows_in long, rows_out long, matched long, modified long")


@query("pipeline_report_text", "orders:o_orderkey,o_custkey,o_totalprice", "customer:c_custkey,c_name", sql=f"{_COUNTED}, n AS (SELECT (SELECT count(*) FROM orders) AS o, (SELECT count(*) FROM a) AS f, (SELECT count(*) FROM b) AS j) SELECT unnest(['Étape 0 — Source : ' || o || ' lignes, 3 colonnes', 'Étape 1 — Filtrer des lignes', 'Étape 2 — Rapprocher / enrichir', 'Étape 3 — set_value_where', '  lignes en entrée : ' || o, '  lignes en sortie : ' || f, '  lignes en sortie : ' || j]) AS line FROM n")
def pipeline_report_text(o: Table, c: Table) -> DataFrame:
    text = _history().report_text(o, {"c": c}, datetime(2020, 1, 1)).split("\n")
    steps = [x for x in text if x.startswith("Étape")]
    return told(o, [{"line": x} for x in [*steps, text[6], text[7], text[12]]], "line string")


@query("report_traceability", "orders:o_orderkey,o_custkey,o_totalprice", "customer:c_custkey,c_name", sql=f"{_COUNTED} SELECT (SELECT count(*) FROM b) AS auto, 0::BIGINT AS manual, 0::BIGINT AS unmatched, 'orders,customer' AS files, 3::BIGINT AS steps")
def report_traceability(o: Table, c: Table) -> DataFrame:
    x = report.traceability(_history(), o, {"c": c})
    return told(o, [{"auto": x["totalAutoMatched"], "manual": x["totalManualMatched"], "unmatched": x["totalUnmatched"], "files": ",".join(f["name"] for f in x["sourceFiles"]), "steps": len(x["steps"])}], "auto long, manual long, unmatched long, files string, steps long")


@query("report_import", "customer:c_custkey,c_mktsegment", sql="SELECT count(*)::VARCHAR AS n, 'c_mktsegment' AS mapped FROM customer")
def report_import(t: Table) -> DataFrame:
    """A spec that expects other names, imported with the mapping that they suggest, and computed from a file."""
    spark, path = t.df.sparkSession, exported(t)
    spec = '{"version": 1, "title": "t", "expectedColumns": ["mktsegment"], "blocks": [{"kind": "page_break"}, {"kind": "kpi_row", "items": [{"label": "n", "aggregate": {"fn": "countNonEmpty", "column": "mktsegment"}}]}]}'
    got = api.import_report(spark, spec, path)
    out = api.build_report(spark, path, got["spec"], got["mapping"])
    return told(t, [{"n": out[1]["items"][0]["value"], "mapped": got["mapping"]["mktsegment"]}], "n string, mapped string")


@query("anonymised_shape", "customer:c_custkey,c_name", sql="SELECT regexp_replace(c_custkey::VARCHAR, '[0-9]', '9', 'g') AS c_custkey, regexp_replace(regexp_replace(regexp_replace(c_name, '[0-9]', '9', 'g'), '[a-z]', 'a', 'g'), '[A-Z]', 'A', 'g') AS c_name FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 3)")
def anonymised_shape(t: Table) -> DataFrame:
    """The shape of three anonymised rows is that of the true ones."""
    mask = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(q(c), "[0-9]", "9"), "[a-z]", "a"), "[A-Z]", "A").alias(c)
    return told(t, anonymise.sample(t), "c_custkey string, c_name string").select(mask("c_custkey"), mask("c_name"))


@query("profile_file", _CUSTOMER, sql="SELECT 'c_mktsegment' AS \"column\", 'text' AS type, count(*) AS total, count(DISTINCT c_mktsegment) AS distinct, (SELECT count(*) FROM customer) AS whole FROM customer UNION ALL SELECT 'c_custkey', 'integer', count(*), count(DISTINCT c_custkey), count(*) FROM customer")
def profile_file(t: Table) -> DataFrame:
    x = api.profile_csv(t.df.sparkSession, exported(t))
    own = [{"column": c["column"], "type": c["type"], "total": c["total"], "distinct": c["distinct"], "whole": x["totalCount"]} for c in x["columns"] if c["column"] in ("c_mktsegment", "c_custkey")]
    return told(t, own, "`column` string, type string, total long, distinct long, whole long")


@query("apply_to_file", _CUSTOMER, sql="SELECT c_custkey::VARCHAR AS c_custkey, upper(c_name) AS c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def apply_to_file(t: Table) -> DataFrame:
    """A pipeline from file to file, both in a folder that its paths may not leave."""
    root = place(t, "root")
    write_csv(t, f"{root}/in")
    steps = [{"type": "filter_rows", "params": {"where": {"column": "c_mktsegment", "operator": "eq", "value": "BUILDING"}}}, {"type": "normalize_columns", "params": {"columns": ["c_name"], "steps": ["upper"]}}, {"type": "drop_columns", "params": {"columns": ["c_nationkey", "c_mktsegment"]}}]
    api.apply_pipeline(t.df.sparkSession, "in", steps, "x/../out", root=root)
    return read_csv(t.df.sparkSession, f"{root}/out").output()


@query("match_files_unmatched", "labels:doc_id,quality", "documents:doc_id,lang", sql="SELECT doc_id::VARCHAR AS doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def match_files_unmatched(a: Table, b: Table) -> DataFrame:
    """The rows of the right file without a partner, as the file that the entry point writes."""
    out = place(a, "unmatched")
    api.match_files(a.df.sparkSession, exported(a), exported(b), [{"left": "doc_id", "right": "doc_id"}], unmatched_output={"right": out})
    return read_csv(a.df.sparkSession, out).output()


@query("find_duplicates_totals", "part:p_partkey,p_name", sql="WITH g AS (SELECT count(*) AS n FROM part GROUP BY upper(p_name) HAVING count(*) > 1) SELECT (SELECT count(*) FROM part) AS total_rows, count(*) AS total_groups, coalesce(sum(n), 0)::BIGINT AS total_duplicate_rows, count(*) > 200 AS truncated FROM g")
def find_duplicates_totals(t: Table) -> DataFrame:
    x = api.find_duplicates(t.df.sparkSession, exported(t), ["p_name"])
    return told(t, [{"a": x.total_rows, "b": x.total_groups, "c": x.total_duplicate_rows, "d": x.truncated}], "total_rows long, total_groups long, total_duplicate_rows long, truncated boolean")


@query("dedup_keep_first_lineitem", "lineitem@l_orderkey,l_linenumber,l_partkey,l_suppkey,l_quantity", sql="SELECT l_orderkey::VARCHAR AS l_orderkey, l_linenumber::VARCHAR AS l_linenumber, l_partkey::VARCHAR AS l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) = 1")
def dedup_keep_first_lineitem(t: Table) -> DataFrame:
    """A table that several columns order; columns that aren't asked for don't go through the aggregate."""
    own = t.select({c: c for c in ("l_orderkey", "l_linenumber", "l_partkey")})
    return op(own, "deduplicate", columns=["l_partkey"], action="keep_first").output()


@query("dedup_after_summary", "orders:o_orderkey,o_custkey,o_orderstatus", sql="WITH g AS (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY 1) SELECT o_custkey::VARCHAR AS o_custkey, n::VARCHAR AS n FROM g QUALIFY row_number() OVER (PARTITION BY n ORDER BY f) = 1")
def dedup_after_summary(t: Table) -> DataFrame:
    """The first customer with each number of orders, in the order of first appearance."""
    return do(t, ("summarize", {"group_by": [{"column": "o_custkey"}], "aggregates": [{"fn": "count", "name": "n"}]}), ("deduplicate", {"columns": ["n"]})).output()


@query("sequence_after_summary", "orders:o_orderkey,o_custkey", sql="SELECT o_custkey::VARCHAR AS o_custkey, row_number() OVER (ORDER BY min(o_orderkey))::VARCHAR AS n FROM orders GROUP BY o_custkey")
def sequence_after_summary(t: Table) -> DataFrame:
    out = do(t, ("summarize", {"group_by": [{"column": "o_custkey"}], "aggregates": [{"fn": "count", "name": "c"}]}), ("add_sequence_column", {"name": "n"}))
    return out.output().select("o_custkey", "n")


@query("fuzzy_after_summary", "part:p_partkey,p_name,p_brand", "part:p_partkey,p_name,p_brand", sql="WITH k AS (SELECT p_brand, p_name, p_partkey, array_to_string(list_sort(string_split(upper(p_name), ' ')), ' ') AS s FROM part), g AS (SELECT p_brand, p_name, min(s) AS s FROM k GROUP BY ALL), m AS (SELECT p_brand, s, min(p_partkey) AS r FROM k GROUP BY ALL) SELECT p_brand, p_name, r::VARCHAR AS p_partkey FROM g JOIN m USING (p_brand, s)")
def fuzzy_after_summary(a: Table, b: Table) -> DataFrame:
    """Rows that a summary made, enriched by equal names."""
    own = op(a, "summarize", group_by=[{"column": "p_brand"}, {"column": "p_name"}], aggregates=[{"fn": "count", "name": "n"}])
    out = op(own, "enrich_join", {"b": b}, table="b", pairs=[{"left": "p_brand", "right": "p_brand"}], copied=["p_partkey"], fuzzy={"left": ["p_name"], "right": ["p_name"]})
    return out.output().select("p_brand", "p_name", "p_partkey")


@query("fuzzy_key_helper", "part:p_partkey,p_name,p_brand", sql="SELECT p_partkey AS ord, array_to_string(list_sort(string_split(upper(replace(p_brand || ' ' || p_name, '#', '')), ' ')), ' ') AS key FROM part")
def fuzzy_key_helper(t: Table) -> DataFrame:
    return fuzzy_keys(t, ["p_brand", "p_name"])


@query("fuzzy_decisions", "part:p_partkey,p_name,p_brand", "part:p_partkey,p_name,p_brand", sql="WITH k AS (SELECT p_partkey, p_brand, array_to_string(list_sort(string_split(upper(p_name), ' ')), ' ') AS s FROM part), f AS (SELECT s FROM k WHERE p_partkey = 1), g AS (SELECT s FROM k WHERE p_partkey = 2), h AS (SELECT min(p_partkey) AS r FROM k WHERE s = (FROM g)) SELECT p_partkey AS left_ord, CASE WHEN s = (FROM f) THEN (SELECT r FROM h) ELSE (SELECT min(p_partkey) FROM k b WHERE b.p_brand = k.p_brand AND b.s = k.s) END AS right_ord, CASE WHEN s = (FROM f) THEN 'forced' WHEN s = (FROM g) THEN 'manual' ELSE 'auto' END AS status FROM k")
def fuzzy_decisions(a: Table, b: Table) -> DataFrame:
    """Of repeated decisions and forced pairs the last one counts."""
    one, two = (a.df.filter(F.col("__ord") == i).first()["p_name"] for i in (1, 2))
    own = {"left": ["p_name"], "right": ["p_name"], "decisions": [{"left": two, "right": two, "decision": d} for d in ("rejected", "validated")], "forced": [{"left": one, "right": r} for r in (one, two)]}
    return resolve(a, b, {"pairs": [{"left": "p_brand", "right": "p_brand"}], "fuzzy": own}).select("left_ord", "right_ord", "status")


@query("jaro_similarity", "part:p_partkey,p_name,p_type", sql="SELECT p_partkey::VARCHAR AS p_partkey, round(jaro_similarity(p_name, p_type), 6) AS s FROM part")
def jaro_similarity(t: Table) -> DataFrame:
    return t.df.select("p_partkey", F.round(jaro_udf(q("p_name"), q("p_type")), 6).alias("s"))


@query("streaming_steps", "orders:o_orderkey,o_orderstatus", sql="SELECT o_orderkey::VARCHAR AS o_orderkey, lower(o_orderstatus) AS o_orderstatus FROM orders WHERE o_orderstatus = 'O'")
def streaming_steps(t: Table) -> DataFrame:
    """Row-wise steps on a stream of files, written by a query that ends when all files are read."""
    from limpid.streaming import apply_steps

    spark, source, sink = t.df.sparkSession, place(t, "stream-in"), place(t, "stream-out")
    t.output().write.parquet(source)
    steps = [{"type": "filter_rows", "params": {"where": {"column": "o_orderstatus", "operator": "eq", "value": "O"}}}, {"type": "normalize_columns", "params": {"columns": ["o_orderstatus"], "steps": ["lower"]}}]
    stream = apply_steps(spark.readStream.schema("o_orderkey string, o_orderstatus string").parquet(source), steps)
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{sink}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink)


@query("duplicates_listing", "events:event_id,user_id,event_type", sql="SELECT user_id || chr(1) || event_type AS key, count(*) AS rows FROM events GROUP BY 1 HAVING count(*) > 1")
def duplicates_listing(t: Table) -> DataFrame:
    return find_duplicates(t, ["user_id", "event_type"], "exact")


@query("filter_extract", "orders:o_orderkey,o_orderstatus", sql="SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, 'extracted' AS part FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey::VARCHAR, o_orderstatus, 'whole' FROM orders")
def filter_extract(t: Table) -> DataFrame:
    """The rows that a filter puts in a table of their own, and the table that it leaves as it was."""
    ctx = Context()
    whole = REGISTRY["filter_rows"](t, {"where": {"column": "o_orderstatus", "operator": "eq", "value": "F"}, "action": "extract_to_new_table", "name": "finished"}, ctx)
    part = lambda x, name: x.output().withColumn("part", F.lit(name))
    return part(ctx.table("finished"), "extracted").unionByName(part(whole, "whole"))


@query("pipeline_states", "orders:o_orderkey,o_custkey,o_totalprice", "customer:c_custkey,c_name", sql=f"{_COUNTED} SELECT 'filter_rows' AS type, count(*) AS rows, 3::BIGINT AS columns FROM a UNION ALL SELECT 'enrich_join', count(*), 4 FROM b UNION ALL SELECT 'set_value_where', count(*), 4 FROM b")
def pipeline_states(o: Table, c: Table) -> DataFrame:
    """The table behind each step."""
    rows = [after.df.agg(F.lit(s.type).alias("type"), F.count("*").alias("rows"), F.lit(len(after.columns)).cast("long").alias("columns")) for s, _, after, _ in _history().states(o, {"c": c})]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


_BLOCKS = [
    {"kind": "text", "text": "t"},
    {"kind": "kpi_row", "items": [{"label": "orders", "aggregate": {"fn": "count"}}, {"label": "customers", "aggregate": {"fn": "countDistinct", "column": "o_custkey"}}]},
    {"kind": "chart", "chart": "bar", "x": "o_orderstatus", "series": ["n"], "summarize": {"group_by": [{"column": "o_orderstatus"}], "aggregates": [{"fn": "count", "name": "n"}]}},
    {"kind": "page_break"},
    {"kind": "table", "columns": ["o_orderkey"], "filter": {"column": "o_orderstatus", "operator": "eq", "value": "P"}, "max_rows": 5},
]


@query("report_blocks", "orders:o_orderkey,o_custkey,o_orderstatus", sql="SELECT 'kpi_row' AS kind, 'orders' AS label, count(*)::VARCHAR AS value FROM orders UNION ALL SELECT 'kpi_row', 'customers', count(DISTINCT o_custkey)::VARCHAR FROM orders UNION ALL SELECT 'chart', o_orderstatus, count(*)::VARCHAR FROM orders GROUP BY 2 UNION ALL SELECT 'table', 'matching', count(*)::VARCHAR FROM orders WHERE o_orderstatus = 'P' UNION ALL (SELECT 'table', 'row', o_orderkey::VARCHAR FROM orders WHERE o_orderstatus = 'P' ORDER BY orders.o_orderkey LIMIT 5) UNION ALL SELECT unnest(['text', 'page_break']), '', ''")
def report_blocks(t: Table) -> DataFrame:
    """A whole report, block by block."""
    rows: list[dict] = []
    for b in report.compute({"version": 1, "title": "t", "blocks": _BLOCKS}, t):
        match b["kind"]:
            case "kpi_row":
                own = [(x["label"], x["value"]) for x in b["items"]]
            case "chart":
                own = [*zip(b["categories"], b["series"]["n"], strict=True)]
            case "table":
                own = [("matching", str(b["totalMatching"])), *[("row", r[0]) for r in b["rows"]]]
            case _:
                own = [("", "")]
        rows += [{"kind": b["kind"], "label": label, "value": value} for label, value in own]
    return told(t, rows, "kind string, label string, value string")


@query("preview_steps", _CUSTOMER, sql="SELECT 'deduplicate' AS type, (SELECT count(*) FROM customer) AS rows_in, count(DISTINCT c_mktsegment) AS rows_out, count(DISTINCT c_mktsegment) AS sample FROM customer")
def preview_steps(t: Table) -> DataFrame:
    x = api.preview_pipeline(t.df.sparkSession, exported(t), [{"type": "deduplicate", "params": {"columns": ["c_mktsegment"]}}])
    return told(t, [{"type": s["type"], "in": s["rowsIn"], "out": s["rowsOut"], "sample": len(x["sample"])} for s in x["steps"]], "type string, rows_in long, rows_out long, sample long")


@query("levenshtein_distance", "part:p_partkey,p_name,p_type", sql="SELECT p_partkey::VARCHAR AS p_partkey, levenshtein(p_name, p_type)::INT AS d FROM part")
def levenshtein_distance(t: Table) -> DataFrame:
    return t.df.select("p_partkey", F.levenshtein(q("p_name"), q("p_type")).alias("d"))


@query("assistant_sheet", _CUSTOMER, sql="SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_mktsegment']) AS \"column\", true AS told")
def assistant_sheet(t: Table) -> DataFrame:
    """The sheet tells every column and no cell of the columns with words."""
    sheet = anonymise.assistant_export(t)
    words = {r[0] for r in t.df.select("c_mktsegment").distinct().collect()}
    assert not any(w in sheet for w in words)
    return told(t, [{"column": c, "told": c in sheet} for c in t.columns], "`column` string, told boolean")
