"""A catalogue of queries over the given tables: each operator on whole tables, with DuckDB SQL for its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limpid.functions.fuzzy import levenshtein_similarity
from limpid.functions.text import token_sorted
from limpid.operators import REGISTRY, Context
from limpid.operators.dedup import diverging_columns, find_duplicates
from limpid.operators.join import ambiguous, match_counts, resolve, unmatched, unmatched_right
from limpid.plans.pipeline import Pipeline
from limpid.plans.profile import odd_case, profile, top_values
from limpid.plans.report import chart, kpis, table_block
from limpid.table import ORD, Table, q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Columns that tell a table's rows apart and order them; others are in the order of their files.
KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "events": ["event_id"], "documents": ["doc_id"], "pages": ["page_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"]}


def query(name: str, *tables: str, sql: str | None = None):
    """Registers f(table, ...) -> DataFrame. tables: name, name:columns or name@columns that order its rows."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            own = []
            for n in tables:
                name, _, keys = n.partition("@")
                name, _, cols = name.partition(":")
                path, kept = f"{sf_dir}/{name}.parquet", cols.split(",") if cols else None
                if keys or name in KEYS:
                    t = Table.of(spark.read.parquet(path), keys.split(",") if keys else KEYS[name], name)
                    own.append(t.select({c: c for c in kept}) if kept else t)
                else:
                    own.append(Table.parquet(spark, path, kept, name))
            return f(*own)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return add


def do(t: Table, *steps: tuple[str, dict], **tables: Table) -> Table:
    p = Pipeline()
    for kind, params in steps:
        p = p.add(kind, **params)
    return p.apply(t, tables)


def op(t: Table, kind: str, /, tables: dict | None = None, **params) -> Table:
    return REGISTRY[kind](t, params, Context(dict(tables or {})))


def double(t: Table, *names: str) -> DataFrame:
    """The output, some columns as numbers rounded to two places; an empty cell is null."""
    num = lambda c: F.round(F.expr(f"try_cast(nullif(`{c}`, '') as double)"), 2).alias(c)
    return t.df.select(*[num(c) if c in names else q(c) for c in t.columns])


query("rename_reorder_drop", "nation", sql="SELECT n_name AS name, n_nationkey::VARCHAR AS id FROM nation")(
    lambda t: do(t, ("rename_columns", {"renames": {"n_name": "name", "n_nationkey": "id"}}), ("reorder_columns", {"order": ["name", "id"]}), ("drop_columns", {"columns": ["n_regionkey"]}), ("hide_columns", {"columns": ["id"]})).output()
)
query("duplicate_constant_concat", "customer:c_name,c_mktsegment", sql="SELECT c_name, c_name AS copy, c_mktsegment, 'x' AS const, c_name || ' - ' || c_mktsegment AS both FROM customer")(
    lambda t: do(t, ("duplicate_column", {"column": "c_name", "name": "copy"}), ("add_constant_column", {"name": "const", "value": "x"}), ("add_concat_column", {"name": "both", "columns": ["c_name", "c_mktsegment"], "separator": " - "})).output()
)
query("extract_year", "orders:o_orderkey,o_orderdate", sql="SELECT o_orderkey::VARCHAR AS o_orderkey, year(o_orderdate)::VARCHAR AS y FROM orders")(
    lambda t: op(op(t, "add_extract_column", name="y", column="o_orderdate", mode="year"), "drop_columns", columns=["o_orderdate"]).output()
)
query("extract_first_last_n", "customer:c_custkey,c_name", sql="SELECT c_custkey::VARCHAR AS c_custkey, left(c_name, 4) AS a, right(c_name, 3) AS b FROM customer")(
    lambda t: do(t, ("add_extract_column", {"name": "a", "column": "c_name", "mode": "first_n", "arg": "4"}), ("add_extract_column", {"name": "b", "column": "c_name", "mode": "last_n", "arg": "3"}), ("drop_columns", {"columns": ["c_name"]})).output()
)
query("extract_before_after_sep", "part:p_partkey,p_name", sql="SELECT p_partkey::VARCHAR AS p_partkey, split_part(p_name, ' ', 1) AS a, CASE WHEN instr(p_name, 'e') > 0 THEN substr(p_name, instr(p_name, 'e') + 1) ELSE '' END AS b FROM part")(
    lambda t: do(t, ("add_extract_column", {"name": "a", "column": "p_name", "mode": "before_sep", "arg": " "}), ("add_extract_column", {"name": "b", "column": "p_name", "mode": "after_sep", "arg": "e"}), ("drop_columns", {"columns": ["p_name"]})).output()
)
query("extract_regex_group", "pages:page_id,url", sql="SELECT page_id::VARCHAR AS page_id, regexp_extract(url, 'https?://([^/]+)', 1) AS host FROM pages")(
    lambda t: op(op(t, "add_extract_column", name="host", column="url", mode="regex_group", arg="https?://([^/]+)"), "drop_columns", columns=["url"]).output()
)
query("sequence", "orders:o_orderkey", sql="SELECT o_orderkey::VARCHAR AS o_orderkey, (5 + 5 * row_number() OVER (ORDER BY o_orderkey))::BIGINT::VARCHAR AS n FROM orders")(
    lambda t: op(t, "add_sequence_column", name="n", start=10, step=5).output()
)
query("expression_arith", "lineitem:l_orderkey,l_quantity,l_extendedprice,l_tax", sql=r"SELECT l_orderkey::VARCHAR AS l_orderkey, regexp_replace((l_extendedprice * l_quantity - l_tax * 2)::VARCHAR, '\.0$', '') AS x FROM lineitem")(
    lambda t: (op(op(t, "add_expression_column", name="x", expression={"op": "-", "left": {"op": "*", "left": {"column": "l_extendedprice"}, "right": {"column": "l_quantity"}}, "right": {"op": "*", "left": {"column": "l_tax"}, "right": {"literal": "2"}}}), "drop_columns", columns=["l_quantity", "l_extendedprice", "l_tax"])).output()
)
query("expression_divide", "orders:o_orderkey,o_totalprice,o_custkey", sql=r"SELECT o_orderkey::VARCHAR AS o_orderkey, CASE WHEN o_custkey = 0 THEN '' ELSE regexp_replace((o_totalprice / o_custkey)::VARCHAR, '\.0$', '') END AS x FROM orders")(
    lambda t: op(op(t, "add_expression_column", name="x", expression={"op": "/", "left": {"column": "o_totalprice"}, "right": {"column": "o_custkey"}}), "drop_columns", columns=["o_totalprice", "o_custkey"]).output()
)
query("expression_concat_fallback", "part:p_partkey,p_brand,p_size", sql="SELECT p_partkey::VARCHAR AS p_partkey, p_brand || p_size AS x FROM part")(
    lambda t: op(op(t, "add_expression_column", name="x", expression={"op": "+", "left": {"column": "p_brand"}, "right": {"column": "p_size"}}), "drop_columns", columns=["p_brand", "p_size"]).output()
)
_md5 = lambda t, c: t.df.select(*[F.md5(q(x)).alias(x) if x == c else q(x) for x in t.columns])
query("normalize_trim_upper", "supplier:s_suppkey,s_name", sql="SELECT s_suppkey::VARCHAR AS s_suppkey, upper(trim(s_name)) AS s_name FROM supplier")(lambda t: op(t, "normalize_columns", columns=["s_name"], steps=["trim", "upper"]).output())
query("normalize_strip_accents", "documents:doc_id,text", sql="SELECT doc_id::VARCHAR AS doc_id, md5(strip_accents(text)) AS text FROM documents")(lambda t: _md5(op(t, "normalize_columns", columns=["text"], steps=["strip_accents"]), "text"))
query("normalize_strip_punctuation", "documents:doc_id,text", sql=r"SELECT doc_id::VARCHAR AS doc_id, md5(regexp_replace(regexp_replace(text, '[\p{P}\p{S}]', '', 'g'), '\s+', ' ', 'g')) AS text FROM documents")(lambda t: _md5(op(t, "normalize_columns", columns=["text"], steps=["strip_punctuation", "collapse_spaces"]), "text"))
query("normalize_digits", "conversations:conv_id,turn,text", sql="SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, text, regexp_replace(text, '[^0-9]', '', 'g') AS \"text (normalisé)\" FROM conversations")(lambda t: op(t, "normalize_columns", columns=["text"], steps=["digits_only"], mode="new_column").output())
query("normalize_title", "part:p_partkey,p_name", sql=r"SELECT p_partkey::VARCHAR AS p_partkey, array_to_string(list_transform(regexp_extract_all(p_name, '[\pL][\pL\pN''\-]*|[^\pL]+'), lambda w: upper(w[1]) || lower(w[2:])), '') AS p_name FROM part")(lambda t: op(t, "normalize_columns", columns=["p_name"], steps=["title"]).output())

_WHERE = {
    "filter_list_prefix_contains": ("orders:o_orderkey,o_orderstatus,o_orderpriority", {"conditions": [{"column": "o_orderstatus", "operator": "in_list", "values": ["O", "P"]}, {"column": "o_orderpriority", "operator": "starts_with", "value": "1"}, {"column": "o_orderpriority", "operator": "contains", "value": "URG"}]}, "o_orderstatus IN ('O', 'P') AND o_orderpriority LIKE '1%' AND o_orderpriority LIKE '%URG%'"),
    "filter_regex": ("part:p_partkey,p_name,p_type", {"column": "p_type", "operator": "regex", "value": "^[A-M].*L"}, "regexp_matches(p_type, '^[A-M].*L')"),
    "filter_between_numeric": ("orders:o_orderkey,o_orderstatus,o_totalprice", {"column": "o_totalprice", "operator": "between", "min": "1000", "max": "150000.5"}, "o_totalprice BETWEEN 1000 AND 150000.5"),
    "filter_between_date": ("orders:o_orderkey,o_orderstatus,o_orderdate", {"column": "o_orderdate", "operator": "between", "min": "1995-01-01", "max": "1996-12-31"}, "o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'"),
    "filter_nested": ("events:event_id,event_type,value", {"combinator": "or", "conditions": [{"column": "event_type", "operator": "eq", "value": "click"}, {"combinator": "and", "conditions": [{"column": "value", "operator": "between", "min": "50"}, {"column": "event_type", "operator": "neq", "value": "view"}]}]}, "event_type = 'click' OR (value >= 50 AND event_type <> 'view')"),
}
for _name, (_table, _where, _cond) in _WHERE.items():
    _key = _table.split(":")[1].split(",")[:2]
    query(_name, _table, sql=f"SELECT {_key[0]}::VARCHAR AS {_key[0]}, {_key[1]} FROM {_table.split(':')[0]} WHERE {_cond}")(lambda t, w=_where, k=_key: op(op(t, "filter_rows", where=w), "drop_columns", columns=[c for c in t.columns if c not in k]).output())
query("filter_delete", "part:p_partkey,p_brand", sql="SELECT p_partkey::VARCHAR AS p_partkey, p_brand FROM part WHERE NOT p_brand = 'Brand#11'")(lambda t: op(t, "filter_rows", where={"column": "p_brand", "operator": "eq", "value": "Brand#11"}, action="delete").output())
query("filter_empty", "part:p_partkey,p_name", sql="SELECT p_partkey::VARCHAR AS p_partkey FROM part WHERE instr(p_name, 'q') = 0 OR p_name LIKE '%q' AND instr(p_name, 'q') = length(p_name)")(
    lambda t: do(t, ("add_extract_column", {"name": "x", "column": "p_name", "mode": "after_sep", "arg": "q"}), ("filter_rows", {"where": {"column": "x", "operator": "is_empty"}}), ("drop_columns", {"columns": ["x", "p_name"]})).output()
)
query("set_value_where_new", "orders:o_orderkey,o_totalprice", sql="SELECT o_orderkey::VARCHAR AS o_orderkey, CASE WHEN o_totalprice >= 100000 THEN 'big' ELSE '' END AS size FROM orders")(
    lambda t: op(op(t, "set_value_where", where={"column": "o_totalprice", "operator": "between", "min": "100000"}, target="size", match_value="big"), "drop_columns", columns=["o_totalprice"]).output()
)
query("set_value_where_existing", "orders:o_orderkey,o_orderstatus", sql="SELECT o_orderkey::VARCHAR AS o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus FROM orders")(
    lambda t: op(t, "set_value_where", where={"column": "o_orderstatus", "operator": "eq", "value": "O"}, target="o_orderstatus", match_value="open").output()
)

_DOCS = "documents:doc_id,text,lang,source"
_short = lambda t: t.df.select("doc_id", F.md5("text").alias("h"), *[q(c) for c in t.columns if c not in ("doc_id", "text")])
_pick = "SELECT doc_id::VARCHAR AS doc_id, md5(text) AS h, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id {}) = 1"
query("dedup_keep_first", _DOCS, sql=_pick.format(""))(lambda t: _short(op(t, "deduplicate", columns=["text"], action="keep_first")))
query("dedup_keep_last", _DOCS, sql=_pick.format("DESC"))(lambda t: _short(op(t, "deduplicate", columns=["text"], action="keep_last")))
query("dedup_keep_most_complete", "events:event_id,user_id,event_type,value", sql="SELECT event_id::VARCHAR AS event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY (event_id % 10 >= 5) DESC, event_id) = 1")(
    lambda t: op(op(do(t, ("add_extract_column", {"name": "e", "column": "event_id", "mode": "last_n", "arg": "1"}), ("set_value_where", {"where": {"column": "e", "operator": "in_list", "values": ["0", "1", "2", "3", "4"]}, "target": "e", "match_value": ""})), "deduplicate", columns=["user_id", "event_type"], action="keep_most_complete"), "drop_columns", columns=["user_id", "event_type", "value", "e"]).output()
)
query("dedup_merge", "events:event_id,user_id,event_type", sql="SELECT min(event_id)::VARCHAR AS event_id, user_id::VARCHAR AS user_id, coalesce(arg_min(CASE WHEN event_id % 10 >= 5 THEN event_type END, CASE WHEN event_id % 10 >= 5 THEN event_id END), '') AS event_type FROM events GROUP BY user_id")(
    lambda t: op(op(t, "set_value_where", where={"column": "event_id", "operator": "regex", "value": "[0-4]$"}, target="event_type", match_value=""), "deduplicate", columns=["user_id"], action="merge_first_nonempty").output()
)
query("dedup_flag", _DOCS, sql="SELECT doc_id::VARCHAR AS doc_id, md5(text) AS h, lang, source, CASE WHEN count(*) OVER (PARTITION BY text) > 1 THEN 'oui' ELSE '' END AS _doublon FROM documents")(lambda t: _short(op(t, "deduplicate", columns=["text"], action="flag_only")))
query("dedup_normalized", "part:p_partkey,p_name", sql="SELECT p_partkey::VARCHAR AS p_partkey, p_name FROM part QUALIFY row_number() OVER (PARTITION BY upper(p_name) ORDER BY p_partkey) = 1")(lambda t: op(t, "deduplicate", columns=["p_name"], mode="normalized").output())
query("dedup_override", "events:event_id,event_type", sql="SELECT event_id::VARCHAR AS event_id, event_type FROM events QUALIFY CASE WHEN event_type = 'click' THEN row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) ELSE row_number() OVER (PARTITION BY event_type ORDER BY event_id) END = 1")(
    lambda t: op(t, "deduplicate", columns=["event_type"], overrides={"click": "keep_last"}).output()
)
query("find_duplicates", "part:p_partkey,p_name", sql="SELECT upper(p_name) AS key, count(*) AS rows FROM part GROUP BY 1 HAVING count(*) > 1")(lambda t: find_duplicates(t, ["p_name"]))
query("diverging_columns", "part:p_name,p_brand,p_type", sql="SELECT p_name AS key, array_to_string(list_filter([CASE WHEN min(p_name) <> max(p_name) THEN 'p_name' END, CASE WHEN min(p_brand) <> max(p_brand) THEN 'p_brand' END, CASE WHEN min(p_type) <> max(p_type) THEN 'p_type' END], lambda x: x IS NOT NULL), ',') AS columns FROM part GROUP BY p_name HAVING count(*) > 1")(
    lambda t: diverging_columns(t, ["p_name"], "exact").select("key", F.array_join("columns", ",").alias("columns"))
)

_ORDERS = ("customer:c_custkey,c_name", "orders:o_orderkey,o_custkey,o_orderstatus,o_totalprice")
_PAIR = [{"left": "c_custkey", "right": "o_custkey"}]
_CTE = "WITH o AS (FROM orders), g AS (SELECT o_custkey, count(*) AS n, first(o_orderstatus ORDER BY o_orderkey) AS f, sum(o_totalprice) AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi, string_agg(o_orderkey::VARCHAR, ', ' ORDER BY o_orderkey) AS c FROM o GROUP BY 1) SELECT c_custkey::VARCHAR AS c_custkey, c_name, {} FROM customer {} JOIN g ON o_custkey = c_custkey"
query("join_exact_left", *_ORDERS, sql=_CTE.format("coalesce(f, '') AS o_orderstatus", "LEFT"))(lambda c, o: op(c, "enrich_join", {"o": o}, table="o", pairs=_PAIR, copied=["o_orderstatus"]).output())
query("join_exact_inner", *_ORDERS, sql=_CTE.format("f AS o_orderstatus", ""))(lambda c, o: op(c, "enrich_join", {"o": o}, table="o", pairs=_PAIR, copied=["o_orderstatus"], type="inner").output())
for _rule, _x in (("min", "lo"), ("max", "hi")):
    query(f"join_aggregate_{_rule}", *_ORDERS, sql=_CTE.format(rf"coalesce(regexp_replace({_x}::VARCHAR, '\.0$', ''), '') AS o_totalprice", "LEFT"))(lambda c, o, r=_rule: op(c, "enrich_join", {"o": o}, table="o", pairs=_PAIR, copied=["o_totalprice"], multiple="aggregate", rules={"o_totalprice": r}).output())
for _rule, _x in (("sum", "s"),):  # sums may differ in their last digits, by the order of adding
    query(f"join_aggregate_{_rule}", *_ORDERS, sql=_CTE.format(f"round({_x}, 2) AS o_totalprice", "LEFT"))(lambda c, o, r=_rule: double(op(c, "enrich_join", {"o": o}, table="o", pairs=_PAIR, copied=["o_totalprice"], multiple="aggregate", rules={"o_totalprice": r}), "o_totalprice"))
query("join_aggregate_concat", *_ORDERS, sql=_CTE.format("coalesce(c, '') AS o_orderkey", "LEFT"))(lambda c, o: op(c, "enrich_join", {"o": o}, table="o", pairs=_PAIR, copied=["o_orderkey"], multiple="aggregate").output())
query("join_flag_conflict", *_ORDERS, sql=_CTE.format("CASE WHEN n = 1 THEN f ELSE '' END AS o_orderstatus", "LEFT"))(lambda c, o: op(c, "enrich_join", {"o": o}, table="o", pairs=_PAIR, copied=["o_orderstatus"], multiple="flag_conflict").output())
query("join_collision", "nation:n_nationkey,n_name,n_regionkey", "region:r_regionkey,r_name", sql="SELECT n_nationkey::VARCHAR AS n_nationkey, n_name AS name, n_regionkey::VARCHAR AS n_regionkey, r_name AS name_droite FROM nation JOIN region ON n_regionkey = r_regionkey")(
    lambda n, r: op(op(n, "rename_columns", renames={"n_name": "name"}), "enrich_join", {"r": op(r, "rename_columns", renames={"r_name": "name"})}, table="r", pairs=[{"left": "n_regionkey", "right": "r_regionkey"}], copied=["name"]).output()
)
query("join_text_key", "part:p_partkey,p_brand", "part:p_partkey,p_brand", sql="SELECT p_partkey::VARCHAR AS p_partkey, p_brand, (SELECT min(b.p_partkey) FROM part b WHERE b.p_brand = a.p_brand)::VARCHAR AS p_partkey_droite FROM part a")(
    lambda a, b: op(a, "enrich_join", {"b": op(b, "normalize_columns", columns=["p_brand"], steps=["lower"])}, table="b", pairs=[{"left": "p_brand", "right": "p_brand", "normalize": "text"}], copied=["p_partkey"]).output()
)
query("join_date_key", "orders:o_orderkey,o_orderdate", "lineitem:l_orderkey,l_shipdate", sql="SELECT o_orderkey::VARCHAR AS o_orderkey, coalesce((SELECT 'x' FROM (SELECT DISTINCT l_shipdate FROM lineitem) WHERE l_shipdate = o_orderdate), '') AS hit FROM orders")(
    lambda o, x: op(op(o, "enrich_join", {"l": op(x, "add_constant_column", name="hit", value="x")}, table="l", pairs=[{"left": "o_orderdate", "right": "l_shipdate", "normalize": "date"}], copied=["hit"]), "drop_columns", columns=["o_orderdate"]).output()
)
query("join_unmatched_left", *_ORDERS, sql="SELECT c_custkey::VARCHAR AS c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")(lambda c, o: unmatched(c, o, _PAIR).output())
query("join_unmatched_right", "labels:doc_id,quality", "documents:doc_id,lang", sql="SELECT doc_id::VARCHAR AS doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")(lambda a, d: unmatched(a, d, [{"left": "doc_id", "right": "doc_id"}], "right").output())
query("join_ambiguous", *_ORDERS, sql="SELECT c_custkey::VARCHAR AS c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)")(lambda c, o: ambiguous(c, o, _PAIR).output())
query("match_counts", *_ORDERS, sql="WITH o AS (FROM orders), n AS (SELECT c_custkey, count(o_custkey) AS n FROM customer LEFT JOIN o ON o_custkey = c_custkey GROUP BY 1) SELECT count(*) FILTER (WHERE n = 1) AS matched, count(*) FILTER (WHERE n > 1) AS ambiguous, count(*) FILTER (WHERE n = 0) AS unmatched_left, (SELECT count(*) FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS unmatched_right FROM n")(lambda c, o: match_counts(c, o, _PAIR))
query("append_rows_mapped", "customer:c_custkey,c_name,c_mktsegment", "supplier:s_suppkey,s_name", sql="SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer UNION ALL SELECT s_suppkey::VARCHAR, s_name, '' FROM supplier")(
    lambda c, s: op(c, "append_rows", {"s": s}, table="s", mapping={"c_custkey": "s_suppkey", "c_name": "s_name"}).output()
)

_AGGS = [{"fn": f, "column": "l_quantity", "name": f} for f in ("count", "countDistinct", "countNonEmpty", "sum", "avg", "min", "max", "median")]
_NUM = ("sum", "avg", "min", "max", "median")
query("summarize_all", "lineitem:l_returnflag,l_linestatus,l_quantity", sql="SELECT l_returnflag, l_linestatus, count(*)::VARCHAR AS count, count(DISTINCT l_quantity)::VARCHAR AS \"countDistinct\", count(*)::VARCHAR AS \"countNonEmpty\", round(sum(l_quantity), 2) AS sum, round(round(avg(l_quantity), 4), 2) AS avg, min(l_quantity) AS min, max(l_quantity) AS max, median(l_quantity) AS median FROM lineitem GROUP BY 1, 2")(
    lambda t: double(op(t, "summarize", group_by=[{"column": "l_returnflag"}, {"column": "l_linestatus"}], aggregates=_AGGS), *_NUM)
)
query("summarize_first_concat", "orders:o_orderkey,o_custkey,o_orderstatus", sql="SELECT o_custkey::VARCHAR AS o_custkey, first(o_orderstatus ORDER BY o_orderkey) AS f, string_agg(o_orderkey::VARCHAR, '|' ORDER BY o_orderkey) AS c FROM orders GROUP BY 1")(
    lambda t: op(t, "summarize", group_by=[{"column": "o_custkey"}], aggregates=[{"fn": "first", "column": "o_orderstatus", "name": "f"}, {"fn": "concat", "column": "o_orderkey", "separator": "|", "name": "c"}]).output()
)
query("summarize_text_norm", "part:p_partkey,p_type", sql="SELECT first(CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) ELSE p_type END ORDER BY p_partkey) AS p_type, count(*)::VARCHAR AS n FROM part GROUP BY upper(p_type)")(
    lambda t: op(t.select({"p_type": F.when(F.col(ORD) % 2 == 0, F.lower("p_type")).otherwise(F.col("p_type"))}), "summarize", group_by=[{"column": "p_type", "normalization": "text"}], aggregates=[{"fn": "count", "name": "n"}]).output()
)
query("summarize_date_norm", "orders:o_orderkey,o_orderdate", sql="SELECT strftime(o_orderdate, '%Y-%m-%d') AS d, count(*)::VARCHAR AS n FROM orders GROUP BY 1")(
    lambda t: op(t.select({"d": F.col("o_orderdate"), "k": F.col("o_orderkey")}), "summarize", group_by=[{"column": "d", "normalization": "date"}], aggregates=[{"fn": "count", "name": "n"}]).output()
)
_EDGES = "(VALUES (0, 10), (10, 20), (20, 30), (30, 60)) b(lo, hi)"
query("summarize_bins_explicit", "lineitem:l_quantity", sql=f"SELECT lo || '–' || hi AS l_quantity, (SELECT count(*) FROM lineitem WHERE l_quantity >= lo AND (l_quantity < hi OR hi = 60 AND l_quantity <= 60))::VARCHAR AS n FROM {_EDGES}")(
    lambda t: op(t, "summarize", group_by=[{"column": "l_quantity", "binning": {"kind": "explicit_boundaries", "boundaries": [0, 10, 20, 30, 60]}}], aggregates=[{"fn": "count", "name": "n"}]).output()
)
query("summarize_bins_width", "lineitem:l_quantity", sql="WITH m AS (SELECT max(l_quantity) AS hi FROM lineitem), b AS (SELECT (15 * i)::INT AS lo, (15 * i + 15)::INT AS hi, 15 * i + 15 >= m.hi AS last FROM range(0, 1000) r(i), m WHERE i = 0 OR 15 * i < m.hi) SELECT lo || '–' || hi AS l_quantity, (SELECT count(*) FROM lineitem WHERE l_quantity >= lo AND (l_quantity < b.hi OR last AND l_quantity <= b.hi))::VARCHAR AS n FROM b")(
    lambda t: op(t, "summarize", group_by=[{"column": "l_quantity", "binning": {"kind": "fixed_width", "width": 15, "start": 0}}], aggregates=[{"fn": "count", "name": "n"}]).output()
)
query("summarize_bins_count", "lineitem:l_quantity", sql="WITH m AS (SELECT min(l_quantity) AS a, max(l_quantity) AS z, (max(l_quantity) - min(l_quantity)) / 7 AS w FROM lineitem), b AS (SELECT i, a + i * w AS lo, CASE WHEN i = 6 THEN z ELSE a + (i + 1) * w END AS hi, i = 6 AS last FROM range(0, 7) r(i), m), t AS (SELECT i, lo, hi, last, CASE WHEN lo = floor(lo) THEN lo::BIGINT::VARCHAR ELSE rtrim(rtrim(round(lo, 4)::DECIMAL(18, 4)::VARCHAR, '0'), '.') END || '–' || CASE WHEN hi = floor(hi) THEN hi::BIGINT::VARCHAR ELSE rtrim(rtrim(round(hi, 4)::DECIMAL(18, 4)::VARCHAR, '0'), '.') END AS label FROM b) SELECT label AS l_quantity, (SELECT count(*) FROM lineitem WHERE l_quantity >= lo AND (l_quantity < t.hi OR last AND l_quantity <= t.hi))::VARCHAR AS n FROM t")(
    lambda t: op(t, "summarize", group_by=[{"column": "l_quantity", "binning": {"kind": "fixed_count", "count": 7}}], aggregates=[{"fn": "count", "name": "n"}]).output()
)
query("summarize_cross_bins", "orders:o_orderstatus,o_totalprice", sql="WITH b(lo, hi) AS (VALUES (0, 50000), (50000, 100000), (100000, 1000000)), s AS (SELECT DISTINCT o_orderstatus FROM orders) SELECT o_orderstatus, lo || '–' || hi AS o_totalprice, (SELECT count(*) FROM orders o WHERE o.o_orderstatus = s.o_orderstatus AND o.o_totalprice >= lo AND o.o_totalprice < hi)::VARCHAR AS n FROM s, b")(
    lambda t: op(t, "summarize", group_by=[{"column": "o_orderstatus"}, {"column": "o_totalprice", "binning": {"kind": "explicit_boundaries", "boundaries": [0, 50000, 100000, 1000000]}}], aggregates=[{"fn": "count", "name": "n"}]).output()
)
query("summarize_global", "events:value", sql="SELECT count(*)::VARCHAR AS n, round(round(avg(value), 4), 2) AS a, round(sum(value), 2) AS s FROM events")(
    lambda t: double(op(t, "summarize", aggregates=[{"fn": "count", "name": "n"}, {"fn": "avg", "column": "value", "name": "a"}, {"fn": "sum", "column": "value", "name": "s"}]), "a", "s")
)

_FUZZY = {"pairs": [{"left": "c_nationkey", "right": "s_nationkey"}], "fuzzy": {"left": ["c_name"], "right": ["s_name"], "high": 70, "low": 50}}
_COMPARED = r"array_to_string(list_sort(string_split(regexp_replace(upper({}), '[\p{{P}}\p{{S}}]', '', 'g'), ' ')), ' ')"
#: Matches are found letter by letter; `taken` marks letters of b that have one. DuckDB's own function halves transpositions to whole numbers.
_JARO = """rec(a, b, i, taken, mine) AS (SELECT DISTINCT a, b, 0, repeat('0', length(b)), '' FROM w UNION ALL
SELECT a, b, i + 1, CASE WHEN j IS NULL THEN taken ELSE left(taken, (j - 1)::INT) || '1' || substr(taken, (j + 1)::INT) END, mine || CASE WHEN j IS NULL THEN '' ELSE a[i + 1] END
FROM (SELECT *, list_min(list_filter(range(greatest(1, i + 1 - reach), least(length(b), i + 1 + reach) + 1), lambda k: b[k] = a[i + 1] AND taken[k] = '0')) AS j
      FROM (SELECT *, greatest(0, greatest(length(a), length(b)) // 2 - 1) AS reach FROM rec WHERE i < length(a)))),
ends AS (SELECT a, b, mine, array_to_string(list_transform(list_filter(range(1, length(b) + 1), lambda k: taken[k] = '1'), lambda k: b[k]), '') AS theirs FROM rec WHERE i = length(a)),
jaro AS (SELECT a, b, CASE WHEN a = b THEN 1.0 WHEN mine = '' THEN 0.0 ELSE (length(mine) / length(a) + length(mine) / length(b) + (length(mine) - len(list_filter(range(1, length(mine) + 1), lambda k: mine[k] <> theirs[k])) / 2) / length(mine)) / 3 END AS j FROM ends)"""
_BEST = f"""WITH RECURSIVE l AS (SELECT *, {_COMPARED.format("c_name")} AS a FROM customer), r AS (SELECT *, {_COMPARED.format("s_name")} AS b FROM supplier),
w AS (SELECT c_custkey, s_suppkey, s_name, a, b FROM l JOIN r ON c_nationkey = s_nationkey), {_JARO},
p AS (SELECT c_custkey, s_suppkey, s_name, a, b, j, (SELECT count(*) FROM range(1, 5) n(k) WHERE a[1:k] = b[1:k] AND k <= least(length(a), length(b))) AS same FROM w JOIN jaro USING (a, b)),
s AS (SELECT *, floor(100 * (j + 0.1 * same * (1 - j) + 1 - levenshtein(a, b) / greatest(length(a), length(b))) / 2 + 0.5)::INT AS score FROM p),
best AS (SELECT c_custkey AS k, s_suppkey, s_name, score FROM s QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, s_suppkey) = 1),
told AS (SELECT l.*, s_suppkey, s_name, score, CASE WHEN score IS NULL THEN 'no_candidate' WHEN score >= 70 THEN 'auto' WHEN score >= 50 THEN 'pending' ELSE 'rejected' END AS status FROM l LEFT JOIN best ON k = c_custkey) """
query("fuzzy_status", "customer:c_custkey,c_name,c_nationkey", "supplier:s_suppkey,s_name,s_nationkey", sql=_BEST + "SELECT c_custkey AS left_ord, s_suppkey AS right_ord, score, status FROM told")(lambda c, s: resolve(c, s, _FUZZY))
query("fuzzy_join", "customer:c_custkey,c_name,c_nationkey", "supplier:s_suppkey,s_name,s_nationkey", sql=_BEST + "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey, CASE WHEN status = 'auto' THEN s_name ELSE '' END AS s_name FROM told")(lambda c, s: op(c, "enrich_join", {"s": s}, table="s", copied=["s_name"], **_FUZZY).output())
query("fuzzy_unmatched_right", "customer:c_custkey,c_name,c_nationkey", "supplier:s_suppkey,s_name,s_nationkey", sql=_BEST + "SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, s_nationkey::VARCHAR AS s_nationkey FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM told WHERE status = 'auto')")(lambda c, s: unmatched_right(c, s, _FUZZY).output())
query("fuzzy_equal_names", "part:p_partkey,p_name,p_brand", "part:p_partkey,p_name,p_brand", sql="SELECT a.p_partkey - 0 AS left_ord, min(b.p_partkey) AS right_ord, 100 AS score, 'auto' AS status FROM part a JOIN part b ON a.p_brand = b.p_brand AND array_to_string(list_sort(string_split(upper(a.p_name), ' ')), ' ') = array_to_string(list_sort(string_split(upper(b.p_name), ' ')), ' ') GROUP BY a.p_partkey")(
    lambda a, b: resolve(a, b, {"pairs": [{"left": "p_brand", "right": "p_brand"}], "fuzzy": {"left": ["p_name"], "right": ["p_name"]}})
)
query("levenshtein_similarity", "part:p_partkey,p_name,p_type", sql="SELECT p_partkey::VARCHAR AS p_partkey, round(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)), 6) AS s FROM part")(lambda t: t.df.select("p_partkey", F.round(levenshtein_similarity(q("p_name"), q("p_type")), 6).alias("s")))
query("token_sorted_key", "part:p_partkey,p_name", sql="SELECT p_partkey::VARCHAR AS p_partkey, array_to_string(list_sort(string_split(upper(p_name), ' ')), ' ') AS k FROM part")(lambda t: t.df.select("p_partkey", token_sorted(q("p_name")).alias("k")))

_CUST = ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
query("profile_columns", "customer:" + ",".join(_CUST), sql=" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS total, count({c}) AS filled, 1.0::DOUBLE AS fill_rate, count(DISTINCT {c}) AS distinct, '{'integer' if c.endswith('key') else 'text'}' AS type, 0::BIGINT AS outer_spaces, 0::BIGINT AS double_spaces, 0::BIGINT AS broken_encoding FROM customer" for c in _CUST))(profile)
query("profile_top_values", "customer:c_mktsegment,c_nationkey", sql=" UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS \"column\", (row_number() OVER (ORDER BY count(*) DESC, min(c_custkey)))::INT AS rank, {c}::VARCHAR AS value, count(*) AS n FROM customer GROUP BY {c}) WHERE rank <= 5" for c in ("c_mktsegment", "c_nationkey")))(top_values)
_CASE = r"CASE WHEN NOT regexp_matches({0}, '[a-zA-ZÀ-ÿ]') THEN NULL WHEN {0} = upper({0}) AND {0} <> lower({0}) THEN 'upper' WHEN {0} = lower({0}) AND {0} <> upper({0}) THEN 'lower' WHEN len(list_filter(string_split_regex({0}, '\s+'), lambda w: w <> '' AND NOT (w[1] = upper(w[1]) AND w[2:] = lower(w[2:])))) = 0 THEN 'title' ELSE 'other' END"
_ODD = "SELECT * FROM (WITH v AS (SELECT doc_id, {0} AS value, {1} AS kind FROM documents WHERE {0} <> ''), m AS (SELECT kind FROM v WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, min(doc_id) LIMIT 1) SELECT '{0}' AS \"column\", (row_number() OVER (ORDER BY doc_id))::INT AS rank, value FROM v WHERE kind <> (SELECT kind FROM m) QUALIFY rank <= 3)"
query("profile_odd_case", "documents:lang,source,text", sql=" UNION ALL ".join(_ODD.format(c, _CASE.format(c)) for c in ("lang", "source", "text")))(odd_case)
query("report_kpis", "orders:o_totalprice,o_custkey", sql="SELECT count(*)::VARCHAR AS orders, round(round(avg(o_totalprice), 4), 2) AS mean, count(DISTINCT o_custkey)::VARCHAR AS customers FROM orders")(
    lambda t: (lambda df: df.select("orders", F.round(F.col("mean").cast("double"), 2).alias("mean"), "customers"))(kpis(t, [{"label": "orders", "aggregate": {"fn": "count"}}, {"label": "mean", "aggregate": {"fn": "avg", "column": "o_totalprice"}}, {"label": "customers", "aggregate": {"fn": "countDistinct", "column": "o_custkey"}}]))
)
query("report_chart", "orders:o_orderpriority", sql="SELECT o_orderpriority, count(*)::VARCHAR AS n FROM orders GROUP BY 1")(lambda t: chart(t, {"x": "o_orderpriority", "series": ["n"], "summarize": {"group_by": [{"column": "o_orderpriority"}], "aggregates": [{"fn": "count", "name": "n"}]}}))
query("report_table", "orders:o_orderkey,o_orderstatus,o_totalprice", sql="SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus FROM orders WHERE o_totalprice >= 150000 ORDER BY orders.o_orderkey LIMIT 50")(
    lambda t: table_block(t, {"columns": ["o_orderkey", "o_orderstatus"], "filter": {"column": "o_totalprice", "operator": "between", "min": "150000"}}).ordered().limit(50)
)
query("pipeline_end_to_end", "orders:o_orderkey,o_custkey,o_orderstatus,o_totalprice", "customer:c_custkey,c_mktsegment", sql="SELECT upper(c_mktsegment) AS c_mktsegment, count(*)::VARCHAR AS n, round(sum(o_totalprice), 0) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice BETWEEN 1000 AND 200000 AND o_orderstatus IN ('F', 'O') GROUP BY 1")(
    lambda o, c: (lambda t: t.df.select("c_mktsegment", "n", F.round(F.col("total").cast("double"), 0).alias("total")))(
        do(
            o,
            ("filter_rows", {"where": {"conditions": [{"column": "o_totalprice", "operator": "between", "min": "1000", "max": "200000"}, {"column": "o_orderstatus", "operator": "in_list", "values": ["F", "O"]}]}}),
            ("enrich_join", {"table": "c", "pairs": [{"left": "o_custkey", "right": "c_custkey"}], "copied": ["c_mktsegment"], "type": "inner"}),
            ("normalize_columns", {"columns": ["c_mktsegment"], "steps": ["trim", "upper"]}),
            ("summarize", {"group_by": [{"column": "c_mktsegment"}], "aggregates": [{"fn": "count", "name": "n"}, {"fn": "sum", "column": "o_totalprice", "name": "total"}]}),
            c=c,
        )
    )
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["pipeline_end_to_end"](spark, sf_dir)
