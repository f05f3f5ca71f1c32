"""DuckDB SQL of the corpus operators, where SQL can express their results."""

from __future__ import annotations

#: Words of a text, cut at the white space of the contracts.
_SPACE = r"'[\x20\x09-\x0D]+'"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(string_split_regex(coalesce({text}, ''), " + _SPACE + "), lambda w: w <> '')"

def _matches(kind: int, pattern: str, group: int, good: str) -> str:
    """Rows (r, kind, s, e, v) of a pattern's matches: places add up from the pieces between matches."""
    cut = f"SELECT r, string_split_regex(t, {pattern}) AS gaps, regexp_extract_all(t, {pattern}) AS hits, regexp_extract_all(t, {pattern}, {group}) AS vals FROM d"
    each = f"SELECT r, unnest(generate_series(1, len(hits))) AS i, unnest(gaps[1:len(hits)]) AS gap, unnest(hits) AS hit, unnest(vals) AS v FROM ({cut})"
    ends = f"SELECT r, v, length(hit) AS n, sum(length(gap) + length(hit)) OVER (PARTITION BY r ORDER BY i) AS e FROM ({each})"
    return f"SELECT r, {kind} AS kind, (e - n)::BIGINT AS s, e::BIGINT AS e, v FROM ({ends}) WHERE {good}"


_ASSIGN = r"""'(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'"""
_MIXED = "length(v) >= 24 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')"

OP1 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, coalesce(source, '') AS owner FROM documents),
base AS ({_matches(0, _ASSIGN, 2, "length(v) >= 8")} UNION ALL {_matches(1, "'AKIA[A-Z0-9]+'", 0, "length(v) >= 16")} UNION ALL {_matches(2, "'[0-9a-f]+'", 0, "length(v) >= 32")}),
generic AS ({_matches(3, "'[A-Za-z0-9_-]+'", 0, _MIXED)}),
apart AS (SELECT * FROM generic g WHERE NOT EXISTS (FROM base b WHERE b.r = g.r AND b.s < g.e AND g.s < b.e)),
every AS (FROM base UNION ALL FROM apart),
spread AS (SELECT kind, v, count(DISTINCT owner) AS owners, count(DISTINCT coalesce(doc_id, -9223372036854775808)) AS repos FROM every JOIN d USING (r) GROUP BY kind, v),
found AS (SELECT r, kind, s, owners, repos, owners < 2 AND repos < 10 AS live, ['assign', 'access', 'hex', 'generic'][kind + 1] || ':' || s || ':' || e AS span FROM every JOIN spread USING (kind, v) WHERE kind < 3 OR owners < 2 AND repos < 10),
per_row AS (SELECT r, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS k, count(*) FILTER (kind = 2) AS h,
                   string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3) AS b, string_agg(span, ',' ORDER BY s, kind) AS spans,
                   count(*) FILTER (live) AS live, count(*) FILTER (NOT live) AS copied, max(repos) AS repos, max(owners) AS owners FROM found GROUP BY r)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex, sha256(coalesce(b, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(live, 0)::BIGINT AS n_live, coalesce(copied, 0)::BIGINT AS n_copied, coalesce(repos, 0)::BIGINT AS most_repos, coalesce(owners, 0)::BIGINT AS most_owners
FROM d LEFT JOIN per_row USING (r)
"""

OP2 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS.format(text="text")} AS w FROM documents),
win AS (SELECT r, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT r, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, i + j AS i FROM rep, (SELECT unnest(generate_series(0, 34)) AS j)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n
         FROM (SELECT r, unnest(w) AS x, unnest(generate_series(1, len(w))) AS i FROM d) ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

OP3 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, sha256(array_to_string(w[i:i + least(len(w), 4) - 1], ' ')) AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of ON a = d.doc_id
"""

OP9 = rf"""
WITH words AS (SELECT doc_id AS id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t
            FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM words, sizes WHERE len(w) >= n)),
hits AS (SELECT r, i, p.n, item FROM places p JOIN windows v ON p.n = v.n AND p.t = v.t),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM (SELECT r, i, unnest(generate_series(0, n - 1)) AS j FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
named AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS t FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT id AS doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
       sha256(coalesce(named.t, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

OP10 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, r, i, t, translate(regexp_replace(t, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
          FROM (SELECT doc_id, r, unnest(l) AS t, unnest(generate_series(1, len(l))) AS i FROM d)),
often AS (SELECT k, max(coalesce(doc_id, -9223372036854775808)) AS last FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT coalesce(doc_id, -9223372036854775808)) >= 3),
kept AS (SELECT r, string_agg(t, chr(10) ORDER BY i) AS t, count(*) AS n FROM lines LEFT JOIN often USING (k) WHERE last IS NULL OR last = doc_id GROUP BY r)
SELECT doc_id, len(l)::BIGINT AS n_lines, (len(l) - coalesce(n, 0))::BIGINT AS n_dropped, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


OP11 = rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {_WORDS.format(text="text")} AS w FROM documents),
marks AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
least_of AS (SELECT text, min(doc_id) AS least FROM w GROUP BY text),
failed AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                  [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text),
                   regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > least, false)] AS f FROM w JOIN least_of USING (text) LEFT JOIN marks USING (doc_id)),
masks AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 3, 4, 5]) AS k),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.k, b.k, c.k, d.k, e.k] AS ks FROM letters a, letters b, letters c, letters d, letters e
           WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps AS (SELECT filter_order, ks, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
each AS (SELECT part, filter_order, step, ks[step] AS k, f[ks[step]] AS fails, len(list_filter(ks[1:step - 1], lambda i: f[i])) > 0 AS gone, len(list_filter(f, lambda x: x)) AS fs, n, good, toxic FROM masks, steps),
told AS (SELECT part, filter_order, step, k, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
                coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND fs = 1), 0)::BIGINT AS unique_fails,
                coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost FROM each GROUP BY part, filter_order, step, k)
SELECT * EXCLUDE (k), (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM told
"""

OP12 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, max(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1, 2),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_secrets": OP1, "op2_repeated_phrases": OP2, "op3_jaccard_join": OP3, "op9_decontamination": OP9, "op10_line_dedup": OP10, "op11_filter_audit": OP11, "op12_top_products": OP12}
