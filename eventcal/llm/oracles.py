"""SQL twins, for DuckDB, of the queries that SQL can express, written from their contracts."""

from __future__ import annotations

SPACED = r"[^\x20\x09-\x0D]+"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op3() -> str:
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS ws FROM documents),
n AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w),
k AS (SELECT doc_id, s, array_to_string(list_slice(ws, s, s + 19), ' ') AS k FROM n),
f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS nth FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM f WHERE nth > 1),
a AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
t AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY a.p) FILTER (g.p IS NULL) AS kept, count(g.p) AS gone
  FROM a LEFT JOIN g ON g.doc_id = a.doc_id AND g.p = a.p GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN t ON t.doc_id = w.doc_id"""


def op6() -> str:
    return rf"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWERED}, '{PLAIN}') AS ws FROM benchmark),
j AS (SELECT item, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS s FROM i WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item, n, array_to_string(list_slice(ws, s, s + n - 1), ' ') AS k FROM j),
w AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{PLAIN}') AS ws FROM documents),
d AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM w, (SELECT DISTINCT n FROM iw)),
dw AS (SELECT doc_id, n, s, array_to_string(list_slice(ws, s, s + n - 1), ' ') AS k FROM d),
h AS (SELECT doc_id, dw.n, s, item FROM dw JOIN iw ON iw.n = dw.n AND iw.k = dw.k),
p AS (SELECT doc_id, count(DISTINCT p) AS hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY 1),
q AS (SELECT doc_id, count(*) AS items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(hit, 0) AS n_hit, coalesce(items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(hit, 0) > 0 AS contaminated
FROM w LEFT JOIN p ON p.doc_id = w.doc_id LEFT JOIN q ON q.doc_id = w.doc_id"""


def op8() -> str:
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{SPACED}') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) + any_value(b.n) AS n, count(*) AS k
  FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM c WHERE 100 * k >= 80 * (n - k)),
r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, m.c AS component_id
FROM s JOIN (SELECT u, min(v) AS c FROM r GROUP BY 1) m ON m.u = s.doc_id"""


def op10() -> str:
    return """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (SELECT doc_id, x, unnest(range(0, CAST(len(x) // 2 AS BIGINT) - 99)) AS s FROM b),
k AS (SELECT doc_id, s, md5(substr(x, 2 * s + 1, 200)) AS k FROM n),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS nth FROM k),
l AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS opens FROM f WHERE nth > 1),
g AS (SELECT doc_id, s, sum(opens) OVER (PARTITION BY doc_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS g FROM l),
r AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS z FROM g GROUP BY doc_id, g),
e AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS was,
  row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) AS last FROM r),
t AS (SELECT b.doc_id, sum(z - a) AS gone, count(*) AS spans,
  string_agg(substr(x, 2 * was + 1, 2 * (a - was)) || CASE WHEN last = 1 THEN substr(x, 2 * z + 1) ELSE '' END, '' ORDER BY a) AS kept
  FROM e JOIN b ON b.doc_id = e.doc_id GROUP BY 1)
SELECT b.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM b LEFT JOIN t ON t.doc_id = b.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": op3(), "op6_decontamination": op6(), "op8_jaccard_join": op8(), "op10_suffix_dedup": op10()}
