"""SQL (DuckDB) for what SQL can express, by brute force: every window, every pair that shares a shingle, every item."""

from __future__ import annotations

from . import op01_substring_dedup as op1
from . import op02_minhash_dedup as op2
from . import op03_decontaminate as op3

_N = op1.LENGTH
OP1 = f"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, {2 * _N})) AS m FROM (SELECT doc_id, x, unnest(range(0, greatest(len(x) // 2 - {_N - 1}, 0))) AS i FROM h)),
twice AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
f AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w WHERE m IN (SELECT m FROM twice)),
g AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + {_N} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f),
s AS (SELECT doc_id, min(i) AS a, max(i) + {_N} AS b FROM g GROUP BY doc_id, k),
p AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS last FROM s),
r AS (SELECT h.doc_id, any_value(x) AS x, count(p.a) AS n_spans, coalesce(sum(b - a), 0) AS n_removed, coalesce(string_agg(substr(x, 2 * last + 1, 2 * (a - last)), '' ORDER BY a), '') AS head, coalesce(max(b), 0) AS rest FROM h LEFT JOIN p ON p.doc_id = h.doc_id GROUP BY h.doc_id)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256,
       decode(unhex(regexp_replace(kept, '((?:[0-7].)+|[CD].[89AB].|E.[89AB].[89AB].|F.[89AB].[89AB].[89AB].)|..', '\\1', 'g'))) AS text
FROM (SELECT *, head || substr(x, 2 * rest + 1) AS kept FROM r)
"""

_WORD = r"[0-9a-z_\x{80}-\x{10FFFF}]+"
_K = op2.SHINGLE
OP2 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '{_WORD}') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least({_K}, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least({_K}, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= {op2.SIMILARITY} * (x.n + y.n - k) UNION SELECT x.doc_id, y.doc_id FROM d x JOIN d y ON x.text = y.text AND x.doc_id < y.doc_id WHERE len(x.w) = 0),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b)
SELECT a AS doc_id, min(b) AS class_id, a = min(b) AS is_kept FROM reach GROUP BY a
"""

OP3 = rf"""
WITH i AS (SELECT item_id, trim(text) AS text, regexp_extract(trim(text), '(?s)^(.*[.!?])\s+(.*)$', ['q', 'a']) AS s FROM benchmark WHERE text IS NOT NULL),
parts AS (SELECT item_id, 'q' AS part, CASE WHEN s.q = '' THEN text ELSE s.q END AS t FROM i UNION ALL SELECT item_id, 'a', CASE WHEN s.q = '' THEN text ELSE s.a END FROM i),
pw AS (SELECT item_id, part, regexp_extract_all(lower(t), '{_WORD}') AS w FROM parts),
pg AS (SELECT DISTINCT item_id, part, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT *, least({op3.SHINGLE}, len(w)) AS k, unnest(range(1, len(w) - least({op3.SHINGLE}, len(w)) + 2)) AS i FROM pw WHERE len(w) > 0)),
size AS (SELECT item_id, part, count(*) AS n FROM pg GROUP BY item_id, part),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM pg))),
hit AS (SELECT doc_id, item_id, part, count(*) AS n FROM dg JOIN pg USING (k, g) GROUP BY doc_id, item_id, part),
share AS (SELECT doc_id, item_id, max(hit.n / size.n::DOUBLE) FILTER (part = 'q') AS q, max(hit.n / size.n::DOUBLE) FILTER (part = 'a') AS a FROM hit JOIN size USING (item_id, part) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, q AS question_overlap, a AS answer_overlap FROM share WHERE q >= {op3.OVERLAP} AND a >= {op3.OVERLAP}
"""
