"""The reports as runnable queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as S
from ..sources.testbed import graph, view, with_sql
from . import exploration as E
from . import reports as P
from .queries import BLAST, CHANGED, FILE_COVERAGE, G, GF, INBOUND, KEY_SYMBOLS, RANKED, ROOTS, SUBS, UP, query, sql_dir, sql_test_file, sql_test_path, suppliers

IMPACT_ROWS = """imp AS (SELECT r.root, count(b.id) AS affected, count(*) FILTER (b.depth = 1) AS direct, count(*) FILTER (b.depth > 1) AS indirect, count(*) FILTER (b.confirmed) AS confirmed, count(*) FILTER (n.kind = 'test') AS tests, count(DISTINCT """ + sql_dir("n.file_path") + """) FILTER (b.depth = 1 AND n.file_path <> '') AS packages
FROM (SELECT DISTINCT root FROM roots) r LEFT JOIN blast b ON b.root = r.root LEFT JOIN nodes n ON n.id = b.id GROUP BY r.root)"""
RISK_ROWS = IMPACT_ROWS + """, amb AS (SELECT r.root, max(d.k) AS definitions FROM roots r JOIN nodes n ON n.id = r.id JOIN (SELECT symbol, count(*) AS k FROM nodes GROUP BY symbol) d ON d.symbol = n.symbol GROUP BY r.root),
unr AS (SELECT r.root, bool_or(n.language IN ('typescript', 'javascript', 'python', 'vue') AND c.file_path IS NULL) AS unresolved, bool_and(n.kind = 'test' OR """ + sql_test_path("n.file_path") + """) AS is_test
FROM roots r JOIN nodes n ON n.id = r.id LEFT JOIN (SELECT DISTINCT project_id, file_path FROM coverage) c ON c.project_id = n.project_id AND c.file_path = n.file_path GROUP BY r.root),
sev AS (SELECT i.*, a.definitions, u.unresolved, u.is_test, CASE WHEN NOT unresolved AND tests = 0 THEN 0.9::DOUBLE ELSE 0 END AS s1, CASE WHEN unresolved THEN 0 WHEN direct >= 10 THEN 0.5::DOUBLE WHEN direct >= 5 THEN 0.3 ELSE 0 END AS s2,
  CASE WHEN NOT unresolved AND packages >= 3 THEN 0.3::DOUBLE ELSE 0 END AS s3, CASE WHEN definitions > 1 THEN 0.2::DOUBLE ELSE 0 END AS s4, CASE WHEN unresolved THEN 0.3::DOUBLE ELSE 0 END AS s5 FROM imp i LEFT JOIN amb a ON a.root = i.root JOIN unr u ON u.root = i.root),
risk AS (SELECT *, floor((1 - (1 - s1) * (1 - s2) * (1 - s3) * (1 - s4) * (1 - s5)) * 1000 + 0.5) / 1000 AS score FROM sev)"""
LEVEL = "CASE WHEN unresolved THEN 'unknown' WHEN score >= 0.67 THEN 'high' WHEN score >= 0.34 THEN 'medium' ELSE 'low' END"
CHANGED_ROOTS = CHANGED + ", roots AS (SELECT id, id AS root FROM changed)"
HG = with_sql("nodes", "edges", "coverage", "hunks")


@query(G + ", " + ROOTS + ", " + BLAST + ", " + IMPACT_ROWS + " SELECT *, tests = 0 AS untested FROM imp")
def impact(spark, sf_dir):
    g = graph(spark, sf_dir)
    return P.impact(g, suppliers(g, spark))


@query(GF + ", " + ROOTS + ", " + BLAST + ", " + RISK_ROWS + f" SELECT root, affected, definitions, score::DOUBLE AS score, {LEVEL} AS level FROM risk")
def risk(spark, sf_dir):
    g = graph(spark, sf_dir)
    return P.risk(g, suppliers(g, spark)).select("root", "affected", "definitions", "score", "level")


@query(HG + ", " + CHANGED_ROOTS + ", " + BLAST + ", " + RISK_ROWS + f" SELECT root, direct, indirect, tests, score::DOUBLE AS score, {LEVEL} AS level, direct >= 8 AS busy FROM risk")
def review(spark, sf_dir):
    return P.review(graph(spark, sf_dir), view(spark, sf_dir, "hunks")).select("root", "direct", "indirect", "tests", "score", "level", "busy")


SUMMARY = """summary AS (SELECT *, unresolved_severity > 0 AS unresolved, floor((1 - (1 - untested) * (1 - fan_in) * (1 - packages) * (1 - ambiguous) * (1 - unresolved_severity)) * 1000 + 0.5) / 1000 AS score,
  CASE WHEN covered = 0 AND uncovered = 0 THEN 'unknown' WHEN covered = 0 THEN 'uncovered' WHEN uncovered = 0 AND unknown = 0 THEN 'covered' ELSE 'partial' END AS coverage
  FROM (SELECT count(*) AS symbols, max(s1) AS untested, max(s2) AS fan_in, max(s3) AS packages, max(s4) AS ambiguous, max(s5) AS unresolved_severity, count(*) FILTER (NOT is_test AND tests > 0) AS covered,
    count(*) FILTER (NOT is_test AND tests = 0 AND NOT unresolved) AS uncovered, count(*) FILTER (NOT is_test AND tests = 0 AND unresolved) AS unknown FROM risk))"""


@query(HG + ", " + CHANGED_ROOTS + ", " + BLAST + ", " + RISK_ROWS + ", " + SUMMARY + f" SELECT symbols, untested, fan_in, packages, ambiguous, unresolved_severity AS unresolved, covered, uncovered, unknown, score::DOUBLE AS score, {LEVEL} AS level, coverage FROM summary")
def review_summary(spark, sf_dir):
    return P.review_summary(P.review(graph(spark, sf_dir), view(spark, sf_dir, "hunks")))


@query(HG + ", " + CHANGED_ROOTS + ", " + BLAST + ", " + RISK_ROWS + ", " + SUMMARY + f" SELECT level, coverage, level = 'high' AS fails_level, coverage IN ('uncovered', 'partial') AND uncovered > 0 AS fails_coverage, level = 'high' OR coverage IN ('uncovered', 'partial') AND uncovered > 0 AS would_fail FROM (SELECT *, {LEVEL} AS level FROM summary)")
def review_gate(spark, sf_dir):
    return P.gate(P.review_summary(P.review(graph(spark, sf_dir), view(spark, sf_dir, "hunks"))), "medium", require_coverage=True)


@query(HG + ", " + CHANGED_ROOTS + ", " + BLAST + """, im AS (SELECT DISTINCT s.file_path AS sf, t.file_path AS tf FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id WHERE e.edge_type = 'imports' AND s.file_path <> t.file_path AND s.language <> 'go'), hf AS (SELECT DISTINCT file_path FROM hunks),
iw AS (SELECT file_path AS place FROM hf UNION SELECT sf FROM iw JOIN im ON im.tf = iw.place WHERE NOT """ + sql_test_file("iw.place") + """)
SELECT file_path AS test_file, 'changed' AS reason FROM hf WHERE """ + sql_test_file("file_path") + """ UNION SELECT n.file_path, 'covers' FROM blast b JOIN nodes n ON n.id = b.id WHERE n.kind = 'test' UNION SELECT place, 'imports' FROM iw WHERE """ + sql_test_file("place") + " AND place NOT IN (SELECT file_path FROM hf)")
def affected_tests(spark, sf_dir):
    return P.affected_tests(graph(spark, sf_dir), view(spark, sf_dir, "hunks"))


@query(G + f""", c AS (SELECT s.file_path AS sf, t.file_path AS tf, s.kind AS sk FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id WHERE e.edge_type = 'calls' AND s.file_path <> t.file_path), f AS (SELECT DISTINCT file_path FROM nodes WHERE starts_with(file_path, 'web/'))
SELECT DISTINCT tf AS file, sf AS related, 'caller' AS reason, 0.9::DOUBLE AS confidence FROM c WHERE tf IN (SELECT * FROM f) UNION SELECT DISTINCT sf, tf, 'callee', 0.7::DOUBLE FROM c WHERE sf IN (SELECT * FROM f) UNION SELECT DISTINCT tf, sf, 'test', 1.0::DOUBLE FROM c WHERE tf IN (SELECT * FROM f) AND (sk = 'test' OR {sql_test_path('sf')})""")
def related_files(spark, sf_dir):
    g = graph(spark, sf_dir)
    return P.related_files(g, g.nodes.where("file_path like 'web/%'").select("file_path").distinct())


DEPS = INBOUND + ", deps AS (SELECT target_file, source_file, edge_type, count(*) AS n, CASE max(CASE WHEN provenance = 'precise' THEN 3 WHEN weight >= 1.0 THEN 2 ELSE 1 END) WHEN 3 THEN 'confirmed' WHEN 2 THEN 'likely' ELSE 'candidate' END AS confidence FROM inbound GROUP BY ALL)"


@query(G + ", " + DEPS.replace("GROUP BY ALL", "GROUP BY target_file, source_file, edge_type") + " SELECT * FROM deps")
def file_dependencies(spark, sf_dir):
    return P.file_dependencies(graph(spark, sf_dir))


@query(G + ", " + DEPS.replace("GROUP BY ALL", "GROUP BY target_file, source_file, edge_type") + " SELECT f.file_path, count(DISTINCT d.source_file) AS dependents, CASE WHEN coalesce(bool_or(d.confidence = 'confirmed'), false) THEN 'unsafe' ELSE 'unknown' END AS delete_verdict FROM (SELECT DISTINCT file_path FROM nodes) f LEFT JOIN deps d ON d.target_file = f.file_path GROUP BY f.file_path")
def file_impact(spark, sf_dir):
    return P.file_impact(graph(spark, sf_dir))


@query(G + ", " + RANKED + ", c AS (SELECT n.*, coalesce(r.in_degree, 0) AS in_degree, coalesce(r.effective, 0) AS effective FROM nodes n LEFT JOIN (SELECT id, in_degree, effective FROM ranked) r ON r.id = n.id WHERE n.kind IN ('function', 'method') AND NOT " + sql_test_path("n.file_path") + """),
e AS (SELECT *, CASE WHEN symbol = 'main' AND kind = 'function' THEN 'main' WHEN starts_with(file_path, 'cmd/') THEN NULL WHEN kind = 'method' AND language = 'go' AND len(string_split(fqn, '.')) >= 3 AND NOT regexp_matches(string_split(fqn, '.')[-2], '^\\p{Lu}') THEN NULL
WHEN regexp_matches(regexp_extract(symbol, '([^.]*)$', 1), '^\\p{Lu}') AND in_degree = 0 THEN 'exported_root' WHEN regexp_matches(regexp_extract(symbol, '([^.]*)$', 1), '^\\p{Lu}') THEN 'exported' END AS reason FROM c),
z AS (SELECT *, floor((0.6::DOUBLE * effective / (SELECT max(effective) FROM ranked) + 0.55::DOUBLE * CASE reason WHEN 'main' THEN 1.0 WHEN 'exported_root' THEN 0.65 WHEN 'exported' THEN 0.35 ELSE 0 END + CASE WHEN reason = 'main' THEN 1 ELSE 0 END) * 1000 + 0.5) / 1000 AS score FROM e)
SELECT id, symbol, file_path, score::DOUBLE AS score, in_degree, effective::DOUBLE AS effective, reason FROM z WHERE score > 0 ORDER BY z.score DESC, z.effective DESC, in_degree DESC, file_path, start_line, fqn, kind, symbol, id LIMIT 20""")
def read_order(spark, sf_dir):
    return P.read_order(graph(spark, sf_dir))


@query(with_sql("files", "later") + ", d AS (SELECT CASE WHEN a.file_path IS NULL THEN 'new' WHEN b.file_path IS NULL THEN 'deleted' ELSE 'changed' END AS c FROM files a FULL JOIN later b ON a.file_path = b.file_path WHERE a.file_hash IS DISTINCT FROM b.file_hash) SELECT count(*) FILTER (c = 'changed') AS changed, count(*) FILTER (c = 'new') AS new, count(*) FILTER (c = 'deleted') AS deleted FROM d")
def staleness(spark, sf_dir):
    return P.staleness(view(spark, sf_dir, "files"), view(spark, sf_dir, "later"))


@query(with_sql("nodes", "edges", "files", "coverage", "annotations") + """ SELECT 'dangling_annotation' AS class, count(*) AS n FROM annotations WHERE kind = 'node' AND target NOT IN (SELECT fqn FROM nodes) AND target NOT IN (SELECT symbol FROM nodes)
UNION ALL SELECT 'name_calls_on_covered_file', count(DISTINCT n.file_path) FROM edges e JOIN nodes n ON n.id = e.source_id WHERE e.edge_type = 'calls' AND e.provenance = 'name' AND n.file_path IN (SELECT file_path FROM coverage) UNION ALL SELECT 'coverage_without_nodes', count(*) FROM coverage WHERE file_path NOT IN (SELECT file_path FROM nodes)""")
def inconsistencies(spark, sf_dir):
    return P.inconsistencies(graph(spark, sf_dir))


@query(GF + ", " + FILE_COVERAGE + " SELECT n.id, CASE WHEN f.covered THEN 'resolved' WHEN n.language IN ('typescript', 'javascript', 'python', 'vue') THEN 'unresolved' ELSE 'name' END AS call_graph FROM nodes n JOIN file_coverage f ON f.file_path = n.file_path WHERE n.kind IN ('function', 'method', 'test')")
def call_graph_labels(spark, sf_dir):
    g = graph(spark, sf_dir)
    return P.call_graph_label(g, g.nodes)


@query(G + ", " + SUBS + ", " + RANKED + ", h AS (SELECT *, " + "row_number() OVER (PARTITION BY s ORDER BY effective DESC, in_degree DESC, file_path, start_line, fqn, kind, symbol, id) AS rn FROM (SELECT r.*, sub.subsystem AS s FROM ranked r JOIN sub ON sub.id = r.id)) SELECT o.subsystem, o.files, h.symbol AS hub FROM (SELECT subsystem, count(DISTINCT file_path) AS files FROM sub GROUP BY subsystem) o LEFT JOIN h ON h.s = o.subsystem AND h.rn = 1")
def architecture_map(spark, sf_dir):
    return P.architecture(graph(spark, sf_dir)).select("subsystem", "files", "hub")


CONTEXT = """deg AS (SELECT target_id AS id, count(*) AS in_degree FROM edges WHERE edge_type = 'calls' GROUP BY target_id), x AS (SELECT DISTINCT r.root, 'caller' AS relation, e.source_id AS id FROM edges e JOIN roots r ON r.id = e.target_id WHERE e.edge_type = 'calls' UNION SELECT DISTINCT r.root, 'callee', e.target_id FROM edges e JOIN roots r ON r.id = e.source_id WHERE e.edge_type = 'calls'),
k AS (SELECT x.root, x.relation, x.id, count(*) OVER (PARTITION BY x.root, relation) AS total, row_number() OVER (PARTITION BY x.root, relation ORDER BY coalesce(deg.in_degree, 0) DESC, n.file_path, n.start_line, n.id)::INT AS position FROM x JOIN nodes n ON n.id = x.id LEFT JOIN deg ON deg.id = x.id)"""


@query(G + ", " + ROOTS + ", " + CONTEXT + " SELECT root, relation, position, total, id FROM k WHERE position <= 25")
def symbol_context(spark, sf_dir):
    g = graph(spark, sf_dir)
    return P.context(g, suppliers(g, spark))


@query("SELECT conv_id, turn, used AS tokens_used FROM (SELECT conv_id, turn, CAST(sum((strlen(coalesce(text, '')) + 3) // 4) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM conversations) WHERE used <= 200")
def turns_within_budget(spark, sf_dir):
    return P.within_budget(view(spark, sf_dir, "conversations"), "conv_id", [F.col("turn")], "text", 200).select("conv_id", "turn", "tokens_used")


@query(with_sql("nodes", "annotations") + """, k AS (SELECT fqn AS e FROM nodes UNION SELECT symbol FROM nodes), x AS (SELECT id, unnest(CASE WHEN kind = 'path' THEN string_split(target, ' -> ') ELSE [target] END) AS e FROM annotations)
SELECT id, kind, target, id IN (SELECT id FROM x WHERE e NOT IN (SELECT e FROM k WHERE e IS NOT NULL)) AS dangling FROM annotations""")
def annotations(spark, sf_dir):
    return E.annotation_list(graph(spark, sf_dir)).select("id", "kind", "target", "dangling")


UP_ = UP.format(d=sql_dir("file_path"))


@query(G + ", " + KEY_SYMBOLS + ", lead AS (SELECT unnest(" + UP_ + """) AS folder, symbol, score, id FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, start_line, fqn, id) AS rn FROM sc) WHERE rn <= 3),
t AS (SELECT folder, string_agg(symbol, ',' ORDER BY rn) AS leading FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY score DESC, symbol, id) AS rn FROM lead) WHERE rn <= 3 GROUP BY folder), f AS (SELECT unnest(""" + UP_ + """) AS folder, file_path FROM (SELECT DISTINCT file_path FROM nodes))
SELECT f.folder, count(*) AS files, any_value(t.leading) AS leading, CASE WHEN f.folder = '' THEN 'root' WHEN regexp_matches(f.folder, '^cmd(/|$)') THEN 'entrypoints' WHEN regexp_matches(f.folder, '^internal(/|$)') THEN 'internal' WHEN regexp_extract(f.folder, '([^/]*)$', 1) = 'web' THEN 'frontend' ELSE 'source' END AS role FROM f LEFT JOIN t ON t.folder = f.folder GROUP BY f.folder""")
def atlas(spark, sf_dir):
    return E.atlas(graph(spark, sf_dir)).select("folder", "files", "leading", "role")


@query(G + ", " + ROOTS + """ SELECT r.root, n.file_path, e.edge_type AS reason, count(*) AS sites, bool_and(e.provenance = 'precise') AS confirmed FROM edges e JOIN roots r ON r.id = e.target_id JOIN nodes n ON n.id = e.source_id WHERE e.edge_type <> 'defines' GROUP BY ALL
UNION ALL SELECT r.root, n.file_path, 'definition', 1, true FROM roots r JOIN nodes n ON n.id = r.id""")
def refactor_sites(spark, sf_dir):
    g = graph(spark, sf_dir)
    return E.refactor_sites(g, suppliers(g, spark))


# Keys are priorities of orders, used at the line where an order's method starts.
USES = "uses AS (SELECT DISTINCT 'KEY_' || substr(o_orderpriority, 1, 1) AS key, n.file_path, n.start_line AS line FROM orders JOIN nodes n ON n.id = 4000000000 + o_orderkey), users AS (SELECT DISTINCT key, id FROM (SELECT u.key, n.id, row_number() OVER (PARTITION BY u.key, u.file_path, u.line ORDER BY n.end_line - n.start_line, n.start_line, n.id) AS rn FROM uses u JOIN nodes n ON n.file_path = u.file_path AND n.start_line <= u.line AND u.line <= n.end_line) WHERE rn = 1)"


def _uses(g, spark, sf_dir):
    orders = view(spark, sf_dir, "orders").select((F.lit(4000000000) + F.col("o_orderkey")).alias("id"), F.concat(F.lit("KEY_"), F.substring("o_orderpriority", 1, 1)).alias("key"))
    return g.nodes.join(orders, "id").select("key", "file_path", F.col("start_line").alias("line")).distinct()


@query()
def key_impact(spark, sf_dir):
    """Of all orders; too slow in SQL, tested against brute force."""
    g = graph(spark, sf_dir)
    return E.key_impact(g, _uses(g, spark, sf_dir))


@query(G + ", " + ROOTS + ", " + USES + ", walk AS (SELECT root, id, 0 AS depth FROM roots UNION SELECT w.root, e.target_id, w.depth + 1 FROM walk w JOIN (SELECT DISTINCT source_id, target_id FROM edges WHERE edge_type = 'calls') e ON e.source_id = w.id WHERE w.depth < 3) SELECT DISTINCT w.root, u.key FROM walk w JOIN users u ON u.id = w.id")
def required_keys(spark, sf_dir):
    g = graph(spark, sf_dir)
    return E.required_keys(g, suppliers(g, spark), _uses(g, spark, sf_dir))


@query()
def explore(spark, sf_dir):
    return E.explore(graph(spark, sf_dir), "Customer building")


@query()
def flow_tree(spark, sf_dir):
    g = graph(spark, sf_dir)
    return E.flow_tree(g, suppliers(g, spark))


@query()
def processes(spark, sf_dir):
    g = graph(spark, sf_dir)
    return E.processes(g, suppliers(g, spark)).select("root", "position", "id", "depth")


@query()
def ranked_processes(spark, sf_dir):
    """Of all suppliers, with the best hits of a search as seeds."""
    g = graph(spark, sf_dir)
    seeds = S.cascade(g.nodes, "medium building order", 20).select("id", F.col("position").alias("rank"))
    return E.ranked_processes(g, suppliers(g, spark).withColumn("place", F.col("root")), seeds)
