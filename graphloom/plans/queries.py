"""Runnable queries over the projected graph, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, paths, scores
from ..operators import aggregates as A
from ..operators import maintenance as M
from ..operators import relations as R
from ..operators import search as S
from ..operators import text_index as X
from ..operators import traverse as T
from ..schema import Graph
from ..sources.testbed import graph, text_index, view, with_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return register


# SQL of the path functions.
_DIR = "regexp_extract({p}, '^(.*)/[^/]*$', 1)"
_BASE = "regexp_extract({p}, '([^/]*)$', 1)"


def sql_dir(p: str) -> str:
    return _DIR.format(p=p)


def sql_subsystem(p: str) -> str:
    d = sql_dir(p)
    return f"CASE WHEN {d} = '' THEN '(root)' WHEN split_part({d}, '/', 1) IN ('internal', 'cmd', 'pkg') AND split_part({d}, '/', 2) <> '' THEN split_part({d}, '/', 1) || '/' || split_part({d}, '/', 2) ELSE split_part({d}, '/', 1) END"


def sql_test_path(p: str) -> str:
    return f"(regexp_matches(lower({_BASE.format(p=p)}), '(_test\\.go|_test\\.py|_spec\\.rb|_test\\.rb|_spec\\.lua|_test\\.lua|\\.(test|spec)\\.(ts|tsx|js|jsx|mjs|cjs))$|^test_.*\\.py$') OR list_has_any(string_split(lower({sql_dir(p)}), '/'), ['testdata', '__tests__', '__mocks__', 'test', 'tests']))"


def sql_test_file(p: str) -> str:
    return f"regexp_matches(lower({_BASE.format(p=p)}), '(_test\\.go|_test\\.py|_spec\\.rb|_test\\.rb|_spec\\.lua|_test\\.lua|\\.(test|spec)\\.(ts|tsx|js|jsx|mjs|cjs))$|^test_.*\\.py$')"


G = with_sql("nodes", "edges")
GF = with_sql("nodes", "edges", "files", "coverage")


def suppliers(g: Graph, spark: SparkSession) -> DataFrame:
    """Roots of the walks: all suppliers, the testbed's classes."""
    return g.nodes.where("kind = 'class'").select("id", F.col("id").alias("root"))


ROOTS = "roots AS (SELECT id, id AS root FROM nodes WHERE kind = 'class')"

# --- scans and lookups


@query(G + " SELECT id, symbol, fqn, kind, file_path, start_line FROM nodes WHERE symbol IN ('Customer#000000010', 'EUROPE') AND kind <> 'file'")
def nodes_by_symbol(spark, sf_dir):
    g = graph(spark, sf_dir)
    ids = R.roots_by_symbol(g, ["Customer#000000010", "EUROPE", ""])
    return g.nodes.join(ids, "id", "left_semi").select("id", "symbol", "fqn", "kind", "file_path", "start_line")


@query(G + " SELECT id, symbol, kind, start_line, end_line FROM nodes WHERE file_path = 'internal/geo/nation.go'")
def file_outline(spark, sf_dir):
    return graph(spark, sf_dir).nodes.where("file_path = 'internal/geo/nation.go'").select("id", "symbol", "kind", "start_line", "end_line")


@query(GF + " SELECT file_path, file_hash, size_bytes FROM files")
def indexed_files(spark, sf_dir):
    return graph(spark, sf_dir).files.select("file_path", "file_hash", "size_bytes")


@query(GF + " SELECT file_path, CASE regexp_extract(file_path, '\\.([^./]+)$', 1) WHEN 'go' THEN 'go' WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' END AS language, regexp_matches(file_path, '^internal/part(/.*)?$') OR regexp_matches(file_path, '(^|/)[^/]*_test\\.go(/|$)') AS excluded FROM files")
def scan_routing(spark, sf_dir):
    p = F.col("file_path")
    return graph(spark, sf_dir).files.select(p, paths.language(p).alias("language"), paths.matches_any_glob(p, ["internal/part", "*_test.go"]).alias("excluded"))


# --- joins


@query(G + ", " + ROOTS + ", deg AS (SELECT target_id AS id, count(*) AS in_degree FROM edges WHERE edge_type = 'calls' GROUP BY target_id) SELECT DISTINCT r.root, n.id, n.symbol, n.file_path, coalesce(d.in_degree, 0) AS in_degree FROM edges e JOIN roots r ON e.target_id = r.id JOIN nodes n ON n.id = e.source_id LEFT JOIN deg d ON d.id = n.id WHERE e.edge_type = 'calls'")
def callers(spark, sf_dir):
    g = graph(spark, sf_dir)
    return R.callers(g, suppliers(g, spark)).select("root", "id", "symbol", "file_path", "in_degree")


@query(G + ", " + ROOTS + ", deg AS (SELECT target_id AS id, count(*) AS in_degree FROM edges WHERE edge_type = 'calls' GROUP BY target_id) SELECT DISTINCT r.root, n.id, n.symbol, n.file_path, coalesce(d.in_degree, 0) AS in_degree FROM edges e JOIN roots r ON e.source_id = r.id JOIN nodes n ON n.id = e.target_id LEFT JOIN deg d ON d.id = n.id WHERE e.edge_type = 'calls'")
def callees(spark, sf_dir):
    g = graph(spark, sf_dir)
    return R.callees(g, suppliers(g, spark)).select("root", "id", "symbol", "file_path", "in_degree")


FILE_COVERAGE = "file_coverage AS (SELECT f.file_path, l.language, c.resolver IS NOT NULL AS covered, c.resolver FROM files f LEFT JOIN (SELECT file_path, min(language) AS language FROM nodes GROUP BY file_path) l ON f.file_path = l.file_path LEFT JOIN coverage c ON c.file_path = f.file_path)"


@query(GF + ", " + FILE_COVERAGE + " SELECT file_path, language, covered, resolver FROM file_coverage")
def file_coverage(spark, sf_dir):
    return R.file_coverage(graph(spark, sf_dir)).drop("project_id")


@query(GF + " SELECT file_path, resolver FROM coverage WHERE file_path NOT IN (SELECT file_path FROM nodes)")
def coverage_without_nodes(spark, sf_dir):
    return R.coverage_without_nodes(graph(spark, sf_dir)).select("file_path", "resolver")


@query(G + " SELECT id, symbol, file_path, start_line FROM nodes WHERE kind IN ('function', 'method') AND id NOT IN (SELECT target_id FROM edges WHERE edge_type IN ('calls', 'references')) AND id NOT IN (SELECT source_id FROM edges WHERE edge_type = 'overrides')")
def orphans(spark, sf_dir):
    return R.orphans(graph(spark, sf_dir)).select("id", "symbol", "file_path", "start_line")


@query(G + " SELECT id FROM nodes WHERE id IN (SELECT target_id FROM edges WHERE edge_type = 'calls' AND provenance = 'name')")
def nodes_with_name_callers(spark, sf_dir):
    return R.with_name_callers(graph(spark, sf_dir)).select("id")


@query(GF + " SELECT n.file_path, count(*) AS name_edges FROM edges e JOIN nodes n ON n.id = e.source_id JOIN (SELECT DISTINCT file_path FROM coverage) c ON c.file_path = n.file_path WHERE e.edge_type = 'calls' AND e.provenance = 'name' GROUP BY n.file_path")
def name_calls_on_covered_files(spark, sf_dir):
    return R.name_calls_on_covered_files(graph(spark, sf_dir))


OVERRIDES = """classes AS (SELECT c_custkey AS k, min(c_custkey) OVER (PARTITION BY c_nationkey) AS base, c_name FROM customer),
methods AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS symbol, 7000000000 + o_custkey * 10 + CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS id FROM orders)"""


@query("WITH " + OVERRIDES + " SELECT DISTINCT a.id AS source_id, b.id AS target_id FROM classes c JOIN methods a ON a.k = c.k JOIN methods b ON b.k = c.base AND b.symbol = a.symbol WHERE c.k <> c.base")
def overrides(spark, sf_dir):
    customer, orders = (view(spark, sf_dir, t) for t in ("customer", "orders"))
    base = customer.groupBy("c_nationkey").agg(F.min("c_custkey").alias("base"))
    classes = customer.select((F.lit(3000000000) + F.col("c_custkey")).alias("id"), F.col("c_name").alias("symbol"), F.col("c_name").alias("fqn"), F.lit("class").alias("kind"))
    methods = orders.join(customer, orders.o_custkey == customer.c_custkey).select((F.lit(7000000000) + F.col("o_custkey") * 10 + F.substring("o_orderpriority", 1, 1).cast("long")).alias("id"), F.col("o_orderpriority").alias("symbol"), F.concat_ws(".", "c_name", "o_orderpriority").alias("fqn"), F.lit("method").alias("kind")).distinct()
    nodes = classes.unionByName(methods).withColumn("project_id", F.lit(1))
    edges = customer.join(base, "c_nationkey").where("c_custkey <> base").select((F.lit(3000000000) + F.col("c_custkey")).alias("source_id"), (F.lit(3000000000) + F.col("base")).alias("target_id"), F.lit("extends").alias("edge_type"))
    return R.overrides(Graph(nodes, edges))


@query(with_sql("nodes", "positions") + """ SELECT position_id, file_path, line, id, symbol FROM (SELECT p.position_id, p.file_path, p.line, n.id, n.symbol, row_number() OVER (PARTITION BY p.position_id ORDER BY n.end_line - n.start_line, n.start_line, n.id) AS rn
FROM positions p JOIN nodes n ON n.file_path = p.file_path AND n.start_line <= p.line AND p.line <= n.end_line) WHERE rn = 1""")
def symbol_at(spark, sf_dir):
    return R.enclosing(graph(spark, sf_dir), view(spark, sf_dir, "positions")).select("position_id", "file_path", "line", "id", "symbol")


@query(with_sql("nodes", "positions") + """ SELECT position_id, id, symbol, start_line FROM (SELECT p.position_id, n.id, n.symbol, n.start_line,
row_number() OVER (PARTITION BY p.position_id ORDER BY CASE n.start_line - p.line WHEN 0 THEN 0 WHEN -1 THEN 1 WHEN 1 THEN 2 WHEN -2 THEN 3 ELSE 4 END, n.start_line - n.end_line, n.id) AS rn
FROM positions p JOIN nodes n ON n.file_path = p.file_path AND abs(n.start_line - p.line) <= 2) WHERE rn = 1""")
def nearest_declaration(spark, sf_dir):
    return R.nearest_declaration(graph(spark, sf_dir), view(spark, sf_dir, "positions")).select("position_id", "id", "symbol", "start_line")


CHANGED = "changed AS (SELECT DISTINCT n.* FROM nodes n JOIN hunks h ON n.file_path = h.file_path AND (h.status IN ('D', '?', 'R') OR (h.start_line <= n.end_line AND n.start_line <= h.end_line) OR (n.start_line <= h.deletion_point AND n.end_line >= h.deletion_point + 1)) WHERE n.kind <> 'file')"


@query(with_sql("nodes", "hunks") + ", " + CHANGED + " SELECT id, symbol, file_path FROM changed")
def changed_symbols(spark, sf_dir):
    return R.changed_symbols(graph(spark, sf_dir), view(spark, sf_dir, "hunks")).select("id", "symbol", "file_path")


@query(with_sql("nodes", "edges", "refs") + """, src AS (SELECT fqn, max(id) AS id FROM nodes GROUP BY fqn),
located AS (SELECT r.*, n.id AS source_id, """ + sql_dir("n.file_path") + """ AS source_dir, CASE WHEN n.language IN ('typescript', 'javascript', 'vue') THEN 'web' ELSE n.language END AS source_family FROM refs r JOIN src s ON s.fqn = r.from_fqn JOIN nodes n ON n.id = s.id),
named AS (SELECT l.ref_id, l.source_id, n.id AS target_id, l.kind, l.qualified, source_dir = """ + sql_dir("n.file_path") + """ AS near FROM located l JOIN nodes n ON n.symbol = l.to_name AND l.to_fqn IS NULL
  WHERE CASE WHEN n.language IN ('typescript', 'javascript', 'vue') THEN 'web' ELSE n.language END = source_family),
kept AS (SELECT * FROM (SELECT *, max(CAST(near AS INT)) OVER (PARTITION BY ref_id) AS any_near FROM named) WHERE qualified OR any_near = 0 OR near)
SELECT ref_id, source_id, target_id, kind, CASE WHEN qualified THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS weight, 'name' AS provenance FROM kept WHERE source_id <> target_id
UNION ALL SELECT ref_id, source_id, s.id, kind, 1.0::DOUBLE, 'precise' FROM located JOIN src s ON s.fqn = to_fqn WHERE source_id <> s.id""")
def resolve_references(spark, sf_dir):
    return R.resolve_references(graph(spark, sf_dir), view(spark, sf_dir, "refs")).select("ref_id", "source_id", "target_id", "kind", "weight", "provenance")


@query(G + """, roots AS (SELECT id FROM nodes WHERE kind = 'module') SELECT DISTINCT root, direction, edge_type, h.id, n.symbol FROM (
SELECT source_id AS root, 'super' AS direction, edge_type, target_id AS id FROM edges JOIN roots ON roots.id = source_id WHERE edge_type = 'extends' UNION ALL SELECT target_id, 'sub', edge_type, source_id FROM edges JOIN roots ON roots.id = target_id WHERE edge_type = 'extends') h JOIN nodes n ON n.id = h.id""")
def hierarchy(spark, sf_dir):
    g = graph(spark, sf_dir)
    return R.hierarchy(g, g.nodes.where("kind = 'module'").select("id", F.col("id").alias("root"))).select("root", "direction", "edge_type", "id", "symbol")


@query(G + """, r AS (SELECT e.source_id, e.target_id, n.symbol AS target_symbol, e.provenance FROM edges e JOIN nodes n ON n.id = e.target_id WHERE e.edge_type = 'references')
SELECT r.*, (SELECT count(DISTINCT target_id) FROM r x WHERE x.source_id = r.source_id AND x.target_symbol = r.target_symbol) > 1 AS ambiguous FROM r""")
def references(spark, sf_dir):
    return R.references(graph(spark, sf_dir))


INBOUND = """inbound AS (SELECT source_id, target_id, edge_type, source_file, target_file, provenance, weight FROM (SELECT e.*, s.file_path AS source_file, t.file_path AS target_file,
row_number() OVER (PARTITION BY e.source_id, e.target_id, e.edge_type ORDER BY CASE WHEN e.provenance = 'precise' THEN 0 ELSE 1 END, e.weight DESC) AS rn
FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id WHERE s.file_path <> t.file_path AND e.edge_type <> 'defines') WHERE rn = 1)"""


@query(G + ", " + INBOUND + " SELECT * FROM inbound")
def inbound_file_dependencies(spark, sf_dir):
    return R.inbound_file_dependencies(graph(spark, sf_dir))


@query(G + " SELECT DISTINCT t.file_path AS target_file, s.file_path AS source_file FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id WHERE e.edge_type IN ('imports', 'extends') AND t.file_path IN ('internal/geo/nation.go', 'cmd/geo/region.go') AND s.file_path <> t.file_path")
def source_files_targeting(spark, sf_dir):
    wanted = spark.createDataFrame([("internal/geo/nation.go",), ("cmd/geo/region.go",)], "file_path string")
    return R.source_files_targeting(graph(spark, sf_dir), wanted, ("imports", "extends"))


@query(with_sql("nodes", "refs") + """, src AS (SELECT fqn, max(id) AS id FROM nodes GROUP BY fqn) SELECT DISTINCT n.file_path FROM refs r JOIN src s ON s.fqn = r.from_fqn JOIN nodes n ON n.id = s.id WHERE r.to_fqn IS NOT NULL AND r.to_fqn NOT IN (SELECT fqn FROM nodes)
AND r.to_name IN (SELECT s_name FROM supplier)""")
def files_to_heal(spark, sf_dir):
    g, refs = graph(spark, sf_dir), view(spark, sf_dir, "refs")
    known = g.nodes.select(F.col("fqn").alias("to_fqn"))
    sources = g.nodes.groupBy(F.col("fqn").alias("from_fqn")).agg(F.max_by(F.struct("project_id", "file_path"), "id").alias("s"))
    unresolved = refs.where("to_fqn is not null").join(known, "to_fqn", "left_anti").join(sources, "from_fqn").select("s.*", "to_name")
    changed = view(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))
    return R.files_to_heal(unresolved, changed).select("file_path")


@query(with_sql("nodes", "annotations") + " SELECT n.id, n.symbol, string_agg(DISTINCT a.note, '|' ORDER BY a.note) AS notes FROM nodes n JOIN annotations a ON a.kind = 'node' AND (a.target = n.fqn OR a.target = n.symbol) GROUP BY n.id, n.symbol")
def annotated_nodes(spark, sf_dir):
    g = graph(spark, sf_dir)
    return R.annotated(g.nodes, g.annotations).select("id", "symbol", F.array_join(F.array_sort(F.array_distinct("notes.note")), "|").alias("notes"))


@query(G + """, s AS (SELECT id AS selector_id, file_path, fqn, start_line, kind FROM nodes WHERE kind = 'type'), m AS (SELECT s.selector_id, n.id, n.start_line, n.start_line = s.start_line AS exact FROM nodes n JOIN s ON n.file_path = s.file_path AND n.fqn = s.fqn AND n.kind = s.kind),
k AS (SELECT *, bool_or(exact) OVER (PARTITION BY selector_id) AS any_exact FROM m) SELECT selector_id, id, count(*) OVER (PARTITION BY selector_id) AS matches FROM k WHERE exact OR NOT any_exact""")
def selector_resolution(spark, sf_dir):
    g = graph(spark, sf_dir)
    wanted = g.nodes.where("kind = 'type'").select(F.col("id").alias("selector_id"), "file_path", "fqn", "start_line", "kind")
    return R.resolve_selector(g.nodes, wanted).select("selector_id", "id", "matches")


@query(G + """, w(name) AS (VALUES ('geo.EUROPE'), ('Customer#000000001.Order#1'), ('nation.FRANCE'), ('Customer#000000007')), e AS (SELECT w.name, n.id, 0 AS tier FROM w JOIN nodes n ON n.fqn = w.name),
s AS (SELECT w.name, n.id, 1 AS tier, n.symbol FROM w JOIN nodes n ON ends_with(n.fqn, '.' || w.name) WHERE w.name NOT IN (SELECT name FROM e))
SELECT * FROM e UNION ALL SELECT name, id, tier FROM s WHERE name IN (SELECT name FROM s GROUP BY name HAVING count(DISTINCT symbol) = 1)""")
def qualified_names(spark, sf_dir):
    wanted = spark.createDataFrame([("geo.EUROPE",), ("Customer#000000001.Order#1",), ("nation.FRANCE",), ("Customer#000000007",)], "name string")
    return R.resolve_qualified(graph(spark, sf_dir).nodes, wanted)


# --- aggregates


@query(G + " SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(DISTINCT file_path) FROM nodes) AS files, (SELECT count(*) FROM edges) AS edges")
def project_stats(spark, sf_dir):
    return A.stats(graph(spark, sf_dir)).drop("project_id")


@query(G + " SELECT language, kind, count(*) AS n FROM nodes GROUP BY language, kind")
def nodes_by_kind(spark, sf_dir):
    return A.count_by(graph(spark, sf_dir).nodes, "language", "kind")


@query(G + " SELECT edge_type, provenance, count(*) AS n FROM edges GROUP BY edge_type, provenance")
def edges_by_provenance(spark, sf_dir):
    return A.count_by(graph(spark, sf_dir).edges, "edge_type", "provenance")


@query(G + " SELECT n.id, n.symbol, h.in_degree FROM (SELECT target_id, count(*) AS in_degree FROM edges WHERE edge_type = 'calls' GROUP BY target_id) h JOIN nodes n ON n.id = h.target_id WHERE n.kind <> 'file' ORDER BY in_degree DESC, file_path, start_line, fqn, kind, symbol, n.id LIMIT 20")
def hotspots(spark, sf_dir):
    return A.hotspots(graph(spark, sf_dir)).select("id", "symbol", "in_degree")


RANKED = """ranked AS (SELECT n.*, c.in_degree, c.precise_in, c.in_degree - c.precise_in AS name_in, greatest(d.definitions, 1) AS shared_defs, c.precise_in + (c.in_degree - c.precise_in) / greatest(d.definitions, 1)::DOUBLE AS effective
FROM (SELECT e.target_id, count(*) AS in_degree, count(*) FILTER (e.provenance = 'precise') AS precise_in FROM edges e JOIN nodes s ON s.id = e.source_id WHERE e.edge_type = 'calls' AND s.kind <> 'test' AND NOT """ + sql_test_path("s.file_path") + """ GROUP BY e.target_id) c
JOIN nodes n ON n.id = c.target_id LEFT JOIN (SELECT symbol, count(*) AS definitions FROM nodes WHERE kind <> 'file' GROUP BY symbol) d ON d.symbol = n.symbol WHERE n.kind NOT IN ('file', 'test') AND NOT """ + sql_test_path("n.file_path") + ")"


@query(G + ", " + RANKED + " SELECT id, symbol, file_path, in_degree, precise_in, name_in, shared_defs, round(effective, 6) AS effective FROM ranked")
def ranked_hotspots(spark, sf_dir):
    return A.ranked_hotspots(graph(spark, sf_dir)).select("id", "symbol", "file_path", "in_degree", "precise_in", "name_in", "shared_defs", F.round("effective", 6).alias("effective"))


@query(G + " SELECT target_id, count(*) AS wired FROM edges WHERE edge_type = 'references' GROUP BY target_id")
def wired_targets(spark, sf_dir):
    return A.wired_counts(graph(spark, sf_dir))


@query(G + " SELECT symbol, count(*) AS definitions FROM nodes WHERE kind <> 'file' GROUP BY symbol")
def definition_counts(spark, sf_dir):
    return A.definition_counts(graph(spark, sf_dir)).drop("project_id")


SUBS = "sub AS (SELECT id, file_path, kind, " + sql_subsystem("file_path") + " AS subsystem FROM nodes), flow AS (SELECT e.*, s.subsystem AS ss, t.subsystem AS ts, s.file_path AS sf, t.file_path AS tf FROM edges e JOIN sub s ON s.id = e.source_id JOIN sub t ON t.id = e.target_id WHERE e.edge_type <> 'defines')"


@query(G + ", " + SUBS + """ SELECT o.subsystem, o.files, o.symbols, (SELECT count(*) FROM flow WHERE ss = o.subsystem AND ts = ss) AS internal, (SELECT count(*) FROM flow WHERE ss = o.subsystem AND ts <> ss) AS outgoing, (SELECT count(*) FROM flow WHERE ts = o.subsystem AND ts <> ss) AS incoming
FROM (SELECT subsystem, count(DISTINCT file_path) AS files, count(*) FILTER (kind <> 'file') AS symbols FROM sub GROUP BY subsystem) o""")
def subsystem_rollup(spark, sf_dir):
    return A.subsystem_rollup(graph(spark, sf_dir))


@query(G + ", " + SUBS + """ SELECT ss AS source_subsystem, ts AS target_subsystem, edge_type, count(*) AS n, count(*) FILTER (provenance = 'precise') AS precise, array_to_string(list_sort(list_distinct(list(sf)))[1:5], ',') AS source_files, count(DISTINCT sf) AS source_files_total,
array_to_string(list_sort(list_distinct(list(tf)))[1:5], ',') AS target_files, count(DISTINCT tf) AS target_files_total FROM flow WHERE ss <> ts GROUP BY ss, ts, edge_type""")
def subsystem_bridges(spark, sf_dir):
    return A.bridges(graph(spark, sf_dir))


@query(GF + ", " + FILE_COVERAGE + """, d AS (SELECT *, """ + sql_dir("file_path") + """ AS folder FROM file_coverage WHERE language IS NOT NULL)
SELECT 'language' AS scope, language AS name, count(*) AS files, count(*) FILTER (covered) AS covered, count(*) FILTER (covered) / count(*)::DOUBLE AS ratio FROM d GROUP BY language
UNION ALL SELECT 'folder', folder, count(*), count(*) FILTER (covered), count(*) FILTER (covered) / count(*)::DOUBLE FROM d GROUP BY folder UNION ALL SELECT 'all', '', count(*), count(*) FILTER (covered), count(*) FILTER (covered) / count(*)::DOUBLE FROM d""")
def coverage_rollup(spark, sf_dir):
    return A.coverage_rollup(R.file_coverage(graph(spark, sf_dir)))


UP = "CASE WHEN {d} = '' THEN [''] ELSE list_prepend('', list_transform(range(1, len(string_split({d}, '/')) + 1), lambda k: array_to_string(string_split({d}, '/')[1:k], '/'))) END"


@query(G + ", f AS (SELECT file_path, count(*) FILTER (kind <> 'file') AS symbols FROM nodes GROUP BY file_path), u AS (SELECT unnest(" + UP.format(d=sql_dir("file_path")) + ") AS folder, symbols FROM f) SELECT folder, count(*) AS files, CAST(sum(symbols) AS BIGINT) AS symbols FROM u GROUP BY folder")
def folder_rollup(spark, sf_dir):
    return A.folder_rollup(graph(spark, sf_dir))


@query(G + ", d AS (SELECT id, " + sql_dir("file_path") + " AS d FROM nodes), p AS (SELECT s.d AS a, t.d AS b, count(*) AS n FROM edges e JOIN d s ON s.id = e.source_id JOIN d t ON t.id = e.target_id WHERE e.edge_type <> 'defines' GROUP BY s.d, t.d), q AS (SELECT n, " + UP.format(d="a") + " AS ua, " + UP.format(d="b") + """ AS ub FROM p),
w AS (SELECT unnest(ua) AS folder, n, ub, 1 AS side, ua FROM q UNION ALL SELECT unnest(ub), n, ub, 2, ua FROM q)
SELECT folder, CAST(coalesce(sum(n) FILTER (side = 1 AND list_contains(ub, folder)), 0) AS BIGINT) AS internal, CAST(coalesce(sum(n) FILTER (side = 1 AND NOT list_contains(ub, folder)), 0) AS BIGINT) AS outgoing, CAST(coalesce(sum(n) FILTER (side = 2 AND NOT list_contains(ua, folder)), 0) AS BIGINT) AS incoming FROM w GROUP BY folder""")
def folder_flows(spark, sf_dir):
    return A.folder_flows(graph(spark, sf_dir))


KEY_SYMBOLS = """inc AS (SELECT target_id AS id, count(*) FILTER (edge_type = 'calls' AND provenance = 'precise') AS p, count(*) FILTER (edge_type = 'calls' AND provenance <> 'precise') AS m, count(*) FILTER (edge_type = 'references') AS r FROM edges GROUP BY target_id),
ba AS (SELECT n.*, coalesce(p, 0) + coalesce(m, 0) / d.k::DOUBLE + 0.5 * coalesce(r, 0) AS base, """ + sql_dir("n.file_path") + """ AS dir FROM nodes n LEFT JOIN inc ON inc.id = n.id JOIN (SELECT symbol, count(*) AS k FROM nodes GROUP BY symbol) d ON d.symbol = n.symbol WHERE n.kind NOT IN ('file', 'test')),
mem AS (SELECT dir, regexp_extract(fqn, '^(.*)\\.[^.]*$', 1) AS fqn, sum(base) AS of_members FROM ba WHERE kind = 'method' AND contains(fqn, '.') GROUP BY 1, 2),
sc AS (SELECT ba.id, ba.file_path, ba.symbol, ba.start_line, ba.fqn, floor((base + CASE WHEN kind IN ('type', 'class') THEN 0.3 * coalesce(of_members, 0) ELSE 0 END) * CASE WHEN regexp_matches(regexp_extract(ba.symbol, '([^.]*)$', 1), '^\\p{Lu}') THEN 1.0 WHEN coalesce(docstring, '') <> '' THEN 0.8 ELSE 0.4 END * 1000 + 0.5) / 1000 AS score
FROM ba LEFT JOIN mem ON mem.dir = ba.dir AND mem.fqn = ba.fqn)"""


@query(G + ", " + KEY_SYMBOLS + " SELECT file_path, rn, id, symbol, score::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, start_line, fqn, id)::INT AS rn FROM sc) WHERE rn <= 3")
def key_symbols(spark, sf_dir):
    return A.key_symbols(graph(spark, sf_dir))


@query(G + ", " + ROOTS + " SELECT e.source_id AS id, count(DISTINCT r.root) AS roots FROM edges e JOIN (SELECT id, id % 4 AS root FROM nodes WHERE kind = 'class') r ON e.target_id = r.id WHERE e.edge_type = 'references' OR e.edge_type = 'calls' GROUP BY e.source_id HAVING count(DISTINCT r.root) >= 2")
def common_callers(spark, sf_dir):
    g = graph(spark, sf_dir)
    roots = g.nodes.where("kind = 'class'").select("id", (F.col("id") % 4).alias("root"))
    calls = Graph(g.nodes, g.edges.where("edge_type in ('references', 'calls')").withColumn("edge_type", F.lit("calls")))
    return A.common_callers(R.callers(calls, roots))


@query(GF + " SELECT sha256(string_agg(file_path || chr(0) || file_hash || chr(10), '' ORDER BY file_path)) AS fingerprint FROM files")
def index_fingerprint(spark, sf_dir):
    return A.fingerprint(graph(spark, sf_dir).files).select("fingerprint")


@query(GF + ", b AS (SELECT substr(md5(file_path), 1, 3) AS bucket, sha256(string_agg(file_path || chr(0) || file_hash || chr(10), '' ORDER BY file_path)) AS digest FROM files GROUP BY 1) SELECT sha256(string_agg(bucket || digest, '' ORDER BY bucket)) AS fingerprint FROM b")
def tree_fingerprint(spark, sf_dir):
    return A.tree_fingerprint(graph(spark, sf_dir).files).select("fingerprint")


@query("SELECT target, count(*) AS hits, max(ts) AS last_hit_at FROM (SELECT user_id, event_type || '/' || (user_id % 10) AS target, max(ts) AS ts FROM events GROUP BY ALL) GROUP BY target")
def hit_counts(spark, sf_dir):
    hits = view(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.concat_ws("/", "event_type", F.col("user_id") % 10).alias("target"), "ts")
    return A.hit_counts(hits)


@query(G + ", " + INBOUND + """, k AS (SELECT *, row_number() OVER (PARTITION BY target_file, source_file, edge_type ORDER BY source_id, target_id) AS k FROM inbound), p AS (SELECT *, row_number() OVER (PARTITION BY target_file ORDER BY source_file, edge_type, k) AS position FROM k WHERE k <= 3)
SELECT target_file, source_file, edge_type, source_id, target_id, position::INT AS position FROM p WHERE position <= 50""")
def dependency_samples(spark, sf_dir):
    return A.dependency_samples(R.inbound_file_dependencies(graph(spark, sf_dir))).select("target_file", "source_file", "edge_type", "source_id", "target_id", "position")


# --- traversals

IMPACT = """uniq AS (SELECT file_path, symbol, count(*) AS k FROM nodes GROUP BY file_path, symbol),
ie AS (SELECT e.source_id, e.target_id, bool_or(e.provenance = 'precise' OR (e.edge_type = 'calls' AND s.file_path = t.file_path AND u.k = 1)) AS confirmed, min(CASE WHEN e.edge_type = 'calls' THEN '' ELSE e.edge_type END) AS via
FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id JOIN uniq u ON u.file_path = t.file_path AND u.symbol = t.symbol WHERE e.edge_type IN ('calls', 'extends', 'implements', 'overrides') GROUP BY e.source_id, e.target_id)"""
BLAST = IMPACT + """, walk AS (SELECT root, id, 0 AS depth, true AS confirmed, '' AS via FROM roots UNION SELECT w.root, ie.source_id, w.depth + 1, w.confirmed AND ie.confirmed, ie.via FROM walk w JOIN ie ON ie.target_id = w.id WHERE w.depth < 3),
blast AS (SELECT w.root, w.id, w.depth, bool_or(w.confirmed) AS confirmed, min(w.via) AS via FROM walk w JOIN (SELECT root, id, min(depth) AS depth FROM walk GROUP BY root, id) m ON m.root = w.root AND m.id = w.id AND m.depth = w.depth WHERE w.depth > 0 GROUP BY w.root, w.id, w.depth)"""


@query(G + ", " + ROOTS + ", " + BLAST + " SELECT root, id, depth, confirmed, via FROM blast")
def blast_radius(spark, sf_dir):
    g = graph(spark, sf_dir)
    return T.blast_radius(g, suppliers(g, spark), 3)


@query(G + ", " + ROOTS + ", walk AS (SELECT root, id, 0 AS depth FROM roots UNION SELECT w.root, e.target_id, w.depth + 1 FROM walk w JOIN (SELECT DISTINCT source_id, target_id FROM edges WHERE edge_type = 'calls') e ON e.source_id = w.id WHERE w.depth < 3) SELECT root, id, min(depth) AS depth FROM walk GROUP BY root, id")
def callee_closure(spark, sf_dir):
    g = graph(spark, sf_dir)
    return T.closure(g, suppliers(g, spark), 3)


@query(G + ", " + ROOTS + """, p AS (SELECT id AS target FROM nodes WHERE kind = 'type'), walk AS (SELECT root, id, 0 AS depth, [id] AS path FROM roots UNION SELECT w.root, e.target_id, w.depth + 1, list_append(w.path, e.target_id) FROM walk w JOIN (SELECT DISTINCT source_id, target_id FROM edges WHERE edge_type = 'calls') e ON e.source_id = w.id WHERE w.depth < 4)
SELECT w.root, target, array_to_string(min(path), '>') AS path FROM walk w JOIN p ON p.target = w.id JOIN (SELECT root, id, min(depth) AS depth FROM walk GROUP BY root, id) m ON m.root = w.root AND m.id = w.id AND m.depth = w.depth GROUP BY w.root, target""")
def shortest_paths(spark, sf_dir):
    g = graph(spark, sf_dir)
    return T.shortest_paths_to(g, suppliers(g, spark), g.nodes.where("kind = 'type'"), 4).select("root", "target", F.array_join("path", ">").alias("path"))


@query(G + ", " + ROOTS + """, b AS (SELECT source_id, target_id FROM edges WHERE edge_type <> 'defines' UNION SELECT target_id, source_id FROM edges WHERE edge_type <> 'defines'), walk AS (SELECT root, id, 0 AS depth FROM roots UNION SELECT w.root, b.target_id, w.depth + 1 FROM walk w JOIN b ON b.source_id = w.id WHERE w.depth < 2),
m AS (SELECT root, w.id, min(depth) AS depth FROM walk w GROUP BY root, w.id), r AS (SELECT m.root, m.id, m.depth, row_number() OVER (PARTITION BY root ORDER BY depth, file_path, start_line, fqn, kind, symbol, m.id)::INT AS position, count(*) OVER (PARTITION BY root) AS total FROM m JOIN nodes n ON n.id = m.id WHERE depth > 0)
SELECT *, total > 100 AS truncated FROM r WHERE position <= 100""")
def traverse_both(spark, sf_dir):
    g = graph(spark, sf_dir)
    return T.traverse(g, suppliers(g, spark), "both").select("root", "id", "depth", "position", "total", "truncated")


@query(G + """, im AS (SELECT s.file_path AS sf, t.file_path AS tf, bool_and(coalesce(s.language = 'go', false)) AS by_package FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id WHERE e.edge_type = 'imports' AND s.file_path <> t.file_path GROUP BY s.file_path, t.file_path)
SELECT tf AS file, sf AS test_file, 1 AS depth, by_package FROM im WHERE tf = 'internal/geo/nation.go' AND """ + sql_test_file("sf"))
def importing_tests(spark, sf_dir):
    return T.importing_tests(graph(spark, sf_dir), spark.createDataFrame([("internal/geo/nation.go",)], "file_path string"))


_TEST = "(kind = 'test' OR " + sql_test_path("file_path") + ")"
FOLLOWABLE = f"""placed AS (SELECT id, symbol, fqn, kind, {sql_dir('file_path')} AS dir, {sql_subsystem('file_path')} AS sub, {_TEST} AS test FROM nodes),
defs AS (SELECT * FROM placed WHERE kind IN ('function', 'method', 'class') AND NOT test),
twins AS (SELECT fqn, list_distinct(list(dir)) AS dirs FROM defs WHERE fqn <> '' GROUP BY fqn HAVING count(*) > 1),
all_of AS (SELECT symbol, count(*) AS n FROM defs GROUP BY symbol), in_dir AS (SELECT symbol, dir, count(*) AS n, min(id) AS one FROM defs GROUP BY symbol, dir), in_sub AS (SELECT symbol, sub, count(*) AS n, min(id) AS one FROM defs GROUP BY symbol, sub),
ends AS (SELECT e.source_id, e.target_id, bool_or(e.provenance = 'precise') AS precise, any_value(s.fqn) AS fqn, any_value(s.dir) AS sd, any_value(s.sub) AS ss, any_value(t.dir) AS td, any_value(t.symbol) AS symbol
  FROM edges e JOIN placed s ON s.id = e.source_id JOIN placed t ON t.id = e.target_id WHERE e.edge_type = 'calls' AND NOT s.test AND NOT t.test AND t.kind <> 'file' GROUP BY e.source_id, e.target_id),
fol AS (SELECT source_id, target_id FROM ends LEFT JOIN all_of a ON a.symbol = ends.symbol LEFT JOIN in_dir d ON d.symbol = ends.symbol AND d.dir = sd LEFT JOIN in_sub u ON u.symbol = ends.symbol AND u.sub = ss LEFT JOIN twins w ON w.fqn = ends.fqn
  WHERE (precise OR coalesce(a.n, 0) <= 1 OR coalesce(CASE WHEN d.n = 1 THEN d.one WHEN d.n IS NULL AND u.n = 1 THEN u.one END = target_id, false))
  AND coalesce(list_sort(list_filter(w.dirs, lambda x: td = x OR (x <> '' AND starts_with(td, x || '/'))), 'DESC')[1], sd) = sd)"""


@query(G + ", " + FOLLOWABLE + " SELECT source_id, target_id FROM fol")
def followable_calls(spark, sf_dir):
    return T.followable_calls(graph(spark, sf_dir))


# --- maintenance


@query(with_sql("files", "later") + " SELECT coalesce(a.file_path, b.file_path) AS file_path, CASE WHEN a.file_path IS NULL THEN 'new' WHEN b.file_path IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM files a FULL JOIN later b ON a.file_path = b.file_path WHERE a.file_hash IS DISTINCT FROM b.file_hash")
def file_delta(spark, sf_dir):
    return M.file_delta(view(spark, sf_dir, "files"), view(spark, sf_dir, "later"))


@query(with_sql("annotations") + """, fresh AS (SELECT external_id, CASE WHEN id % 40 = 0 THEN note || '!' ELSE note END AS note FROM annotations WHERE external_id IS NOT NULL AND id % 60 <> 0 UNION ALL SELECT 'new' || CAST(s_suppkey AS VARCHAR), s_name FROM supplier)
SELECT coalesce(a.external_id, f.external_id) AS external_id, coalesce(f.note, a.note) AS note, CASE WHEN a.external_id IS NULL THEN 'created' WHEN f.external_id IS NULL THEN 'kept' WHEN a.note = f.note THEN 'unchanged' ELSE 'updated' END AS action FROM (SELECT * FROM annotations WHERE external_id IS NOT NULL) a FULL JOIN fresh f ON a.external_id = f.external_id""")
def annotation_upsert(spark, sf_dir):
    old = view(spark, sf_dir, "annotations").where("external_id is not null")
    fresh = old.where("id % 60 <> 0").select("external_id", F.when(F.col("id") % 40 == 0, F.concat("note", F.lit("!"))).otherwise(F.col("note")).alias("note"))
    fresh = fresh.unionByName(view(spark, sf_dir, "supplier").select(F.concat(F.lit("new"), "s_suppkey").alias("external_id"), F.col("s_name").alias("note")))
    return M.upsert(old, fresh, ["external_id"], ["note"])


@query(G + ", gone AS (SELECT id FROM nodes WHERE starts_with(file_path, 'internal/part/')) SELECT edge_type, count(*) AS n FROM edges WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone) GROUP BY edge_type")
def cascade_delete(spark, sf_dir):
    g = graph(spark, sf_dir)
    gone = g.files.where(F.col("file_path").startswith("internal/part/")).select("file_path")
    return A.count_by(M.cascade_delete(g, gone).edges, "edge_type")


@query(G + """, e2 AS (SELECT edge_type, provenance FROM edges WHERE NOT (edge_type = 'calls' AND source_id BETWEEN 5000000000 AND 5999999999) UNION ALL SELECT 'calls', 'precise' FROM edges WHERE edge_type = 'references') SELECT edge_type, provenance, count(*) AS n FROM e2 GROUP BY ALL""")
def supersede_calls(spark, sf_dir):
    g = graph(spark, sf_dir)
    clean = g.nodes.where("kind = 'type'").select(F.col("id").alias("source_id"))
    return A.count_by(M.supersede_calls(g, clean, g.edges.where("edge_type = 'references'")).edges, "edge_type", "provenance")


@query(G + """, fresh AS (SELECT *, id + 500000000000 AS nid FROM nodes WHERE kind = 'type' AND id % 5 <> 0), touched AS (SELECT DISTINCT file_path FROM nodes WHERE kind = 'type'), gone AS (SELECT * FROM nodes WHERE file_path IN (SELECT file_path FROM touched)),
o AS (SELECT *, row_number() OVER (PARTITION BY file_path, symbol, fqn, kind ORDER BY start_line, id) AS k FROM gone), f AS (SELECT *, row_number() OVER (PARTITION BY file_path, symbol, fqn, kind ORDER BY start_line, nid) AS k FROM fresh)
SELECT e.source_id, f.nid AS target_id, e.edge_type, CASE WHEN e.provenance = 'precise' THEN 0.7 ELSE e.weight END AS weight, 'name' AS provenance FROM edges e JOIN o ON o.id = e.target_id JOIN f ON f.file_path = o.file_path AND f.symbol = o.symbol AND f.fqn = o.fqn AND f.kind = o.kind AND f.k = o.k WHERE e.source_id NOT IN (SELECT id FROM gone)""")
def generation_remap(spark, sf_dir):
    g = graph(spark, sf_dir)
    fresh = g.nodes.where("kind = 'type' and id % 5 <> 0").withColumn("id", F.col("id") + 500000000000)
    touched = g.nodes.where("kind = 'type'").select("file_path").distinct()
    nxt, _ = M.replace_files(g, Graph(fresh, g.edges.limit(0)), touched)
    return nxt.edges.where("target_id > 500000000000")


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)")
def orphan_vectors(spark, sf_dir):
    owners = view(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select(F.col("doc_id").alias("vec_id"))
    return M.orphan_vectors(view(spark, sf_dir, "embeddings"), owners).select("vec_id")


@query(G + " SELECT id, file_path, fqn, left(docstring, 12) AS docstring FROM nodes ORDER BY file_path, start_line, fqn, kind, symbol, id LIMIT 50 OFFSET 100")
def structural_page(spark, sf_dir):
    return M.page(graph(spark, sf_dir).nodes, list(R.NODE_ORDER), 100, 50).select("id", "file_path", "fqn", F.left("docstring", F.lit(12)).alias("docstring"))


@query(G + " SELECT id, row_number() OVER (ORDER BY file_path, start_line, fqn, kind, symbol, id) - 1 AS position FROM nodes")
def export_positions(spark, sf_dir):
    return M.node_positions(graph(spark, sf_dir).nodes)


# --- search

NAME_ORDER = "tier, exact DESC, prefix DESC, length(symbol), symbol, file_path, start_line, id"


def _name_sql(tokens: list[str], raw: str) -> str:
    every = lambda field: " AND ".join(f"contains(lower(coalesce({field}, '')), '{t}')" for t in tokens)
    name, either = f"({every('symbol')}) OR ({every('fqn')})", every("docstring")
    return f"hits AS (SELECT *, CASE WHEN {name} THEN 0 WHEN {either} THEN 1 WHEN contains(lower(symbol), '{raw}') OR contains(lower(fqn), '{raw}') THEN 2 END AS tier, CAST(lower(symbol) = '{raw}' AS INT) AS exact, CAST(starts_with(lower(symbol), '{raw}') AS INT) AS prefix FROM nodes WHERE kind <> 'file')"


@query(G + ", " + _name_sql(["customer", "building"], "customer building") + f" SELECT id, symbol, tier FROM hits WHERE tier IS NOT NULL ORDER BY {NAME_ORDER} LIMIT 50")
def search_names(spark, sf_dir):
    return S.search_names(graph(spark, sf_dir).nodes, "customer Building").select("id", "symbol", "tier")


BM25_QUERY = "the thing heats"


def _bm25_sql(terms: list[str]) -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: starts_with(x, '{t}'))) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln((s.n - s.df{i} + 0.5) / (s.df{i} + 0.5) + 1) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / s.mean))" for i in range(len(terms)))
    cov = " + ".join(f"CAST(tf{i} > 0 AS INT)" for i in range(len(terms)))
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents), c AS (SELECT doc_id, len(w) AS dl, {tf} FROM d), s AS (SELECT count(*) AS n, avg(dl) AS mean, {df} FROM c)
SELECT doc_id, floor(({score}) * 1000000 + 0.5) / 1000000 AS score, {cov} AS covered FROM c, s WHERE {cov} > 0 ORDER BY score DESC, doc_id LIMIT 50"""


@query(_bm25_sql(names.lexical_terms(BM25_QUERY)))
def bm25_documents(spark, sf_dir):
    return S.bm25(view(spark, sf_dir, "documents"), "doc_id", F.col("text"), BM25_QUERY)


LEX_TERMS = names.lexical_terms("orders of priority handled")


def _lexical_sql(terms: list[str]) -> str:
    fields = list(S.FIELD_WEIGHTS)
    words = ", ".join(f"regexp_extract_all(lower(coalesce({f}, '')), '[\\p{{L}}\\p{{N}}]+') AS w_{f}" for f in fields)
    length = " + ".join(f"len(w_{f})" for f in fields)
    tf = ", ".join(" + ".join(f"{w} * len(list_filter(w_{f}, lambda x: starts_with(x, '{t}')))" for f, w in S.FIELD_WEIGHTS.items()) + f" AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    weight = " + ".join(f"greatest(ln((s.n - s.df{i} + 0.5) / (s.df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / s.mean))" for i in range(len(terms)))
    cov = " + ".join("CAST(" + " OR ".join(f"contains(lower(coalesce({f}, '')), '{t}')" for f in fields) + " AS INT)" for t in terms)
    kind = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for k, i in S.KIND_RANK.items()) + f" ELSE {S.OTHER_KIND} END"
    return f"""lexw AS (SELECT *, {words} FROM nodes), lext AS (SELECT *, {length} AS dl, {tf} FROM lexw), lexs AS (SELECT count(*) AS n, avg(dl) AS mean, {df} FROM lext),
lex AS (SELECT t.*, floor(({weight}) * 1000000 + 0.5) / 1000000 AS weight, {cov} AS covered, {kind} AS kind_rank, CAST(kind = 'test' OR {sql_test_path('file_path')} AS INT) AS is_test FROM lext t, lexs s WHERE kind <> 'file' AND ({' OR '.join(f'tf{i} > 0' for i in range(len(terms)))}))"""


LEX_ORDER = "covered DESC, is_test, kind_rank, weight DESC, id"


@query(G + ", " + _lexical_sql(LEX_TERMS) + f" SELECT id, symbol, covered, floor(covered / {len(LEX_TERMS)}::DOUBLE * 1000000 + 0.5) / 1000000 AS score FROM lex WHERE covered > 0 ORDER BY {LEX_ORDER} LIMIT 50")
def lexical_search(spark, sf_dir):
    """From the kept index of the graph's nodes."""
    version = text_index(spark, sf_dir)
    return X.lexical_search(spark, version, graph(spark, sf_dir).nodes, "orders of priority handled").select("id", "symbol", "covered", "score")


COSINE = "list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) * list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))"
VECTOR = f"v AS (SELECT e.vec_id, floor({COSINE} * 1000000 + 0.5) / 1000000 AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY score DESC, e.vec_id LIMIT 10)"


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return view(spark, sf_dir, "embeddings").where("vec_id = 7").select("embedding").first()[0]


@query(f"WITH {VECTOR} SELECT vec_id, round(score, 4) AS score FROM v")
def vector_search(spark, sf_dir):
    return S.vector_search(view(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir)).select("vec_id", F.round("score", 4).alias("score"))


@query("WITH " + VECTOR + ", l AS (SELECT doc_id AS vec_id, score FROM (" + _bm25_sql(names.lexical_terms("thing")).replace("LIMIT 50", "LIMIT 10") + """)), rv AS (SELECT vec_id, 0.5 / (60 + row_number() OVER (ORDER BY score DESC, vec_id)) AS s FROM v), rl AS (SELECT vec_id, 1.5 / (60 + row_number() OVER (ORDER BY score DESC, vec_id)) AS s FROM l)
SELECT coalesce(rv.vec_id, rl.vec_id) AS vec_id, floor((coalesce(rv.s, 0) + coalesce(rl.s, 0)) * 100000000 + 0.5) / 100000000 AS score FROM rv FULL JOIN rl ON rv.vec_id = rl.vec_id ORDER BY score DESC, vec_id LIMIT 10""")
def hybrid_search(spark, sf_dir):
    near = S.vector_search(view(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir))
    text = S.bm25(view(spark, sf_dir, "documents").withColumnRenamed("doc_id", "vec_id"), "vec_id", F.col("text"), "thing", 10)
    return S.fuse(near, text, "vec_id", "identifier")


@query("SELECT turn, CASE WHEN regexp_matches(t, '" + names.IDENTIFIER + "') OR (len(w) BETWEEN 1 AND 2 AND NOT list_has_any(w, " + str(list(names.QUESTION_WORDS)) + ")) THEN 'identifier' ELSE 'natural_language' END AS class, count(*) AS n FROM (SELECT turn, t, list_filter(string_split_regex(lower(t), '\\s+'), lambda x: x <> '') AS w FROM (SELECT turn, regexp_replace(trim(text), '[.?!]$', '') AS t FROM conversations)) GROUP BY ALL")
def query_classes(spark, sf_dir):
    turns = view(spark, sf_dir, "conversations")
    return turns.groupBy("turn", names.query_class(F.col("text")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(G + ", " + _name_sql(["order#1"], "order#1") + ", " + _lexical_sql(names.lexical_terms("Order#1")) + f""", a AS (SELECT id, 0 AS mode, row_number() OVER (ORDER BY {NAME_ORDER}) AS rn FROM hits WHERE tier IS NOT NULL ORDER BY rn LIMIT 10), b AS (SELECT id, 1 AS mode, row_number() OVER (ORDER BY {LEX_ORDER}) AS rn FROM lex WHERE covered > 0 ORDER BY rn LIMIT 10),
u AS (SELECT id, min(mode * 1000 + rn) AS k FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id) SELECT id, CASE WHEN k < 1000 THEN 'name' ELSE 'lexical' END AS mode, position FROM (SELECT *, row_number() OVER (ORDER BY k)::INT AS position FROM u) WHERE position <= 10""")
def search_cascade(spark, sf_dir):
    g = graph(spark, sf_dir)
    return S.cascade(g.nodes, "Order#1", lexical=X.lexical_search(spark, text_index(spark, sf_dir), g.nodes, "Order#1", 10))


@query(G + " SELECT id, sha256(concat_ws(chr(10), docstring, signature, fqn)) AS digest FROM nodes WHERE kind <> 'file'")
def embedding_text(spark, sf_dir):
    return S.embedding_text(graph(spark, sf_dir).nodes).select("id", "digest")


@query("SELECT doc_id, line_number, line FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_number, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '@[a-z0-9]+\\.example') ORDER BY doc_id, line_number LIMIT 100")
def grep_documents(spark, sf_dir):
    return S.grep(view(spark, sf_dir, "documents"), "doc_id", "text", r"@[a-z0-9]+\.example")
