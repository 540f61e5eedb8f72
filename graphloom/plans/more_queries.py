"""Upkeep of notes, vectors and the search index, evidence by name, confidence, distances and file context, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names
from ..operators import aggregates as A
from ..operators import maintenance as M
from ..operators import search as S
from ..operators import traverse as T
from ..schema import Graph
from ..sources.testbed import graph, view, with_sql
from . import reports as P
from .queries import BLAST, FOLLOWABLE, G, GF, LEX_ORDER, NAME_ORDER, ROOTS, VECTOR, _lexical_sql, _name_sql, query, sql_dir, sql_subsystem, sql_test_path, suppliers
from .report_queries import DEPS

NOTES = with_sql("annotations")
#: Every customer's note moves, and as many that do not exist.
MOVES = "moves AS (SELECT CAST(1 AS BIGINT) AS project_id, c_custkey AS id, 'moved.' || c_name AS target FROM customer)"


def _moves(spark, sf_dir):
    return view(spark, sf_dir, "customer").select(F.lit(1).cast("long").alias("project_id"), F.col("c_custkey").alias("id"), F.concat(F.lit("moved."), "c_name").alias("target"))


@query(NOTES + ", " + MOVES + " SELECT a.id, coalesce(m.target, a.target) AS target, a.note FROM annotations a LEFT JOIN moves m ON m.id = a.id")
def retargeted_notes(spark, sf_dir):
    return M.retarget_notes(view(spark, sf_dir, "annotations"), _moves(spark, sf_dir))[0].select("id", "target", "note")


@query(NOTES + ", " + MOVES + " SELECT m.id, a.id IS NOT NULL AS matched FROM moves m LEFT JOIN annotations a ON a.id = m.id")
def retarget_matches(spark, sf_dir):
    return M.retarget_notes(view(spark, sf_dir, "annotations"), _moves(spark, sf_dir))[1].select("id", "matched")


@query(NOTES + ", " + MOVES + " SELECT id, target FROM annotations WHERE id NOT IN (SELECT id FROM moves)")
def remaining_notes(spark, sf_dir):
    return M.delete_notes(view(spark, sf_dir, "annotations"), _moves(spark, sf_dir))[0].select("id", "target")


@query(G + " SELECT id, CASE kind WHEN 'function' THEN 'vec-' || id WHEN 'class' THEN NULL ELSE 'old-' || kind END AS vec_id FROM nodes")
def vector_ids(spark, sf_dir):
    """Functions get new vectors, classes lose theirs, the others keep what they had."""
    nodes = graph(spark, sf_dir).nodes.withColumn("vec_id", F.concat(F.lit("old-"), "kind"))
    moved = nodes.where("kind in ('function', 'class')").select("project_id", "id", F.when(F.col("kind") == "function", F.concat(F.lit("vec-"), "id")).alias("vec_id"))
    return M.set_vec_ids(nodes, moved).select("id", "vec_id")


@query(
    G
    + """, was AS (SELECT id FROM nodes WHERE kind <> 'test' UNION ALL SELECT -c_custkey FROM customer), dirty AS (SELECT id FROM nodes WHERE kind = 'class')
SELECT id, 'remove' AS action FROM was WHERE id NOT IN (SELECT id FROM nodes) OR id IN (SELECT id FROM dirty) UNION ALL SELECT id, 'add' FROM nodes WHERE id NOT IN (SELECT id FROM was) OR id IN (SELECT id FROM dirty)"""
)
def search_index_delta(spark, sf_dir):
    """The index lacks tests, holds customers that are gone, and classes were flagged."""
    nodes = graph(spark, sf_dir).nodes
    was = nodes.where("kind <> 'test'").select("id").unionByName(view(spark, sf_dir, "customer").select((-F.col("c_custkey")).alias("id")))
    return M.index_delta(nodes, was, nodes.where("kind = 'class'"))


@query(
    G + ", " + ROOTS + ", " + BLAST
    + """ SELECT r.root, count(b.id) FILTER (b.confirmed) AS affected, count(b.id) FILTER (b.confirmed AND b.depth = 1) AS direct, count(b.id) FILTER (b.confirmed AND n.kind = 'test') AS tests,
count(DISTINCT {'f': n.fqn, 'p': n.file_path, 'l': n.start_line}) FILTER (NOT b.confirmed) AS filtered, count(b.id) FILTER (n.kind = 'test') = 0 AS untested
FROM (SELECT DISTINCT root FROM roots) r LEFT JOIN blast b ON b.root = r.root LEFT JOIN nodes n ON n.id = b.id GROUP BY r.root"""
)
def confirmed_impact(spark, sf_dir):
    g = graph(spark, sf_dir)
    return P.confirmed_impact(g, suppliers(g, spark))


#: Documents of the third source stand for test files; the names asked for are the words of the benchmark.
@query(
    r"""WITH s AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS word FROM benchmark),
f AS (SELECT DISTINCT source || '/d' || doc_id || '_test.go' AS test_file, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+')) AS word FROM documents),
r AS (SELECT 'pkg.' || word AS symbol, test_file, row_number() OVER (PARTITION BY word ORDER BY test_file) AS rn, count(*) OVER (PARTITION BY word) AS total FROM s JOIN f USING (word))
SELECT symbol, test_file, total FROM r WHERE rn <= 50"""
)
def tests_by_name(spark, sf_dir):
    words = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), 0))
    symbols = view(spark, sf_dir, "benchmark").select(words.alias("word")).distinct().select(F.concat(F.lit("pkg."), "word").alias("symbol"))
    sources = view(spark, sf_dir, "documents").select(F.concat("source", F.lit("/d"), "doc_id", F.lit("_test.go")).alias("file_path"), F.coalesce("text", F.lit("")).alias("content"))
    return P.tests_by_name(sources, symbols)


@query(G + """, seeds AS (SELECT id FROM nodes WHERE kind = 'class'), c AS (SELECT DISTINCT source_id, target_id FROM edges WHERE edge_type = 'calls'),
walk AS (SELECT id, 0 AS distance FROM seeds UNION SELECT c.source_id, w.distance + 1 FROM walk w JOIN c ON c.target_id = w.id WHERE w.distance < 6) SELECT id, min(distance)::INT AS distance FROM walk GROUP BY id""")
def seed_distances(spark, sf_dir):
    """From all suppliers at once."""
    g = graph(spark, sf_dir)
    return T.distances(g, g.nodes.where("kind = 'class'"))


WEAKEST = """labels AS (SELECT n.file_path, CASE WHEN c.file_path IS NOT NULL THEN 3 WHEN n.language IN ('typescript', 'javascript', 'python', 'vue') THEN 1 ELSE 2 END AS rank
FROM nodes n LEFT JOIN (SELECT DISTINCT file_path FROM coverage) c ON c.file_path = n.file_path WHERE n.kind IN ('function', 'method', 'test')),
weakest AS (SELECT file_path, CASE min(rank) WHEN 1 THEN 'unresolved' WHEN 2 THEN 'name' ELSE 'resolved' END AS call_graph FROM labels GROUP BY file_path)"""


@query(GF + ", " + WEAKEST + " SELECT * FROM weakest")
def weakest_call_graphs(spark, sf_dir):
    g = graph(spark, sf_dir)
    labels = P.call_graph_label(g, g.nodes).join(g.nodes.select("id", "file_path"), "id").select("file_path", "call_graph")
    return A.weakest_call_graph(labels, "file_path")


@query(
    GF + ", " + WEAKEST + ", " + DEPS.replace("GROUP BY ALL", "GROUP BY target_file, source_file, edge_type")
    + f""", cross_calls AS (SELECT s.file_path AS sf, t.file_path AS tf, s.kind AS sk FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id WHERE e.edge_type = 'calls' AND s.file_path <> t.file_path),
rel AS (SELECT tf AS file, sf AS related, CASE WHEN sk = 'test' OR {sql_test_path('sf')} THEN 1.0 ELSE 0.9 END::DOUBLE AS c FROM cross_calls UNION ALL SELECT sf, tf, 0.7::DOUBLE FROM cross_calls),
rs AS (SELECT file, count(DISTINCT related) AS related, max(c) AS best_related FROM rel GROUP BY file),
fi AS (SELECT f.file_path, count(DISTINCT d.source_file) AS dependents, CASE WHEN coalesce(bool_or(d.confidence = 'confirmed'), false) THEN 'unsafe' ELSE 'unknown' END AS delete_verdict FROM (SELECT DISTINCT file_path FROM nodes) f LEFT JOIN deps d ON d.target_file = f.file_path GROUP BY f.file_path)
SELECT o.file_path, o.symbols, o.tests, fi.dependents, fi.delete_verdict, coalesce(w.call_graph, 'none') AS call_graph, coalesce(rs.related, 0) AS related, rs.best_related
FROM (SELECT file_path, count(*) FILTER (kind <> 'file') AS symbols, count(*) FILTER (kind = 'test') AS tests FROM nodes GROUP BY file_path) o JOIN fi ON fi.file_path = o.file_path LEFT JOIN weakest w ON w.file_path = o.file_path LEFT JOIN rs ON rs.file = o.file_path"""
)
def file_contexts(spark, sf_dir):
    """Of every file."""
    g = graph(spark, sf_dir)
    return P.file_context(g, g.nodes)


@query(
    G + ", " + ROOTS + ", " + FOLLOWABLE
    + """, walk AS (SELECT root, id, 0 AS depth FROM roots UNION SELECT w.root, f.target_id, w.depth + 1 FROM walk w JOIN fol f ON f.source_id = w.id WHERE w.depth < 4),
near AS (SELECT root, id, min(depth)::INT AS depth FROM walk GROUP BY root, id)
SELECT root, id, depth, n > 400 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, id) AS rn, count(*) OVER (PARTITION BY root) AS n FROM near) WHERE rn <= 400"""
)
def footprint(spark, sf_dir):
    g = graph(spark, sf_dir)
    return T.footprint(g, suppliers(g, spark))


#: The graph with a node for each file, and imports between files in place of those of their symbols.
WITH_FILES = """file_nodes AS (SELECT 8000000000 + row_number() OVER (ORDER BY file_path) AS id, file_path FROM (SELECT DISTINCT file_path FROM nodes)),
all_nodes AS (SELECT id, file_path, symbol, fqn, kind, start_line FROM nodes UNION ALL SELECT id, file_path, NULL, NULL, 'file', 1 FROM file_nodes),
file_imports AS (SELECT DISTINCT a.id AS source_id, b.id AS target_id FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id JOIN file_nodes a ON a.file_path = s.file_path JOIN file_nodes b ON b.file_path = t.file_path WHERE e.edge_type = 'imports' AND a.id <> b.id),
hops AS (SELECT source_id AS id, target_id AS far FROM edges WHERE edge_type = 'calls' UNION SELECT * FROM file_imports UNION SELECT n.id, i.target_id FROM nodes n JOIN file_nodes f ON f.file_path = n.file_path JOIN file_imports i ON i.source_id = f.id)"""


def graph_with_files(spark, sf_dir) -> Graph:
    g = graph(spark, sf_dir)
    files = g.nodes.select("project_id", "file_path").distinct().withColumn("id", F.lit(8000000000) + F.row_number().over(W.orderBy("file_path")))
    nodes = g.nodes.unionByName(files.select("id", "project_id", "file_path", F.lit("file").alias("kind"), F.lit(1).alias("start_line")), allowMissingColumns=True)
    at = lambda p: g.nodes.select(F.col("id").alias(f"{p}_id"), "file_path").join(files, "file_path").select(f"{p}_id", F.col("id").alias(p))
    imports = g.edges.where("edge_type = 'imports'").join(at("source"), "source_id").join(at("target"), "target_id").where("source <> target").select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), "edge_type", "weight", "provenance").distinct()
    return Graph(nodes, g.edges.where("edge_type <> 'imports'").unionByName(imports), g.files, g.coverage)


@query(
    G + ", " + ROOTS + ", " + WITH_FILES
    + """, walk AS (SELECT root, id, 0 AS depth FROM roots UNION SELECT w.root, h.far, w.depth + 1 FROM walk w JOIN hops h ON h.id = w.id WHERE w.depth < 3),
m AS (SELECT root, id, min(depth)::INT AS depth FROM walk GROUP BY root, id HAVING min(depth) > 0),
r AS (SELECT root, m.id, depth, row_number() OVER (PARTITION BY root ORDER BY depth, file_path, start_line, fqn NULLS FIRST, kind, symbol NULLS FIRST, m.id)::INT AS position, count(*) OVER (PARTITION BY root) AS total FROM m JOIN all_nodes n ON n.id = m.id)
SELECT *, total > 100 AS truncated FROM r WHERE position <= 100"""
)
def traverse_files(spark, sf_dir):
    """From all suppliers along calls and the imports of their files."""
    g = graph_with_files(spark, sf_dir)
    return T.traverse(g, suppliers(g, spark), "out", ("calls", "imports"), 3).select("root", "id", "depth", "position", "total", "truncated")


#: Vectors stand for the customers of their numbers; where any is near, neither names nor words are asked.
@query(
    G + ", " + VECTOR + ", " + _name_sql(["building"], "building") + ", " + _lexical_sql(names.lexical_terms("building"))
    + f""", s AS (SELECT 3000000000 + vec_id AS id, 'semantic' AS mode, row_number() OVER (ORDER BY score DESC, vec_id)::INT AS position FROM v WHERE 3000000000 + vec_id IN (SELECT id FROM nodes WHERE kind <> 'file') ORDER BY position LIMIT 4),
a AS (SELECT id, row_number() OVER (ORDER BY {NAME_ORDER}) AS rn FROM hits WHERE tier IS NOT NULL ORDER BY rn LIMIT 4),
b AS (SELECT id, 1000 + row_number() OVER (ORDER BY {LEX_ORDER}) AS rn FROM lex WHERE covered > 0 ORDER BY rn LIMIT 4),
u AS (SELECT id, min(rn) AS k FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id)
SELECT * FROM s UNION ALL SELECT id, mode, position FROM (SELECT id, CASE WHEN k < 1000 THEN 'name' ELSE 'lexical' END AS mode, row_number() OVER (ORDER BY k)::INT AS position FROM u) WHERE position <= 4 AND NOT EXISTS (SELECT 1 FROM s)"""
)
def search_cascade_semantic(spark, sf_dir):
    vectors = view(spark, sf_dir, "embeddings")
    wanted = [float(x) for x in vectors.where("vec_id = 7").first()["embedding"]]
    near = S.vector_search(vectors, wanted).select((F.lit(3000000000) + F.col("vec_id")).alias("id"), "score")
    return S.cascade(graph(spark, sf_dir).nodes, "building", 4, near)
