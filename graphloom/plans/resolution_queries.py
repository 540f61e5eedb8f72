"""References within files, references that met nothing, and the exact pass, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import imports as I
from ..operators import relations as R
from ..operators import resolution as X
from ..sources.testbed import graph, view, with_sql
from .queries import query

_FIRST = "(CASE WHEN {line} > 0 THEN list_filter({ids}, lambda x: x.start_line = {line})[1:1] ELSE [] END)"
SCOPED = """, decl AS (SELECT file_path, fqn, list({'start_line': start_line, 'id': id, 'kind': kind} ORDER BY start_line, id) AS ids FROM nodes WHERE kind <> 'file' AND fqn <> '' GROUP BY file_path, fqn),
named AS (SELECT fqn, max(id) AS id FROM nodes WHERE fqn <> '' GROUP BY fqn),
src AS (SELECT r.*, CASE WHEN from_file IS NULL THEN n.id ELSE coalesce(@F[1].id, d.ids[1].id) END AS source_id FROM scoped_refs r LEFT JOIN named n ON n.fqn = r.from_name LEFT JOIN decl d ON d.file_path = r.from_file AND d.fqn = r.from_name),
tgt AS (SELECT s.*, unnest(CASE WHEN len(@T) > 0 THEN @T ELSE t.ids END) AS t FROM src s JOIN decl t ON t.file_path = s.to_file AND t.fqn = s.to_name WHERE source_id IS NOT NULL)
SELECT ref_id, source_id, t.id AS target_id, kind, 0.7::DOUBLE AS weight, 'name' AS provenance FROM tgt
WHERE t.id <> source_id AND CASE WHEN kind IN ('extends', 'implements') THEN t.kind IN ('class', 'type', 'variable') ELSE t.kind IN ('function', 'class', 'variable', 'method', 'test') END"""


@query(with_sql("nodes", "scoped_refs") + SCOPED.replace("@F", _FIRST.format(line="from_line", ids="d.ids")).replace("@T", _FIRST.format(line="to_line", ids="t.ids")))
def scoped_references(spark, sf_dir):
    return X.scoped_references(graph(spark, sf_dir), view(spark, sf_dir, "scoped_refs"))


#: References of the testbed that lead to nothing, as reads and writes of tables.
DANGLING = "dangling AS (SELECT ref_id, from_fqn, CASE WHEN ref_id % 3 = 0 THEN 'lost ' || to_name ELSE to_name END AS to_name, CASE WHEN ref_id % 2 = 0 THEN 'reads' WHEN ref_id % 5 = 0 THEN 'calls' ELSE 'writes' END AS kind, to_fqn, true AS qualified FROM refs)"


@query(
    with_sql("nodes", "refs") + ", " + DANGLING + """, named AS (SELECT fqn, max(id) AS id FROM nodes GROUP BY fqn)
SELECT DISTINCT n.file_path, coalesce(d.to_fqn, d.to_name) AS to_name, d.kind FROM dangling d JOIN named s ON s.fqn = d.from_fqn JOIN nodes n ON n.id = s.id
WHERE d.kind IN ('reads', 'writes') AND CASE WHEN d.to_fqn IS NOT NULL THEN d.to_fqn NOT IN (SELECT fqn FROM named) OR (SELECT id FROM named x WHERE x.fqn = d.to_fqn) = s.id
  ELSE NOT EXISTS (SELECT 1 FROM nodes t WHERE t.symbol = d.to_name AND t.id <> s.id) END"""
)
def unresolved_references(spark, sf_dir):
    g = graph(spark, sf_dir)
    lost = F.when(F.col("ref_id") % 3 == 0, F.concat(F.lit("lost "), "to_name")).otherwise(F.col("to_name"))
    kind = F.when(F.col("ref_id") % 2 == 0, "reads").when(F.col("ref_id") % 5 == 0, "calls").otherwise("writes")
    refs = view(spark, sf_dir, "refs").select("ref_id", "from_fqn", lost.alias("to_name"), kind.alias("kind"), "to_fqn", F.lit(True).alias("qualified"))
    refs = refs.where(F.col("kind").isin(*X.DECLARATIVE))
    return X.unresolved_references(g, refs, R.resolve_references(g, refs, brief=True)).drop("project_id")


LOCATED = """, pos AS (SELECT file_path, start_line, max(id) AS id FROM nodes GROUP BY file_path, start_line HAVING count(*) = 1), named AS (SELECT fqn, max(id) AS id FROM nodes GROUP BY fqn),
located AS (SELECT e.external, coalesce(a.id, an.id) AS source_id, coalesce(b.id, bn.id) AS target_id FROM exact e LEFT JOIN pos a ON a.file_path = caller_file AND a.start_line = caller_line LEFT JOIN named an ON an.fqn = caller_fqn
LEFT JOIN pos b ON b.file_path = callee_file AND b.start_line = callee_line LEFT JOIN named bn ON bn.fqn = callee_fqn)"""
#: Files an exact pass resolved whole.
CLEAN = "clean AS (SELECT DISTINCT project_id, file_path FROM nodes WHERE language = 'go' AND substr(md5(file_path), 5, 1) < 'c')"


def _clean(g):
    return g.nodes.where((F.col("language") == "go") & (F.substring(F.md5("file_path"), 5, 1) < "c")).select("project_id", "file_path").distinct()


@query(
    with_sql("nodes", "edges", "exact") + LOCATED + ", " + CLEAN + """, after AS (
SELECT edge_type, provenance, source_id, target_id FROM edges e WHERE edge_type <> 'calls' OR (source_id NOT IN (SELECT id FROM nodes JOIN clean USING (file_path))
  AND (provenance <> 'precise' OR NOT EXISTS (SELECT 1 FROM located l WHERE NOT l.external AND l.source_id = e.source_id AND l.target_id = e.target_id)))
UNION ALL SELECT 'calls', 'precise', source_id, target_id FROM located WHERE NOT external AND source_id <> target_id)
SELECT edge_type, provenance, count(*) AS n, sum(hash_of)::BIGINT AS ends FROM (SELECT *, (source_id % 1009) * (target_id % 1013) AS hash_of FROM after) GROUP BY edge_type, provenance"""
)
def exact_pass(spark, sf_dir):
    """All edges after the pass, by kind, with a sum that shows both ends."""
    g = graph(spark, sf_dir)
    after = X.supersede_by_position(g, view(spark, sf_dir, "exact"), _clean(g))
    ends = (F.col("source_id") % 1009) * (F.col("target_id") % 1013)
    return after.edges.groupBy("edge_type", "provenance").agg(F.count(F.lit(1)).alias("n"), F.sum(ends).alias("ends"))


@query(with_sql("nodes", "files", "coverage") + ", " + CLEAN + """ SELECT file_path, resolver FROM coverage WHERE file_path NOT IN (SELECT file_path FROM nodes WHERE language = 'go') AND file_path NOT IN (SELECT file_path FROM clean)
UNION ALL SELECT file_path, 'types' FROM clean""")
def exact_pass_coverage(spark, sf_dir):
    g = graph(spark, sf_dir)
    return X.pass_coverage(g, _clean(g)).drop("project_id")


@query(with_sql("nodes", "exact") + LOCATED + """ SELECT count(*) FILTER (NOT external AND source_id <> target_id) AS upgraded, count(*) FILTER (NOT external AND (source_id IS NULL OR target_id IS NULL)) AS skipped,
count(*) FILTER (NOT external AND source_id = target_id) AS to_itself, count(*) FILTER (external) AS external FROM located""")
def exact_pass_counts(spark, sf_dir):
    return X.pass_counts(graph(spark, sf_dir), view(spark, sf_dir, "exact"))


#: Imports of the testbed's files: scripts by relative paths, an alias and a package, Go by two modules, one inside the other, Python by dots.
IMPORTS = """imports AS (
SELECT DISTINCT 'web/supplier/n' || s_nationkey || CASE WHEN s_nationkey % 5 = 4 THEN '.test.ts' ELSE '.ts' END AS file_path,
  CASE s_suppkey % 5 WHEN 0 THEN './n' || ((s_nationkey + 1) % 25) WHEN 1 THEN '@/supplier/n' || s_nationkey WHEN 2 THEN '@shop/web/supplier/n' || ((s_nationkey + 7) % 25) || '.js' WHEN 3 THEN '@shop/web' ELSE '~/none' END AS spec FROM supplier
UNION SELECT DISTINCT 'internal/' || lower(c_mktsegment) || '/n' || c_nationkey || CASE WHEN c_custkey % 7 = 0 THEN '_test.go' ELSE '.go' END, CASE c_custkey % 4 WHEN 0 THEN 'example.org/shop/geo/' WHEN 1 THEN 'example.org/shop/internal/' || lower(c_mktsegment) WHEN 2 THEN 'example.org/shop/cmd/geo/v2' ELSE 'fmt' END FROM customer
UNION SELECT DISTINCT 'internal/part/' || lower(replace(p_brand, '#', '_')) || '.py', CASE p_partkey % 3 WHEN 0 THEN '.brand_' || (p_partkey % 30) WHEN 1 THEN 'internal.part.brand_' || (p_partkey % 30) ELSE 'os' END FROM part)"""


@query(
    with_sql("nodes") + ", " + IMPORTS + """, files AS (SELECT DISTINCT file_path AS target FROM nodes),
meant AS (SELECT file_path, spec, CASE
    WHEN ends_with(file_path, '.ts') AND spec = '@shop/web' THEN 'web/supplier/n0.ts'
    WHEN ends_with(file_path, '.ts') THEN 'web/supplier/' || regexp_replace(regexp_extract(spec, '([^/]*)$', 1), '\\.js$', '') || '.ts'
    WHEN ends_with(file_path, '.py') THEN 'internal/part/' || regexp_extract(spec, '([^.]*)$', 1) || '.py' END AS target,
  CASE WHEN ends_with(file_path, '.go') THEN CASE WHEN spec = 'example.org/shop/geo/' THEN 'internal/geo' WHEN spec = 'example.org/shop/cmd/geo/v2' THEN 'cmd/geo' ELSE substr(spec, 18) END END AS folder FROM imports WHERE spec <> '~/none'),
standing AS (SELECT regexp_extract(target, '^(.*)/[^/]*$', 1) AS folder, arg_min(target, (ends_with(target, '_test.go'), target)) AS chosen FROM files WHERE ends_with(target, '.go') GROUP BY 1)
SELECT file_path, spec, f.target FROM meant m JOIN files f ON f.target = m.target UNION ALL SELECT file_path, spec, chosen FROM meant m JOIN standing s ON s.folder = m.folder"""
)
def import_targets(spark, sf_dir):
    g = graph(spark, sf_dir)
    imports = spark.sql(IMPORTS.removeprefix("imports AS (").removesuffix(")").replace("FROM supplier", "FROM {supplier}").replace("FROM customer", "FROM {customer}").replace("FROM part)", "FROM {part})").replace("FROM part", "FROM {part}"), **{t: view(spark, sf_dir, t) for t in ("supplier", "customer", "part")})
    packages = spark.createDataFrame([("@shop/web", "web", ["supplier/n0.js", "index"])], "name string, dir string, entries array<string>")
    modules = spark.createDataFrame([("example.org/shop", ""), ("example.org/shop/geo", "internal/geo")], "name string, dir string")
    return I.resolve_imports(imports, g.nodes.select("file_path").distinct(), packages, modules)
