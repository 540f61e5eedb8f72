"""Tests by name in impact and review, reports within a budget, and comparisons by digest trees, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import digests as D
from ..operators import grep as R
from ..schema import Graph
from ..sources.files import merged_hunks
from ..sources.testbed import graph, view, with_sql
from . import reports as P
from .queries import BLAST, G, ROOTS, query, suppliers
from .report_queries import CHANGED_ROOTS, CONTEXT, IMPACT_ROWS, LEVEL, RISK_ROWS

#: Suppliers have names that are words, which test files of every other nation use; a few are used nowhere else.
WORDS = "renamed AS (SELECT * REPLACE (replace(symbol, '#', '_') AS symbol) FROM nodes), sources AS (SELECT 'tests/n' || s_nationkey || '_test.go' AS file_path, string_agg('use(' || replace(s_name, '#', '_') || '); ', '') AS content FROM supplier WHERE s_nationkey % 2 = 0 GROUP BY s_nationkey)"
NAMED = """named AS (SELECT r.root, count(DISTINCT s.file_path) AS named_tests FROM roots r JOIN renamed n ON n.id = r.id JOIN sources s ON list_contains(regexp_extract_all(s.content, '[A-Za-z0-9_]+'), n.symbol)
WHERE (SELECT count(*) FROM renamed x WHERE x.symbol = n.symbol) = 1 GROUP BY r.root)"""


def _named(g: Graph) -> Graph:
    return Graph(g.nodes.withColumn("symbol", F.translate("symbol", "#", "_")), g.edges, g.files, g.coverage, g.annotations)


def _sources(spark, sf_dir):
    rows = view(spark, sf_dir, "supplier").where("s_nationkey % 2 = 0")
    text = F.array_join(F.collect_list(F.concat(F.lit("use("), F.translate("s_name", "#", "_"), F.lit("); "))), "")
    return rows.groupBy(F.concat(F.lit("tests/n"), "s_nationkey", F.lit("_test.go")).alias("file_path")).agg(text.alias("content"))


@query(G + ", " + ROOTS + ", " + WORDS + ", " + NAMED + ", " + BLAST + ", " + IMPACT_ROWS + """ SELECT i.root, affected, tests, CASE WHEN tests > 0 THEN 0 ELSE coalesce(named_tests, 0) END AS named_tests, tests = 0 AND coalesce(named_tests, 0) = 0 AS untested
FROM imp i LEFT JOIN named n ON n.root = i.root""")
def impact_by_name(spark, sf_dir):
    g = _named(graph(spark, sf_dir))
    return P.impact(g, suppliers(g, spark), sources=_sources(spark, sf_dir)).select("root", "affected", "tests", "named_tests", "untested")


@query(
    with_sql("nodes", "edges", "coverage", "hunks") + ", " + CHANGED_ROOTS + ", " + WORDS + ", " + NAMED + ", " + BLAST + ", " + RISK_ROWS.replace("NOT unresolved AND tests = 0 THEN 0.9", "NOT unresolved AND tests = 0 AND n2.named_tests IS NULL THEN 0.9").replace("JOIN unr u ON u.root = i.root)", "JOIN unr u ON u.root = i.root LEFT JOIN named n2 ON n2.root = i.root)")
    + f" SELECT root, tests, score::DOUBLE AS score, {LEVEL} AS level FROM risk"
)
def review_by_name(spark, sf_dir):
    return P.review(_named(graph(spark, sf_dir)), view(spark, sf_dir, "hunks"), sources=_sources(spark, sf_dir)).select("root", "tests", "score", "level")


#: Lists of a context, the least important first, and how many entries stay of each.
PLAN = [("callee", 2), ("caller", 3)]
BUDGET = 90
SIZED = "sized AS (SELECT k.root, k.relation, k.position, k.id, strlen(n.fqn) + strlen(n.file_path) + 40 AS size FROM k JOIN nodes n ON n.id = k.id WHERE k.position <= 25)"
#: By trial: how much is left for each number of entries that stay of callees, then of callers; the largest that fits wins.
FITTED = f"""sums AS (SELECT root, relation, position, sum(size) OVER (PARTITION BY root, relation ORDER BY position) AS upto FROM sized),
size_of AS (SELECT root, relation, 0 AS n, 0 AS bytes FROM sized GROUP BY root, relation UNION ALL SELECT root, relation, position, upto FROM sums),
total AS (SELECT root, count(*) FILTER (relation = 'callee') AS callees, count(*) FILTER (relation = 'caller') AS callers FROM sized GROUP BY root),
tries AS (SELECT t.root, a.n AS keep_callee, b.n AS keep_caller, a.bytes + b.bytes AS bytes, t.callees, t.callers FROM total t
  JOIN (SELECT root, n, bytes FROM size_of WHERE relation = 'callee' UNION ALL SELECT root, 0, 0 FROM total WHERE callees = 0) a ON a.root = t.root
  JOIN (SELECT root, n, bytes FROM size_of WHERE relation = 'caller' UNION ALL SELECT root, 0, 0 FROM total WHERE callers = 0) b ON b.root = t.root
  WHERE a.n >= least(t.callees, {PLAN[0][1]}) AND b.n >= least(t.callers, {PLAN[1][1]}) AND (b.n = t.callers OR a.n = least(t.callees, {PLAN[0][1]}))),
best AS (SELECT root, arg_max(keep_callee, rank) AS keep_callee, arg_max(keep_caller, rank) AS keep_caller FROM (SELECT *, CASE WHEN ceil(bytes / 4) <= {BUDGET} THEN 1000000 + keep_callee + keep_caller ELSE -(keep_callee + keep_caller) END AS rank FROM tries) GROUP BY root)"""


@query(G + ", " + ROOTS + ", " + CONTEXT + ", " + SIZED + ", " + FITTED + " SELECT s.root, s.relation, s.position, s.id FROM sized s JOIN best b ON b.root = s.root WHERE s.position <= CASE s.relation WHEN 'callee' THEN keep_callee ELSE keep_caller END")
def budgeted_context(spark, sf_dir):
    """Callers and callees of all suppliers, as many as fit."""
    g = graph(spark, sf_dir)
    rows = P.context(g, suppliers(g, spark)).where("relation in ('caller', 'callee')").join(g.nodes.select("id", "fqn", "file_path"), "id")
    sized = rows.withColumn("size", F.octet_length("fqn") + F.octet_length("file_path") + 40)
    return P.fit_budget(sized, "root", "relation", "position", "size", PLAN, BUDGET).select("root", "relation", "position", "id")


@query(with_sql("files", "later") + " SELECT coalesce(a.file_path, b.file_path) AS file_path, CASE WHEN a.file_path IS NULL THEN 'new' WHEN b.file_path IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM files a FULL JOIN later b ON a.file_path = b.file_path WHERE a.file_hash IS DISTINCT FROM b.file_hash")
def digest_delta(spark, sf_dir):
    return D.delta_by_digests(view(spark, sf_dir, "files"), view(spark, sf_dir, "later"))


_TREE = "SELECT substr(md5(file_path), 1, 3) AS prefix, sha256(string_agg(file_path || chr(0) || file_hash || chr(10), '' ORDER BY file_path || chr(0) || file_hash)) AS digest FROM {t} GROUP BY 1"


@query(with_sql("files", "later") + f" SELECT coalesce(a.prefix, b.prefix) AS prefix FROM ({_TREE.format(t='files')}) a FULL JOIN ({_TREE.format(t='later')}) b ON a.prefix = b.prefix WHERE a.digest IS DISTINCT FROM b.digest")
def unequal_buckets(spark, sf_dir):
    return D.unequal_buckets(D.file_tree(view(spark, sf_dir, "files")), D.file_tree(view(spark, sf_dir, "later"))).select("prefix")


_LINE = " || ".join(f"coalesce({c}::VARCHAR, '') || chr(0)" for c in D.STRUCTURE) + " || chr(10)"


@query(
    G + f""", l3 AS (SELECT substr(md5(file_path), 1, 3) AS prefix, sha256(string_agg(line, '' ORDER BY line)) AS digest FROM (SELECT file_path, {_LINE} AS line FROM nodes WHERE kind <> 'file') GROUP BY 1),
l2 AS (SELECT substr(prefix, 1, 2) AS prefix, sha256(string_agg(prefix || digest, '' ORDER BY prefix)) AS digest FROM l3 GROUP BY 1), l1 AS (SELECT substr(prefix, 1, 1) AS prefix, sha256(string_agg(prefix || digest, '' ORDER BY prefix)) AS digest FROM l2 GROUP BY 1)
SELECT sha256(string_agg(prefix || digest, '' ORDER BY prefix)) AS fingerprint FROM l1"""
)
def structural_fingerprint(spark, sf_dir):
    return D.structural_tree(graph(spark, sf_dir).nodes).where("level = 0").select(F.col("digest").alias("fingerprint"))


#: Files of suppliers with a line for each of their symbols' lines.
TEXTS = "texts AS (SELECT file_path, array_to_string(list_transform(range(1, max(end_line) + 11), lambda k: 'call_' || (k % 50) || '(' || file_path || ')'), chr(10)) AS content FROM nodes WHERE kind = 'class' GROUP BY file_path)"


def _texts(g: Graph):
    lines = F.transform(F.sequence(F.lit(1), F.max("end_line") + 10), lambda k: F.concat(F.lit("call_"), (k % 50).cast("string"), F.lit("("), F.col("file_path"), F.lit(")")))
    return g.nodes.where("kind = 'class'").groupBy("file_path").agg(F.array_join(lines, "\n").alias("content"))


@query(
    G + ", " + TEXTS
    + """, hit AS (SELECT file_path, unnest(list_filter(range(1, len(string_split(content, chr(10))) + 1), lambda k: contains(string_split(content, chr(10))[k], 'call_7('))) AS line FROM texts),
first AS (SELECT * FROM hit ORDER BY file_path, line LIMIT 1000),
met AS (SELECT f.*, n.symbol, n.fqn, n.kind, n.start_line, row_number() OVER (PARTITION BY f.file_path, f.line ORDER BY n.end_line - n.start_line, n.start_line, n.id) AS rn FROM first f LEFT JOIN nodes n ON n.file_path = f.file_path AND n.start_line <= f.line AND f.line <= n.end_line)
SELECT file_path, line, symbol, kind, CASE WHEN symbol IS NULL THEN 'none' WHEN start_line = line THEN 'exact' ELSE 'enclosing' END AS resolution FROM met WHERE rn = 1"""
)
def grep_symbols(spark, sf_dir):
    g = graph(spark, sf_dir)
    return R.grep(g, _texts(g), "call_7(", top=1000)[0].select("file_path", "line", "symbol", "kind", "resolution")


#: A later diff of some of the files, and files no diff shows.
WORKING = """working AS (SELECT file_path, CASE WHEN substr(md5(file_path), 6, 1) < '3' THEN 'A' ELSE 'M' END AS status, CAST(5 + length(file_path) AS INT) AS start_line, CAST(9 + length(file_path) AS INT) AS end_line, CAST(NULL AS INT) AS deletion_point, CAST(NULL AS VARCHAR(9)) AS old_path FROM files WHERE substr(md5(file_path), 5, 1) < '9'
UNION ALL SELECT file_path, 'R', NULL, NULL, NULL, 'old/' || substr(file_path, 1, 4) FROM files WHERE substr(md5(file_path), 7, 1) = '0'),
untracked AS (SELECT 'new/' || file_path AS file_path FROM files WHERE substr(md5(file_path), 8, 1) = '0' UNION ALL SELECT file_path FROM files WHERE substr(md5(file_path), 8, 1) < '4')"""


@query(
    with_sql("nodes", "hunks", "files") + ", " + WORKING + """, every AS (SELECT file_path, status, start_line, end_line, deletion_point, NULL::VARCHAR AS old_path, 0 AS k FROM hunks UNION ALL SELECT *, CASE status WHEN 'R' THEN 2 ELSE 1 END FROM working),
per AS (SELECT file_path, coalesce(arg_min(status, k) FILTER (status <> 'M'), 'M') AS status, max(old_path) AS old_path, bool_and(start_line IS NULL AND deletion_point IS NULL) AS bare FROM every GROUP BY file_path)
SELECT DISTINCT b.file_path, p.status, b.start_line, b.end_line, b.deletion_point, p.old_path FROM every b JOIN per p ON p.file_path = b.file_path WHERE p.bare OR b.start_line IS NOT NULL OR b.deletion_point IS NOT NULL
UNION ALL SELECT DISTINCT file_path, '?', NULL::INT, NULL::INT, NULL::INT, NULL::VARCHAR FROM untracked WHERE file_path NOT IN (SELECT file_path FROM per)"""
)
def merged_diff(spark, sf_dir):
    """The staged diff, a working one, and renames as a third."""
    files = view(spark, sf_dir, "files")
    at = lambda k: F.substring(F.md5("file_path"), k, 1)
    none = F.lit(None).cast("int")
    changed = files.where(at(5) < "9").select("file_path", F.when(at(6) < "3", "A").otherwise("M").alias("status"), (5 + F.length("file_path")).cast("int").alias("start_line"), (9 + F.length("file_path")).cast("int").alias("end_line"), none.alias("deletion_point"), F.lit(None).cast("string").alias("old_path"))
    renamed = files.where(at(7) == "0").select("file_path", F.lit("R").alias("status"), none.alias("start_line"), none.alias("end_line"), none.alias("deletion_point"), F.concat(F.lit("old/"), F.substring("file_path", 1, 4)).alias("old_path"))
    untracked = files.where(at(8) == "0").select(F.concat(F.lit("new/"), "file_path").alias("file_path")).unionByName(files.where(at(8) < "4").select("file_path"))
    staged = view(spark, sf_dir, "hunks").withColumn("old_path", F.lit(None).cast("string"))
    return merged_hunks([staged, changed, renamed], untracked)
