"""A code-shaped graph projected from star-schema tables, written once as SQL both Spark and DuckDB read.

Customers are functions (every seventh a test), orders their methods, parts types, suppliers classes, nations and
regions modules. Calls run customer - order - part - supplier - customer, so traversals meet cycles.
"""

from __future__ import annotations

import contextlib
import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

from ..operators import text_index as X
from ..operators.lineage import shared_folder
from ..schema import Graph
from .store import EMPTY, Conflict, Store, Version, file_system

NODES = """
SELECT 1000000000 + CAST(r_regionkey AS BIGINT) AS id, CAST(1 AS BIGINT) AS project_id, 'cmd/geo/region.go' AS file_path, r_name AS symbol, 'geo.' || r_name AS fqn, 'module' AS kind, 'go' AS language,
       CAST(1 + r_regionkey * 10 AS INT) AS start_line, CAST(9 + r_regionkey * 10 AS INT) AS end_line, 'module ' || r_name AS signature, 'Region of the world' AS docstring, md5(r_name) AS source_hash FROM {region}
UNION ALL
SELECT 2000000000 + CAST(n_nationkey AS BIGINT), CAST(1 AS BIGINT), 'internal/geo/nation.go', n_name, 'geo.nation.' || n_name, 'module', 'go',
       CAST(1 + n_nationkey * 10 AS INT), CAST(9 + n_nationkey * 10 AS INT), 'module ' || n_name, 'Nation of a region', md5(n_name) FROM {nation}
UNION ALL
SELECT 3000000000 + c_custkey, CAST(1 AS BIGINT), 'internal/' || lower(c_mktsegment) || '/n' || CAST(c_nationkey AS VARCHAR(9)) || CASE WHEN c_custkey % 7 = 0 THEN '_test.go' ELSE '.go' END, c_name,
       lower(c_mktsegment) || '.' || c_name, CASE WHEN c_custkey % 7 = 0 THEN 'test' ELSE 'function' END, 'go',
       CAST(1 + (c_custkey % 50) * 100 AS INT), CAST(100 + (c_custkey % 50) * 100 AS INT), 'func ' || c_name || '()', 'Handles orders of the ' || lower(c_mktsegment) || ' segment', md5(c_name) FROM {customer}
UNION ALL
SELECT 4000000000 + o_orderkey, CAST(1 AS BIGINT), 'internal/' || lower(c_mktsegment) || '/n' || CAST(c_nationkey AS VARCHAR(9)) || CASE WHEN c_custkey % 7 = 0 THEN '_test.go' ELSE '.go' END, 'Order#' || CAST(o_orderkey AS VARCHAR(20)),
       lower(c_mktsegment) || '.' || c_name || '.Order#' || CAST(o_orderkey AS VARCHAR(20)), 'method', 'go',
       CAST(2 + (c_custkey % 50) * 100 + o_orderkey % 90 AS INT), CAST(6 + (c_custkey % 50) * 100 + o_orderkey % 90 AS INT), 'func (c) order' || CAST(o_orderkey AS VARCHAR(20)) || '()', 'Order of priority ' || o_orderpriority, md5('Order#' || CAST(o_orderkey AS VARCHAR(20)))
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
UNION ALL
SELECT 5000000000 + p_partkey, CAST(1 AS BIGINT), 'internal/part/' || lower(replace(p_brand, '#', '_')) || '.py', p_name, 'part.' || p_name, 'type', 'python',
       CAST(1 + (p_partkey % 80) * 20 AS INT), CAST(20 + (p_partkey % 80) * 20 AS INT), 'class ' || p_name, p_type, md5(p_name) FROM {part}
UNION ALL
SELECT 6000000000 + s_suppkey, CAST(1 AS BIGINT), 'web/supplier/n' || CAST(s_nationkey AS VARCHAR(9)) || CASE WHEN s_nationkey % 5 = 4 THEN '.test.ts' ELSE '.ts' END, s_name, 'supplier.' || s_name, 'class', 'typescript',
       CAST(1 + (s_suppkey % 40) * 30 AS INT), CAST(30 + (s_suppkey % 40) * 30 AS INT), 'class ' || s_name, 'Supplies parts', md5(s_name) FROM {supplier}
"""

EDGES = """
SELECT 3000000000 + o_custkey AS source_id, 4000000000 + o_orderkey AS target_id, 'calls' AS edge_type, CAST(0.7 AS DOUBLE) AS weight, 'name' AS provenance FROM {orders} JOIN {customer} ON o_custkey = c_custkey
UNION ALL
SELECT DISTINCT 4000000000 + l_orderkey, 5000000000 + l_partkey, 'calls', CAST(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.7 END AS DOUBLE), CASE WHEN l_returnflag = 'N' THEN 'precise' ELSE 'name' END
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey
UNION ALL
SELECT 5000000000 + l_partkey, 6000000000 + min(l_suppkey), 'calls', CAST(CASE WHEN l_partkey % 2 = 0 THEN 1.0 ELSE 0.7 END AS DOUBLE), CASE WHEN l_partkey % 2 = 0 THEN 'precise' ELSE 'name' END
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey GROUP BY l_partkey
UNION ALL
SELECT 6000000000 + s_suppkey, 3000000000 + min(c_custkey), 'calls', CAST(1.0 AS DOUBLE), 'precise' FROM {supplier} JOIN {customer} ON s_nationkey = c_nationkey GROUP BY s_suppkey
UNION ALL
SELECT DISTINCT 5000000000 + l_partkey, 6000000000 + l_suppkey, 'references', CAST(0.7 AS DOUBLE), 'name' FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey WHERE l_returnflag = 'R'
UNION ALL
SELECT 6000000000 + s_suppkey, 2000000000 + CAST(s_nationkey AS BIGINT), 'imports', CAST(1.0 AS DOUBLE), 'name' FROM {supplier}
UNION ALL
SELECT 3000000000 + c_custkey, 2000000000 + CAST(c_nationkey AS BIGINT), 'imports', CAST(1.0 AS DOUBLE), 'name' FROM {customer}
UNION ALL
SELECT 2000000000 + CAST(n_nationkey AS BIGINT), 1000000000 + CAST(n_regionkey AS BIGINT), 'extends', CAST(1.0 AS DOUBLE), 'name' FROM {nation}
"""

FILES = "SELECT DISTINCT CAST(1 AS BIGINT) AS project_id, file_path, md5(file_path) AS file_hash, CAST(length(file_path) * 100 AS BIGINT) AS size_bytes FROM {nodes}"
#: Files whose calls an exact resolver has covered, and two rows for files that are gone.
COVERAGE = """
SELECT project_id, file_path, 'types' AS resolver FROM {files} WHERE substr(file_hash, 1, 1) < '8'
UNION ALL SELECT CAST(1 AS BIGINT), 'internal/old/gone.go', 'types' UNION ALL SELECT CAST(1 AS BIGINT), 'web/old/gone.ts', 'lsp'
"""
#: The manifest of the working tree later on: some files changed, some gone, some new.
LATER = """
SELECT project_id, file_path, CASE WHEN substr(file_hash, 2, 1) < '4' THEN md5(file_hash) ELSE file_hash END AS file_hash, size_bytes FROM {files} WHERE substr(file_hash, 2, 1) <> 'f'
UNION ALL SELECT project_id, 'new/' || file_path, file_hash, size_bytes FROM {files} WHERE substr(file_hash, 3, 1) = '0'
"""
ANNOTATIONS = """
SELECT c_custkey AS id, CAST(1 AS BIGINT) AS project_id, 'node' AS kind, CASE WHEN c_custkey % 100 = 0 THEN 'gone.' || c_name ELSE lower(c_mktsegment) || '.' || c_name END AS target, 'note' AS source,
       'x' || CAST(c_custkey AS VARCHAR(20)) AS external_id, 'balance ' || CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR(20)) AS note FROM {customer} WHERE c_custkey % 20 = 0
UNION ALL
SELECT 1000000 + s_suppkey, CAST(1 AS BIGINT), 'path', s_name || ' -> Customer#000000001', 'note', CAST(NULL AS VARCHAR(20)), 'path note' FROM {supplier} WHERE s_suppkey % 5 = 0
"""
#: Ranges of changed lines; a null range with a deletion point is a pure deletion.
HUNKS = """
SELECT DISTINCT file_path, CASE WHEN substr(md5(file_path), 4, 1) = '0' THEN 'D' ELSE 'M' END AS status, CAST(1 + id % 40 * 50 AS INT) AS start_line, CAST(20 + id % 40 * 50 AS INT) AS end_line, CAST(NULL AS INT) AS deletion_point FROM {nodes} WHERE kind IN ('function', 'type') AND id % 10 = 3
UNION ALL
SELECT DISTINCT file_path, 'M', CAST(NULL AS INT), CAST(NULL AS INT), CAST(end_line AS INT) - 10 FROM {nodes} WHERE kind = 'class' AND id % 5 = 1
"""
#: Positions to look up.
POSITIONS = "SELECT file_path, CAST(start_line + id % 13 AS INT) AS line, id AS position_id FROM {nodes}"
#: References still to resolve, from customers to names of parts and suppliers.
REFS = """
SELECT o_orderkey AS ref_id, lower(c_mktsegment) || '.' || c_name AS from_fqn, p_name AS to_name, 'calls' AS kind, o_orderkey % 2 = 0 AS qualified, CAST(NULL AS VARCHAR(200)) AS to_fqn
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {lineitem} ON l_orderkey = o_orderkey AND l_linenumber = 1 JOIN {part} ON l_partkey = p_partkey
UNION ALL
SELECT 10000000000 + l_partkey, 'part.' || p_name, s_name, 'references', true, CASE WHEN l_partkey % 3 = 0 THEN 'supplier.' || s_name WHEN l_partkey % 3 = 1 THEN 'gone.' || s_name END
FROM (SELECT l_partkey, min(l_suppkey) AS l_suppkey FROM {lineitem} GROUP BY l_partkey) x JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey
"""

#: References within files: from orders (in their file, anywhere, or with a wrong line) to suppliers and parts in theirs.
SCOPED_REFS = """
SELECT o_orderkey AS ref_id, CASE WHEN o_orderkey % 3 = 0 THEN 'extends' ELSE 'calls' END AS kind, CASE WHEN o_orderkey % 4 <> 1 THEN f.file_path END AS from_file, f.fqn AS from_name,
       CAST(CASE WHEN o_orderkey % 5 = 0 THEN 7 ELSE f.start_line END AS INT) AS from_line, CASE WHEN o_orderkey % 7 <> 2 THEN t.file_path END AS to_file, t.fqn AS to_name,
       CAST(CASE WHEN o_orderkey % 2 = 0 THEN t.start_line ELSE 0 END AS INT) AS to_line
FROM {orders} JOIN (SELECT l_orderkey, min(l_suppkey) AS l_suppkey, min(l_partkey) AS l_partkey FROM {lineitem} GROUP BY l_orderkey) x ON l_orderkey = o_orderkey JOIN {nodes} f ON f.id = 4000000000 + o_orderkey
     JOIN {nodes} t ON t.id = CASE WHEN o_orderkey % 3 = 1 THEN 6000000000 + l_suppkey ELSE 5000000000 + l_partkey END
"""
#: Calls as an exact resolver finds them, by position and full name; some ends are known by neither, some leave the project.
EXACT = """
SELECT f.file_path AS caller_file, CAST(f.start_line AS INT) AS caller_line, f.fqn AS caller_fqn, t.file_path AS callee_file, CAST(CASE WHEN l_linenumber = 2 THEN 0 ELSE t.start_line END AS INT) AS callee_line,
       CASE WHEN l_linenumber = 3 THEN 'gone.' || t.fqn ELSE t.fqn END AS callee_fqn, l_linenumber = 4 AS external
FROM {lineitem} JOIN {nodes} f ON f.id = 4000000000 + l_orderkey JOIN {nodes} t ON t.id = 5000000000 + l_partkey
"""

VIEWS = {"nodes": NODES, "edges": EDGES, "files": FILES, "coverage": COVERAGE, "later": LATER, "annotations": ANNOTATIONS, "hunks": HUNKS, "positions": POSITIONS, "refs": REFS, "scoped_refs": SCOPED_REFS, "exact": EXACT}
#: What Spark reads in place of a view, with the same rows: a supplier calls the first customer of its nation, which is found before the two
#: meet, since pairs of them grow with the square of the tables.
AS_READ = {"edges": EDGES.replace("JOIN {customer} ON s_nationkey", "JOIN (SELECT c_nationkey, min(c_custkey) AS c_custkey FROM {customer} GROUP BY c_nationkey) c ON s_nationkey")}


def view(spark: SparkSession, sf_dir: str, name: str, have: dict[str, DataFrame] | None = None) -> DataFrame:
    """One of VIEWS, or a table of ``sf_dir``, as a DataFrame. ``have`` keeps what was opened, so no table is opened twice; by itself it
    holds the indexed tables of the graph."""
    have = (_pinned(spark, sf_dir) if name in VIEWS else {}) if have is None else have
    if name not in have:
        if name in VIEWS:
            inputs = {k: view(spark, sf_dir, k, have) for k in sorted(set(re.findall(r"{(\w+)}", VIEWS[name])))}
            have[name] = spark.sql(AS_READ.get(name, VIEWS[name]), **inputs)
        else:
            have[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return have[name]


def _stamp(spark: SparkSession, sf_dir: str) -> str:
    """A digest of names, lengths and times of all files of the tables: another state of the tables has another one."""
    seen = []
    for table in TABLES:
        fs, path = file_system(spark, f"{sf_dir}/{table}.parquet")
        for s in fs.listStatus(path) if fs.exists(path) else []:
            seen.append(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(seen)).encode()).hexdigest()


#: Tables the graph is projected from, and what of it is indexed.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
INDEXED = ("nodes", "edges")


def indexed(spark: SparkSession, sf_dir: str) -> Store:
    """The store of the graph of ``sf_dir``, indexed first if it has no version: queries read an index, as they do after
    ``plans.indexing``. It lies in the folder of ``spark.checkpoint.dir`` and goes with the application."""
    root = f"{shared_folder(spark)}/graph-{spark.sparkContext.applicationId}-{_stamp(spark, sf_dir)}"
    store = Store(spark, root)
    if store.pin() is EMPTY:
        have: dict[str, DataFrame] = {}
        nodes, edges = (view(spark, sf_dir, k, have) for k in INDEXED)
        # Nodes are dealt by id: as projected, all methods would come in the few splits of one table, and every scan would wait for these.
        dealt = nodes.repartition("id")
        # Walks read one family of edges at a time.
        by_family = lambda folder: edges.repartition("edge_type", "target_id").write.partitionBy("edge_type").parquet(folder)
        with contextlib.suppress(Conflict):  # another thread was faster
            store.publish(EMPTY, {"nodes": dealt, "edges": by_family})
        fs, where = file_system(spark, root)
        fs.deleteOnExit(where)
    return store


def _pinned(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    version = indexed(spark, sf_dir).pin()
    have = {k: version.read(spark, k) for k in INDEXED}
    return have | {"edges": have["edges"].select("source_id", "target_id", "edge_type", "weight", "provenance")}


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of ``sf_dir``, pinned to one version of its store; what is not indexed is derived from that."""
    have = _pinned(spark, sf_dir)
    return Graph(*(view(spark, sf_dir, k, have) for k in ("nodes", "edges", "files", "coverage", "annotations")))


def text_index(spark: SparkSession, sf_dir: str) -> Version:
    """The version of the store with an index of the words of the graph's nodes, which is made on first use and kept from then on."""
    store = indexed(spark, sf_dir)
    version = store.pin()
    if not any(k.startswith("entries/") for k in version.tables):
        version = X.update(store, version.read(spark, "nodes"))
    return version


def with_sql(*names: str) -> str:
    """The CTEs of those views for DuckDB, with what they read from, ready for more after a comma."""
    out: dict[str, str] = {}

    def add(name: str) -> None:
        for inner in re.findall(r"{(\w+)}", VIEWS[name]):
            if inner in VIEWS and inner not in out:
                add(inner)
        out[name] = re.sub(r"{(\w+)}", r"\1", VIEWS[name])

    for name in names:
        if name not in out:
            add(name)
    return "WITH RECURSIVE " + ", ".join(f"{k} AS ({v})" for k, v in out.items())
