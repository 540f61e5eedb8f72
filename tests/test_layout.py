"""How work is dealt to tasks: no task gets most of a table, and nothing is worked out once a level that can be worked out once."""

import shutil

from pyspark.sql import functions as F

from graphloom import schema
from graphloom.operators import maintenance as M
from graphloom.operators import text_index as X
from graphloom.operators import traverse as T
from graphloom.plans import exploration as E
from graphloom.schema import Graph
from graphloom.sources import testbed
from graphloom.sources.store import Store


def chain(spark, n):
    nodes = [(i, 1, f"src/f{i % 7}.go", f"Order{i}", f"src.Order{i}", "function", "go", i, i, "", "order", "") for i in range(n)]
    return Graph(spark.createDataFrame(nodes, schema.NODES), spark.createDataFrame([(i, i + 1, "calls", 1.0, "precise") for i in range(n - 1)], schema.EDGES))


def test_nodes_of_one_table_do_not_lie_in_one_file(spark, tmp_path):
    for table in testbed.TABLES:
        shutil.copy(f"/root/testdata/sf0.01/{table}.parquet", tmp_path)
    least = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    spark.conf.set(least, "16KB")  # the table is small
    try:
        nodes = testbed.graph(spark, str(tmp_path)).nodes
    finally:
        spark.conf.unset(least)
    sizes = [r["count"] for r in nodes.groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) <= 0.6 * sum(sizes)


def test_a_frequent_word_lies_in_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "PIECE", 25, raising=False)
    nodes = chain(spark, 200).nodes
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # the words are few
    try:
        version = X.update(Store(spark, f"file://{tmp_path}/s"), nodes)
    finally:
        spark.conf.unset(coalesce)
    found = version.read(spark, "postings/1", X.POSTINGS).where("term = 'order'")
    assert found.select(F.input_file_name()).distinct().count() > 1
    got = X.lexical_search(spark, version, nodes, "order", 300)
    assert got.count() == 200
    # Once as a docstring and once as the beginning of two names.
    assert {r.tf0 for r in X.postings_of(spark, version, ["order"]).collect()} == {18.0}


def test_positions_take_one_sort_of_bounded_ranges(spark, monkeypatch):
    monkeypatch.setattr(M, "RANGE", 20, raising=False)
    nodes = chain(spark, 200).nodes
    got = M.node_positions(nodes)
    assert "row_number" not in got._jdf.queryExecution().optimizedPlan().toString()
    order = nodes.orderBy("file_path", "start_line", "fqn", "kind", "symbol", "id").collect()
    assert {r.id: r.position for r in got.collect()} == {r.id: k for k, r in enumerate(order)}


def test_folders_of_nodes_are_worked_out_once_a_walk(spark, monkeypatch):
    seen, real = [], T.paths.subsystem
    monkeypatch.setattr(T.paths, "subsystem", lambda c: seen.append(1) or real(c))
    graph = chain(spark, 9)
    roots = spark.createDataFrame([(0, 0)], "id long, root long")
    assert {(r.id, r.depth) for r in T.footprint(graph, roots, 4).collect()} == {(k, k) for k in range(5)}
    assert len(seen) == 1


def test_trees_are_dealt_to_tasks(spark):
    graph = chain(spark, 40)
    tree = E.flow_tree(graph, graph.nodes.select("id", F.col("id").alias("root")), 2)
    assert tree.rdd.getNumPartitions() > 1
    assert {(r.root, r.path, r.id) for r in tree.where("root = 3").collect()} == {(3, "", 3), (3, "001.", 4), (3, "001.001.", 5)}
