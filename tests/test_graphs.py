"""Operators on toy graphs with answers worked out by hand."""

import pytest
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.operators import aggregates as A
from graphloom.operators import maintenance as M
from graphloom.operators import relations as R
from graphloom.operators import search as S
from graphloom.operators import traverse as T
from graphloom.plans import reports as P
from graphloom.schema import Graph


def make(spark, nodes, edges, **tables):
    """nodes: name -> (kind, file, start, end); edges: (source, target, type, provenance)."""
    ids = {n: i for i, n in enumerate(nodes, 1)}
    rows = [(ids[n], 1, f, n.split("@")[0].rsplit(".", 1)[-1], n.split("@")[0], k, "go", a, b, "", "", "h") for n, (k, f, a, b) in nodes.items()]
    links = [(ids[s], ids[t], kind, 1.0 if p == "precise" else 0.7, p) for s, t, kind, p in edges]
    g = Graph(spark.createDataFrame(rows, schema.NODES), spark.createDataFrame(links, schema.EDGES), **tables)
    return g, ids


def function(file="a/x.go", start=1, end=5):
    return ("function", file, start, end)


def roots(spark, ids, *names):
    return spark.createDataFrame([(ids[n], ids[n]) for n in names], "id long, root long")


def chain(spark):
    nodes = {"Top": function(), "Run": function(start=10, end=15), "Helper": function(start=20, end=25), "Other": function("b/y.go"), "TestHelper": ("test", "a/x_test.go", 1, 9)}
    edges = [("Top", "Run", "calls", "name"), ("Run", "Helper", "calls", "precise"), ("Other", "Helper", "calls", "name"), ("Other", "Run", "calls", "precise"), ("TestHelper", "Helper", "calls", "precise")]
    return make(spark, nodes, edges)


def test_chain(spark):
    g, ids = chain(spark)
    assert {r.symbol for r in R.callers(g, roots(spark, ids, "Helper")).collect()} == {"Run", "Other", "TestHelper"}
    path = T.shortest_paths(g, spark.createDataFrame([(ids["Top"], ids["Helper"])], "root long, target long")).first().path
    assert path == [ids["Top"], ids["Run"], ids["Helper"]]
    assert A.hotspots(g, 1).first().symbol == "Helper"
    row = P.impact(g, roots(spark, ids, "Helper")).first()
    assert (row.affected, row.direct, row.indirect, row.tests, row.untested) == (4, 3, 1, 1, False)


def test_cycle_ends_and_leaves_the_start_out(spark):
    g, ids = make(spark, {n: function(start=10 * i, end=10 * i + 5) for i, n in enumerate("ABCD")}, [("A", "B", "calls", "precise"), ("B", "C", "calls", "precise"), ("C", "A", "calls", "precise"), ("D", "A", "calls", "precise")])
    found = {r.id: r.depth for r in T.blast_radius(g, roots(spark, ids, "A"), 10).collect()}
    assert found == {ids["C"]: 1, ids["D"]: 1, ids["B"]: 2}
    assert T.shortest_paths(g, spark.createDataFrame([(ids["A"], ids["D"])], "root long, target long")).count() == 0


def test_one_confirmed_shortest_path_is_enough(spark):
    files = {n: function(f"{n}/x.go") for n in ("S", "L", "M", "T", "U")}
    g, ids = make(spark, files, [("S", "L", "calls", "precise"), ("S", "M", "calls", "name"), ("L", "T", "calls", "precise"), ("M", "T", "calls", "precise"), ("U", "M", "calls", "name")])
    found = {r.id: r.confirmed for r in T.blast_radius(g, roots(spark, ids, "T"), 3).collect()}
    assert found == {ids["L"]: True, ids["M"]: True, ids["S"]: True, ids["U"]: False}


def test_via_prefers_calls(spark):
    g, ids = make(spark, {"B": ("class", "b/b.go", 1, 9), "C": ("class", "c/c.go", 1, 9), "D": ("class", "d/d.go", 1, 9)}, [("C", "B", "extends", "name"), ("C", "B", "calls", "name"), ("D", "B", "extends", "name")])
    assert {r.id: r.via for r in T.blast_radius(g, roots(spark, ids, "B")).collect()} == {ids["C"]: "", ids["D"]: "extends"}


def test_name_calls_are_shared_among_namesakes(spark):
    nodes = {"Close": function("a/a.go"), "Close@2": function("b/b.go"), "Close@3": function("c/c.go"), "Use": function("d/d.go"), "Exact": function("e/e.go")}
    edges = [("Use", n, "calls", "name") for n in ("Close", "Close@2", "Close@3")] + [("Exact", "Close", "calls", "precise")]
    g, ids = make(spark, nodes, edges)
    found = {r.id: round(r.effective, 4) for r in A.ranked_hotspots(g).collect()}
    assert found == {ids["Close"]: 1.3333, ids["Close@2"]: 0.3333, ids["Close@3"]: 0.3333}


def test_overrides(spark):
    nodes = {"B": ("class", "b.py", 1, 9), "C": ("class", "c.py", 1, 9), "B.m": ("method", "b.py", 2, 3), "C.m": ("method", "c.py", 2, 3), "B.constructor": ("method", "b.py", 4, 5), "C.constructor": ("method", "c.py", 4, 5), "C.n": ("method", "c.py", 6, 7)}
    g, ids = make(spark, nodes, [("C", "B", "extends", "name")])
    assert [tuple(r) for r in R.overrides(g).collect()] == [(ids["C.m"], ids["B.m"])]


def test_innermost_symbol(spark):
    g, ids = make(spark, {"K": ("class", "a.go", 1, 1000), "m": ("method", "a.go", 10, 20), "inner": ("function", "a.go", 12, 14)}, [("K", "m", "calls", "name")])
    at = spark.createDataFrame([("a.go", 13), ("a.go", 18), ("a.go", 999), ("a.go", 1001), ("b.go", 13)], "file_path string, line int")
    assert {r.line: r.symbol for r in R.enclosing(g, at).collect()} == {13: "inner", 18: "m", 999: "K"}


def test_changed_symbols(spark):
    g, ids = make(spark, {"f": function(start=1, end=10), "g": function(start=12, end=20), "h": function("gone.go"), "k": function("moved.go")}, [("f", "g", "calls", "name")])
    hunks = spark.createDataFrame([("a/x.go", "M", 9, 10, None), ("a/x.go", "M", None, None, 10), ("gone.go", "D", None, None, None), ("moved.go", "R", None, None, None)], "file_path string, status string, start_line int, end_line int, deletion_point int")
    assert {r.symbol for r in R.changed_symbols(g, hunks).collect()} == {"f", "h", "k"}
    inside = hunks.limit(0).union(spark.createDataFrame([("a/x.go", "M", None, None, 15)], hunks.schema))
    assert {r.symbol for r in R.changed_symbols(g, inside).collect()} == {"g"}


def test_projects_stay_apart(spark):
    g, ids = chain(spark)
    twin = g.nodes.withColumn("id", F.col("id") + 100).withColumn("project_id", F.lit(2).cast("long"))
    links = g.edges.withColumn("source_id", F.col("source_id") + 100).withColumn("target_id", F.col("target_id") + 100)
    both = Graph(g.nodes.unionByName(twin), g.edges.unionByName(links)).project(1)
    assert both.nodes.count() == 5 and both.edges.count() == 5
    assert {r.id for r in R.callers(both, R.roots_by_symbol(both, ["Helper"])).collect()} == {ids[n] for n in ("Run", "Other", "TestHelper")}


def test_inconsistencies(spark):
    notes = spark.createDataFrame([(1, 1, "node", "Gone", "note", None, "x"), (2, 1, "node", "f", "note", None, "y")], schema.ANNOTATIONS)
    cover = spark.createDataFrame([(1, "a/x.go", "types"), (1, "old.go", "types")], schema.COVERAGE)
    g, _ = make(spark, {"f": function(), "g": function("b/y.go")}, [("f", "g", "calls", "name")], coverage=cover, annotations=notes)
    assert {r["class"]: r.n for r in P.inconsistencies(g).collect()} == {"dangling_annotation": 1, "name_calls_on_covered_file": 1, "coverage_without_nodes": 1}


def test_generations_follow_identity(spark):
    old, ids = make(spark, {"f": function(start=1, end=3), "o": function(start=10, end=11), "o@2": function(start=20, end=21), "gone": function(start=30, end=31), "caller": function("b/y.go")}, [("caller", n, "calls", "precise") for n in ("f", "o", "o@2", "gone")])
    fresh, _ = make(spark, {"f": function(start=101, end=103), "o": function(start=110, end=111), "o@2": function(start=120, end=121), "renamed": function(start=130, end=131)}, [("f", "o", "calls", "name")])
    fresh = Graph(fresh.nodes.withColumn("id", F.col("id") + 50), fresh.edges.limit(0))
    nxt, surface = M.replace_files(old, fresh, spark.createDataFrame([("a/x.go",)], "file_path string"))
    assert sorted((r.target_id, r.provenance) for r in nxt.edges.collect()) == [(51, "name"), (52, "name"), (53, "name")]
    assert [r.file_path for r in surface.collect()] == ["a/x.go"]
    assert nxt.nodes.count() == 5


def test_walks_do_not_depend_on_order_or_copies_of_edges(spark):
    g, ids = chain(spark)
    shaken = Graph(g.nodes.repartition(7), g.edges.union(g.edges).repartition(5))
    want = sorted(map(tuple, T.blast_radius(g, roots(spark, ids, "Helper")).collect()))
    assert sorted(map(tuple, T.blast_radius(shaken, roots(spark, ids, "Helper")).collect())) == want


@pytest.mark.parametrize(("level", "limit", "fails"), [("high", "medium", True), ("medium", "medium", False), ("unknown", "low", False)])
def test_gate(spark, level, limit, fails):
    row = P.gate(spark.createDataFrame([(level, "covered", 0)], "level string, coverage string, uncovered long"), limit).first()
    assert row.would_fail is fails


def test_risk_without_a_call_graph_is_unknown(spark):
    nodes = {"App": function("web/app.ts"), "Run": function("lib/run.go")}
    for i in range(6):
        nodes[f"C{i}"] = function(f"p{i % 2}/c.go", start=10 * i, end=10 * i + 5)
        nodes[f"D{i}"] = function(f"q{i}/d.go")
    edges = [*((f"C{i}", "Run", "calls", "precise") for i in range(6)), *((f"D{i}", f"C{i}", "calls", "precise") for i in range(6))]
    g, ids = make(spark, nodes, edges)
    g = Graph(g.nodes.withColumn("language", F.when(F.col("symbol") == "App", "typescript").otherwise("go")), g.edges)
    row = P.risk(g, roots(spark, ids, "App")).first()
    assert (row.level, row.score, row.unresolved) == ("unknown", 0.3, True)
    row = P.risk(g, roots(spark, ids, "Run")).first()
    # Six direct callers in two packages, though eight packages lie in the radius, and no test.
    assert (row.packages, row.direct, row.level, row.score) == (2, 6, "high", 0.93)


def test_flow_tree_marks_cycles_and_repeats(spark):
    from graphloom.plans import exploration as E

    nodes = {n: function(f"d/{n}.go", start=i) for i, n in enumerate("ABCDE", 1)}
    links = [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("D", "E"), ("D", "A")]
    g, ids = make(spark, nodes, [(s, t, "calls", "precise") for s, t in links])
    rows = E.flow_tree(g, roots(spark, ids, "A"), 4).orderBy("path").collect()
    back = {v: k for k, v in ids.items()}
    assert [(r.path, back[r.id], r.leaf) for r in rows] == [("", "A", None), ("001.", "B", None), ("001.001.", "D", None), ("001.001.001.", "A", "cycle"), ("001.001.002.", "E", None), ("002.", "C", None), ("002.001.", "D", "repeat")]


def test_required_keys_and_key_impact(spark):
    from graphloom.plans import exploration as E

    g, ids = make(spark, {"main": function("a.go", 1, 9), "load": function("a.go", 20, 29), "other": function("b.go", 1, 9)}, [("main", "load", "calls", "precise")])
    uses = spark.createDataFrame([("DB_URL", "a.go", 22), ("TOKEN", "b.go", 3)], "key string, file_path string, line int")
    assert [r.key for r in E.required_keys(g, roots(spark, ids, "main"), uses).collect()] == ["DB_URL"]
    assert {(r.key, r.id, r.depth) for r in E.key_impact(g, uses).collect()} == {("DB_URL", ids["load"], 0), ("DB_URL", ids["main"], 1), ("TOKEN", ids["other"], 0)}


def test_features(spark):
    from graphloom.plans import exploration as E

    texts = spark.createDataFrame([("a.js", "x\napp.get('/users', list)\n"), ("main.go", "func main() {\n"), ("n.go", "nothing\n")], "file_path string, content string")
    assert {(r.file_path, r.line, r.kind, r.name) for r in E.features(texts).collect()} == {("a.js", 2, "http_route", "/users"), ("main.go", 1, "program", "main")}


def test_embedding_text_is_whole(spark):
    long = "x" * 2500
    rows = [(1, "function", long + "a", "f()", "m.f", "body"), (2, "function", long + "b", "f()", "m.f", ""), (3, "function", "", "f()", "m.f", "body"), (4, "file", "", "", "m", None)]
    nodes = spark.createDataFrame(rows, "id long, kind string, docstring string, signature string, fqn string, source string")
    found = {r.id: r for r in S.embedding_text(nodes).collect()}
    assert {k: r.text for k, r in found.items()} == {1: long + "a\nf()\nm.f\nbody", 2: long + "b\nf()\nm.f", 3: "f()\nm.f\nbody"}
    assert len({r.digest for r in S.embedding_text(nodes.drop("source")).collect()}) == 3
    assert all(len(r.text) <= 2000 for r in S.embedding_text(nodes, 2000).collect())
