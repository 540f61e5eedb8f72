"""Work on many symbols of one name or place: results by brute force, and joins that make no pair for every two of them."""

import random

from pyspark.sql import functions as F

from graphloom import schema
from graphloom.operators import relations as R
from graphloom.operators import resolution as X
from graphloom.operators import traverse as T
from graphloom.plans import exploration as E
from graphloom.schema import Graph
from graphloom.sources import testbed

MANY = 120


def graph(spark, nodes, edges=()):
    """Nodes as (id, file, symbol, fqn, kind, language, start, end)."""
    rows = [(i, 1, f, symbol, fqn, kind, lang, a, b, "", "", "") for i, f, symbol, fqn, kind, lang, a, b in nodes]
    return Graph(spark.createDataFrame(rows, schema.NODES), spark.createDataFrame(list(edges), schema.EDGES))


def joined(df):
    """The rows of ``df``, and the most rows that one of its joins made."""
    rows = df.collect()

    def walk(plan):
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(plan.finalPhysicalPlan())
        if "QueryStage" in name:
            return walk(plan.plan())
        metric = plan.metrics().get("numOutputRows")
        most = [metric.get().value()] if "Join" in name and metric.isDefined() else [0]
        children = plan.children()
        return max(most + [walk(children.apply(i)) for i in range(children.size())])

    return rows, walk(df._jdf.queryExecution().executedPlan())


def test_enclosing_equals_brute_force(spark):
    rng = random.Random(5)
    nodes = [(i, f"f{rng.randrange(2)}", "s", f"p.s{i}", "function", "go", a := rng.randrange(0, 70), a + rng.choice((-1, 0, 0, 1, 3, 10, 64, 900))) for i in range(200)]
    at = [(f"f{rng.randrange(2)}", rng.randrange(0, 140), k) for k in range(200)] + [("f0", 5000, 200)]
    got = {(r.k, r.id, r.start_line) for r in R.enclosing(graph(spark, nodes), spark.createDataFrame(at, "file_path string, line int, k int")).collect()}
    around = {k: [(n[7] - n[6], n[6], n[0]) for n in nodes if n[1] == f and n[6] <= line <= n[7]] for f, line, k in at}
    assert got == {(k, min(v)[2], min(v)[1]) for k, v in around.items() if v}


def test_symbols_in_one_place_make_no_pairs(spark):
    g = graph(spark, [(i, "f", f"s{i}", f"p.s{i}", "function", "go", 1, 9) for i in range(MANY)])
    at = spark.createDataFrame([("f", 5, k) for k in range(MANY)], "file_path string, line int, k int")
    rows, most = joined(R.enclosing(g, at))
    assert {(r.k, r.id) for r in rows} == {(k, 0) for k in range(MANY)} and most <= MANY


def test_declarations_of_one_line_make_no_pairs(spark):
    g = graph(spark, [(i, "f", f"s{i}", f"p.s{i}", "function", "go", 4, 9 + i % 3) for i in range(MANY)])
    at = spark.createDataFrame([("f", 5, k) for k in range(MANY)], "file_path string, line int, k int")
    rows, most = joined(R.nearest_declaration(g, at))
    assert {(r.k, r.id) for r in rows} == {(k, 2) for k in range(MANY)} and most <= MANY


REFS = "ref_id long, from_fqn string, to_name string, kind string, qualified boolean, to_fqn string"


def namesakes(spark):
    return graph(spark, [(i, "lib/a.py", "name", f"a.name{i}", "function", "python", i, i) for i in range(MANY)] + [(999, "m.go", "main", "m.main", "function", "go", 1, 9), (998, "x", "name", "x.name", "function", None, 1, 9)])


def test_names_of_foreign_languages_are_not_met(spark):
    refs = spark.createDataFrame([(k, "m.main", "name", "calls", k % 2 == 0, None) for k in range(MANY)], REFS)
    rows, most = joined(R.resolve_references(namesakes(spark), refs))
    assert {(r.ref_id, r.target_id) for r in rows} == {(k, 998) for k in range(MANY)} and most <= 2 * MANY


def test_whether_a_reference_meets_something_needs_no_pairs(spark):
    g = namesakes(spark)
    refs = spark.createDataFrame([(k, "m.main", "name" if k else "none", "reads", True, None) for k in range(MANY)], REFS)
    whole, brief = (R.resolve_references(g, refs, brief=b) for b in (False, True))
    rows, most = joined(brief)
    assert {r.ref_id for r in rows} == {r.ref_id for r in whole.collect()} == set(range(1, MANY)) and most <= 4 * MANY
    assert [r.to_name for r in X.unresolved_references(g, refs, brief).collect()] == ["none"]


def test_scoped_references_by_line_meet_one_declaration(spark):
    g = graph(spark, [(i, "b.ts", "go", "m.go", "method", "typescript", i + 1, i + 1) for i in range(MANY)])
    refs = spark.createDataFrame([(k, "calls", "b.ts", "m.go", k + 1, "b.ts", "m.go", (k + 1) % MANY + 1) for k in range(MANY)], X.SCOPED)
    rows, most = joined(X.scoped_references(g, refs))
    assert {(r.ref_id, r.source_id, r.target_id) for r in rows} == {(k, k, (k + 1) % MANY) for k in range(MANY)} and most <= MANY


def test_selectors_by_line_meet_the_nodes_there(spark):
    g = graph(spark, [(i, "b.ts", "go", "m.go", "method" if i % 2 else "class", "typescript", i // 2 + 1, i) for i in range(MANY)])
    want = [(k, "b.ts", "m.go", k // 2 + 1, "method" if k % 2 else None) for k in range(MANY)] + [(MANY, "b.ts", "m.go", 0, "class")]
    rows, most = joined(R.resolve_selector(g.nodes, spark.createDataFrame(want, "selector_id long, file_path string, fqn string, start_line int, kind string")))
    own = {(k, k, 1) for k in range(1, MANY, 2)} | {(k, k + d, 2) for k in range(0, MANY, 2) for d in (0, 1)}
    assert {(r.selector_id, r.id, r.matches) for r in rows} == own | {(MANY, i, MANY // 2) for i in range(0, MANY, 2)} and most <= 2 * MANY


def test_ends_of_exact_calls_are_looked_up_once(spark):
    g = graph(spark, [(1, "a.go", "f", "p.f", "function", "go", 1, 2), (2, "b.py", "t", "p.t", "type", "python", 4, 9), (3, "b.py", "u", "p.u", "type", "python", 4, 9)])
    calls = [("a.go", 1, "p.f", "b.py", (4, 0, None)[k % 3], "p.t", False) for k in range(MANY)]
    df = X.located_calls(g, spark.createDataFrame(calls, X.EXACT))
    assert [(r.source_id, r.target_id) for r in df.collect()] == [(1, 2)] * MANY
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.lstrip("+- :").startswith("Aggregate [c") for line in plan.splitlines()) == 2  # distinct ends of callers and of callees


def test_exact_calls_are_worked_out_once(spark):
    g = graph(spark, [(i, "a.go", f"f{i}", f"p.f{i}", "function", "go", i, i) for i in range(1, 31)], [(1, 2, "calls", 1.0, "precise")])
    seen = spark.sparkContext.accumulator(0)
    calls = [("a.go", 1 + k % 30, f"p.f{1 + k % 30}", "a.go", 0, f"p.f{1 + k % 7}", k % 4 == 0) for k in range(MANY)]
    exact = spark.createDataFrame(spark.sparkContext.parallelize(calls).map(lambda c: (seen.add(1), c)[1]), X.EXACT)
    clean = spark.createDataFrame([(1, "b.go")], "project_id long, file_path string")
    after = X.supersede_by_position(g, exact, clean)
    got = [(r.source_id, r.target_id) for r in after.edges.collect()]
    want = [(1 + k % 30, 1 + k % 7) for k in range(MANY) if k % 4 and k % 30 != k % 7]
    assert sorted(got) == sorted(want + [(1, 2)] * ((1, 2) not in want)) and seen.value == MANY
    seen.value = 0
    assert X.pass_counts(g, exact).first().external == MANY // 4 and seen.value == MANY


def test_exact_calls_go_to_their_ends_without_names(spark):
    g = graph(spark, [(1, "a.go", "f", "p.f", "function", "go", 1, 2)])
    plan = X.located_calls(g, spark.createDataFrame([("a.go", 1, "p.f", "a.go", 1, "p.f", False)], X.EXACT))._jdf.queryExecution().optimizedPlan()

    def joins(node):
        columns = [node.output().apply(i).name() for i in range(node.output().size())] if node.nodeName() == "Join" else []
        return [columns] * bool(columns) + [j for i in range(node.children().size()) for j in joins(node.children().apply(i))]

    found = joins(plan)
    assert len(found) == 6 and not [j for j in found if any("caller" in c for c in j) and any("callee" in c for c in j) and not all(c.startswith(("key_", "source_id", "target_id")) for c in j)]


def test_ends_of_exact_calls_equal_brute_force(spark):
    rng = random.Random(41)
    pick = lambda *some: rng.choice((None, *some))
    nodes = [(i, f"f{rng.randrange(3)}", "s", f"p.s{rng.randrange(12)}", "function", "go", rng.randrange(1, 9), 99) for i in range(30)]
    end = lambda: (pick("f0", "f1", "f2"), pick(0, *range(1, 9)), pick(*(f"p.s{k}" for k in range(14))))
    calls = [(*end(), *end(), rng.choice((False, False, True))) for _ in range(400)]

    def node(file, line, fqn):
        at = [n[0] for n in nodes if (n[1], n[6]) == (file, line)]
        return at[0] if len(at) == 1 else max((n[0] for n in nodes if n[3] == fqn), default=None)

    got = X.located_calls(graph(spark, nodes), spark.createDataFrame(calls, X.EXACT)).collect()
    order = lambda row: tuple(-1 if v is None else v for v in row)
    assert sorted(map(order, got)) == sorted(order((node(*c[:3]), node(*c[3:6]))) for c in calls if not c[6])


def test_suppliers_and_customers_of_a_nation_make_no_pairs(spark, tmp_path):
    for table in testbed.TABLES:
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet")
        if table in ("supplier", "customer"):
            rows = rows.crossJoin(spark.range(90 if table == "supplier" else 6).withColumnRenamed("id", "copy"))
            rows = rows.withColumn(f"{table[0]}_nationkey", F.lit(3)).withColumn(k := f"{table[0]}_{table[:4]}key", F.col(k) + 1000 * F.col("copy")).drop("copy")
        rows.write.parquet(f"{tmp_path}/{table}.parquet")
    rows, most = joined(testbed.view(spark, str(tmp_path), "edges", {}))
    first = spark.read.parquet(f"{tmp_path}/customer.parquet").agg(F.min("c_custkey")).first()[0]
    suppliers = {r.s_suppkey for r in spark.read.parquet(f"{tmp_path}/supplier.parquet").collect()}
    got = [(r.source_id, r.target_id) for r in rows if r.edge_type == "calls" and r.source_id >= 6000000000]
    assert sorted(got) == sorted((6000000000 + k, 3000000000 + first) for k in suppliers) and most <= 10_000


def test_walks_through_hubs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(T, "HUB", 6)
    rng = random.Random(11)
    n, cap = 90, 12
    nodes = [(i, f"f{rng.randrange(4)}", f"s{i}", f"p.s{i}", "function", "go", rng.randrange(9), 99) for i in range(n)]
    pairs = {(rng.randrange(n + 3), rng.choice((1, 2, 3)) if rng.random() < 0.6 else rng.randrange(n + 3)) for _ in range(260)}  # three ends are no nodes
    g = graph(spark, nodes, [(a, b, "calls", 0.7, "name") for a, b in pairs])
    roots = spark.createDataFrame([(i, i) for i in range(40)], "id long, root long")
    order = {i: (f, a, fqn, kind, s, i) for i, f, s, fqn, kind, _, a, _ in nodes}
    for depth in (1, 2, 3):
        want = set()
        for root in range(40):
            at = {root: 0}
            for d in range(1, depth + 1):
                for v in [v for v, k in at.items() if k == d - 1]:
                    for a, b in pairs:
                        for x, y in ((a, b), (b, a)):
                            if x == v:
                                at.setdefault(y, d)
            met = sorted((at[i], order[i]) for i in at if i != root and i in order)
            want |= {(root, k[-1], d, p + 1, len(met)) for p, (d, k) in enumerate(met[:cap])}
        got = T.traverse(g, roots, "both", ("calls",), depth, cap).collect()
        assert {(r.root, r.id, r.depth, r.position, r.total) for r in got} == want


def test_what_lies_around_a_hub_is_listed_once(spark):
    g = graph(spark, [(i, "f", f"s{i}", f"p.s{i}", "function", "go", 1, 9) for i in range(1, 800)], [(i, 1, "calls", 0.7, "name") for i in range(2, 800)])
    roots = g.nodes.where("id > 1").select("id", F.col("id").alias("root"))
    rows, most = joined(T.traverse(g, roots, "both", ("calls",), 2, 5))
    assert len(rows) == 798 * 5 and {r.total for r in rows} == {798} and most <= 798 * 10


def test_the_impact_of_a_key_is_one_walk(spark, monkeypatch):
    rng = random.Random(3)
    nodes = [(i, "f", f"s{i}", f"p.s{i}", "function", "go", i, i) for i in range(60)]
    pairs = {(rng.randrange(60), rng.randrange(60)): rng.choice(("name", "precise")) for _ in range(110)}
    g = graph(spark, nodes, [(a, b, "extends", 0.7, p) for (a, b), p in pairs.items()])
    uses = [(f"k{i % 2}", "f", i) for i in range(0, 60, 9)]
    walks, walk = [], T.blast_radius
    monkeypatch.setattr(T, "blast_radius", lambda graph, roots, depth: walks.append({r.root for r in roots.collect()}) or walk(graph, roots, depth))
    got = {(r.key, r.id, r.depth, r.confirmed) for r in E.key_impact(g, spark.createDataFrame(uses, "key string, file_path string, line int")).collect()}
    want = {}
    for key in ("k0", "k1"):
        at = {i: (0, True) for k, _, i in uses if k == key}
        for d in (1, 2, 3):
            step = {}
            for (a, b), p in pairs.items():
                if b in at and at[b][0] == d - 1 and a not in at:
                    step[a] = step.get(a, False) or (at[b][1] and p == "precise")
            at |= {i: (d, sure) for i, sure in step.items()}
        want |= {(key, i): v for i, v in at.items()}
    assert got == {(*k, *v) for k, v in want.items()} and walks == [{"k0", "k1"}]


def written_rows(monkeypatch):
    """The rows of each table that walks write from here on."""
    rows, cut = [], T.cut
    monkeypatch.setattr(T, "cut", lambda df: (out := cut(df), rows.append(out.count()))[0])
    return rows


def fan(spark, roots, ends):
    """Many roots that call one node, which calls many."""
    nodes = [(i, "f", f"s{i}", f"p.s{i}", "function", "go", i, i) for i in range(roots + ends + 1)]
    links = [(i, roots, "calls", 0.7, "name") for i in range(roots)] + [(roots, roots + k, "calls", 0.7, "name") for k in range(1, ends + 1)]
    return graph(spark, nodes, links)


def test_keys_go_back_once_a_node(spark, monkeypatch):
    g = fan(spark, 80, 90)
    roots = g.nodes.where("id < 80").select("id", F.col("id").alias("root"))
    uses = spark.createDataFrame([(f"k{i % 2}", "f", i) for i in range(81, 171)] + [("own", "f", 3)], "key string, file_path string, line int")
    rows = written_rows(monkeypatch)
    got = [(r.root, r.key) for r in E.required_keys(g, roots, uses).collect()]
    assert sorted(got) == sorted([(i, k) for i in range(80) for k in ("k0", "k1")] + [(3, "own")]) and max(rows) <= 2 * 171


def test_required_keys_equal_brute_force(spark):
    rng = random.Random(17)
    pairs = {(rng.randrange(60), rng.randrange(60)) for _ in range(90)}
    g = graph(spark, [(i, "f", f"s{i}", f"p.s{i}", "function", "go", i, i) for i in range(60)], [(a, b, "calls", 0.7, "name") for a, b in pairs])
    uses = [(f"k{rng.randrange(4)}", "f", rng.randrange(60)) for _ in range(20)]
    roots = [(i, f"r{i % 13}") for i in range(30)]
    for depth in (0, 1, 4):
        want = set()
        for i, root in roots:
            at = {i}
            for _ in range(depth):
                at |= {b for a, b in pairs if a in at}
            want |= {(root, key) for key, _, line in uses if line in at}
        found = E.required_keys(g, spark.createDataFrame(roots, "id long, root string"), spark.createDataFrame(uses, "key string, file_path string, line int"), depth)
        assert sorted((r.root, r.key) for r in found.collect()) == sorted(want)


def test_roots_that_call_the_same_nodes_walk_once(spark, monkeypatch):
    g = fan(spark, 80, 90)
    roots, ends = g.nodes.where("id < 80").select("id"), g.nodes.where("id > 80").select("id")
    pairs = roots.withColumnRenamed("id", "root").where("root < 2").crossJoin(ends.select(F.col("id").alias("target")))
    rows = written_rows(monkeypatch)
    got = {(r.root, r.target): r.path for r in T.shortest_paths_to(g, roots, ends, 4).collect()}
    assert got == {(i, k): [i, 80, k] for i in range(80) for k in range(81, 171)} and max(rows) <= 171
    rows.clear()
    assert {(r.root, r.target): r.path for r in T.shortest_paths(g, pairs).collect()} == {x: p for x, p in got.items() if x[0] < 2} and max(rows) <= 2 * 90


def test_registered_paths_are_not_listed_twice(spark, monkeypatch, tmp_path):
    from graphloom.plans import queries as Q

    g = fan(spark, 80, 90)
    kinds = F.when(F.col("id") < 80, "class").when(F.col("id") > 80, "type").otherwise("function")
    monkeypatch.setattr(Q, "graph", lambda spark, sf_dir: Graph(g.nodes.withColumn("kind", kinds), g.edges))
    rows = written_rows(monkeypatch)
    got = {(r.root, r.target, r.path) for r in Q.shortest_paths(spark, str(tmp_path)).collect()}
    assert got == {(i, k, f"{i}>80>{k}") for i in range(80) for k in range(81, 171)} and max(rows) <= 171


def test_shortest_paths_to_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(T, "CELL", 3)
    monkeypatch.setattr(T, "TASK_ROWS", 50)
    rng = random.Random(23)
    # Twenty roots share two sets of calls; one calls itself, two call each other, one is called by what it calls.
    pairs = {(i, k) for i in range(20) for k in ((20, 21), (22,))[i % 2]} | {(20, 3), (22, 3), (4, 4), (6, 8), (8, 6)}
    pairs |= {(rng.randrange(20, 60), rng.randrange(60)) for _ in range(90)}
    g = graph(spark, [(i, "f", f"s{i}", f"p.s{i}", "function", "go", i, i) for i in range(60)], [(a, b, "calls", 0.7, "name") for a, b in pairs for _ in range(2)])
    roots, ends = list(range(24)) + [59], list(range(0, 60, 2)) + [3, 99]
    for depth in (0, 1, 4):
        want = {}
        for root in roots:
            best, level = {root: [root]}, {root: [root]}
            for _ in range(depth or 60):
                step = {}
                for x, path in level.items():
                    for b in [b for a, b in pairs if a == x and b not in best]:
                        step[b] = min(step.get(b, [999]), path + [b])
                best, level = best | step, step
            want |= {(root, t): best[t] for t in ends if t in best}
        got = T.shortest_paths_to(g, spark.createDataFrame([(r,) for r in roots], "id long"), spark.createDataFrame([(t,) for t in ends], "id long"), depth).collect()
        assert len(got) == len(want) and {(r.root, r.target): r.path for r in got} == want
