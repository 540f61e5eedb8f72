"""Walks on random graphs against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.operators import traverse as T
from graphloom.plans import exploration as E
from graphloom.plans import reports as P
from graphloom.schema import Graph

FOLDERS = ["", "cmd/a", "cmd/b", "internal/x", "internal/x/y", "internal/z", "web"]


class Toy:
    """A random graph with namesakes, twins by full name, tests, files and imports."""

    def __init__(self, spark, seed, n=40, m=120):
        rnd = random.Random(seed)
        self.nodes = {}
        for i in range(1, n + 1):
            folder = rnd.choice(FOLDERS)
            name = rnd.choice("abcdefgh")
            kind = rnd.choice(["function", "function", "method", "class", "type", "test"])
            file = f"{folder}/{rnd.choice('pq')}.go".lstrip("/")
            self.nodes[i] = {"file": file, "dir": folder, "symbol": name, "fqn": rnd.choice(["main", f"m{rnd.randint(0, 3)}"]) + "." + name, "kind": kind, "line": rnd.randint(1, 90)}
        self.files = {}
        for f in sorted({v["file"] for v in self.nodes.values()}):
            i = 1000 + len(self.files)
            self.files[f] = i
        kinds = ["calls"] * 6 + ["references", "extends"]
        self.edges = [(rnd.randint(1, n), rnd.randint(1, n), rnd.choice(kinds), rnd.choice(["name", "name", "precise"])) for _ in range(m)]
        ids = list(self.files.values())
        self.imports = [(rnd.choice(ids), rnd.choice(ids), "imports", "name") for _ in range(12)]
        rows = [(i, 1, v["file"], v["symbol"], v["fqn"], v["kind"], "go", v["line"], v["line"] + 5, "", "", "") for i, v in self.nodes.items()]
        rows += [(i, 1, f, None, None, "file", "go", 1, 99, "", "", "") for f, i in self.files.items()]
        links = [(a, b, k, 1.0 if p == "precise" else 0.7, p) for a, b, k, p in self.edges + self.imports]
        self.graph = Graph(spark.createDataFrame(rows, schema.NODES), spark.createDataFrame(links, schema.EDGES), coverage=spark.createDataFrame([], schema.COVERAGE))
        self.roots = spark.createDataFrame([(i, i) for i in (1, 2, 3, 4)], "id long, root long")

    def test(self, i):
        return self.nodes[i]["kind"] == "test"

    def sub(self, i):
        parts = self.nodes[i]["dir"].split("/")
        return "(root)" if parts == [""] else "/".join(parts[:2]) if parts[0] in ("internal", "cmd") and len(parts) > 1 else parts[0]

    def followable(self):
        defs = [i for i, v in self.nodes.items() if v["kind"] in ("function", "method", "class")]
        out = set()
        for a, b, kind, p in self.edges:
            if kind != "calls" or self.test(a) or self.test(b):
                continue
            same = [d for d in defs if self.nodes[d]["symbol"] == self.nodes[b]["symbol"]]
            near = [d for d in same if self.nodes[d]["dir"] == self.nodes[a]["dir"]]
            around = [d for d in same if self.sub(d) == self.sub(a)]
            pick = near[0] if len(near) == 1 else around[0] if not near and len(around) == 1 else None
            twins = [self.nodes[d]["dir"] for d in defs if self.nodes[d]["fqn"] == self.nodes[a]["fqn"]]
            held = [d for d in twins if self.nodes[b]["dir"] == d or (d and self.nodes[b]["dir"].startswith(d + "/"))] if len(twins) > 1 else []
            foreign = bool(held) and max(held, key=len) != self.nodes[a]["dir"]
            if not foreign and (p == "precise" or len(same) <= 1 or pick == b):
                out.add((a, b))
        return out


def levels(start, step, depth):
    seen, frontier = {start: 0}, [start]
    for d in range(1, depth + 1):
        frontier = sorted({y for x in frontier for y in step(x)} - seen.keys())
        seen |= dict.fromkeys(frontier, d)
    return seen


SEEDS = range(2)


@pytest.mark.parametrize("seed", SEEDS)
def test_followable_calls_and_footprint(spark, seed):
    toy = Toy(spark, seed)
    want = toy.followable()
    assert {tuple(r) for r in T.followable_calls(toy.graph).collect()} == want
    some = spark.createDataFrame([(1,), (5,), (5,)], "id long")
    assert {tuple(r) for r in T.followable_calls(toy.graph, some).collect()} == {e for e in want if e[0] in (1, 5)}
    step = lambda x: {b for a, b in want if a == x}
    full = {(r, i, d, False) for r in (1, 2, 3, 4) for i, d in levels(r, step, 4).items()}
    assert {tuple(r) for r in T.footprint(toy.graph, toy.roots).select("root", "id", "depth", "truncated").collect()} == full
    cut = T.footprint(toy.graph, toy.roots, cap=2).collect()
    for r in (1, 2, 3, 4):
        reach = sorted((d, i) for i, d in levels(r, step, 4).items())
        assert sorted((x.depth, x.id) for x in cut if x.root == r) == reach[:2] and all(x.truncated == (len(reach) > 2) for x in cut if x.root == r)


@pytest.mark.parametrize("seed", SEEDS)
@pytest.mark.parametrize("direction", ["out", "in", "both"])
def test_traverse_has_two_kinds_of_vertices(spark, seed, direction):
    toy = Toy(spark, seed, m=30)
    types = ("calls", "references", "imports")
    near = defaultdict(set)
    for a, b, kind, _ in toy.edges + toy.imports:
        if kind in types:
            if direction != "in":
                near[a].add(b)
            if direction != "out":
                near[b].add(a)
    imports = defaultdict(set)
    for a, b, _, _ in toy.imports:
        if direction != "in":
            imports[a].add(b)
        if direction != "out":
            imports[b].add(a)
    step = lambda x: near[x] | (imports[toy.files[toy.nodes[x]["file"]]] if x in toy.nodes else set())
    got = {(r.root, r.id, r.depth, r.total) for r in T.traverse(toy.graph, toy.roots, direction, types, 3, 1000).collect()}
    want = set()
    for r in (1, 2, 3, 4):
        reach = {i: d for i, d in levels(r, step, 3).items() if d}
        want |= {(r, i, d, len(reach)) for i, d in reach.items()}
    assert got == want


@pytest.mark.parametrize("seed", SEEDS)
def test_blast_radius_and_shortest_paths(spark, seed):
    toy = Toy(spark, seed)
    same = defaultdict(int)
    for v in toy.nodes.values():
        same[v["file"], v["symbol"]] += 1
    sure, via, back, calls = defaultdict(bool), {}, defaultdict(set), defaultdict(set)
    for a, b, kind, p in toy.edges:
        if kind in ("calls", "extends"):
            x, y = toy.nodes[a], toy.nodes[b]
            sure[a, b] |= p == "precise" or (kind == "calls" and x["file"] == y["file"] and same[y["file"], y["symbol"]] == 1)
            via[a, b] = min(via.get((a, b), "z"), "" if kind == "calls" else kind)
            back[b].add(a)
        if kind == "calls":
            calls[a].add(b)
    want = set()
    for r in (1, 2, 3, 4):
        dist = levels(r, lambda x: back[x], 3)
        confirmed = {r: True}
        for d in (1, 2, 3):
            for i in [i for i, k in dist.items() if k == d]:
                into = [t for t in dist if dist[t] == d - 1 and (i, t) in via]
                confirmed[i] = any(confirmed[t] and sure[i, t] for t in into)
                want.add((r, i, d, confirmed[i], min(via[i, t] for t in into)))
    assert {tuple(x) for x in T.blast_radius(toy.graph, toy.roots, 3).select("root", "id", "depth", "confirmed", "via").collect()} == want
    pairs = [(r, t) for r in (1, 2, 3, 4) for t in range(1, 41)]
    paths = {}
    for r in (1, 2, 3, 4):
        best, frontier = {r: [r]}, {r: [r]}
        while frontier:
            found = {}
            for x, path in frontier.items():
                for y in calls[x]:
                    if y not in best:
                        found[y] = min(found.get(y, [999]), path + [y])
            best |= found
            frontier = found
        paths |= {(r, t): best[t] for _, t in pairs if t in best}
    got = {(x.root, x.target): x.path for x in T.shortest_paths(toy.graph, spark.createDataFrame(pairs, "root long, target long")).collect()}
    assert got == paths


def every_path(root, calls, depth):
    """All walks in call order, each ended by a return to itself; then read once from first to last, expanding what has not been expanded."""
    walks = [("", (root,))]
    for at, trail in walks:
        if len(trail) <= depth and trail[-1] not in trail[:-1]:
            walks += [(f"{at}{k:03}.", (*trail, c)) for k, c in enumerate(calls.get(trail[-1], []), 1)]
    open_, expanded, out = {""}, {}, []
    for at, trail in sorted(walks):
        if at and at[:-4] not in open_:
            continue
        if at and expanded.get(trail[-2]) != at[:-4]:
            continue
        node = trail[-1]
        leaf = "cycle" if node in trail[:-1] else "repeat" if node in expanded else "depth" if calls.get(node) and len(trail) > depth else None
        if leaf is None and calls.get(node):
            expanded[node] = at
        open_.add(at)
        out.append((at, len(trail) - 1, node, leaf))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_call_trees_in_order(seed):
    rnd = random.Random(seed)
    n = rnd.randint(2, 12)
    calls = {i: sorted(rnd.sample(range(n), rnd.randint(0, min(4, n)))) for i in range(n)}
    depth = rnd.randint(1, 4)
    whole = E.call_tree(0, calls, depth, 10**6)
    assert whole == every_path(0, calls, depth)
    for budget in (1, 2, 3, 5, 8):
        some = E.call_tree(0, calls, depth, budget)
        assert len(some) == min(budget, len(whole)) and {r[:3] for r in some} <= {r[:3] for r in whole}
        shown = {r[0] for r in some}
        for at, _, node, leaf in some:
            lost = [r for r in whole if r[0][:-4] == at and r[0] != "" and r[0] not in shown]
            if lost:
                assert leaf == "max_nodes"


@pytest.mark.parametrize("seed", SEEDS)
def test_flow_trees_and_processes(spark, seed):
    toy = Toy(spark, seed)
    place = lambda i: (toy.nodes[i]["file"], toy.nodes[i]["line"], i)
    calls = defaultdict(list)
    for a, b in sorted(toy.followable(), key=lambda e: place(e[1])):
        calls[a].append(b)
    calls = {k: v[:3] for k, v in calls.items()}
    want = {(r, *row) for r in (1, 2, 3, 4) for row in every_path(r, calls, 3)}
    assert {tuple(r) for r in E.flow_tree(toy.graph, toy.roots, 3, breadth=3).collect()} == want
    rows = E.processes(toy.graph, toy.roots, 3, 10**6).collect()
    whole = {k: [b for a, b in sorted(toy.followable(), key=lambda e: place(e[1])) if a == k][:20] for k in toy.nodes}
    for r in (1, 2, 3, 4):
        first = []
        for _, depth, node, leaf in every_path(r, whole, 3):
            if leaf != "cycle" and node not in [f[0] for f in first]:
                first.append((node, depth))
        assert [(x.id, x.depth) for x in sorted((x for x in rows if x.root == r), key=lambda x: x.position)] == first


@pytest.mark.parametrize("seed", SEEDS)
def test_ranked_processes(spark, seed):
    toy = Toy(spark, seed)
    entries = toy.roots.withColumn("place", -F.col("root"))
    seeds = {20 + 3 * k: k for k in range(5)}
    rows = E.ranked_processes(toy.graph, entries, spark.createDataFrame(list(seeds.items()), "id long, rank int"), limit=2).collect()
    steps = defaultdict(list)
    for x in sorted(E.processes(toy.graph, toy.roots).collect(), key=lambda x: x.position):
        steps[x.root].append(x)
    back = defaultdict(set)
    for a, b, kind, _ in toy.edges:
        if kind in ("calls", "references"):
            back[b].add(a)
    dist = {}
    for s in seeds:
        for i, d in levels(s, lambda x: back[x], 4).items():
            dist[i] = min(d, dist.get(i, 9))
    found = []
    for r in sorted((r for r in (1, 2, 3, 4) if r in dist), key=lambda r: (dist[r], -r)):
        held = [x for x in steps[r] if x.id in seeds]
        if held:
            found.append((-len(held), min(seeds[x.id] for x in held), len(found), r))
    want = []
    for rank, (n, _, _, r) in enumerate(sorted(found)[:2], 1):
        ends = [x.path for x in steps[r] if x.id in seeds]
        path = [x for x in steps[r] if any(e.startswith(x.path) for e in ends)]
        chosen = sorted(path, key=lambda x: (x.path != "", x.id not in seeds, x.path))[:8]
        want += [(rank, r, -n, k, x.id, x.depth, x.id in seeds) for k, x in enumerate(sorted(chosen, key=lambda x: x.path), 1)]
    assert sorted(tuple(x) for x in rows) == sorted(want)


@pytest.mark.parametrize("seed", SEEDS)
def test_key_impact_and_context(spark, seed):
    toy = Toy(spark, seed)
    rnd = random.Random(seed)
    uses = [(f"K{rnd.randint(0, 2)}", v["file"], v["line"] + rnd.randint(0, 2)) for v in list(toy.nodes.values())[::3]]
    rows = E.key_impact(toy.graph, spark.createDataFrame(uses, "key string, file_path string, line int")).collect()
    users = defaultdict(set)
    for key, file, line in uses:
        inside = [i for i, v in toy.nodes.items() if v["file"] == file and v["line"] <= line <= v["line"] + 5]
        users[key].add(min(inside, key=lambda i: (5, toy.nodes[i]["line"], i)))
    of = defaultdict(dict)
    starts = spark.createDataFrame([(i, i) for i in toy.nodes], "id long, root long")
    for r in T.blast_radius(toy.graph, starts, 3).collect():
        of[r.root][r.id] = (r.depth, r.confirmed)
    want = set()
    for key, own in users.items():
        reach = defaultdict(list)
        for u in own:
            reach[u].append((0, True))
            for i, hit in of[u].items():
                reach[i].append(hit)
        for i, hits in reach.items():
            least = min(d for d, _ in hits)
            want.add((key, i, least, any(c for d, c in hits if d == least)))
    assert {(r.key, r.id, r.depth, r.confirmed) for r in rows} == want
    context = P.context(toy.graph, toy.roots, cap=1000).collect()
    for r in (1, 2, 3, 4):
        callers = {a for a, b, k, _ in toy.edges if b == r and k == "calls"}
        assert {x.id for x in context if x.root == r and x.relation == "caller"} == callers
        assert {x.total for x in context if x.root == r and x.relation == "caller"} <= {len(callers)}


def importers(spark, files, links):
    """A graph of files (path, language) and the imports among them, by path."""
    ids = {f: i for i, (f, _) in enumerate(files)}
    rows = [(ids[f], 1, f, None, None, "file", language, 1, 9, "", "", "") for f, language in files]
    return Graph(spark.createDataFrame(rows, schema.NODES), spark.createDataFrame([(ids[a], ids[b], "imports", 1.0, "name") for a, b in links], schema.EDGES))


def test_importing_tests_of_a_hub_are_all_there(spark):
    near = [f"a{i:03}.ts" for i in range(520)]
    tests = [f"t{i}.test.ts" for i in range(3)] + [f"z{i}.test.ts" for i in range(510)]
    links = [(f, "hub.ts") for f in near + tests[3:]] + [(t, near[500 + k]) for k, t in enumerate(tests[:3])]
    graph = importers(spark, [(f, "typescript") for f in ["hub.ts", *near, *tests]], links)
    got = T.importing_tests(graph, spark.createDataFrame([("hub.ts",)], "file_path string"))
    assert sorted((r.file, r.test_file, r.depth) for r in got.collect()) == sorted(("hub.ts", t, 2 if t[0] == "t" else 1) for t in tests)


def test_importing_tests_are_found_at_any_depth(spark):
    chain = [f"m{i}.py" for i in range(10)]
    links = list(zip(chain[1:], chain)) + [("test_end.py", chain[-1]), (chain[0], chain[3]), ("test_far.py", "test_end.py")]
    graph = importers(spark, [(f, "python") for f in [*chain, "test_end.py", "test_far.py"]], links)
    changed = spark.createDataFrame([(chain[0],), (chain[8],)], "file_path string")
    assert {(r.file, r.test_file, r.depth) for r in T.importing_tests(graph, changed).collect()} == {(chain[0], "test_end.py", 10), (chain[8], "test_end.py", 2)}
    assert T.importing_tests(graph, changed, 2).count() == 1


def test_importing_tests_by_package_are_marked(spark):
    # t1 by package alone; t2 by package at 1, by files at 3; t3 only through a.go; t4 by a file of Go and one of another language.
    files = [("m.py", "python"), ("a.go", "go"), ("b.py", "python"), ("c.py", "python"), ("t1_test.go", "go"), ("t2.test.ts", "typescript"), ("t3.test.ts", "typescript"), ("t4_test.py", None)]
    links = [("t1_test.go", "m.py"), ("a.go", "m.py"), ("t2.test.ts", "a.go"), ("t3.test.ts", "a.go"), ("b.py", "m.py"), ("c.py", "b.py"), ("t2.test.ts", "c.py"), ("t4_test.py", "m.py")]
    graph = importers(spark, files, links)
    changed = spark.createDataFrame([("m.py",)], "file_path string")
    by_file = {("m.py", "t2.test.ts", 3, False), ("m.py", "t4_test.py", 1, False)}
    assert {tuple(r) for r in T.importing_tests(graph, changed).collect()} == by_file | {("m.py", "t1_test.go", 1, True), ("m.py", "t3.test.ts", 2, True)}
    assert {tuple(r) for r in T.importing_tests(graph, changed, packages=False).collect()} == by_file


def test_importing_tests_equal_brute_force(spark):
    rnd = random.Random(31)
    files = [(f"f{i}.{'go' if i % 3 == 0 else 'py'}" if i % 4 else f"f{i}_test.{'go' if i % 3 == 0 else 'py'}", "go" if i % 3 == 0 else "python") for i in range(40)]
    links = [(rnd.choice(files)[0], rnd.choice(files)[0]) for _ in range(70)]
    graph = importers(spark, files, links)
    starts = [f for f, _ in files[:12]]
    want = set()
    for start in starts:
        found = {}
        for exact in (False, True):  # chains of files alone come last and win
            at = levels(start, lambda x: {a for a, b in links if b == x and not (exact and a.endswith(".go"))} if x == start or "_test" not in x else (), 99)
            found |= {f: (d, not exact) for f, d in at.items() if d and "_test" in f}
        want |= {(start, f, d, p) for f, (d, p) in found.items()}
    got = T.importing_tests(graph, spark.createDataFrame([(s,) for s in starts], "file_path string")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want and {r.by_package for r in got} == {False, True}
