"""Budgets by trial, digest trees against plain comparison, and tests by name."""

import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.operators import digests as D
from graphloom.operators.grep import grep
from graphloom.operators.maintenance import file_delta
from graphloom.plans import reports as P
from graphloom.schema import Graph


def trimmed(lists, plan, budget):
    """Lists after cutting them in the order of ``plan``, entry by entry, until all fits."""
    lists = {k: list(v) for k, v in lists.items()}
    for key, floor in plan:
        while len(lists.get(key, [])) > floor and math.ceil(sum(map(sum, lists.values())) / 4) > budget:
            lists[key].pop()
    return lists


@pytest.mark.parametrize("seed", range(3))
def test_budget_cuts_no_more_than_it_must(spark, seed):
    rnd = random.Random(seed)
    plan = [("source", 0), ("callee", 1), ("caller", 2)]
    lists = {g: {k: [rnd.randint(0, 60) for _ in range(rnd.randint(0, 6))] for k in ("caller", "callee", "source", "kept")} for g in range(12)}
    rows = [(g, k, i, size) for g, own in lists.items() for k, sizes in own.items() for i, size in enumerate(sizes, 1)]
    df = spark.createDataFrame(rows, "root long, relation string, position int, size int")
    for budget in (0, 40, 90, 10_000):
        kept = P.fit_budget(df, "root", "relation", "position", "size", plan, budget)
        want = sorted((g, k, i, s) for g, own in lists.items() for k, sizes in trimmed(own, plan, budget).items() for i, s in enumerate(sizes, 1))
        assert sorted(map(tuple, kept.collect())) == want, budget
    summary = P.budget_summary(df, P.fit_budget(df, "root", "relation", "position", "size", plan, 40), "root", "relation", "size")
    for r in summary.collect():
        own = trimmed(lists[r.root], plan, 40)
        assert (r.total, r.kept, r.dropped, r.tokens) == (len(lists[r.root][r.relation]), len(own[r.relation]), len(lists[r.root][r.relation]) - len(own[r.relation]), math.ceil(sum(map(sum, own.values())) / 4))


def manifest(spark, rows):
    return spark.createDataFrame([(p, f"d{i % 7}/f{i}.go", h) for p, i, h in rows], "project_id long, file_path string, file_hash string")


@pytest.mark.parametrize("seed", range(1, 3))
def test_digest_trees_find_what_differs(spark, seed):
    rnd = random.Random(seed)
    before = [(1, i, "a") for i in range(300)]
    after = [(p, i, rnd.choice(["a", "b"]) if rnd.random() < 0.05 else h) for p, i, h in before if rnd.random() > 0.02] + [(1, 1000 + k, "n") for k in range(seed)]
    a, b = manifest(spark, before), manifest(spark, after)
    want = {tuple(r) for r in file_delta(a, b).collect()}
    assert {tuple(r) for r in D.delta_by_digests(a, b).collect()} == want
    assert {tuple(r) for r in D.delta_by_digests(a, b, D.file_tree(a), D.file_tree(b)).collect()} == want
    changed = {r.file_path for r in file_delta(a, b).collect()}
    touched = {r.b for r in spark.createDataFrame([(p,) for p in changed], "p string").select(D.bucket(F.col("p")).alias("b")).collect()} if changed else set()
    assert {r.prefix for r in D.unequal_buckets(D.file_tree(a), D.file_tree(b)).collect()} == touched
    assert D.unequal_buckets(D.file_tree(a), D.file_tree(a)).count() == 0
    assert D.delta_by_digests(a.limit(0), b).count() == len(after)


def test_trees_are_of_projects_and_levels(spark):
    tree = D.file_tree(manifest(spark, [(p, i, "x") for p in (1, 2) for i in range(50)])).collect()
    roots = {r.project_id: r.digest for r in tree if r.level == 0}
    assert len(roots) == 2 and roots[1] == roots[2] and all(len(r.prefix) == r.level for r in tree)
    one = D.file_tree(manifest(spark, [(1, i, "y" if i == 3 else "x") for i in range(50)])).collect()
    assert next(r.digest for r in one if r.level == 0) != roots[1]


def test_structure_sees_a_move(spark):
    row = (1, 1, "a.go", "f", "m.f", "function", "go", 1, 5, "f()", "doc", "h")
    tree = lambda *rows: {(r.level, r.digest) for r in D.structural_tree(spark.createDataFrame(list(rows), schema.NODES)).where("level = 0").collect()}
    moved = (*row[:7], 2, *row[8:])
    other_id = (99, *row[1:])
    file = (2, 1, "a.go", None, None, "file", "go", 1, 9, "", "", "z")
    assert tree(row) == tree(other_id) == tree(row, file) != tree(moved)


def test_tests_by_name_count_only_for_names_of_one(spark):
    rows = [(1, 1, "a.ts", "save", "m.save", "function", "typescript", 1, 5, "", "", ""), (2, 1, "a.ts", "load", "m.load", "function", "typescript", 7, 9, "", "", ""), (3, 1, "b.ts", "load", "n.load", "function", "typescript", 1, 5, "", "", ""), (4, 1, "a.test.ts", "t", "t", "test", "typescript", 1, 5, "", "", ""), (5, 1, "a.ts", "sent", "m.sent", "function", "typescript", 11, 12, "", "", "")]
    g = Graph(spark.createDataFrame(rows, schema.NODES), spark.createDataFrame([(4, 5, "calls", 1.0, "precise")], schema.EDGES), coverage=spark.createDataFrame([(1, "a.ts", "lsp")], schema.COVERAGE))
    sources = spark.createDataFrame([("a.test.ts", "it(() => save(1) && load() && sent)"), ("b.test.ts", "m.save()"), ("c.test.ts", "unsaved(); saves()"), ("main.ts", "save()")], "file_path string, content string")
    roots = spark.createDataFrame([(i, i) for i in (1, 2, 5)], "id long, root long")
    got = {r.root: (r.tests, r.named_tests, r.untested) for r in P.impact(g, roots, sources=sources).collect()}
    assert got == {1: (0, 2, False), 2: (0, 0, True), 5: (1, 0, False)}
    hunks = spark.createDataFrame([("a.ts", "M", 1, 9, None, None)], "file_path string, status string, start_line int, end_line int, deletion_point int, old_path string")
    plain, named = (P.review_summary(P.review(g, hunks, sources=s)).first() for s in (None, sources))
    assert (plain.covered, plain.uncovered, plain.coverage) == (0, 2, "uncovered") and (named.covered, named.uncovered, named.coverage) == (1, 1, "partial")


def test_grep_names_the_symbol_around(spark):
    nodes = [(1, 1, "a.go", None, None, "file", "go", 1, 9, "", "", ""), (2, 1, "a.go", "Big", "m.Big", "class", "go", 2, 9, "", "", ""), (3, 1, "a.go", "f", "m.f", "method", "go", 4, 6, "", "", "")]
    g = Graph(spark.createDataFrame(nodes, schema.NODES), spark.createDataFrame([], schema.EDGES))
    files = [
        ("a.go", "x = todo\n\nTODO here\ntodo(1)\r\n  todo(2)\n" + "é" * 400 + "todo\n"),
        ("b.go", "nothing\n"),
        ("bin.go", "todo\0"),
        ("big.go", "todo" + " " * (4 << 20)),
        ("long.go", "todo\n" + "y" * ((1 << 20) + 1) + "\ntodo\n"),
        ("none.go", None),
    ]
    df = spark.createDataFrame(files, "file_path string, content string")
    hits, report = grep(g, df, "todo")
    got = [(r.file_path, r.line, r.symbol, r.resolution) for r in sorted(hits.collect(), key=lambda r: (r.file_path, r.line))]
    assert got == [("a.go", 1, None, "none"), ("a.go", 4, "f", "exact"), ("a.go", 5, "f", "enclosing"), ("a.go", 6, "f", "enclosing"), ("long.go", 1, None, "none")]
    assert hits.where("line = 4").first().matched_line == "todo(1)" and hits.where("line = 6").first().matched_line == "é" * 300 + "…"
    assert report.first().asDict() == {"files_scanned": 4, "files_skipped": 2, "total": 5, "truncated": False}
    hits, report = grep(g, df, "^TODO|x =", regex=True, ignore_case=True, top=2)
    assert hits.count() == 2 and report.first().total == 4 and report.first().truncated
    assert grep(g, df, "tOdO", ignore_case=True)[1].first().total == 6
    with pytest.raises(ValueError):
        grep(g, df, "")
