"""The kept index against searches of all nodes, through updates and merges."""

import random

from pyspark.sql import functions as F

from graphloom.operators import search as S
from graphloom.operators import text_index as X
from graphloom.schema import NODES
from graphloom.sources.store import EMPTY, Store

WORDS = "order orders ordering cancel cancelled user session token parse parser parsing café überholt ab x".split()
QUERIES = ["cancel the orders", "parsing tokens of a user session", "café", "nothing here", "über", "the of"]


def make(spark, rnd, ids):
    rows = []
    for i in ids:
        pick = lambda n: " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, n)))
        kind = rnd.choice(["function", "file", "type", "test", "variable"])
        rows.append((i, 1, f"src/{pick(1)}/{rnd.choice(WORDS)}{'_test' if kind == 'test' else ''}.go", rnd.choice([None, pick(2)]), pick(3), kind, "go", 1, 2, pick(3), rnd.choice([None, pick(9)]), "h"))
    return spark.createDataFrame(rows, NODES)


def same(spark, version, nodes):
    for query in QUERIES:
        got = [tuple(r) for r in X.lexical_search(spark, version, nodes, query, 30).collect()]
        assert got == [tuple(r) for r in S.lexical_search(nodes, query, 30).collect()], query


def test_index_follows_nodes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "MOST_SEGMENTS", 2)
    rnd = random.Random(3)
    store = Store(spark, f"file://{tmp_path}/s")
    nodes = make(spark, rnd, range(80))
    version = X.update(store, nodes)
    same(spark, version, nodes)
    assert X.update(store, nodes) == version  # nothing changed, nothing is published
    older = version
    for k in range(3):  # nodes change, go and come; the third update merges segments first
        changed = make(spark, rnd, range(10 * k, 10 * k + 15))
        later = nodes.join(changed.select("id"), "id", "left_anti").where(F.col("id") % 11 != k).select(*nodes.columns).union(changed).union(make(spark, rnd, [200 + k]))
        later.write.parquet(str(tmp_path / f"n{k}"))
        before, nodes = nodes, spark.read.parquet(str(tmp_path / f"n{k}"))
        version = X.update(store, nodes)
        same(spark, version, nodes)
        same(spark, older, before)  # a pinned version still answers for its nodes
        older = version
    assert len(X._segments(version)) <= 2
    assert X.lexical_search(spark, EMPTY, nodes, "order").count() == 0


def test_a_gone_node_is_not_found_and_an_update_is_small(spark, tmp_path):
    rnd = random.Random(4)
    store = Store(spark, f"file://{tmp_path}/s")
    nodes = make(spark, rnd, range(60)).cache()
    X.update(store, nodes)
    rest = nodes.where("id <> 7")
    version = X.update(store, rest)
    assert version.read(spark, "gone/2").count() == 1 and version.read(spark, "entries/2").count() == 0
    same(spark, version, rest)


def test_a_search_reads_the_parts_of_its_terms(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    version = X.update(store, make(spark, random.Random(5), range(200)))
    found = X.postings_of(spark, version, ["order"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,order)" in plan and "PartitionFilters: [isnotnull(part" in plan and "part#" in plan
    assert found.count() > 0


def test_semantic_hits_come_alone(spark):
    nodes = make(spark, random.Random(6), range(40)).where("kind <> 'file'")
    some = [r.id for r in nodes.limit(3).collect()]
    near = spark.createDataFrame([(i, 1.0 - k / 10) for k, i in enumerate(some)] + [(9999, 2.0)], "id long, score double")
    rows = S.cascade(nodes, "order", 10, near).collect()
    assert [(r.id, r.mode, r.position) for r in rows] == [(i, "semantic", k + 1) for k, i in enumerate(some)]
    none = S.cascade(nodes, "order", 10, near.where("id = 9999")).collect()
    assert none and {r.mode for r in none} <= {"name", "lexical"}
