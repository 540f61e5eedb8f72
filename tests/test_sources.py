"""Sources, functions and streams."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import names, paths
from graphloom.sources import extract as X
from graphloom.sources import files, testbed
from graphloom.operators.imports import resolve_imports
from graphloom.streaming import changes


@pytest.mark.parametrize(
    ("path", "file", "anywhere", "subsystem"),
    [("a/b_test.go", True, True, "a"), ("web/x.spec.ts", True, True, "web"), ("tests/util.py", False, True, "tests"), ("internal/app/x.go", False, False, "internal/app"), ("main.go", False, False, "(root)"), ("test_a.py", True, True, "(root)"), ("cmd/x.go", False, False, "cmd")],
)
def test_paths(spark, path, file, anywhere, subsystem):
    p = F.lit(path)
    row = spark.range(1).select(paths.is_test_file(p).alias("f"), paths.is_test_path(p).alias("p"), paths.subsystem(p).alias("s")).first()
    assert tuple(row) == (file, anywhere, subsystem)


@pytest.mark.parametrize(
    ("glob", "path", "hit"),
    [("vendor", "a/vendor/x.go", True), ("vendor", "a/vendored/x.go", False), ("a/b", "a/b/c.go", True), ("a/b", "x/a/b/c.go", False), ("**/gen/*.go", "x/y/gen/a.go", True), ("./a/b", "a/b", True), ("*.min.js", "web/x.min.js", True), ("dist/", "dist/a.js", True), ("dist/", "web/dist/a.js", False), ("build-*", "x/build-1/a.js", True)],
)
def test_globs(spark, glob, path, hit):
    assert spark.range(1).select(paths.matches_any_glob(F.lit(path), [glob])).first()[0] is hit


def test_query_texts():
    assert names.camel_tokens("parseHTTPRequest now") == ["parse", "http", "request", "now"]
    assert names.lexical_terms("The parsing of parsed files") == ["pars", "file"]
    assert [names.classify_query(q) for q in ("getUser", "how do callers reach this", "fix getUser now", "node store", "the store")] == ["identifier", "natural_language", "identifier", "identifier", "natural_language"]


def test_python_extraction():
    rows = X.python_rows('import os\nclass A(Base):\n    """Doc."""\n    def m(self):\n        self.n(os.getcwd())\ndef test_x():\n    A()\n')
    symbols = {(r[1], r[3]) for r in rows if r[0] == "symbol"}
    assert symbols == {("class", "A"), ("method", "A.m"), ("test", "test_x")}
    assert {(r[1], r[2], r[6]) for r in rows if r[0] == "reference"} == {("imports", "os", None), ("extends", "Base", "A"), ("calls", "A.n", "A.m"), ("calls", "os.getcwd", "A.m"), ("calls", "A", "test_x")}
    assert X.python_rows("def broken(") == []


def test_sql_extraction():
    rows = X.sql_rows("CREATE VIEW v AS WITH c AS (SELECT * FROM t) SELECT * FROM c JOIN u ON 1=1; DELETE FROM t; INSERT INTO w SELECT 1 -- from z\n")
    assert {(r[1], r[2]) for r in rows if r[0] == "reference"} == {("reads", "t"), ("reads", "u"), ("writes", "t"), ("writes", "w")}
    assert ("view", "v") in {(r[1], r[2]) for r in rows if r[0] == "symbol"}


def test_markdown_extraction():
    rows = X.markdown_rows("# A\n[x](docs/x.md)\n## B\ntext\n# C\n[y](https://e.org)\n")
    assert {(r[3], r[4], r[5]) for r in rows if r[0] == "symbol"} == {("A", 1, 4), ("A/B", 3, 4), ("C", 5, 7)}
    assert [(r[2], r[6]) for r in rows if r[0] == "reference"] == [("docs/x.md", "A")]


def test_tree_to_symbols_and_imports(spark, tmp_path):
    for name, text in {"pkg/a.py": "from pkg.b import f\n\ndef g():\n    f()\n", "pkg/b.py": "def f():\n    pass\n", "web/i.ts": "import x from './j'\nexport class K {}\n", "web/j.ts": "export function x() {}\n", "vendor/z.py": "x = 1\n", ".git/h.py": "y = 1\n", "gen.go": "// Code generated by x. DO NOT EDIT.\npackage q\nfunc q() {}\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "b.bin").write_bytes(b"\0\1")
    tree = files.walk_tree(spark, f"file://{tmp_path}")
    assert {r.file_path for r in tree.collect()} == {"pkg/a.py", "pkg/b.py", "web/i.ts", "web/j.ts", "gen.go", "b.bin"}
    rows = X.extract(tree)
    assert {r.fqn for r in rows.where("row = 'symbol'").collect()} == {"g", "f", "K", "x"}
    imports = rows.where("kind = 'imports'").selectExpr("file_path", "name spec")
    assert {(r.file_path, r.target) for r in resolve_imports(imports, tree).collect()} == {("pkg/a.py", "pkg/b.py"), ("web/i.ts", "web/j.ts")}


DIFF = """diff --git a/x.go b/x.go
--- a/x.go
+++ b/x.go
@@ -1,2 +1,3 @@ f
+a
@@ -9 +9,0 @@
-b
diff --git a/o.go b/n.go
rename from o.go
rename to n.go
diff --git a/d.go b/d.go
deleted file mode 100644
--- a/d.go
+++ /dev/null
@@ -1,3 +0,0 @@
"""


def test_diff(spark):
    rows = [tuple(r) for r in files.diff_hunks(spark.createDataFrame([(DIFF,)], "diff string")).collect()]
    assert rows == [("x.go", "M", 1, 3, None, None), ("x.go", "M", None, None, 9, None), ("n.go", "R", None, None, None, "o.go"), ("d.go", "D", None, None, 0, None)]


def test_snapshot_round_trip(spark, tmp_path):
    g = testbed.graph(spark, "/root/testdata/sf0.001")
    files.export_snapshot(g, f"file://{tmp_path}/snap")
    back = files.import_snapshot(spark, f"file://{tmp_path}/snap")
    key = lambda g: sorted(tuple(r) for r in g.edges.join(g.nodes.selectExpr("id source_id", "fqn a", "start_line la"), "source_id").join(g.nodes.selectExpr("id target_id", "fqn b", "start_line lb"), "target_id").groupBy("a", "la", "b", "lb", "edge_type", "provenance").count().collect())
    assert key(back) == key(g)
    assert back.files.count() == g.files.count()


def stream(spark, tmp_path, df):
    df.write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def test_debounce_stream_equals_batch(spark, tmp_path):
    rows = [("p", "a", "write", 0), ("p", "a", "delete", 1), ("p", "b", "write", 1), ("p", "a", "write", 30), ("p", "z", "write", 100000)]
    events = spark.createDataFrame(rows, "project string, path string, op string, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    want = {(r.path, r.op, r.events) for r in changes.debounced(events, "5 seconds").collect()}
    query = changes.debounced(stream(spark, tmp_path, events), "5 seconds").writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    got = {(r.path, r.op, r.events) for r in spark.table("bursts").collect()}
    assert got == want - {("z", "write", 1)}  # still open: the watermark has not passed it
    assert ("a", "delete", 2) in got


def test_batches_reach_one_writer(spark, tmp_path):
    rows = [("p", f"f{i}", "write", i) for i in range(5)]
    events = spark.createDataFrame(rows, "project string, path string, op string, t long")
    seen = []
    changes.apply_batches(stream(spark, tmp_path, events), lambda df, n: seen.append((n, df.count())), str(tmp_path / "c"), min_files=3).trigger(availableNow=True).start().awaitTermination(120)
    assert seen == [(0, 5)]


def test_manifest_merge(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1")], "file_path string, file_hash string")
    batch = spark.createDataFrame([("a", "delete", None), ("b", "write", "2"), ("c", "write", "3")], "path string, op string, file_hash string")
    assert {tuple(r) for r in changes.merged_manifest(old, batch).collect()} == {("b", "2"), ("c", "3")}


def test_idle_spells(spark):
    events = spark.createDataFrame([("p", 0), ("p", 30), ("p", 200), ("q", 10)], "project string, t long").withColumn("ts", F.timestamp_seconds("t"))
    assert {(r.project, r.events) for r in changes.idle_projects(events).collect()} == {("p", 2), ("p", 1), ("q", 1)}


def test_each_text_is_embedded_once(spark):
    from graphloom.operators import search

    texts = spark.createDataFrame([(1, "a", "h1"), (2, "a", "h1"), (3, "bb", "h2")], "id long, text string, digest string")
    calls = spark.sparkContext.accumulator(0)

    def lengths(batch):
        calls.add(len(batch))
        return [[float(len(t))] for t in batch]

    assert {(r.id, r.embedding[0]) for r in search.embed(texts, lengths).collect()} == {(1, 1.0), (2, 1.0), (3, 2.0)}
    assert calls.value == 2


def test_diffs_of_one_tree_are_merged(spark):
    staged = [("a.go", "M", 1, 3, None, None), ("b.go", "A", 1, 9, None, None), ("c.go", "M", None, None, None, None), ("d.go", "R", None, None, None, "old/d.go")]
    working = [("a.go", "D", None, None, 0, None), ("b.go", "M", 4, 5, None, None), ("d.go", "M", 7, 8, None, None), ("a.go", "M", 1, 3, None, None)]
    frames = [spark.createDataFrame(r, files.HUNKS) for r in (staged, working)]
    extra = spark.createDataFrame([("new.go",), ("new.go",), ("a.go",)], "file_path string")
    got = {tuple(r) for r in files.merged_hunks(frames, extra).select("file_path", "status", "start_line", "end_line", "deletion_point", "old_path").collect()}
    assert got == {("a.go", "D", 1, 3, None, None), ("a.go", "D", None, None, 0, None), ("b.go", "A", 1, 9, None, None), ("b.go", "A", 4, 5, None, None), ("c.go", "M", None, None, None, None), ("d.go", "R", 7, 8, None, "old/d.go"), ("new.go", "?", None, None, None, None)}
