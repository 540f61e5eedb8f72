"""Rules of scoped references and of the exact pass, worked out by hand."""

from graphloom import schema
from graphloom.operators import resolution as X
from graphloom.schema import Graph


def graph(spark, nodes, edges=(), coverage=()):
    rows = [(i, 1, f, fqn.split(".")[-1] if fqn else None, fqn, kind, lang, line, line + 3, "", "", "") for i, f, fqn, kind, line, lang in nodes]
    files = sorted({(1, r[2], "h", 1) for r in rows})
    return Graph(spark.createDataFrame(rows, schema.NODES), spark.createDataFrame(list(edges), schema.EDGES), spark.createDataFrame(files, schema.FILES), spark.createDataFrame(list(coverage), schema.COVERAGE))


NODES = [
    (1, "a.ts", None, "file", 1, "typescript"),
    (2, "a.ts", "m.run", "function", 5, "typescript"),
    (3, "a.ts", "m.run", "function", 20, "typescript"),
    (4, "b.ts", "m.run", "function", 5, "typescript"),
    (5, "b.ts", "m.Base", "class", 30, "typescript"),
    (6, "b.ts", "m.Base", "type", 40, "typescript"),
    (7, "b.ts", "m.go", "method", 50, "typescript"),
    (8, "b.ts", "m.go", "section", 60, "typescript"),
]


def test_scoped_references(spark):
    refs = [
        (1, "calls", "a.ts", "m.run", 20, "b.ts", "m.run", 0),  # its line names the source
        (2, "calls", "a.ts", "m.run", 0, "b.ts", "m.run", 0),  # else the first one
        (3, "calls", "a.ts", "m.run", 99, "a.ts", "m.run", 99),  # a line that has moved: all targets but itself
        (4, "calls", "a.ts", "a.ts", 0, "a.ts", "m.run", 20),  # the file itself, and one target by line
        (5, "calls", None, "m.run", 0, "b.ts", "m.Base", 0),  # the last of that name anywhere; no type is called
        (6, "extends", "a.ts", "m.run", 5, "b.ts", "m.Base", 0),  # both can be inherited
        (7, "extends", "a.ts", "m.run", 5, "b.ts", "m.go", 0),
        (8, "calls", "a.ts", "m.run", 5, None, "m.run", 0),
        (9, "calls", "a.ts", "m.none", 0, "b.ts", "m.run", 0),
        (10, "calls", "a.ts", "m.run", 5, "b.ts", "m.go", 60),  # the line decides first, then the kind
        (11, "calls", "a.ts", "m.run", 5, "b.ts", "m.go", 0),
    ]
    got = {(r.ref_id, r.source_id, r.target_id) for r in X.scoped_references(graph(spark, NODES), spark.createDataFrame(refs, X.SCOPED)).collect()}
    assert got == {(1, 3, 4), (2, 2, 4), (3, 2, 3), (4, 1, 3), (5, 4, 5), (6, 2, 5), (6, 2, 6), (11, 2, 7)}


GO = [
    (1, "a.go", None, "file", 1, "go"),
    (2, "a.go", "p.first", "function", 1, "go"),  # shares its line with the file
    (3, "a.go", "p.main", "function", 10, "go"),
    (4, "cmd/m.go", "p.main", "function", 10, "go"),
    (5, "cmd/m.go", "p.x", "function", 20, "go"),
    (6, "cmd/m.go", "p.y", "function", 20, "go"),
    (7, "w.ts", "w.z", "function", 3, "typescript"),
]


def test_exact_pass(spark):
    old = [(3, 5, "calls", 0.7, "name"), (3, 6, "calls", 1.0, "precise"), (4, 2, "calls", 0.7, "name"), (7, 3, "calls", 0.7, "name"), (3, 2, "references", 0.7, "name")]
    coverage = [(1, "cmd/m.go", "types"), (1, "w.ts", "lsp"), (1, "a.go", "lsp")]
    g = graph(spark, GO, old, coverage)
    exact = [
        ("a.go", 10, "p.main", "cmd/m.go", 20, "p.x", False),  # two declarations on a line: by name
        ("a.go", 10, "p.main", "a.go", 1, "p.first", False),  # the file starts there too: by name
        ("a.go", 10, "p.main", "a.go", 10, "p.main", False),  # itself, though the name means another one
        ("a.go", 10, "p.main", "x.go", 1, "p.none", False),
        ("a.go", 10, "p.main", "fmt.go", 1, "fmt.Println", True),
        ("a.go", 11, "p.main", "a.go", 10, "?", False),  # the caller by name is the last p.main
    ]
    exact = spark.createDataFrame(exact, X.EXACT)
    clean = spark.createDataFrame([(1, "a.go")], "project_id long, file_path string")
    after = X.supersede_by_position(g, exact, clean)
    got = {(r.source_id, r.target_id, r.edge_type, r.provenance) for r in after.edges.collect()}
    assert got == {(3, 5, "calls", "precise"), (3, 2, "calls", "precise"), (4, 3, "calls", "precise"), (4, 2, "calls", "name"), (7, 3, "calls", "name"), (3, 2, "references", "name")}
    assert {tuple(r) for r in after.coverage.collect()} == {(1, "a.go", "types"), (1, "w.ts", "lsp")}
    assert X.pass_counts(g, exact).first().asDict() == {"upgraded": 3, "skipped": 1, "to_itself": 1, "external": 1}
    again = X.supersede_by_position(after, exact, clean)
    assert sorted(map(tuple, again.edges.collect())) == sorted(map(tuple, after.edges.collect()))


def test_unresolved_references_are_kept(spark):
    g = graph(spark, NODES)
    refs = [(1, "m.go", "orders", "reads", None), (2, "a.ts", "x", "documents", "docs/x"), (3, "m.go", "f", "calls", None), (4, "gone", "orders", "reads", None), (5, "m.go", "items", "writes", None), (6, "m.go", "", "reads", None)]
    edges = spark.createDataFrame([(5,)], "ref_id long")
    rows = X.unresolved_references(g, spark.createDataFrame(refs, "ref_id long, from_fqn string, to_name string, kind string, to_fqn string"), edges)
    assert {tuple(r) for r in rows.collect()} == {(1, "b.ts", "orders", "reads"), (1, "a.ts", "docs/x", "documents")}
