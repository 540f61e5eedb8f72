"""A small source tree from files to answers, and its refresh."""

import pytest

from graphloom.operators import relations as R
from graphloom.plans import indexing
from graphloom.sources import snapshots, testbed

FILES = {
    "app/main.py": "from app.store import save\n\ndef main():\n    save(1)\n    helper()\n\ndef helper():\n    missing_thing()\n",
    "app/store.py": "class Store:\n    def put(self):\n        pass\n\ndef save(x):\n    Store().put()\n",
    "docs/a.md": "# Title\nSee [b](b.md)\n",
    "docs/b.md": "# Other\n",
}


def write(folder, files):
    for name, text in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)


def edges(g):
    name = g.nodes.selectExpr("id", "coalesce(fqn, file_path) n")
    rows = g.edges.join(name.withColumnsRenamed({"id": "source_id", "n": "a"}), "source_id").join(name.withColumnsRenamed({"id": "target_id", "n": "b"}), "target_id")
    return {(r.a, r.edge_type, r.b) for r in rows.collect()}


def test_index_and_refresh(spark, tmp_path):
    write(tmp_path, FILES)
    g, unresolved = indexing.index_tree(spark, f"file://{tmp_path}")
    found = edges(g)
    assert ("app.main.main", "calls", "app.store.save") in found and ("app.main.main", "calls", "app.main.helper") in found
    assert ("app/main.py", "imports", "app/store.py") in found and ("docs/a.md", "documents", "docs/b.md") in found
    assert ("app/store.py", "defines", "app.store.Store") in found
    assert ("missing_thing", "calls") in {(r.to_name, r.kind) for r in unresolved.collect()}
    assert {r.symbol for r in R.callers(g, R.roots_by_symbol(g, ["save"])).collect()} == {"main"}

    write(tmp_path, {"app/store.py": "\n\n" + FILES["app/store.py"] + "\ndef extra():\n    save(2)\n", "app/new.py": "def fresh():\n    helper()\n"})
    (tmp_path / "docs/b.md").unlink()
    nxt, surface = indexing.refresh(spark, g, f"file://{tmp_path}")
    later = edges(nxt)
    assert {("app.main.main", "calls", "app.store.save"), ("app.store.extra", "calls", "app.store.save"), ("app.new.fresh", "calls", "app.main.helper")} <= later
    assert not any("docs/b.md" in e for e in later)
    assert surface.count() == 0
    whole, _ = indexing.index_tree(spark, f"file://{tmp_path}")
    assert edges(whole) == later


def test_calls_of_other_languages(spark, tmp_path):
    """Edges worked out by hand: owners, module-level calls, members, bases, same-named functions, styles in scope."""
    write(
        tmp_path,
        {
            "srv/store.go": "package srv\n\nfunc (s *Store) Put(k string) {\n\tcheck(k) // Get(\n}\n\nfunc check(k string) {}\n\nfunc init() { s.Put(\"check(\") }\n",
            "cmd/main.go": "package main\n\nfunc main() {\n\tif ok { run() }\n}\n\nfunc run() { srv.Put(1) }\n",
            "tool/main.go": "package main\n\nfunc main() { start() }\n\nfunc start() {}\n",
            "web/app.ts": "import { Base } from './base'\nexport class App extends Base {\n  async open(): Promise<void> {\n    await this.load(1)\n  }\n  load(n: number) {\n  }\n}\nboot()\n\nfunction boot() {\n  new App().open()\n}\n",
            "web/base.ts": "export class Base {\n}\n",
            "lib/job.rb": "class Job\n  def perform(x)\n    while x do\n      step(x)\n    end\n  end\n\n  def step(x)\n  end\nend\n",
            "lua/m.lua": "local function a()\n  if x then b(1) end\nend\nfunction b(y)\nend\na()\n",
            "page/index.html": '<link rel="stylesheet" href="own.css"><p class="big">x</p>',
            "page/own.css": ".big {\n}\n",
            "other/far.css": ".big {\n}\n",
            "db/t.sql": "CREATE TABLE shop.items (id int);\nSELECT * FROM items;\n",
        },
    )
    g, _ = indexing.index_tree(spark, f"file://{tmp_path}")
    found = {e for e in edges(g) if e[1] != "defines"}
    assert {e for e in found if e[1] == "calls"} == {
        ("srv.store.Store.Put", "calls", "srv.store.check"), ("srv.store.init", "calls", "srv.store.Store.Put"),
        ("cmd.main.main", "calls", "cmd.main.run"), ("cmd.main.run", "calls", "srv.store.Store.Put"), ("tool.main.main", "calls", "tool.main.start"),
        ("web.app.App.open", "calls", "web.app.App.load"), ("web/app.ts", "calls", "web.app.boot"), ("web.app.boot", "calls", "web.app.App"), ("web.app.boot", "calls", "web.app.App.open"),
        ("lib.job.Job.perform", "calls", "lib.job.Job.step"), ("lua.m.a", "calls", "lua.m.b"), ("lua/m.lua", "calls", "lua.m.a"),
    }
    assert ("web.app.App", "extends", "web.base.Base") in found and ("web/app.ts", "imports", "web/base.ts") in found
    assert {e for e in found if e[1] == "styles"} == {("page/index.html", "styles", "page.own..big")}
    assert ("db.t.query2", "reads", "db.t.shop.items") in found
    ends = {r.fqn: (r.start_line, r.end_line) for r in g.nodes.collect()}
    assert ends["srv.store.Store.Put"] == (3, 5) and ends["web.app.App"] == (2, 8) and ends["lib.job.Job"] == (1, 10) and ends["lua.m.a"] == (1, 3)


def test_snapshots(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    g = testbed.graph(spark, "/root/testdata/sf0.001")
    name = snapshots.save(g, root)
    assert snapshots.save(g, root) == name
    assert [r.fingerprint for r in snapshots.listing(spark, root).collect()] == [name]
    back = snapshots.restore(spark, root, name)
    assert back.edges.count() == g.edges.count() and back.nodes.exceptAll(g.nodes).count() == 0
    assert snapshots.drop(spark, root, name) and not snapshots.drop(spark, root, name)
    with pytest.raises(FileNotFoundError):
        snapshots.restore(spark, root, name)
