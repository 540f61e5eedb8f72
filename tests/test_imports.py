"""Specifiers against a small monorepo; answers worked out by hand from the rules of each language."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import paths
from graphloom.operators import imports as I

FILES = """
package.json index.ts src/lib/x.ts
apps/web/package.json apps/web/src/lib/x.ts apps/web/src/pages/home.tsx apps/web/lib/y.ts apps/web/src/ui/index.vue
apps/api/main.ts apps/api/util.js apps/api/util.test.ts
packages/domain/package.json packages/domain/src/index.ts packages/domain/src/money.ts packages/domain/tools.ts
packages/domain-extra/package.json packages/domain-extra/lib/main.mjs
packages/copy/package.json packages/copy/index.js
go.mod main.go internal/store/a_test.go internal/store/b.go internal/store/c.go only/x_test.go
tools/go.mod tools/gen/gen.go tools/root.go
app/__init__.py app/core.py app/sub/__init__.py app/sub/leaf.py src/pkg/mod.py src/pkg/typed.pyi
lib/job.rb lib/deep/item.rb spec/job_spec.rb
lua/plug/init.lua src/other.lua m.lua
styles/_mixins.scss styles/main.scss styles/base/_index.scss styles/plain.css
scenes/player.gd scenes/util/tool.gd docs/a.md docs/guide/b.md data/x.json
""".split()
CONTENT = {
    "package.json": '{"name": "root-app", "main": "./index.js"}',
    "apps/web/package.json": '{"private": true}',
    "packages/domain/package.json": '{"name": "@shop/domain", "exports": {".": {"import": "./dist/none.js", "types": "./src/x.ts"}}, "main": "lib/none.js"}',
    "packages/domain-extra/package.json": '{"name": "@shop/domain-extra", "exports": "./lib/main.mjs"}',
    "packages/copy/package.json": '{"name": "@shop/domain", "main": "index.js"}',
    "go.mod": "module example.org/shop\n\ngo 1.22\n",
    "tools/go.mod": "// tools\nmodule example.org/shop/tools\n",
}
CASES = {
    # aliases: the nearest folder above, its src first
    ("apps/web/src/pages/home.tsx", "@/lib/x"): "apps/web/src/lib/x.ts",
    ("apps/web/src/pages/home.tsx", "~/lib/y"): "apps/web/lib/y.ts",
    ("apps/api/main.ts", "@/lib/x"): "src/lib/x.ts",
    ("apps/api/main.ts", "@/none"): None,
    # relative and rooted paths, extensions that are swapped, index files
    ("apps/api/main.ts", "./util"): "apps/api/util.js",
    ("apps/api/main.ts", "./util.ts"): "apps/api/util.js",
    ("apps/api/main.ts", "./util.test"): "apps/api/util.test.ts",
    ("apps/api/main.ts", "../web/src/ui"): "apps/web/src/ui/index.vue",
    ("apps/api/main.ts", "../web/src/ui/index.vue"): "apps/web/src/ui/index.vue",
    ("apps/api/main.ts", "/index"): "index.ts",
    ("apps/api/main.ts", "../../../out"): None,
    ("apps/api/main.ts", "../../data/x.json"): None,
    # packages: entries in order, subpaths, the longest name, the first folder of a name
    ("apps/api/main.ts", "@shop/domain"): "packages/copy/index.js",
    ("apps/api/main.ts", "@shop/domain-extra"): "packages/domain-extra/lib/main.mjs",
    ("apps/api/main.ts", "root-app"): "index.ts",
    ("apps/api/main.ts", "@shop/domain-extra/lib/main"): "packages/domain-extra/lib/main.mjs",
    ("apps/api/main.ts", "react"): None,
    ("apps/api/main.ts", "@shop/domainx"): None,
    # modules: the longest, no tests if there is another file
    ("main.go", "example.org/shop/internal/store"): "internal/store/b.go",
    ("main.go", "example.org/shop"): "main.go",
    ("main.go", "example.org/shop/only"): "only/x_test.go",
    ("main.go", "example.org/shop/tools/gen/"): "tools/gen/gen.go",
    ("main.go", "example.org/shop/tools"): "tools/root.go",
    ("main.go", "example.org/shop/internal/store/v2"): "internal/store/b.go",
    ("main.go", "example.org/shopping/internal/store"): None,
    ("main.go", "./internal/store"): None,
    ("app/core.py", "app.sub.leaf"): "app/sub/leaf.py",
    ("app/core.py", "pkg.mod"): "src/pkg/mod.py",
    ("app/core.py", "pkg.typed"): "src/pkg/typed.pyi",
    ("app/core.py", ".sub"): "app/sub/__init__.py",
    ("app/core.py", "."): "app/__init__.py",
    ("app/sub/leaf.py", "..core"): "app/core.py",
    ("app/sub/leaf.py", "...main"): None,
    ("app/core.py", "os.path"): None,
    ("spec/job_spec.rb", "../lib/job"): "lib/job.rb",
    ("spec/job_spec.rb", "deep/item.rb"): "lib/deep/item.rb",
    ("m.lua", "plug"): "lua/plug/init.lua",
    ("m.lua", "other"): "src/other.lua",
    ("styles/main.scss", "mixins"): "styles/_mixins.scss",
    ("styles/main.scss", "mixins.scss"): "styles/_mixins.scss",
    ("styles/main.scss", "./base"): "styles/base/_index.scss",
    ("styles/main.scss", "plain"): "styles/plain.css",
    ("styles/main.scss", "~bootstrap"): None,
    ("scenes/player.gd", "res://scenes/util/tool.gd"): "scenes/util/tool.gd",
    ("scenes/player.gd", "util/tool"): "scenes/util/tool.gd",
    ("docs/a.md", "guide/b.md"): "docs/guide/b.md",
    ("docs/guide/b.md", "../a.md"): "docs/a.md",
}


def test_imports_mean_files(spark):
    tree = spark.createDataFrame([(p, CONTENT.get(p, "")) for p in FILES], "file_path string, content string")
    asked = spark.createDataFrame([*CASES, *CASES, ("main.go", "")], "file_path string, spec string")
    found = I.resolve_imports(asked, tree, I.packages(tree), I.modules(tree))
    rows = found.collect()
    assert {(r.file_path, r.spec): r.target for r in rows} == {k: v for k, v in CASES.items() if v}
    assert len(rows) == sum(v is not None for v in CASES.values())
    plain = {(r.file_path, r.spec) for r in I.resolve_imports(asked, tree).collect()}
    assert ("apps/api/main.ts", "root-app") not in plain and ("apps/api/main.ts", "./util") in plain


def test_entries_of_packages(spark):
    texts = ['{"name": "a", "exports": {"import": "./i.js", "default": "./d.js"}, "module": "m.js"}', '{"name": "b", "exports": {".": "./dot.js"}}', '{"name": "c"}', "{broken", '{"name": "d", "exports": {".": {"default": "./x.js", "require": "./r.js"}}}']
    tree = spark.createDataFrame([(f"p{i}/package.json", t) for i, t in enumerate(texts)], "file_path string, content string")
    got = {r.name: r.entries for r in I.packages(tree).collect()}
    assert got == {"a": ["./i.js", "m.js", "index", "src/index"], "b": ["./dot.js", "index", "src/index"], "c": ["index", "src/index"], "d": ["./r.js", "index", "src/index"]}


@pytest.mark.parametrize("path, clean", [("a/./b//c", "a/b/c"), ("a/b/../../c", "c"), ("../a", None), ("a/../..", None), ("", ""), ("/x/", "x"), ("a/b/..", "a")])
def test_normalized(spark, path, clean):
    assert spark.createDataFrame([(path,)], "p string").select(paths.normalized(F.col("p"))).first()[0] == clean
