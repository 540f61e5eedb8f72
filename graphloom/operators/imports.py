"""From import specifiers to the files they mean, by joins with what the tree holds.

Each language gives an import its candidates in order; candidates meet the manifest in one equi-join and the first one wins.
An alias is looked for in all folders above its file, the nearest first; a package or module is the one with the longest name
that the specifier begins with, found by an equi-join over the specifier's own prefixes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths

#: Extensions in the order they are tried.
SCRIPT_ENDS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue")
SCRIPTS = ("typescript", "javascript", "vue")
SHEETS = ("css", "scss", "sass", "less", "html")
#: Conditions of a package's main export, the first one first.
CONDITIONS = ("import", "require", "default", "types")

_ANY_END = "(" + "|".join(e.replace(".", r"\.") for e in SCRIPT_ENDS) + ")$"


def _join(*parts: Column | str) -> Column:
    """Path of parts, of which empty ones do not count."""
    each = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws("/", F.filter(F.array(*each), lambda p: (p != "") & (p != ".")))


def _prefixes(spec: Column) -> Column:
    """'a', 'a/b', 'a/b/c' of 'a/b/c'."""
    parts = F.split(spec, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, F.lit(1), n)))


def script_keys(manifest: DataFrame) -> DataFrame:
    """(key, form, rank, target): what a specifier's path may be to mean a script, the least rank first.

    Form 0 is the path as it is written: the file, or the file without its extension. Form 1 is the path without a script's extension:
    the file by its stem, or the folder of an index file.
    """
    p = F.col("file_path")
    end = F.regexp_extract(p, _ANY_END, 1)
    at = F.array_position(F.array(*map(F.lit, SCRIPT_ENDS)), end).cast("int")
    stem = F.regexp_replace(p, _ANY_END, "")
    of_index = F.when(paths.base_name(stem) == "index", paths.folder(stem))
    keys = F.array(
        F.struct(p.alias("key"), F.lit(0).alias("form"), F.lit(0).alias("rank")),
        F.struct(F.when(at > 0, stem).alias("key"), F.lit(0).alias("form"), at.alias("rank")),
        F.struct(F.when(at > 0, stem).alias("key"), F.lit(1).alias("form"), (10 + at).alias("rank")),
        F.struct(F.when((at > 0) & (of_index != ""), of_index).alias("key"), F.lit(1).alias("form"), (20 + at).alias("rank")),
    )
    known = manifest.where(paths.language(p).isNotNull())
    return known.select(p.alias("target"), F.explode(keys).alias("k")).select("k.*", "target").where("key is not null")


def _scripts(tries: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """``by`` with the target of the first of their paths (pos, path) that means a script."""
    forms = F.array(F.struct(F.lit(0).alias("form"), F.col("path").alias("key")), F.struct(F.lit(1).alias("form"), F.regexp_replace("path", _ANY_END, "").alias("key")))
    each = tries.where("path <> ''").select(*by, "pos", F.explode(forms).alias("f")).select(*by, "pos", "f.*")
    return each.join(keys, ["key", "form"]).groupBy(*by).agg(F.min_by("target", F.struct("pos", "form", "rank")).alias("target"))


def packages(tree: DataFrame) -> DataFrame:
    """(name, dir, entries): packages that ``tree`` (file_path, content) declares in package.json files, with the paths of their entries in
    order. Of folders that declare one name the first one by path counts."""
    own = tree.where(paths.base_name(F.col("file_path")) == "package.json").withColumn("name", F.get_json_object("content", "$.name"))
    dot = F.get_json_object("content", "$.exports['.']")
    exports = F.get_json_object("content", "$.exports")
    inner = F.coalesce(dot, exports)
    said = F.coalesce(*(F.get_json_object(inner, f"$.{c}") for c in CONDITIONS), F.when(~inner.startswith("{"), inner))
    entries = F.array(said, F.get_json_object("content", "$.module"), F.get_json_object("content", "$.main"), F.lit("index"), F.lit("src/index"))
    rows = own.where("name <> ''").select("name", paths.folder(F.col("file_path")).alias("dir"), F.filter(entries, lambda e: e.isNotNull() & (e != "")).alias("entries"))
    return rows.groupBy("name").agg(F.min("dir").alias("dir"), F.min_by("entries", "dir").alias("entries"))


def modules(tree: DataFrame) -> DataFrame:
    """(name, dir): Go modules that ``tree`` (file_path, content) declares in go.mod files."""
    own = tree.where(paths.base_name(F.col("file_path")) == "go.mod")
    name = F.regexp_extract("content", r"(?m)^\s*module\s+(\S+)", 1)
    return own.select(name.alias("name"), paths.folder(F.col("file_path")).alias("dir")).where("name <> ''").groupBy("name").agg(F.min("dir").alias("dir"))


def _longest(imports: DataFrame, named: DataFrame) -> DataFrame:
    """Imports (file_path, spec, clean) with the entry of ``named`` (name, ...) that has the longest name their ``clean`` begins with, and the rest of it."""
    tries = imports.select("file_path", "spec", "clean", F.explode(_prefixes(F.col("clean"))).alias("name"))
    found = tries.join(named, "name").groupBy("file_path", "spec", "clean").agg(F.max_by(F.struct("name", *(c for c in named.columns if c != "name")), F.length("name")).alias("n"))
    return found.select("file_path", "spec", "n.*", F.expr("substr(clean, length(n.name) + 2)").alias("rest"))


def _script_imports(imports: DataFrame, manifest: DataFrame, known: DataFrame | None) -> DataFrame:
    keys = script_keys(manifest)
    spec, here = F.col("spec"), paths.folder(F.col("file_path"))
    alias = spec.rlike("^[@~]/.")
    placed = spec.rlike(r"^(\.{1,2})?/")
    rest = F.substring(spec, 3, 1 << 20)
    up = F.reverse(paths.ancestors(F.col("file_path")))
    above = F.flatten(F.transform(up, lambda d: F.array(_join(d, "src", rest), _join(d, rest))))
    beside = F.when(spec.startswith("/"), paths.normalized(spec)).otherwise(paths.normalized(F.concat_ws("/", here, spec)))
    tries = imports.where(alias | placed).select("file_path", "spec", F.posexplode(F.when(alias, above).otherwise(F.array(beside))).alias("pos", "path"))
    found = _scripts(tries, keys, ["file_path", "spec"])
    if known is None:
        return found
    bare = _longest(imports.where(~alias & ~placed & ~spec.isin("@/", "~/")).withColumn("clean", spec), known)
    entry = F.transform("entries", lambda e: paths.normalized(F.concat_ws("/", F.col("dir"), e)))
    inside = F.array(_join(F.col("dir"), F.col("rest")), _join(F.col("dir"), "src", F.col("rest")))
    tries = bare.select("file_path", "spec", F.posexplode(F.when(F.col("rest") == "", entry).otherwise(inside)).alias("pos", "path"))
    return found.unionByName(_scripts(tries, keys, ["file_path", "spec"]))


def _go_imports(imports: DataFrame, manifest: DataFrame, known: DataFrame) -> DataFrame:
    """A package is its folder; the file that stands for it is the first by path that is no test, else the first test."""
    p = F.col("file_path")
    files = manifest.where(paths.language(p) == "go")
    chosen = files.groupBy(paths.folder(p).alias("folder")).agg(F.min_by(p, F.struct(paths.is_test_file(p), p)).alias("target"))
    clean = F.regexp_replace(F.rtrim(F.col("spec"), F.lit("/")), r"/v[0-9]+$", "")
    asked = _longest(imports.where(~F.col("spec").rlike(r"^\.{1,2}/")).withColumn("clean", clean), known)
    return asked.withColumn("folder", _join(F.col("dir"), F.col("rest"))).join(chosen, "folder").select("file_path", "spec", "target")


def _candidates(language: Column) -> Column:
    """Ordered paths of the other languages."""
    spec, here = F.col("spec"), paths.folder(F.col("file_path"))
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    dotted = F.translate(F.expr("substr(spec, length(regexp_extract(spec, '^([.]*)', 1)) + 1)"), ".", "/")
    folders = F.split(here, "/")
    above = F.concat_ws("/", F.slice(folders, F.lit(1), F.greatest(F.size(folders) - dots + 1, F.lit(0))))
    base = F.when(dots == 0, dotted).otherwise(_join(above, dotted))
    python_of = lambda b: [F.when(b != "", F.concat(b, F.lit(".py"))), F.when(b != "", F.concat(b, F.lit(".pyi"))), _join(b, "__init__.py")]
    python = F.array(*python_of(base), *(F.when(dots == 0, c) for c in python_of(_join("src", base))))

    ruby_spec = F.regexp_replace(spec, r"\.rb$", "")
    ruby = F.when(spec.rlike(r"^\.{1,2}/"), F.array(paths.normalized(F.concat_ws("/", here, F.concat(ruby_spec, F.lit(".rb")))))).otherwise(F.array(F.concat(ruby_spec, F.lit(".rb")), F.concat(F.lit("lib/"), ruby_spec, F.lit(".rb"))))

    lua_spec = F.translate(spec, ".", "/")
    lua = F.array(*(F.concat(F.lit(root), lua_spec, F.lit(end)) for root in ("", "lua/", "src/") for end in (".lua", "/init.lua")))

    sheet = F.when(~spec.rlike("^[/~]"), paths.normalized(F.concat_ws("/", here, spec)))
    folder, name = paths.folder(sheet), paths.base_name(sheet)
    sheets = F.array(
        sheet,
        *(F.concat(sheet, F.lit(end)) for end in (".css", ".scss", ".sass", ".less")),
        *(_join(folder, F.concat(F.lit("_"), name, F.lit(end))) for end in ("", ".scss", ".sass")),
        *(F.concat(sheet, F.lit(end)) for end in ("/index.scss", "/_index.scss")),
    )

    scene = F.regexp_replace(spec, "^(res://)?/?", "")
    gd = lambda b: [b, F.when(~b.endswith(".gd"), F.concat(b, F.lit(".gd")))]
    gdscript = F.array(*gd(scene), *gd(paths.normalized(F.concat_ws("/", here, scene))))

    page = paths.normalized(F.concat_ws("/", here, spec))
    pages = F.array(page, F.concat(page, F.lit(".md")))
    of = {"python": python, "ruby": ruby, "lua": lua, "gdscript": gdscript, "markdown": pages, **dict.fromkeys(SHEETS, sheets)}
    out = reduce(lambda when, kv: when.when(language == kv[0], kv[1]), list(of.items())[1:], F.when(language == "python", python))
    return F.when(spec != "", out)


def resolve_imports(imports: DataFrame, manifest: DataFrame, js_packages: DataFrame | None = None, go_modules: DataFrame | None = None) -> DataFrame:
    """(file_path, spec, target): the file of ``manifest`` (file_path) that each import (file_path, spec) means; imports of none are left out.

    ``js_packages`` is as from :func:`packages`, ``go_modules`` as from :func:`modules`; without them such imports mean nothing. Only
    files of a known language are meant.
    """
    language = paths.language(F.col("file_path"))
    asked = imports.select("file_path", "spec").where("spec <> ''").distinct()
    known = manifest.select("file_path").where(paths.language(F.col("file_path")).isNotNull())
    scripts = _script_imports(asked.where(language.isin(*SCRIPTS)), known, js_packages)
    tries = asked.select("file_path", "spec", F.posexplode(_candidates(language)).alias("pos", "target"))
    others = tries.join(known.select(F.col("file_path").alias("target")), "target").groupBy("file_path", "spec").agg(F.min_by("target", "pos").alias("target"))
    out = scripts.unionByName(others.select("file_path", "spec", "target"))
    return out if go_modules is None else out.unionByName(_go_imports(asked.where(language == "go"), known, go_modules))
