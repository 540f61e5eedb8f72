"""From a source tree to a graph, whole or only what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names, paths
from ..operators import maintenance as M
from ..operators import relations as R
from ..operators.imports import modules, packages, resolve_imports
from ..operators.lineage import cut
from ..schema import EDGE_TYPES, Graph
from ..sources.extract import extract
from ..sources.files import walk_tree
from ..sources.store import file_system


def module_name(path: Column) -> Column:
    """Dotted name of a file without its extension."""
    return F.regexp_replace(F.regexp_replace(path, r"\.[^./]+$", ""), "/", ".")


def symbol_nodes(tree: DataFrame, rows: DataFrame, project_id: int) -> DataFrame:
    """A node per file and per extracted symbol; ids are hashes of durable keys, with an ordinal among equals."""
    files = tree.select("file_path", F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("string").alias("fqn"), F.lit("file").alias("kind"), "language", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit(None).cast("string").alias("docstring"), F.col("file_hash").alias("source_hash"))
    found = rows.where("row = 'symbol'").join(tree.select("file_path", "language", F.col("file_hash").alias("source_hash")), "file_path")
    symbols = found.select("file_path", F.col("name").alias("symbol"), F.concat_ws(".", module_name(F.col("file_path")), "fqn").alias("fqn"), "kind", "language", "start_line", "end_line", "docstring", "source_hash")
    both = files.unionByName(symbols)
    ordinal = F.row_number().over(W.partitionBy("file_path", "kind", "fqn", "start_line").orderBy("end_line"))
    ident = F.xxhash64(F.lit(project_id), "file_path", "kind", "fqn", "start_line", ordinal)
    return both.select(ident.alias("id"), F.lit(project_id).cast("long").alias("project_id"), "file_path", "symbol", "fqn", "kind", "language", "start_line", "end_line", F.lit(None).cast("string").alias("signature"), "docstring", "source_hash")


def reference_edges(nodes: DataFrame, own: DataFrame, rows: DataFrame, manifest: DataFrame, tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of the references in ``rows`` (definitions, imports and resolved names) and the references that met nothing.

    ``nodes`` are all that can be met, ``own`` those of the files that were read. ``tree`` has the manifests of packages and modules.
    """
    refs = rows.where("row = 'reference'")
    files = own.where("kind = 'file'").select(F.col("id").alias("source_id"), "file_path")
    all_files = nodes.where("kind = 'file'").select(F.col("id").alias("target_id"), F.col("file_path").alias("target"))
    defines = own.where("kind <> 'file'").join(files, "file_path").select("source_id", F.col("id").alias("target_id"), F.lit("defines").alias("edge_type"), F.lit(1.0).alias("weight"), F.lit("name").alias("provenance"))
    files_named = refs.where("kind in ('imports', 'documents')").select("file_path", "kind", F.col("name").alias("spec")).distinct()
    links = cut(resolve_imports(files_named.select("file_path", "spec"), manifest, packages(tree), modules(tree)).join(files_named, ["file_path", "spec"]))
    imports = links.join(files, "file_path").join(all_files, "target").where("source_id <> target_id").select("source_id", "target_id", F.col("kind").alias("edge_type"), F.lit(1.0).alias("weight"), F.lit("name").alias("provenance")).distinct()
    named = refs.where("kind not in ('imports', 'documents')")
    by_last = F.col("kind").isin("calls", "references", "extends", "implements")
    asked = named.select(
        F.xxhash64("file_path", "kind", "name", "from_fqn", "start_line").alias("ref_id"),
        F.when(F.col("from_fqn").isNotNull(), F.concat_ws(".", module_name(F.col("file_path")), "from_fqn")).alias("from_fqn"),
        F.when(by_last, names.bare(F.col("name"))).otherwise(F.col("name")).alias("to_name"),
        "kind",
        F.col("name").contains(".").alias("qualified"),
        F.lit(None).cast("string").alias("to_fqn"),
        F.when(F.col("kind").isin("reads", "writes"), F.array(F.lit("table"), F.lit("view"))).when(F.col("kind") == "styles", F.array(F.lit("selector"))).alias("to_kinds"),
        "file_path",
    ).dropDuplicates(["ref_id"])
    asked = cut(asked)
    met = cut(_own_styles(R.resolve_references(Graph(nodes, nodes.limit(0)), asked), asked, nodes, links))
    resolved = met.select("source_id", "target_id", F.col("kind").alias("edge_type"), "weight", "provenance").distinct()
    unresolved = asked.join(met.select("ref_id"), "ref_id", "left_anti").select("file_path", "to_name", "kind").distinct()
    return defines.unionByName(imports).unionByName(resolved), unresolved


def _own_styles(met: DataFrame, asked: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """A style is meant of the file itself and the sheets it imports, if they have it; else of any sheet."""
    styles = met.where("kind = 'styles'").join(asked.select("ref_id", "file_path"), "ref_id").join(nodes.select(F.col("id").alias("target_id"), F.col("file_path").alias("target")), "target_id")
    scope = links.select("file_path", "target", F.lit(True).alias("imported")).distinct()
    close = (F.col("file_path") == F.col("target")) | F.coalesce("imported", F.lit(False))
    placed = styles.join(scope, ["file_path", "target"], "left").withColumn("close", close).withColumn("any_close", F.bool_or("close").over(W.partitionBy("ref_id")))
    return met.where("kind <> 'styles'").unionByName(placed.where("close or not any_close").select(*met.columns))


def index_tree(spark: SparkSession, root: str, project_id: int = 1, exclude: list[str] | None = None) -> tuple[Graph, DataFrame]:
    """The graph of all files below ``root``, and its unresolved references (file_path, to_name, kind)."""
    tree = walk_tree(spark, root, exclude)
    rows = cut(extract(tree))
    nodes = cut(symbol_nodes(tree, rows, project_id))
    manifest = cut(tree.select(F.lit(project_id).cast("long").alias("project_id"), "file_path", "file_hash", "size_bytes"))
    edges, unresolved = reference_edges(nodes, nodes, rows, manifest, tree)
    coverage = manifest.select("project_id", "file_path", F.lit("").alias("resolver")).limit(0)
    return Graph(nodes, edges, manifest, coverage), unresolved


def _replaced(spark: SparkSession, old: Graph, some: DataFrame, declared: DataFrame, deleted: DataFrame, manifest: DataFrame, project_id: int) -> tuple[Graph, DataFrame]:
    """The next snapshot once the files of ``some`` (a tree) were read again and ``deleted`` (file_path) are gone, and the files whose surface changed.

    ``declared`` is a tree with the manifests of packages and modules."""
    base = M.cascade_delete(old, deleted)
    rows = cut(extract(some))
    fresh = cut(symbol_nodes(some, rows, project_id))
    touched = some.select("file_path")
    everything = base.nodes.join(touched, "file_path", "left_anti").select(*fresh.columns).unionByName(fresh)
    edges, _ = reference_edges(everything, fresh, rows, manifest, declared)
    nxt, surface = M.replace_files(base, Graph(fresh, edges), touched)
    return Graph(nxt.nodes, nxt.edges, manifest, nxt.coverage, nxt.annotations), surface


def _manifest(tree: DataFrame, project_id: int) -> DataFrame:
    return tree.select(F.lit(project_id).cast("long").alias("project_id"), "file_path", "file_hash", "size_bytes")


def refresh(spark: SparkSession, old: Graph, root: str, project_id: int = 1, exclude: list[str] | None = None) -> tuple[Graph, DataFrame]:
    """The next snapshot of a graph after files changed, reading only those, and the files whose surface changed.

    Edges from untouched files into touched ones follow identities; the touched files' own references are resolved against all nodes.
    """
    tree = walk_tree(spark, root, exclude)
    manifest = cut(_manifest(tree, project_id))
    delta = cut(M.file_delta(old.files, manifest))
    touched = delta.where("change <> 'deleted'").select("file_path")
    return _replaced(spark, old, tree.join(touched, "file_path", "left_semi"), tree, delta.where("change = 'deleted'").select("file_path"), manifest, project_id)


#: Paths of one batch that are read by name; a batch of more is a refresh of the whole tree.
MOST_PATHS = 10_000


def apply_paths(spark: SparkSession, old: Graph, root: str, batch: DataFrame, project_id: int = 1, exclude: list[str] | None = None) -> tuple[Graph, DataFrame]:
    """The next snapshot after a batch of paths (path), of which only the files are read, and the files (file_path) that were touched.

    A path without a file is deleted, whatever its operation says. Files that referred to a symbol that is gone are read again as well,
    so that their references meet what is there now. A batch of more than MOST_PATHS paths refreshes the whole tree.
    """
    paths_ = [r["path"] for r in batch.select("path").distinct().limit(MOST_PATHS + 1).collect()]
    if len(paths_) > MOST_PATHS:
        nxt, _ = refresh(spark, old, root, project_id, exclude)
        return nxt, M.file_delta(old.files, nxt.files).select("file_path")
    fs, _ = file_system(spark, root)
    declared = _declared(spark, old, root, exclude, paths_)
    there = {p for p in paths_ if fs.exists(file_system(spark, f"{root.rstrip('/')}/{p}")[1])}

    def step(read: set[str]) -> tuple[Graph, DataFrame]:
        some = cut(walk_tree(spark, root, exclude, sorted(read))) if read else walk_tree(spark, root, exclude).limit(0)
        kept = old.files.join(_names(spark, {*paths_, *read}), "file_path", "left_anti").select("project_id", "file_path", "file_hash", "size_bytes")
        manifest = cut(kept.unionByName(_manifest(some, project_id)))
        return _replaced(spark, old, some, declared, _names(spark, set(paths_) - there), manifest, project_id)

    nxt, surface = step(there)
    broken = surface.unionByName(_names(spark, set(paths_) - there)).distinct()
    dependents = R.source_files_targeting(old, broken, EDGE_TYPES).select("source_file").distinct().limit(MOST_PATHS + 1).collect()
    more = {r["source_file"] for r in dependents} - there - set(paths_)
    if len(more) > MOST_PATHS:
        nxt, _ = refresh(spark, old, root, project_id, exclude)
    elif more:
        nxt, _ = step(there | more)
    return nxt, _names(spark, {*paths_, *more})


#: Files that declare packages and modules.
DECLARING = ("package.json", "go.mod")


def _declared(spark: SparkSession, old: Graph, root: str, exclude: list[str] | None, batch: list[str]) -> DataFrame:
    """A tree with the files that declare packages and modules: those that are known and those of the batch, read by name if they are not too many."""
    known = old.files.where(paths.base_name(F.col("file_path")).isin(*DECLARING)).select("file_path").limit(MOST_PATHS + 1).collect()
    if len(known) > MOST_PATHS:
        return walk_tree(spark, root, exclude)
    fs, _ = file_system(spark, root)
    named = {r["file_path"] for r in known} | {p for p in batch if p.rsplit("/", 1)[-1] in DECLARING}
    there = sorted(p for p in named if fs.exists(file_system(spark, f"{root.rstrip('/')}/{p}")[1]))
    return walk_tree(spark, root, exclude, there) if there else walk_tree(spark, root, exclude).limit(0)


def _names(spark: SparkSession, names_: set[str]) -> DataFrame:
    return spark.createDataFrame([(p,) for p in sorted(names_)], "file_path string")


def language_counts(tree: DataFrame) -> DataFrame:
    """Files per language, unknown ones by extension."""
    return tree.groupBy(F.coalesce(paths.language(F.col("file_path")), F.regexp_extract("file_path", r"(\.[^./]+)$", 1)).alias("language")).agg(F.count(F.lit(1)).alias("files"))
