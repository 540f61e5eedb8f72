"""Counts, rankings and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names, paths, scores
from ..schema import Graph


def stats(graph: Graph) -> DataFrame:
    """One row per project: nodes, files and edges."""
    nodes = graph.nodes.groupBy("project_id").agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("file_path").alias("files"))
    edges = graph.edges.join(graph.nodes.select(F.col("id").alias("source_id"), "project_id"), "source_id").groupBy("project_id").agg(F.count(F.lit(1)).alias("edges"))
    return nodes.join(edges, "project_id", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))


def count_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def hotspots(graph: Graph, limit: int = 20) -> DataFrame:
    """Most called nodes; ties by file, line, names and id."""
    calls = graph.edges.where("edge_type = 'calls'").groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    ranked = calls.join(graph.nodes.where("kind <> 'file'"), "id")
    return ranked.orderBy(F.desc("in_degree"), "file_path", "start_line", "fqn", "kind", "symbol", "id").limit(limit)


def definition_counts(graph: Graph) -> DataFrame:
    return graph.nodes.where("kind <> 'file' and coalesce(symbol, '') <> ''").groupBy("project_id", "symbol").agg(F.count(F.lit(1)).alias("definitions"))


def ranked_hotspots(graph: Graph, include_tests: bool = False) -> DataFrame:
    """Nodes by effective in-degree: exact calls count 1, calls by name 1 / definitions of the name (tests among them).

    Calls are summed per (target, provenance, caller's file and kind) before they meet the target.
    """
    caller = graph.nodes.select(F.col("id").alias("source_id"), paths.is_test_node(F.col("kind"), F.col("file_path")).alias("from_test"))
    calls = graph.edges.where("edge_type = 'calls'").join(caller, "source_id")
    if not include_tests:
        calls = calls.where(~F.col("from_test"))
    precise = F.sum((F.col("provenance") == "precise").cast("long"))
    sums = calls.groupBy(F.col("target_id").alias("id")).agg(precise.alias("precise_in"), F.count(F.lit(1)).alias("in_degree"))
    targets = graph.nodes.where("kind <> 'file'")
    if not include_tests:
        targets = targets.where(~paths.is_test_node(F.col("kind"), F.col("file_path")))
    joined = sums.join(targets, "id").join(definition_counts(graph), ["project_id", "symbol"], "left")
    shared = F.greatest(F.coalesce("definitions", F.lit(1)), F.lit(1))
    out = joined.withColumn("shared_defs", shared.cast("long")).withColumn("name_in", F.col("in_degree") - F.col("precise_in"))
    return out.withColumn("effective", F.col("precise_in") + F.col("name_in") / F.col("shared_defs"))


HOTSPOT_ORDER = (F.desc, "effective"), (F.desc, "in_degree"), *((F.asc, c) for c in ("file_path", "start_line", "fqn", "kind", "symbol", "id"))


def rank_order() -> list:
    return [f(c) for f, c in HOTSPOT_ORDER]


def wired_counts(graph: Graph) -> DataFrame:
    return graph.edges.where("edge_type = 'references'").groupBy("target_id").agg(F.count(F.lit(1)).alias("wired"))


def subsystem_rollup(graph: Graph) -> DataFrame:
    """Files, symbols and edges inside, out of and into each subsystem, tests apart from neither; definitions do not count as edges."""
    nodes = graph.nodes.withColumn("subsystem", paths.subsystem(F.col("file_path")))
    own = nodes.groupBy("subsystem").agg(F.countDistinct("file_path").alias("files"), F.sum((F.col("kind") != "file").cast("long")).alias("symbols"))
    side = lambda p: nodes.select(F.col("id").alias(f"{p}_id"), F.col("subsystem").alias(f"{p}_sub"))
    flows = graph.edges.where("edge_type <> 'defines'").join(side("source"), "source_id").join(side("target"), "target_id").groupBy("source_sub", "target_sub").agg(F.count(F.lit(1)).alias("n"))
    inside, outside = F.col("source_sub") == F.col("target_sub"), F.col("source_sub") != F.col("target_sub")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    outward = flows.groupBy(F.col("source_sub").alias("subsystem")).agg(total(inside).alias("internal"), total(outside).alias("outgoing"))
    inward = flows.where(outside).groupBy(F.col("target_sub").alias("subsystem")).agg(F.sum("n").alias("incoming"))
    out = own.join(outward, "subsystem", "left").join(inward, "subsystem", "left")
    return out.fillna(0, ["internal", "outgoing", "incoming"])


def bridges(graph: Graph, samples: int = 5) -> DataFrame:
    """Edges between two subsystems by type: count, how many are precise, and the first files on either side with their totals.

    Files are made distinct before they are gathered, so what is gathered is bounded by files, not edges.
    """
    nodes = graph.nodes.withColumn("subsystem", paths.subsystem(F.col("file_path")))
    side = lambda p: nodes.select(F.col("id").alias(f"{p}_id"), F.col("subsystem").alias(f"{p}_subsystem"), F.col("file_path").alias(f"{p}_file"))
    across = graph.edges.where("edge_type <> 'defines'").join(side("source"), "source_id").join(side("target"), "target_id").where("source_subsystem <> target_subsystem")
    keys = ["source_subsystem", "target_subsystem", "edge_type"]
    counts = across.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("provenance") == "precise").cast("long")).alias("precise"))

    def first_files(column: str) -> DataFrame:
        distinct = across.select(*keys, column).distinct()
        ranked = distinct.withColumn("rn", F.row_number().over(W.partitionBy(*keys).orderBy(column)))
        names_ = F.array_join(F.array_sort(F.collect_list(F.when(F.col("rn") <= samples, F.col(column)))), ",")
        return ranked.groupBy(*keys).agg(names_.alias(f"{column}s"), F.count(F.lit(1)).alias(f"{column}s_total"))

    return counts.join(first_files("source_file"), keys).join(first_files("target_file"), keys)


def coverage_rollup(file_coverage: DataFrame) -> DataFrame:
    """Covered files by language, by folder and over all, from one pass with grouping sets."""
    df = file_coverage.withColumn("folder", paths.folder(F.col("file_path"))).where("language is not null")
    spark = df.sparkSession
    return spark.sql(
        """SELECT CASE WHEN grouping(language) = 0 THEN 'language' WHEN grouping(folder) = 0 THEN 'folder' ELSE 'all' END AS scope, coalesce(language, folder, '') AS name,
        count(*) AS files, sum(CAST(covered AS INT)) AS covered, sum(CAST(covered AS INT)) / count(*) AS ratio FROM {df} GROUP BY GROUPING SETS ((language), (folder), ())""",
        df=df,
    )


def folder_rollup(graph: Graph) -> DataFrame:
    """Files and symbols below every folder: each file counts for all its ancestors."""
    per_file = graph.nodes.groupBy("file_path").agg(F.sum((F.col("kind") != "file").cast("long")).alias("symbols"))
    return per_file.select(F.explode(paths.ancestors(F.col("file_path"))).alias("folder"), "symbols").groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("symbols").alias("symbols"))


def folder_flows(graph: Graph) -> DataFrame:
    """Edges within, out of and into every folder: summed per pair of folders first, then spread over ancestors."""
    where = graph.nodes.select("id", paths.folder(F.col("file_path")).alias("d"))
    ends = graph.edges.where("edge_type <> 'defines'").join(where.select(F.col("id").alias("source_id"), F.col("d").alias("a")), "source_id").join(where.select(F.col("id").alias("target_id"), F.col("d").alias("b")), "target_id")
    pairs = ends.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    up = lambda c: paths.ancestors(F.concat(F.col(c), F.lit("/x")))
    up_or_root = lambda c: F.when(F.col(c) == "", F.array(F.lit(""))).otherwise(up(c))
    pairs = pairs.withColumn("ua", up_or_root("a")).withColumn("ub", up_or_root("b"))
    label = lambda c, name: F.transform(c, lambda f: F.struct(f.alias("folder"), F.lit(name).alias("direction")))
    flows = F.concat(label(F.array_intersect("ua", "ub"), "internal"), label(F.array_except("ua", "ub"), "out"), label(F.array_except("ub", "ua"), "in"))
    return pairs.select(F.inline(flows), "n").groupBy("folder").pivot("direction", ["internal", "out", "in"]).agg(F.sum("n")).fillna(0).withColumnsRenamed({"out": "outgoing", "in": "incoming"})


#: Share of its methods' scores that a type gains (fixed value).
MEMBERS = 0.3


def key_symbols(graph: Graph, per_file: int = 3) -> DataFrame:
    """The leading symbols of every file. Score: exact calls 1, references 0.5, calls by name 1 / definitions; a type or
    class gains MEMBERS of the scores of its methods in its folder; unexported names count 0.8 of it with a docstring and 0.4 without; main counts 0.5 more."""
    incoming = graph.edges.groupBy(F.col("target_id").alias("id")).agg(
        F.sum(((F.col("edge_type") == "calls") & (F.col("provenance") == "precise")).cast("long")).alias("precise"),
        F.sum(((F.col("edge_type") == "calls") & (F.col("provenance") != "precise")).cast("long")).alias("named"),
        F.sum((F.col("edge_type") == "references").cast("long")).alias("refs"),
    )
    symbols = graph.nodes.where("kind not in ('file', 'test')").join(incoming, "id", "left").fillna(0, ["precise", "named", "refs"]).join(definition_counts(graph), ["project_id", "symbol"], "left")
    base = F.col("precise") + F.col("named") / F.greatest(F.coalesce("definitions", F.lit(1)), F.lit(1)) + 0.5 * F.col("refs")
    symbols = symbols.withColumn("base", base)
    # "pkg.Type.method" counts for the type whose full name is "pkg.Type".
    owner = F.substring_index("fqn", ".", -1)
    of = F.expr("left(fqn, length(fqn) - length(substring_index(fqn, '.', -1)) - 1)")
    methods = symbols.where((F.col("kind") == "method") & (owner != F.col("fqn"))).groupBy("project_id", paths.folder(F.col("file_path")).alias("dir"), of.alias("fqn")).agg(F.sum("base").alias("of_members"))
    symbols = symbols.withColumn("dir", paths.folder(F.col("file_path"))).join(methods, ["project_id", "dir", "fqn"], "left").drop("dir")
    gained = F.when(F.col("kind").isin("type", "class"), MEMBERS * F.coalesce("of_members", F.lit(0.0))).otherwise(0.0)
    base = F.col("base") + gained
    factor = F.when(names.is_exported(F.col("symbol")), 1.0).when(F.coalesce("docstring", F.lit("")) != "", 0.8).otherwise(0.4)
    score = scores.round_half_up(base * factor + F.when(F.col("symbol") == "main", 0.5).otherwise(0.0), 3)
    ranked = symbols.withColumn("score", score).withColumn("rn", F.row_number().over(W.partitionBy("file_path").orderBy(F.desc("score"), "start_line", "fqn", "id")))
    return ranked.where(F.col("rn") <= per_file).select("file_path", "rn", "id", "symbol", "score")


def common_callers(callers: DataFrame) -> DataFrame:
    """Of (root, id) caller rows: callers of two or more roots."""
    return callers.groupBy("id").agg(F.countDistinct("root").alias("roots")).where("roots >= 2")


def fingerprint(files: DataFrame) -> DataFrame:
    """One SHA-256 per project over ``path NUL hash LF`` of its files in order of path.

    The digest is over an ordered whole by definition: one task gathers a line per file. See tree_fingerprint for very large projects.
    """
    return files.groupBy("project_id").agg(_digest(_file_line()).alias("fingerprint"))


#: Buckets of a digest tree go by this many leading hex digits of the digest of a path.
BUCKET_DIGITS = 3


def tree_fingerprint(files: DataFrame) -> DataFrame:
    """One SHA-256 per project, as a digest tree: over the digests, in order, of 4096 buckets of files, so no task gathers more than a bucket's lines."""
    bucket = F.left(F.md5("file_path"), F.lit(BUCKET_DIGITS)).alias("bucket")
    buckets = files.groupBy("project_id", bucket).agg(_digest(_file_line()).alias("digest"))
    return buckets.groupBy("project_id").agg(_digest(F.concat("bucket", "digest")).alias("fingerprint"))


def _file_line() -> Column:
    return F.concat("file_path", F.lit("\0"), "file_hash", F.lit("\n"))


def _digest(lines: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(lines)), ""), 256)


#: How far a call graph can be trusted, weakest first; none says nothing.
CALL_GRAPHS = {"unresolved": 1, "name": 2, "resolved": 3}


def weakest_call_graph(labels: DataFrame, key: str) -> DataFrame:
    """(key, call_graph): the weakest label of each group of (key, call_graph); none only if all are none."""
    rank = F.try_element_at(F.create_map(*[F.lit(x) for kv in CALL_GRAPHS.items() for x in kv]), F.col("call_graph"))
    return labels.groupBy(key).agg(F.coalesce(F.min_by("call_graph", rank), F.lit("none")).alias("call_graph"))


def hit_counts(hits: DataFrame) -> DataFrame:
    """Hits per target of an append-only log (query_id, target, ts): each query counts a target once."""
    once = hits.groupBy("query_id", "target").agg(F.max("ts").alias("ts"))
    return once.groupBy("target").agg(F.count(F.lit(1)).alias("hits"), F.max("ts").alias("last_hit_at"))


def dependency_samples(dependencies: DataFrame, per_kind: int = 3, budget: int = 50) -> DataFrame:
    """Samples of evidence per target file: the first few edges of each source file and type, while the file's budget lasts."""
    one = W.partitionBy("target_file", "source_file", "edge_type").orderBy("source_id", "target_id")
    few = dependencies.withColumn("k", F.row_number().over(one)).where(F.col("k") <= per_kind)
    running = F.row_number().over(W.partitionBy("target_file").orderBy("source_file", "edge_type", "k"))
    return few.withColumn("position", running).where(F.col("position") <= budget)
