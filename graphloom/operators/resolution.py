"""References that name their files, those that met nothing, and the exact pass that takes the place of calls by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Graph
from .lineage import cut, release

#: Kinds that a reference within files can mean, and kinds of references that are kept when they meet nothing.
CALLABLE = ("function", "class", "variable", "method", "test")
INHERITED = ("class", "type", "variable")
DECLARATIVE = ("reads", "writes", "documents", "depends_on")
NAME_WEIGHT = 0.7

#: A reference whose source or target is meant within a file. ``from_name`` is a full name, or the file's path for the file itself.
SCOPED = "ref_id long, kind string, from_file string, from_name string, from_line int, to_file string, to_name string, to_line int"
#: A call as an exact resolver gives it: both ends by file and line and by full name.
EXACT = "caller_file string, caller_line int, caller_fqn string, callee_file string, callee_line int, callee_fqn string, external boolean"


def by_full_name(graph: Graph) -> DataFrame:
    """(name, id): a full name means the last of its nodes; a file's path means its file node."""
    names = graph.nodes.select(F.explode(F.array(F.when(F.col("fqn") != "", F.col("fqn")), F.when(F.col("kind") == "file", F.col("file_path")))).alias("name"), "id").where("name is not null")
    return names.groupBy("name").agg(F.max("id").alias("id"))


def _declared(graph: Graph) -> DataFrame:
    return graph.nodes.where("kind <> 'file' and fqn <> ''").select("id", "file_path", "fqn", "kind", "start_line")


def _at_line(refs: DataFrame, decls: DataFrame, end: str) -> DataFrame:
    """``refs`` with ``hit`` (id, kind): of the declarations of the name at ``end`` the first by id that starts at its line, if one does."""
    keys = [f"{end}_file", f"{end}_name", f"{end}_line"]
    starts = decls.where("start_line > 0").groupBy("file_path", "fqn", "start_line").agg(F.min(F.struct("id", "kind")).alias("hit"))
    return refs.join(starts.toDF(*keys, "hit"), keys, "left")


def scoped_references(graph: Graph, refs: DataFrame) -> DataFrame:
    """(ref_id, source_id, target_id, kind, weight, provenance): edges of SCOPED references, candidates by name.

    The source is the first declaration of its name in from_file, at from_line if one starts there; the file node if the name is the
    file's path; any of that name without from_file. Targets are the declarations of to_name in to_file, at to_line if one starts there,
    of kinds that the reference can mean; without to_file there are none. Nothing refers to itself.
    """
    decls = _declared(graph)
    names = by_full_name(graph)
    anywhere = refs.where("from_file is null").join(names.select(F.col("name").alias("from_name"), F.col("id").alias("source_id")), "from_name")
    of_file = refs.where("from_file = from_name").join(names.select(F.col("name").alias("from_name"), F.col("id").alias("source_id")), "from_name")
    first = decls.groupBy("file_path", "fqn").agg(F.min(F.struct("start_line", "id")).alias("first")).select(F.col("file_path").alias("from_file"), F.col("fqn").alias("from_name"), F.col("first.id").alias("first"))
    inside = _at_line(refs.where("from_file <> from_name").join(first, ["from_file", "from_name"]), decls, "from").withColumn("source_id", F.coalesce("hit.id", "first"))
    columns = ["ref_id", "source_id", "kind", "to_file", "to_name", "to_line"]
    located = anywhere.select(*columns).unionByName(of_file.select(*columns)).unionByName(inside.select(*columns))
    located = cut(_at_line(located, decls, "to").withColumn("inherits", F.coalesce(F.col("kind").isin("extends", "implements"), F.lit(False))))
    means = lambda kind: F.when(F.col("inherits"), F.col(kind).isin(*INHERITED)).otherwise(F.col(kind).isin(*CALLABLE))
    exact = located.where(F.col("hit").isNotNull() & means("hit.kind")).withColumn("target_id", F.col("hit.id"))
    # Declarations of one name meet only references that can mean them.
    ways = F.array_compact(F.array(F.when(F.col("kind").isin(*INHERITED), True), F.when(F.col("kind").isin(*CALLABLE), False)))
    every = decls.select(F.col("file_path").alias("to_file"), F.col("fqn").alias("to_name"), F.col("id").alias("target_id"), F.explode(ways).alias("inherits"))
    named = located.where("hit is null").join(every, ["to_file", "to_name", "inherits"])
    columns = ["ref_id", "source_id", "target_id", "kind"]
    kept = exact.select(*columns).unionByName(named.select(*columns)).where("target_id <> source_id")
    return kept.select(*columns, F.lit(NAME_WEIGHT).alias("weight"), F.lit("name").alias("provenance"))


def unresolved_references(graph: Graph, refs: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, file_path, to_name, kind): declarative references (ref_id, from_fqn, to_name, kind, to_fqn) with a known source of which ``edges`` (ref_id) has none.

    They are known by their full name if they have one, and kept so that a file is read again once the name is there.
    """
    sources = by_full_name(graph).join(graph.nodes.select("id", "project_id", "file_path"), "id").select(F.col("name").alias("from_fqn"), "project_id", "file_path")
    open_ = refs.where(F.col("kind").isin(*DECLARATIVE)).join(edges.select("ref_id"), "ref_id", "left_anti").select("from_fqn", "kind", F.coalesce("to_fqn", "to_name").alias("to_name"))
    return open_.where("to_name <> ''").join(sources, "from_fqn").select("project_id", "file_path", "to_name", "kind").distinct()


def by_position(graph: Graph) -> DataFrame:
    """(file_path, start_line, id) of the lines at which a single node of its file starts."""
    return graph.nodes.groupBy("file_path", "start_line").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("id")).where("n = 1").select("file_path", "start_line", "id")


def _end_key(who: str) -> list[Column]:
    """128 bits that stand for an end (file, line, full name); nulls count as such."""
    parts = [F.col(f"{who}_{c}") for c in ("file", "line", "fqn")]
    nulls = [p.isNull() for p in parts]
    return [F.xxhash64(*parts, *nulls).alias(f"key_{who}_a"), F.xxhash64(*nulls, *reversed(parts)).alias(f"key_{who}_b")]


def located_calls(graph: Graph, exact: DataFrame) -> DataFrame:
    """EXACT rows within the project with source_id and target_id: by position where a single node starts there, else by full name; null if by neither.

    ``exact`` is read for the ends of callers, for those of callees and for the calls, so it should be a table and not a plan.
    """
    positions, names = by_position(graph), by_full_name(graph)
    inside = exact.where("not external")

    def ends(who: str, out: str) -> DataFrame:
        keys = [f"{who}_file", f"{who}_line", f"{who}_fqn"]
        at = positions.select(F.col("file_path").alias(keys[0]), F.col("start_line").alias(keys[1]), F.col("id").alias("by_position"))
        named = names.select(F.col("name").alias(keys[2]), F.col("id").alias("by_name"))
        # Each end is looked up once, whatever number of calls has it.
        found = inside.select(*keys).distinct().join(at, keys[:2], "left").join(named, keys[2], "left")
        found = found.select(*_end_key(who), F.coalesce("by_position", "by_name").alias("id"))
        # Two ends of one key have yet to be seen; they would end the job, not mix its rows.
        one = F.when(F.count(F.lit(1)) == 1, F.max("id")).otherwise(F.raise_error(F.lit("two ends of calls have one key")).cast("long"))
        return found.groupBy(f"key_{who}_a", f"key_{who}_b").agg(one.alias(out))

    # Calls go to their ends by keys, not by paths and names.
    calls = inside.select(*_end_key("caller"), *_end_key("callee"))
    calls = calls.join(ends("caller", "source_id"), ["key_caller_a", "key_caller_b"]).select("source_id", "key_callee_a", "key_callee_b")
    return calls.join(ends("callee", "target_id"), ["key_callee_a", "key_callee_b"]).select("source_id", "target_id")


def supersede_by_position(graph: Graph, exact: DataFrame, clean: DataFrame, language: str = "go", resolver: str = "types") -> Graph:
    """The graph after an exact pass over a language: ``exact`` calls (EXACT) and the files it resolved whole, ``clean`` (project_id, file_path).

    Calls of clean files, by name and exact ones of an earlier pass, give way to the new ones, of which those come in whose ends are known
    and differ. Coverage of the language's files is what this pass says; that of other files stays.
    """
    own = graph.nodes.join(clean.select("file_path").distinct(), "file_path", "left_semi").select(F.col("id").alias("source_id"))
    calls = graph.edges.where("edge_type = 'calls'").join(own, "source_id", "left_anti").select(*graph.edges.columns)
    exact = cut(exact.where("not external"))
    located = cut(located_calls(graph, exact).where("source_id <> target_id"))
    release(exact)
    new = located.select("source_id", "target_id", F.lit("calls").alias("edge_type"), F.lit(1.0).alias("weight"), F.lit("precise").alias("provenance"))
    # An exact call of an earlier pass from a file that is not clean now comes in again only once.
    precise = F.coalesce(F.col("provenance") == "precise", F.lit(False))
    kept = calls.where(precise).join(located.distinct(), ["source_id", "target_id"], "left_anti").select(*graph.edges.columns)
    calls = calls.where(~precise).unionByName(kept)
    edges = graph.edges.where("edge_type <> 'calls'").unionByName(calls).unionByName(new)
    return Graph(graph.nodes, edges, graph.files, pass_coverage(graph, clean, language, resolver), graph.annotations)


def pass_coverage(graph: Graph, clean: DataFrame, language: str = "go", resolver: str = "types") -> DataFrame | None:
    """The coverage that :func:`supersede_by_position` leaves, for which no call is read."""
    if graph.coverage is None:
        return None
    read = graph.nodes.where(F.col("language") == language).select("file_path").distinct()
    fresh = clean.select("project_id", "file_path", F.lit(resolver).alias("resolver")).distinct()
    return graph.coverage.join(read, "file_path", "left_anti").join(clean.select("file_path").distinct(), "file_path", "left_anti").select("project_id", "file_path", "resolver").unionByName(fresh)


def pass_counts(graph: Graph, exact: DataFrame) -> DataFrame:
    """One row: calls that come in, calls with an unknown end, calls of a node to itself, and calls out of the project."""
    exact = cut(exact)
    ends = located_calls(graph, exact)
    known = F.col("source_id").isNotNull() & F.col("target_id").isNotNull()
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    inside = ends.agg(count(known & (F.col("source_id") != F.col("target_id"))).alias("upgraded"), count(~known).alias("skipped"), count(known & (F.col("source_id") == F.col("target_id"))).alias("to_itself"))
    return inside.withColumn("external", F.lit(exact.where("external").count()).cast("long"))
