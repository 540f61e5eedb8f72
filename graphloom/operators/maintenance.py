"""How one immutable snapshot becomes the next: replace, remap, upsert, supersede, cascade, export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import Graph
from .lineage import cut


def file_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file_path, change): 'changed', 'new' or 'deleted' files between two manifests (file_path, file_hash)."""
    both = before.select("file_path", F.col("file_hash").alias("old")).join(after.select("file_path", F.col("file_hash").alias("new")), "file_path", "full")
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed")
    return both.select("file_path", change.alias("change")).where("change is not null")


def replace_files(old: Graph, fresh: Graph, touched: DataFrame) -> tuple[Graph, DataFrame]:
    """The next snapshot after the files in ``touched`` (file_path) were read again as ``fresh``, and the files whose surface changed.

    Edges from elsewhere into a touched file follow their target's identity (symbol, fqn, kind and its ordinal by line among
    equals) to its new id, exact ones becoming edges by name; a target without a new self is a surface change of its file.
    """
    key = ["file_path"]
    gone = old.nodes.join(touched, key, "left_semi")
    stay = old.nodes.join(touched, key, "left_anti")
    identity = ["project_id", "file_path", "symbol", "fqn", "kind"]
    ordinal = F.row_number().over(W.partitionBy(*identity).orderBy("start_line", "id"))
    was = gone.withColumn("ordinal", ordinal).select(*identity, "ordinal", F.col("id").alias("old_id"))
    now = fresh.nodes.withColumn("ordinal", ordinal).select(*identity, "ordinal", F.col("id").alias("new_id"))
    same = [was[c].eqNullSafe(now[c]) for c in (*identity, "ordinal")]
    moved = was.join(now, same, "left").select("old_id", "new_id", was["file_path"])
    inside = gone.select(F.col("id").alias("source_id"))
    inbound = old.edges.join(inside, "source_id", "left_anti").join(moved, F.col("target_id") == F.col("old_id"))
    kept = inbound.where("new_id is not null")
    remapped = kept.select("source_id", F.col("new_id").alias("target_id"), "edge_type", F.when(F.col("provenance") == "precise", 0.7).otherwise(F.col("weight")).alias("weight"), F.lit("name").alias("provenance"))
    outside = old.edges.join(inside, "source_id", "left_anti").join(gone.select(F.col("id").alias("target_id")), "target_id", "left_anti").select(*old.edges.columns)
    surface = inbound.where("new_id is null").select("file_path").distinct()
    nodes = stay.unionByName(fresh.nodes.select(*stay.columns))
    edges = outside.unionByName(remapped).unionByName(fresh.edges.select(*outside.columns))
    return Graph(nodes, edges, old.files, old.coverage, old.annotations), surface


def upsert(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """A keyed full-outer merge with what happened to each row: created, updated, unchanged or kept."""
    a = old.select(*keys, F.struct(*values).alias("was"))
    b = new.select(*keys, F.struct(*values).alias("is"))
    action = F.when(F.col("was").isNull(), "created").when(F.col("is").isNull(), "kept").when(F.col("was").eqNullSafe(F.col("is")), "unchanged").otherwise("updated")
    return a.join(b, keys, "full").select(*keys, F.coalesce("is", "was").alias("v"), action.alias("action")).select(*keys, "v.*", "action")


def cascade_delete(graph: Graph, deleted: DataFrame) -> Graph:
    """Without the deleted files (file_path): their nodes, and every edge that touched those."""
    gone = graph.nodes.join(deleted, "file_path", "left_semi").select("id")
    drop = lambda df, c: df.join(gone.withColumnRenamed("id", c), c, "left_anti")
    edges = drop(drop(graph.edges, "source_id"), "target_id").select(*graph.edges.columns)
    without = lambda df: None if df is None else df.join(deleted, "file_path", "left_anti").select(*df.columns)
    return Graph(graph.nodes.join(deleted, "file_path", "left_anti").select(*graph.nodes.columns), edges, without(graph.files), without(graph.coverage), graph.annotations)


def supersede_calls(graph: Graph, clean: DataFrame, exact: DataFrame) -> Graph:
    """Calls of cleanly resolved sources (source_id) give way to ``exact`` ones, which are precise."""
    kept = graph.edges.where("edge_type <> 'calls'").unionByName(graph.edges.where("edge_type = 'calls'").join(clean, "source_id", "left_anti").select(*graph.edges.columns))
    new = exact.select("source_id", "target_id", F.lit("calls").alias("edge_type"), F.lit(1.0).alias("weight"), F.lit("precise").alias("provenance"))
    return Graph(graph.nodes, kept.unionByName(new), graph.files, graph.coverage, graph.annotations)


def orphan_vectors(vectors: DataFrame, owners: DataFrame) -> DataFrame:
    """Vectors (vec_id) that no node (vec_id) claims."""
    return vectors.join(owners.where("vec_id is not null"), "vec_id", "left_anti")


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in that order."""
    return df.orderBy(*order).offset(offset).limit(limit)


#: About how many nodes one task sorts.
RANGE = 250_000


def node_positions(nodes: DataFrame) -> DataFrame:
    """(id, position) in the order of an export, without gathering nodes in one task: ranks within sorted ranges plus the sizes of the ranges before.

    A range holds about RANGE nodes, so there are more of them, not larger ones, the more nodes there are. It is sorted once, and its
    nodes are numbered as they come. A range's offset comes from one count per partition, a bounded row each.
    """

    ranges = max(1, -(-nodes.count() // RANGE), nodes.sparkSession.sparkContext.defaultParallelism)
    ordered = nodes.select("id", F.struct("file_path", "start_line", "fqn", "kind", "symbol", "id").alias("key")).repartitionByRange(ranges, F.col("key")).sortWithinPartitions("key")
    # The upper bits are the partition, the lower 33 count its rows.
    number = F.monotonically_increasing_id()
    numbered = ordered.select("id", number.alias("number"))
    tagged = cut(numbered).select("id", F.shiftright("number", 33).alias("part"), F.col("number").bitwiseAND(F.lit((1 << 33) - 1)).alias("rank"))
    sizes = tagged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("part", before.alias("before"))
    return tagged.join(F.broadcast(offsets), "part").select("id", (F.col("rank") + F.col("before")).alias("position"))


def retarget_notes(annotations: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annotations with the targets of ``moves`` (project_id, id, target), and (project_id, id, matched) of each move."""
    new = moves.select("project_id", "id", F.col("target").alias("new_target")).dropDuplicates(["project_id", "id"])
    out = annotations.join(new, ["project_id", "id"], "left").withColumn("target", F.coalesce("new_target", "target")).select(*annotations.columns)
    return out, _matched(new, annotations)


def delete_notes(annotations: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annotations without those of ``ids`` (project_id, id), and (project_id, id, matched) of each."""
    gone = ids.select("project_id", "id").distinct()
    return annotations.join(gone, ["project_id", "id"], "left_anti").select(*annotations.columns), _matched(gone, annotations)


def _matched(asked: DataFrame, annotations: DataFrame) -> DataFrame:
    there = annotations.select("project_id", "id", F.lit(True).alias("there"))
    return asked.join(there, ["project_id", "id"], "left").select("project_id", "id", F.coalesce("there", F.lit(False)).alias("matched"))


def set_vec_ids(nodes: DataFrame, by_node: DataFrame) -> DataFrame:
    """Nodes whose vec_id follows ``by_node`` (project_id, id, vec_id); a null there clears it, other nodes keep theirs."""
    old = F.col("vec_id") if "vec_id" in nodes.columns else F.lit(None).cast("string")
    new = by_node.select("project_id", "id", F.struct(F.col("vec_id").alias("v")).alias("set_to")).dropDuplicates(["project_id", "id"])
    moved = nodes.withColumn("old_vec", old).join(new, ["project_id", "id"], "left")
    return moved.select(*(c for c in nodes.columns if c != "vec_id"), F.when(F.col("set_to").isNotNull(), F.col("set_to.v")).otherwise(F.col("old_vec")).alias("vec_id"))


def index_delta(nodes: DataFrame, indexed: DataFrame, dirty: DataFrame) -> DataFrame:
    """(id, action) that bring a search index (ids in ``indexed``) up to ``nodes``: rows gone or flagged ``dirty`` (id) are removed,
    new and flagged ones added; a flagged node gives both."""
    now, was, flagged = (df.select("id").distinct() for df in (nodes, indexed, dirty))
    remove = was.join(now, "id", "left_anti").unionByName(was.join(flagged, "id", "left_semi")).distinct()
    add = now.join(was, "id", "left_anti").unionByName(now.join(flagged, "id", "left_semi")).distinct()
    return remove.withColumn("action", F.lit("remove")).unionByName(add.withColumn("action", F.lit("add")))
