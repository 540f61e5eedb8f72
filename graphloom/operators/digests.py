"""Digest trees: one digest per bucket of rows and per inner node, so that two states are compared by descending where they differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .maintenance import file_delta

#: Levels below the root; a node of level k is named by the k leading hex digits of the digest of a path.
LEVELS = 3
#: Fixed value: the fields of a symbol that a structural digest is over, in order.
STRUCTURE = ("file_path", "start_line", "end_line", "fqn", "kind", "symbol", "language", "signature", "docstring", "source_hash")


def bucket(path: Column) -> Column:
    return F.left(F.md5(path), F.lit(LEVELS))


def _over(lines: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(lines)), ""), 256)


def digest_tree(rows: DataFrame, line: Column, path: str = "file_path", project: str = "project_id") -> DataFrame:
    """(project_id, level, prefix, digest) of every node. A bucket's digest is over its rows' lines in order, an inner one over its children's prefixes
    and digests, so no task gathers more than a bucket, and the root is one digest per project."""
    # At most 16 ** LEVELS rows a project, from which the levels above are made.
    level = cut(rows.groupBy(F.col(project).alias("project_id"), bucket(F.col(path)).alias("prefix")).agg(_over(line).alias("digest")))
    out = [level.withColumn("level", F.lit(LEVELS))]
    for k in range(LEVELS - 1, -1, -1):
        level = level.groupBy("project_id", F.left("prefix", F.lit(k)).alias("prefix")).agg(_over(F.concat("prefix", "digest")).alias("digest"))
        out.append(level.withColumn("level", F.lit(k)))
    return reduce(DataFrame.unionByName, out).select("project_id", "level", "prefix", "digest")


def file_tree(files: DataFrame) -> DataFrame:
    """The tree of a manifest (project_id, file_path, file_hash)."""
    return digest_tree(files, F.concat("file_path", F.lit("\0"), "file_hash", F.lit("\n")))


def structural_tree(nodes: DataFrame) -> DataFrame:
    """The tree of all symbols, over their STRUCTURE: it changes when a symbol moves or is described anew, though no file is compared."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in STRUCTURE]
    return digest_tree(nodes.where("kind <> 'file'"), F.concat(*(x for f in fields for x in (f, F.lit("\0"))), F.lit("\n")))


def unequal_buckets(before: DataFrame, after: DataFrame) -> DataFrame:
    """(project_id, prefix): buckets in which two trees differ, or that one of them lacks.

    Level by level only the children of unequal nodes are met; equal subtrees are never looked into.
    """
    open_ = None
    for k in range(LEVELS + 1):
        old, new = (t.where(F.col("level") == k).select("project_id", "prefix", F.col("digest").alias(n)) for t, n in ((before, "old"), (after, "new")))
        if open_ is not None:
            above = open_.withColumnRenamed("prefix", "up")
            old, new = (t.withColumn("up", F.left("prefix", F.lit(k - 1))).join(above, ["project_id", "up"], "left_semi").drop("up") for t in (old, new))
        both = old.join(new, ["project_id", "prefix"], "full")
        open_ = cut(both.where(~F.col("old").eqNullSafe(F.col("new"))).select("project_id", "prefix"))
    return open_


def delta_by_digests(before: DataFrame, after: DataFrame, before_tree: DataFrame | None = None, after_tree: DataFrame | None = None) -> DataFrame:
    """(file_path, change) between two manifests, as ``file_delta`` gives it, from the rows of unequal buckets alone.

    Kept trees (:func:`file_tree`) spare reading the manifests for them; where a manifest is stored by ``bucket``, only its unequal parts are read.
    """
    unequal = unequal_buckets(file_tree(before) if before_tree is None else before_tree, file_tree(after) if after_tree is None else after_tree)
    some = lambda files: files.withColumn("prefix", bucket(F.col("file_path"))).join(unequal, ["project_id", "prefix"], "left_semi")
    return file_delta(some(before), some(after))
