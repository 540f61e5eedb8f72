"""File trees, diffs and snapshots."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import paths
from ..operators.maintenance import node_positions
from ..schema import Graph
from ..ship import ship

#: What a walk leaves out by default.
EXCLUDED = [
    ".git", "node_modules", "vendor", "dist/", "build/", "target/", "coverage/", "dist-*", "build-*", ".next", ".nuxt", "__pycache__", "venv/", "env/", "site-packages",
    "*.min.js", "*.gen.go", "*_gen.go", "*.pb.go", "*_pb.go", "*.lock",
]


def walk_tree(spark: SparkSession, root: str, exclude: list[str] | None = None, only: list[str] | None = None) -> DataFrame:
    """(file_path, content, size_bytes, file_hash, language) of the files below ``root``, or of ``only`` those of these paths; hidden folders and excluded globs are left out."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root if only is None else [f"{root.rstrip('/')}/{p}" for p in only])
    base = re.sub(r"^\w+:/*", "/", root).rstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), "^" + re.escape(base) + "/", "")
    rows = read.select(relative.alias("file_path"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("file_hash"), F.col("content").alias("raw"))
    p = F.col("file_path")
    rows = rows.where(~paths.folder(p).rlike(r"(^|/)\.[^/]") & ~paths.matches_any_glob(p, EXCLUDED if exclude is None else exclude))
    text = F.when(F.locate("\0", F.decode(F.substring("raw", 1, 512), "ISO-8859-1")) == 0, F.decode("raw", "UTF-8"))  # binary files have no text
    return rows.select("file_path", text.alias("content"), "size_bytes", "file_hash", paths.language(p).alias("language"))


HUNKS = "file_path string, status string, start_line int, end_line int, deletion_point int, old_path string"


def parse_diff(text: str) -> list[tuple]:
    """HUNKS of one unified diff without context lines."""
    out: list[tuple] = []
    path = old = status = None
    seen = False

    def close() -> None:
        if path and not seen:
            out.append((path, status, None, None, None, old))

    for line in text.split("\n"):
        if line.startswith("diff --git "):
            close()
            m = re.match(r"diff --git a/(.*?) b/(.*)$", line)
            path, old, status, seen = (m[2], None, "M", False) if m else (None, None, None, False)
        elif line.startswith("new file"):
            status = "A"
        elif line.startswith("deleted file"):
            status = "D"
        elif line.startswith("rename from "):
            old, status = line[12:], "R"
        elif path and (m := re.match(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", line)):
            start, n = int(m[1]), int(m[2]) if m[2] is not None else 1
            out.append((path, status, start, start + n - 1, None, old) if n else (path, status, None, None, start, old))
            seen = True
    close()
    return out


def diff_hunks(diffs: DataFrame) -> DataFrame:
    """HUNKS of every diff text in ``diffs`` (diff)."""
    ship(diffs.sparkSession)
    columns = [c.split()[0] for c in HUNKS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for text in batch["diff"] for r in parse_diff(text or "")]
            frame = pd.DataFrame(rows, columns=columns)
            yield frame.astype({c: "Int32" for c in ("start_line", "end_line", "deletion_point")})

    return diffs.select("diff").mapInPandas(run, HUNKS)


def merged_hunks(diffs: list[DataFrame], untracked: DataFrame | None = None) -> DataFrame:
    """HUNKS of several diffs of one tree, such as the staged and the working one, and of files (file_path) no diff shows.

    Ranges of a file are put together. It has the first status that is more than a change (M), and the old path of its last rename. A
    row without a range stands only for a file that has no other. Files of ``untracked`` come in whole (?), unless a diff has them.
    """
    ordered = reduce(DataFrame.unionByName, [d.withColumn("of", F.lit(k)) for k, d in enumerate(diffs)])
    status = F.coalesce(F.min_by("status", F.when(F.col("status") != "M", F.col("of"))), F.lit("M"))
    renamed = F.max_by("old_path", F.when(F.col("old_path").isNotNull(), F.col("of")))
    empty = F.col("start_line").isNull() & F.col("deletion_point").isNull()
    per_file = ordered.groupBy("file_path").agg(status.alias("status"), renamed.alias("old_path"), F.bool_and(empty).alias("bare"))
    rows = ordered.select("file_path", "start_line", "end_line", "deletion_point").distinct().join(per_file, "file_path")
    rows = rows.where("bare or start_line is not null or deletion_point is not null").select("file_path", "status", "start_line", "end_line", "deletion_point", "old_path")
    if untracked is None:
        return rows
    fresh = untracked.select("file_path").distinct().join(per_file.select("file_path"), "file_path", "left_anti")
    return rows.unionByName(fresh.withColumn("status", F.lit("?")), allowMissingColumns=True)


def export_snapshot(graph: Graph, folder: str) -> None:
    """JSON lines of a graph, edges by position in the ordered nodes, so that a snapshot does not depend on ids."""
    position = node_positions(graph.nodes)
    graph.nodes.join(position, "id").drop("id").write.mode("overwrite").json(f"{folder}/nodes")
    ends = graph.edges.join(position.withColumnsRenamed({"id": "source_id", "position": "source"}), "source_id").join(position.withColumnsRenamed({"id": "target_id", "position": "target"}), "target_id")
    ends.select("source", "target", "edge_type", "weight", "provenance").write.mode("overwrite").json(f"{folder}/edges")
    for name in ("files", "coverage", "annotations"):
        if (table := getattr(graph, name)) is not None:
            table.write.mode("overwrite").json(f"{folder}/{name}")


def import_snapshot(spark: SparkSession, folder: str) -> Graph:
    """A graph of exported JSON lines; node ids are made anew from durable keys and position."""
    nodes = spark.read.schema(schema.NODES.replace("id long, ", "", 1) + ", position long").json(f"{folder}/nodes")
    nodes = nodes.withColumn("id", F.xxhash64("project_id", "file_path", "kind", "fqn", "start_line", "position"))
    at = nodes.select("position", "id")
    edges = spark.read.schema("source long, target long, edge_type string, weight double, provenance string").json(f"{folder}/edges")
    edges = edges.join(at.withColumnsRenamed({"position": "source", "id": "source_id"}), "source").join(at.withColumnsRenamed({"position": "target", "id": "target_id"}), "target")
    other = {k: spark.read.schema(s).json(f"{folder}/{k}") for k, s in (("files", schema.FILES), ("coverage", schema.COVERAGE), ("annotations", schema.ANNOTATIONS))}
    columns = [c.split()[0] for c in schema.NODES.split(", ")]
    return Graph(nodes.select(*columns), edges.select("source_id", "target_id", "edge_type", "weight", "provenance"), **other)
