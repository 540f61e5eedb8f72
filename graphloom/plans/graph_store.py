"""A graph in a store of versions, in parts by file, so that a batch of paths rewrites only the parts it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut
from ..schema import ANNOTATIONS, COVERAGE, EDGES, FILES, NODES, Graph
from ..sources.store import EMPTY, Conflict, Store, Version

#: Parts of a graph; fixed when its first version is published.
PARTS = 64
SCHEMAS = {"nodes": NODES, "edges": EDGES, "files": FILES, "coverage": COVERAGE, "annotations": ANNOTATIONS}
#: A batch that meets another writer starts over from the version that was faster, so many times at most.
TRIES = 5


def part_of(file_path: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(file_path), F.lit(parts)).cast("int")


def _placed(graph: Graph, parts: int) -> dict[str, DataFrame]:
    """Tables with the part of each row: of its file, an edge of its source's, an annotation of its target's name."""
    own = graph.nodes.select(F.col("id").alias("source_id"), part_of(F.col("file_path"), parts).alias("part"))
    out = {"nodes": graph.nodes.withColumn("part", part_of(F.col("file_path"), parts)), "edges": graph.edges.join(own, "source_id")}
    for name in ("files", "coverage"):
        if (table := getattr(graph, name)) is not None:
            out[name] = table.withColumn("part", part_of(F.col("file_path"), parts))
    if graph.annotations is not None:
        out["annotations"] = graph.annotations.withColumn("part", part_of(F.coalesce("target", F.lit("")), parts))
    return out


def _shaped(rows: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Columns as the schemas have them, then the part."""
    return {k: df.select(*(F.col(f.strip().split(" ")[0]).cast(f.strip().split(" ")[1]) for f in SCHEMAS[k].split(",")), "part") for k, df in rows.items()}


def publish_graph(store: Store, graph: Graph, base: Version = EMPTY, parts: int = PARTS) -> Version:
    """A version with all of ``graph``."""
    everything = list(range(parts))
    return store.publish(base, {}, {**base.batches, "parts": parts}, {k: (df, everything) for k, df in _shaped(_placed(graph, parts)).items()})


def read_graph(spark: SparkSession, version: Version) -> Graph:
    """The graph of a pinned version."""
    return Graph(**{k: version.read_parts(spark, k, schema) for k, schema in SCHEMAS.items()})


#: From the present graph and a batch to the next one and the files (file_path) it touches.
Change = Callable[[Graph, DataFrame], tuple[Graph, DataFrame]]


def apply_batch(store: Store, stream: str, number: int, batch: DataFrame, change: Change) -> Version:
    """The version after batch ``number`` of ``stream``; the present one if it has that batch already, so that a batch may come again.

    Only parts with a touched file, or with a node that referred to one, are written; the version names the others again.
    """
    spark = store.spark
    for _ in range(TRIES):
        base = store.pin()
        if base.batches.get(stream, -1) >= number:
            return base
        parts = base.batches.get("parts", PARTS)
        old = read_graph(spark, base)
        new, touched = change(old, batch)
        touched = cut(touched.select("file_path").distinct())
        own = [r[0] for r in touched.select(part_of(F.col("file_path"), parts)).distinct().collect()]
        inside = old.nodes.join(touched, "file_path", "left_semi").select(F.col("id").alias("target_id"))
        into = old.edges.join(inside, "target_id", "left_semi").select(F.col("source_id").alias("id")).distinct()
        around = [r[0] for r in old.nodes.join(into, "id", "left_semi").select(part_of(F.col("file_path"), parts)).distinct().collect()]
        written = {"nodes": own, "files": own, "coverage": own, "edges": sorted({*own, *around})}
        placed = _shaped(_placed(Graph(new.nodes, new.edges, new.files, new.coverage), parts))
        changed = {k: (df.where(F.col("part").isin(written[k])), written[k]) for k, df in placed.items()}
        try:
            return store.publish(base, {}, {stream: number}, changed)
        except Conflict:
            continue
    raise Conflict(f"batch {number} of {stream} met other writers {TRIES} times")


def graph_writer(store: Store, stream: str, change: Change) -> Callable[[DataFrame, int], None]:
    """What ``streaming.changes.apply_batches`` hands its batches to."""

    def apply(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            apply_batch(store, stream, number, batch, change)

    return apply
