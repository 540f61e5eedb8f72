"""A store of immutable graph snapshots, addressed by the fingerprint of their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.aggregates import tree_fingerprint
from ..schema import ANNOTATIONS, COVERAGE, EDGES, FILES, NODES, Graph

SCHEMAS = {"nodes": NODES, "edges": EDGES, "files": FILES, "coverage": COVERAGE, "annotations": ANNOTATIONS}


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def address(graph: Graph) -> str:
    """The fingerprint of one project's files."""
    row = tree_fingerprint(graph.files).first()
    return row["fingerprint"] if row else "empty"


def save(graph: Graph, root: str) -> str:
    """Write a snapshot unless its like is there; a marker comes last, so a broken write is never taken for one."""
    spark = graph.nodes.sparkSession
    name = address(graph)
    fs, done = _fs(spark, f"{root}/{name}/_DONE")
    if not fs.exists(done):
        for key in SCHEMAS:
            if (table := getattr(graph, key)) is not None:
                table.write.mode("overwrite").parquet(f"{root}/{name}/{key}")
        fs.create(done, True).close()
    return name


def restore(spark: SparkSession, root: str, name: str) -> Graph:
    """The graph of a snapshot; raises if there is none whole."""
    fs, done = _fs(spark, f"{root}/{name}/_DONE")
    if not fs.exists(done):
        raise FileNotFoundError(f"no snapshot {name} in {root}")
    tables = {}
    for key, schema in SCHEMAS.items():
        _, path = _fs(spark, f"{root}/{name}/{key}")
        tables[key] = spark.read.schema(schema).parquet(f"{root}/{name}/{key}") if fs.exists(path) else None
    return Graph(**tables)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(fingerprint) of all whole snapshots."""
    fs, path = _fs(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    whole = [(n,) for n in sorted(names) if fs.exists(_fs(spark, f"{root}/{n}/_DONE")[1])]
    return spark.createDataFrame(whole, "fingerprint string")


def drop(spark: SparkSession, root: str, name: str) -> bool:
    """Delete a snapshot; whether there was one."""
    fs, path = _fs(spark, f"{root}/{name}")
    return bool(fs.exists(path) and fs.delete(path, True))
