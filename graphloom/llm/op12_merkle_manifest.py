"""A Merkle manifest of a table: digests of rows, a proof for each, and the check of a tampered copy.

Rows become leaves in the JVM; only digests are shuffled. Leaves are ranked within their group by a range shuffle and the counts
of its partitions. Then the broadcast upper-tree variant: blocks of FAN ** BLOCK_LEVELS consecutive leaves are reduced
in parallel, and what they leave is reduced in the same way until a top of at most MOST_TOP nodes is left. The driver builds
the tree above it and broadcasts its levels, of which a suffix path is one run each; executors finish the proofs and fold each row.

The roots of the groups are the leaves of a second tree, which the driver builds too; only where there are more groups than
MOST_TOP, it is reduced like the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import ship, written

#: Fixed values.
FAN = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

BLOCK_LEVELS = 3
#: Nodes the driver takes at most, 64 bytes each; their whole tree is broadcast.
MOST_TOP = 1 << 14


def encoded(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(encoded, columns)), 256)


def digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def levels_above(nodes: list[str], n: int | None = None) -> list[list[str]]:
    """The levels of a tree from its leaves up to its root; or just ``n`` levels, even where one node is left before, as in a short last block."""
    out = [nodes]
    while len(out[-1]) > 1 if n is None else len(out) <= n:
        out.append([digest(out[-1][i : i + FAN]) for i in range(0, len(out[-1]), FAN)])
    return out


def siblings(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """What stands before and after node ``at`` of the lowest level in its run, level by level."""
    out = []
    for nodes in levels[:-1]:
        first = at - at % FAN
        out.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + FAN])))
        at //= FAN
    return out


def folded(node: str, path: list[tuple[str, str]]) -> str:
    for before, after in path:
        node = digest([before, node, after])
    return node


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    out = 0
    while n > 1:
        n, out = -(-n // FAN), out + 1
    return out


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Written ``rows`` with pos (within its group, by ``order``), n (rows of the group) and grp (rank of the group); all from 0, nulls first.

    Rows that are equal in all of ``order`` are dealt out by where they were read, so that they, however many, do not meet in one task.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    held = rows.withColumn("__at", F.monotonically_increasing_id())
    held = held.repartitionByRange(*keys, F.col("__at")).sortWithinPartitions(*keys, "__at").drop("__at")
    held = written(held.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    runs = held.groupBy(group, "part").agg(F.count(F.lit(1)).alias("k"), F.min("row").alias("first"))
    own = W.partitionBy(group)
    earlier = own.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # A row per group and partition at most; Catalyst broadcasts it if its measured size allows.
    runs = written(
        runs.select(
            F.col(group).alias("its"),
            F.col("part").alias("its_part"),
            (F.coalesce(F.sum("k").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
            F.sum("k").over(own).alias("n"),
            (F.dense_rank().over(W.orderBy(F.col(group).asc_nulls_first())) - 1).cast("long").alias("grp"),
        )
    )
    joined = held.join(runs, F.col(group).eqNullSafe(F.col("its")) & (F.col("part") == F.col("its_part")))
    return joined.withColumn("pos", F.col("row") + F.col("shift")).drop("its", "its_part", "shift", "part", "row")


_NODE = "grp long, pos long, n long, digest string"


def _block(rows: pd.DataFrame, deep: int) -> list[list[str]]:
    """The levels of a block, given in order: ``deep``, or as many as its group has."""
    return levels_above(rows["digest"].tolist(), min(deep, height(int(rows["n"].iloc[0]))))


def _blocks(nodes: DataFrame, deep: int) -> DataFrame:
    """A written node for each block of nodes (grp, pos, n, digest)."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        top = _block(rows.sort_values("pos"), deep)[-1]
        return pd.DataFrame({"grp": [key[0]], "pos": [key[1]], "n": [-(-int(rows["n"].iloc[0]) // FAN**deep)], "digest": top})

    return written(nodes.select("grp", "pos", "n", "digest").groupBy("grp", F.floor(F.col("pos") / FAN**deep).alias("block")).applyInPandas(one, _NODE))


@dataclass(frozen=True)
class Top:
    """The tree above blocks, as the driver has built it: levels by group, and those above the groups' roots."""

    groups: dict[int, list[list[str]]]
    above: list[list[str]]

    def suffix(self, grp: int, at: int) -> tuple[list[tuple[str, str]], str, str]:
        """Path from a block's node up, the root of its group, and that of all."""
        levels = self.groups[grp]
        return siblings(levels, at) + siblings(self.above, grp), levels[-1][0], self.above[-1][0]


_SUFFIX = "grp long, pos long, path array<struct<before: string, after: string>>, subroot string, root string"
Finish = Callable[[pd.DataFrame, list[list[tuple[str, str]]], list[tuple[str, str]], str, str], pd.DataFrame]


def _suffix_rows(rows: pd.DataFrame, own: list[list[tuple[str, str]]], suffix: list[tuple[str, str]], subroot: str, root: str) -> pd.DataFrame:
    named = [[{"before": a, "after": b} for a, b in p + suffix] for p in own]
    return pd.DataFrame({"grp": rows["grp"], "pos": rows["pos"], "path": named, "subroot": subroot, "root": root})


def _suffixes(blocks: DataFrame, deep: int, most_top: int) -> Broadcast | DataFrame:
    """For the nodes of blocks: a broadcast :class:`Top` where the driver can take them all, else a written table of suffix paths."""
    n, most = blocks.agg(F.count(F.lit(1)), F.max("n")).first()
    if n <= most_top:
        held: dict[int, list[str]] = {}
        for r in blocks.orderBy("grp", "pos").select("grp", "digest").collect():
            held.setdefault(r["grp"], []).append(r["digest"])
        groups = {g: levels_above(d) for g, d in held.items()}
        return blocks.sparkSession.sparkContext.broadcast(Top(groups, levels_above([t[-1][0] for t in groups.values()])))
    if most > 1:
        return written(_finished(blocks, _suffixes(_blocks(blocks, deep), deep, most_top), deep, _suffix_rows, _SUFFIX))
    # A root per group, more than the driver takes: they are the leaves of one tree.
    one = blocks.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("pos"), F.lit(n).cast("long").alias("n"), "digest")
    upper = written(_finished(one, _suffixes(_blocks(one, deep), deep, most_top), deep, _suffix_rows, _SUFFIX))
    own = blocks.select(F.col("grp").alias("its"), "digest")
    return written(upper.join(own, F.col("pos") == F.col("its")).select(F.col("pos").alias("grp"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root"))


def _finished(nodes: DataFrame, above: Broadcast | DataFrame, deep: int, finish: Finish, schema: str) -> DataFrame:
    """``finish`` of each block with the paths of its nodes inside it, and the suffix path and roots they share."""

    def rows_of(rows: pd.DataFrame, at: int, suffix: tuple) -> pd.DataFrame:
        rows = rows.sort_values("pos", ignore_index=True)
        levels = _block(rows, deep)
        return finish(rows, [siblings(levels, p - at * FAN**deep) for p in rows["pos"].tolist()], *suffix)

    def by_top(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return rows_of(rows, key[1], above.value.suffix(key[0], key[1]))

    def by_table(key: tuple, rows: pd.DataFrame, suffix: pd.DataFrame) -> pd.DataFrame:
        s = suffix.iloc[0]
        return rows_of(rows, key[1], ([(p["before"], p["after"]) for p in s["path"]], s["subroot"], s["root"]))

    grouped = nodes.groupBy("grp", F.floor(F.col("pos") / FAN**deep).alias("block"))
    if isinstance(above, DataFrame):
        return grouped.cogroup(above.groupBy("grp", "pos")).applyInPandas(by_table, schema)
    return grouped.applyInPandas(by_top, schema)


def _proofs(rows: pd.DataFrame, own: list[list[tuple[str, str]]], suffix: list[tuple[str, str]], subroot: str, root: str) -> pd.DataFrame:
    rest = "".join(a + b for a, b in suffix)
    proof = [digest([*(a + b for a, b in p), rest]) for p in own]
    fold = [folded(node, p + suffix) for node, p in zip(rows["copy"].tolist(), own, strict=True)]
    return pd.DataFrame({"doc_id": rows["doc_id"], "leaf": rows["digest"], "subroot": subroot, "root": root, "proof_sha256": proof, "folded_root": fold, "verified": [f == root for f in fold]})


def manifest(docs: DataFrame, copy: dict[str, Column] | None = None, deep: int = BLOCK_LEVELS, most_top: int = MOST_TOP) -> DataFrame:
    """A row per row of ``docs``: doc_id, leaf, subroot (of its source), root, proof_sha256 (of all siblings, from the leaf up), folded_root and verified.

    ``copy`` gives columns of a copy of the rows that is checked against the manifest: folded_root is what the leaf of the copy and
    the original siblings give, and verified says whether that is the root. Without it the rows check themselves.
    ``deep`` levels are reduced at a time, until ``most_top`` nodes are left for the driver.
    Null values are leaves' parts of their own; a null source is the first source and a null doc_id comes first within its source. Rows of
    equal doc_id stand by their leaves. An empty table has no rows. Other columns than COLUMNS are not part of the manifest.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    changed = {**{c: F.col(c) for c in COLUMNS}, **(copy or {})}
    leaves = written(docs.select("doc_id", "source", leaf([F.col(c) for c in COLUMNS]).alias("digest"), leaf([changed[c] for c in COLUMNS]).alias("copy")))
    nodes = ranked(leaves, "source", ["doc_id", "digest"]).select("grp", "pos", "n", "doc_id", "digest", "copy")
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _finished(nodes, _suffixes(_blocks(nodes, deep), deep, most_top), deep, _proofs, schema)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return manifest(docs, {"text": F.when(tampered, lower).otherwise(F.col("text"))})
