"""An inverted index of nodes that is kept: searches read the postings of their terms, updates write what changed.

The index lies in a store (``sources.store``) as segments. A segment has
postings   term, id, tf, dl by part, a row for each time a word comes; a part holds all words with the same first PREFIX characters, so that a search for words that
           begin with a term, which has at least so many, reads one part per term, and within it the range of the term
entries    id and digest of what was indexed, dl, for every node of the segment
gone       ids that the segment takes out of all earlier ones: removed nodes, and those it brings anew
sums       how many nodes it adds and how many words they have, less those it takes out
An update writes one segment of the nodes that are new, changed or gone. After MOST_SEGMENTS they are merged into one.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, paths, scores
from ..sources.store import EMPTY, Store, Version
from .lineage import cut, release
from .search import B, FIELD_WEIGHTS, K1, KIND_RANK, LEAST_IDF, OTHER_KIND, words_of

#: Characters of a word that decide its part; search terms have no fewer.
PREFIX = 3
PARTS = 64
MOST_SEGMENTS = 8
#: About how many nodes share a file of a part.
PIECE = 250_000

POSTINGS = "term string, id long, tf double, dl int, segment int, part int"
ENTRIES = "id long, digest long, dl int, segment int"
GONE = "id long, segment int"
SUMS = "nodes long, words long"


def part_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, PREFIX)), F.lit(PARTS)).cast("int")


def _digest() -> Column:
    return F.xxhash64(*(F.coalesce(F.col(f), F.lit("")) for f in FIELD_WEIGHTS))


def _segments(version: Version) -> list[int]:
    return sorted(int(name.split("/")[1]) for name in version.tables if name.startswith("entries/"))


def _all(spark: SparkSession, version: Version, table: str, schema: str) -> DataFrame:
    """A table of all segments. Postings have partitions of their own, so those of each segment are read by themselves."""
    if table != "postings":
        return version.read_parts(spark, table, schema)
    each = [version.read(spark, f"{table}/{n}", schema) for n in _segments(version)]
    return reduce(DataFrame.unionByName, each) if each else spark.createDataFrame([], schema)


def _live(spark: SparkSession, version: Version, rows: DataFrame) -> DataFrame:
    """Rows (id, segment) of the segment that brought their node last, if it was not removed since."""
    gone = _all(spark, version, "gone", GONE).groupBy("id").agg(F.max("segment").alias("last"))
    return rows.join(gone, "id", "left").where("last is null or last <= segment").drop("last")


def _rows(nodes: DataFrame, segment: int) -> tuple[DataFrame, DataFrame]:
    """Postings and entries of nodes."""
    words = {f: words_of(F.col(f)) for f in FIELD_WEIGHTS}
    dl = reduce(lambda a, b: a + b, (F.size(w) for w in words.values())).cast("int")
    entries = nodes.select("id", _digest().alias("digest"), dl.alias("dl"), F.lit(segment).alias("segment"))

    def weighed(field: str) -> Column:
        return F.transform(words[field], lambda x: F.struct(x.alias("term"), F.lit(FIELD_WEIGHTS[field]).alias("tf")))

    # Words of one node lie in one row, so nothing is grouped; a word that comes again is a posting of its own, and searches add them up.
    weighted = F.flatten(F.array(*map(weighed, words)))
    # Lengths are taken before words become rows, once a node.
    each = nodes.select("id", dl.alias("dl"), weighted.alias("words")).select("id", "dl", F.explode("words").alias("w"))
    postings = each.select(F.col("w.term").alias("term"), "id", F.col("w.tf").alias("tf"), "dl", F.lit(segment).alias("segment"))
    return postings.withColumn("part", part_of(F.col("term"))), entries


def _write_postings(postings: DataFrame, nodes: int):
    """A frequent word stands in most nodes, so a part of very many nodes is dealt to several tasks by id, each with a file of its own."""
    piece = F.pmod(F.xxhash64("id"), F.lit(-(-nodes // PIECE) or 1))
    ordered = postings.repartition("part", piece).sortWithinPartitions("part", "term", "id")
    return lambda folder: ordered.write.partitionBy("part").parquet(folder)


def delta(spark: SparkSession, version: Version, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that are new or whose text is another than the one indexed, and (id, dl) of entries that go: of changed nodes and of those no longer there."""
    held = _live(spark, version, _all(spark, version, "entries", ENTRIES)).select("id", F.col("digest").alias("was"), F.col("dl").alias("old_dl"))
    marked = nodes.withColumn("digest", _digest()).join(held, "id", "left")
    fresh = marked.where("was is null or was <> digest").select(*nodes.columns)
    out = held.join(nodes.select("id", _digest().alias("digest")), "id", "left").where("digest is null or was <> digest").select("id", F.col("old_dl").alias("dl"))
    return fresh, out


def update(store: Store, nodes: DataFrame) -> Version:
    """The version whose index is of ``nodes`` (id and the fields; ids are unique). Nothing is published if nothing changed."""
    spark, version = store.spark, store.pin()
    segments = _segments(version)
    if len(segments) >= MOST_SEGMENTS:
        version = merge(store, version)
        segments = _segments(version)
    fresh, out = delta(spark, version, nodes) if segments else (nodes, spark.createDataFrame([], "id long, dl int"))
    out = cut(out)
    number = segments[-1] + 1 if segments else 1
    postings, entries = _rows(fresh, number)
    entries = cut(entries)
    if segments and entries.isEmpty() and out.isEmpty():
        release(entries, out)
        return version
    count = lambda df, sign: df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("w")).select((F.col("n") * sign).alias("n"), (F.col("w") * sign).alias("w"))
    sums = count(entries, 1).unionByName(count(out, -1)).agg(F.sum("n").cast("long").alias("nodes"), F.sum("w").cast("long").alias("words"))
    added = entries.count()
    tables = {f"postings/{number}": _write_postings(postings, added), f"entries/{number}": entries, f"gone/{number}": out.select("id", F.lit(number).alias("segment")), f"sums/{number}": sums}
    after = store.publish(version, tables)
    release(entries, out)
    return after


def merge(store: Store, version: Version) -> Version:
    """All segments as one, without what is gone."""
    spark = store.spark
    number = _segments(version)[-1] + 1
    postings = _live(spark, version, _all(spark, version, "postings", POSTINGS)).withColumn("segment", F.lit(number))
    entries = _live(spark, version, _all(spark, version, "entries", ENTRIES)).withColumn("segment", F.lit(number))
    sums = _all(spark, version, "sums", SUMS).agg(F.sum("nodes").alias("nodes"), F.sum("words").alias("words"))
    kept = {k: v for k, v in version.tables.items() if k.split("/")[0] not in ("postings", "entries", "gone", "sums")}
    base = Version(version.number, kept, version.batches)
    return store.publish(base, {f"postings/{number}": _write_postings(postings.select("term", "id", "tf", "dl", "segment", "part"), sums.first()["nodes"] or 0), f"entries/{number}": entries.select("id", "digest", "dl", "segment"), f"sums/{number}": sums})


def postings_of(spark: SparkSession, version: Version, terms: list[str]) -> DataFrame:
    """(id, dl, tf0, tf1, ...): how much each term weighs in each live node with a word that begins with any of them.

    Only the parts of the terms are read, and of their files the row groups that can hold such words.
    """
    postings = _all(spark, version, "postings", POSTINGS)
    found = postings.where(F.col("part").isin([part for part in _parts(spark, terms)]) & reduce(lambda a, b: a | b, (F.col("term").startswith(t) for t in terms)))
    tf = [F.sum(F.when(F.col("term").startswith(t), F.col("tf")).otherwise(0.0)).alias(f"tf{i}") for i, t in enumerate(terms)]
    return _live(spark, version, found).groupBy("id").agg(F.max("dl").alias("dl"), *tf)


def _parts(spark: SparkSession, terms: list[str]) -> list[int]:
    """Parts of terms; the driver's own work on a handful of words."""
    return sorted({r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(part_of(F.col("term"))).collect()})


def lexical_search(spark: SparkSession, version: Version, nodes: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """What ``search.lexical_search`` gives for the nodes that are indexed, from the postings of the query's terms.

    Of ``nodes`` only those found are joined, for their fields decide how many terms they cover; a node that is gone is found no more.
    """
    terms = names.lexical_terms(query)
    empty = nodes.limit(0).select("*", F.lit(0.0).alias("weight"), F.lit(0).alias("covered"), F.lit(0).alias("kind_rank"), F.lit(0).alias("is_test"), F.lit(0.0).alias("score"))
    if not terms or version is EMPTY:
        return empty
    found = cut(postings_of(spark, version, terms))
    total = _all(spark, version, "sums", SUMS).agg(F.sum("nodes").alias("n"), F.sum("words").alias("words")).first()
    df = found.agg(*(F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms)))).first()
    n, mean = total["n"] or 0, float((total["words"] or 0) / total["n"] if total["n"] else 0) or 1.0
    weight, covered = F.lit(0.0), F.lit(0)
    for i, t in enumerate(terms):
        idf = max(math.log((n - (df[i] or 0) + 0.5) / ((df[i] or 0) + 0.5)), LEAST_IDF)
        tf = F.col(f"tf{i}")
        weight = weight + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(mean)))
        covered = covered + reduce(lambda a, b: a | b, (F.lower(F.coalesce(F.col(f), F.lit(""))).contains(t) for f in FIELD_WEIGHTS)).cast("int")
    kind = F.lit(OTHER_KIND)
    for k, rank in KIND_RANK.items():
        kind = F.when(F.col("kind") == k, rank).otherwise(kind)
    test = paths.is_test_node(F.col("kind"), F.col("file_path")).cast("int")
    hits = nodes.join(found, "id").where("kind <> 'file'").select(*nodes.columns, scores.round_half_up(weight, 6).alias("weight"), covered.alias("covered"), kind.alias("kind_rank"), test.alias("is_test"))
    ordered = hits.orderBy(F.desc("covered"), "is_test", "kind_rank", F.desc("weight"), "id").limit(limit)
    return ordered.withColumn("score", scores.round_half_up(F.col("covered") / len(terms), 6))
