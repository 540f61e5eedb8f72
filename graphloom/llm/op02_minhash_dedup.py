"""Near duplicates by DartMinHash signatures, banded joins and exact verification.

1. Texts with equal shingle sets form one class at once; only its smallest doc_id goes on.
2. Each class has a complete DartMinHash signature, cut into bands; classes that share a band share a bucket.
3. Every class is compared, exactly and on its whole shingle set, with the smallest class it shares a bucket with, and
   with the smallest it shares each longer run of bands with (up to DEEPEST): the longer the run, the closer the two. That is a
   few comparisons a class, and joins most of even a large group whose copies have drifted apart.
4. Buckets that still hold several components go through rounds: leaders of each bucket, drawn by hash, are compared
   with its members of other components. A round has four times the leaders of the one before, and rounds end
   when each bucket holds one component or all its members have led. So every pair that shares a bucket and lies in
   different components is compared, no bucket is capped, and only pairs are emitted and verified that two bounds leave
   possible: the agreement of their sketches (4 bits of each coordinate), and the bits by which hashed bitmaps of their
   sets differ, of which each is a shingle that only one of the two has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .dartminhash import signatures
from .runtime import blocks, drop_written, ship, written
from .textops import U, mix, shingle_sets

SHINGLE = 5
SIMILARITY = 0.8
COORDINATES, BAND = 96, 4
#: Bands of the longest runs by which a class finds a close one.
DEEPEST = 4
#: Leaders of a bucket in the first round, about; each round has GROWTH times as many.
LEADERS, GROWTH = 16, 4
SKETCH = COORDINATES // 16
#: Words of 64 bits in a bitmap of a set.
BITMAP = 16
#: Standard deviations below its mean at which the sketch agreement of a link is taken to be impossible (3 in a million).
SURE = 4.5


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, f1, f2, bands, sketch) of each row: a 128-bit fingerprint of its shingle set, its band keys and its sketch."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            n = block.num_rows
            column, ids = block.column("text"), block.column("doc_id").to_pylist()
            owner, h, _ = shingle_sets(column, SHINGLE)
            size = np.bincount(owner, minlength=n)
            at = np.concatenate([[0], np.cumsum(size)])
            some = np.flatnonzero(size)
            f = np.zeros((2, n), U)
            if len(some):
                for k in range(2):
                    f[k, some] = np.add.reduceat(mix(h + U(k + 1)), at[:-1][some])
            sig = signatures(owner, h, np.ones(len(h)), n, COORDINATES)
            nibbles = (sig.reshape(n, SKETCH, 16) & U(15)) << (U(4) * np.arange(16, dtype=U))
            sketch = np.bitwise_or.reduce(nibbles, axis=2).view(np.int64)
            sig = sig.reshape(n, -1, BAND)
            bands = np.zeros(sig.shape[:2], U)
            for k in range(BAND):
                bands = mix(bands + sig[:, :, k])
            bands = mix(bands + np.arange(bands.shape[1], dtype=U)).view(np.int64)
            f = f.view(np.int64)
            for i in np.flatnonzero(size == 0):
                text = column[int(i)].as_py()
                if text is None:
                    f[:, i] = ids[i] if ids[i] is not None else 0, np.iinfo(np.int64).min
                else:
                    d = xxhash.xxh3_128_intdigest(text.encode())
                    f[:, i] = np.array([d >> 64, d & (1 << 64) - 1], U).view(np.int64)
            full = np.where(size > 0, bands.shape[1], 0)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(full)]).astype(np.int32), pa.array(bands[some].reshape(-1)))
            sketches = pa.ListArray.from_arrays((np.arange(n + 1) * SKETCH).astype(np.int32), pa.array(sketch.reshape(-1)))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(f[0]), pa.array(f[1]), lists, sketches], ["doc_id", "f1", "f2", "bands", "sketch"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, f1 long, f2 long, bands array<long>, sketch array<long>")


def shingle_table(docs: DataFrame) -> DataFrame:
    """(id, shingles, size, bits): the sorted distinct 64-bit shingle hashes of each row as bytes, how many, and their bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            owner, h, _ = shingle_sets(block.column("text"), SHINGLE)
            at = np.searchsorted(owner, np.arange(block.num_rows + 1))
            sets = [h[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            bits = np.zeros((block.num_rows, BITMAP), U)
            place = h >> U(54)
            np.bitwise_or.at(bits, (owner, (place >> U(6)).astype(np.int64)), U(1) << (place & U(63)))
            lists = pa.ListArray.from_arrays((np.arange(block.num_rows + 1) * BITMAP).astype(np.int32), pa.array(bits.view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(sets, pa.binary()), pa.array(np.diff(at).astype(np.int64)), lists], ["id", "shingles", "size", "bits"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "id long, shingles binary, size long, bits array<long>")


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, U), np.frombuffer(b, U)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least that Jaccard similarity."""
    bound = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            # Sizes alone rule out most pairs that are far apart.
            ok = [min(len(p), len(q)) >= bound * max(len(p), len(q)) and jaccard(p, q) >= bound for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([pc.filter(batch.column(k), pa.array(ok, pa.bool_())) for k in ("a", "b")], ["a", "b"])

    sets = sets.select("id", "shingles")
    left = sets.selectExpr("id a", "shingles x")
    right = sets.selectExpr("id b", "shingles y")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def possible(similarity: float) -> Column:
    """Whether the sketches and bitmaps of the rows ``x`` and ``y`` leave a link possible.

    A bit that only one bitmap has stands for a shingle that only one set has, so the second bound loses nothing: at a
    similarity t, two sets of s elements in sum differ in at most s (1 - t) / (1 + t).
    """
    p = similarity + (1 - similarity) / 16
    least = int(COORDINATES * p - SURE * (COORDINATES * p * (1 - p)) ** 0.5)
    different = F.lit(0)
    for k in range(SKETCH):
        b = F.col(f"x.s{k}").bitwiseXOR(F.col(f"y.s{k}"))
        b = b.bitwiseOR(F.shiftrightunsigned(b, 1))
        b = b.bitwiseOR(F.shiftrightunsigned(b, 2))
        different = different + F.bit_count(b.bitwiseAND(F.lit(0x1111111111111111)))
    apart = F.lit(0)
    for k in range(BITMAP):
        apart = apart + F.bit_count(F.col("x.bits")[k].bitwiseXOR(F.col("y.bits")[k]))
    most = (F.col("x.size") + F.col("y.size")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    return (different <= COORDINATES - least) & (apart <= most)


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, is_kept) of each row of ``docs`` (doc_id, text).

    A class is a connected component of the links between texts whose sets of five-word shingles (lower-cased
    runs of letters, digits, underscore and characters beyond ASCII) have a Jaccard similarity of ``similarity`` or
    more; class_id is its smallest doc_id. All shingles weigh 1. Shorter texts have one shingle of all their words;
    texts without words are one class if equal byte for byte. A null text stands alone. Rows that repeat a doc_id
    are of one class, rows without doc_id are kept. An empty table gives no rows; other columns are ignored. Two linked texts share a bucket
    with probability 1 - (1 - s ** 4) ** 24: 0.999997 at s = 0.8.
    """
    ship(docs.sparkSession)
    fp = written(fingerprints(docs))
    # min(struct) keeps the bands of one of the equal sets; it is summed per task first, so a hot text is a row a task.
    sets_of = fp.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "bands", "sketch")).alias("one"))
    groups = written(sets_of.select("f1", "f2", "rep", F.col("one.bands").alias("bands"), *(F.col("one.sketch")[k].alias(f"s{k}") for k in range(SKETCH))))
    banded = groups.select("rep", F.explode("bands").alias("band"))
    leaders = written(banded.groupBy("band").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead < last").select("band", "lead"))
    buckets = written(banded.join(leaders, "band").select("band", "rep", "lead"))
    needed = buckets.select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "text").where("text is not null").join(needed, "doc_id", "left_semi")
    sets = written(shingle_table(texts))
    n = COORDINATES // BAND
    crowd = groups.select("rep", "bands").join(needed.withColumnRenamed("doc_id", "rep"), "rep", "left_semi")
    runs = [F.struct(F.lit(k).alias("k"), F.xxhash64(*(F.col("bands")[(j + i) % n] for i in range(k))).alias("run")) for k in range(2, DEEPEST + 1) for j in range(n)]
    deeper = written(crowd.select("rep", F.inline(F.array(*runs))))
    least = written(deeper.groupBy("k", "run").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead < last").select("k", "run", "lead"))
    closest = deeper.join(least, ["k", "run"]).groupBy("rep", "k").agg(F.min("lead").alias("lead")).select("rep", "lead")
    first = buckets.groupBy("rep").agg(F.min("lead").alias("lead")).unionByName(closest).where("rep <> lead").distinct()
    links = written(verified(first.selectExpr("rep a", "lead b"), sets, similarity))
    labels = connected_components(links)

    # u places a class among the leaders of every bucket it is in, the same way in all.
    u = (F.pmod(F.xxhash64("rep"), F.lit(1 << 40)) / float(1 << 40)).alias("u")
    alive = written(buckets.select("band", "rep").join(groups.select("rep", u, *(f"s{k}" for k in range(SKETCH))), "rep").join(sets.selectExpr("id rep", "size", "bits"), "rep"))
    old: list[DataFrame] = []
    done, wide = 0, LEADERS
    while True:
        marked = written(alive.join(labels.selectExpr("id rep", "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep")))
        drop_written(alive)
        counts = marked.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"))
        open_buckets = written(counts.where(F.col("low") < F.col("high")).where(F.col("n") > done).select("band", "n"))
        if open_buckets.limit(1).count() == 0:
            break
        members = written(marked.join(open_buckets, "band"))
        leads = members.where((F.col("u") * F.col("n") >= done) & (F.col("u") * F.col("n") < done + wide))
        apart = (F.col("x.band") == F.col("y.band")) & (F.col("x.label") != F.col("y.label")) & (F.struct("x.u", "x.rep") < F.struct("y.u", "y.rep"))
        pairs = leads.alias("x").join(members.alias("y"), apart & possible(similarity)).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
        new = written(verified(pairs.groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b"), sets, similarity))
        done, wide = done + wide, wide * GROWTH
        alive = members.drop("label", "n")
        old.append(links)
        links = written(links.union(new))
        if new.limit(1).count():
            labels = connected_components(links)
        drop_written(marked)
        drop_written(open_buckets)
    for table in (*old, leaders, deeper, least, sets):
        drop_written(table)

    of_group = groups.select("f1", "f2", "rep").join(labels.selectExpr("id rep", "label"), "rep", "left").selectExpr("f1", "f2", "coalesce(label, rep) label")
    of_group = written(of_group)
    out = fp.select("doc_id", "f1", "f2").join(of_group, ["f1", "f2"]).selectExpr("doc_id", "label class_id", "coalesce(doc_id = label, true) is_kept")
    return out


def kept_ids(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The doc_id of the document that stays of each class."""
    return near_duplicate_classes(docs, similarity).where("is_kept").select("doc_id")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
