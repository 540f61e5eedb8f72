"""A quality classifier from weak labels.

Heuristic labellers vote on every document; expectation maximisation over the counts of vote patterns estimates
their accuracies; the posteriors are soft labels for a linear scorer on hashed byte trigrams and bucketed
shape features. The scorer is fitted on a bounded sample (TRAIN_ROWS rows, by hash of doc_id): each of a few
partitions runs stochastic gradient descent on its share and the weights are averaged. Every row is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .op10_quality_rules import class_posteriors, estimate, features, rules, text_features
from .runtime import blocks, ship, written
from .textops import U, flat, mix

DIMENSIONS = 1 << 14
TRAIN_ROWS = 20_000
#: Rows of one training partition.
SHARE_ROWS = 5_000
EPOCHS, RATE, DECAY = 6, 0.5, 1e-5
GOOD_FROM = 0.5
#: Fewer words are a bad sign to the length labeller; short texts that are fine else must pass.
MIN_WORDS = 5
#: Weight of one shape feature beside the unit-length trigram vector.
SHAPE = 0.3


def labelled(docs: DataFrame) -> tuple[DataFrame, list[tuple[str, float, float]]]:
    """(doc_id, posterior) of each row, and (labeller, P(bad vote | good), P(bad vote | junk)) as estimated, both of the votes it gives."""
    named = rules(MIN_WORDS)
    table = written(features(docs).select("doc_id", *(v.cast("int").alias(k) for k, v in named.items())))
    counts = table.groupBy(*named).count().collect()  # at most 3 ** labellers rows
    patterns = sorted((tuple(r[v] for v in named), r["count"]) for r in counts)
    prior, bad = estimate(patterns, len(named))
    seen = np.array([k for k, _ in patterns], int).reshape(-1, len(named))
    good = class_posteriors(seen, prior, bad)[:, 0]
    rows = [(*map(int, k), float(g)) for k, g in zip(seen, good, strict=True)]
    known = docs.sparkSession.createDataFrame(rows, ", ".join(f"{v} int" for v in named) + ", posterior double")
    return table.join(F.broadcast(known), list(named)).select("doc_id", "posterior"), [(k, float(bad[r, 0]), float(1 - prior[1:] @ (1 - bad[r, 1:]) / prior[1:].sum())) for r, k in enumerate(named)]


def vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and values of each text: log counts of byte trigrams scaled to length 1, and SHAPE per shape feature."""
    buf, at = flat(column)
    b = buf.astype(np.uint32)
    h = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1) if len(b) > 2 else np.zeros(0, np.uint32)
    bucket = (h ^ (h >> np.uint32(15))) >> np.uint32(18)
    f = text_features(column)
    per = lambda a, b: np.floor(10 * f[a] / np.maximum(1, f[b])).clip(0, 20)
    shapes = np.stack([np.log2(1 + f["n_words"]).astype(int), per("n_repeat_words", "n_words"), per("n_dup_lines", "n_lines"), per("n_upper", "n_letters"), per("n_symbols", "n_words"), per("word_chars", "n_words"), per("n_letters", "n_chars"), per("n_digits", "n_chars")]).astype(U)
    shape_bucket = mix(shapes + (np.arange(len(shapes), dtype=U)[:, None] + U(1) << U(32))) % U(DIMENSIONS)
    for i in range(len(column)):
        counts = np.bincount(bucket[at[i] : max(at[i], at[i + 1] - 2)], minlength=DIMENSIONS)
        some = np.flatnonzero(counts)
        value = np.log1p(counts[some])
        norm = np.sqrt((value * value).sum()) or 1.0
        yield np.concatenate([some, shape_bucket[:, i].astype(np.int64)]), np.concatenate([value / norm, np.full(len(shapes), SHAPE)])


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights (the last is the bias) from at most about ``train_rows`` of the rows of ``docs`` and their posteriors."""
    n = labels.count()
    if not n:
        return np.zeros(DIMENSIONS + 1)
    some = F.shiftrightunsigned(F.xxhash64("doc_id"), 1) <= F.lit(min((1 << 63) - 1, (train_rows << 63) // n))
    shares = max(1, min(n, train_rows) // SHARE_ROWS)
    sample = docs.selectExpr("cast(doc_id as long) doc_id", "text").where(some).join(labels.where(some).dropDuplicates(["doc_id"]), "doc_id")
    sample = sample.select("doc_id", "text", "posterior").repartition(shares, "doc_id").sortWithinPartitions(F.xxhash64("doc_id", F.lit(1)), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, target = [], []
        for block in blocks(batches):
            rows += vectors(pc.fill_null(block.column("text"), ""))
            target += block.column("posterior").to_pylist()
        w, bias, step = np.zeros(DIMENSIONS), 0.0, 0
        for epoch in range(EPOCHS):
            for k in np.random.default_rng(epoch).permutation(len(rows)):
                at, value = rows[k]
                guess = 1 / (1 + np.exp(-np.clip(w[at] @ value + bias, -30, 30)))
                rate = RATE / (1 + 1e-4 * step)
                w[at] += rate * ((target[k] - guess) * value - DECAY * w[at])
                bias += 0.1 * rate * (target[k] - guess)
                step += 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64()), pa.array([[*w.tolist(), bias]])], ["n", "w"])

    found = sample.mapInArrow(run, "n long, w array<double>").collect()  # a few weight vectors
    total = sum(r["n"] for r in found)
    return sum(np.array(r["w"]) * r["n"] for r in found) / total if total else np.zeros(DIMENSIONS + 1)


def quality_scores(docs: DataFrame, weights: np.ndarray, good_from: float = GOOD_FROM) -> DataFrame:
    """(doc_id, score, is_good) of each row of ``docs`` (doc_id, text).

    The score is the probability of good quality. Null and empty texts score by their shape alone, as does every text
    if nothing could be learned (0.5 then). Repeated rows are scored each; an empty table gives no rows; other
    columns are ignored. Texts are read whole. There is no shuffle.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # DIMENSIONS + 1 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = shared.value[:-1], shared.value[-1]
        for block in blocks(batches):
            raw = np.array([w[at] @ value for at, value in vectors(pc.fill_null(block.column("text"), ""))]) + bias
            score = 1 / (1 + np.exp(-np.clip(raw, -500, 500)))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(score), pa.array(score >= good_from)], ["doc_id", "score", "is_good"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, score double, is_good boolean")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    posteriors, _ = labelled(docs)
    return quality_scores(docs, fit(docs, posteriors))
