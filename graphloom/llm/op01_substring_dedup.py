"""Removal of long repeated substrings, exact to the byte.

1. Every window of LENGTH bytes is assigned the smallest hash of its GRAM-byte substrings (its anchor); runs of windows
   with one anchor are segments, cut at MAX_RUN windows. Equal windows have equal anchors, so anchors that occur
   once in the corpus hold no repeats and go.
2. Equal segments are counted, not compared: all windows of a segment that occurs twice are repeats, and only one
   occurrence of it goes on.
3. The distinct segments of an anchor meet in one batch, whose Burrows-Wheeler transform is expanded up to LENGTH; windows at
   borders it never reaches share their first LENGTH bytes with another. Batches hold whole anchors and are bounded.
4. An anchor with more than MAX_TOGETHER distinct segments (a passage in very many contexts) would not stay bounded. Its
   windows are counted by a 64-bit hash beside the anchor's, summed per task before they are shuffled.
5. Flags go back to every occurrence, and each text is cut once, by all bytes its flagged windows cover.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bwt import repeated_starts
from .runtime import blocks, drop_written, ship, written
from .textops import U, flat, span_hashes

LENGTH = 400
GRAM = 64
MAX_RUN = 4096
MAX_TOGETHER = 1000
#: Bytes of segments in one transform; a batch is closed at the first anchor border beyond it.
BATCH_BYTES = 1 << 19
ANCHOR_BLOCK = 1 << 20
#: What stands for a missing doc_id; a row that has it is told apart by its text.
NO_ID = -(1 << 62)

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _extreme(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over x[i : i + width] for each i that has so many, by doubling."""
    span = 1
    while span * 2 <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def segments(buf: np.ndarray, at: np.ndarray, length: int, gram: int, max_run: int):
    """Anchor, document, first window, windows, anchor occurrences and content hash of each segment."""
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(buf) < length:
        return none
    width = length - gram + 1
    grams = np.arange(len(buf) - gram + 1)
    h = span_hashes(buf, grams, grams + gram)
    anchor = _extreme(h, width, np.minimum)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(anchor)]
    inside = np.arange(len(anchor)) + length <= at[doc + 1]
    start = np.flatnonzero(inside)
    if not len(start):
        return none
    # A gram is an anchor occurrence if it is the smallest of some window, here of one that may cross texts too: a superset.
    most = _extreme(np.concatenate([np.zeros(width - 1, U), anchor, np.zeros(width - 1, U)]), width, np.maximum)
    occurs = np.flatnonzero(most[: len(h)] == h)
    new = np.concatenate([[True], (start[1:] != start[:-1] + 1) | (anchor[start[1:]] != anchor[start[:-1]]) | (doc[start[1:]] != doc[start[:-1]])])
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate([first, [len(start)]]))
    pieces = -(-size // max_run)
    part = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(start[first], pieces) + part * max_run
    count = np.minimum(max_run, np.repeat(size, pieces) - part * max_run)
    key = anchor[begin]
    a, b = np.searchsorted(occurs, begin), np.searchsorted(occurs, begin + count + width - 1)
    owner = np.repeat(np.arange(len(begin)), b - a)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
    occ = np.bincount(owner[h[occurs[inner]] == key[owner]], minlength=len(begin))
    content = span_hashes(buf, begin, begin + count + length - 1)
    return key.view(np.int64), doc[begin], begin - at[doc[begin]], count, occ, content.view(np.int64)


SEGMENTS = "anchor long, doc_id long, body long, start long, n long, occ long, content long"
IDENTITY = ["anchor", "n", "content"]


def _segment_rows(docs: DataFrame, length: int, gram: int, max_run: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=ANCHOR_BLOCK):
            buf, at = flat(block.column("text"))
            anchor, doc, start, n, occ, content = segments(buf, at, length, gram, max_run)
            own = pa.array(doc)
            columns = [pa.array(anchor), block.column("doc_id").take(own), block.column("body").take(own), *(pa.array(x.astype(np.int64)) for x in (start, n, occ, content))]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "doc_id", "body", "start", "n", "occ", "content"])

    return docs.mapInArrow(run, SEGMENTS)


def _segment_bytes(docs: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """(anchor, n, content, crowded, bytes) of the segments in ``chosen``, cut from their representatives' texts."""
    per_doc = chosen.groupBy("doc_id", "body").agg(F.collect_list(F.struct("anchor", "n", "content", "start", "crowded")).alias("cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            rows = []
            for text, cuts in zip(block.column("text").to_pylist(), block.column("cuts").to_pylist(), strict=True):
                raw = text.encode()
                rows += [(c["anchor"], c["n"], c["content"], c["crowded"], raw[c["start"] : c["start"] + c["n"] + length - 1]) for c in cuts]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["anchor", "n", "content", "crowded", "bytes"])

    # One of repeated rows is enough.
    return docs.join(per_doc, ["doc_id", "body"]).select("text", "cuts").mapInArrow(run, "anchor long, n long, content long, crowded boolean, bytes binary")


def _runs(starts: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last of each run of consecutive numbers."""
    if not len(starts):
        return [], []
    cut = np.flatnonzero(np.diff(starts) != 1)
    return starts[np.concatenate([[0], cut + 1])].tolist(), starts[np.concatenate([cut, [len(starts) - 1]])].tolist()


FLAGS = "anchor long, n long, content long, low array<long>, high array<long>"


def _expanded(together: DataFrame, length: int, batch_bytes: int) -> DataFrame:
    """FLAGS of the segments with repeated windows, by the transform of batches of whole anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[tuple]) -> pa.RecordBatch:
            rows = []
            for (anchor, n, content, _), starts in zip(held, repeated_starts([h[3] for h in held], length), strict=True):
                if len(starts):
                    rows.append((anchor, n, content, *_runs(starts)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (*[pa.int64()] * 3, *[pa.list_(pa.int64())] * 2)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["anchor", "n", "content", "low", "high"])

        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("anchor", "n", "content", "bytes")), strict=True):
                if size >= batch_bytes and row[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                if held and row[:3] == held[-1][:3]:
                    continue  # a representative that stands in repeated rows
                held.append(row)
                size += len(row[3])
        if held:
            yield flush(held)

    # A fixed number of partitions: by bytes alone Spark would merge them, though a byte costs about a microsecond here.
    parts = int(together.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = together.select("anchor", "n", "content", "bytes").repartition(parts, "anchor").sortWithinPartitions("anchor", "n", "content")
    return ordered.mapInArrow(run, FLAGS)


def _counted(crowded: DataFrame, length: int) -> DataFrame:
    """FLAGS of the segments of crowded anchors, by counts of their windows' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("bytes").to_pylist()
            for i, text in enumerate(raw):
                buf = np.frombuffer(text, np.uint8)
                at = np.arange(len(buf) - length + 1)
                own = pa.array(np.full(len(at), i))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(own) for k in ("anchor", "n", "content")), pa.array(at), pa.array(span_hashes(buf, at, at + length).view(np.int64))], ["anchor", "n", "content", "offset", "window"])

    distinct = crowded.select("anchor", "n", "content", "bytes")
    windows = written(distinct.mapInArrow(run, "anchor long, n long, content long, offset long, window long"))
    twice = written(windows.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("anchor", "window"))
    flagged = windows.join(twice, ["anchor", "window"]).groupBy("anchor", "n", "content").agg(F.collect_list("offset").alias("low"))
    return flagged.select("anchor", "n", "content", "low", F.col("low").alias("high"))


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, max_run: int = MAX_RUN, max_together: int = MAX_TOGETHER, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, body, low, high): runs of starts of repeated windows, of ``docs`` (doc_id, body, text); body tells apart
    rows that repeat a doc_id with another text."""
    found = written(_segment_rows(docs, length, gram, max_run))
    often = written(found.groupBy("anchor").agg(F.sum("occ").alias("k")).where("k > 1").select("anchor"))
    rows = written(found.join(often, "anchor"))
    drop_written(found)
    drop_written(often)
    distinct = rows.groupBy(*IDENTITY).agg(F.count(F.lit(1)).alias("k"), F.max("occ").alias("occ"), F.min(F.struct("doc_id", "body", "start")).alias("one"))
    distinct = written(distinct.select(*IDENTITY, "k", "occ", "one.*"))
    per_anchor = written(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.max("occ").alias("most")).where("kinds > 1 or most > 1"))
    chosen = distinct.select(*IDENTITY, "doc_id", "body", "start").join(per_anchor, "anchor").withColumn("crowded", F.col("kinds") > max_together)
    texts = written(_segment_bytes(docs, chosen, length))
    flags = written(_expanded(texts.where("not crowded"), length, batch_bytes).union(_counted(texts.where("crowded").dropDuplicates(IDENTITY), length)))
    drop_written(texts)
    # A segment that occurs more than once is repeated whole.
    whole = distinct.where("k > 1").selectExpr(*IDENTITY, "array(0L) low", "array(n - 1) high")
    once = distinct.where("k = 1").select(*IDENTITY).join(flags, IDENTITY)
    marks = written(whole.unionByName(once))
    for table in (distinct, per_anchor, flags):
        drop_written(table)
    return rows.select(*IDENTITY, "doc_id", "body", "start").join(marks, IDENTITY).selectExpr("doc_id", "body", "transform(low, x -> x + start) low", "transform(high, x -> x + start) high")


def covered(low: np.ndarray, high: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by windows of ``length`` that start in the runs."""
    order = np.argsort(low, kind="stable")
    out: list[list[int]] = []
    for a, b in zip(low[order].tolist(), (high[order] + length).tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False, **options) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text), as in SCHEMA; ``with_text`` adds ``text``, what remains,
    without the parts of characters that were cut.

    Every byte goes that a string of ``length`` bytes covers which starts anywhere else as well, in the same text or another, as
    judged on the texts as they came. Null texts count as empty. Repeated rows are texts of their own, and so repeats of
    each other. Rows without doc_id, or with one that is no number, are texts like others and come back without one. An empty table
    gives no rows; other columns are ignored.
    """
    ship(docs.sparkSession)
    # A text is known by doc_id and body; texts without doc_id share one, and of equal texts any may stand for all.
    texts = docs.selectExpr("cast(doc_id as long) own_id", f"coalesce(cast(doc_id as long), {NO_ID}) doc_id", "xxhash64(text) body", "coalesce(text, '') text")
    marks = repeated_windows(texts.where(f"octet_length(text) >= {length}").select("doc_id", "body", "text"), length, **options)
    # A set, so that rows of equal texts, however many, meet once a task.
    per_doc = marks.groupBy("doc_id", "body").agg(F.collect_set(F.struct("low", "high")).alias("runs"))
    per_doc = written(per_doc.select("doc_id", "body", F.flatten("runs.low").alias("low"), F.flatten("runs.high").alias("high")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            rows = []
            for text, low, high in zip(*(block.column(k).to_pylist() for k in ("text", "low", "high")), strict=True):
                raw = text.encode()
                spans = covered(np.array(low), np.array(high), length) if low else []
                parts, last = [], 0
                for a, b in spans:
                    parts.append(raw[last:a])
                    last = b
                kept = b"".join([*parts, raw[last:]])
                rows.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if spans else text))
            n_bytes, n_removed, n_spans, sums, left = zip(*rows, strict=True)
            columns = [block.column("own_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sums)]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(left, pa.string())] if with_text else []), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["text"] * with_text])

    joined = texts.join(per_doc, ["doc_id", "body"], "left").select("own_id", "text", "low", "high")
    return joined.mapInArrow(run, SCHEMA + ", text string" * with_text)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=True)
