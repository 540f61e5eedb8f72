"""Change feeds: last operation per path after a quiet time, usage counters, and merging batches into a manifest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def debounced(events: DataFrame, quiet: str = "500 milliseconds", late: str = "1 minute", key: str = "project", path: str = "path", op: str = "op", ts: str = "ts") -> DataFrame:
    """One row per project, path and burst: the last operation, and when the burst began and fell quiet.

    A burst is a session of events with gaps below ``quiet``. In a stream, events later than ``late`` are dropped; a burst
    comes out once the watermark passes its end. Works on batches as well.
    """
    seen = events.withWatermark(ts, late) if events.isStreaming else events
    burst = F.session_window(ts, quiet)
    out = seen.groupBy(key, path, burst).agg(F.max_by(op, ts).alias("op"), F.count(F.lit(1)).alias("events"))
    return out.select(key, path, "op", "events", F.col("session_window.start").alias("began"), F.col("session_window.end").alias("quiet_at"))


def usage_counts(hits: DataFrame, late: str = "1 minute", target: str = "target", ts: str = "ts") -> DataFrame:
    """Running hits and last hit per target; update mode in a stream."""
    seen = hits.withWatermark(ts, late) if hits.isStreaming else hits
    return seen.groupBy(target).agg(F.count(F.lit(1)).alias("hits"), F.max(ts).alias("last_hit_at"))


def merged_manifest(manifest: DataFrame, batch: DataFrame) -> DataFrame:
    """The manifest (file_path, file_hash) after a batch of (path, op, file_hash): deletes go, others replace or add."""
    last = batch.select(F.col("path").alias("file_path"), "op", F.col("file_hash").alias("new_hash"))
    both = manifest.join(last, "file_path", "full")
    return both.where("op is null or op <> 'delete'").select("file_path", F.coalesce("new_hash", "file_hash").alias("file_hash"))


def apply_batches(bursts: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, min_files: int = 1) -> DataStreamWriter:
    """A writer that hands each batch of at least ``min_files`` paths to ``apply``, one batch at a time, so there is a single writer.

    A batch may come again after a failure; ``apply`` gets its number to make the write idempotent.
    """

    def each(batch: DataFrame, number: int) -> None:
        if batch.select("path").distinct().limit(min_files).count() >= min_files:
            apply(batch, number)

    return bursts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("append")


def idle_projects(events: DataFrame, idle: str = "45 seconds", late: str = "1 minute", key: str = "project", ts: str = "ts") -> DataFrame:
    """(project, events, idle_at): when a project has had no event for ``idle``, so that slow exact resolution is due.

    A later event begins a new spell, which is how it calls a pending one off.
    """
    seen = events.withWatermark(ts, late) if events.isStreaming else events
    spell = F.session_window(ts, idle)
    return seen.groupBy(key, spell).agg(F.count(F.lit(1)).alias("events")).select(key, "events", F.col("session_window.end").alias("idle_at"))
