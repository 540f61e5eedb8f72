"""Streaming operators on the events table; as batches they have SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.queries import query
from ..sources.testbed import graph, view, with_sql
from . import changes, stateful


@query("""WITH e AS (SELECT user_id % 3 AS project, event_type AS path, props AS op, ts, event_id FROM events), g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY project, path ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY project, path ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT project, path, count(*) AS events, min(ts) AS began, max(ts) + INTERVAL 30 MINUTE AS quiet_at FROM s GROUP BY project, path, k""")
def debounced_changes(spark, sf_dir):
    events = view(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("project"), F.col("event_type").alias("path"), F.col("props").alias("op"), F.col("ts").cast("timestamp").alias("ts"))
    return changes.debounced(events, "30 minutes").select("project", "path", "events", F.col("began").cast("timestamp_ntz").alias("began"), F.col("quiet_at").cast("timestamp_ntz").alias("quiet_at"))


@query("SELECT event_type AS target, count(*) AS hits, max(ts) AS last_hit_at FROM events GROUP BY event_type")
def usage_counts(spark, sf_dir):
    hits = view(spark, sf_dir, "events").select(F.col("event_type").alias("target"), F.col("ts").cast("timestamp").alias("ts"))
    return changes.usage_counts(hits).withColumn("last_hit_at", F.col("last_hit_at").cast("timestamp_ntz"))


@query("""WITH e AS (SELECT event_type AS project, ts, event_id FROM events), g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 45 SECOND THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY project ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY project ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT project, count(*) AS events, max(ts) + INTERVAL 45 SECOND AS idle_at FROM s GROUP BY project, k""")
def idle_spells(spark, sf_dir):
    events = view(spark, sf_dir, "events").select(F.col("event_type").alias("project"), F.col("ts").cast("timestamp").alias("ts"))
    return changes.idle_projects(events).withColumn("idle_at", F.col("idle_at").cast("timestamp_ntz"))


@query(with_sql("nodes") + " SELECT '1' AS project, 'symbol' AS kind, symbol AS name, id FROM nodes WHERE symbol <> '' UNION SELECT '1', 'fqn', fqn, id FROM nodes WHERE fqn <> ''")
def node_index(spark, sf_dir):
    """What the state of a stream of all files holds."""
    return stateful.node_index_of(stateful.file_changes(graph(spark, sf_dir).nodes, 1))
