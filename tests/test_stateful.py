"""State that outlives batches: the index of names against its batch form, and timers that fire in a quiet stream."""

import json
import time

import pytest
from pyspark.sql import functions as F

from graphloom.streaming import stateful


@pytest.fixture(autouse=True)
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    stateful.use_rocksdb(spark)
    yield
    spark.conf.unset(name)


def run(writer, checkpoint):
    query = writer.trigger(availableNow=True).option("checkpointLocation", str(checkpoint)).start()
    query.awaitTermination(180)


def test_node_index_stream_equals_batch(spark, tmp_path):
    rounds = [
        [("p", "a.go", 1, "write", [1, 2], ["f", "g"], ["m.f", "m.g"]), ("p", "b.go", 1, "write", [3], ["f"], ["n.f"]), ("q", "a.go", 1, "write", [9], ["f"], ["m.f"])],
        # an edit that keeps one node, a second change of a file in one batch, a node without a name
        [("p", "a.go", 2, "write", [2, 4], ["g", "h"], ["m.g", "m.h"]), ("p", "c.go", 2, "write", [5], ["x"], ["c.x"]), ("p", "c.go", 3, "write", [6, 7], ["y", None], ["c.y", ""])],
        # deletions; changes that come again or too late
        [("p", "b.go", 4, "delete", [], [], []), ("p", "a.go", 1, "write", [1, 2], ["f", "g"], ["m.f", "m.g"]), ("p", "c.go", 3, "write", [6, 7], ["y", None], ["c.y", ""])],
        [("p", "b.go", 3, "write", [3], ["f"], ["n.f"]), ("p", "b.go", 5, "write", [8], ["z"], ["n.z"])],
    ]
    given, source, out = None, tmp_path / "in", tmp_path / "out"
    for k, rows in enumerate(rounds):
        df = spark.createDataFrame(rows, stateful.CHANGES)
        given = df if given is None else given.union(df)
        df.coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        # Each round starts the query anew from its checkpoint, as after a failure.
        run(stateful.node_index_changes(stream, parts=4).writeStream.format("parquet").option("path", str(out)).outputMode("append"), tmp_path / "c")
        deltas = spark.read.parquet(str(out))
        got = {tuple(r) for r in stateful.node_index(deltas).collect()}
        assert got == {tuple(r) for r in stateful.node_index_of(given).collect()}, k
    assert ("p", "symbol", "z", 8) in got and not any(name == "f" and p == "p" for p, _, name, _ in got)
    assert deltas.where("file_path = 'a.go' and project = 'p' and name = 'g'").count() == 1  # what stays is not told again


def test_changes_of_a_graph_make_its_index(spark):
    nodes = spark.createDataFrame([(1, 7, "a.go", "f", "m.f"), (2, 7, "a.go", None, "m"), (3, 7, "b.go", "f", "n.f")], "id long, project_id long, file_path string, symbol string, fqn string")
    rows = {tuple(r) for r in stateful.node_index_of(stateful.file_changes(nodes, 1)).collect()}
    assert rows == {("7", "symbol", "f", 1), ("7", "symbol", "f", 3), ("7", "fqn", "m.f", 1), ("7", "fqn", "m", 2), ("7", "fqn", "n.f", 3)}


def test_timers_fire_in_silence_and_are_called_off(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def send(name, *projects):
        (tmp_path / name).write_text("".join(json.dumps({"project": p}) + "\n" for p in projects))
        (tmp_path / name).rename(source / name)

    events = spark.readStream.schema("project string").json(str(source))
    fired = []
    began = time.time()

    def note(df, _):
        fired.extend((r.project, r.events, time.time() - began, r.idle_at.timestamp()) for r in df.withColumn("idle_at", F.col("idle_at").cast("timestamp")).collect())

    writer = stateful.idle_timers(events, idle_ms=6000).writeStream.foreachBatch(note).outputMode("append")
    query = writer.trigger(processingTime="500 milliseconds").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        send("1.json", "p", "p", "q")
        waited = time.time()
        while not query.recentProgress or not any(p["numInputRows"] for p in query.recentProgress):
            assert time.time() - waited < 90
            time.sleep(0.2)
        time.sleep(2)
        again = time.time() - began
        send("2.json", "q")  # calls off q's timer; p hears nothing ever again
        while len(fired) < 2 and time.time() - began < 120:
            time.sleep(0.3)
    finally:
        query.stop()
    by = {f[0]: f for f in fired}
    assert len(fired) == 2 and by["p"][1] == 2 and by["q"][1] == 2
    assert by["q"][3] > by["p"][3] and by["q"][2] >= again + 5.5
