"""Keyed state with ``transformWithState``: an index of nodes that follows files, and timers of processing time that are called off.

Both need the RocksDB state store (:func:`use_rocksdb`), which keeps state on executors and its changes in the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Parts of a project, so that a large one is kept by many tasks.
PARTS = 64
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: A file as it is now, or that it is gone (op 'delete'); seq orders the changes of a file.
CHANGES = "project string, file_path string, seq long, op string, ids array<long>, symbols array<string>, fqns array<string>"
#: A row of the index of names that comes or goes.
DELTAS = "project string, file_path string, kind string, name string, id long, change int"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def file_changes(nodes: DataFrame, seq: int, op: str = "write") -> DataFrame:
    """CHANGES of all files of ``nodes`` (project_id, file_path, id, symbol, fqn)."""
    entry = F.struct("id", "symbol", "fqn")
    grouped = nodes.groupBy(F.col("project_id").cast("string").alias("project"), "file_path").agg(F.array_sort(F.collect_list(entry)).alias("n"))
    return grouped.select("project", "file_path", F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"), F.col("n.id").alias("ids"), F.col("n.symbol").alias("symbols"), F.col("n.fqn").alias("fqns"))


def _entries(ids, symbols, fqns) -> set[tuple[str, str, int]]:
    """Names a file gives its nodes: (kind, name, id); nodes without a name have none."""
    named = [*(("symbol", s, int(i)) for i, s in zip(ids, symbols, strict=True) if s), *(("fqn", f, int(i)) for i, f in zip(ids, fqns, strict=True) if f)]
    return set(named)


class NodeIndex(StatefulProcessor):
    """Map state from file to its nodes; a change of a file emits only what it adds to and takes from the index of names."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.files = handle.getMapState("files", "file_path string", "seq long, ids array<long>, symbols array<string>, fqns array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changes = pd.concat(list(rows))
        out = []
        # Of several changes of a file the last one counts; one that is not later than what is held is a repeat.
        for row in changes.sort_values("seq").drop_duplicates("file_path", keep="last").itertuples():
            held = self.files.getValue((row.file_path,)) if self.files.containsKey((row.file_path,)) else None
            if held is not None and held[0] >= row.seq:
                continue
            before = _entries(*held[1:]) if held is not None else set()
            gone = row.op == "delete"
            after = set() if gone else _entries(row.ids, row.symbols, row.fqns)
            now = ([], [], []) if gone else ([int(i) for i in row.ids], list(row.symbols), list(row.fqns))
            # A deleted file stays with its seq, so that an older change of it that comes late is known.
            self.files.updateValue((row.file_path,), (int(row.seq), *now))
            out += [(key[0], row.file_path, *e, -1) for e in sorted(before - after)] + [(key[0], row.file_path, *e, 1) for e in sorted(after - before)]
        yield pd.DataFrame(out, columns=["project", "file_path", "kind", "name", "id", "change"]).astype({"id": "int64", "change": "int32"})

    def close(self) -> None:
        pass


def node_index_changes(changes: DataFrame, parts: int = PARTS) -> DataFrame:
    """The stream of DELTAS of a stream of CHANGES."""
    keyed = changes.withColumn("part", F.pmod(F.xxhash64("file_path"), F.lit(parts)).cast("int"))
    return keyed.groupBy("project", "part").transformWithStateInPandas(statefulProcessor=NodeIndex(), outputStructType=DELTAS, outputMode="Append", timeMode="None")


def node_index(deltas: DataFrame) -> DataFrame:
    """(project, kind, name, id) that stand after all ``deltas``."""
    return deltas.groupBy("project", "file_path", "kind", "name", "id").agg(F.sum("change").alias("n")).where("n > 0").select("project", "kind", "name", "id").distinct()


def node_index_of(changes: DataFrame) -> DataFrame:
    """The same from all CHANGES at once."""
    last = changes.groupBy("project", "file_path").agg(F.max_by(F.struct("op", "ids", "symbols", "fqns"), "seq").alias("c")).where("c.op <> 'delete'").select("project", "c.*")
    each = lambda kind, names: last.select("project", F.lit(kind).alias("kind"), F.explode(F.arrays_zip(F.col(names).alias("name"), F.col("ids").alias("id"))).alias("e")).select("project", "kind", "e.name", "e.id")
    return each("symbol", "symbols").unionByName(each("fqn", "fqns")).where("coalesce(name, '') <> ''").distinct()


#: A project that fell quiet: how many events its spell had, and when its timer was due.
IDLE = "project string, events long, idle_at timestamp"


class IdleTimer(StatefulProcessor):
    """One timer of processing time per project; each batch with events of it calls the pending one off and sets a new one."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spell = handle.getValueState("spell", "events long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = sum(len(r) for r in rows) + (self.spell.get()[0] if self.spell.exists() else 0)
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        self.spell.update((int(events),))
        yield self._rows([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        events = self.spell.get()[0]
        self.spell.clear()
        yield self._rows([(key[0], events, pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms"))])

    @staticmethod
    def _rows(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["project", "events", "idle_at"]).astype({"events": "int64", "idle_at": "datetime64[ns]"})

    def close(self) -> None:
        pass


def idle_timers(events: DataFrame, idle_ms: int = 45_000, key: str = "project") -> DataFrame:
    """IDLE rows of a stream of events: a project is quiet once no event of it has come for ``idle_ms``, though none ever comes again."""
    return events.select(F.col(key).cast("string").alias("project")).groupBy("project").transformWithStateInPandas(statefulProcessor=IdleTimer(idle_ms), outputStructType=IDLE, outputMode="Append", timeMode="ProcessingTime")
