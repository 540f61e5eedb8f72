"""Helpers every operator here shares: written intermediates and bounded Arrow blocks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..ship import ship as _ship

__all__ = ["BLOCK_BYTES", "blocks", "drop_written", "ship", "shared_dir", "spare_names", "written"]

#: Bytes of text that one vectorised step holds at a time; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20
#: Bytes of one Arrow batch between Spark and Python; Spark's own default of 64 MB would be held several times over.
BATCH_BYTES = 4 << 20


def _libc():
    """The C library if it can trim its heap."""
    try:
        found = ctypes.CDLL(None)
        return found if hasattr(found, "malloc_trim") else None
    except OSError:
        return None


_LIBC = _libc()
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Give the executors this package, and bound Arrow batches in bytes unless the session has a bound of its own below Spark's."""
    _ship(spark)
    if int(spark.conf.get(_BATCHES).rstrip("b")) >= 64 << 20:
        spark.conf.set(_BATCHES, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own is set only where a local session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there and survives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete a table of :func:`written` that no later plan reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spare_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores more as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches at row borders so that each holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = held = 0
        for row in range(n):
            if row > start and held + sizes[row] > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += int(sizes[row])
        yield batch.slice(start, n - start)
    give_back()


def give_back() -> None:
    """Return what a task no longer holds to the system: its worker waits for other stages, beside the memory of their own."""
    pa.default_memory_pool().release_unused()
    if _LIBC:
        _LIBC.malloc_trim(0)
