"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own is set only where a local session names none."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: lineage ends there, a lost executor costs nothing earlier,
    and later joins know its true size. The table goes with :func:`release`, else when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, where = _file_system(spark, path)
    fs.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`cut` that no later plan reads."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            folder = file.rsplit("/", 1)[0]
            if folder.rsplit("/", 1)[1].startswith("cut-"):
                fs, where = _file_system(df.sparkSession, folder)
                fs.delete(where, True)
