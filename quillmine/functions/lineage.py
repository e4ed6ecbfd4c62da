"""Cutting the lineage of what a loop builds up, and folders for such tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which executors share; only in local mode,
    and where that is unset, a temporary folder takes its place."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="quillmine-shared-"))
        atexit.register(shutil.rmtree, _own_folder[0], True)
    return f"file://{_own_folder[0]}"


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder, which goes when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/quillmine-scratch/{spark.sparkContext.applicationId}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(at)
    store.deleteOnExit(at)
    return f"{path}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written to a scratch folder and read from there, so that what it costs is paid once."""
    at = scratch_folder(df.sparkSession, label)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed to the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
