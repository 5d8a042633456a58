"""The folder in which an application keeps what it writes on the way; it goes when the application ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def file_system(spark: SparkSession, path: str):
    """(file system, path) of the JVM for a path in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def folder(spark: SparkSession) -> str:
    """A folder of this application in the one that driver and executors share; a local one only where they are one process and the session names none."""
    app = spark.sparkContext.applicationId
    shared = spark.conf.get("spark.checkpoint.dir", None) or _folders.get("")
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = _folders.setdefault("", tempfile.mkdtemp(prefix="rankloom-"))
    path = f"{shared.rstrip('/')}/rankloom-{app}"
    if _folders.get(app) != path:
        store, at = file_system(spark, path)
        store.mkdirs(at)
        store.deleteOnExit(at)
        _folders[app] = path
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    store, at = file_system(spark, path)
    store.delete(at, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the folder and read back: what follows depends on no executor that may be lost, and computes nothing twice."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
