"""Lineage cuts that survive lost executors: tables written to the shared folder.

The folder is ``spark.checkpoint.dir`` of the session. Only a session on one machine
(master ``local``) may have none; it then uses its SQL warehouse folder. Tables lie in a
folder of their application, which is deleted when the driver ends, or by ``release``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_KNOWN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not (spark.sparkContext.master or "").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def _file_system(spark: SparkSession, folder: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def scratch_dir(spark: SparkSession) -> str:
    """The application's folder, marked for deletion at the driver's end."""
    folder = f"{shared_dir(spark)}/marginalia-scratch/{spark.sparkContext.applicationId}"
    if folder not in _KNOWN:
        files, path = _file_system(spark, folder)
        files.mkdirs(path)
        files.deleteOnExit(path)
        _KNOWN.add(folder)
    return folder


def release(spark: SparkSession) -> None:
    """Delete the tables written so far; frames that were read from them are of no use afterwards."""
    folder = scratch_dir(spark)
    files, path = _file_system(spark, folder)
    files.delete(path, True)
    _KNOWN.discard(folder)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later plans start at the files.

    Unlike a cached table, the copy stays complete when an executor is lost, and
    unlike ``checkpoint()`` it is columnar, with sizes that the planner sees.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
