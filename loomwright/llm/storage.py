"""Intermediate tables in the shared folder that the cluster names.

Cutting lineage with a written table survives lost executors: the files are in shared storage, not on an
executor. The folder is the one that the session names (``spark.checkpoint.dir`` or ``setCheckpointDir``); where none is
named, a temporary folder is made for a local session, and a cluster is refused.

A result is read lazily, so its tables stay while it may be read: they go when the application ends
(``remove_tables`` does it before).
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of tables by application.
_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; for a local session without one, a temporary folder."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="loomwright-"))
    return context.getCheckpointDir()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and return the reread table."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{shared_folder(spark)}/loomwright-{app}-{uuid.uuid4().hex}"
        atexit.register(remove_tables, spark)
    path = f"{_FOLDERS[app]}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_tables(spark: SparkSession) -> None:
    """Delete the tables that this application has written so far; results that read them are lost."""
    context = spark.sparkContext
    if context._jsc is None or (folder := _FOLDERS.pop(context.applicationId, None)) is None:
        return
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
