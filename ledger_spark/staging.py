"""Intermediate tables written to the cluster's shared checkpoint folder.

A staged table cuts the lineage at a point that several later plans read, it
survives the loss of any executor, and its file sizes give the optimizer real
statistics for the joins that follow.
"""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"

# Folders made for local sessions that name none, by application.
_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local-mode session without the setting gets a folder of its own; a
    cluster has to name one that every executor can reach.
    """
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SETTING} to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="ledger-stage-")
    return _local_folders[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh, unused path below the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark).rstrip('/')}/ledger_spark/{app}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete everything that this application has staged; its staged tables end with it."""
    app = spark.sparkContext.applicationId
    store, path = fs.FileSystem.from_uri(f"{shared_folder(spark).rstrip('/')}/ledger_spark/{app}")
    if store.get_file_info(path).type == fs.FileType.Directory:
        store.delete_dir(path)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
