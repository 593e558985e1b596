"""Intermediate tables in the folder that the driver and all executors share.

The folder is the session's ``spark.checkpoint.dir``.  Where that is unset, a local master
uses a temporary folder of its own; on a cluster that would be one machine's, so there a
missing setting is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    app = spark.sparkContext.applicationId
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _LOCAL.setdefault(app, tempfile.mkdtemp(prefix="loomgraph-")) if app not in _LOCAL else _LOCAL[app]
    return f"{root.rstrip('/')}/loomgraph/{app}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: its lineage ends there, and partition numbers in it stay as they are."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
