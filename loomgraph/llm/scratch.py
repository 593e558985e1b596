"""Intermediate tables in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``.  Only where that is unset
(tests, local runs) a folder of our own under the temporary directory is used,
and only with a local master: on a cluster a missing setting is an error,
because executors could not see a machine-local folder.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Spark deletes a plan's shuffle files when the plan has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: By operator, how to drop what it keeps in a worker between tasks.
CACHES: dict[str, Callable[[], object]] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder for this application's intermediate tables."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    app = spark.sparkContext.applicationId
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="loomgraph-")
        found = _LOCAL[app]
    return f"{found.rstrip('/')}/loomgraph/{app}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder (a folder for each value of ``by``) and read it back.

    Cuts lineage: a lost executor costs a reread, never a recomputation.  So the
    shuffle files of the plan that wrote it are of no more use, and Spark is told to
    delete them at the plan's end.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        out = df.write.option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def free_name(wanted: str, taken: Iterable[str]) -> str:
    """``wanted``, with underscores behind until no column of ``taken`` begins like it (Spark ignores case)."""
    low = [c.lower() for c in taken]
    while any(c.startswith(wanted.lower()) for c in low):
        wanted += "_"
    return wanted


def release_memory(keep: str = "") -> None:
    """Drop what other operators keep in this worker; later stages use workers again and need their memory for other things."""
    for name, clear in CACHES.items():
        if name != keep:
            clear()
    pa.default_memory_pool().release_unused()


def drop_tree(spark: SparkSession, path: str) -> None:
    """Delete a path with the file system that holds it (not only a local one)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cleanup(spark: SparkSession) -> None:
    """Remove this application's intermediate tables, once its results are written."""
    drop_tree(spark, shared_root(spark))
