"""Cutting lineage through tables in the folder that all executors share, and the size of Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; in local mode a temporary one where the session names none."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError(f"set {SETTING} to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="girder-")
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/girder/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote; only for tables from which nothing is read any more."""
    for t in tables:
        path = _paths.pop(t, None)
        if path is not None:
            sc = t.sparkSession.sparkContext
            place = sc._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bound the bytes of the session's Arrow batches, unless it has a bound of its own: texts of any length then go to Python a few megabytes at a time."""
    if BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(BATCH_BYTES, size)
