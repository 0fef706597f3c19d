"""Files that arrive over time, merged into a table by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, path: str, pattern: str = "*.txt", per_trigger: int = 1000) -> DataFrame:
    """A stream of (path, content, arrived) of the files that appear below a folder."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(path)
    return files.select("path", "content", F.col("modificationTime").alias("arrived"))


def merge_arrivals(files: DataFrame, decode: Callable[[DataFrame], DataFrame], table: str, checkpoint: str) -> StreamingQuery:
    """Decode each batch and append it to a Parquet folder under the batch's number; a batch that is run again replaces itself, so each file counts once."""

    def put(batch: DataFrame, number: int) -> None:
        decode(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{table}/batch_id={number}")

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(table: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key in what arrived."""
    rest = [c for c in table.columns if c != key and c not in order]
    return table.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("r")).select(key, "r.*")
