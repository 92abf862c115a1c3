"""Incremental runs: new files are merged by key, what is there already is left alone."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; a temporary one where none is set and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="stream-")


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def merge_new(spark: SparkSession, source: str, schema, key: list[str], target: str, checkpoint: str, name: str = "*") -> DataFrame:
    """Append rows of new files whose key the target lacks; each batch is written once, however often it is tried."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.dropDuplicates(key)
        part = f"{target}/batch={batch_id}"
        if batch_id:
            have = spark.read.schema(f"{batch.select(*key)._jdf.schema().toDDL()}, batch bigint").parquet(target).where(F.col("batch") < batch_id)
            fresh = fresh.join(have.select(*key), key, "left_anti")
        fresh.write.mode("overwrite").parquet(part)

    rows = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(source)
    rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target)


def windowed_counts(rows: DataFrame, time: str, key: str, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and means by window and key of a stream (or a table) with late rows up to a bound."""
    rows = rows.withWatermark(time, late) if rows.isStreaming else rows
    return rows.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), key, "n", "mean")
