"""Structured Streaming: stage rows as they arrive, kept as the latest row of each id."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def latest(df: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """(key, at, value): the latest row of each key; of equal times the greater value."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(at, value)).alias("m")).select(key, F.col(f"m.{at}").alias(at), F.col(f"m.{value}").alias(value))


def upsert_stream(spark: SparkSession, source: str, schema: StructType, key: str, at: str, value: str, target: str, checkpoint: str, files_per_batch: int = 1):
    """Starts a query that folds files of ``source`` into ``target``: each batch writes a new version of the table (batch id
    in its path), so a batch that is run again after a loss replaces its own version. Read with :func:`current`."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        before = [v for v in _versions(session, target) if v < batch_id]
        rows = batch.select(key, at, value)
        if before:
            rows = rows.unionByName(session.read.parquet(f"{target}/v={before[-1]}"))
        latest(rows, key, at, value).write.mode("overwrite").parquet(f"{target}/v={batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, target: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    done = [n for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(os.path.join(target, n, "_SUCCESS")))]
    return sorted(int(n[2:]) for n in done)


def current(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/v={_versions(spark, target)[-1]}")


def windowed_counts(events: DataFrame, at: str, kind: str, late: str = "7 days", width: str = "1 day") -> DataFrame:
    """Rows per window and kind, late rows counted until the watermark has passed; the same for a stream and a table."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), F.col(kind)).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
