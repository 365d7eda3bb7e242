"""Structured Streaming over append-only logs, and idempotent label merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windows(events: DataFrame, ts: str, kind: str, value: str, width: str = "1 hour", watermark: str | None = None) -> DataFrame:
    """Tumbling counts and sums per kind, the same for a stream (with a watermark) and a table."""
    base = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    base = base.withWatermark("__ts", watermark) if watermark else base
    g = base.groupBy(F.window("__ts", width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), kind, "n", "total")


def lineage_breaks(versions: DataFrame, version: str, parent: str) -> DataFrame:
    """Versions whose parent is not among the versions; without parent they are roots and no breaks."""
    known = versions.select(F.col(version).alias("__known")).where("__known IS NOT NULL").distinct()
    return versions.where(F.col(parent).isNotNull()).join(known, F.col(parent) == F.col("__known"), "left_anti")


def append_progress(rows: DataFrame, path: str, began: float) -> None:
    """Append progress events as JSON lines with the seconds since ``began`` (a Unix time); earlier files are never touched."""
    rows.withColumn("elapsed_s", F.round(F.unix_millis(F.current_timestamp()) / 1000 - F.lit(began), 3)).write.mode("append").json(path)


def log_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def merge_batches(stream: DataFrame, target: str, key: str, fields: list[str], checkpoint: str):
    """A streaming query that inserts unseen keys into versions of ``target`` and fails on conflicting rows; a replayed
    batch adds nothing."""
    from plumbago.operators.queues import merge_labels

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fresh = batch.dropDuplicates([key, *fields])
        if not fs.exists(jpath):
            fresh.write.parquet(target)
            return
        have = spark.read.parquet(target)
        _, conflicts = merge_labels(have, fresh, key, fields)
        if not conflicts.isEmpty():
            raise ValueError("a label conflicts with an accepted one")
        fresh.join(have.select(key), key, "left_anti").write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
