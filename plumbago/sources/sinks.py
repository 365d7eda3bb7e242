"""Sinks: content-addressed versions, immutable and atomic publication, exports."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbago.functions.text import canonical_json


class PublishConflict(RuntimeError):
    """The target exists with other content."""


def content_digest(df: DataFrame, key: str) -> str:
    """A version that depends on the rows only, not on their order or partitioning.

    Rows are hashed as canonical JSON and combined in two levels: the sorted row hashes of each of 4,096 key buckets, then
    the bucket digests; no task holds more than a bucket. Use keys and exact types, not floats, where engines differ.
    """
    rows = df.select(F.sha2(canonical_json(df.columns), 256).alias("h"), F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(4096)).alias("b"))
    buckets = rows.groupBy("b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("h"))
    return buckets.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda e: e["h"]), "\n"), 256).alias("d")).first()[0]


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(df: DataFrame, path: str, key: str, partition_by: Sequence[str] = ()) -> str:
    """Write to a staging folder, then rename: readers see all or nothing. The same content again is a no-op, other
    content raises PublishConflict. Returns the content digest, which is stored beside the data."""
    spark = df.sparkSession
    digest = content_digest(df, key)
    target, fs = _fs(spark, path)
    marker, _ = _fs(spark, f"{path}/_digest")
    if fs.exists(target):
        stored = spark.read.text(f"{path}/_digest").first() if fs.exists(marker) else None
        if stored is not None and stored[0] == digest:
            return digest
        raise PublishConflict(f"{path} holds other content")
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(staging)
        spark.createDataFrame([(digest,)], "value string").coalesce(1).write.text(f"{staging}/_digest")
        source, _ = _fs(spark, staging)
        if not fs.rename(source, target):
            raise PublishConflict(f"{path} appeared meanwhile")
    finally:
        left, _ = _fs(spark, staging)
        if fs.exists(left):
            fs.delete(left, True)
    return digest


def export_csv(df: DataFrame, path: str, header: Sequence[str], order: Sequence[str]) -> None:
    """A fixed header in a fixed order, sorted."""
    df.select(*header).orderBy(*order).write.mode("errorifexists").option("header", True).csv(path)


def export_json_lines(df: DataFrame, path: str, order: Sequence[str]) -> None:
    df.orderBy(*order).write.mode("errorifexists").option("ignoreNullFields", False).json(path)
