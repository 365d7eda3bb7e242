"""Problem 3: cap the records of each contributor, keeping those with the best quality score.

Mergeable bounded heaps: every partition keeps, per contributor, only the ``cap`` best (score, id) pairs; the heaps
are merged in two levels (salted, then whole) and the records are semi-joined with the kept ids. Heaps hold up to
``cap`` pairs, and a cap given as a share grows with the data: above ``heap_limit`` pairs the same order is cut by
blocked ranks instead, exactly and with no heap in any one task. Only contributors above the cap enter either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbago.session import written

HEAP = "contributor string, klass int, score double, record string"
HEAP_LIMIT = 20_000


def _best(table: pa.Table, cap: int) -> pa.Table:
    """The cap best rows of each contributor, by (klass, score, record)."""
    table = table.sort_by([("contributor", "ascending"), ("klass", "ascending"), ("score", "ascending"), ("record", "ascending")])
    names = table["contributor"].combine_chunks().dictionary_encode()
    names = (names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names).indices.to_numpy(zero_copy_only=False)
    if len(names) == 0:
        return table
    start = np.r_[True, names[1:] != names[:-1]]
    first = np.maximum.accumulate(np.where(start, np.arange(len(names)), 0))
    return table.filter(pa.array(np.arange(len(names)) - first < cap))


def _heaps(cap: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        waiting: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= 65536:
                held = _best(pa.concat_tables([*([held] if held is not None else []), pa.Table.from_batches(waiting)]), cap)
                waiting, rows = [], 0
        if waiting:
            held = _best(pa.concat_tables([*([held] if held is not None else []), pa.Table.from_batches(waiting)]), cap)
        if held is not None:
            yield from held.to_batches(max_chunksize=65536)

    return merge


def ranked_scores(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """(record, contributor) with the record's order key (klass, score): scored records first, lower scores first.

    scores: (record, score). Null, NaN and values outside 0..1 don't count; a record's score is its highest one.
    """
    peak = scores.where("score IS NOT NULL AND NOT isnan(score) AND score >= 0 AND score <= 1").groupBy("record").agg(F.max("score").alias("score"))
    joined = pairs.join(peak, "record", "left")
    return joined.select("record", "contributor", F.when(F.col("score").isNull(), 1).otherwise(0).alias("klass"), F.coalesce("score", F.lit(0.0)).alias("score"))


def over_cap(pairs: DataFrame, scores: DataFrame, cap: int | None = None, share: float | None = None, heap_limit: int = HEAP_LIMIT) -> DataFrame:
    """(record, contributor) of all pairs that fall away when each contributor keeps at most the cap.

    pairs: (record, contributor); the share is of all distinct records, those without contributor included,
    rounded down, at least 1. Records without contributor stay; repeated pairs count once; a record with several
    contributors counts at each. Ties go to the smaller record. Empty input gives no rows.
    """
    if (cap is None) == (share is None):
        raise ValueError("give either cap or share")
    pairs = pairs.select("record", "contributor").where("record IS NOT NULL").distinct()
    if cap is None:
        total = pairs.agg(F.count_distinct("record")).first()[0]
        cap = max(1, int(total * share + 1e-9))
    named = pairs.where("contributor IS NOT NULL")
    large = named.groupBy("contributor").agg(F.count("*").alias("n")).where(F.col("n") > cap).select("contributor")
    entries = ranked_scores(named.join(large, "contributor", "left_semi"), scores).select("contributor", "klass", "score", "record")
    if cap <= heap_limit:
        salted = entries.mapInArrow(_heaps(cap), HEAP)
        level = salted.repartition(64, F.col("contributor"), F.pmod(F.xxhash64("record"), F.lit(8))).mapInArrow(_heaps(cap), HEAP)
        kept = level.repartition(F.col("contributor")).mapInArrow(_heaps(cap), HEAP).select("contributor", "record")
        return entries.select("record", "contributor").join(kept, ["contributor", "record"], "left_anti")
    return beyond_rank(entries, cap)


def beyond_rank(entries: DataFrame, cap: int) -> DataFrame:
    """The rows of ``entries`` past the cap, by counts of sorted range partitions: no group sits in one task.

    The range partitioning splits a contributor at sampled (contributor, klass, score, record) bounds; the counts per
    partition and contributor (bounded by partitions + contributors) give each partition its offset.
    """
    order = ["contributor", "klass", "score", "record"]
    parts = max(8, entries.sparkSession.sparkContext.defaultParallelism * 4)
    cut = written(entries.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "cap-order")
    sums = cut.groupBy("contributor", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("contributor").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("contributor", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("contributor", "part").orderBy("klass", "score", "record"))
    return cut.withColumn("rank", rank).join(offsets, ["contributor", "part"]).where(F.col("rank") + F.col("offset") > cap).select("record", "contributor")
