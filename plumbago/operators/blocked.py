"""Ranks, running sums and lowest-n cuts inside groups of any size.

A window ``PARTITION BY group`` puts a whole group into one task. Here a group is first cut into blocks by a prefix
of its order key; the blocks' totals (bounded by groups x blocks) carry the offsets, and the window runs inside a
block only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbago.session import broadcast_up_to


def running_sums(df: DataFrame, group: Sequence[str], block: Column, order: Sequence[Column], values: Mapping[str, Column]) -> DataFrame:
    """Add a column for each of ``values``: its sum over all rows of the group that come before the row.

    ``block`` must be non-decreasing along ``order``. Null group values form a group of their own. All sums share one
    shuffle of the rows.
    """
    keys = [F.coalesce(F.col(g).cast("string"), F.lit("\0")) for g in group]
    own = {f"__value_{n}": c for n, c in values.items()}
    keyed = df.withColumns({"__block": block, "__group": F.concat_ws("\1", F.lit("g"), *keys), **own})
    totals = keyed.groupBy("__group", "__block").agg(*[F.sum(f"__value_{n}").alias(f"__total_{n}") for n in values])
    before = Window.partitionBy("__group").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__group", "__block", *[F.coalesce(F.sum(f"__total_{n}").over(before), F.lit(0)).alias(f"__offset_{n}") for n in values])
    inside = Window.partitionBy("__group", "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.withColumns({f"__local_{n}": F.coalesce(F.sum(f"__value_{n}").over(inside), F.lit(0)) for n in values})
    joined = local.join(offsets, ["__group", "__block"]).withColumns({n: F.col(f"__offset_{n}") + F.col(f"__local_{n}") for n in values})
    return joined.drop("__group", "__block", *[f"__{k}_{n}" for n in values for k in ("value", "local", "offset")])


def running_sum(df: DataFrame, group: Sequence[str], block: Column, order: Sequence[Column], value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows of the group that come before the row."""
    return running_sums(df, group, block, order, {out: value})


def lowest(df: DataFrame, group: str, block: Column, order: Sequence[Column], quotas: DataFrame, quota: str) -> DataFrame:
    """Add ``chosen``: whether the row is among the group's first ``quota`` rows (quotas: one row per group).

    The block in which a quota ends comes from counts; only that block is ranked, and its last chosen row is the limit
    that every row of the group is compared with. ``order`` must tell the rows of a group apart and hold no nulls; rows
    without group or quota are not chosen. ``df`` is read three times: hand in a stored one if its plan is dear.
    """
    names = [f"__order_{k}" for k in range(len(order))]
    keyed = df.withColumns({"__block": block, **dict(zip(names, order, strict=True))})
    counts = keyed.groupBy(group, "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    cum = counts.withColumns({"__before": F.coalesce(F.sum("__n").over(before), F.lit(0)), "__all": F.sum("__n").over(Window.partitionBy(group))})
    cum = cum.join(quotas.select(group, F.col(quota).alias("__q")), group).withColumn("__q", F.least("__q", "__all"))
    cut = cum.where((F.col("__before") < F.col("__q")) & (F.col("__before") + F.col("__n") >= F.col("__q"))).select(group, F.col("__block").alias("__cut"), (F.col("__q") - F.col("__before")).alias("__rest"))
    edge = keyed.select(group, "__block", *names).join(broadcast_up_to(cut), group).where(F.col("__block") == F.col("__cut"))
    ranked = edge.withColumn("__rank", F.row_number().over(Window.partitionBy(group).orderBy(*names)))
    limit = broadcast_up_to(ranked.where(F.col("__rank") == F.col("__rest")).select(group, F.struct(*names).alias("__limit")))
    marked = keyed.join(limit, group, "left").withColumn("chosen", F.coalesce(F.struct(*names) <= F.col("__limit"), F.lit(False)))
    return marked.drop("__block", "__limit", *names)
