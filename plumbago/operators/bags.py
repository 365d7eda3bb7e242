"""Out-of-fold contracts, bags of instances and their pooled scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def fold_plan(df: DataFrame, fold: str, eligible: Column, accepted: Column, k: int) -> DataFrame:
    """Per held-out fold: rows scored, rows trained on (eligible, accepted, other folds), rows left for review."""
    folds = df.sparkSession.range(k).select(F.col("id").cast("int").alias("held"))
    counted = df.select(F.col(fold).alias("f"), eligible.alias("e"), accepted.alias("a")).groupBy("f", "e", "a").agg(F.count("*").alias("n"))
    j = folds.crossJoin(F.broadcast(counted))  # folds x folds x 4 counted rows
    return j.groupBy("held").agg(
        F.sum(F.when((F.col("f") == F.col("held")), F.col("n")).otherwise(0)).alias("scoring"),
        F.sum(F.when((F.col("f") != F.col("held")) & (F.col("f") >= 0) & F.col("e") & F.col("a"), F.col("n")).otherwise(0)).alias("training"),
        F.sum(F.when((F.col("f") != F.col("held")) & F.col("e") & ~F.col("a"), F.col("n")).otherwise(0)).alias("review"),
    )


def nested_pairs(df: DataFrame, fold: str, k: int) -> DataFrame:
    """All (outer, scoring) folds, the folds their model must not see, and its training rows."""
    ids = df.sparkSession.range(k).select(F.col("id").cast("int").alias("outer_fold"))
    pairs = ids.crossJoin(F.broadcast(ids.withColumnRenamed("outer_fold", "scoring_fold"))).withColumn("excluded", F.array_sort(F.array_distinct(F.array("outer_fold", "scoring_fold"))))
    counts = df.where(F.col(fold) >= 0).groupBy(F.col(fold).cast("int").alias("f")).agg(F.count("*").alias("n"))
    j = pairs.crossJoin(F.broadcast(counts))  # k x k x k counted rows
    return j.groupBy("outer_fold", "scoring_fold", "excluded").agg(F.sum(F.when(~F.array_contains("excluded", F.col("f")), F.col("n")).otherwise(0)).alias("training"))


def pooled_scores(images: DataFrame, crops: DataFrame, key: str, risk: str, attention: float = 0.0, scale: float = 1.0, context: float = 0.0, empty: float = -2.0) -> DataFrame:
    """One score per image: sigmoid(context + softplus(scale) x (attended + highest risk) / 2); images without crops get
    sigmoid(empty). Attention weights are the softmax of sigmoid(attention) x risk, ``attention`` a number, as sums of exponentials: no bag is
    ever collected, and one with a third of all crops is combined map-side."""
    w = F.exp(F.lit(1 / (1 + math.exp(-attention))) * F.col(risk))  # at most e: no overflow for risks in 0..1
    pooled = crops.where(F.col(risk).isNotNull() & ~F.isnan(risk)).groupBy(key).agg(F.count("*").alias("characters"), F.sum(w).alias("w"), F.sum(w * F.col(risk)).alias("wr"), F.max(risk).alias("top"))
    logit = F.lit(context) + F.log1p(F.exp(F.lit(scale))) * 0.5 * (F.col("wr") / F.col("w") + F.col("top"))
    j = images.select(key).distinct().join(pooled, key, "left")
    return j.select(key, F.coalesce("characters", F.lit(0)).alias("characters"), sigmoid(F.coalesce(logit, F.lit(empty))).alias("score"))


def top_instance(crops: DataFrame, key: str, item: str, weight: str) -> DataFrame:
    """The instance of highest weight of each bag, the smaller id on ties, by a map-side combined aggregate."""
    best = crops.groupBy(key).agg(F.min(F.struct((-F.col(weight)).alias("w"), F.col(item).alias("id"))).alias("b"))
    return best.select(key, F.col("b.id").alias(item), (-F.col("b.w")).alias(weight))
