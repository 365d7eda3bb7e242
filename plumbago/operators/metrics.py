"""Score analytics: sweeps, areas, gates, calibrated thresholds, intervals.

Input rows have a boolean ``label`` (true = positive) and a double ``score``; rows with a null or NaN score or a null
label take no part. Rows are first reduced to one per distinct score, running sums then go over blocks of the score
range, so no task holds the whole order.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbago.operators.blocked import running_sum, running_sums

Z95 = 1.959963984540054
#: name, highest false positive rate, least recall
GATES = (("MVP", 1e-4, 0.40), ("TRIAL", 2.5e-5, 0.50))


def next_up(column: Column) -> Column:
    """The next double above."""
    return F.pandas_udf(lambda s: pd.Series(np.nextafter(s.to_numpy(float), np.inf)), T.DoubleType())(column)


def usable(df: DataFrame) -> DataFrame:
    return df.where("score IS NOT NULL AND NOT isnan(score) AND label IS NOT NULL")


def score_steps(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score (and ``by``): p, n of the score and tp, fp at or above it, P and N of the group."""
    steps = usable(df).groupBy(*by, "score").agg(F.count_if("label").alias("p"), F.count_if(~F.col("label")).alias("n"))
    group = list(by) or ["__all"]
    steps = steps if by else steps.withColumn("__all", F.lit(1))
    block = (-F.floor(F.least(F.greatest(F.col("score"), F.lit(-1.0)), F.lit(2.0)) * 1024)).cast("int")
    cum = running_sums(steps, group, block, [F.desc("score")], {"__tp": F.col("p"), "__fp": F.col("n")})
    total = steps.groupBy(*group).agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    joined = cum.withColumns({"tp": F.col("__tp") + F.col("p"), "fp": F.col("__fp") + F.col("n")}).drop("__tp", "__fp")
    out = joined.join(F.broadcast(total) if not by else total, group)  # one row without ``by``
    return out if by else out.drop("__all")


def base_rate_ppv(prevalence: Column, recall: Column, fpr: Column) -> Column:
    hit = prevalence * recall
    return F.coalesce(F.try_divide(hit, hit + (1 - prevalence) * fpr), F.lit(0.0))


def threshold_sweep(df: DataFrame, prevalence: float = 0.001) -> DataFrame:
    """tp, fp, recall, fpr and base-rate precision at each distinct score as threshold (score >= threshold), and at one
    threshold above all scores. Recall is null without positives, fpr without negatives; no usable rows give no rows."""
    steps = score_steps(df).select(F.col("score").alias("threshold"), "tp", "fp", "pos", "neg")
    top = steps.agg(F.max("threshold").alias("t"), F.max("pos").alias("pos"), F.max("neg").alias("neg")).where("t IS NOT NULL")
    above = top.select(next_up(F.col("t")).alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), "pos", "neg")
    out = steps.unionByName(above).withColumns({"recall": F.try_divide("tp", "pos"), "fpr": F.try_divide("fp", "neg")})
    return out.withColumn("ppv", base_rate_ppv(F.lit(prevalence), F.coalesce("recall", F.lit(0.0)), F.coalesce("fpr", F.lit(0.0)))).drop("pos", "neg")


def ranking_areas(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tie-aware AUROC and average precision; null where a class is missing."""
    s = score_steps(df, by)
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    roc = F.sum(F.col("n") * (F.col("tp") - F.col("p") + F.col("p") / 2.0))
    ap = F.sum((F.col("p") / F.greatest("pos", F.lit(1))) * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    agg = s.groupBy(*by).agg(F.max("pos").alias("pos"), F.max("neg").alias("neg"), roc.alias("roc"), ap.alias("ap")).where("pos IS NOT NULL")
    return agg.select(*by, "pos", "neg", F.when(both, F.try_divide(F.col("roc"), F.col("pos") * F.col("neg"))).alias("auroc"), F.when(both, F.col("ap")).alias("aucpr"))


def operating_gates(df: DataFrame, gates: Sequence[tuple[str, float, float]] = GATES) -> DataFrame:
    """For each gate the best threshold and its status.

    Passing thresholds are ranked by recall, fpr, threshold; else the least violation is taken. With fewer negatives
    than ceil(1 / max_fpr), or none of a class, the gate is inconclusive.
    """
    rows = df.sparkSession.createDataFrame(list(gates), "gate string, max_fpr double, min_recall double")
    points = threshold_sweep(df).crossJoin(F.broadcast(rows))  # a handful of gates
    totals = usable(df).agg(F.count_if("label").alias("pos"), F.count_if(~F.col("label")).alias("neg"))
    r, f = F.coalesce("recall", F.lit(0.0)), F.coalesce("fpr", F.lit(0.0))
    over = F.greatest(f / F.col("max_fpr") - 1, F.lit(0.0)) + F.greatest(F.col("min_recall") - r, F.lit(0.0)) / F.col("min_recall")
    passing = (f <= F.col("max_fpr")) & (r >= F.col("min_recall"))
    key = F.struct(passing.alias("ok"), (-F.when(passing, F.lit(0.0)).otherwise(over)).alias("v"), r.alias("recall"), (-f).alias("nf"), F.col("threshold"))
    best = points.groupBy("gate", "max_fpr", "min_recall").agg(F.max(key).alias("b")).crossJoin(F.broadcast(totals))  # one row
    support = (F.col("neg") >= F.ceil(1 / F.col("max_fpr"))) & (F.col("pos") > 0)
    status = F.when(~support, "inconclusive").when(F.col("b.ok"), "passed").otherwise("failed")
    return best.select("gate", F.col("b.threshold").alias("threshold"), F.col("b.recall").alias("recall"), (-F.col("b.nf")).alias("fpr"), status.alias("status"))


def calibrated_threshold(df: DataFrame, max_fpr: float, by: str) -> DataFrame:
    """Per group the lowest threshold that lets at most floor(max_fpr x negatives) negatives through, ties included.

    It is the next double above the first score not allowed; the least score when all are allowed. Groups without
    negatives give no row.
    """
    neg = usable(df).where("NOT label").groupBy(by, "score").agg(F.count("*").alias("k"))
    block = (-F.floor(F.least(F.greatest(F.col("score"), F.lit(-1.0)), F.lit(2.0)) * 1024)).cast("int")
    cum = running_sum(neg, [by], block, [F.desc("score")], F.col("k"), "before")
    size = neg.groupBy(by).agg(F.sum("k").alias("n"), F.min("score").alias("least"))
    allowed = F.floor(F.lit(max_fpr) * F.col("n"))
    cut = cum.join(size, by).where((F.col("before") <= allowed) & (F.col("before") + F.col("k") > allowed)).select(by, F.col("score").alias("first_refused"))
    joined = size.join(cut, by, "left")
    return joined.select(by, F.col("n").alias("negatives"), F.coalesce(next_up(F.col("first_refused")), F.col("least")).alias("threshold"))


def confusion(df: DataFrame, threshold: Column, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, tn, fn, recall and fpr (null at a zero denominator) of score >= threshold."""
    hit, pos = F.col("score") >= threshold, F.col("label")
    out = usable(df).groupBy(*by).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & ~pos).alias("tn"), F.count_if(~hit & pos).alias("fn"))
    return out.withColumns({"recall": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), "fpr": F.try_divide(F.col("fp"), F.col("fp") + F.col("tn"))})


def wilson(successes: Column, trials: Column) -> tuple[Column, Column]:
    """The 95 % interval, clipped to 0..1; null without trials."""
    n = F.nullif(trials.cast("double"), F.lit(0.0))
    p = successes / n
    mid, half, scale = p + Z95**2 / (2 * n), Z95 * F.sqrt(p * (1 - p) / n + Z95**2 / (4 * n * n)), 1 + Z95**2 / n
    return F.greatest((mid - half) / scale, F.when(n.isNotNull(), F.lit(0.0))), F.least((mid + half) / scale, F.when(n.isNotNull(), F.lit(1.0)))


def recall_by_group(df: DataFrame, group: str, threshold: float) -> DataFrame:
    """Positives only, null and blank groups dropped: support, detected, recall and its interval."""
    pos = usable(df).where(F.col("label") & (F.coalesce(F.col(group), F.lit("")) != ""))
    out = pos.groupBy(group).agg(F.count("*").alias("support"), F.count_if(F.col("score") >= threshold).alias("detected"))
    low, high = wilson(F.col("detected"), F.col("support"))
    return out.withColumns({"recall": F.col("detected") / F.col("support"), "low": low, "high": high})


def diagnostic_threshold(df: DataFrame, max_fpr: float) -> DataFrame:
    """Among thresholds with fpr <= max_fpr the one of highest (recall, -fpr, threshold)."""
    ok = threshold_sweep(df).where(F.coalesce("fpr", F.lit(0.0)) <= max_fpr)
    best = ok.agg(F.max(F.struct(F.coalesce("recall", F.lit(0.0)).alias("recall"), (-F.coalesce("fpr", F.lit(0.0))).alias("nf"), "threshold")).alias("b"))
    return best.where("b IS NOT NULL").select("b.threshold", "b.recall", (-F.col("b.nf")).alias("fpr"))


def bootstrap_ap(df: DataFrame, by: str, rounds: int = 200, seed: str = "boot") -> DataFrame:
    """2.5 and 97.5 % points of the average precision over Poisson resamples of whole rows, drawn from a hash of (seed,
    round, key): rows go to every round by explode, a resample is reduced to its distinct scores before anything moves.
    Resamples with one class are skipped. ``df`` needs a unique ``key``."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "round", "key"), F.lit(2**53)) + 0.5) / float(2**53)
    # inverse of the Poisson(1) distribution, its tail cut where it is under 1e-7
    steps = np.cumsum([np.exp(-1) / float(np.prod(np.arange(1, k + 1))) if k else np.exp(-1) for k in range(10)])
    draws = sum((F.when(u > float(s), 1).otherwise(0) for s in steps), F.lit(0))
    rows = usable(df).withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("w", draws).where("w > 0")
    per = rows.groupBy(by, "round", "score").agg(F.sum(F.when(F.col("label"), F.col("w")).otherwise(0)).alias("p"), F.sum(F.when(~F.col("label"), F.col("w")).otherwise(0)).alias("n"))
    w = Window.partitionBy(by, "round").orderBy(F.desc("score"))
    cum = per.withColumns({"tp": F.sum("p").over(w), "all": F.sum(F.col("p") + F.col("n")).over(w)})
    aps = cum.groupBy(by, "round").agg((F.try_divide(F.sum(F.col("p") * F.col("tp") / F.col("all")), F.sum("p"))).alias("ap"), F.sum("p").alias("pos"), F.sum("n").alias("neg")).where("pos > 0 AND neg > 0")
    return aps.groupBy(by).agg(F.count("*").alias("rounds"), F.expr("percentile(ap, 0.025)").alias("low"), F.expr("percentile(ap, 0.975)").alias("high"))


def percentiles(df: DataFrame, by: str, value: str, shares: Sequence[float]) -> DataFrame:
    """(by, n, p0, p1, ...): exact percentiles, interpolated between neighbours, from the counts of distinct values.

    Running counts go over blocks of the value range, so no task holds all values of a group. Null and NaN values take no
    part; an empty table gives no rows.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(by, F.col(value).cast("double").alias("v"))
    low, high = rows.agg(F.min("v"), F.max("v")).first()
    width = (high - low) / 4096 if low is not None and high > low else 1.0
    steps = rows.groupBy(by, "v").agg(F.count("*").alias("c"))
    block = F.least(F.floor((F.col("v") - F.lit(low or 0.0)) / F.lit(width)), F.lit(4096)).cast("int")
    cum = running_sum(steps, [by], block, [F.col("v")], F.col("c"), "before")
    total = steps.groupBy(F.col(by).alias("__by")).agg(F.sum("c").alias("n"))
    j = cum.join(total, F.col(by).eqNullSafe(F.col("__by"))).drop("__by")
    at = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("c")), F.col("v")))
    ends = []
    for k, p in enumerate(shares):
        place = (F.col("n") - 1) * F.lit(float(p))
        ends += [at(F.floor(place)).alias(f"lo{k}"), at(F.ceil(place)).alias(f"hi{k}")]
    g = j.groupBy(by, "n").agg(*ends)
    part = lambda p: (F.col("n") - 1) * F.lit(float(p)) - F.floor((F.col("n") - 1) * F.lit(float(p)))
    return g.select(by, "n", *[(F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * part(p)).alias(f"p{k}") for k, p in enumerate(shares)])
