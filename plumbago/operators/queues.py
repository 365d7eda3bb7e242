"""Candidate mining and review queues: reasons, priorities, suppression, interleaving, labels."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbago.session import dropped, written

REASONS = ("ABNORMAL_HIGH_ATTENTION", "NEW_STYLE_CLUSTER", "DISAGREEMENT", "THRESHOLD_BAND", "NORMAL_FALSE_POSITIVE")


def reason_tags(signals: Mapping[str, Column]) -> Column:
    """Array of the names whose condition is true, in the order given."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in signals.items()]))


def band_signal(risk: Column, low: float, high: float) -> Column:
    """1 in the middle of the band, 0 at its ends and beyond."""
    return 1 - F.least(F.abs(risk - (low + high) / 2) / max((high - low) / 2, 1e-12), F.lit(1.0))


def priority(signals: Mapping[str, tuple[Column, Column]]) -> Column:
    """The largest value among the signals that are active."""
    return F.greatest(*[F.when(active, value) for active, value in signals.values()])


def tie_break(seed: int, key: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)


def keep_best(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__rn = 1").drop("__rn")


def greedy_suppression(df: DataFrame, key: str, rank: str, groups: Sequence[str], max_rounds: int = 60) -> DataFrame:
    """The rows a greedy pass in rank order keeps, when a row falls to any earlier kept row that shares a group value.

    Suppressed rows hold no keys. In each round rows that are first in all their groups are kept, and rows that share a
    group with a kept one are removed; this gives the same set as the sequential pass. Null values share nothing.
    """
    base = df.select(F.struct(F.col(rank), F.col(key)).alias("pos"), F.col(key).alias("id"), *[F.concat(F.lit(f"{g}:"), F.col(g).cast("string")).alias(g) for g in groups])
    own = F.concat(F.lit("self:"), F.col("id").cast("string"))
    open_ = written(base.select("pos", "id", F.explode(F.array_distinct(F.array_compact(F.array(own, *[F.col(g) for g in groups])))).alias("v")), "suppress")
    kept = None
    for _ in range(max_rounds):
        first = open_.groupBy("v").agg(F.min("pos").alias("lead"))
        joined = open_.join(first, "v")
        winners = written(joined.groupBy("id").agg(F.bool_and(F.col("pos") == F.col("lead")).alias("ok")).where("ok").select("id"), "suppress-kept")
        kept = winners if kept is None else kept.unionByName(winners)
        taken = open_.join(winners, "id", "left_semi").select("v").distinct()
        gone = open_.join(taken, "v", "left_semi").select("id").distinct()
        nxt = written(open_.join(gone, "id", "left_anti"), "suppress")
        dropped(open_)
        open_ = nxt
        if open_.isEmpty():
            return df.join(kept, df[key] == kept["id"], "left_semi")
    raise RuntimeError("suppression not finished")


def interleaved(df: DataFrame, key: str, rank: str, buckets: str, caps: Mapping[str, int], limit: int, order: Sequence[str] = REASONS) -> DataFrame:
    """Round-robin over reason buckets with caps: (key, queue_rank, bucket).

    A row stands in each of its buckets in rank order; buckets take turns in ``order``, a row is handled once, a row over
    a cap uses up its bucket's turn, caps count chosen rows only. Turns depend on each other, so they are taken one by
    one, but only over the head of each bucket: a line ends where the queue is full, and where the heads turn out too
    short (caps used them up) they are fetched again four times as long.
    """
    slim = df.select(F.col(key).alias("key"), F.col(rank).alias("rank"), F.explode(F.array_distinct(F.col(buckets))).alias("bucket"), *[F.col(c).cast("string").alias(c) for c in caps]).where(F.col("bucket").isin(*order))
    kind, head = dict(df.dtypes)[key], 2 * limit
    while True:
        heads = [slim.where(F.col("bucket") == b).orderBy("rank", "key").limit(head).collect() for b in order]
        chosen, short = _turns(heads, list(order), caps, limit, head)
        if not short:
            return df.sparkSession.createDataFrame(chosen, f"`{key}` {kind}, queue_rank int, bucket string")
        head *= 4


def _turns(heads: Sequence[Sequence], names: Sequence[str], caps: Mapping[str, int], limit: int, head: int) -> tuple[list[tuple], bool]:
    """The queue from the heads of the buckets, and whether a cut head ran out before the queue was full."""
    lines = [iter(h) for h in heads]
    used = {c: Counter() for c in caps}
    done: set = set()
    chosen: list[tuple] = []
    live = list(range(len(names)))
    while live and len(chosen) < limit:
        for k in tuple(live):
            row = next((r for r in lines[k] if r["key"] not in done), None)
            if row is None:
                if len(heads[k]) == head:
                    return chosen, True
                live.remove(k)
                continue
            done.add(row["key"])
            if all(row[c] is None or used[c][row[c]] < most for c, most in caps.items()):
                for c in caps:
                    used[c][row[c]] += 1
                chosen.append((row["key"], len(chosen) + 1, names[k]))
                if len(chosen) == limit:
                    break
    return chosen, False


def merge_labels(previous: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts): new keys are inserted; a key whose new rows differ in ``fields``, among themselves or from the
    accepted row, is a conflict and changes nothing. Equal new rows count once (the smallest of the other columns)."""
    told = F.struct(*fields)
    rest = [c for c in previous.columns if c != key and c not in fields]
    g = new.groupBy(key).agg(F.min(told).alias("__lo"), F.max(told).alias("__hi"), F.min(F.struct(*fields, *rest)).alias("__row"))
    j = g.join(previous.select(key, told.alias("__was"), F.lit(True).alias("__known")), key, "left")
    same = F.col("__lo").eqNullSafe(F.col("__hi"))
    conflict = ~same | (F.col("__known").isNotNull() & ~F.col("__lo").eqNullSafe(F.col("__was")))
    fresh = j.where(same & F.col("__known").isNull()).select(key, *[F.col("__row")[c].alias(c) for c in [*fields, *rest]])
    return previous.unionByName(fresh), j.where(conflict).select(key)
