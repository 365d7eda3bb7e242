"""Identity graph: edges by equal values and near hashes, components, leakage and balanced folds."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbago.operators.blocked import running_sum
from plumbago.operators.components import hash_to_min
from plumbago.session import written


def equality_edges(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Star edges (src = smallest key of the value, dst) for rows that share a value of a column; nulls join nothing.

    The star keeps the edges linear in the rows; the smallest key comes from an aggregate, so a value with a third of all
    rows is combined map-side and joined back with skew handling instead of a window over one partition.
    """
    long = df.select(F.col(key).alias("dst"), F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in columns])).alias("e")).select("dst", "e.*").where("value IS NOT NULL")
    low = long.groupBy("col", "value").agg(F.min("dst").alias("src"), F.max("dst").alias("top")).where("src < top").drop("top")
    return long.join(low, ["col", "value"]).where("src <> dst").select("src", "dst").distinct()


def segment_keys(code: Column, bits: int, count: int, spread: int = 0) -> Column:
    """Array of (segment, value) of a long cut into ``count`` runs of bits (the first ones a bit longer if they don't divide
    evenly), each also with every way of up to ``spread`` of its bits turned."""
    at, parts = 0, []
    for k in range(count):
        w = bits // count + (k < bits % count)
        own = F.shiftrightunsigned(code, at).bitwiseAND(F.lit((1 << w) - 1))
        masks = [sum(1 << x for x in c) for t in range(spread + 1) for c in itertools.combinations(range(w), t)]
        parts.append(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), _turned(k, own)))
        at += w
    return F.flatten(F.array(*parts))


def _turned(segment: int, own: Column):
    return lambda mask: F.struct(F.lit(segment).alias("segment"), own.bitwiseXOR(mask).alias("value"))


def segment_count(rows: int, bits: int, radius: int, most_probes: int = 2000) -> int:
    """How many segments make the fewest probes and candidates a row: with m of them, codes within the radius agree in one up
    to radius // m bits, so longer segments need more probes but meet fewer chance partners."""

    def cost(m: int) -> float:
        probes = m * sum(math.comb(-(-bits // m), t) for t in range(radius // m + 1))
        return math.inf if probes > most_probes else probes * (1 + rows / 2 ** (bits / m))

    return min(range(2, radius + 2), key=cost) if radius else 1


def hamming_pairs(df: DataFrame, key: str, code: str, radius: int = 10, bits: int = 64, segments: int | None = None) -> DataFrame:
    """All pairs (a < b, distance) of distinct codes within ``radius``, exactly, for any radius below ``bits``.

    Codes are cut into segments; two codes within the radius agree in one segment up to radius // segments bits, so one
    side looks up all such neighbours of each segment. The number of segments follows the number of codes. Rows of equal
    code are first reduced to the smallest key and linked to it by distance 0 (a star, not all pairs).
    """
    if not 0 <= radius < bits:
        raise ValueError("radius must be at least 0 and below the number of bits")
    rows = df.where(F.col(key).isNotNull() & F.col(code).isNotNull()).select(F.col(key).alias("id"), F.col(code).alias("code"))
    reps = written(rows.groupBy("code").agg(F.min("id").alias("rep")), "hamming-codes")
    same = rows.join(reps, "code").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(0).alias("distance")).distinct()
    m = segments or segment_count(reps.count(), bits, radius)
    asked = reps.select(F.col("rep").alias("a"), F.col("code").alias("code_a"), F.explode(segment_keys(F.col("code"), bits, m, radius // m)).alias("k")).select("a", "code_a", "k.*")
    own = reps.select(F.col("rep").alias("b"), F.col("code").alias("code_b"), F.explode(segment_keys(F.col("code"), bits, m)).alias("k")).select("b", "code_b", "k.*")
    gap = F.bit_count(F.col("code_a").bitwiseXOR(F.col("code_b")))
    near = asked.join(own, ["segment", "value"]).where(F.col("a") < F.col("b")).withColumn("distance", gap).where(F.col("distance") <= radius)
    return near.select("a", "b", "distance").distinct().unionByName(same)


def component_ids(nodes: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """(key, component): the smallest key reachable; nodes without edge are their own."""
    labels = hash_to_min(edges).withColumnRenamed("node", key)
    return nodes.select(key).distinct().join(labels, key, "left").withColumn("component", F.coalesce("component", key))


def component_digest(parts: DataFrame, key: str) -> DataFrame:
    """Per component its size and the first 16 hex digits of the SHA-256 of its sorted keys, NUL-joined.

    The digest is defined over the whole sorted list, so one row holds a component's keys: for identity groups, whose
    size is bounded by what one row may hold (2 GB), not for clusters of unbounded size.
    """
    ids = F.array_join(F.array_sort(F.collect_set(F.col(key).cast("string"))), "\0")
    return parts.groupBy("component").agg(F.count("*").alias("size"), F.substring(F.sha2(ids, 256), 1, 16).alias("digest"))


def mixed_components(parts: DataFrame, role: Column) -> DataFrame:
    """Components that hold rows for which ``role`` is true and rows for which it is not."""
    g = parts.groupBy("component").agg(F.count_if(role).alias("locked"), F.count_if(~role).alias("open"))
    return g.where("locked > 0 AND open > 0")


def shared_out(load: list[list[int]], whole: Sequence[int], item: Sequence[int], n: int) -> list[int]:
    """How many of ``n`` equal items each fold takes when each goes where its labels weigh least (then the least loaded, then
    the first fold); ``load`` is changed. Adding an item raises a fold's cost by the same step, so the items fill the
    costs to a level; only the last few are placed one by one."""
    k = len(load)
    used = [x for x, c in enumerate(item) if c]
    step = sum(item[x] / whole[x] for x in used)
    base = [sum(load[f][x] / whole[x] for x in used) for f in range(k)]
    low, high = min(base), max(base) + step * (n + 1)
    for _ in range(200 if n > 4 * k else 0):
        level = (low + high) / 2
        low, high = (level, high) if sum(max(0, math.floor((level - b) / step)) for b in base) <= n - k else (low, level)
    take = [max(0, math.floor((low - b) / step)) for b in base] if n > 4 * k else [0] * k
    for f in range(k):
        load[f] = [was + take[f] * c for was, c in zip(load[f], item, strict=True)]
    for _ in range(n - sum(take)):
        best = min(range(k), key=lambda f: (round(sum((load[f][x] + item[x]) / whole[x] for x in used), 12), sum(load[f]), f))
        load[best] = [was + c for was, c in zip(load[best], item, strict=True)]
        take[best] += 1
    return take


def balanced_folds(parts: DataFrame, label: str, locked: str, k: int = 5, seed: int = 0, most_kinds: int = 100_000) -> DataFrame:
    """(component, fold): label counts balanced over folds; components with a locked row get -1.

    Components are placed from large to small, of one size those with more positives first. Those with the same counts are
    one kind, whose quotas come from ``shared_out`` on the driver (the number of kinds is checked); within a kind the
    components take the folds by blocked ranks of their hash, so no task holds all of them.
    """
    counts = parts.groupBy("component").agg(F.bool_or(locked).alias("is_locked"), F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg"))
    counts = written(counts.withColumn("order", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("component").cast("string")), 256)), "fold-components")
    fixed = counts.where("is_locked").select("component", F.lit(-1).alias("fold"))
    free = counts.where("NOT is_locked")
    kinds = free.groupBy("pos", "neg").agg(F.count("*").alias("n")).limit(most_kinds + 1).collect()
    if len(kinds) > most_kinds:
        raise ValueError("more kinds of components than the driver takes")
    whole = [max(1, sum(r["pos"] * r["n"] for r in kinds)), max(1, sum(r["neg"] * r["n"] for r in kinds))]
    load, plan = [[0, 0] for _ in range(k)], []
    for r in sorted(kinds, key=lambda r: (-(r["pos"] + r["neg"]), -r["pos"])):
        plan.append((r["pos"], r["neg"], list(itertools.accumulate(shared_out(load, whole, (r["pos"], r["neg"]), r["n"])))))
    ends = F.broadcast(parts.sparkSession.createDataFrame(plan, "pos long, neg long, ends array<long>"))  # one row a kind
    ranked = running_sum(free, ["pos", "neg"], F.conv(F.substring("order", 1, 4), 16, 10).cast("int"), [F.col("order"), F.col("component")], F.lit(1), "rank")
    fold = F.size(F.filter("ends", lambda e: e <= F.col("rank")))
    return ranked.join(ends, ["pos", "neg"]).select("component", fold.cast("int").alias("fold")).unionByName(fixed)
