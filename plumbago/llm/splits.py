"""Problem 2: splits that keep related records together, and where the roles at hand break this.

Records and their groups form a bipartite graph; its components are found by hash-to-min and put into splits by
weighted rendezvous hashing. Records of a single group need no graph work: only groups that share a record are
edges, so the graph is as large as the overlap, not as the data.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbago.operators.components import hash_to_min

DEFAULT = {"train": 0.8, "validation": 0.1, "test": 0.1}


def rendezvous(component: Column, weights: Mapping[str, float], salt: str = "split") -> Column:
    """The split with the highest weighted score; changing one weight moves only the components it must move."""
    if not weights or any(w < 0 or not math.isfinite(w) for w in weights.values()) or sum(weights.values()) <= 0:
        raise ValueError("weights must be finite, not negative, and not all zero")

    def score(name: str, weight: float) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}:{name}:"), component).cast("binary")), 1, 13), 16, 10).cast("double")
        unit = (bits + 0.5) / float(2**52)
        return F.struct((-F.lit(float(weight)) / F.log(unit)).alias("score"), F.lit(name).alias("split"))

    return F.array_max(F.array(*[score(n, w) for n, w in sorted(weights.items()) if w > 0])).getField("split")


def related_components(pairs: DataFrame) -> DataFrame:
    """(record, grp) rows -> (record, grp, component).

    A record with several groups joins them. A record without any group is its own component. Nulls in record are
    dropped; repeated rows count once.
    """
    pairs = pairs.where("record IS NOT NULL").distinct()
    low = pairs.groupBy("record").agg(F.min("grp").alias("low"), F.max("grp").alias("high"))
    bridges = low.where("low < high").select("record", "low")
    edges = pairs.join(bridges, "record").where("grp <> low").select(F.col("low").alias("src"), F.col("grp").alias("dst")).distinct()
    labels = hash_to_min(edges).select(F.col("node").alias("low"), F.col("component").alias("joined"))
    of_record = low.join(labels, "low", "left").select("record", F.coalesce(F.concat(F.lit("g:"), F.coalesce("joined", "low")), F.concat(F.lit("r:"), F.col("record"))).alias("component"))
    return pairs.join(of_record, "record")


def assign_splits(pairs: DataFrame, weights: Mapping[str, float] = DEFAULT, salt: str = "split") -> DataFrame:
    """(record, grp) rows -> (record, grp, component, split)."""
    parts = related_components(pairs)
    return parts.withColumn("split", rendezvous(F.col("component"), weights, salt))


def role_conflicts(rows: DataFrame, assigned: DataFrame, held: str) -> DataFrame:
    """Records whose group has rows with role ``held`` and rows with another role.

    rows: (record, grp, role) canonical, all rows; null roles tell nothing, null groups are no cases. The
    components of ``assigned`` with mixed roles are the candidates; the groups inside them are then checked one by
    one, as a component may join a clean group to a mixed one.
    """
    role = rows.where("role IS NOT NULL AND grp IS NOT NULL").select("grp", (F.col("role") == held).alias("is_held"))
    by_group = role.groupBy("grp").agg(F.bool_or("is_held").alias("has_held"), F.bool_or(~F.col("is_held")).alias("has_other"))
    known = assigned.where("grp IS NOT NULL").select("grp", "component").distinct().join(by_group, "grp", "left")
    mixed = known.groupBy("component").agg(F.bool_or("has_held").alias("any_held"), F.bool_or("has_other").alias("any_other")).where("any_held AND any_other")
    bad = known.join(mixed.select("component"), "component", "left_semi").where("has_held AND has_other").select("grp")
    return assigned.where("record IS NOT NULL").join(bad, "grp", "left_semi").select("record").distinct()
