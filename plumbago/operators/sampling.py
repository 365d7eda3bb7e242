"""Hash-ordered holdouts, splits, batches and slot plans. Orders come from SHA-256 of (seed, id), never from a generator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbago.operators.blocked import lowest, running_sum


def seeded(seed: int | str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def unit_interval(digest: Column) -> Column:
    """The first 13 hex digits as a number in 0..1."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)


def seed63(digest: Column) -> Column:
    """The first 8 bytes, big-endian, without the top bit."""
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))
    return F.shiftleft(high, 32).bitwiseOR(F.conv(F.substring(digest, 9, 8), 16, 10).cast("long"))


def hash_holdout(df: DataFrame, key: str, group: str, fraction: float, seed: int) -> DataFrame:
    """(key, group, chosen): of each group of n keys the min(n - 1, max(1, round-half-even(n x fraction))) lowest hashes."""
    keys = df.select(key, group).distinct().withColumn("h", seeded(seed, F.col(key)))
    n = keys.groupBy(group).agg(F.count("*").alias("n")).withColumn("quota", F.least(F.col("n") - 1, F.greatest(F.lit(1), F.bround(F.col("n") * fraction).cast("long"))))
    block = F.conv(F.substring("h", 1, 3), 16, 10).cast("int")
    return lowest(keys, group, block, [F.col("h"), F.col(key)], n, "quota").select(key, group, "chosen")


def hash_split(df: DataFrame, key: str, parts: Sequence[str], share: float) -> DataFrame:
    digest = F.sha2(F.concat_ws("\0", *[F.col(p).cast("string") for p in parts]), 256)
    return df.select(key, F.when(unit_interval(digest) < share, "train").otherwise("validation").alias("split"))


def paired_batches(df: DataFrame, key: str, group: str, seed: int) -> DataFrame:
    """Consecutive pairs of each group in hash order, an odd last row paired with the first: (group, pair, a, b).

    Groups of one row give no pair. Groups are characters or classes; the order is inside a group.
    """
    w = Window.partitionBy(group).orderBy("h", key)
    r = df.select(key, group, seeded(seed, F.col(key)).alias("h")).withColumns({"rn": F.row_number().over(w), "nxt": F.lead(key).over(w), "first": F.first(key).over(w)})
    odd = r.where("rn % 2 = 1").where("nxt IS NOT NULL OR rn > 1")
    return odd.select(group, ((F.col("rn") + 1) / 2).cast("long").alias("pair"), F.col(key).alias("a"), F.coalesce("nxt", "first").alias("b"))


def pair_exposure(batches: DataFrame, epoch: str, batch: str, group: str) -> DataFrame:
    """Per epoch: rows, rows in groups of two or more, pairs inside groups, batches without any pair."""
    n = batches.groupBy(epoch, batch, group).agg(F.count("*").alias("n"))
    per = n.groupBy(epoch, batch).agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("eligible"), F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"))
    return per.groupBy(epoch).agg(F.sum("rows").alias("rows"), F.sum("eligible").alias("eligible"), F.sum("pairs").alias("pairs"), F.count_if(F.col("pairs") == 0).alias("empty_batches"))


def slot_plan(characters: DataFrame, column: str, roles: Sequence[str], operators: Sequence[str], replicas: int, seed: int) -> DataFrame:
    """Every character x role x operator x replica with a stable 63-bit seed; the small sides are exploded, not joined."""
    s = characters.select(F.col(column).alias("character")).distinct()
    for name, values in (("role", roles), ("operator", operators)):
        s = s.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    s = s.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
    return s.withColumn("seed", seed63(seeded(seed, F.col("character"), F.col("role"), F.col("operator"), F.col("replica"))))


def bounded_retry(slots: DataFrame, attempts: int, accept: Column) -> DataFrame:
    """First accepted attempt of each slot (null if none of ``attempts``) and the number of tries. ``accept`` may use the
    column ``attempt``. Attempts are bounded and small; their rows are combined map-side."""
    tries = slots.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1)))).withColumn("__ok", accept)
    keys = slots.columns
    out = tries.groupBy(*keys).agg(F.min(F.when(F.col("__ok"), F.col("attempt"))).alias("accepted"))
    return out.withColumn("tries", F.coalesce(F.col("accepted") + 1, F.lit(attempts)))


def quota_accounting(done: DataFrame, by: Sequence[str]) -> DataFrame:
    g = done.groupBy(*by).agg(F.count("*").alias("expected"), F.count("accepted").alias("actual"), F.sum("tries").alias("attempts"))
    return g.withColumns({"skipped": F.col("expected") - F.col("actual"), "complete": F.col("expected") == F.col("actual")})


def numbered(df: DataFrame, key: str, seed: int, name: str = "position") -> DataFrame:
    """A seeded shuffle: every row's place 0.. in the order of the hash of (seed, key), ranked by blocks."""
    h = df.withColumn("__h", seeded(seed, F.col(key)))
    return running_sum(h, [], F.conv(F.substring("__h", 1, 4), 16, 10).cast("int"), [F.col("__h"), F.col(key)], F.lit(1), name).withColumn(name, F.col(name).cast("long")).drop("__h")


def random_batches(df: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """(key, batch, place): consecutive batches of a seeded shuffle; the last one may be short."""
    return numbered(df.select(key), key, seed).select(key, F.expr(f"position div {size}").alias("batch"), (F.col("position") % size).cast("int").alias("place"))


def composed_batches(pairs: DataFrame, others: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """(batch, slot, kind, a, b): batches of size / 4 pairs and size / 2 other rows, as many as the longer side needs; the
    shorter side starts again (its place is the slot's number modulo its length). An empty side gives no batches.

    pairs: (a, b); others: (key). Slots are computed from ranges and joined by place, nothing is cycled on the driver.
    """
    spark = pairs.sparkSession
    p = numbered(pairs.select("a", "b").withColumn("__k", F.concat_ws("|", "a", "b")), "__k", seed + 1, "at").drop("__k")
    o = numbered(others.select(F.col(key).alias("a")), "a", seed + 2, "at").withColumn("b", F.lit(None).cast(dict(others.dtypes)[key]))
    sides = (("pair", p, pairs.count(), size // 4), ("other", o, others.count(), size // 2))
    if not all(n for _, _, n, _ in sides):
        return p.selectExpr("at AS batch", "0 AS slot", "'pair' AS kind", "a", "b").limit(0)
    batches = max(-(-n // slots) for _, _, n, slots in sides)
    out = None
    for kind, rows, n, slots in sides:
        at = spark.range(batches * slots).select(F.expr(f"id div {slots}").alias("batch"), (F.col("id") % slots).cast("int").alias("slot"), (F.col("id") % n).alias("at"))
        one = at.join(rows, "at").select("batch", "slot", F.lit(kind).alias("kind"), "a", "b")
        out = one if out is None else out.unionByName(one)
    return out


def zipped(left: DataFrame, right: DataFrame, position: str) -> DataFrame:
    """Rows side by side by their position; a position on one side only is an error row (null there), never shifted."""
    return left.join(right, position, "full_outer")
