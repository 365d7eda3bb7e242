"""Problem 1: a sample that stays the same as data grows.

The state is a persisted ledger with one row per key ever seen: (key, delivery, priority, chosen). A new delivery
never touches earlier rows: they are kept by a join on the key, and the growth quota is filled from unseen keys
with the lowest hash priority. The quota after delivery k is round(rate x keys seen up to k), so the sample has the
given rate at every delivery and is a superset of each earlier one. Nothing depends on the order or partitioning
of the rows, and all rows of one key are treated alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbago.llm.keys import canon_col
from plumbago.operators.blocked import lowest
from plumbago.session import written

LEDGER = "key string, delivery int, priority string, chosen boolean"
_NEWEST = 2**31 - 1


def priority(key: Column, salt: str) -> Column:
    return F.md5(F.concat(F.lit(salt + ":"), key).cast("binary"))


def quota_rows(counts: list[tuple[int, int, bool]], rate: float) -> list[tuple[int, int]]:
    """(delivery, quota) of the new deliveries among (delivery, keys, is_old): round(rate x keys up to it), less those before."""
    out, upto = [], 0
    for delivery, n, old in sorted(counts):
        was, upto = upto, upto + n
        if not old:
            out.append((delivery, math.floor(upto * rate + 0.5) - math.floor(was * rate + 0.5)))
    return out


def advance(ledger: DataFrame | None, rows: DataFrame, key: str, delivery: str, rate: float, salt: str = "sample", canonical: bool = True) -> DataFrame:
    """The ledger after the deliveries in ``rows``; several deliveries at once equal one at a time.

    ``rows`` needs only the columns ``key`` and ``delivery``; further columns are not read, whatever their names.
    Keys are compared by their canonical form; rows without a key are never sampled; a null delivery counts as the
    newest of ``rows``; repeated rows count once, at their first delivery. Deliveries not after the ledger's last
    one are taken as the next one (a ledger never reopens a quota). Empty rows leave the ledger as it is.

    The unseen keys are written once; the counts per delivery (one row a delivery) give the quotas.
    """
    # the ledger is read several times: hand in the stored one, not the plan that made it
    if not 0 <= rate <= 1:
        raise ValueError("rate must be between 0 and 1")
    spark = rows.sparkSession
    keyed = rows.select((canon_col(key) if canonical else F.col(key).cast("string")).alias("key"), F.col(delivery).cast("int").alias("delivery")).where("key IS NOT NULL")
    first = keyed.groupBy("key").agg(F.min("delivery").alias("delivery"))
    # null deliveries: the highest int until the newest delivery is known
    first = first.withColumn("delivery", F.coalesce("delivery", F.lit(_NEWEST)))
    counts: list[tuple[int, int, bool]] = []
    if ledger is not None:
        first = first.join(ledger.select("key"), "key", "left_anti")
        counts = [(r[0], r[1], True) for r in ledger.groupBy("delivery").agg(F.count("*")).collect()]
    fresh = written(first.withColumn("priority", priority(F.col("key"), salt)), "ledger-fresh")
    found = {r[0]: r[1] for r in fresh.groupBy("delivery").agg(F.count("*")).collect()}
    newest = (rows.agg(F.max(F.col(delivery).cast("int"))).first()[0] or 0) if _NEWEST in found else 0
    last = max((d for d, _, _ in counts), default=None)
    moved = {d: (newest if d == _NEWEST else d) if last is None else max(newest if d == _NEWEST else d, last + 1) for d in found}
    grown: dict[int, int] = {}
    for d, n in found.items():
        grown[moved[d]] = grown.get(moved[d], 0) + n
    quotas = spark.createDataFrame(quota_rows(counts + [(d, n, False) for d, n in grown.items()], rate), "delivery int, quota long")
    at = F.when(F.col("delivery") == _NEWEST, F.lit(newest)).otherwise(F.col("delivery"))
    placed = fresh.withColumn("delivery", at if last is None else F.greatest(at, F.lit(last + 1)))
    block = F.conv(F.substring("priority", 1, 4), 16, 10).cast("int")
    picked = lowest(placed, "delivery", block, [F.col("priority"), F.col("key")], quotas, "quota").select("key", "delivery", "priority", "chosen")
    return picked if ledger is None else ledger.select("key", "delivery", "priority", "chosen").unionByName(picked)


def store(ledger: DataFrame, path: str) -> DataFrame:
    """Write the next version of the ledger under ``path`` (a folder a version, visible only when complete); read it back."""
    versions = _versions(ledger.sparkSession, path)
    target = f"{path.rstrip('/')}/v{max(versions, default=0) + 1:08d}"
    ledger.select("key", "delivery", "priority", "chosen").write.parquet(target)
    return ledger.sparkSession.read.schema(LEDGER).parquet(target)


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete version under ``path``; None if there is none."""
    versions = _versions(spark, path)
    return spark.read.schema(LEDGER).parquet(f"{path.rstrip('/')}/v{max(versions):08d}") if versions else None


def _versions(spark: SparkSession, path: str) -> list[int]:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    folders = [s.getPath() for s in fs.listStatus(root) if s.isDirectory()]
    complete = [p.getName() for p in folders if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return [int(n[1:]) for n in complete if n[:1] == "v" and n[1:].isdigit()]


def sampled(rows: DataFrame, ledger: DataFrame, key: str, canonical: bool = True) -> DataFrame:
    """All rows whose key the ledger chose, with all their columns."""
    chosen = ledger.where("chosen").select(F.col("key").alias("__ledger_key"))
    keyed = rows.withColumn("__row_key", canon_col(key) if canonical else F.col(key).cast("string"))
    return keyed.join(chosen, keyed["__row_key"] == chosen["__ledger_key"], "left_semi").drop("__row_key")
