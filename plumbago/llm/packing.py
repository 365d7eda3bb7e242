"""Problem 6: fill containers of fixed capacity by the sum-of-squares rule.

A document goes where the sum over residual gaps of (open bins with this gap)^2 grows least. Documents are cut into
shards of bounded size by the hash of their id; each shard is packed on its own in hash order, then the containers
that stayed more than half empty are opened again and repacked together across shards, level by level.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbago.session import written

SHARD = 20_000
FAN = 16
PLACED = "container_name string, capacity int, shard long, bin long, doc_id long, piece int, start_token long, n_tokens long"


def sum_of_squares(sizes: Sequence[int], capacity: int) -> np.ndarray:
    """Bin number of each size (all between 1 and ``capacity``), in the order given.

    Moving a bin from gap g to g - s changes the sum by -2 N[g] + 1 and, unless it is then full, by 2 N[g - s] + 1. Of
    equal choices the smallest gap wins; a bin is opened only if that is strictly better or no gap fits.
    """
    count = np.zeros(capacity + 1, np.int64)
    stacks: dict[int, list[int]] = {}
    out = np.empty(len(sizes), np.int64)
    opened = 0
    for k, s in enumerate(sizes):
        after = 2 * count[: capacity - s + 1] + 1  # by the gap left, 0 .. capacity - s
        after[0] = 0
        change = np.where(count[s:] > 0, after - 2 * count[s:] + 1, np.iinfo(np.int64).max)
        best = int(np.argmin(change))
        gap = best + s
        if change[best] == np.iinfo(np.int64).max or (gap != capacity and after[capacity - s] < change[best]):
            gap, out[k] = capacity, opened
            opened += 1
        else:
            out[k] = stacks[gap].pop()
            count[gap] -= 1
        left = gap - s
        if left:
            count[left] += 1
            stacks.setdefault(left, []).append(int(out[k]))
    return out


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["order", "doc_id", "piece"], kind="stable")
    capacity = int(pdf["capacity"].iloc[0])
    pdf["bin"] = sum_of_squares(pdf["n_tokens"].to_list(), capacity)
    return pdf


def packed(sizes: DataFrame, containers: DataFrame, shard_rows: int = SHARD) -> DataFrame:
    """(doc_id, n_tokens) x (container_name, capacity_tokens) -> one row per container kind, document and piece.

    A document is split only if it alone exceeds the capacity: into whole containers and one remainder, which is packed
    like any document. Documents of no tokens (null or empty text) get a row without container. Container kinds with a
    null or not positive capacity are ignored; a doc_id given twice is packed twice; empty input gives no rows.
    """
    kinds = [(r[0], int(r[1])) for r in containers.select("container_name", "capacity_tokens").where("capacity_tokens > 0").distinct().limit(1001).collect()]
    if len(kinds) > 1000:
        raise ValueError("more than 1,000 kinds of containers")
    if not kinds:
        return sizes.sparkSession.createDataFrame([], PLACED.replace("shard long, bin long", "container_id string"))
    kind = F.explode(F.array(*[F.struct(F.lit(n).alias("container_name"), F.lit(c).alias("capacity")) for n, c in kinds]))
    base = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("total"), kind.alias("k")).select("doc_id", "total", "k.*")
    base = base.withColumn("order", F.xxhash64("doc_id"))
    pieces = F.explode_outer(F.when(F.col("total") > 0, F.sequence(F.lit(0), ((F.col("total") - 1) / F.col("capacity")).cast("int"))))
    cut = base.withColumn("piece", pieces).withColumn("start_token", (F.col("piece") * F.col("capacity")).cast("long"))
    cut = cut.withColumn("n_tokens", F.when(F.col("piece").isNotNull(), F.least(F.col("total") - F.col("start_token"), F.col("capacity").cast("long"))))
    cut = written(cut.select("container_name", "capacity", "doc_id", "piece", "start_token", "n_tokens", "order"), "pack-pieces")
    n = cut.where("n_tokens < capacity").count()
    shards = max(1, -(-n // (shard_rows * len(kinds))))
    loose = cut.where("n_tokens < capacity").withColumn("shard", F.pmod(F.col("order"), F.lit(shards)))
    whole = cut.where("n_tokens = capacity").withColumn("shard", F.lit(-1).cast("long")).withColumn("bin", F.xxhash64("doc_id", "piece"))
    cols = ["container_name", "capacity", "shard", "bin", "doc_id", "piece", "start_token", "n_tokens", "order"]
    schema = PLACED + ", order long"
    done = []
    level = 0
    while True:
        filled = written(loose.groupBy("container_name", "shard").applyInPandas(lambda p: _pack(p)[cols], schema), f"pack-level{level}")
        if shards == 1:
            done.append(filled.withColumn("level", F.lit(level)))
            break
        fill = filled.groupBy("container_name", "shard", "bin").agg((F.sum("n_tokens") * 2 < F.first("capacity")).alias("open"))
        marked = filled.join(fill, ["container_name", "shard", "bin"])
        done.append(marked.where("NOT open").drop("open").withColumn("level", F.lit(level)))
        shards = -(-shards // FAN)
        loose = marked.where("open").select(*[c for c in cols if c not in ("shard", "bin")], F.pmod(F.col("order"), F.lit(shards)).alias("shard"))
        level += 1
    out = whole.select(*cols).withColumn("level", F.lit(-1))
    for d in done:
        out = out.unionByName(d.select(*cols, "level"))
    out = out.withColumn("container_id", F.concat_ws("-", "level", "shard", "bin"))
    empty = cut.where("n_tokens IS NULL").withColumn("container_id", F.lit(None).cast("string"))
    final = ["container_name", "capacity", "container_id", "doc_id", "piece", "start_token", "n_tokens"]
    return out.select(*final).unionByName(empty.select(*final))


def usage(placed: DataFrame) -> DataFrame:
    """Per kind: containers, tokens, and the share of the room that is used."""
    real = placed.where("container_id IS NOT NULL")
    boxes = real.groupBy("container_name", "capacity", "container_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("pieces"))
    out = boxes.groupBy("container_name", "capacity").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.sum("pieces").alias("pieces"))
    return out.withColumn("used_share", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))
