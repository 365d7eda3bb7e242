"""Connected components as a relation: hash-to-min over (node, neighbour) rows.

No cluster is ever held as an array: the neighbour set of a node is the set of its rows, so a component with a
third of all nodes is spread over the partitions like any other data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbago.session import dropped, written


def hash_to_min(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 40) -> DataFrame:
    """Label every node that occurs in ``edges`` with the smallest node of its component: (node, component).

    Each round every node sends its neighbour cluster to the cluster's minimum and the minimum to all members.
    Rows with a null end are ignored; self loops give a component of one; no edges give no rows. Works on any
    orderable node type. Raises if not stable after ``max_rounds`` (the rounds needed grow with the logarithm of
    the diameter).
    """
    pair = edges.select(F.col(src).alias("v"), F.col(dst).alias("u")).where("v IS NOT NULL AND u IS NOT NULL")
    v, u = F.col("v"), F.col("u")
    both = pair.select(F.explode(F.array(F.struct(v, u), F.struct(u.alias("v"), v.alias("u")), F.struct(v, v.alias("u")), F.struct(u.alias("v"), u))).alias("p"))
    state = written(both.select("p.*").distinct(), "components")
    seen = None
    for _ in range(max_rounds):
        low = state.groupBy("v").agg(F.min("u").alias("m"))
        sent = state.join(low, "v").select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct(F.col("m").alias("v"), F.col("u")))).alias("p"))
        nxt = written(sent.select("p.*").distinct(), "components")
        mark = nxt.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        dropped(state)
        state = nxt
        if mark == seen:
            return state.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))
        seen = mark
    raise RuntimeError(f"components not stable after {max_rounds} rounds")
