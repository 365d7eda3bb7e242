"""Vector retrieval: unit vectors, class centres, nearest class with runner-up, own-class neighbours, statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """The vector over its norm; null for norms up to 1e-12."""
    n = norm(v)
    return F.when(n > 1e-12, F.transform(v, lambda x: x.cast("double") / n))


def class_centres(df: DataFrame, label: str, vector: str) -> DataFrame:
    """One unit centre per class: (label, proto, centre) from per-dimension means, aggregated map-side."""
    flat = df.select(label, F.posexplode(unit(F.col(vector))).alias("dim", "value"))
    mean = flat.groupBy(label, "dim").agg(F.avg("value").alias("value"))
    packed = mean.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda e: e["value"]).alias("mean"))  # one vector a class
    return packed.select(label, F.lit(0).alias("proto"), unit(F.col("mean")).alias("centre"))


def kmeans_centres(df: DataFrame, label: str, vector: str, key: str, most: int = 8, rounds: int = 10, most_centres: int = 50_000, seeds: int = 128) -> DataFrame:
    """Up to min(most, floor(sqrt n)) unit centres per class by Lloyd rounds over all vectors of the class.

    Every round each partition sums its vectors by nearest centre, so only one sum per partition and centre leaves it; the
    bank of centres is held by the driver (its size is checked). The first centres are picked greedily, each for the
    largest fall of the square distances, from the ``seeds`` vectors of a class with the lowest key hashes. Classes of
    fewer than four rows get their mean.
    """
    kind = dict(df.dtypes)[label]
    name = F.to_json(F.struct(F.col(label).alias("l")))  # one string a class, null included
    units = df.select(name.alias("lab"), F.xxhash64(key).alias("h"), unit(F.col(vector)).alias("u")).where("u IS NOT NULL")
    names = {r["lab"]: r["l"] for r in df.select(name.alias("lab"), F.col(label).alias("l")).distinct().limit(most_centres + 1).collect()}
    if len(names) > most_centres:
        raise ValueError("the prototype bank is larger than its bound")

    def lowest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = pd.DataFrame({"lab": [], "h": [], "u": []}), {}
        for pdf in frames:
            for lab, c in pdf["lab"].value_counts().items():
                n[lab] = n.get(lab, 0) + c
            held = pd.concat([held, pdf]) if len(held) else pdf
            held = held.sort_values("h", kind="stable").groupby("lab").head(seeds)
        if len(held):
            yield held.assign(n=held["lab"].map(n).where(~held["lab"].duplicated(), 0))  # the count once a class

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        total = int(pdf["n"].sum())
        x = np.stack(pdf.assign(t=pdf["u"].map(tuple)).sort_values(["h", "t"])["u"].head(seeds).to_numpy())
        k = min(most, max(1, int(np.sqrt(total)))) if total >= 4 else 1
        gap = 2 - 2 * np.clip(x @ x.T, -1, 1)
        chosen, left = [0], gap[0]
        while len(chosen) < k and left.max() > 1e-12:
            chosen.append(int(np.minimum(gap, left).sum(1).argmin()))
            left = np.minimum(left, gap[chosen[-1]])
        return pd.DataFrame({"lab": pdf["lab"].iloc[0], "proto": range(len(chosen)), "c": list(x[chosen])})

    picked = units.mapInPandas(lowest, "lab string, h long, u array<double>, n long")
    bank: dict[str, np.ndarray] = {}
    for r in sorted(picked.groupBy("lab").applyInPandas(first, "lab string, proto int, c array<double>").limit(most_centres + 1).collect(), key=lambda r: (r["lab"], r["proto"])):
        bank.setdefault(r["lab"], []).append(r["c"])  # type: ignore[arg-type]
    bank = {lab: np.array(c) for lab, c in bank.items()}
    if sum(map(len, bank.values())) > most_centres:
        raise ValueError("the prototype bank is larger than its bound")

    def one_round(shared):
        def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[tuple[str, int], list] = {}
            for pdf in frames:
                for lab, own in pdf.groupby("lab"):
                    x, c = np.stack(own["u"].to_numpy()), shared.value[lab]
                    at = np.argmax(x @ c.T - 0.5 * (c * c).sum(1), axis=1)
                    for j in np.unique(at):
                        was = total.setdefault((lab, int(j)), [0, 0.0])
                        was[0], was[1] = was[0] + int((at == j).sum()), was[1] + x[at == j].sum(0)
            if total:
                yield pd.DataFrame({"lab": [k[0] for k in total], "proto": [k[1] for k in total], "n": [v[0] for v in total.values()], "s": [v[1] for v in total.values()]})

        return sums

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        c = np.sum(np.stack(pdf["s"].to_numpy()), axis=0) / pdf["n"].sum()
        return pd.DataFrame({"lab": pdf["lab"].iloc[:1], "proto": pdf["proto"].iloc[:1], "c": [c]})

    for _ in range(rounds if bank else 0):
        shared = df.sparkSession.sparkContext.broadcast(bank)
        part = units.select("lab", "u").mapInPandas(one_round(shared), "lab string, proto int, n long, s array<double>")
        moved = {lab: c.copy() for lab, c in bank.items()}
        for r in part.groupBy("lab", "proto").applyInPandas(mean, "lab string, proto int, c array<double>").collect():  # at most the bank
            moved[r["lab"]][r["proto"]] = r["c"]
        shared.unpersist()
        still = all(np.abs(moved[lab] - c).max() < 1e-12 for lab, c in bank.items())
        bank = moved
        if still:
            break
    rows = [(names[lab], j, (v / max(float(np.linalg.norm(v)), 1e-12)).tolist()) for lab, c in bank.items() for j, v in enumerate(c)]
    return df.sparkSession.createDataFrame(rows, f"`{label}` {kind}, proto int, centre array<double>")


def nearest_class(df: DataFrame, key: str, vector: str, centres: DataFrame, label: str, most_centres: int = 50_000) -> DataFrame:
    """(key, nearest, distance, second, margin): best class and best other class by cosine distance over all centres.

    The bank is collected once (its size is checked) and multiplied with Arrow batches of vectors; second and margin are
    infinite with a single class. Vectors that are null or of norm 0 give nulls.
    """
    bank = centres.select(label, "centre").limit(most_centres + 1).collect()
    if len(bank) > most_centres:
        raise ValueError("the prototype bank is larger than its bound")
    if not bank:
        raise ValueError("the prototype bank is empty")
    names = sorted({r[0] for r in bank})
    at = {n: k for k, n in enumerate(names)}
    order = sorted(range(len(bank)), key=lambda i: at[bank[i][0]])
    matrix = np.array([bank[i][1] for i in order], float)
    starts = np.searchsorted([at[bank[i][0]] for i in order], np.arange(len(names)))
    shared = df.sparkSession.sparkContext.broadcast((names, matrix, starts))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, m, s = shared.value
        for pdf in frames:
            good = pdf["u"].notna().to_numpy()
            out = pd.DataFrame({"key": pdf["key"], "nearest": pd.Series([None] * len(pdf), dtype=object), "distance": np.nan, "second": np.nan})
            if good.any():
                d = 1 - np.stack(pdf["u"][good].to_numpy()) @ m.T
                per = np.minimum.reduceat(d, s, axis=1)
                best = per.argmin(1)
                rows = np.arange(len(per))
                dist = per[rows, best]
                per[rows, best] = np.inf
                out.loc[good, "nearest"] = np.array(own, dtype=object)[best]
                out.loc[good, "distance"] = dist
                out.loc[good, "second"] = per.min(1)
            yield out

    kinds = dict(df.dtypes)
    got = df.select(F.col(key).alias("key"), unit(F.col(vector)).alias("u")).mapInPandas(run, f"key {kinds[key]}, nearest {dict(centres.dtypes)[label]}, distance double, second double")
    return got.select(F.col("key").alias(key), "nearest", "distance", "second", (F.col("second") - F.col("distance")).alias("margin"))


def own_class_neighbour(queries: DataFrame, references: DataFrame, key: str, label: str, vector: str, block: int = 4096) -> DataFrame:
    """(key, neighbour, distance): nearest reference of the same class by cosine distance, the smaller key on ties.

    References of a class are cut into blocks by hash so that a large class is spread over tasks; each query visits all
    blocks of its class. A block is multiplied as a matrix in Arrow batches, only the best of each block leaves it.
    """
    kinds = dict(references.dtypes)
    per_class = references.groupBy(F.col(label).alias("lab")).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    side = lambda df, asked: df.select(F.col(label).alias("lab"), F.col(key).alias("key"), unit(F.col(vector)).alias("u"), F.lit(asked).alias("asked")).where("u IS NOT NULL").join(per_class, "lab")
    refs = side(references, False).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    asked = side(queries, True).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[~pdf["asked"]].sort_values("key", kind="stable")
        out = []
        if len(own):
            m, ids = np.stack(own["u"].to_numpy()), own["key"].to_numpy()
            ask = pdf[pdf["asked"]]
            for at in range(0, len(ask), 1024):
                part = ask.iloc[at : at + 1024]
                d = np.round(1 - np.stack(part["u"].to_numpy()) @ m.T, 12)
                d[part["key"].to_numpy()[:, None] == ids[None]] = np.inf
                k = d.argmin(1)
                ok = np.isfinite(d[np.arange(len(k)), k])
                out.append(pd.DataFrame({"q": part["key"].to_numpy()[ok], "ref": ids[k[ok]], "d": d[np.arange(len(k)), k][ok]}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "ref": [], "d": []})

    pairs = refs.unionByName(asked).groupBy("lab", "block").applyInPandas(best, f"q {kinds[key]}, ref {kinds[key]}, d double")
    low = pairs.groupBy("q").agg(F.min(F.struct("d", "ref")).alias("b"))
    return low.select(F.col("q").alias(key), F.col("b.ref").alias("neighbour"), F.col("b.d").alias("distance"))


def own_centre_distance(df: DataFrame, centres: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """(key, centre_distance): cosine distance to the nearest centre of the vector's own class; none, none. The bank is
    one row a prototype; AQE broadcasts it where it is small."""
    bank = centres.select(F.col(label).alias("__l"), F.col("centre").alias("__c"))
    j = df.select(key, label, unit(F.col(vector)).alias("__u")).join(bank, F.col(label) == F.col("__l"))
    return j.groupBy(key).agg(F.min(1 - dot(F.col("__u"), F.col("__c"))).alias("centre_distance"))


def embedding_drift(before: DataFrame, after: DataFrame, key: str, vector: str, least_variance: float = 1e-4) -> DataFrame:
    """Rows on both sides, mean and largest cosine distance between the two vectors of a key, and whether the later ones
    have collapsed (mean variance over dimensions below the bound). One row."""
    j = before.select(key, unit(F.col(vector)).alias("a")).join(after.select(key, unit(F.col(vector)).alias("b")), key)
    drift = j.agg(F.count("*").alias("rows"), F.avg(1 - dot(F.col("a"), F.col("b"))).alias("drift_mean"), F.max(1 - dot(F.col("a"), F.col("b"))).alias("drift_max"))
    spread = after.select(F.posexplode(vector).alias("dim", "value")).groupBy("dim").agg(F.var_pop(F.col("value").cast("double")).alias("v")).agg((F.avg("v") < least_variance).alias("collapsed"))
    return drift.crossJoin(F.broadcast(spread))  # one row each


def embedding_statistics(df: DataFrame, vector: str) -> DataFrame:
    """Rows, mean over dimensions of the population variance, mean and deviation of the norms."""
    flat = df.select(F.posexplode(vector).alias("dim", "value")).groupBy("dim").agg(F.var_pop(F.col("value").cast("double")).alias("v"))
    spread = flat.agg(F.avg("v").alias("mean_variance"))
    norms = df.agg(F.count("*").alias("rows"), F.avg(norm(F.col(vector))).alias("norm_mean"), F.stddev_pop(norm(F.col(vector))).alias("norm_std"))
    return norms.crossJoin(F.broadcast(spread))  # one row each


def top_per_class(df: DataFrame, label: str, order: Column, key: str, n: int = 1) -> DataFrame:
    w = Window.partitionBy(label).orderBy(order, key)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
