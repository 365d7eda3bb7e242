"""Problem 4: the same or nearly the same record in the training split and in an evaluation split.

Distinct gray views (copies collapsed) get a bit fingerprint. Permuted segments of the code are the keys of hash
tables, into which go the id, the whole code and a sketch of the view, not the view itself. Training and evaluation
views that share a key in any table, lie within a Hamming radius and whose sketches allow a distance within the limit
are candidates; their views are fetched once and compared exactly. Equal pixel hashes are an equi-join.

The sketch holds sums of two pixels each: sums never differ by more than their pixels do, so it refuses no true pair.

Recall of the tables: a pair with h different bits of 100 is missed by all with probability about
(1 - (1 - h/100)^width)^tables; the exact distance decides about every pair that is found. Keys get wider with the
number of views, so there are more tables then: a pair with up to 7 different bits is missed no more often than with
10 tables of 14 bits, at any number of views.

Keys that may hold more than ``hot`` rows (told by a count sketch over all keys) are split on both sides: training rows
by one hash, evaluation rows by another, every part of one side meets every part of the other in a task of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbago.llm.codes import PIXELS, ROOM, binary_matrix, bits, blob_matrix, blobs, buckets, distance, encoded, flat_cells, packed, pair_chunks, segments, task_count, view_ids
from plumbago.session import written

HOT = 20_000
#: Candidates have at most so many different bits of 100 (views of low contrast any number); a pair with more is hardly
#: ever brought together by the tables.
RADIUS = 30
GRID = 8
CODE, SKETCH = -(-PIXELS // 8), PIXELS // 2
LOAD = 9 + CODE + SKETCH  # id, flags, code, sketch


def width_for(rows: int) -> int:
    """Bits of a key: about one view a bucket by chance, between 14 and 30."""
    return max(14, min(30, math.ceil(math.log2(max(rows, 2)))))


def tables_for(width: int, least: int = 10, bits: int = 7) -> int:
    """Tables that miss a pair with up to ``bits`` different bits no more often than ``least`` tables of 14 bits do."""
    hit = lambda w, h: math.log(1 - (1 - h / 100) ** w)
    return max(least, *(math.ceil(least * hit(14, h) / hit(width, h) - 1e-9) for h in range(1, bits + 1)))


def sketch(q: np.ndarray) -> np.ndarray:
    """Half the sum of each two pixels, rounded down, as one byte."""
    x = q.reshape(len(q), -1, 2)
    if q.dtype == np.uint8:
        return (x.astype(np.uint16).sum(2) >> 1).astype(np.uint8)
    return np.clip(np.floor(x.sum(2) / 2), 0, 255).astype(np.uint8)


def keyed_rows(q: np.ndarray, code: np.ndarray, tables: list[np.ndarray], limit: float, in_train: np.ndarray, in_eval: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, key, train, eval) by table; the key holds the table's number and the bits of its segment.

    One table more is for views of low contrast, whose bits say little: they meet by their mean, evaluation views also
    visit the neighbouring cells.
    """
    every = np.arange(len(q))
    for k, pixels in enumerate(tables):
        yield every, (np.int64(k) << 32) | packed(code[:, pixels]), in_train, in_eval
    flat, cell = flat_cells(q, limit)
    at, ev = np.flatnonzero(flat), np.flatnonzero(flat & in_eval)
    none = np.zeros(len(ev), bool)
    cells = np.concatenate([cell[at], cell[ev] - 1, cell[ev] + 1]) + (1 << 20)
    yield np.concatenate([at, ev, ev]), (np.int64(len(tables)) << 32) | cells, np.concatenate([in_train[at], none, none]), np.concatenate([in_eval[at], ~none, ~none])


def _cells(key: np.ndarray, count: int) -> np.ndarray:
    x = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - count.bit_length() + 1)).astype(np.int64)


def _read(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    flag = lambda n: np.asarray(b.column(n).to_numpy(zero_copy_only=False), bool)
    q = binary_matrix(b.column("gray"))
    return q, bits(q), b.column("gid").to_numpy(), flag("in_train"), flag("in_eval")


def _counts(tables: list[np.ndarray], limit: float, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(cells, np.int64)
        for b in batches:
            if b.num_rows:
                q, code, _, tr, ev = _read(b)
                for _, key, _, _ in keyed_rows(q, code, tables, limit, tr, ev):
                    held += np.bincount(_cells(key, cells), minlength=cells)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["cell", "n"])

    return run


def hot_cells(classes: DataFrame, tables: list[np.ndarray], limit: float, rows: int, hot: int) -> tuple[np.ndarray, int]:
    """The cells of a count sketch over all keys that hold more than ``hot`` rows, and the number of cells.

    A key with more rows than ``hot`` is always in such a cell; a key with fewer may be, which only costs copies. A
    partition sends one row a cell at most; there are 16 cells for each ``hot`` keyed rows.
    """
    cells = 1 << max(12, math.ceil(math.log2(max(16 * rows * (len(tables) + 1) / hot, 1))))
    found = classes.select("gid", "in_train", "in_eval", "gray").mapInArrow(_counts(tables, limit, cells), "cell long, n long")
    over = found.groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > hot).select("cell").collect()  # at most cells / 16 of them
    return np.array(sorted(r[0] for r in over), np.int64), cells


def _keyed(tables: list[np.ndarray], hot: np.ndarray, cells: int, limit: float):
    def rows(key: np.ndarray, block: np.ndarray, at: np.ndarray, load: np.ndarray, flags: np.ndarray) -> pa.RecordBatch:
        own = load[at]
        own[:, 8] = flags
        return pa.RecordBatch.from_arrays([pa.array((key << 6) | block), blobs(own)], ["key", "load"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            q, code, gid, in_train, in_eval = _read(b)
            load = np.concatenate([gid.astype("<i8").view(np.uint8).reshape(-1, 8), np.zeros((len(q), 1), np.uint8), np.packbits(code, axis=1), sketch(q)], axis=1)
            for at, key, tr, ev in keyed_rows(q, code, tables, limit, in_train, in_eval):
                is_hot = np.isin(_cells(key, cells), hot) if len(hot) else np.zeros(len(at), bool)
                c = ~is_hot
                yield rows(key[c], np.zeros(c.sum(), np.int64), at[c], load, tr[c] + 2 * ev[c])
                if not is_hot.any():
                    continue
                part = np.abs(gid[at] % GRID)
                for side, flag in ((tr, 1), (ev, 2)):
                    h = np.flatnonzero(is_hot & side)
                    own, other = np.repeat(part[h], GRID), np.tile(np.arange(GRID), len(h))
                    yield rows(np.repeat(key[h], GRID), own * GRID + other if flag == 1 else other * GRID + own, np.repeat(at[h], GRID), load, np.uint8(flag))

    return run


def _candidates(limit: float, radius: int, tables: int):
    most = limit * 255 * PIXELS / 2 + SKETCH + 1  # rounding of each sum costs less than 1

    def work(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        load = blob_matrix(t["load"], LOAD)
        gid = np.ascontiguousarray(load[:, :8]).view("<i8").ravel()
        tr, ev = (load[:, 8] & 1) > 0, (load[:, 8] & 2) > 0
        flat = t["key"].to_numpy() >> 38 == tables  # met by their mean: the radius says nothing there
        code, own = np.ascontiguousarray(load[:, 9 : 9 + CODE]), np.ascontiguousarray(load[:, 9 + CODE :])
        bucket = np.zeros(len(load), np.int64)
        bucket[starts[1:]] = 1
        bucket = np.cumsum(bucket)
        trains = np.flatnonzero(tr)
        first = np.searchsorted(bucket[trains], np.arange(len(starts)), "left")
        count = np.searchsorted(bucket[trains], np.arange(len(starts)), "right") - first
        evals = np.flatnonzero(ev)
        found = []
        for i, k in pair_chunks(first[bucket[evals]], count[bucket[evals]], evals):
            j = trains[k]
            near = np.flatnonzero(flat[i] | (np.bitwise_count(code[i] ^ code[j]).sum(1, dtype=np.int32) <= radius))
            i, j = i[near], j[near]
            a, b = own[i], own[j]
            ok = ((np.maximum(a, b) - np.minimum(a, b)).sum(1, dtype=np.uint32) <= most) & (gid[i] != gid[j])
            if ok.any():
                found.append(np.unique(np.stack([gid[j[ok]], gid[i[ok]]], 1), axis=0))
        if found:
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["train_gid", "eval_gid"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from buckets(batches, ["key"], work)

    return run


def _exact(limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n = b.num_rows
                d = distance(binary_matrix(pa.concat_arrays([b.column("train_gray"), b.column("eval_gray")])), np.arange(n), np.arange(n, 2 * n))
                ok = pa.array(d <= limit + ROOM)
                yield pa.RecordBatch.from_arrays([b.column("train_gid").filter(ok), b.column("eval_gid").filter(ok), pa.array(d).filter(ok)], ["train_gid", "eval_gid", "dist"])

    return run


def view_classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, rows with gid): one row per distinct gray view (gid, gray, in_train, in_eval), and the rows that have it."""
    views = written(rows.where("gray IS NOT NULL AND (is_train OR is_eval)").groupBy("gray").agg(F.bool_or("is_train").alias("in_train"), F.bool_or("is_eval").alias("in_eval")), "overlap-classes")
    gid = view_ids(views)
    return views.withColumn("gid", gid("gray")), rows.withColumn("gid", F.when(F.col("gray").isNotNull(), gid("gray")))


def similar_classes(classes: DataFrame, limit: float, tables: int | None = None, width: int | None = None, hot: int = HOT, radius: int = RADIUS) -> DataFrame:
    """(train_gid, eval_gid, dist) of the different views within ``limit`` of each other."""
    spark = classes.sparkSession
    n = classes.count()
    if width is None:
        width = width_for(n)
    if tables is None:
        tables = tables_for(width)
    pixels = segments(tables, width)
    over, cells = hot_cells(classes, pixels, limit, n, hot)
    keyed = classes.select("gid", "in_train", "in_eval", "gray").mapInArrow(_keyed(pixels, over, cells, limit), "key long, load binary")
    grouped = keyed.repartition(task_count(spark, n * (tables + 1), 90), "key").sortWithinPartitions("key")
    found = grouped.mapInArrow(_candidates(limit, radius, tables), "train_gid long, eval_gid long").distinct()
    side = lambda s: classes.where(f"in_{s}").select(F.col("gid").alias(f"{s}_gid"), F.col("gray").alias(f"{s}_gray"))
    return found.join(side("train"), "train_gid").join(side("eval"), "eval_gid").mapInArrow(_exact(limit), "train_gid long, eval_gid long, dist double")


def with_roles(rows: DataFrame, evaluation: tuple[str, ...] = ("calibration", "test")) -> DataFrame:
    return rows.withColumns({"is_train": F.coalesce(F.col("role") == "train", F.lit(False)), "is_eval": F.coalesce(F.col("role").isin(*evaluation), F.lit(False))}).where("is_train OR is_eval")


def class_links(rows: DataFrame, limit: float, tables: int | None, width: int | None, hot: int) -> tuple[DataFrame, DataFrame]:
    """((train_gid, eval_gid, dist) of linked views, equal ones included; the rows with their gid)."""
    classes, known = view_classes(rows)
    near = similar_classes(classes, limit, tables, width, hot)
    both = classes.where("in_train AND in_eval").select(F.col("gid").alias("train_gid"), F.col("gid").alias("eval_gid"), F.lit(0.0).alias("dist"))
    return near.unionByName(both), known


def cross_split_pairs(items: DataFrame, limit: float = 0.02, tables: int | None = None, width: int | None = None, hot: int = HOT, evaluation: tuple[str, ...] = ("calibration", "test")) -> DataFrame:
    """(train_id, eval_id, dist, by_hash) for every pair of ids in train and evaluation rows that overlap.

    A pair has the same pixel hash, or gray views with a mean absolute difference of at most ``limit``. Missing or
    malformed hashes, views and roles match nothing; repeated rows count once; an id that is in both splits is paired
    with itself. base_char is not read. An empty table gives no rows.
    """
    rows = written(with_roles(encoded(items, False), evaluation), "overlap-rows")
    links, known = class_links(rows, limit, tables, width, hot)
    by = known.select("sample_id", "hash", "is_train", "is_eval", "gid")
    hashed = by.where("hash IS NOT NULL").select("hash", "sample_id", "is_train", "is_eval").distinct()
    same = hashed.where("is_train").select("hash", F.col("sample_id").alias("train_id")).join(hashed.where("is_eval").select("hash", F.col("sample_id").alias("eval_id")), "hash").select("train_id", "eval_id", F.lit(None).cast("double").alias("dist"), F.lit(True).alias("by_hash"))
    members = by.where("gid IS NOT NULL").select("gid", "sample_id", "is_train", "is_eval").distinct()
    train = members.where("is_train").select(F.col("gid").alias("train_gid"), F.col("sample_id").alias("train_id"))
    held = members.where("is_eval").select(F.col("gid").alias("eval_gid"), F.col("sample_id").alias("eval_id"))
    viewed = links.join(train, "train_gid").join(held, "eval_gid").select("train_id", "eval_id", "dist", F.lit(False).alias("by_hash"))
    return same.unionByName(viewed).groupBy("train_id", "eval_id").agg(F.min("dist").alias("dist"), F.bool_or("by_hash").alias("by_hash"))


def _atoms(rows: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
    """Ids with one (hash, view) are counted together, an id with several stands for itself.

    (atom, hash, gid) without repeats, and (sample_id, atom).
    """
    own = rows.where(f"is_{side}").select("sample_id", "hash", "gid").distinct()
    one = F.concat_ws("|", F.lit("c"), F.coalesce("hash", F.lit("")), F.coalesce(F.col("gid").cast("string"), F.lit("")))
    atom = own.groupBy("sample_id").agg(F.when(F.count("*") > 1, F.concat(F.lit("i|"), F.col("sample_id"))).otherwise(F.first(one)).alias("atom"))
    return own.join(atom, "sample_id").select("atom", "hash", "gid").distinct(), atom


def overlap_report(items: DataFrame, limit: float = 0.02) -> DataFrame:
    """Overlapping evaluation records per role and source.

    One row per (role, source_group_id, asset): the pairs and the distinct evaluation ids in them. A record with
    several source assets counts under each; without any, under null. Pairs are counted between classes of records with
    the same hash and view, never listed: copies that are a third of all rows are one class.
    """
    links, known = class_links(written(with_roles(encoded(items)), "overlap-rows"), limit, None, None, HOT)
    train, train_ids = _atoms(known, "train")
    held, held_ids = _atoms(known, "eval")
    held_ids = written(held_ids, "overlap-atoms")
    weight = train_ids.groupBy("atom").agg(F.count("*").alias("n")).withColumnRenamed("atom", "train_atom")
    t, e = train.withColumnRenamed("atom", "train_atom"), held.withColumnRenamed("atom", "eval_atom")
    hashed = t.where("hash IS NOT NULL").select("train_atom", "hash").distinct().join(e.where("hash IS NOT NULL").select("eval_atom", "hash").distinct(), "hash")
    viewed = links.join(t.select("train_atom", F.col("gid").alias("train_gid")).distinct(), "train_gid").join(e.select("eval_atom", F.col("gid").alias("eval_gid")).distinct(), "eval_gid")
    pairs = hashed.select("train_atom", "eval_atom").unionByName(viewed.select("train_atom", "eval_atom")).distinct().join(weight, "train_atom")
    per_record = pairs.groupBy(F.col("eval_atom").alias("atom")).agg(F.sum("n").alias("pairs")).join(held_ids, "atom").select("sample_id", "pairs")
    source = known.where("is_eval").select("sample_id", "role", "source_group_id", F.explode_outer("source_asset_ids").alias("asset")).distinct()
    return per_record.join(source, "sample_id").groupBy("role", "source_group_id", "asset").agg(F.sum("pairs").alias("n_pairs"), F.count_distinct("sample_id").alias("n_records"))
