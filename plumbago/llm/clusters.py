"""Problem 5: clusters of mutually similar records.

Two uses of mergeable cluster features:

* ``threshold_clusters`` (glyph views): leaves (leader view, radius, members by link). Every partition first builds the
  leaves of its own rows, then rounds of shuffled hash buckets merge leaves of different partitions: a leaf takes in
  another one only if all members stay within ``cover`` of its leader, so a chain is never reduced to one row. The leaves
  that are left meet in many hash tables. Leaders within the limit are linked; leaders further apart, but not by more
  than the limit and both radii, are tested member by member. The links give the clusters by hash-to-min.
* ``feature_groups`` (crops by style): cluster-feature leaves (n, linear sum, square sum) by nearest leaf under a radius,
  a bounded number per partition and group, merged level by level, Ward agglomeration of the leaves, one assignment pass
  over all records, and the members nearest to each centroid.

Ward's criterion weighs sizes and can neither keep every link under a distance nor refuse one over it, so the clusters
by a distance limit take the leaves and the exact link test in its place (see the README).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbago.llm.codes import PIXELS, ROOM, binary_matrix, buckets, distance, encoded, flat_cells, packed, pair_chunks, task_count, view_ids
from plumbago.operators.components import hash_to_min
from plumbago.session import released, written

#: kind 0: a leaf (gid, gray, r); 1: gid was taken in by the leaf ``other``; 2: leaves to be tested by members; 3: linked.
LEAF = "kind int, gid long, gray binary, r float, other long"
BLOCK = 512
#: Radius of a leaf and of one of low contrast, as parts of the limit.
COVER, COVER_FLAT = 0.7, 0.25
#: Leaders further apart than so many limits are not tested by members: only two members that both lie at the far ends of
#: their leaves, in the direction of each other, could be linked then.
REACH = 2
#: Chance that one plane does not part two views at the limit (their angle is about 30 degrees at usual contrast).
SAME_SIDE = 0.833
TABLES = 28
#: Tables worked on at a time: bounds the disk the shuffles take, however many tables there are. Spark holds on to the files
#: of the last query, so those of two passes are there at a time.
PASS = 7


def tables_for(width: int, least: int = TABLES) -> int:
    """Tables that miss two leaders at the limit no more often than ``TABLES`` tables of 10 bits do, at any width."""
    miss = lambda w: math.log(1 - SAME_SIDE**w)
    return max(least, math.ceil(TABLES * miss(10) / miss(width) - 1e-9))


def _planes(seed: int, count: int, pixels: int = PIXELS) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((pixels, count)).astype(np.float32)


def _codes(q: np.ndarray, planes: np.ndarray) -> np.ndarray:
    x = q.astype(np.float32)
    return packed((x - x.mean(1, keepdims=True)) @ planes > 0)


def _cells_of(q: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Low-contrast leaves and the cell of their mean: leaves of low contrast that may hold a link are neighbours at most."""
    return flat_cells(q, limit * (1 + 2 * COVER_FLAT))


def _keyed(seeds: Sequence[int], width: int, limit: float, flats: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = [_planes(s, width) for s in seeds]
        for b in batches:
            if not b.num_rows:
                continue
            q = binary_matrix(b.column("gray"))
            for k, p in enumerate(planes):
                yield pa.RecordBatch.from_arrays([pa.array((np.int64(k + 1) << 41) | _codes(q, p)), *b.columns], ["key", *b.schema.names])
            if flats:  # low-contrast views also meet by their mean, each in its cell and the next one
                flat, cell = _cells_of(q, limit)
                at = np.flatnonzero(flat)
                for shift in (0, 1) if len(at) else ():
                    yield pa.RecordBatch.from_arrays([pa.array(cell[at] + shift), *[c.take(pa.array(at)) for c in b.columns]], ["key", *b.schema.names])

    return run


def local_labels(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Component labels (smallest index) of n nodes under edges (i, j), on top of the components of ``label``."""
    label = np.arange(n) if label is None else label
    while len(i):
        before = label.copy()
        low = np.minimum(label[i], label[j])
        for end in (i, j):
            np.minimum.at(label, before[end], low)
            np.minimum.at(label, end, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _all_pairs(q: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs of rows of the same bucket with their distance, in bounded pieces."""
    ends = np.r_[starts[1:], len(q)]
    rows = np.arange(len(q))
    last = np.repeat(ends, ends - starts)
    for i, j in pair_chunks(rows + 1, last - rows - 1, rows):
        yield i, j, distance(q, i, j)


def _near_pairs(q: np.ndarray, starts: np.ndarray, r: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components of the buckets' rows under the limit, and the pairs of rows of different components that the radii
    leave open (one, the nearest, for each two components)."""
    label, maybe = np.arange(len(q)), []
    for i, j, d in _all_pairs(q, starts):
        sure = d <= limit + ROOM
        new = sure & (label[i] != label[j])
        if new.any():
            label = local_labels(len(q), i[new], j[new], label)
        open_ = np.flatnonzero(~sure & (d <= np.minimum(limit + r[i] + r[j], REACH * limit) + ROOM))
        open_ = open_[label[i[open_]] != label[j[open_]]]
        if len(open_):
            maybe.append((i[open_], j[open_]))
    if not maybe:
        return label, np.zeros(0, int), np.zeros(0, int)
    i, j = (np.concatenate(x) for x in zip(*maybe, strict=True))
    apart = label[i] != label[j]
    return label, i[apart], j[apart]


def _taken(i: np.ndarray, j: np.ndarray, d: np.ndarray, r: np.ndarray, cover: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which row takes in which: (owner, new radius) of n rows under the pairs (i, j, d) within the limit.

    Rows with many rows in reach come first. A leader takes in the free rows that stay within its cover with all they hold.
    """
    n = len(r)
    owner, radius = np.arange(n), r.copy()
    u, v, d = np.r_[i, j], np.r_[j, i], np.r_[d, d]
    ok = d + r[v] <= np.minimum(cover[u], cover[v])
    u, v, d = u[ok], v[ok], d[ok]
    degree = np.bincount(u, minlength=n)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((np.arange(n), -degree))] = np.arange(n)
    free = np.ones(n, bool)
    while len(u):
        # free rows that no earlier free row can take in lead now; none of them can take in another
        best = np.full(n, n)
        np.minimum.at(best, v, rank[u])
        now = np.unique(u[rank[u] < best[u]])
        free[now] = False
        own = np.zeros(n, bool)
        own[now] = True
        got = own[u] & free[v]
        a, b, c = u[got], v[got], d[got]
        order = np.lexsort((rank[a], b))
        a, b, c = a[order], b[order], c[order]
        first = np.r_[True, b[1:] != b[:-1]] if len(b) else np.zeros(0, bool)
        a, b, c = a[first], b[first], c[first]
        owner[b] = a
        np.maximum.at(radius, a, c + r[b])
        free[b] = False
        rest = free[u] & free[v]
        u, v, d = u[rest], v[rest], d[rest]
    return owner, radius


def contracted(q: np.ndarray, r: np.ndarray, starts: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(owner, radius, links) of rows in buckets; owner[x] = x for the leaves that are left.

    Buckets are worked on in blocks of at most ``BLOCK`` rows; what is left of a bucket's blocks meets in new blocks, as
    long as that takes in a tenth of it.
    """
    n = len(q)
    flat = _cells_of(q, limit)[0]
    cover = np.where(flat, COVER_FLAT, COVER) * limit
    owner, radius, links = np.arange(n), r.astype(np.float64), []
    ends = np.r_[starts[1:], n]
    bucket = np.repeat(np.arange(len(starts)), ends - starts)
    at = np.arange(n)
    while True:
        place = np.arange(len(at)) - np.searchsorted(bucket[at], bucket[at], "left")
        cut = np.r_[True, (bucket[at][1:] != bucket[at][:-1]) | (place[1:] % BLOCK == 0)] if len(at) else np.zeros(0, bool)
        block = np.flatnonzero(cut)
        found = [(i[ok], j[ok], d[ok]) for i, j, d in _all_pairs(q[at], block) if (ok := d <= limit + ROOM).any()]
        if not found:
            break
        i, j, d = (np.concatenate(x) for x in zip(*found, strict=True))
        own, rad = _taken(i, j, d, radius[at], cover[at])
        label = local_labels(len(at), i, j)
        root = label != np.arange(len(at))
        links.append((at[np.flatnonzero(root)], at[label[root]]))
        owner[at] = at[own]
        radius[at] = rad
        left = own == np.arange(len(at))
        wide = np.bincount(bucket[at[left]], minlength=len(starts)) > 0
        wide &= np.bincount(bucket[at], minlength=len(starts)) > BLOCK
        few = left.sum() > 0.9 * len(at)
        at = at[left]
        at = at[wide[bucket[at]]]
        if few or not len(at):
            break
    return owner, radius, links


def _leaf_rows(kind: np.ndarray, gid: np.ndarray, gray: pa.Array | None, r: np.ndarray | None, other: np.ndarray | None) -> pa.RecordBatch:
    none = pa.nulls(len(gid))
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(gid, pa.int64()), none.cast(pa.binary()) if gray is None else gray, none.cast(pa.float32()) if r is None else pa.array(np.nextafter(r.astype(np.float32), np.float32(2)) * (r > 0), pa.float32()), none.cast(pa.int64()) if other is None else pa.array(other, pa.int64())], ["kind", "gid", "gray", "r", "other"])


def _round(t: pa.Table, starts: np.ndarray, limit: float) -> Iterator[pa.RecordBatch]:
    q, gid, r = binary_matrix(t["gray"]), t["gid"].to_numpy(), t["r"].to_numpy().astype(np.float64)
    owner, radius, links = contracted(q, r, starts, limit)
    while (owner[owner] != owner).any():  # taken in block after block
        owner = owner[owner]
    left = np.flatnonzero(owner == np.arange(len(q)))
    gone = np.flatnonzero(owner != np.arange(len(q)))
    gray = t["gray"].combine_chunks()
    yield _leaf_rows(np.zeros(len(left)), gid[left], (gray.combine_chunks() if isinstance(gray, pa.ChunkedArray) else gray).take(pa.array(left)), radius[left], None)
    yield _leaf_rows(np.ones(len(gone)), gid[gone], None, None, gid[owner[gone]])
    for a, b in links:
        more = owner[a] != owner[b]
        yield _leaf_rows(np.full(more.sum(), 3), gid[owner[a[more]]], None, None, gid[owner[b[more]]])


def _merge(limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from buckets(batches, ["key"], lambda t, starts: _round(t, starts, limit))

    return run


def _local(limit: float, width: int, rows: int = 20_000):
    """The first level, without a shuffle: the leaves of each partition's own views, about ``rows`` of them at a time."""

    def work(held: list[pa.RecordBatch], planes: np.ndarray) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        q = binary_matrix(t["gray"])
        flat, cell = _cells_of(q, limit)
        key = np.where(flat, cell, (np.int64(1) << 41) | _codes(q, planes))
        order = np.argsort(key, kind="stable")
        t = t.take(pa.array(order)).combine_chunks().append_column("r", pa.array(np.zeros(len(order), np.float32)))
        yield from _round(t, np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]), limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, held, n = _planes(99, width), [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from work(held, planes)
                held, n = [], 0
        if n:
            yield from work(held, planes)

    return run


def _last(limit: float):
    """The last level: links only, one to the bucket's component and the pairs to be tested by members."""

    def work(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        q, gid = binary_matrix(t["gray"]), t["gid"].to_numpy()
        label, i, j = _near_pairs(q, starts, t["r"].to_numpy().astype(np.float64), limit)
        lost = np.flatnonzero(label != np.arange(len(q)))
        yield _leaf_rows(np.r_[np.full(len(lost), 3), np.full(len(i), 2)], np.r_[gid[lost], np.minimum(gid[i], gid[j])], None, None, np.r_[gid[label[lost]], np.maximum(gid[i], gid[j])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from buckets(batches, ["key"], work)

    return run


def _level(leaves: DataFrame, rows: int, seeds: Sequence[int], width: int, limit: float, work, flats: bool = False) -> DataFrame:
    keyed = leaves.select("gid", "gray", "r").mapInArrow(_keyed(seeds, width, limit, flats), "key long, gid long, gray binary, r float")
    parts = task_count(leaves.sparkSession, rows * len(seeds), 140)
    return keyed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(work, LEAF)


def threshold_clusters(rows: DataFrame, limit: float = 0.08, rounds: int = 2) -> DataFrame:
    """(sample_id, gray) -> (sample_id, gid, component): components of views joined by distances of at most ``limit``.

    Rows without view belong to none; repeated rows and copies collapse to one view first. Two leaders at the limit are
    missed by all tables of the last level with a probability below 1 % at any number of rows; members of two leaves whose
    leaders are further apart (up to ``REACH`` limits) are found if the leaders meet, which is less likely the further
    they are apart.
    """
    known = rows.where("gray IS NOT NULL AND sample_id IS NOT NULL")
    views = written(known.select("gray").distinct(), "cluster-views")
    gid = view_ids(views)
    views = views.withColumn("gid", gid("gray"))
    levels = [written(views.select("gid", "gray").mapInArrow(_local(limit, 10), LEAF), "cluster-level0")]
    for k in range(rounds):
        leaves = levels[-1].where("kind = 0")
        n = leaves.count()
        levels.append(written(_level(leaves, n, [k], max(8, min(40, round(math.log2(max(n, 2) / 16)))), limit, _merge(limit)), f"cluster-level{k + 1}"))
    leaves = levels[-1].where("kind = 0")
    n = leaves.count()
    width = max(6, min(40, round(math.log2(max(n, 2) / 100))))
    last = None
    for at in range(0, tables_for(width), PASS):
        seeds = list(range(100 + at, 100 + min(at + PASS, tables_for(width))))
        one = written(_level(leaves, n, seeds, width, limit, _last(limit), at == 0).select("kind", F.col("gid").alias("src"), F.col("other").alias("dst")).distinct(), "cluster-last")
        last = one if last is None else last.unionByName(one)
        released(views.sparkSession)
    links = None
    for level in levels:  # the ends of a link are followed to the leaves that are left
        links = level.where("kind = 3").select(F.col("gid").alias("src"), F.col("other").alias("dst")).unionByName(_moved(links, level)) if links is not None else level.where("kind = 3").select(F.col("gid").alias("src"), F.col("other").alias("dst"))
    links = written(links.unionByName(last.where("kind = 3").select("src", "dst")).where("src <> dst").distinct(), "cluster-links")
    held = None
    for level in reversed(levels):
        taken = level.where("kind = 1").select("gid", F.col("other").alias("leaf"))
        if held is not None:
            further = held.select(F.col("gid").alias("leaf"), F.col("leaf").alias("__top"))
            taken = taken.join(further, "leaf", "left").select("gid", F.coalesce("__top", "leaf").alias("leaf")).unionByName(held)
        held = taken
    held = written(held, "cluster-held")
    labels = written(hash_to_min(links), "cluster-labels")
    more = _by_members(last.where("kind = 2").select("src", "dst").distinct(), labels, held, leaves, views, limit)
    if more is not None:
        ends = held.withColumnRenamed("gid", "src")
        more = more.join(ends, "src", "left").select(F.coalesce("leaf", "src").alias("src"), "dst")
        more = more.join(held.withColumnRenamed("gid", "dst"), "dst", "left").select("src", F.coalesce("leaf", "dst").alias("dst"))
        labels = written(hash_to_min(links.unionByName(more)), "cluster-labels")
    ids = known.select("sample_id", gid("gray").alias("gid")).distinct().join(held, "gid", "left").select("sample_id", "gid", F.coalesce("leaf", "gid").alias("leaf"))
    return ids.join(labels.withColumnRenamed("node", "leaf"), "leaf", "left").select("sample_id", "gid", F.coalesce("component", "leaf").alias("component"))


def _moved(links: DataFrame, level: DataFrame) -> DataFrame:
    """Links between leaves of the level before as links between the leaves of ``level`` that hold them."""
    taken = level.where("kind = 1")
    for end in ("src", "dst"):
        links = links.join(taken.select(F.col("gid").alias(end), F.col("other").alias("__top")), end, "left").withColumn(end, F.coalesce("__top", end)).drop("__top")
    return links.select("src", "dst")


def _close(limit: float, reach: str | None, keep: Sequence[str]):
    """Rows whose two views (gray_a, gray_b) are within the limit, plus the radius in the column ``reach``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n = b.num_rows
                d = distance(binary_matrix(pa.concat_arrays([b.column("gray_a"), b.column("gray_b")])), np.arange(n), np.arange(n, 2 * n))
                ok = pa.array(d <= limit + ROOM + (b.column(reach).to_numpy() if reach else 0))
                yield pa.RecordBatch.from_arrays([b.column(k).filter(ok) for k in keep], list(keep))

    return run


def _by_members(open_: DataFrame, labels: DataFrame, held: DataFrame, leaves: DataFrame, views: DataFrame, limit: float) -> DataFrame | None:
    """The true links (src, dst) between the members of leaf pairs whose radii leave it open; None if there are none.

    A member takes part only if it is within the limit and the other leaf's radius of the other leader, so the work is
    linear in the members of the open leaves but for the few that lie between two of them.
    """
    of = lambda end, name: labels.select(F.col("node").alias(end), F.col("component").alias(name))
    open_ = open_.join(of("src", "a"), "src", "left").join(of("dst", "b"), "dst", "left").where("coalesce(a, src) <> coalesce(b, dst)").select("src", "dst")
    open_ = written(open_, "cluster-open")
    if open_.isEmpty():
        return None
    turned = open_.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ends = open_.select("src").unionByName(turned.select("src")).distinct()
    inside = ends.select(F.col("src").alias("leaf"), F.col("src").alias("gid")).unionByName(held.join(ends.withColumnRenamed("src", "leaf"), "leaf", "left_semi").select("leaf", "gid"))
    leader = leaves.select(F.col("gid").alias("dst"), F.col("gray").alias("gray_b"), "r")
    member = inside.join(views.select("gid", F.col("gray").alias("gray_a")), "gid").select(F.col("leaf").alias("src"), "gid", "gray_a")
    sides = open_.unionByName(turned).join(leader, "dst").join(member, "src")
    near = written(sides.select("src", "dst", "gid", "gray_a", "gray_b", "r").mapInArrow(_close(limit, "r", ["src", "dst", "gid", "gray_a"]), "src long, dst long, gid long, gray_a binary"), "cluster-near")
    other = near.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("gid").alias("gid_b"), F.col("gray_a").alias("gray_b"))
    both = near.where("src < dst").join(other, ["src", "dst"]).select(F.col("gid").alias("src"), F.col("gid_b").alias("dst"), "gray_a", "gray_b")
    found = written(both.mapInArrow(_close(limit, None, ["src", "dst"]), "src long, dst long"), "cluster-found")
    return None if found.isEmpty() else found


def glyph_clusters(items: DataFrame, limit: float = 0.08) -> DataFrame:
    """(cluster_id, sample_id) of clusters with at least two ids; cluster_id is the smallest id. An empty table gives no rows."""
    rows = written(encoded(items, False).select("sample_id", "gray").where("gray IS NOT NULL"), "cluster-rows")
    return named(threshold_clusters(rows, limit))


def named(parts: DataFrame) -> DataFrame:
    sizes = parts.groupBy("component").agg(F.min("sample_id").alias("cluster_id"), F.max("sample_id").alias("other")).where("cluster_id <> other").select("component", "cluster_id")
    return parts.join(sizes, "component").select("cluster_id", "sample_id").distinct()


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mergeable features of the rows of one partition: component -> (n, linear sum)."""
    n: dict[int, int] = {}
    total: dict[int, np.ndarray] = {}
    for b in batches:
        if not b.num_rows:
            continue
        q, comp = binary_matrix(b.column("gray")).astype(np.float64), b.column("component").to_numpy()
        values, at = np.unique(comp, return_inverse=True)
        sums = np.zeros((len(values), q.shape[1]))
        np.add.at(sums, at, q)
        for v, c, s in zip(values.tolist(), np.bincount(at).tolist(), sums, strict=True):
            n[v] = n.get(v, 0) + c
            total[v] = total[v] + s if v in total else s
    yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["component", "n", "ls"])


def _to_centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            q = binary_matrix(b.column("gray")).astype(np.float64)
            c = np.stack([np.frombuffer(x, np.float64) for x in b.column("ls").to_pylist()]) / b.column("n").to_numpy()[:, None]
            yield pa.RecordBatch.from_arrays([b.column("component"), b.column("sample_id"), b.column("n"), pa.array(np.abs(q - c).mean(1) / 255)], ["component", "sample_id", "n", "dist"])


def glyph_groups(items: DataFrame, limit: float = 0.08, typical: int = 3) -> DataFrame:
    """Each cluster of at least two ids: cluster_id, size, and its most typical members (nearest to the centroid, ties by id)."""
    rows = written(encoded(items, False).select("sample_id", "gray").where("gray IS NOT NULL").distinct(), "cluster-rows")
    parts = threshold_clusters(rows, limit)
    view = rows.select("gray").distinct()
    joined = written(rows.withColumn("gid", view_ids(view)("gray")).join(parts, ["sample_id", "gid"]).select("component", "sample_id", "gray"), "cluster-members")
    # per-partition features of views hashed by (component, salt), then merged: a component of any size is spread over salts
    parts_n = max(int(joined.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    partial = joined.repartition(parts_n, "component", F.pmod(F.xxhash64("sample_id"), F.lit(4))).mapInArrow(_sums, "component long, n long, ls binary")
    centre = partial.groupBy("component").applyInArrow(_merged_sums, "component long, n long, ls binary").where("n > 1")
    dist = joined.join(centre, "component").mapInArrow(_to_centre, "component long, sample_id string, n long, dist double")
    return _described(dist, "component", "sample_id", typical, "cluster_id")


def _merged_sums(t: pa.Table) -> pa.Table:
    ls = np.sum([np.frombuffer(x, np.float64) for x in t["ls"].to_pylist()], axis=0)
    return pa.table({"component": t["component"].slice(0, 1), "n": pa.array([int(np.sum(t["n"].to_numpy()))], pa.int64()), "ls": pa.array([ls.tobytes()], pa.binary())})


def _described(dist: DataFrame, group: str, record: str, typical: int, name: str) -> DataFrame:
    ranked = dist.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("dist", record))).where(F.col("rank") <= typical)
    top = ranked.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(record).alias("id")))).alias("top"))
    sizes = dist.groupBy(group).agg(F.count_distinct(record).alias("size"), F.min(record).alias(name), F.avg("dist").alias("mean_dist"))
    out = sizes.join(top, group).select(name, "size", F.round("mean_dist", 6).alias("mean_dist"), F.transform("top", lambda x: x["id"]).alias("typical"))
    return out.where("size > 1")


# ---- bounded leaves and Ward agglomeration over plain features ----


def _inserted(n: np.ndarray, ls: np.ndarray, ss: np.ndarray, reach: float, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Features put one after the other into the nearest leaf if the radius of the union stays within ``reach``, else into a
    leaf of their own; None if that takes more than ``limit`` leaves. Blocks of features look up their leaves at once."""
    ln, ll, lq = n[:0], ls[:0], ss[:0]
    for at in range(0, len(n), 256):
        wait = np.arange(at, min(at + 256, len(n)))
        while len(wait):
            fits = np.zeros(len(wait), bool)
            if len(ln):
                gap = ((ls[wait] / n[wait, None])[:, None] - (ll / ln[:, None])[None]) ** 2
                near = gap.sum(2).argmin(1)
                un, ul, uq = n[wait] + ln[near], ls[wait] + ll[near], ss[wait] + lq[near]
                fits = uq / un - ((ul / un[:, None]) ** 2).sum(1) <= reach * reach
                for own, more in ((ln, n), (ll, ls), (lq, ss)):
                    np.add.at(own, near[fits], more[wait[fits]])
            wait = wait[~fits]
            if len(wait):
                if len(ln) == limit:
                    return None
                ln, ll, lq = np.append(ln, n[wait[0]]), np.concatenate([ll, ls[wait[:1]]]), np.append(lq, ss[wait[0]])
                wait = wait[1:]
    return ln, ll, lq


def leaves_of(x: np.ndarray, limit: int, n: np.ndarray | None = None, ls: np.ndarray | None = None, ss: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most ``limit`` cluster features (n, ls, ss) of the points or features given.

    Equal points are one feature. While there are more than the limit, they are inserted anew into leaves under a radius
    that doubles. The features enter in the order of their sums, so the result depends on the rows only.
    """
    if n is None:
        n, ls, ss = np.ones(len(x)), x.astype(np.float64), (x.astype(np.float64) ** 2).sum(1)
    assert ls is not None and ss is not None
    if not len(n):
        return n, ls, ss
    centre, at = np.unique(ls / n[:, None], axis=0, return_inverse=True)
    k = len(centre)
    n2, ls2, ss2 = np.bincount(at.ravel(), n, k), np.zeros((k, ls.shape[1])), np.bincount(at.ravel(), ss, k)
    np.add.at(ls2, at.ravel(), ls)
    reach = math.sqrt(max(1e-12, ss2.sum() / n2.sum() - ((ls2.sum(0) / n2.sum()) ** 2).sum())) / 64
    while len(n2) > limit:
        got = _inserted(n2, ls2, ss2, reach, limit)
        if got is not None:
            return got
        reach *= 2
    return n2, ls2, ss2


def ward(n: np.ndarray, ls: np.ndarray, k: int) -> np.ndarray:
    """Cluster number of each leaf after merging the pair of smallest Ward cost until ``k`` clusters are left."""
    m = len(n)
    label = np.arange(m)
    if m <= k:
        return label
    n, c, alive = n.astype(float).copy(), ls / n[:, None], np.ones(m, bool)
    cost = n[:, None] * n[None] / (n[:, None] + n[None]) * ((c[:, None] - c[None]) ** 2).sum(2)
    np.fill_diagonal(cost, np.inf)
    for _ in range(m - k):
        a, b = divmod(int(np.argmin(cost)), m)
        a, b = min(a, b), max(a, b)
        c[a] = (n[a] * c[a] + n[b] * c[b]) / (n[a] + n[b])
        n[a] += n[b]
        label[label == b] = a
        alive[b] = False
        cost[b, :] = cost[:, b] = np.inf
        row = n[a] * n / (n[a] + n) * ((c[a] - c) ** 2).sum(1)
        row[~alive] = np.inf
        row[a] = np.inf
        cost[a, :] = cost[:, a] = row
    return np.unique(label, return_inverse=True)[1]


def feature_groups(df: DataFrame, record: str, group: str, features: Sequence[str], k: int = 4, leaf_limit: int = 64) -> DataFrame:
    """(record, grp, part, dist): every record with all features finite is put into one of at most ``k`` parts of its group.

    Leaves per partition and group are bounded by ``leaf_limit`` and merged level by level, so no task holds more than
    leaf_limit x merged tables of one group. Records with a null or NaN feature, or without group, are left out.
    """
    ok = F.lit(True)
    for f in features:
        ok = ok & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) & (F.abs(F.col(f).cast("double")) < F.lit(float("inf")))
    data = df.where(ok & F.col(group).isNotNull() & F.col(record).isNotNull()).select(F.col(record).alias("record"), F.col(group).alias("grp"), F.array(*[F.col(f).cast("double") for f in features]).alias("x")).distinct()
    schema = "grp string, n array<double>, ls array<double>, ss array<double>"

    def pack(g: str, n: np.ndarray, ls: np.ndarray, ss: np.ndarray) -> dict:
        return {"grp": g, "n": n, "ls": ls.ravel(), "ss": ss}

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple] = {}
        for pdf in frames:
            for g, own in pdf.groupby("grp"):
                x = np.stack(own["x"].to_numpy())
                n, ls, ss = np.ones(len(x)), x, (x**2).sum(1)
                if g in held:
                    n, ls, ss = (np.concatenate(z) for z in zip(held[g], (n, ls, ss), strict=True))
                held[g] = leaves_of(x, leaf_limit, n, ls, ss)
        if held:
            yield pd.DataFrame([pack(g, *v) for g, v in held.items()])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        n, ss = np.concatenate(pdf["n"].to_list()), np.concatenate(pdf["ss"].to_list())
        ls = np.concatenate(pdf["ls"].to_list()).reshape(len(n), -1)
        return pd.DataFrame([pack(pdf["grp"].iloc[0], *leaves_of(ls, leaf_limit, n, ls, ss))])

    def agglomerate(pdf: pd.DataFrame) -> pd.DataFrame:
        one = merge(pdf)
        n = np.asarray(one["n"][0])
        ls = np.asarray(one["ls"][0]).reshape(len(n), -1)
        label = ward(n, ls, k)
        centres = [(ls[label == c].sum(0) / n[label == c].sum()).tolist() for c in range(label.max() + 1)]
        return pd.DataFrame({"grp": pdf["grp"].iloc[0], "part": range(len(centres)), "centre": centres})

    partial = data.mapInPandas(first, schema)
    level = partial.groupBy("grp", F.pmod(F.spark_partition_id(), F.lit(8)).alias("salt")).applyInPandas(merge, schema)
    centres = level.groupBy("grp").applyInPandas(agglomerate, "grp string, part int, centre array<double>")
    near = centres.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("part", "centre"))).alias("centres"))  # k a group
    gap = lambda c: F.aggregate(F.zip_with("x", c["centre"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    best = F.array_min(F.transform("centres", lambda c: F.struct(gap(c).alias("d"), c["part"].alias("part"))))
    return data.join(near, "grp").withColumn("best", best).select("record", "grp", F.col("best.part").alias("part"), F.sqrt("best.d").alias("dist"))


def crop_groups(candidates: DataFrame, typical: int = 3, k: int = 4, whole: bool = False) -> DataFrame:
    """Crops of each style in at most ``k`` parts of similar risk and disagreement: style, part, size, most typical crops.

    With ``whole`` each distinct crop is in exactly one part. Rows of one crop give its style and its highest disagreement;
    crops that lack a feature are grouped by the others in parts of their own, numbered from k on (from 2 k without
    disagreement, from 3 k without either), and crops without style form the null style. Else such crops are left out.
    """
    from plumbago.llm.keys import canon_col

    slim = candidates.select(canon_col("crop_id").alias("crop"), canon_col("style_id").alias("style"), "risk_score", "disagreement")
    if whole:
        known = lambda c: F.when(F.abs(F.col(c).cast("double")) < F.lit(float("inf")), F.col(c).cast("double"))
        slim = slim.withColumns({"risk_score": known("risk_score"), "disagreement": known("disagreement")})
        best = F.max(F.struct(F.col("disagreement").isNotNull(), F.col("risk_score").isNotNull(), "disagreement", "risk_score")).alias("best")
        slim = slim.groupBy("crop").agg(F.min("style").alias("style"), best).select("crop", "style", "best.risk_score", "best.disagreement")
        lacks = F.col("risk_score").isNull().cast("int") + 2 * F.col("disagreement").isNull().cast("int")
        style = F.concat_ws("|", lacks.cast("string"), "style")  # without style only the number
        slim = slim.select("crop", style.alias("style"), F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"), F.coalesce("disagreement", F.lit(0.0)).alias("disagreement"))
    placed = feature_groups(slim, "crop", "style", ["risk_score", "disagreement"], k)
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("grp", "part").orderBy("dist", "record"))).where(F.col("rank") <= typical)
    top = ranked.groupBy("grp", "part").agg(F.array_sort(F.collect_list(F.struct("rank", "record"))).alias("top"))
    size = placed.groupBy("grp", "part").agg(F.count_distinct("record").alias("size"), F.round(F.avg("dist"), 6).alias("mean_dist"))
    out = size.join(top, ["grp", "part"])
    if whole:
        part = F.substring("grp", 1, 1).cast("int") * k + F.col("part")
        out = out.withColumns({"part": part, "grp": F.when(F.length("grp") > 1, F.expr("substring(grp, 3)"))})
    return out.select(F.col("grp").alias("style_id"), "part", "size", "mean_dist", F.transform("top", lambda t: t["record"]).alias("typical"))
