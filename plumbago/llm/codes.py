"""Gray views as bytes, similarity-hash bit fingerprints of them, and streams of hash buckets.

A view is held as one byte a pixel when every pixel is a multiple of 1/255 (as gray levels are), else as float32;
distances are the same either way, up to float rounding. The fingerprint bit of a pixel says whether it is above the
view's own mean; a table's key is a permuted segment of the code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbago.llm.keys import canon, canon_hash

PIXELS = 100
ENCODED = "sample_id string, role string, hash string, gray binary, source_group_id string, source_asset_ids array<string>"
#: Distances are compared with this much room for float32 rounding; one gray level is 3.9e-5 of the mean over 100 pixels.
ROOM = 1e-6
FLAT = 0.1


def encode_views(views: pa.Array, pixels: int = PIXELS) -> list[bytes | None]:
    """The first ``pixels`` numbers of each list; None where the list is null, shorter, or has a null, NaN or infinite number there."""
    out: list[bytes | None] = [None] * len(views)
    views = views.combine_chunks() if isinstance(views, pa.ChunkedArray) else views
    offsets = np.asarray(views.offsets)
    size, valid = np.diff(offsets), np.asarray(views.is_valid())
    rows = np.flatnonzero(valid & (size >= pixels))
    if not len(rows):
        return out
    flat = views.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)  # nulls become NaN
    block = flat[offsets[rows][:, None] + np.arange(pixels)]
    fine = np.isfinite(block).all(1)
    level = np.rint(np.where(fine[:, None], block, 0) * 255)
    grid = fine & (np.abs(np.where(fine[:, None], block, 0) * 255 - level).max(1) < 2e-3) & (level >= 0).all(1) & (level <= 255).all(1)
    bytes_ = np.clip(level, 0, 255).astype(np.uint8)
    for k, row in enumerate(rows):
        if grid[k]:
            out[row] = bytes_[k].tobytes()
        elif fine[k]:
            out[row] = block[k].tobytes()
    return out


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        get = lambda c: b.column(b.schema.get_field_index(c))  # noqa: E731, B023
        text = lambda c, f: pa.array([f(x) for x in get(c).to_pylist()], pa.string())  # noqa: E731, B023
        yield pa.RecordBatch.from_arrays(
            [text("sample_id", canon), text("role", canon), text("hash", canon_hash), pa.array(encode_views(get("views")), pa.binary()), get("source_group_id"), get("source_asset_ids")],
            ["sample_id", "role", "hash", "gray", "source_group_id", "source_asset_ids"],
        )


def encoded(items: DataFrame, with_source: bool = True) -> DataFrame:
    """glyph_items -> (sample_id, role, hash, gray, source_group_id, source_asset_ids), canonical; rows without id dropped."""
    source = [F.col("source_group_id"), F.col("source_asset_ids")] if with_source else [F.lit(None).cast("string").alias("source_group_id"), F.lit(None).cast("array<string>").alias("source_asset_ids")]
    slim = items.select("sample_id", F.col("split_role").alias("role"), F.col("pixel_sha256").alias("hash"), F.slice("views", 1, PIXELS).alias("views"), *source)
    return slim.mapInArrow(_encode, ENCODED).where("sample_id IS NOT NULL")


def matrix(grays: list[bytes], pixels: int = PIXELS) -> np.ndarray:
    """uint8 rows where all views are bytes, else float32 rows on the 0..255 scale."""
    if all(len(g) == pixels for g in grays):
        return np.frombuffer(b"".join(grays), np.uint8).reshape(-1, pixels)
    return np.stack([np.frombuffer(g, np.uint8).astype(np.float32) if len(g) == pixels else np.frombuffer(g, np.float32) * np.float32(255) for g in grays])


def binary_matrix(column: pa.Array, pixels: int = PIXELS) -> np.ndarray:
    """``matrix`` of a binary column without nulls, without a copy for each row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    if len(column) and (np.diff(offsets) == pixels).all():
        return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, pixels)
    return matrix(column.to_pylist(), pixels) if len(column) else np.zeros((0, pixels), np.uint8)


def distance(q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Mean absolute difference (0..1 scale) of the row pairs (i, j)."""
    a, b = q[i], q[j]
    if q.dtype == np.uint8:
        return (np.maximum(a, b) - np.minimum(a, b)).sum(1, dtype=np.uint32) / (255.0 * q.shape[1])
    return np.abs(a.astype(np.float64) - b).sum(1) / (255.0 * q.shape[1])


def bits(q: np.ndarray) -> np.ndarray:
    return q > q.mean(1, keepdims=True, dtype=np.float64)


def flat_cells(q: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Views of so little contrast that their bits say little (mean absolute deviation up to FLAT), and the cell of each
    view's mean in steps of ``limit``: means of views within the limit lie in the same or in neighbouring cells."""
    mean = q.mean(1, dtype=np.float64)
    spread = np.abs(q - mean[:, None]).mean(1) / 255
    return spread <= FLAT, np.floor(mean / 255 / limit).astype(np.int64)


def segments(tables: int, width: int, pixels: int = PIXELS, seed: int = 7) -> list[np.ndarray]:
    """The pixels of each table's key: consecutive segments of as many random permutations as are needed."""
    rng, out = np.random.default_rng(seed), []
    width = min(width, pixels)
    while len(out) < tables:
        order = rng.permutation(pixels)
        out += [order[k : k + width] for k in range(0, pixels - width + 1, width)]
    return out[:tables]


def blobs(rows: np.ndarray) -> pa.Array:
    """A binary column of the rows of a uint8 matrix, without a copy for each row."""
    rows = np.ascontiguousarray(rows, np.uint8)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def blob_matrix(column: pa.Array, width: int) -> np.ndarray:
    """The uint8 matrix of a binary column whose values are all ``width`` bytes long."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, width)


def view_ids(views: DataFrame) -> Callable[[str], Column]:
    """The id of a view as an expression of its column, told apart by all of ``views`` (distinct in ``gray``).

    It is a 64-bit hash; the hashes that two views share, a handful at most below 10^11 views, take a second hash.
    """
    shared = [r[0] for r in views.groupBy(F.xxhash64("gray").alias("h")).agg(F.count("*").alias("n")).where("n > 1").select("h").limit(10_001).collect()]
    if len(shared) > 10_000:
        raise ValueError("too many views share a 64-bit hash")
    plain = lambda c: F.xxhash64(c)
    return (lambda c: F.when(plain(c).isin(shared), F.xxhash64(c, F.lit("again"))).otherwise(plain(c))) if shared else plain


def task_count(spark: SparkSession, rows: int, row_bytes: int, task_bytes: int = 12 << 20, most: int = 50_000) -> int:
    """Partitions of a shuffle of that size whose tasks do much work a row: about ``task_bytes`` each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2, min(most, -(-rows * row_bytes // task_bytes)))


def packed(code: np.ndarray) -> np.ndarray:
    """Rows of at most 62 bits as int64."""
    return code.astype(np.int64) @ (np.int64(1) << np.arange(code.shape[1], dtype=np.int64))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s + n)."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


def pair_chunks(starts: np.ndarray, lengths: np.ndarray, rows: np.ndarray, size: int = 150_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (row, partner) with partners starts[k] .. starts[k] + lengths[k] for rows[k], about ``size`` at a time."""
    keep = lengths > 0
    starts, lengths, rows = starts[keep], lengths[keep], rows[keep]
    at = 0
    cum = np.cumsum(lengths)
    while at < len(rows):
        base = cum[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(cum, base + size, "right")))
        n = lengths[at:to]
        yield np.repeat(rows[at:to], n), ranges(starts[at:to], n)
        at = to


def buckets(batches: Iterator[pa.RecordBatch], keys: list[str], work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], rows: int = 40_000) -> Iterator[pa.RecordBatch]:
    """Cut a stream sorted by ``keys`` into tables of whole buckets and hand each with its bucket starts to ``work``."""

    def edges(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows, bool)
        change[0] = True
        for k in keys:
            x = t[k].to_numpy()
            change[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(change)

    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n >= rows:
            t = pa.Table.from_batches(held)
            at = edges(t)
            if at[-1] > 0:
                yield from work(t.slice(0, at[-1]).combine_chunks(), at[:-1])
                held = t.slice(at[-1]).combine_chunks().to_batches()
                n = t.num_rows - at[-1]
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield from work(t, edges(t))
