"""Bitmap kernels in Arrow batches: defects on gray bitmaps, boxes, hashes, visibility."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

OPERATORS = ("erase", "add", "break", "bridge", "shift")


def defect(image: np.ndarray, kind: str, seed: int) -> np.ndarray:
    """One seeded defect of a gray bitmap (ink above 127)."""
    rng = np.random.default_rng(seed)
    out, ink = image.copy(), np.argwhere(image > 127)
    h, w = image.shape
    if not len(ink):
        return out
    y, x = ink[rng.integers(len(ink))]
    r = int(rng.integers(2, max(3, min(h, w) // 5)))
    box = (slice(max(0, y - r), min(h, y + r)), slice(max(0, x - r), min(w, x + r)))
    if kind == "erase":
        out[box] = 0
    elif kind == "add":
        out[y, max(0, x - 2 * r) : min(w, x + 2 * r)] = 255
    elif kind == "break":
        out[box[0], x : x + 2] = 0
        out[y : y + 2, box[1]] = 0
    elif kind == "bridge":
        y2, x2 = ink[rng.integers(len(ink))]
        n = max(abs(int(y2) - int(y)), abs(int(x2) - int(x)), 1)
        out[np.linspace(y, y2, n + 1).round().astype(int), np.linspace(x, x2, n + 1).round().astype(int)] = 255
    elif kind == "shift":
        part = np.zeros_like(image)
        part[box] = image[box]
        out[box] = 0
        out = np.maximum(out, np.roll(part, (r // 2 + 1, r // 2 + 1), (0, 1)))
    else:
        raise ValueError(f"unknown operator {kind}")
    return out


def accepted_defect(image: np.ndarray, kind: str, seed: int, tries: int = 20) -> tuple[np.ndarray | None, int, int]:
    """First proposal that changes at least 8 pixels and at most 35 % of the ink; (bitmap or None, changed, tries)."""
    ink = max(1, int((image > 127).sum()))
    for t in range(tries):
        out = defect(image, kind, seed + t)
        changed = int(((out > 127) != (image > 127)).sum())
        if 8 <= changed <= 0.35 * ink:
            return out, changed, t + 1
    return None, 0, tries


def tight_box(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    ys, xs = np.nonzero(mask)
    return None if not len(ys) else (int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1)


def components_of(mask: np.ndarray) -> int:
    """4-connected components of a mask, by label propagation."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        new = label.copy()
        new[1:] = np.where(mask[1:] & mask[:-1], np.maximum(new[1:], label[:-1]), new[1:])
        new[:-1] = np.where(mask[:-1] & mask[1:], np.maximum(new[:-1], label[1:]), new[:-1])
        new[:, 1:] = np.where(mask[:, 1:] & mask[:, :-1], np.maximum(new[:, 1:], label[:, :-1]), new[:, 1:])
        new[:, :-1] = np.where(mask[:, :-1] & mask[:, 1:], np.maximum(new[:, :-1], label[:, 1:]), new[:, :-1])
        if (new == label).all():
            return len(np.unique(label[mask]))
        label = new


@functools.cache
def _area_weights(n: int, size: int = 32) -> np.ndarray:
    """size x n averaging matrix: each output cell is the mean over its share of the n input cells."""
    edge = np.linspace(0, n, size + 1)
    cover = np.minimum(edge[1:, None], np.arange(1, n + 1)[None]) - np.maximum(edge[:-1, None], np.arange(n)[None])
    return np.clip(cover, 0, None) * size / n


def perceptual_hash(image: np.ndarray) -> int:
    """64 bits: the 8 x 8 low DCT terms of the 32 x 32 area-averaged image against the median of all but the first."""
    rows, cols = (_area_weights(n) for n in image.shape)
    k = np.arange(32)
    basis = np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / 64)[:8]
    low = np.round((basis @ (rows @ image @ cols.T) @ basis.T).ravel(), 6)  # terms that cancel are exactly 0
    out = 0
    for bit in low > np.median(low[1:]):
        out = out << 1 | int(bit)
    return out - (1 << 64) if out >= 1 << 63 else out


def corrupted(df: DataFrame, key: str, views: str, side: int) -> DataFrame:
    """Every bitmap (first side x side numbers of ``views``, 0..1) under every operator: (key, operator, changed, tries,
    x0, y0, x1, y1, parts, phash). Rows with a null or short view are left out; unmet quotas have null boxes."""
    kinds = dict(df.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for k, v in zip(pdf["key"], pdf["v"], strict=True):
                if v is None or len(v) < side * side:
                    continue
                img = ((1 - np.nan_to_num(np.asarray(v[: side * side], float))) * 255).astype(np.uint8).reshape(side, side)
                seed = int.from_bytes(str(k).encode()[-6:], "big")
                for n, op in enumerate(OPERATORS):
                    out, changed, tries = accepted_defect(img, op, seed + 1000 * n)
                    box = tight_box((out > 127) != (img > 127)) if out is not None else None
                    rows.append((k, op, changed, tries, *(box or (None,) * 4), components_of((out if out is not None else img) > 127), perceptual_hash(out if out is not None else img)))
            yield pd.DataFrame(rows, columns=["key", "operator", "changed", "tries", "x0", "y0", "x1", "y1", "parts", "phash"])

    got = df.selectExpr(f"`{key}` AS key", f"`{views}` AS v").mapInPandas(run, f"key {kinds[key]}, operator string, changed int, tries int, x0 int, y0 int, x1 int, y1 int, parts int, phash long")
    return got.withColumnRenamed("key", key)
