"""Array kernels on gray images in Arrow batches: resampling, appearance, augmentation, photometry, crops and measures.

Images are float arrays in 0..1 with ink dark unless said otherwise; every random choice comes from a seed of the row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Affine:
    """Scale, rotation in degrees and shift in pixels about the centre of the image."""

    scale: float = 1.0
    angle: float = 0.0
    dx: float = 0.0
    dy: float = 0.0


def warped(image: np.ndarray, move: Affine, fill: float = 1.0) -> np.ndarray:
    """The image moved by ``move``, bilinear, ``fill`` from outside."""
    h, w = image.shape
    a = np.deg2rad(move.angle)
    y, x = np.mgrid[:h, :w].astype(float)
    u, v = x - (w - 1) / 2 - move.dx, y - (h - 1) / 2 - move.dy
    sx = (np.cos(a) * u + np.sin(a) * v) / move.scale + (w - 1) / 2
    sy = (-np.sin(a) * u + np.cos(a) * v) / move.scale + (h - 1) / 2
    framed = np.pad(image, 1, constant_values=fill)
    sx, sy = np.clip(sx + 1, 0, w + 1), np.clip(sy + 1, 0, h + 1)
    x0, y0 = np.minimum(sx.astype(int), w), np.minimum(sy.astype(int), h)
    fx, fy = sx - x0, sy - y0
    top = framed[y0, x0] * (1 - fx) + framed[y0, x0 + 1] * fx
    low = framed[y0 + 1, x0] * (1 - fx) + framed[y0 + 1, x0 + 1] * fx
    return top * (1 - fy) + low * fy


def appearance(image: np.ndarray, seed: int) -> np.ndarray:
    """A seeded print variation: scale 0.85..1, up to 3 degrees and 3 / 128 of the width of shift."""
    r = np.random.default_rng(seed)
    most = 3 / 128 * image.shape[1]
    return warped(image, Affine(r.uniform(0.85, 1), r.uniform(-3, 3), r.uniform(-most, most), r.uniform(-most, most)))


def euler_number(mask: np.ndarray) -> int:
    """Parts minus holes (8-connected ink), from the counts of 2 x 2 patterns: one ink pixel adds, three take away, and a
    diagonal pair takes away twice, a quarter each."""
    p = np.pad(mask.astype(int), 1)
    a, b, c, d = p[:-1, :-1], p[:-1, 1:], p[1:, :-1], p[1:, 1:]
    n = a + b + c + d
    return int(((n == 1).sum() - (n == 3).sum() - 2 * ((n == 2) & (a == d)).sum()) // 4)


def augmented(image: np.ndarray, seed: int, tries: int = 4) -> tuple[np.ndarray, int, str]:
    """A small seeded move (2 degrees, 3 % of scale, 2 / 128 of shift) that keeps the ink: (image, tries, outcome).

    Refused are moves that push ink over the border, change the number of parts or holes, or change the ink by more than a
    quarter; after ``tries`` refusals the image stays as it is.
    """
    ink = image < 0.5
    for t in range(tries):
        r = np.random.default_rng((seed, t))
        most = 2 / 128 * image.shape[1]
        out = warped(image, Affine(r.uniform(0.97, 1.03), r.uniform(-2, 2), r.uniform(-most, most), r.uniform(-most, most)))
        got = out < 0.5
        edge = lambda m: m[0].sum() + m[-1].sum() + m[:, 0].sum() + m[:, -1].sum()
        if edge(got) <= edge(ink) and abs(int(got.sum()) - int(ink.sum())) <= 0.25 * max(1, ink.sum()) and euler_number(got) == euler_number(ink):
            return out, t + 1, "moved"
    return image, tries, "kept"


def area_resized(image: np.ndarray, size: int) -> np.ndarray:
    """size x size: each cell is the mean over its share of the image."""

    def weights(n: int) -> np.ndarray:
        edge = np.linspace(0, n, size + 1)
        cover = np.minimum(edge[1:, None], np.arange(1, n + 1)[None]) - np.maximum(edge[:-1, None], np.arange(n)[None])
        return np.clip(cover, 0, None) * size / n

    return weights(image.shape[0]) @ image @ weights(image.shape[1]).T


def edges(image: np.ndarray, low: float = 0.2, high: float = 0.4) -> np.ndarray:
    """Thin edges: Sobel gradient, maxima along its direction, weak ones kept where they touch strong ones."""
    p = np.pad(image, 1, mode="edge")
    h, w = image.shape
    at = lambda dy, dx: p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    gx = (at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)) / 4
    gy = (at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)) / 4
    g = np.hypot(gx, gy)
    q = np.pad(g, 1)
    turn = np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int) % 4
    thin = np.zeros_like(g, bool)
    for k, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        a, b = q[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w], q[1 - dy : 1 - dy + h, 1 - dx : 1 - dx + w]
        thin |= (turn == k) & (g >= a) & (g > b)
    weak, strong = thin & (g >= low), thin & (g >= high)
    while True:
        s = np.pad(strong, 1)
        grown = weak & np.any([s[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)], axis=0)
        if (grown | strong == strong).all():
            return strong
        strong = strong | grown


def three_views(image: np.ndarray, size: int = 96) -> np.ndarray:
    """(3, size, size): the gray view, the ink mask (darker than 1 - 8/255) and the edges of the resized image."""
    gray = area_resized(image, size)
    return np.stack([gray, (gray < 1 - 8 / 255).astype(float), edges(gray).astype(float)])


def photometric(image: np.ndarray, seed: int) -> np.ndarray:
    """Seeded brightness, contrast, noise and, in half of the cases, a 3 x 3 blur; values stay in 0..1."""
    r = np.random.default_rng(seed)
    out = (image - 0.5) * r.uniform(0.8, 1.2) + 0.5 + r.uniform(-0.1, 0.1)
    out = out + r.normal(0, r.uniform(0, 0.03), image.shape)
    if r.random() < 0.5:
        p = np.pad(out, 1, mode="edge")
        h, w = image.shape
        out = sum(c * p[dy : dy + h, dx : dx + w] for (dy, dx), c in zip(np.ndindex(3, 3), np.outer([1, 2, 1], [1, 2, 1]).ravel() / 16, strict=True))
    return np.clip(out, 0, 1)


def cropped(image: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    """The part within (x0, y0, x1, y1), cut to the image; a box outside of it gives an empty array."""
    h, w = image.shape[:2]
    x0, y0, x1, y1 = box
    return image[max(0, y0) : max(0, min(h, y1)), max(0, x0) : max(0, min(w, x1))]


def visibility(before: np.ndarray, after: np.ndarray, least: float = 16 / 255) -> dict[str, float]:
    """How visible a change is: changed share of all pixels, of the ink, of the edge pixels, and the largest changed body
    as a share of the ink."""
    changed = np.abs(before - after) > least
    ink = (before < 0.5) | (after < 0.5)
    was, now = edges(before), edges(after)
    body = 0
    if changed.any():
        label = _labels(changed)
        body = int(np.bincount(label[changed]).max())
    part = lambda m, whole: float(m.sum()) / max(1, int(whole.sum()))
    return {"changed": float(changed.mean()), "ink_changed": part(changed & ink, ink), "edge_changed": part(was ^ now, was | now), "largest_body": body / max(1, int(ink.sum()))}


def _labels(mask: np.ndarray) -> np.ndarray:
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        p = np.pad(label, 1)
        near = [p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]]
        new = np.max(near, axis=0) * mask
        if (new == label).all():
            return label
        label = new


def mapped(df: DataFrame, key: str, views: str, side: int, work: Callable[[np.ndarray, int], dict], schema: str) -> DataFrame:
    """``work(image, seed) -> columns`` over every row's first side x side numbers; rows with a null or short view or a NaN
    in it are left out. The seed comes from the key, so results don't depend on partitions."""
    kind = dict(df.dtypes)[key]
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for k, v in zip(pdf["key"], pdf["v"], strict=True):
                if v is None or len(v) < side * side:
                    continue
                x = np.asarray(v[: side * side], float)
                if np.isfinite(x).all():
                    seed = int.from_bytes(str(k).encode()[-7:], "big")
                    got = work(x.reshape(side, side), seed)
                    rows.append((k, *[got[n] for n in names]))
            yield pd.DataFrame(rows, columns=["key", *names])

    return df.selectExpr(f"`{key}` AS key", f"`{views}` AS v").mapInPandas(run, f"key {kind}, {schema}").withColumnRenamed("key", key)
