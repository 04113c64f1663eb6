"""Kernels over pixel arrays in numpy, and their Arrow batch wrappers. Images are arrays in binary columns with width and height.

Decoding of image files is left to adapters; these kernels take decoded pixels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def components(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Labels of the 8-connected parts of a mask, from 1 in order of first appearance. Joins runs of rows by union-find."""
    labels = np.zeros(mask.shape, np.int32)
    parent = [0]

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    previous: list[tuple[int, int, int]] = []
    for y in range(mask.shape[0]):
        edges = np.flatnonzero(np.diff(np.r_[0, mask[y].astype(np.int8), 0]))
        runs, k = [], 0
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            while k < len(previous) and previous[k][1] < a:
                k += 1
            mine, j = 0, k
            while j < len(previous) and previous[j][0] <= b:
                other = find(previous[j][2])
                if mine and other != mine:
                    parent[max(mine, other)] = min(mine, other)
                    mine = min(mine, other)
                mine = mine or other
                j += 1
            if not mine:
                parent.append(len(parent))
                mine = len(parent) - 1
            labels[y, a:b] = mine
            runs.append((a, b, mine))
        previous = runs
    roots = np.array([find(i) for i in range(len(parent))])
    uniq, number = np.unique(roots, return_inverse=True)
    return number[labels].astype(np.int32), len(uniq) - 1


def dilate(mask: np.ndarray, width: int, height: int) -> np.ndarray:
    """Dilation by a centred rectangle."""
    out = mask.copy()
    for axis, n in ((1, width), (0, height)):
        grown = out.copy()
        for d in range(1, n // 2 + 1):
            for s in (d, -d):
                moved = np.zeros_like(out)
                src = [slice(None), slice(None)]
                dst = [slice(None), slice(None)]
                src[axis], dst[axis] = (slice(None, -s), slice(s, None)) if s > 0 else (slice(-s, None), slice(None, s))
                moved[tuple(dst)] = out[tuple(src)]
                grown |= moved
        out = grown
    return out


def revision_changes(before: np.ndarray, after: np.ndarray, least_delta: int = 18, least_pixels: int = 20, most: int = 8) -> tuple[float, list[tuple]]:
    """Changed fraction and the largest changed boxes (x, y, width, height, pixels) between two renders (height, width, 3)."""
    raw = np.abs(before.astype(np.int16) - after.astype(np.int16)).max(axis=2) >= least_delta
    if not raw.any():
        return 0.0, []
    labels, n = components(dilate(raw, 9, 5))
    boxes = []
    for label in range(1, n + 1):
        here = labels == label
        pixels = int((raw & here).sum())
        if pixels >= least_pixels:
            ys, xs = np.flatnonzero(here.any(axis=1)), np.flatnonzero(here.any(axis=0))
            boxes.append((int(xs[0]), int(ys[0]), int(xs[-1] - xs[0] + 1), int(ys[-1] - ys[0] + 1), pixels))
    boxes.sort(key=lambda b: -b[4])
    return float(raw.mean()), boxes[:most]


def block_outliers(energy: np.ndarray, threshold: float) -> list[tuple]:
    """Outlying parts of a grid of block energies: (x, y, width, height, highest robust z), the highest first."""
    middle = np.median(energy)
    mad = np.median(np.abs(energy - middle))
    z = (energy - middle) / max(1e-3, 1.4826 * mad)
    if energy.size < 9 or mad < 1e-3:
        z = np.zeros_like(z)
    labels, n = components(z >= threshold)
    out = []
    for label in range(1, n + 1):
        here = labels == label
        ys, xs = np.flatnonzero(here.any(axis=1)), np.flatnonzero(here.any(axis=0))
        out.append((int(xs[0]), int(ys[0]), int(xs[-1] - xs[0] + 1), int(ys[-1] - ys[0] + 1), float(z[here].max())))
    return sorted(out, key=lambda b: -b[4])


def block_percentile(values: np.ndarray, side: int = 64, q: float = 75) -> np.ndarray:
    """Percentile of each block of a plane; blocks at the border may be smaller."""
    rows, cols = -(-values.shape[0] // side), -(-values.shape[1] // side)
    return np.array([[np.percentile(values[r * side : (r + 1) * side, c * side : (c + 1) * side], q) for c in range(cols)] for r in range(rows)])


def shifted_dice(left: np.ndarray, right: np.ndarray, reach: int = 2) -> float:
    """Best Dice coefficient of two masks over small shifts of the second."""
    best, (h, w) = 0.0, left.shape
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            moved = np.zeros_like(right)
            moved[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] = right[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
            if total := left.sum() + moved.sum():
                best = max(best, float(2 * (left & moved).sum() / total))
    return best


def area_resize(plane: np.ndarray, width: int, height: int) -> np.ndarray:
    """Resize by area: each target pixel is the mean of the source it covers, borders by their share."""

    def weights(n, m):
        edges = np.linspace(0, n, m + 1)
        at = np.arange(n)
        return np.clip(np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at), 0, None) * (m / n)

    return weights(plane.shape[0], height) @ plane.astype(float) @ weights(plane.shape[1], width).T


def otsu(plane: np.ndarray) -> int:
    """The grey level that best parts a plane of bytes in two classes."""
    n = np.bincount(plane.ravel(), minlength=256).astype(float)
    low = np.cumsum(n)
    mean = np.cumsum(n * np.arange(256))
    high, total = low[-1] - low, mean[-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        between = low * high * (mean / low - (total - mean) / high) ** 2
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def mark_mask(grey: np.ndarray, width: int = 96, height: int = 48) -> np.ndarray | None:
    """Foreground of a mark in a fixed frame; None if it has little contrast, extent or ink, or too much ink."""
    if grey.size < 256 or np.percentile(grey, 95) - np.percentile(grey, 5) < 18:
        return None
    ink = grey < min(240.0, np.percentile(grey, 90) - 12.0)
    ys, xs = np.flatnonzero(ink.any(axis=1)), np.flatnonzero(ink.any(axis=0))
    if not len(ys) or xs[-1] - xs[0] < 7 or ys[-1] - ys[0] < 5:
        return None
    part = area_resize(grey[ys[0] : ys[-1] + 1, xs[0] : xs[-1] + 1], width, height)
    part = np.rint(part).astype(np.uint8)
    mask = part <= otsu(part)
    return mask if 0.01 <= mask.mean() <= 0.60 else None


def revision_diffs(pairs: DataFrame) -> DataFrame:
    """(doc_id, page, changed, boxes) from pairs of renders: doc_id, page, width, height, before, after (RGB bytes)."""
    schema = T.StructType.fromDDL("doc_id bigint, page int, changed double, boxes array<struct<x:int,y:int,width:int,height:int,pixels:int>>")
    kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("x", "y", "width", "height", "pixels")]))

    def run(batches):
        for batch in batches:
            changed, boxes = [], []
            for w, h, a, b in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                share, found = revision_changes(*(np.frombuffer(x, np.uint8).reshape(h, w, 3) for x in (a, b)))
                changed.append(share)
                boxes.append([dict(zip(("x", "y", "width", "height", "pixels"), x, strict=True)) for x in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(changed), pa.array(boxes, kind)], names=schema.names)

    return pairs.select("doc_id", "page", "width", "height", "before", "after").mapInArrow(run, schema)


def mark_similarity(pairs: DataFrame) -> DataFrame:
    """(pair_id, similarity) of mask pairs: pair_id, width, height, left, right (bytes, one a pixel)."""
    schema = T.StructType([pairs.schema["pair_id"], T.StructField("similarity", T.DoubleType())])

    def run(batches):
        for batch in batches:
            out = []
            for w, h, a, b in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                out.append(shifted_dice(*(np.frombuffer(x, np.uint8).reshape(h, w) > 0 for x in (a, b))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=schema.names)

    return pairs.select("pair_id", "width", "height", "left", "right").mapInArrow(run, schema)
