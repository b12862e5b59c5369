"""Variants of training images: turned, shifted, recoloured, blurred, in the manner of icons or of photographs.

Every variant has a generator of its own from the seed and its number, so a variant doesn't depend on how many are made or where.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from binmap.operators.training import SEED_STEP
from binmap.vision import images


def _turned(rgb: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Turned by up to 15 degrees, sized by up to a tenth and sheared a little, on white."""
    h, w = rgb.shape[:2]
    angle, size, shear = np.radians(rng.uniform(-15, 15)), rng.uniform(0.9, 1.1), rng.uniform(-0.08, 0.08)
    m = np.array([[np.cos(angle), -np.sin(angle) + shear], [np.sin(angle), np.cos(angle)]]) / size
    y, x = np.mgrid[:h, :w]
    at = np.stack([x - (w - 1) / 2, y - (h - 1) / 2]).reshape(2, -1)
    sx, sy = m @ at + np.array([[(w - 1) / 2], [(h - 1) / 2]])
    return _sampled(rgb, sx, sy).reshape(h, w, 3)


def _sampled(rgb: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Colours at places between pixels; white outside."""
    h, w = rgb.shape[:2]
    padded = np.pad(rgb.astype(float), ((1, 1), (1, 1), (0, 0)), constant_values=255)
    x, y = (x + 1).clip(0, w + 0.999), (y + 1).clip(0, h + 0.999)
    i, j = x.astype(int), y.astype(int)
    a, b = (x - i)[:, None], (y - j)[:, None]
    return (padded[j, i] * (1 - a) + padded[j, i + 1] * a) * (1 - b) + (padded[j + 1, i] * (1 - a) + padded[j + 1, i + 1] * a) * b


def _blurred(rgb: np.ndarray, reach: int) -> np.ndarray:
    for axis in (0, 1):
        padded = np.pad(rgb, [(reach, reach) if k == axis else (0, 0) for k in range(3)], mode="edge")
        sums = np.cumsum(np.insert(padded, 0, 0, axis=axis), axis=axis)
        n = rgb.shape[axis]
        rgb = (np.take(sums, np.arange(2 * reach + 1, n + 2 * reach + 1), axis) - np.take(sums, np.arange(n), axis)) / (2 * reach + 1)
    return rgb


def variant(rgb: np.ndarray, seed: int, style: str = "icon") -> np.ndarray:
    """A variant of an image (h, w, 3). icon: flat shades and dark outlines, as instructions have them; photo: as a camera sees it."""
    if style not in ("icon", "photo"):
        raise ValueError(f"no such style: {style}")
    rng = np.random.default_rng(seed)
    out = _turned(rgb, rng)
    out = (out * rng.uniform(0.9, 1.1, 3) + rng.uniform(-12, 12)).clip(0, 255)
    if style == "icon":
        out = np.rint(out / 48) * 48
        light = out.mean(axis=2)
        step = np.abs(np.diff(light, axis=0, prepend=light[:1])) + np.abs(np.diff(light, axis=1, prepend=light[:, :1]))
        out[step > 60] = 0
    if rng.random() < 0.5:
        out = _blurred(out, 1)
    pad = int(rng.integers(0, 1 + min(rgb.shape[:2]) // 8))
    out = np.pad(out, ((pad, pad), (pad, pad), (0, 0)), constant_values=float(rng.integers(200, 256)))
    return out.clip(0, 255).astype(np.uint8)


def augmented(parts: DataFrame, n: int = 8, style: str = "icon") -> DataFrame:
    """(part_num, variant, content): n variants of each part's image (part_num, seed, content); images that can't be read have none.

    seed as training.part_seeds() gives it; a variant's own is seed * SEED_STEP + its number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seed, data in zip(*(batch.column(c).to_pylist() for c in ("part_num", "seed", "content")), strict=True):
                rgb = images.decode(data)
                made = [] if rgb is None else [images.encode(variant(rgb, abs(seed) * SEED_STEP + i, style)) for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(made), pa.string()), pa.array(range(len(made)), pa.int64()), pa.array(made, pa.binary())], ["part_num", "variant", "content"])

    kind = parts.schema["part_num"]
    return parts.select("part_num", "seed", "content").mapInArrow(run, StructType([kind, StructField("variant", LongType()), StructField("content", BinaryType())]))
