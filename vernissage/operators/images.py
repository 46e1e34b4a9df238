"""Image statistics, resizing and model inputs, one image row at a time.

An image is one row of Spark's image source (height, width, nChannels, data).
Decoding, resizing and all statistics happen inside that row in Arrow batches:
no pixel table, no shuffle. Sums are whole numbers and divided once. A missing
or unreadable image gives a row of nulls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vernissage.functions import fixed

FULL = 255.0
FULL_GRAY = 255000.0
BINS, LEVELS = 8, 256

CHANNEL_NAMES = tuple(f"img_{c}_{s}" for c in "rgb" for s in ("mean", "std"))
TONE_NAMES = ("img_brightness", "img_saturation", "img_contrast", "img_black_frac", "img_white_frac", "img_warmth")
HISTOGRAM_NAMES = tuple(f"img_{c}_h{k}" for c in "rgb" for k in range(BINS))
GRAY_NAMES = ("img_gray_mean", *(f"img_gray_p{p}" for p in fixed.GRAY_PERCENTILES))
FEATURE_NAMES = (*CHANNEL_NAMES, *TONE_NAMES, *HISTOGRAM_NAMES, *GRAY_NAMES, "img_edge_mean")


def decoded(height: int | None, width: int | None, channels: int | None, data: bytes | None) -> np.ndarray | None:
    """(height, width, 3) levels in R, G, B order; stored bytes are B, G, R(, A) or one gray channel."""
    if not height or not width or height <= 0 or width <= 0 or channels not in (1, 3, 4) or data is None:
        return None
    if len(data) != height * width * channels:
        return None
    stored = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    return (np.repeat(stored, 3, axis=2) if channels == 1 else stored[:, :, 2::-1]).astype(np.int64)


def gray(levels: np.ndarray) -> np.ndarray:
    """Luma in thousandths of a level, 0..255000."""
    return levels @ np.array(fixed.GRAY_WEIGHTS)


def _deviation(values: np.ndarray, scale: float) -> float:
    """Population deviation from whole sums."""
    n, total, squares = float(values.size), float(values.sum()), float((values * values).sum())
    return float(np.sqrt(max(n * squares - total * total, 0.0)) / (n * scale))


def statistics(levels: np.ndarray) -> list[float]:
    """The values of FEATURE_NAMES."""
    n = levels.shape[0] * levels.shape[1]
    flat, luma = levels.reshape(n, 3), gray(levels)
    high, low = flat.max(axis=1), flat.min(axis=1)
    mean = lambda total, scale: float(total) / (n * scale)
    out = []
    for c in range(3):
        out += [mean(flat[:, c].sum(), FULL), _deviation(flat[:, c], FULL)]
    out += [
        mean(high.sum(), FULL),
        float((((high - low) / FULL) / (high / FULL + 1e-7)).mean()),
        _deviation(luma, FULL_GRAY),
        float((luma < 0.1 * FULL_GRAY).sum()) / n,
        float((luma > 0.9 * FULL_GRAY).sum()) / n,
        mean((flat[:, 0] - flat[:, 2]).sum(), FULL),
    ]
    width = LEVELS // BINS
    for c in range(3):
        out += [float(k) / (n * width) for k in np.bincount(flat[:, c] // width, minlength=BINS)]
    out += [mean(luma.sum(), FULL_GRAY), *(np.percentile(luma, fixed.GRAY_PERCENTILES) / FULL_GRAY).tolist()]
    down, right = np.abs(np.diff(luma, axis=0)), np.abs(np.diff(luma, axis=1))
    if down.size and right.size:
        out.append((float(down.sum()) / down.size + float(right.sum()) / right.size) / 2 / FULL_GRAY)
    else:
        out.append(None)
    return out


def _axis(size: int, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source cells, first of each target cell, how many): several when shrinking, one when growing."""
    if size < target:
        return np.arange(target) * size // target, np.arange(target), np.ones(target, dtype=np.int64)
    cell = np.arange(size) * target // size
    return np.arange(size), np.searchsorted(cell, np.arange(target)), np.bincount(cell, minlength=target)


def block_average(levels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Block average to width x height cells, rounded half up to whole levels."""
    rows, row_first, row_n = _axis(levels.shape[0], height)
    columns, column_first, column_n = _axis(levels.shape[1], width)
    sums = np.add.reduceat(np.add.reduceat(levels[rows][:, columns], row_first, axis=0), column_first, axis=1)
    n = (row_n[:, None] * column_n)[:, :, None]
    return (2 * sums + n) // (2 * n)


def _triangle(t: np.ndarray) -> np.ndarray:
    return np.maximum(1 - t, 0.0)


def _cubic(t: np.ndarray) -> np.ndarray:
    """Cubic convolution with slope -1/2 at distance 1."""
    near, far = ((1.5 * t - 2.5) * t) * t + 1, ((-0.5 * t + 2.5) * t - 4) * t + 2
    return np.where(t < 1, near, np.where(t < 2, far, 0.0))


KERNELS = {"triangle": _triangle, "cubic": _cubic}


@lru_cache(maxsize=256)
def kernel_weights(size: int, target: int, kernel: str) -> np.ndarray:
    """(target, size) weights with rows of sum 1; the kernel is as many times wider as the axis shrinks."""
    scale = size / target
    centers = (np.arange(target) + 0.5) * scale
    distance = np.abs(np.arange(size) + 0.5 - centers[:, None]) / max(scale, 1.0)
    weights = KERNELS[kernel](distance)
    return weights / weights.sum(axis=1, keepdims=True)


def kernel_resize(levels: np.ndarray, width: int, height: int, kernel: str = "cubic") -> np.ndarray:
    """Antialiased resampling along one axis after the other, rounded half up to levels 0..255."""
    down, across = (kernel_weights(n, target, kernel) for n, target in zip(levels.shape[:2], (height, width), strict=True))
    narrow = np.tensordot(across, levels, (1, 1))
    sums = np.tensordot(down, narrow, (1, 1))
    return np.clip(np.floor(np.round(sums, 6) + 0.5), 0, LEVELS - 1).astype(np.int64)


def resize(levels: np.ndarray, width: int, height: int, method: str = "block") -> np.ndarray:
    """Block average, or one of KERNELS."""
    return block_average(levels, width, height) if method == "block" else kernel_resize(levels, width, height, method)


def shorter_side(levels: np.ndarray, side: int, method: str = "block") -> np.ndarray:
    """Keeps the aspect ratio; the longer side is cut to whole cells."""
    height, width = levels.shape[:2]
    short = min(height, width)
    return resize(levels, width * side // short, height * side // short, method)


def center(levels: np.ndarray, side: int) -> np.ndarray:
    """The middle side x side cells, fewer where the image is smaller."""
    top, left = (int(np.rint((n - side) / 2)) for n in levels.shape[:2])
    return levels[max(top, 0) : max(top + side, 0), max(left, 0) : max(left + side, 0)]


def standardised(levels: np.ndarray) -> np.ndarray:
    """Channel standardisation before inference."""
    return (levels / FULL - np.array(fixed.CHANNEL_MEAN)) / np.array(fixed.CHANNEL_STD)


def _per_image(images: DataFrame, work: Callable[[np.ndarray], list], form: str, key: str) -> DataFrame:
    """key and the columns of `form`, which `work` gives for the levels of a readable image."""
    rows = images.select(
        F.col(key).alias("key"), *[F.col(f"image.{c}").alias(c) for c in ("height", "width", "nChannels", "data")]
    )
    kind = rows.schema["key"].dataType.simpleString()
    plain = {"double": pa.float64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
    names, kinds = zip(*(part.split() for part in form.split(", ")), strict=True)
    arrow = [plain[k] for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for fields in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                levels = decoded(*fields)
                out.append([None] * len(names) if levels is None else work(levels))
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            arrays = [pa.array(c, t) for c, t in zip(columns, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["key", *names])

    return rows.mapInArrow(run, f"key {kind}, {form}").withColumnRenamed("key", key)


def image_features(images: DataFrame, key: str = "id", side: int | None = fixed.IMAGE_SIDE, method: str = "block") -> DataFrame:
    """All 43 statistics per image row, after resizing to side x side (not at all with None)."""
    def work(levels: np.ndarray) -> list:
        return statistics(levels if side is None else resize(levels, side, side, method))

    return _per_image(images, work, ", ".join(f"{n} double" for n in FEATURE_NAMES), key)


def resized(images: DataFrame, side: int, key: str = "id", keep_aspect: bool = False, crop: int | None = None, method: str = "block") -> DataFrame:
    """(key, w, h, levels): R, G, B of the cells in row order, after resizing and an optional centre crop."""
    def work(levels: np.ndarray) -> list:
        small = shorter_side(levels, side, method) if keep_aspect else resize(levels, side, side, method)
        small = small if crop is None else center(small, crop)
        return [small.shape[1], small.shape[0], small.ravel()]

    return _per_image(images, work, "w int, h int, levels array<int>", key)


def model_inputs(images: DataFrame, side: int, crop: int, key: str = "id", method: str = "block") -> DataFrame:
    """(key, tensor): resized by the shorter side, cropped and standardised; crop x crop x 3 numbers.

    An image that the crop does not fill counts as unreadable.
    """
    def work(levels: np.ndarray) -> list:
        small = center(shorter_side(levels, side, method), crop)
        return [standardised(small).ravel() if small.shape[:2] == (crop, crop) else None]

    return _per_image(images, work, "tensor array<double>", key)


def cells(rows: DataFrame, key: str = "id", values: str = "levels") -> DataFrame:
    """(key, px, py, r, g, b) of resized images, for inspection."""
    at = rows.select(key, "w", values, F.explode(F.sequence(F.lit(0), F.col("w") * F.col("h") - 1)).alias("i"))
    return at.select(
        key, (F.col("i") % F.col("w")).alias("px"), F.floor(F.col("i") / F.col("w")).cast("int").alias("py"),
        *[F.get(values, F.col("i") * 3 + k).alias(c) for k, c in enumerate("rgb")],
    )
