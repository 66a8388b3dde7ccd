"""Pixel features of RGB buffers: numpy on Arrow batches, one Python step for all of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LUMA = np.array([0.2126, 0.7152, 0.0722])
GRID = (32, 18)  # columns, rows of the luma used for differences
SHARP_GRID = (64, 36)


def channels_of(size: int, width: int, height: int) -> int:
    return 3 if size == width * height * 3 else 4


def image(data: bytes, width: int, height: int, channels: int | None = None) -> np.ndarray:
    """height x width x channels; fails on a buffer that is too short."""
    c = channels or channels_of(len(data), width, height)
    if width <= 0 or height <= 0 or len(data) < width * height * c:
        raise ValueError(f"pixel buffer of {len(data)} bytes is too short for {width} x {height} x {c}")
    return np.frombuffer(data, np.uint8, width * height * c).reshape(height, width, c)


def luma_grid(img: np.ndarray, cols: int, rows: int) -> np.ndarray:
    """Luma at the centres of a grid, as float32, rows x cols."""
    y = ((np.arange(rows) + 0.5) * img.shape[0] / rows).astype(int)
    x = ((np.arange(cols) + 0.5) * img.shape[1] / cols).astype(int)
    p = img[y[:, None], x[None, :], :3].astype(np.float64)
    return ((p[..., 0] * LUMA[0] + p[..., 1] * LUMA[1] + p[..., 2] * LUMA[2]) / 255).astype(np.float32)


def mean_rgb(img: np.ndarray) -> np.ndarray:
    return img[..., :3].reshape(-1, 3).astype(np.float64).mean(axis=0) / 255


def blur(img: np.ndarray) -> tuple[float, float]:
    """Variance of the 4-neighbour Laplacian of the luma, and the sharpness score."""
    cols, rows = min(SHARP_GRID[0], img.shape[1]), min(SHARP_GRID[1], img.shape[0])
    if cols < 3 or rows < 3:
        return 0.0, 0.0
    l = luma_grid(img, cols, rows).astype(np.float64)
    lap = l[:-2, 1:-1] + l[2:, 1:-1] + l[1:-1, :-2] + l[1:-1, 2:] - 4 * l[1:-1, 1:-1]
    v = max(0.0, float((lap * lap).mean() - lap.mean() ** 2))
    return v, min(1.0, max(0.0, float(np.log1p(2000 * v) / np.log(81))))


def exposure(img: np.ndarray) -> tuple[float, float, float]:
    """Mean luma, share of clipped samples, and the exposure score."""
    l = luma_grid(img, min(SHARP_GRID[0], img.shape[1]), min(SHARP_GRID[1], img.shape[0])).astype(np.float64)
    mean, clipped = float(l.mean()), float(((l <= 0.025) | (l >= 0.975)).mean())
    score = 0.65 * max(0.0, 1 - abs(mean - 0.5) / 0.5) + 0.35 * max(0.0, 1 - 2.5 * clipped)
    return mean, clipped, min(1.0, max(0.0, score))


def difference_hash(img: np.ndarray) -> list[int]:
    """128 bits in four words: brighter than the right neighbour (9 x 8), than the one below (8 x 9)."""
    h, v = luma_grid(img, 9, 8), luma_grid(img, 8, 9)
    bits = np.concatenate([(h[:, :-1] > h[:, 1:]).ravel(), (v[:-1] > v[1:]).ravel()])
    return [int(w) for w in np.packbits(bits, bitorder="little").view("<u4")]


FEATURES = "luma array<float>, mean_rgb array<double>, blur_variance double, sharpness double, exposure_mean double, exposure_clipped_ratio double, exposure double, hash array<bigint>"


def _features(batches):
    for batch in batches:
        rows: list[dict] = []
        for data, w, h, c in zip(*(batch.column(n).to_pylist() for n in ("data", "width", "height", "channels"))):
            img = image(data, w, h, c)
            v, sharp = blur(img)
            mean, clipped, exp = exposure(img)
            rows.append({
                "luma": luma_grid(img, *GRID).ravel().tolist(), "mean_rgb": mean_rgb(img).tolist(), "blur_variance": v, "sharpness": sharp,
                "exposure_mean": mean, "exposure_clipped_ratio": clipped, "exposure": exp, "hash": difference_hash(img),
            })
        keys = [batch.column(n) for n in ("source_id", "id", "index", "time_ms")]
        kinds = {"luma": pa.list_(pa.float32()), "mean_rgb": pa.list_(pa.float64()), "hash": pa.list_(pa.int64())}
        names = list(FEATURES.replace("<float>", "").replace("<double>", "").replace("<bigint>", "").replace(" array", "").replace(" double", "").split(", "))
        cols = [pa.array([r[n] for r in rows], kinds.get(n, pa.float64())) for n in names]
        yield pa.RecordBatch.from_arrays([*keys, *cols], ["source_id", "id", "index", "time_ms", *names])


def with_features(pixels: DataFrame) -> DataFrame:
    """source_id, id, index, time_ms and the features of each pixel row."""
    p = pixels.select("source_id", "id", "index", "time_ms", "width", "height", "channels", "data")
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in p.schema.fields[:4])
    return p.mapInArrow(_features, f"{keys}, {FEATURES}")


def color_distance(a: Column, b: Column) -> Column:
    """Distance of two mean colours over the longest possible; missing channels are 0."""
    d = lambda i: F.coalesce(F.get(a, F.lit(i)), F.lit(0.0)) - F.coalesce(F.get(b, F.lit(i)), F.lit(0.0))
    return F.sqrt(d(0) * d(0) + d(1) * d(1) + d(2) * d(2)) / F.sqrt(F.lit(3.0))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(F.coalesce(x, F.lit(0)).bitwiseXOR(F.coalesce(y, F.lit(0))))), F.lit(0), lambda s, x: s + x)


def frame_difference(luma_a: Column, luma_b: Column, rgb_a: Column, rgb_b: Column) -> Column:
    """0.72 of the mean luma difference and 0.28 of the colour distance, 1 at most; null without one of the frames."""
    total = F.aggregate(F.zip_with(luma_a, luma_b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    both = luma_a.isNotNull() & luma_b.isNotNull()
    return F.when(both, F.least(F.lit(1.0), total / F.size(luma_a) * 0.72 + color_distance(rgb_a, rgb_b) * 0.28))
