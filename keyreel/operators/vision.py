"""Detector output: decoding, overlap, suppression, text maps, and the provider protocol."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyreel.errors import FrameError
from keyreel.functions.taxonomy import CLASS_NAMES, GROUPS

# Fixed values of the detector's format.
INPUT_SIZE, STRIDES, PAD = 416, (8, 16, 32), 0x72
CONFIDENCE, IOU = 0.4, 0.45
TEXT_LEVEL, MIN_REGION = 0.3, 24


class VisionProvider(Protocol):
    id: str

    def is_ready(self) -> bool: ...

    def detect_objects(self, rgb: np.ndarray) -> np.ndarray:
        """Raw output (cells, 5 + classes) for an INPUT_SIZE x INPUT_SIZE x 3 image."""


def cell_count(size: int = INPUT_SIZE) -> int:
    return sum((size // s) ** 2 for s in STRIDES)


def grid(size: int = INPUT_SIZE) -> np.ndarray:
    """x, y, stride of every cell, row by row, finest stride first."""
    out = []
    for s in STRIDES:
        y, x = np.mgrid[0 : size // s, 0 : size // s]
        out.append(np.stack([x.ravel(), y.ravel(), np.full(x.size, s)], axis=1))
    return np.concatenate(out).astype(np.float64)


def network_input(rgb: np.ndarray) -> np.ndarray:
    """1 x 3 x size x size float32 in BGR order, 0 to 255."""
    return rgb[..., ::-1].transpose(2, 0, 1)[None].astype(np.float32)


def text_input(rgb: np.ndarray) -> np.ndarray:
    """1 x 3 x height x width float32, normalised by the usual channel means and deviations."""
    mean, sd = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])
    return ((rgb / 255.0 - mean) / sd).transpose(2, 0, 1)[None].astype(np.float32)


def letterboxed(rgb: np.ndarray, size: int = INPUT_SIZE) -> np.ndarray:
    """Shrunk or grown to fit (nearest samples), in the top left corner of a grey square."""
    h, w = rgb.shape[:2]
    k = min(size / w, size / h)
    nh, nw = max(1, int(h * k)), max(1, int(w * k))
    y, x = np.minimum((np.arange(nh) / k).astype(int), h - 1), np.minimum((np.arange(nw) / k).astype(int), w - 1)
    out = np.full((size, size, 3), PAD, np.uint8)
    out[:nh, :nw] = rgb[y[:, None], x[None, :], :3]
    return out


def iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlap of a box (x, y, width, height) with others; 0 where the union is empty."""
    w = np.minimum(a[0] + a[2], b[:, 0] + b[:, 2]) - np.maximum(a[0], b[:, 0])
    h = np.minimum(a[1] + a[3], b[:, 1] + b[:, 3]) - np.maximum(a[1], b[:, 1])
    both = np.maximum(w, 0) * np.maximum(h, 0)
    union = a[2] * a[3] + b[:, 2] * b[:, 3] - both
    return np.where(union > 0, both / np.where(union > 0, union, 1), 0.0)


def suppress(boxes: np.ndarray, scores: np.ndarray, limit: float = IOU) -> list[int]:
    """Indices kept, best first: each overlaps all kept before by less than the limit."""
    kept: list[int] = []
    for i in np.argsort(-scores, kind="stable").tolist():
        if not kept or (iou(boxes[i], boxes[kept]) < limit).all():
            kept.append(i)
    return kept


def decode(raw: np.ndarray, width: int, height: int, confidence: float = CONFIDENCE, size: int = INPUT_SIZE) -> list[dict]:
    """Detections with boxes as shares of the frame's size, best first."""
    raw = np.asarray(raw, np.float32).reshape(cell_count(size), -1).astype(np.float64)
    g = grid(size)
    classes = raw[:, 5:] * raw[:, 4:5]
    best = classes.argmax(axis=1)
    score = classes[np.arange(len(raw)), best]
    at = np.flatnonzero((raw[:, 4] > 0) & (score >= confidence))
    centre = (raw[at, :2] + g[at, :2]) * g[at, 2:]
    extent = np.exp(raw[at, 2:4]) * g[at, 2:]
    boxes = np.concatenate([centre - extent / 2, extent], axis=1)
    found = []
    for c in np.unique(best[at]).tolist():
        own = np.flatnonzero(best[at] == c)
        found += [int(own[i]) for i in suppress(boxes[own], score[at][own])]
    k = min(size / width, size / height)
    out = []
    for i in sorted(found, key=lambda i: -score[at[i]]):
        x, y, w, h = boxes[i] / k
        x0, y0, x1, y1 = (min(1.0, max(0.0, v)) for v in (x / width, y / height, (x + w) / width, (y + h) / height))
        c = int(best[at[i]])
        group = next((name for name, ids in GROUPS.items() if c in ids), None)
        out.append({"class_id": c, "class_name": CLASS_NAMES[c] if c < len(CLASS_NAMES) else f"object_{c}", "group": group, "confidence": float(score[at[i]]), "box": {"x": x0, "y": y0, "width": x1 - x0, "height": y1 - y0}})
    return out


def text_regions(levels: np.ndarray, least: int = MIN_REGION, level: float = TEXT_LEVEL) -> dict:
    """Regions of neighbouring cells above the level, of `least` cells or more, and the share of all cells above."""
    mask = levels > level
    h, w = mask.shape
    label = np.where(mask, np.arange(mask.size).reshape(h, w), -1)
    while True:  # each cell takes the least label of its region
        low = label.copy()
        for a, b in ((np.s_[1:], np.s_[:-1]), (np.s_[:-1], np.s_[1:])):
            for p, q in (((a, np.s_[:]), (b, np.s_[:])), ((np.s_[:], a), (np.s_[:], b))):
                both = mask[p] & mask[q]
                low[p] = np.where(both, np.minimum(low[p], low[q]), low[p])
        if (low == label).all():
            break
        label = low
    regions = []
    names, count = np.unique(label[mask], return_counts=True)
    for name, n in zip(names.tolist(), count.tolist()):
        if n >= least:
            y, x = np.nonzero(label == name)
            regions.append({"x": x.min() / w, "y": y.min() / h, "width": (x.max() - x.min() + 1) / w, "height": (y.max() - y.min() + 1) / h, "pixel_count": n})
    return {"has_text": bool(regions), "coverage": float(mask.sum() / mask.size), "region_count": len(regions), "regions": regions}


_BOX = pa.struct([(n, pa.float64()) for n in ("x", "y", "width", "height")])
_DETECTIONS = pa.list_(pa.struct([("class_id", pa.int32()), ("class_name", pa.string()), ("group", pa.string()), ("confidence", pa.float64()), ("box", _BOX)]))
_TEXT = pa.struct([("has_text", pa.bool_()), ("coverage", pa.float64()), ("region_count", pa.int32()), ("regions", pa.list_(pa.struct([*[(n, pa.float64()) for n in ("x", "y", "width", "height")], ("pixel_count", pa.int32())])))])


def detections_of(raw: Column, width: Column, height: Column, confidence: float = CONFIDENCE) -> Column:
    """Detections of a raw output, an array<float>."""
    from keyreel.schemas import DETECTIONS

    @F.arrow_udf(DETECTIONS)
    def run(raw: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
        return pa.array([decode(r.values.to_numpy(), w.as_py(), h.as_py(), confidence) if r.is_valid else None for r, w, h in zip(raw, width, height)], _DETECTIONS)

    return run(raw, width, height)


def text_of(levels: Column, width: Column, height: Column, least: int = MIN_REGION, level: float = TEXT_LEVEL) -> Column:
    """Text regions of a probability map, an array<float> of height rows."""
    from keyreel.schemas import TEXT

    @F.arrow_udf(TEXT)
    def run(levels: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
        return pa.array([text_regions(v.values.to_numpy().reshape(h.as_py(), w.as_py()), least, level) if v.is_valid else None for v, w, h in zip(levels, width, height)], _TEXT)

    return run(levels, width, height)


def with_detections(pixels: DataFrame, provider: Callable[[], VisionProvider], confidence: float = CONFIDENCE) -> DataFrame:
    """source_id, id and all detections of each pixel row. provider makes a provider once in each task."""
    from keyreel.functions.pixels import image
    from keyreel.schemas import DETECTIONS

    def run(batches):
        p = provider()
        if not p.is_ready():
            raise FrameError("VISION_NOT_READY", f"{p.id} is not ready")
        for b in batches:
            out = []
            for data, w, h, c in zip(*(b.column(n).to_pylist() for n in ("data", "width", "height", "channels"))):
                out.append(decode(p.detect_objects(letterboxed(image(data, w, h, c))), w, h, confidence))
            yield pa.RecordBatch.from_arrays([b.column("source_id"), b.column("id"), pa.array(out, _DETECTIONS)], ["source_id", "id", "detections"])

    return pixels.select("source_id", "id", "width", "height", "channels", "data").mapInArrow(run, f"source_id string, id string, detections {DETECTIONS}")


def detect_text(*_: object) -> None:
    raise FrameError("TEXT_VISION_BLOCKED", "no text model is available")


def box_iou(a: Column, b: Column) -> Column:
    """Overlap of two struct(x, y, width, height) columns."""
    w = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    both = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    union = a["width"] * a["height"] + b["width"] * b["height"] - both
    return F.when(union > 0, both / union).otherwise(0.0)


def suppressed(boxes: Column, limit: float = IOU) -> Column:
    """The kept ones of an array<struct<..., box>> that is sorted best first."""
    return F.aggregate(boxes, F.slice(boxes, 1, 0), lambda kept, c: F.when(F.forall(kept, lambda k: box_iou(k["box"], c["box"]) < limit), F.concat(kept, F.array(c))).otherwise(kept))


def detect_summary(frames: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """source_id, frames_with_objects, detection_count; of the terms' classes only, if given. All
    detections stay stored."""
    from keyreel.functions.taxonomy import resolve

    d = F.col("detections")
    if terms:
        ids = F.array(*[F.lit(i) for i in sorted({i for t in terms for i in resolve(t)})])
        d = F.filter(d, lambda x: F.array_contains(ids, x["class_id"]))
    n = F.coalesce(F.size(d), F.lit(0))
    return frames.select("source_id", n.alias("n")).groupBy("source_id").agg(F.count_if(F.col("n") > 0).alias("frames_with_objects"), F.sum("n").cast("long").alias("detection_count"))
