"""Table schemas; every source is read with one of these, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROBES = (
    "source_id STRING, path STRING, duration_sec DOUBLE, width INT, height INT, coded_width INT, coded_height INT, rotation DOUBLE, "
    "fps DOUBLE, codec STRING, container STRING, has_audio BOOLEAN, size_bytes BIGINT"
)
METRICS = (
    "STRUCT<scene_index INT, scene_difference DOUBLE, sharpness DOUBLE, exposure DOUBLE, uniqueness DOUBLE, scene_position DOUBLE, composite DOUBLE, "
    "blur_variance DOUBLE, exposure_mean DOUBLE, exposure_clipped_ratio DOUBLE, duplicate_of_id STRING, hash ARRAY<BIGINT>>"
)
BOX = "STRUCT<x DOUBLE, y DOUBLE, width DOUBLE, height DOUBLE>"
DETECTIONS = f"ARRAY<STRUCT<class_id INT, class_name STRING, `group` STRING, confidence DOUBLE, box {BOX}>>"
TEXT = "STRUCT<has_text BOOLEAN, coverage DOUBLE, region_count INT, regions ARRAY<STRUCT<x DOUBLE, y DOUBLE, width DOUBLE, height DOUBLE, pixel_count INT>>>"
FRAMES = f"source_id STRING, id STRING, index INT, time_ms BIGINT, time_sec DOUBLE, path STRING, width INT, height INT, metrics {METRICS}, detections {DETECTIONS}, text {TEXT}"
PIXELS = "source_id STRING, id STRING, index INT, time_ms BIGINT, width INT, height INT, channels INT, data BINARY"
SELECTIONS = "source_id STRING, pos INT, frame_id STRING, time_ms BIGINT, time_sec DOUBLE, reasons ARRAY<STRUCT<code STRING, message STRING>>"
SAMPLING = (
    "STRUCT<strategy STRING, requested_interval_sec DOUBLE, effective_interval_sec DOUBLE, requested_count INT, requested_fps DOUBLE, timestamps_sec ARRAY<DOUBLE>, "
    "from_sec DOUBLE, to_sec DOUBLE, count INT, capped BOOLEAN, budget INT, equal_density BOOLEAN, timestamp_basis STRING>"
)
MANIFESTS = f"source_id STRING, version INT, created_at TIMESTAMP, updated_at TIMESTAMP, source_path STRING, sampling {SAMPLING}, detections_complete BOOLEAN, detection_min_confidence DOUBLE, text_complete BOOLEAN"

_UNIT = ("sharpness", "exposure", "uniqueness", "scene_position", "composite")


def validated(frames: DataFrame) -> DataFrame:
    """frames, with a failure at the first row whose numbers are out of range."""
    ok = (F.col("index") >= 0) & (F.col("time_ms") >= 0)
    for c in _UNIT:
        v = F.col(f"metrics.{c}")
        ok = ok & (v.isNull() | v.between(0, 1))
    checked = F.when(ok, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("frame out of range: "), F.coalesce("id", F.lit("null")))))
    return frames.withColumn("id", checked)
