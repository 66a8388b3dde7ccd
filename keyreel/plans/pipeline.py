"""From pixels to selections: the analysis of all sources in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyreel.functions.pixels import frame_difference, with_features
from keyreel.operators import duplicates, scenes, scoring
from keyreel.operators.select import SelectOptions, apply_preset, select
from keyreel.schemas import METRICS


def analyze(pixels: DataFrame, sensitivity: float = scenes.SENSITIVITY, debounce_ms: int = scenes.DEBOUNCE_MS, weights: dict[str, float] | None = None) -> DataFrame:
    """source_id, id, index, time_ms, metrics and recommended of every frame.

    The features are the only Python step; they are used three times, so they are kept."""
    f = with_features(pixels).persist()
    w = scenes.in_order()
    diff = frame_difference(F.col("luma"), F.lag("luma").over(w), F.col("mean_rgb"), F.lag("mean_rgb").over(w))
    d = scenes.with_difference(f, diff)
    d = d.join(scenes.adaptive_thresholds(d.select("source_id", "difference"), sensitivity), "source_id")
    found = scenes.boundaries(d.select("source_id", "index", "time_ms", "difference", "threshold"), F.col("threshold"), debounce_ms)
    s = scenes.with_scenes(d.drop("luma", "mean_rgb"), found)
    s = s.join(duplicates.find_duplicates(f), ["source_id", "id"])
    s = s.withColumn("uniqueness", scoring.uniqueness(F.col("min_distance"), F.col("duplicate_of_id")))
    s = s.withColumn("scene_position", scoring.position_score(F.col("scene_position")))
    s = s.withColumn("composite", scoring.composite(weights)).withColumnRenamed("difference", "scene_difference")
    best = scoring.pareto_keepers(s).select("source_id", "id", F.lit(True).alias("recommended"))
    s = s.join(best, ["source_id", "id"], "left")
    names = [part.split()[0] for part in METRICS[len("STRUCT<") : -1].split(", ")]
    return s.select("source_id", "id", "index", "time_ms", F.struct(*[F.col(n) for n in names]).alias("metrics"), F.coalesce("recommended", F.lit(False)).alias("recommended"))


def with_metrics(frames: DataFrame, scan: DataFrame) -> DataFrame:
    """frames with the metrics of a scan; those that it lacks have none."""
    return frames.drop("metrics").join(scan.select("source_id", "id", "metrics"), ["source_id", "id"], "left")


def run(frames: DataFrame, preset: str | None = None, options: SelectOptions = SelectOptions()) -> DataFrame:
    """The selections of analysed frames, by a preset and options that go before it."""
    return select(frames, apply_preset(preset, options) if preset else options)
