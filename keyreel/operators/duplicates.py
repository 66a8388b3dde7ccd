"""Perceptual duplicates: each frame against the earlier frames of its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyreel.functions.pixels import color_distance, hamming

MAX_BITS, MAX_COLOR, NO_MATCH = 4, 0.035, 128
#: Earlier frames of a source that one join key holds.
BLOCK = 1024


def is_duplicate(bits: Column, color: Column, max_bits: int = MAX_BITS, max_color: float = MAX_COLOR) -> Column:
    return (bits <= max_bits) & (color <= max_color)


def nearest_earlier(frames: DataFrame, distance: Column, duplicate: Column) -> DataFrame:
    """source_id, id, min_distance (128 without an earlier frame) and duplicate_of_id (the earliest
    match, which may be a duplicate itself).

    distance and duplicate are over the aliases `b` (this frame) and `a` (an earlier one). The exact
    distance needs all earlier frames; the join is by source and block of them, so that a source of
    very many frames is shared out over tasks."""
    block = F.floor(F.col("index") / BLOCK).cast("int")
    a = frames.withColumn("__block", block).alias("a")
    b = frames.withColumn("__block", F.explode(F.sequence(F.lit(0), block))).alias("b")
    same = (F.col("a.source_id") == F.col("b.source_id")) & (F.col("a.__block") == F.col("b.__block"))
    pairs = b.join(a, same & (F.col("a.index") < F.col("b.index")), "left")
    rows = pairs.select(F.col("b.source_id").alias("source_id"), F.col("b.id").alias("id"), F.col("a.index").alias("i"), F.col("a.id").alias("other"), distance.alias("d"), duplicate.alias("dup"))
    return rows.groupBy("source_id", "id").agg(
        F.coalesce(F.min("d"), F.lit(NO_MATCH)).alias("min_distance"),
        F.min_by("other", F.when(F.col("dup"), F.col("i"))).alias("best"), F.max(F.when(F.col("dup"), 1)).alias("any"),
    ).select("source_id", "id", "min_distance", F.when(F.col("any") == 1, F.col("best")).alias("duplicate_of_id"))


def find_duplicates(features: DataFrame) -> DataFrame:
    """nearest_earlier() by hash and mean colour."""
    bits = hamming(F.col("a.hash"), F.col("b.hash"))
    return nearest_earlier(features.select("source_id", "id", "index", "hash", "mean_rgb"), bits, is_duplicate(bits, color_distance(F.col("a.mean_rgb"), F.col("b.mean_rgb"))))
