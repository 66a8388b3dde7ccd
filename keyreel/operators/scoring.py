"""Composite scores, reasons, the Pareto front, keyframes and scan summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the composite score.
WEIGHTS = {"sharpness": 0.45, "exposure": 0.25, "uniqueness": 0.2, "scene_position": 0.1}
BLURRY = 0.28


def normalized(weights: dict[str, float] | None = None) -> dict[str, float]:
    """Weights that sum to 1; negative ones count as 0, and without any the defaults hold."""
    w = {k: max(0.0, float((weights or {}).get(k, v))) for k, v in WEIGHTS.items()}
    total = sum(w.values())
    return {k: v / total for k, v in w.items()} if total > 0 else dict(WEIGHTS)


def uniqueness(min_distance: Column, duplicate_of: Column) -> Column:
    return F.when(duplicate_of.isNotNull(), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), min_distance / 24.0)))


def position_score(relative: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(relative - 0.5) * 1.25)


def composite(weights: dict[str, float] | None = None, prefix: str = "") -> Column:
    w = normalized(weights)
    out = F.lit(0.0)
    for k, v in w.items():
        out = out + F.col(prefix + k) * v
    return out


def strongest(prefix: str = "") -> Column:
    """The name of the greatest component; the first in the order of WEIGHTS among equals."""
    best = F.greatest(*[F.col(prefix + k) for k in WEIGHTS])
    out = F.lit(None).cast("string")
    for k in reversed(WEIGHTS):
        out = F.when(F.col(prefix + k) == best, k).otherwise(out)
    return out


def pareto_front(frames: DataFrame, score: str = "composite", sharpness: str = "sharpness") -> DataFrame:
    """Rows of each source that no other row beats in one of both scores and equals or beats in the other.

    Two windows instead of a join of all pairs: no higher score has as much sharpness, and no
    equal sharpness a higher score."""
    above = Window.partitionBy("source_id").orderBy(F.desc(score)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    level = Window.partitionBy("source_id", sharpness)
    marked = frames.withColumn("__s", F.max(sharpness).over(above)).withColumn("__c", F.max(score).over(level))
    return marked.where((F.col("__s") <= F.col(sharpness)) & (F.col("__c") <= F.col(score))).drop("__s", "__c")


def pareto_keepers(frames: DataFrame, score: str = "composite", sharpness: str = "sharpness", duplicate: str = "duplicate_of_id") -> DataFrame:
    """The front of the frames that are no duplicates, from the mean score plus half a standard
    deviation (0.04 at least) on; where none of a source reaches it, the whole front.
    A source's first frame is never a duplicate, so the front of a source that has frames is never empty."""
    own = Window.partitionBy("source_id")
    pool = frames.where(F.col(duplicate).isNull())
    pool = pool.withColumn("__t", F.avg(score).over(own) + F.greatest(F.lit(0.04), F.stddev_pop(score).over(own) * 0.5))
    front = pareto_front(pool, score, sharpness).withColumn("__ok", F.col(score) >= F.col("__t"))
    front = front.withColumn("__any", F.max("__ok").over(own))
    return front.where("__ok or not __any").drop("__t", "__ok", "__any")


def recommendation_bounds(least: int = 5, most: int = 10) -> dict[str, int]:
    """The bounds that a scan tells beside its recommendations. They are told only: what is recommended
    follows from the fronts alone."""
    most = max(1, most)
    return {"min_recommendations": min(max(1, least), most), "max_recommendations": most}


def scene_keyframes(frames: DataFrame, score: str = "composite", duplicate: str = "duplicate_of_id") -> DataFrame:
    """The best frame of each scene that is no duplicate; the first among equals."""
    w = Window.partitionBy("source_id", F.coalesce("scene_index", F.lit(0))).orderBy(F.desc(score), "index")
    return frames.where(F.col(duplicate).isNull()).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def scan_summary(frames: DataFrame) -> DataFrame:
    """Counts of each source: frames, scenes, blurry ones, duplicates, recommended ones (where marked)."""
    rec = F.count_if("recommended") if "recommended" in frames.columns else F.lit(None).cast("bigint")
    return frames.groupBy("source_id").agg(
        F.count("*").alias("sampled_count"), (F.max("scene_index") + 1).cast("long").alias("scene_count"), F.count_if(F.col("sharpness") < BLURRY).alias("blurry_count"),
        F.count_if(F.col("duplicate_of_id").isNotNull()).alias("duplicate_count"), rec.alias("recommended_count"),
    )
