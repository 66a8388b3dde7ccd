"""Scenes of ordered frames: differences, an adaptive threshold, debounced boundaries, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SENSITIVITY, DEBOUNCE_MS = 0.58, 650
#: Boundaries that the fold of boundaries() appends to one array; appending copies it.
PIECE = 256


def scene_threshold(sensitivity: float = SENSITIVITY) -> float:
    return 0.2 - 0.15 * min(1.0, max(0.0, sensitivity))


def with_difference(frames: DataFrame, difference: Column, name: str = "difference") -> DataFrame:
    """difference: an expression over this row and lag() columns; the first frame's is 0."""
    return frames.withColumn(name, F.coalesce(difference, F.lit(0.0)))


def in_order() -> Window:
    return Window.partitionBy("source_id").orderBy("index")


def adaptive_thresholds(frames: DataFrame, sensitivity: float = SENSITIVITY, difference: str = "difference") -> DataFrame:
    """source_id, threshold: the upper median of the positive differences plus 1.5 standard
    deviations (0.04 at least), within 0.35 and 2.5 of the fixed threshold; with fewer than three,
    the fixed one. The median comes from ranks, so no source is collected."""
    base = scene_threshold(sensitivity)
    d = F.col(difference)
    own = Window.partitionBy("source_id")
    p = frames.where(d > 0).select("source_id", d.alias("d"))
    p = p.withColumn("r", F.row_number().over(own.orderBy("d"))).withColumn("n", F.count("*").over(own))
    stats = p.groupBy("source_id").agg(F.max("n").alias("n"), F.max(F.when(F.col("r") == F.floor(F.col("n") / 2) + 1, F.col("d"))).alias("median"), F.stddev_pop("d").alias("sd"))
    value = F.greatest(F.lit(base * 0.35), F.least(F.lit(base * 2.5), F.col("median") + F.greatest(F.lit(0.04), F.col("sd") * 1.5)))
    sources = frames.select("source_id").distinct()
    return sources.join(stats, "source_id", "left").select("source_id", F.when(F.col("n") >= 3, value).otherwise(F.lit(base)).alias("threshold"))


def boundaries(frames: DataFrame, threshold: Column, debounce_ms: int = DEBOUNCE_MS, difference: str = "difference") -> DataFrame:
    """source_id, index, time_ms of the frames that begin a new scene: the difference reaches the
    threshold and the last accepted boundary (at first, the first frame) is debounce_ms ago.

    A fold over the candidate frames of a source: only those that reach the threshold are gathered.
    Accepted ones are kept in pieces, so time grows with their number, not with its square."""
    first = frames.groupBy("source_id").agg(F.min(F.struct("index", "time_ms")).alias("f"))
    hits = frames.where(F.col(difference) >= threshold).select("source_id", "index", "time_ms").where("index > 0")
    rows = hits.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("index", "time_ms"))).alias("hits")).join(first, "source_id")
    piece = "array<struct<index:int,time_ms:bigint>>"
    empty = F.expr(f"cast(array() as {piece})")

    def step(a: Column, x: Column) -> Column:
        ok = (x["time_ms"] - a["last"] >= debounce_ms) & (x["index"] > F.col("f.index"))
        full = F.size(a["now"]) >= PIECE
        one = F.array(F.struct(x["index"].cast("int").alias("index"), x["time_ms"].alias("time_ms")))
        return F.struct(
            F.when(ok, x["time_ms"]).otherwise(a["last"]).alias("last"),
            F.when(ok & full, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]).alias("done"),
            F.when(ok & full, one).when(ok, F.concat(a["now"], one)).otherwise(a["now"]).alias("now"),
        )

    zero = F.struct(F.col("f.time_ms").alias("last"), F.expr(f"cast(array() as array<{piece}>)").alias("done"), empty.alias("now"))
    found = F.aggregate("hits", zero, step, lambda a: F.flatten(F.concat(a["done"], F.array(a["now"]))))
    return rows.select("source_id", F.explode(found).alias("b")).select("source_id", "b.index", "b.time_ms")


def with_scenes(frames: DataFrame, found: DataFrame) -> DataFrame:
    """frames with scene_index, counted by the boundaries so far, and scene_position (0 to 1; alone: 0.5)."""
    marked = frames.join(found.select("source_id", "index", F.lit(1).alias("__b")), ["source_id", "index"], "left")
    scene = F.sum(F.coalesce("__b", F.lit(0))).over(in_order().rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    marked = marked.withColumn("scene_index", scene).drop("__b")
    own = Window.partitionBy("source_id", "scene_index")
    n = F.count("*").over(own)
    place = (F.row_number().over(own.orderBy("index")) - 1) / (n - 1)
    return marked.withColumn("scene_position", F.when(n == 1, 0.5).otherwise(place))


def ranges(frames: DataFrame) -> DataFrame:
    """source_id, scene_index, start and end index and time of each scene."""
    return frames.groupBy("source_id", "scene_index").agg(
        F.min("index").alias("start_index"), F.max("index").alias("end_index"), F.min_by("time_ms", "index").alias("start_ms"), F.max_by("time_ms", "index").alias("end_ms"),
    )
