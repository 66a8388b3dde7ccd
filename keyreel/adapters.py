"""Driver tables in the shapes of this engine: events as frames, orders with detections, vectors as grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: The class that stands for each event type.
EVENT_CLASSES = {"view": 0, "click": 63, "purchase": 16, "signup": 2, "error": 39}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame for each event: the user is the source, value the score, the day the scene, and every
    seventh event a duplicate of the one before it."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ms = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    cls = F.lit(None).cast("int")
    for name, i in EVENT_CLASSES.items():
        cls = F.when(F.col("event_type") == name, i).otherwise(cls)
    k = F.regexp_extract("props", "([0-9]+)", 1).try_cast("double")
    return e.select(
        F.col("user_id").alias("source_id"), F.col("event_id").alias("id"), (F.row_number().over(w) - 1).cast("int").alias("index"), ms.alias("time_ms"),
        F.struct(
            (F.dayofmonth("ts") - 1).alias("scene_index"), F.least(F.lit(1.0), F.col("value") / 500.0).alias("composite"),
            ((F.col("event_id") * 7919 % 97) / 96.0).alias("sharpness"), (k / 100.0).alias("exposure"),
            F.when(F.col("event_id") % 7 == 0, (F.col("event_id") - 1).cast("string")).alias("duplicate_of_id"),
        ).alias("metrics"),
        F.array(F.struct(cls.alias("class_id"), F.lit(0.9).alias("confidence"))).alias("detections"), "value",
    )


def flat(frames: DataFrame) -> DataFrame:
    return frames.select("source_id", "id", "index", "time_ms", "metrics.*", "value")


def order_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame for each order; its lines are detections."""
    l = table(spark, sf_dir, "lineitem")
    det = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), (F.col("l_partkey") % 80).cast("int").alias("class_id"), (1 - F.col("l_discount") * 10).alias("confidence"))
    return l.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(det)).alias("detections")).withColumn("source_id", F.col("id") % 100)


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8 x 8 grid for each vector: source is the label, index the rank by id, levels 0 to 1."""
    v = table(spark, sf_dir, "embeddings")
    level = F.transform("embedding", lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x.cast("double") + 0.5)))
    w = Window.partitionBy("label").orderBy("vec_id")
    return v.select(F.col("label").alias("source_id"), F.col("vec_id").alias("id"), (F.row_number().over(w) - 1).cast("int").alias("index"), level.alias("grid"))


def grid_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grids as grey pictures of 8 x 8 pixels, two a second, in the shape of decoded frames."""
    g = grids(spark, sf_dir)
    hexed = F.transform("grid", lambda x: F.repeat(F.lpad(F.hex(F.floor(x * 255 + 0.5).cast("long")), 2, "0"), 3))
    side = lambda n, name: F.lit(n).alias(name)
    return g.select("source_id", "id", "index", (F.col("index") * 500).cast("long").alias("time_ms"), side(8, "width"), side(8, "height"), side(3, "channels"), F.unhex(F.array_join(hexed, "")).alias("data"))
