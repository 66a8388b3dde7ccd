"""Sampling plans as column expressions, and the rows that a plan asks for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyreel.errors import FrameError

INTERVAL, BUDGET, EPSILON = 0.5, 1200, 1e-10
WARN_FRAMES, WARN_BYTES, FRAME_BYTES = 5000, 2 << 30, 200_000
MODES = ("every", "fps", "count", "at", "all")


def _rows(n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(n - EPSILON).cast("int"))


def with_plan(probes: DataFrame, *, every: float | None = None, fps: float | None = None, count: int | None = None, at: list[float] | None = None, all_: bool = False,
              start: float = 0.0, end: float | None = None, budget: int | None = BUDGET) -> DataFrame:
    """probes with plan: strategy, interval, count, capped, equal_density, timestamps, range.

    budget None leaves the count as it is. At most one mode may be given."""
    given = [m for m, v in zip(MODES, (every, fps, count, at, all_ or None)) if v is not None]
    if len(given) > 1:
        raise FrameError("USAGE", f"choose one of {', '.join(MODES)}")
    for name, v in (("every", every), ("fps", fps), ("count", count)):
        if v is not None and not v > 0:
            raise FrameError("USAGE", f"{name} must be positive")
    duration = F.col("duration_sec")
    to = duration if end is None else F.least(F.lit(float(end)), duration)
    to = F.when(F.lit(float(start)) >= to, F.raise_error(F.lit("USAGE: the range begins at or after its end"))).otherwise(to).cast("double")
    span = to - F.lit(float(start))
    mode = given[0] if given else "default"
    if mode == "at":
        times = F.array_sort(F.filter(F.array_distinct(F.array(*[F.lit(float(t)) for t in at])), lambda t: (t >= start) & (t < to)))
        wanted = F.size(times)
        times = F.when(wanted == 0, F.raise_error(F.lit("USAGE: no timestamp within the range"))).otherwise(times).cast("array<double>")
    elif mode == "count":
        wanted = F.lit(int(count))
    elif mode == "fps":
        wanted = _rows(span / (1.0 / fps))
    elif mode == "all":
        wanted = _rows(span * F.when(F.coalesce("fps", F.lit(0.0)) > 0, F.col("fps")).otherwise(30.0))
    else:
        wanted = _rows(span / (INTERVAL if every is None else every))
    n = wanted if budget is None else F.least(wanted, F.lit(budget))
    capped = F.lit(False) if budget is None else wanted > budget
    if mode == "at":
        interval = F.lit(None).cast("double")
        times = times if budget is None else F.slice(times, 1, budget)
    elif mode == "count":
        interval = span / n
    elif mode == "fps":
        interval = F.when(capped, span / n).otherwise(1.0 / fps)
    elif mode == "all":
        interval = span / n
    else:
        interval = F.when(capped, span / n).otherwise(INTERVAL if every is None else every)
    return probes.withColumn("plan", F.struct(
        F.lit("every" if mode == "default" else mode).alias("strategy"), F.lit(float(start)).alias("from_sec"), to.alias("to_sec"), interval.alias("interval_sec"),
        n.cast("int").alias("count"), capped.alias("capped"), (~capped).alias("equal_density"),
        (times if mode == "at" else F.lit(None)).cast("array<double>").alias("timestamps"),
    ))


def plan_times(plan: Column) -> Column:
    """The times of a plan: those given, else count steps from the start, before the end."""
    start, n = plan["from_sec"], plan["count"]
    steps = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: start + i * plan["interval_sec"]), lambda t: t < plan["to_sec"] - EPSILON)
    none = F.expr("cast(array() as array<double>)")
    return F.when(plan["timestamps"].isNotNull(), plan["timestamps"]).when(n == 0, none).when(n == 1, F.array(start)).otherwise(steps)


def planned_rows(planned: DataFrame) -> DataFrame:
    """A row for each time of each source: source_id, index, time_ms, time_sec."""
    rows = planned.select("source_id", F.posexplode(plan_times(F.col("plan"))).alias("index", "t"))
    ms = F.floor(F.col("t") * 1000 + 0.5).cast("long")
    return rows.select("source_id", "index", ms.alias("time_ms"), F.col("t").alias("time_sec"))


def estimate(strategy: str, duration: Column, fps: Column, every: float | None = None, count: int | None = None, at: list[float] | None = None, start: float = 0.0, end: Column | None = None) -> Column:
    """Rows to expect before anything is decoded."""
    span = F.greatest(F.lit(0.0), (duration if end is None else end) - start)
    if strategy == "count":
        return F.lit(max(1, count or 1))
    if strategy == "at":
        return F.lit(len(at or []))
    n = span * fps if strategy == "all" else span * (1 / every if every else 1) if strategy == "fps" else span / (every or 1)
    return F.when(span <= 0, 0).otherwise(_rows(n))


def downsampled(times: Column, budget: int) -> Column:
    """`budget` of the times, evenly spread over their positions."""
    n = F.size(times)
    if budget == 1:
        return F.slice(times, 1, 1)
    pick = F.transform(F.sequence(F.lit(0), F.lit(budget - 1)), lambda i: F.get(times, F.floor(i * (n - 1) / F.lit(float(budget - 1)) + 0.5).cast("int")))
    return F.when(n <= budget, times).otherwise(pick)


def guard_rows(rows: int, most: int | None = None, force: bool = False, confirm: Callable[[int], bool] | None = None) -> None:
    """Refuse large outputs that aren't wanted explicitly; confirm is asked about them, where it is given."""
    if most is not None and rows > most:
        raise FrameError("GUARD", f"{rows} frames exceed the limit of {most}")
    if not force and (rows > WARN_FRAMES or rows * FRAME_BYTES > WARN_BYTES) and not (confirm and confirm(rows)):
        raise FrameError("GUARD", f"about {rows} frames would be written", "confirm, or choose a smaller range")
