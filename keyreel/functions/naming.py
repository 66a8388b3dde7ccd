"""File names of frames and folders of sources, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_TEMPLATE = "{source}_frame_{index}"


def frame_id(index: Column) -> Column:
    return F.format_string("frame-%06d", index)


def time_token(time_ms: Column) -> Column:
    """`MMmSSsCC`, from whole milliseconds; halves of a hundredth round up, and 59.995 s gives 60s00."""
    ms = F.greatest(time_ms, F.lit(0)).cast("long")
    minutes = F.floor(ms / 60000).cast("long")
    cents = F.floor((ms - minutes * 60000 + 5) / 10).cast("long")
    return F.format_string("%02dm%02ds%02d", minutes, F.floor(cents / 100).cast("long"), cents % 100)


def sanitized(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(name, r'[\\/:*?"<>|]', "-"), r"\s+", " "))


def render(template: str | None, source: Column, index: Column, time_ms: Column, scene: Column | None = None, date: Column | None = None) -> Column:
    """A file name without extension. Unknown tokens stay; a blank template is the default one."""
    template = (template or "").strip() or DEFAULT_TEMPLATE
    scene = F.lit(0) if scene is None else scene
    values = {
        "{source}": source,
        "{index}": F.format_string("%04d", index),
        "{time}": time_token(time_ms),
        "{ms}": F.floor(time_ms + F.lit(0.5)).cast("long").cast("string"),
        "{scene}": F.format_string("%02d", F.coalesce(scene, F.lit(0)) + 1),
        "{date}": F.date_format(F.current_date() if date is None else date, "yyyy-MM-dd"),
    }
    out = F.lit(template)
    for token, value in values.items():
        out = F.replace(out, F.lit(token), value)
    out = sanitized(out)
    fallback = sanitized(F.concat(source, F.lit("_frame_"), F.format_string("%04d", index)))
    return F.when(out == "", fallback).otherwise(out)


def with_unique(df: DataFrame, name: str, order: list[str], mark: str = "_", within: tuple[str, ...] = ()) -> DataFrame:
    """df with the n-th of equal names (letter case aside) ending in mark and n."""
    n = F.row_number().over(Window.partitionBy(*within, F.lower(name)).orderBy(*order))
    return df.withColumn(name, F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(mark), n.cast("string"))))


def slug(path: Column) -> Column:
    """The folder name of a source: its file name without extension, odd characters as dashes."""
    base = F.element_at(F.split(path, r"[\\/]"), -1)
    stem = F.regexp_replace(F.regexp_replace(base, r"\.[^.]+$", ""), r"[^a-zA-Z0-9._-]+", "-")
    stem = F.regexp_replace(stem, r"^-+|-+$", "")
    return F.when(stem == "", "video").otherwise(stem)


def artifact_path(path: Column, root: Column) -> Column:
    """Relative to root where inside it, else as it is."""
    inside = F.startswith(path, F.concat(root, F.lit("/")))
    return F.when(inside, F.substring(path, F.length(root) + 2, F.length(path))).otherwise(path)


def absolute_path(path: Column, root: Column) -> Column:
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(root, F.lit("/"), path))
