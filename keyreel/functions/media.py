"""Expressions over probe facts, and the command lines of the external decoder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Image formats by their file endings.
EXTENSIONS = {"image/jpeg": "jpg", "image/png": "png", "image/webp": "webp"}
LEAST_INTERVAL = 0.05


def _number(x: float) -> str:
    """Without an exponent at usual sizes; six digits would be too few for times of long videos."""
    return format(x, ".15g")


def parse_fps(rate: Column) -> Column:
    """`n/d` or `n` as a number; 0 where missing, malformed or divided by 0."""
    parts = F.split(F.coalesce(rate, F.lit("")), "/")
    n = F.get(parts, F.lit(0)).try_cast("double")
    d = F.coalesce(F.get(parts, F.lit(1)), F.lit("1")).try_cast("double")
    return F.coalesce(F.try_divide(n, d), F.lit(0.0))


def rotation(side_data: Column, tag: Column) -> Column:
    """The first finite rotation of the side data (array of double), else the tag, else 0."""
    finite = F.filter(side_data, lambda r: r.isNotNull() & ~F.isnan(r) & (F.abs(r) < float("inf")))
    return F.coalesce(F.get(finite, F.lit(0)), tag.try_cast("double"), F.lit(0.0))


def display_size(width: Column, height: Column, rotation: Column) -> Column:
    """struct(width, height) as shown: sides change places at 90 and 270 degrees."""
    turned = F.pmod(F.floor(rotation + 0.5).cast("long"), F.lit(360)).isin(90, 270)
    return F.struct(F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height"))


def parse_timestamps(json: Column) -> Column:
    """Finite times >= 0 of a frame listing, in order."""
    frames = F.from_json(json, "frames array<struct<best_effort_timestamp_time:string>>")["frames"]
    times = F.transform(F.coalesce(frames, F.expr("cast(array() as array<struct<best_effort_timestamp_time:string>>)")), lambda f: f["best_effort_timestamp_time"].try_cast("double"))
    return F.filter(times, lambda t: t.isNotNull() & ~F.isnan(t) & (t >= 0) & (t < float("inf")))


def probe_facts(json: Column) -> Column:
    """struct of the facts of the first video stream of a probe document; null without one."""
    doc = F.from_json(json, (
        "streams array<struct<codec_type:string,codec_name:string,width:int,height:int,avg_frame_rate:string,r_frame_rate:string,"
        "tags:struct<rotate:string>,side_data_list:array<struct<rotation:double>>>>, format struct<duration:string,format_name:string,size:string>"
    ))
    v = F.get(F.filter(doc["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    avg, base = parse_fps(v["avg_frame_rate"]), parse_fps(v["r_frame_rate"])
    turn = rotation(F.transform(v["side_data_list"], lambda s: s["rotation"]), v["tags"]["rotate"])
    size = display_size(v["width"], v["height"], turn)
    seconds = doc["format"]["duration"].try_cast("double")
    facts = F.struct(
        F.when(seconds.isNull() | F.isnan(seconds) | (F.abs(seconds) == float("inf")), 0.0).otherwise(seconds).alias("duration_sec"),
        size["width"].alias("width"), size["height"].alias("height"), v["width"].alias("coded_width"), v["height"].alias("coded_height"), turn.alias("rotation"),
        F.when(avg > 0, avg).otherwise(base).alias("fps"), v["codec_name"].alias("codec"), doc["format"]["format_name"].alias("container"),
        F.exists(doc["streams"], lambda s: s["codec_type"] == "audio").alias("has_audio"), doc["format"]["size"].try_cast("bigint").alias("size_bytes"),
    )
    return F.when(v.isNotNull(), facts)


def probe_command(path: str) -> list[str]:
    return ["-v", "quiet", "-print_format", "json", "-show_format", "-show_streams", path]


def timestamp_command(path: str, start: float | None = None, end: float | None = None) -> list[str]:
    out = ["-v", "error", "-select_streams", "v:0", "-show_entries", "frame=best_effort_timestamp_time", "-print_format", "json"]
    if start is not None or end is not None:
        out += ["-read_intervals", f"{'' if start is None else _number(start)}%{'' if end is None else _number(end)}"]
    return [*out, path]


def select_times_filter(times: list[float]) -> str:
    """A filter that passes the frames at these times, in thousandths of a second."""
    return "select='" + "+".join(f"eq(t\\,{t:.3f})" for t in times) + "'"


def _quality(fmt: str, quality: float) -> list[str]:
    q = min(1.0, max(0.0, quality))
    if fmt == "image/jpeg":
        return ["-q:v", str(min(31, max(2, int((1 - q) * 31 + 0.5))))]
    return ["-quality", str(int(q * 100 + 0.5))] if fmt == "image/webp" else []


def _scale(width: int | None) -> str | None:
    return f"scale='min({width},iw)':-2" if width else None


def interval_command(path: str, pattern: str, interval: float, fmt: str = "image/jpeg", quality: float = 0.85, max_width: int | None = None, start: float = 0.0, end: float | None = None) -> list[str]:
    """One pass that writes a frame each `interval` seconds, 0.05 at least."""
    out = ["-hide_banner", "-y", *(["-ss", _number(start)] if start > 0 else []), "-i", path]
    if end is not None and end > start:
        out += ["-t", _number(end - start)]
    filters = [f"fps=1/{_number(max(LEAST_INTERVAL, interval))}", *filter(None, [_scale(max_width)])]
    return [*out, "-vf", ",".join(filters), *_quality(fmt, quality), pattern]


def all_frames_command(path: str, pattern: str, fmt: str = "image/jpeg", quality: float = 0.85, max_width: int | None = None, start: float = 0.0, end: float | None = None, most: int | None = None) -> list[str]:
    out = ["-hide_banner", "-y", *(["-ss", _number(start)] if start > 0 else []), "-i", path]
    if end is not None:
        out += ["-t", _number(end - start)]
    out += ["-vf", _scale(max_width)] if max_width else []
    out += ["-fps_mode", "passthrough", *(["-frames:v", str(most)] if most is not None else [])]
    return [*out, *_quality(fmt, quality), pattern]


def single_frame_command(path: str, out_path: str, at: float, fmt: str = "image/jpeg", quality: float = 0.92, max_width: int | None = None) -> list[str]:
    out = ["-hide_banner", "-y", "-ss", _number(max(0.0, at)), "-i", path, "-frames:v", "1"]
    return [*out, *(["-vf", _scale(max_width)] if max_width else []), *_quality(fmt, quality), out_path]


def raw_rgb_command(pattern: str, width: int, height: int, letterbox: bool = False, pad: str = "0x727272") -> list[str]:
    """Frames as raw rgb24 on standard output, one of a path without a number pattern; with letterbox, shrunk to fit and padded at the right and below."""
    if letterbox:
        vf = f"scale={width}:{height}:force_original_aspect_ratio=decrease,pad={width}:{height}:0:0:color={pad}"
        return ["-v", "error", "-i", pattern, "-vf", vf, "-frames:v", "1", "-f", "rawvideo", "-pix_fmt", "rgb24", "pipe:1"]
    one = ["-frames:v", "1"] if "%" not in pattern else []
    return ["-v", "error", *(["-framerate", "1"] if not one else []), "-i", pattern, "-vf", f"scale={width}:{height}", *one, "-f", "rawvideo", "-pix_fmt", "rgb24", "pipe:1"]
