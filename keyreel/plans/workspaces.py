"""The steps over a workspace of many sources: extract, analyze, detect, select, export, run.

A workspace is a folder that driver and executors share. Every step is one plan over all its
sources: the decoder runs on the executors, a row for each piece of work, and writes files whose
names follow from the row alone, so a lost task is simply run again. Tables get a new
name each time and manifest.json, moved into place, says which ones count; a step that fails
leaves the former state. Driver memory holds that one small document only.

No sources: empty tables; export refuses an empty selection. A failing decoder ends the step.
"""

from __future__ import annotations

import os
import subprocess
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyreel import schemas
from keyreel.errors import FrameError
from keyreel.functions import media, naming
from keyreel.operators import scoring, vision
from keyreel.operators import select as S
from keyreel.plans import pipeline, sampling
from keyreel.sources import media as M
from keyreel.sources import workspace as W

# What candidates are made with, and the size that analysis reads.
CANDIDATE_WIDTH, CANDIDATE_QUALITY, EXPORT_QUALITY = 640, 0.85, 0.92
ANALYSIS_SIZE = (64, 36)
TIMING = "source_id STRING, count BIGINT, timestamp_basis STRING"
#: Frames that one task seeks before the next may take over.
SEEKS = 32

Progress = Callable[[dict], None]


@dataclass(frozen=True)
class Tools:
    """Paths of the decoder and the probe; None: on PATH."""

    ffmpeg: str | None = None
    ffprobe: str | None = None


@dataclass(frozen=True)
class Sampling:
    every: float | None = None
    fps: float | None = None
    count: int | None = None
    at: list[float] | None = None
    all_: bool = False
    start: float = 0.0
    end: float | None = None
    budget: int | None = sampling.BUDGET


@dataclass(frozen=True)
class Images:
    """How frames are written."""

    fmt: str = "image/jpeg"
    quality: float = CANDIDATE_QUALITY
    max_width: int | None = None
    template: str | None = None
    tools: Tools = field(default_factory=Tools)

    def __post_init__(self):
        if self.fmt not in media.EXTENSIONS:
            raise FrameError("USAGE", f"format must be one of {', '.join(media.EXTENSIONS)}")
        if not 0 <= self.quality <= 1:
            raise FrameError("USAGE", "quality must be within 0 and 1")
        if self.max_width is not None and self.max_width < 1:
            raise FrameError("USAGE", "max_width must be positive")

    @property
    def extension(self) -> str:
        return media.EXTENSIONS[self.fmt]


def progress_event(phase: str, done: int, total: int, message: str | None = None) -> dict:
    total = max(0, total)
    return {"phase": phase, "done": done, "total": total, "percent": min(100, int(done / total * 100 + 0.5)) if total else 0, "message": message}


def _silent(event: dict) -> None:
    pass


def _spread(df: DataFrame, *cols: str) -> DataFrame:
    """Few rows with much work each, over all tasks that the cluster runs at a time, and more."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *cols)


def _state(root: str) -> dict:
    return W.read_json(f"{root}/manifest.json")


def _update(root: str, **values: object) -> None:
    old = _state(root) if os.path.exists(f"{root}/manifest.json") else {"version": 1}
    W.write_json(f"{root}/manifest.json", {**old, **values})


def is_workspace(path: str) -> bool:
    return os.path.isfile(f"{path}/manifest.json")


def sources_of(spark: SparkSession, inputs: list[str]) -> DataFrame:
    """source_id, path of video files; equal names get a number."""
    rows = spark.createDataFrame([(i, W.canonical_path(p)) for i, p in enumerate(inputs)], "pos int, path string")
    return naming.with_unique(rows.withColumn("source_id", naming.slug(F.col("path"))), "source_id", ["pos"], "-").select("source_id", "path")


def probe(sources: DataFrame, tools: Tools = Tools()) -> DataFrame:
    return M.probes(M.probe_documents(_spread(sources, "source_id"), tools.ffprobe))


def read_frames(spark: SparkSession, root: str) -> DataFrame:
    return W.read_frames(spark, f"{root}/{_state(root)['frames']}", root)


def read_probes(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(schemas.PROBES).json(f"{root}/{_state(root)['probes']}")


def read_selections(spark: SparkSession, root: str) -> DataFrame:
    state = _state(root)
    if "selections" not in state:
        raise FrameError("NOT_FOUND", f"{root} has no selections")
    return W.read_selections(spark, f"{root}/{state['selections']}")


def read_timing(spark: SparkSession, root: str) -> DataFrame:
    """source_id, count, timestamp_basis of the extracted frames."""
    return spark.read.schema(TIMING).json(f"{root}/{_state(root)['timing']}")


def timestamp_basis(planned: DataFrame, frames: DataFrame, all_: bool) -> DataFrame:
    """source_id, count, timestamp_basis: where the times of a source's frames come from. All frames have the
    times that the probe lists, or where these are not as many, times by the rate of frames."""
    if all_:
        wanted = planned.groupBy("source_id").agg(F.bool_or(F.col("kind") == "all").alias("whole"), F.sum(F.size("times")).alias("n"))
        basis = F.when(F.col("whole") & (F.col("count") != F.col("n")), "estimated-fps").otherwise("source-pts")
    else:
        wanted, basis = planned.select("source_id").distinct(), F.lit("planned-interval")
    counts = frames.groupBy("source_id").agg(F.count("*").alias("count"))
    return wanted.join(counts, "source_id", "left").withColumn("count", F.coalesce("count", F.lit(0))).select("source_id", "count", basis.alias("timestamp_basis"))


def _store_frames(frames: DataFrame, root: str, **values: object) -> None:
    name = f"frames-{uuid.uuid4().hex}.jsonl"
    W.write_frames(frames, f"{root}/{name}", root)
    _update(root, frames=name, **values)


def _listing(sources: DataFrame, start: float, end: float | None, tools: Tools) -> DataFrame:
    """source_id, times: the times of all frames of each source within the range."""

    def run(batches):
        exe = M.find_tool("ffprobe", tools.ffprobe)
        for b in batches:
            out = [M.run_tool([exe, *media.timestamp_command(p, start, end)], M.PTS_MOST).decode() for p in b.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("source_id"), pa.array(out, pa.string())], ["source_id", "json"])

    listed = _spread(sources.select("source_id", "path"), "source_id").mapInArrow(run, "source_id string, json string")
    within = (lambda t: t >= start) if end is None else (lambda t: (t >= start) & (t < end))
    return listed.select("source_id", F.filter(media.parse_timestamps(F.col("json")), within).alias("times"))


def planned_work(probes: DataFrame, how: Sampling, tools: Tools = Tools()) -> DataFrame:
    """A row for each decoder run: source_id, path, kind, fps, first (index), times, interval, start, end.

    A steady plan within its budget is one pass over its source, and so are all frames; others are seeks, SEEKS at a time."""
    p = sampling.with_plan(probes, every=how.every, fps=how.fps, count=how.count, at=how.at, all_=how.all_, start=how.start, end=how.end, budget=how.budget)
    if how.all_:
        p = p.join(_listing(probes, how.start, how.end, tools), "source_id")
        few = F.lit(True) if how.budget is None else F.size("times") <= how.budget
        p = p.withColumn("kind", F.when(few, "all").otherwise("seek"))
        if how.budget is not None:
            p = p.withColumn("times", sampling.downsampled(F.col("times"), how.budget))
    else:
        steady = F.col("plan.strategy").isin("every", "fps") & ~F.col("plan.capped") & (F.col("plan.interval_sec") >= media.LEAST_INTERVAL)
        p = p.withColumn("times", sampling.plan_times(F.col("plan"))).withColumn("kind", F.when(steady, "interval").otherwise("seek"))
    p = p.select("source_id", "path", "kind", "times", "fps", F.col("plan.interval_sec").alias("interval"), F.col("plan.from_sec").alias("start"), F.col("plan.to_sec").alias("end"))
    chunks = F.expr(f"transform(sequence(0, cast((size(times) - 1) / {SEEKS} as int)), i -> struct(i * {SEEKS} as first, slice(times, i * {SEEKS} + 1, {SEEKS}) as times))")
    whole = F.array(F.struct(F.lit(0).alias("first"), F.col("times").alias("times")))
    return p.where(F.size("times") > 0).select("source_id", "path", "kind", "fps", "interval", "start", "end", F.explode(F.when(F.col("kind") == "seek", chunks).otherwise(whole)).alias("piece")).select(
        "source_id", "path", "kind", "fps", "interval", "start", "end", "piece.first", "piece.times"
    )


def _decode(work: DataFrame, folder: str, images: Images, exact: bool = True) -> DataFrame:
    """source_id, index, time_sec, path of the frames that the decoder writes for the rows of work.

    Where all frames are wanted and their number is not that of the times, exact fails; otherwise
    their times follow from the rate of frames."""
    ext = images.extension
    like = {"fmt": images.fmt, "quality": images.quality, "max_width": images.max_width}

    def written(exe: str, row: dict) -> Iterator[tuple[int, float, str]]:
        into, times = f"{folder}/{row['source_id']}", row["times"]
        os.makedirs(into, exist_ok=True)
        name = lambda i: f"{into}/frame_{i + 1:06d}.{ext}"
        if row["kind"] == "seek":
            for i, t in enumerate(times, row["first"]):
                M.run_tool([exe, *media.single_frame_command(row["path"], name(i), t, **like)])
                yield i, t, name(i)
            return
        pattern = f"{into}/frame_%06d.{ext}"
        if row["kind"] == "all":
            argv = media.all_frames_command(row["path"], pattern, start=row["start"], end=row["end"], most=len(times) if exact else None, **like)
        else:
            argv = media.interval_command(row["path"], pattern, row["interval"], start=row["start"], end=row["end"], **like)
        M.run_tool([exe, *argv])
        if row["kind"] == "all" and not exact:
            n = 0
            while os.path.exists(name(n)):
                n += 1
            if n != len(times):
                step = 1 / row["fps"] if row["fps"] and row["fps"] > 0 else 0.0
                times = [(row["start"] or 0.0) + k * step for k in range(n)]
        i = 0
        while os.path.exists(name(i)):
            if i < len(times):
                yield i, times[i], name(i)
            else:
                os.unlink(name(i))  # the decoder rounds the number of steps up
            i += 1
        if row["kind"] == "all" and i != len(times):
            raise FrameError("EXTRACT_FAILED", f"{row['path']} gave {i} frames for {len(times)} times")

    def run(batches):
        exe = M.find_tool("ffmpeg", images.tools.ffmpeg)
        for b in batches:
            for row in b.to_pylist():
                out = list(written(exe, row))
                cols = list(zip(*out)) or [(), (), ()]
                kinds = (pa.int32(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([row["source_id"]] * len(out), pa.string()), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["source_id", "index", "time_sec", "path"])

    return _spread(work, "source_id", "first").mapInArrow(run, "source_id string, index int, time_sec double, path string")


def _prepared(sources: DataFrame, folder: str, overwrite: bool, clear: bool = True) -> None:
    """An output folder for each source; see prepare_output(). Without clear nothing is deleted."""

    def run(batches):
        for b in batches:
            for s in b.column("source_id").to_pylist():
                into = f"{folder}/{s}"
                if clear or not overwrite:
                    W.prepare_output(into, overwrite)
            yield b

    sources.select("source_id").mapInArrow(run, "source_id string").write.format("noop").mode("overwrite").save()


def _moved(rows: DataFrame, name: Column | str) -> DataFrame:
    """rows with their files moved to the path in column `name`; done already where a task ran before."""

    def run(batches):
        for b in batches:
            for old, new in zip(b.column("path").to_pylist(), b.column("__to").to_pylist()):
                if os.path.exists(old):
                    os.replace(old, new)
                elif not os.path.exists(new):
                    raise FrameError("IO", f"{old} is gone")
            yield b.drop_columns(["path"]).rename_columns([*[n for n in b.schema.names if n not in ("path", "__to")], "path"])

    kept = [c for c in rows.columns if c != "path"]
    rows = rows.select("path", *kept, (F.col(name) if isinstance(name, str) else name).alias("__to"))
    kinds = dict((f.name, f.dataType.simpleString()) for f in rows.schema)
    return rows.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in kept], "path string"]))


def extract(spark: SparkSession, inputs: list[str] | DataFrame, root: str, how: Sampling = Sampling(), images: Images | None = None, output: str | None = None,
            overwrite: bool = False, force: bool = False, most: int | None = None, progress: Progress = _silent, confirm: Callable[[int], bool] | None = None) -> DataFrame:
    """The frames of videos, as a workspace in root: candidates in root/frames, or with output frames
    of full width in output, named by the template. inputs: paths, or a table of source_id, path."""
    root = W.canonical_path(root)
    if images is None:
        images = Images(max_width=None if output else CANDIDATE_WIDTH)
    sources = sources_of(spark, inputs) if isinstance(inputs, list) else inputs
    if is_workspace(root) and not overwrite:
        raise FrameError("GUARD", f"{root} is a workspace already", "choose another folder or allow overwriting")
    progress(progress_event("extract", 0, 1))
    os.makedirs(root, exist_ok=True)
    if overwrite:
        W.prepare_output(root, True)
    name = f"probes-{uuid.uuid4().hex}.json"
    probe(sources, images.tools).write.json(f"{root}/{name}")
    probes = spark.read.schema(schemas.PROBES).json(f"{root}/{name}")
    if how.all_:
        end = F.col("duration_sec") if how.end is None else F.least(F.lit(float(how.end)), F.col("duration_sec"))
        fps = F.when(F.coalesce("fps", F.lit(0.0)) > 0, F.col("fps")).otherwise(30.0)
        expected = probes.agg(F.sum(sampling.estimate("all", F.col("duration_sec"), fps, start=how.start, end=end))).first()[0] or 0
        sampling.guard_rows(expected, most, force, confirm)
    folder = W.canonical_path(output) if output else f"{root}/frames"
    raw = f"{folder}/.unnamed-{uuid.uuid4().hex}" if output and images.template else folder
    plan = f"{root}/work-{uuid.uuid4().hex}.parquet"
    planned = planned_work(probes, how, images.tools)
    planned.write.parquet(plan)
    planned = spark.read.schema(planned.schema).parquet(plan)
    if most is not None and (n := planned.agg(F.sum(F.size("times"))).first()[0] or 0) > most:
        raise FrameError("GUARD", f"the plan has {n} frames, which exceed the limit of {most}")
    _prepared(probes, folder, overwrite)
    rows = _decode(planned, raw, images, exact=output is None)
    shown = probes.select("source_id", F.col("path").alias("video"), F.col("width").alias("w"), F.col("height").alias("h"))
    rows = rows.join(shown, "source_id").withColumn("time_ms", F.floor(F.col("time_sec") * 1000 + 0.5).cast("long"))
    if raw != folder:
        stem = F.regexp_replace(F.element_at(F.split("video", "/"), -1), r"\.[^.]+$", "")
        rows = rows.withColumn("name", naming.render(images.template, stem, F.col("index") + 1, F.col("time_ms")))
        rows = naming.with_unique(rows, "name", ["index"], within=("source_id",))
        rows = _moved(rows, F.concat(F.lit(f"{folder}/"), F.col("source_id"), F.lit("/"), F.col("name"), F.lit(f".{images.extension}"))).drop("name")
    width = F.col("w") if images.max_width is None else F.least(F.col("w"), F.lit(images.max_width))
    height = F.when(width == F.col("w"), F.col("h")).otherwise((F.floor(F.col("h") * width / F.col("w") / 2 + 0.5) * 2).cast("int"))
    none = {n: F.lit(None).cast(k) for n, k in (("metrics", schemas.METRICS), ("detections", schemas.DETECTIONS), ("text", schemas.TEXT))}
    frames = rows.select(
        "source_id", naming.frame_id(F.col("index")).alias("id"), "index", "time_ms", "time_sec", "path", width.alias("width"), height.alias("height"),
        *[v.alias(n) for n, v in none.items()],
    )
    state = {"probes": name, "sampling": vars(how), "candidates": output is None, "format": images.fmt, "detection_min_confidence": None}
    _store_frames(frames, root, **state)
    out = read_frames(spark, root)
    timing = f"timing-{uuid.uuid4().hex}.json"
    timestamp_basis(planned, out, how.all_).write.json(f"{root}/{timing}")
    _update(root, timing=timing)
    if output:
        W.write_json(f"{folder}/manifest.json", {"version": 1, "workspace": root, "frames": _state(root)["frames"], "timing": timing, "probes": name, "sampling": vars(how), "format": images.fmt,
                                                 "quality": images.quality, "max_width": images.max_width, "count": out.count()})
    if most is not None and (n := out.count()) > most:
        raise FrameError("GUARD", f"{n} frames exceed the limit of {most}")
    progress(progress_event("extract", 1, 1, "done"))
    return out


def _streamed(argv: list[str], size: int) -> Iterator[bytes]:
    """Standard output of a command in blocks of `size` bytes; the last one may be short."""
    with subprocess.Popen(argv, stdout=subprocess.PIPE, stderr=subprocess.PIPE) as p:
        while block := p.stdout.read(size):
            yield block
        error = p.stderr.read()
    if p.returncode:
        raise FrameError("ANALYZE_FAILED", f"{argv[0]} failed: {error[-500:].decode(errors='replace')}")


def decoded(frames: DataFrame, tools: Tools = Tools(), size: tuple[int, int] = ANALYSIS_SIZE) -> DataFrame:
    """The pixels table of candidate frames, read as they come: one decoder run for a source, or for each
    file where the names are not numbered."""
    w, h = size

    def run(batches):
        exe = M.find_tool("ffmpeg", tools.ffmpeg)
        for b in batches:
            for row in b.to_pylist():
                k = 0
                for block in _streamed([exe, *media.raw_rgb_command(row["pattern"], w, h)], w * h * 3):
                    if len(block) == w * h * 3:
                        yield pa.RecordBatch.from_pydict({"source_id": [row["source_id"]], "index": pa.array([row["first"] + k], pa.int32()), "data": pa.array([block], pa.binary())})
                        k += 1
                if k != row["n"]:
                    raise FrameError("ANALYZE_FAILED", f"{row['pattern']} gave {k} of {row['n']} frames")

    numbered = F.regexp_replace("path", r"frame_\d{6}(\.[^./]+)$", "frame_%06d$1")
    alone = numbered == F.col("path")
    work = frames.groupBy("source_id", numbered.alias("pattern"), F.when(alone, F.col("index")).alias("__one")).agg(F.count("*").alias("n"), F.min("index").alias("first")).drop("__one")
    px = _spread(work, "source_id", "pattern").mapInArrow(run, "source_id string, index int, data binary")
    px = px.join(frames.select("source_id", "id", "index", "time_ms"), ["source_id", "index"])
    return px.select("source_id", "id", "index", "time_ms", F.lit(w).alias("width"), F.lit(h).alias("height"), F.lit(3).alias("channels"), "data")


def analyze(spark: SparkSession, root: str, tools: Tools = Tools(), progress: Progress = _silent) -> DataFrame:
    """The workspace's frames, with metrics; returns the scan with its recommendations."""
    if not _state(root)["candidates"]:
        raise FrameError("USAGE", "analysis needs candidates, not frames of a chosen output")
    progress(progress_event("analyze", 0, 1))
    frames = read_frames(spark, root)
    name = f"scan-{uuid.uuid4().hex}.parquet"
    pipeline.analyze(decoded(frames, tools)).write.parquet(f"{root}/{name}")
    scan = spark.read.parquet(f"{root}/{name}")
    _store_frames(pipeline.with_metrics(frames, scan).select(*frames.columns), root, scan=name, recommendations=scoring.recommendation_bounds())
    progress(progress_event("analyze", 1, 1, "done"))
    return scan


class OnnxProvider:
    """A detector model in a file that the executors can read."""

    def __init__(self, path: str):
        self.id, self.path, self.session = "onnx", path, None

    def is_ready(self) -> bool:
        return os.path.isfile(self.path)

    def detect_objects(self, rgb: np.ndarray) -> np.ndarray:
        if self.session is None:
            import onnxruntime

            self.session = onnxruntime.InferenceSession(self.path, providers=["CPUExecutionProvider"])
        return self.session.run(None, {self.session.get_inputs()[0].name: vision.network_input(rgb)})[0][0]


def detect(spark: SparkSession, root: str, provider: Callable[[], vision.VisionProvider] | None, confidence: float = vision.CONFIDENCE, tools: Tools = Tools(), progress: Progress = _silent) -> DataFrame:
    """The workspace's frames, with detections of the confidence or more. provider makes a provider once in each task."""
    if provider is None or not provider().is_ready():
        raise FrameError("VISION_NOT_READY", "no detector model is set up", "name a provider or a model file")
    size = vision.INPUT_SIZE

    def run(batches):
        exe, p = M.find_tool("ffmpeg", tools.ffmpeg), provider()
        for b in batches:
            out = []
            for path, w, h in zip(*(b.column(n).to_pylist() for n in ("path", "width", "height"))):
                block = next(_streamed([exe, *media.raw_rgb_command(path, size, size, letterbox=True)], size * size * 3), b"")
                if len(block) != size * size * 3:
                    raise FrameError("DETECT_FAILED", f"{path} gave {len(block)} bytes")
                out.append(vision.decode(p.detect_objects(np.frombuffer(block, np.uint8).reshape(size, size, 3)), w, h, confidence))
            yield pa.RecordBatch.from_arrays([b.column("source_id"), b.column("id"), pa.array(out, vision._DETECTIONS)], ["source_id", "id", "detections"])

    progress(progress_event("detect", 0, 1))
    frames = read_frames(spark, root)
    work = _spread(frames.select("source_id", "id", "path", "width", "height"), "source_id", "id")
    found = work.mapInArrow(run, f"source_id string, id string, detections {schemas.DETECTIONS}")
    _store_frames(frames.drop("detections").join(found, ["source_id", "id"], "left").select(*frames.columns), root, detection_min_confidence=confidence)
    progress(progress_event("detect", 1, 1, "done"))
    return read_frames(spark, root)


def _complete(frames: DataFrame, options: S.SelectOptions) -> bool:
    return not S.complete_for(frames, options).where(~F.col("complete")).head(1)


def select(spark: SparkSession, root: str, preset: str | None = None, options: S.SelectOptions = S.SelectOptions(), provider: Callable[[], vision.VisionProvider] | None = None,
           tools: Tools = Tools(), progress: Progress = _silent) -> DataFrame:
    """The selections of a workspace; metrics and detections that it lacks are made first."""
    options = S.apply_preset(preset, options) if preset else options
    S.validate(options)
    frames = read_frames(spark, root)
    if S.needs_text(options) and frames.where("text is null").head(1):
        vision.detect_text()
    if not _complete(frames, S.SelectOptions()):
        analyze(spark, root, tools, progress)
    if S.needs_detections(options):
        known = _complete(read_frames(spark, root), options) and S.can_reuse(_state(root)["detection_min_confidence"], options.min_confidence)
        if not known:
            detect(spark, root, provider, S.MIN_CONFIDENCE if options.min_confidence is None else options.min_confidence, tools, progress)
    progress(progress_event("select", 0, 1))
    name = f"selections-{uuid.uuid4().hex}.json"
    W.write_selections(pipeline.run(read_frames(spark, root), None, options), f"{root}/{name}")
    _update(root, selections=name, selection=S.echoed(options), preset=preset)
    progress(progress_event("select", 1, 1, "done"))
    return read_selections(spark, root)


def export(spark: SparkSession, root: str, output: str, images: Images | None = None, overwrite: bool = False, manifest: bool = True, progress: Progress = _silent, inputs: list[str] | None = None) -> DataFrame:
    """The selected frames, read from their videos once more at full quality: source_id, pos, frame_id,
    time_sec, path. One source is written to output itself, several to a folder for each. With inputs,
    the videos of the selected frames must be among them."""
    images = Images(quality=EXPORT_QUALITY) if images is None else images
    output = W.canonical_path(output)
    chosen = read_selections(spark, root)
    ids = chosen.select("source_id").distinct()
    several = len(ids.limit(2).collect())
    if inputs is not None:
        named = spark.createDataFrame([(W.canonical_path(p),) for p in inputs], "path string")
        other = read_probes(spark, root).join(ids, "source_id").join(named, "path", "left_anti").select("path").first()
        if other:
            raise FrameError("EXPORT_FAILED", f"{other.path} is not one of the videos given", "export a workspace with the videos it was made from")
    if not several:
        raise FrameError("EXPORT_FAILED", "no frame is selected")
    if os.path.isdir(output) and os.listdir(output) and not overwrite:
        raise FrameError("GUARD", f"{output} is not empty", "choose another folder or allow overwriting; unrelated files are kept")
    progress(progress_event("export", 0, 1))
    folder = F.lit(output) if several == 1 else F.concat(F.lit(f"{output}/"), F.col("source_id"))
    rows = chosen.join(read_probes(spark, root).select("source_id", F.col("path").alias("video")), "source_id", "left")
    rows = rows.withColumn("video", F.when(F.col("video").isNull(), F.raise_error(F.concat(F.lit("EXPORT_FAILED: not a source of this workspace: "), F.col("source_id")))).otherwise(F.col("video")))
    stem = F.regexp_replace(F.element_at(F.split("video", "/"), -1), r"\.[^.]+$", "")
    rows = rows.withColumn("name", naming.render(images.template, stem, F.col("pos"), F.col("time_ms")))
    rows = naming.with_unique(rows, "name", ["pos"], within=("source_id",))
    rows = rows.withColumn("path", F.concat(folder, F.lit("/"), F.col("name"), F.lit(f".{images.extension}")))

    def run(batches):
        exe = M.find_tool("ffmpeg", images.tools.ffmpeg)
        for b in batches:
            for video, path, t in zip(*(b.column(n).to_pylist() for n in ("video", "path", "time_sec"))):
                os.makedirs(os.path.dirname(path), exist_ok=True)
                M.run_tool([exe, *media.single_frame_command(video, path, t, images.fmt, images.quality, images.max_width)], code="EXPORT_FAILED")
            yield b.drop_columns(["video"])

    done = _spread(rows.select("source_id", "pos", "frame_id", "time_sec", "path", "video"), "source_id", "pos")
    done = done.mapInArrow(run, "source_id string, pos int, frame_id string, time_sec double, path string")
    name = f"{W.canonical_path(root)}/exported-{uuid.uuid4().hex}.json"
    done.write.json(name)
    out = spark.read.schema(done.schema).json(name)
    if manifest:
        W.write_json(f"{output}/manifest.json", {"version": 1, "format": images.fmt, "quality": images.quality, "count": out.count(), "exported": name, "selection": _state(root)["selection"]})
    progress(progress_event("export", 1, 1, "done"))
    return out


def run(spark: SparkSession, inputs: list[str] | DataFrame, root: str, preset: str | None = None, options: S.SelectOptions = S.SelectOptions(), how: Sampling = Sampling(),
        output: str | None = None, images: Images | None = None, provider: Callable[[], vision.VisionProvider] | None = None, overwrite: bool = False,
        progress: Progress = _silent) -> tuple[DataFrame, DataFrame | None]:
    """Selections and, with output, the exported frames of all inputs; a workspace that exists is used again."""
    tools = images.tools if images else Tools()
    progress(progress_event("run", 0, 2, "select"))
    if not is_workspace(root):
        extract(spark, inputs, root, how, Images(max_width=CANDIDATE_WIDTH, tools=tools), progress=progress)
    chosen = select(spark, root, preset, options, provider, tools, progress)
    progress(progress_event("run", 1, 2, "export"))
    done = export(spark, root, output, images, overwrite, progress=progress) if output else None
    progress(progress_event("run", 2, 2, "done"))
    return chosen, done
