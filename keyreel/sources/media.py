"""Videos and images as tables: probing, frame times, decoded frames."""

from __future__ import annotations

import json
import os
import shutil
import subprocess
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from keyreel.errors import FrameError
from keyreel.functions import media
from keyreel.schemas import PIXELS

PTS_BYTES, PTS_LEAST, PTS_MOST = 128, 1 << 20, 256 << 20


def tool_places(name: str, explicit: str | None = None) -> list[tuple[str, str | None]]:
    """(kind, path) of the places where a tool is looked for, in order; the first that has a path counts."""
    folder = os.environ.get("KEYREEL_TOOLS_DIR", "").strip() or os.path.expanduser("~/.keyreel/tools")
    managed = os.path.join(folder, name)
    return [
        ("explicit", (explicit or "").strip() or None),
        ("environment", os.environ.get(f"KEYREEL_{name.upper()}_PATH", "").strip() or None),
        ("path", shutil.which(name)),
        ("managed", managed if os.path.isfile(managed) else None),
    ]


def find_tool(name: str, explicit: str | None = None) -> str:
    """An explicit path, else KEYREEL_<NAME>_PATH, else the one on PATH, else the one in KEYREEL_TOOLS_DIR.

    Executors look with their own environment."""
    found = next((p for _, p in tool_places(name, explicit) if p), None)
    if not found:
        raise FrameError("FFMPEG_NOT_FOUND", f"{name} was not found")
    if not (os.path.isfile(found) and os.access(found, os.X_OK)):
        raise FrameError("FFMPEG_NOT_FOUND", f"{found} cannot be run")
    return found


def run_tool(argv: list[str], most: int = 16 << 20, code: str = "EXTRACT_FAILED") -> bytes:
    """Standard output of a command without a shell. One that writes more than `most` bytes is ended, and so
    is one whose task ends before it."""
    with tempfile.TemporaryFile() as said:
        p = subprocess.Popen(argv, stdout=subprocess.PIPE, stderr=said)
        try:
            out = p.stdout.read(most + 1)
            if len(out) > most:
                raise FrameError(code, f"{argv[0]} wrote more than {most} bytes")
            p.wait()
        finally:
            p.stdout.close()
            if p.poll() is None:
                p.terminate()
                p.wait()
        if p.returncode:
            said.seek(0)
            raise FrameError(code, f"{argv[0]} failed: {said.read()[-500:].decode(errors='replace')}")
    return out


def pts_buffer(frames: int) -> int:
    return min(PTS_MOST, max(PTS_LEAST, PTS_BYTES * frames))


def probe_documents(paths: DataFrame, tool: str | None = None) -> DataFrame:
    """source_id, path, json: the probe's answer for each path, asked on the executors."""

    def run(batches):
        exe = find_tool("ffprobe", tool)
        for b in batches:
            docs = [run_tool([exe, *media.probe_command(p)], code="PROBE_FAILED").decode() for p in b.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("source_id"), b.column("path"), pa.array(docs)], ["source_id", "path", "json"])

    return paths.select("source_id", "path").mapInArrow(run, "source_id string, path string, json string")


def probes(documents: DataFrame) -> DataFrame:
    """The probes table from source_id, path, json; a document without a video fails."""
    d = documents.withColumn("p", media.probe_facts(F.col("json")))
    d = d.withColumn("p", F.when(F.col("p").isNull(), F.raise_error(F.concat(F.lit("PROBE_FAILED: no video in "), F.col("path")))).otherwise(F.col("p")))
    return d.select("source_id", "path", "p.*")


class FrameTimes(DataSource):
    """Frame times (pts double) of JSON listings: option path, and from / to (half open) in seconds.

    Without a file ending in .json, the path is a video and ffprobe lists it, only within from and to."""

    @classmethod
    def name(cls) -> str:
        return "frametimes"

    def schema(self) -> str:
        return "path string, pts double"

    def reader(self, schema) -> "FrameTimesReader":
        return FrameTimesReader(dict(self.options))


class FrameTimesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["path"].split(",")
        self.start, self.end = float(options.get("from", 0)), float(options.get("to", "inf"))

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        path = partition.value
        if path.endswith(".json"):
            with open(path) as f:
                doc = json.load(f)
        else:
            end = None if self.end == float("inf") else self.end
            doc = json.loads(run_tool([find_tool("ffprobe"), *media.timestamp_command(path, self.start, end)], PTS_MOST))
        for frame in doc.get("frames", []):
            try:
                t = float(frame.get("best_effort_timestamp_time"))
            except (TypeError, ValueError):
                continue
            if t >= 0 and t != float("inf") and self.start <= t < self.end:
                yield (path, t)


def read_images(spark: SparkSession, pattern: str, interval_sec: float | None = None, start: float = 0.0) -> DataFrame:
    """Image files as pixels rows, RGB, in name order; source_id is the folder."""
    img = spark.read.format("image").load(pattern).select("image.*")
    img = img.withColumn("source_id", F.regexp_extract("origin", r"([^/]+)/[^/]+$", 1))
    index = (F.row_number().over(Window.partitionBy("source_id").orderBy("origin")) - 1).cast("int")
    ms = F.floor(F.lit(start * 1000) + index * (interval_sec or 0.0) * 1000 + 0.5).cast("long")

    def run(batches):
        for b in batches:
            out = []
            for data, h, w, c in zip(*(b.column(n).to_pylist() for n in ("data", "height", "width", "channels"))):
                px = np.frombuffer(data, np.uint8).reshape(h, w, c)
                px = np.repeat(px, 3, axis=2) if c == 1 else px[..., 2::-1]
                out.append(np.ascontiguousarray(px).tobytes())
            keep = [b.column(n) for n in ("source_id", "id", "index", "time_ms", "width", "height")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array([3] * len(b), pa.int32()), pa.array(out, pa.binary())], ["source_id", "id", "index", "time_ms", "width", "height", "channels", "data"])

    rows = img.withColumn("index", index).withColumn("time_ms", ms).withColumn("id", F.format_string("frame-%06d", "index"))
    return rows.select("source_id", "id", "index", "time_ms", "width", "height", "nChannels", "data").withColumnRenamed("nChannels", "channels").mapInArrow(run, PIXELS)


def with_source_times(files: DataFrame, times: DataFrame) -> DataFrame:
    """Frame files (source_id, path) with the source's times (source_id, pts), by position; a
    source whose counts differ fails."""
    n = lambda by: F.row_number().over(Window.partitionBy("source_id").orderBy(by)) - 1
    f = files.withColumn("index", n("path")).withColumn("__n", F.count("*").over(Window.partitionBy("source_id")))
    t = times.withColumn("index", n("pts")).withColumn("__m", F.count("*").over(Window.partitionBy("source_id")))
    out = f.join(t, ["source_id", "index"], "left")
    sec = F.when(F.coalesce(F.col("__m") != F.col("__n"), F.lit(True)), F.raise_error(F.lit("EXTRACT_FAILED: frame files and times differ"))).otherwise(F.col("pts"))
    return out.withColumn("time_sec", sec.cast("double")).withColumn("time_ms", F.floor(F.col("time_sec") * 1000 + 0.5).cast("long")).drop("__n", "__m", "pts")
