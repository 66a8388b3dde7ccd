"""Frame tables on disk: JSON lines for exchange, guarded outputs, and their readers."""

from __future__ import annotations

import json
import os
import re
import shutil
import tempfile

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyreel import schemas
from keyreel.errors import FrameError
from keyreel.functions.naming import absolute_path, artifact_path

# Files that an output folder may lose when it is overwritten.
FRAME_FILE = re.compile(r"^frame_\d{6}\.(jpg|jpeg|png|webp)$")
WORKSPACE_FILES = {"manifest.json", "frames.jsonl", "selections.json"}
#: Tables that the steps write under names of their own.
TABLES = re.compile(r"^(frames|probes|scan|selections|exported|work|timing)-[0-9a-f]{32}\.(jsonl|json|parquet)$")

# The text fields that an asset of each kind must have, and those it may have.
ASSETS = {
    "binaries": (("id", "platform", "arch", "filename", "sha256", "status"), ("sourceUrl", "license", "licenseUrl", "upstreamVersion", "approvedAt", "blockReason")),
    "models": (("id", "file", "sha256", "origin", "upstreamVersion", "license", "provenance", "status"), ("url", "releaseTag", "licenseUrl", "blockReason")),
}


def canonical_path(path: str) -> str:
    return os.path.realpath(os.path.abspath(path))


def read_frames(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """Frames of JSON lines; blank lines are skipped, paths are made absolute under root. No file, no frames."""
    try:
        out = spark.read.schema(schemas.FRAMES).option("mode", "FAILFAST").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        out = spark.createDataFrame([], schemas.FRAMES)
    return out.withColumn("path", absolute_path(F.col("path"), F.lit(root))) if root else out


def write_frames(frames: DataFrame, path: str, root: str | None = None, append: bool = False) -> None:
    """Validated frames as JSON lines, paths relative to root."""
    if root:
        frames = frames.withColumn("path", artifact_path(F.col("path"), F.lit(root)))
    schemas.validated(frames).write.mode("append" if append else "overwrite").json(path)


def read_selections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SELECTIONS).option("mode", "FAILFAST").json(path)


def write_selections(selections: DataFrame, path: str) -> None:
    selections.write.mode("overwrite").json(path)


def write_selection_documents(selections: DataFrame, folder: str, about: dict) -> DataFrame:
    """One JSON document a source, `<source_id>.json` with its selections in order and what is in about
    (filters, ranking), each written aside and moved into place. Returns source_id, path, count."""

    def run(batches):
        for b in batches:
            paths = []
            for source, rows in zip(b.column("source_id").to_pylist(), b.column("document").to_pylist()):
                paths.append(os.path.join(folder, f"{source}.json"))
                write_json(paths[-1], {"version": 1, "source_id": source, **about, "selections": json.loads(rows)})
            yield pa.RecordBatch.from_arrays([b.column("source_id"), pa.array(paths, pa.string()), b.column("count")], ["source_id", "path", "count"])

    one = F.struct("pos", "frame_id", "time_ms", "time_sec", "reasons")
    docs = selections.groupBy("source_id").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("document"), F.count("*").alias("count"))
    return docs.mapInArrow(run, "source_id string, path string, count bigint")


def read_assets(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The rows of a JSON catalogue of assets (kind: a name of ASSETS); an invalid catalogue fails."""
    if kind not in ASSETS:
        raise FrameError("USAGE", f"kind must be one of {', '.join(ASSETS)}")
    needed, optional = ASSETS[kind]
    row = ", ".join([*(f"{n}: string" for n in (*needed, *optional)), *(["sizeBytes: bigint"] if kind == "models" else [])])
    doc = spark.read.schema(f"schemaVersion INT, {kind} ARRAY<STRUCT<{row}>>").option("mode", "FAILFAST").option("multiLine", True).json(path)
    bad = F.coalesce(F.col("schemaVersion") != 1, F.lit(True)) | F.col(kind).isNull()
    rows = doc.withColumn(kind, F.when(bad, F.raise_error(F.lit("IO: no catalogue of version 1"))).otherwise(F.col(kind))).select(F.inline(kind))
    ok = F.col("sha256").rlike("^[a-fA-F0-9]{64}$") & F.col("status").isin("available", "blocked")
    for n in needed:
        ok = ok & F.col(n).isNotNull()
    if kind == "models":
        ok = ok & (F.col("sizeBytes").isNull() | (F.col("sizeBytes") > 0))
    wrong = F.raise_error(F.concat(F.lit("IO: invalid asset "), F.coalesce(F.col(needed[0]), F.lit("null"))))
    return rows.withColumn("sha256", F.when(F.coalesce(ok, F.lit(False)), F.col("sha256")).otherwise(wrong))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MANIFESTS).option("mode", "FAILFAST").option("multiLine", True).json(path)


def write_manifests(manifests: DataFrame, path: str) -> None:
    manifests.withColumn("updated_at", F.current_timestamp()).write.mode("overwrite").json(path)


def write_json(path: str, value: object) -> None:
    """A small document, written aside and moved into place."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(fd, "w") as f:
            json.dump(value, f, indent=2)
            f.write("\n")
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, path)
    except BaseException:
        os.unlink(tmp)
        raise


def read_json(path: str) -> object:
    try:
        with open(path) as f:
            return json.load(f)
    except (OSError, ValueError) as e:
        raise FrameError("IO", f"cannot read {path}: {e}") from e


def prepare_output(folder: str, overwrite: bool = False) -> None:
    """An output folder that is empty, or of which only known files go."""
    os.makedirs(folder, exist_ok=True)
    names = os.listdir(folder)
    if names and not overwrite:
        raise FrameError("GUARD", f"{folder} is not empty", "choose another folder or allow overwriting; unrelated files are kept")
    for n in names:
        where = os.path.join(folder, n)
        if TABLES.match(n) and os.path.isdir(where):
            shutil.rmtree(where)
        elif FRAME_FILE.match(n) or n in WORKSPACE_FILES:
            os.unlink(where)


def bounded(frames: DataFrame, n: int = 20) -> dict:
    """The count, and the first n rows as id, time and path."""
    rows = frames.orderBy("source_id", "index").select("id", "time_sec", "path").limit(n).collect()
    return {"count": frames.count(), "sample": [r.asDict() for r in rows]}


def with_digests(spark: SparkSession, pattern: str) -> DataFrame:
    """path, size, sha256 of files."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def verified(digests: DataFrame, expected: DataFrame) -> DataFrame:
    """path, actual, ok: the digests of files against those expected (path, sha256), in any case of letters.
    A file that is not there has no actual digest, and is not ok."""
    want = expected.select("path", F.col("sha256").alias("wanted"))
    both = want.join(digests.select("path", F.col("sha256").alias("actual")), "path", "left")
    return both.select("path", "actual", F.coalesce(F.lower("actual") == F.lower("wanted"), F.lit(False)).alias("ok"))
