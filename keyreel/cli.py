"""Command line: the steps over a workspace, one JSON document on standard output.

Progress goes to standard error as JSON lines, and so does an error; its code gives the exit code."""

from __future__ import annotations

import argparse
import functools
import importlib
import json
import math
import os
import sys
from collections.abc import Callable

from keyreel.errors import FrameError, as_frame_error
from keyreel.functions.media import EXTENSIONS
from keyreel.functions.taxonomy import GROUPS
from keyreel.operators.select import PRESETS, RANKS, SelectOptions

FORMATS = {ext.replace("jpg", "jpeg"): fmt for fmt, ext in EXTENSIONS.items()}


def _tools(p: argparse.ArgumentParser) -> None:
    p.add_argument("--ffmpeg-path")
    p.add_argument("--ffprobe-path")


def _sampling(p: argparse.ArgumentParser) -> None:
    for name in ("every", "fps", "from", "to"):
        p.add_argument(f"--{name}", type=float, dest={"from": "start", "to": "end"}.get(name, name))
    p.add_argument("--count", type=int)
    p.add_argument("--at", type=float, action="append")
    p.add_argument("--all", action="store_true", dest="all_")
    p.add_argument("--budget", type=int)
    p.add_argument("--force", action="store_true", help="don't ask back about large outputs")
    p.add_argument("--max-output-frames", type=int)


def _images(p: argparse.ArgumentParser, quality: float) -> None:
    p.add_argument("--format", choices=sorted(FORMATS), default="jpeg")
    p.add_argument("--quality", type=float, default=quality)
    p.add_argument("--max-width", type=int)
    p.add_argument("--filename-template")
    p.add_argument("--overwrite", action="store_true")


def _detector(p: argparse.ArgumentParser) -> None:
    p.add_argument("--provider", help="module:callable that makes a detector, known to the executors")
    p.add_argument("--model", help="an ONNX file that the executors can read")


def _selection(p: argparse.ArgumentParser) -> None:
    p.add_argument("--preset", choices=sorted(PRESETS))
    for name in ("with", "with-any", "without"):
        p.add_argument(f"--{name}", action="append", dest=name.replace("-", "_") + ("_" if name == "with" else ""))
    for name in ("with-text", "without-text", "dedupe"):
        p.add_argument(f"--{name}", action="store_true", default=None)
    for name in ("min-text-coverage", "max-text-coverage", "min-confidence", "min-quality"):
        p.add_argument(f"--{name}", type=float)
    p.add_argument("--rank", choices=sorted(RANKS))
    for name in ("best-per-scene", "limit"):
        p.add_argument(f"--{name}", type=int)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="keyreel")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, what: str, *parts: Callable[[argparse.ArgumentParser], None]) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=what)
        for part in (*parts, _tools):
            part(c)
        return c

    command("doctor", "what is installed").add_argument("--model")
    command("probe", "facts of videos").add_argument("inputs", nargs="+")
    c = command("extract", "write frames of videos", _sampling, lambda c: _images(c, 0.85))
    c.add_argument("inputs", nargs="+")
    c.add_argument("--workspace", required=True)
    c.add_argument("--output", help="frames of full width go here; without it, candidates go to the workspace")
    command("analyze", "metrics of a workspace's frames").add_argument("workspace")
    c = command("detect", "objects in a workspace's frames", _detector)
    c.add_argument("workspace")
    c.add_argument("--object", action="append", default=[])
    c.add_argument("--group", action="append", default=[], choices=sorted(GROUPS))
    c.add_argument("--people", action="append_const", const="people", dest="group")
    c.add_argument("--text", action="store_true")
    c.add_argument("--min-confidence", type=float, default=0.4)
    c = command("select", "select frames of a workspace, or of a frames table (JSON lines)", _selection, _detector)
    c.add_argument("frames")
    c.add_argument("--out", help="selections of a frames table")
    c.add_argument("--documents", help="a folder for one JSON document a source")
    c = command("export", "the selected frames at full quality", lambda c: _images(c, 0.92))
    c.add_argument("workspace")
    c.add_argument("--output", required=True)
    c.add_argument("--no-manifest", action="store_true")
    c = command("run", "extract, select and export", _sampling, _selection, _detector, lambda c: _images(c, 0.92))
    c.add_argument("inputs", nargs="+")
    c.add_argument("--workspace", required=True)
    c.add_argument("--export")
    e = command("estimate", "expected frames of a sampling plan")
    e.add_argument("--duration", type=float, required=True)
    e.add_argument("--fps", type=float, default=30.0)
    e.add_argument("--every", type=float)
    return p


def options_of(args: argparse.Namespace) -> SelectOptions:
    """Options given on the command line; lists that are empty count as not given."""
    names = SelectOptions.__dataclass_fields__
    values = {n: getattr(args, n, None) for n in names}
    return SelectOptions(**{n: tuple(v) if isinstance(v, list) else v for n, v in values.items() if v not in (None, [])})


def provider_of(args: argparse.Namespace) -> Callable | None:
    from keyreel.plans.workspaces import OnnxProvider

    if args.provider:
        module, _, name = args.provider.partition(":")
        try:
            return getattr(importlib.import_module(module), name)
        except (ImportError, AttributeError, ValueError) as e:
            raise FrameError("USAGE", f"no provider {args.provider!r}: {e}") from e
    return functools.partial(OnnxProvider, args.model) if args.model else None


def report(event: dict) -> None:
    print(json.dumps(event), file=sys.stderr)


def run(argv: list[str], progress: Callable[[dict], None] = report) -> dict:
    args = parser().parse_args(argv)
    if args.command == "doctor":
        import shutil

        return {"ffmpeg": args.ffmpeg_path or shutil.which("ffmpeg"), "ffprobe": args.ffprobe_path or shutil.which("ffprobe"), "vision": bool(args.model and os.path.isfile(args.model)), "text": False}
    if args.command == "estimate":
        n = args.duration * args.fps if args.every is None else args.duration / args.every
        return {"frames": 0 if args.duration <= 0 else max(1, math.ceil(n - 1e-10))}
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from keyreel.operators.select import apply_preset, echoed, validate
    from keyreel.operators.vision import detect_summary, detect_text
    from keyreel.plans import pipeline
    from keyreel.plans import workspaces as P
    from keyreel.sources import workspace

    tools = P.Tools(args.ffmpeg_path, args.ffprobe_path)
    if args.command in ("select", "run"):
        options = options_of(args)
        validate(options)
    if args.command in ("probe", "extract", "run"):
        for path in args.inputs:
            if not os.path.isfile(path):
                raise FrameError("NOT_FOUND", f"no file {path}")
    if hasattr(args, "workspace") and args.command not in ("extract", "run") and not P.is_workspace(args.workspace):
        raise FrameError("NOT_FOUND", f"{args.workspace} is no workspace")
    how = images = None
    if hasattr(args, "all_"):
        given = {k: v for k in ("every", "fps", "count", "at", "all_", "start", "end", "budget") if (v := getattr(args, k)) is not None}
        how = P.Sampling(**({"budget": None} if getattr(args, "output", None) else {}) | given)
    if hasattr(args, "format"):
        width = P.CANDIDATE_WIDTH if args.command == "extract" and not args.output and args.max_width is None else args.max_width
        images = P.Images(FORMATS[args.format], args.quality, width, args.filename_template, tools)
    every = lambda df, *by: [r.asDict(recursive=True) for r in df.orderBy(*by).collect()]
    rows = lambda df, *by: every(df.orderBy(*by).limit(20), *by)
    spark = SparkSession.builder.getOrCreate()
    if args.command == "probe":
        return {"probes": every(P.probe(P.sources_of(spark, args.inputs), tools), "source_id")}
    if args.command == "extract":
        frames = P.extract(spark, args.inputs, args.workspace, how, images, args.output, args.overwrite, args.force, args.max_output_frames, progress)
        return {"workspace": args.workspace, **workspace.bounded(frames)}
    if args.command == "analyze":
        scan = P.analyze(spark, args.workspace, tools, progress)
        return {"workspace": args.workspace, "recommended": scan.where("recommended").count(), "sources": every(scan.groupBy("source_id").agg(F.count("*").alias("frames"), (F.max("metrics.scene_index") + 1).alias("scenes")), "source_id")}
    if args.command == "detect":
        if args.text:
            detect_text()
        frames = P.detect(spark, args.workspace, provider_of(args), args.min_confidence, tools, progress)
        return {"workspace": args.workspace, "sources": every(detect_summary(frames, [*args.object, *args.group]), "source_id")}
    if args.command == "export":
        done = P.export(spark, args.workspace, args.output, images, args.overwrite, not args.no_manifest, progress)
        return {"output": args.output, "count": done.count(), "sample": rows(done, "source_id", "pos")}
    if args.command == "run":
        chosen, done = P.run(spark, args.inputs, args.workspace, args.preset, options, how, args.export, images, provider_of(args), args.overwrite, progress)
        return {"workspace": args.workspace, "count": chosen.count(), "sample": rows(chosen, "source_id", "pos"), "exported": None if done is None else done.count()}
    if P.is_workspace(args.frames):
        chosen = P.select(spark, args.frames, args.preset, options, provider_of(args), tools, progress)
    else:
        chosen = pipeline.run(workspace.read_frames(spark, args.frames), args.preset, options)
    if args.out:
        workspace.write_selections(chosen, args.out)
    if args.documents:
        said = echoed(apply_preset(args.preset, options) if args.preset else options)
        workspace.write_selection_documents(chosen, args.documents, said).write.format("noop").mode("overwrite").save()
    return {"count": chosen.count(), "sample": rows(chosen, "source_id", "pos")}


def main(argv: list[str] | None = None) -> int:
    try:
        print(json.dumps(run(sys.argv[1:] if argv is None else argv)))
        return 0
    except Exception as e:  # noqa: BLE001  every error becomes a record and an exit code
        error = as_frame_error(e)
        print(json.dumps(error.to_dict()), file=sys.stderr)
        return error.exit_code


if __name__ == "__main__":
    sys.exit(main())
