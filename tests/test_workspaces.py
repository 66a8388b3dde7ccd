"""The steps over workspaces, with small stand-ins for the decoder and the probe."""

import json
import os
import stat
import sys

import numpy as np
import pytest

from keyreel import cli, schemas
from keyreel.errors import FrameError, as_frame_error
from keyreel.functions import media
from keyreel.operators import scoring
from keyreel.operators import select as S
from keyreel.plans import sampling
from keyreel.plans import workspaces as P
from keyreel.sources import media as M
from keyreel.sources import workspace as W

#: Videos are text files of "seconds fps width height"; a frame's file holds its time.
PROBE = """
import json, sys
path = sys.argv[-1]
sec, fps, w, h = open(path).read().split()
if "-show_entries" in sys.argv:
    n = round(float(sec) * float(fps))
    print(json.dumps({"frames": [{"best_effort_timestamp_time": str(i / float(fps))} for i in range(n)]}))
else:
    print(json.dumps({"streams": [{"codec_type": "video", "codec_name": "mpeg4", "width": int(w), "height": int(h), "avg_frame_rate": fps + "/1"}], "format": {"duration": sec}}))
"""
FFMPEG = """
import os, sys
a = sys.argv[1:]
path, out = a[a.index("-i") + 1], a[-1]
get = lambda k: a[a.index(k) + 1] if k in a else None
if out == "pipe:1":
    vf = get("-vf")
    w, h = map(int, vf.split("scale=")[1].split(":")[:2])
    i = 1
    names = [path] if "%" not in path else []
    while "%" in path and os.path.exists(path % i):
        names.append(path % i)
        i += 1
    for n in names:
        t = float(open(n).read())
        sys.stdout.buffer.write(bytes([int(t * 60) % 256]) * (w * h * 3))
else:
    sec, fps = map(float, open(path).read().split()[:2])
    start = float(get("-ss") or 0)
    if get("-frames:v") == "1" and "%" not in out:
        times = [start]
    else:
        step = 1 / fps
        if get("-vf") and "fps=1/" in get("-vf"):
            step = float(get("-vf").split("fps=1/")[1].split(",")[0])
        end = min(sec, start + float(get("-t") or sec))
        times = [start + k * step for k in range(int((end - start) / step + 1))]
        if "fps=1/" not in (get("-vf") or ""):
            times = [t for t in times if t < end - 1e-9][: int(get("-frames:v") or 10**9)]
    for k, t in enumerate(times):
        open(out % (k + 1) if "%" in out else out, "w").write(repr(t))
"""


class Detector:
    """A dog in bright frames."""

    id = "bright"

    def is_ready(self):
        return True

    def detect_objects(self, rgb):
        raw = np.zeros((3549, 85), np.float32)
        if rgb.mean() > 50:
            raw[1000, 4], raw[1000, 5 + 16], raw[1000, 2:4] = 1.0, 0.9, np.log(8.0)
        return raw


@pytest.fixture(scope="module")
def tools(tmp_path_factory):
    folder, out = tmp_path_factory.mktemp("bin"), []
    for name, code in (("ffmpeg", FFMPEG), ("ffprobe", PROBE)):
        f = folder / name
        f.write_text(f"#!{sys.executable}\n{code}")
        f.chmod(f.stat().st_mode | stat.S_IXUSR)
        out.append(str(f))
    return P.Tools(*out)


@pytest.fixture(scope="module")
def videos(tmp_path_factory):
    a, b = (tmp_path_factory.mktemp("v") / "clip.mp4" for _ in range(2))
    a.write_text("2 10 320 240")
    b.write_text("3 4 1280 720")
    return [str(a), str(b)]


def by_source(df):
    out = {}
    for r in df.orderBy("source_id", "index").collect():
        out.setdefault(r.source_id, []).append(r)
    return out


def test_extract_analyze_select_export(spark, tools, videos, tmp_path):
    root = str(tmp_path / "w")
    events = []
    frames = P.extract(spark, videos, root, images=P.Images(max_width=640, tools=tools), progress=events.append)
    got = by_source(frames)
    assert {k: [r.time_sec for r in v] for k, v in got.items()} == {"clip": [0.0, 0.5, 1.0, 1.5], "clip-2": [0.0, 0.5, 1.0, 1.5, 2.0, 2.5]}
    assert (got["clip"][0].width, got["clip"][0].height) == (320, 240) and (got["clip-2"][0].width, got["clip-2"][0].height) == (640, 360)
    assert all(float(open(r.path).read()) == r.time_sec for v in got.values() for r in v)
    assert not os.path.exists(f"{root}/frames/clip/frame_000005.jpg")  # one more than planned was written
    assert events[-1] == {"phase": "extract", "done": 1, "total": 1, "percent": 100, "message": "done"}
    with pytest.raises(FrameError) as e:
        P.extract(spark, videos, root, images=P.Images(tools=tools))
    assert e.value.code == "GUARD"

    scan = P.analyze(spark, root, tools)
    assert scan.count() == 10 and scan.where("recommended").count() >= 2
    assert by_source(P.read_frames(spark, root))["clip"][0].metrics.hash is not None
    with pytest.raises(FrameError) as e:
        P.select(spark, root, options=S.SelectOptions(with_=("dog",)), tools=tools)
    assert e.value.code == "VISION_NOT_READY"
    with pytest.raises(FrameError) as e:
        P.export(spark, root, str(tmp_path / "x"))
    assert e.value.code == "NOT_FOUND"
    chosen = P.select(spark, root, options=S.SelectOptions(with_=("dog",), min_confidence=0.5), provider=Detector, tools=tools).collect()
    assert sorted((r.source_id, r.time_sec) for r in chosen) == [("clip", 1.0), ("clip", 1.5), ("clip-2", 1.0), ("clip-2", 1.5), ("clip-2", 2.0), ("clip-2", 2.5)]
    # Detections from 0.5 up do for 0.6, but not for 0.4.
    P.select(spark, root, options=S.SelectOptions(with_=("dog",), min_confidence=0.6, limit=1), tools=tools)
    with pytest.raises(FrameError):
        P.select(spark, root, options=S.SelectOptions(with_=("dog",)), tools=tools)

    out = tmp_path / "out"
    images = P.Images("image/png", 0.92, template="{source}_{time}", tools=tools)
    done = P.export(spark, root, str(out), images).orderBy("source_id").collect()
    assert len(done) == 2 and all(float(open(r.path).read()) == r.time_sec for r in done)
    assert {os.path.relpath(r.path, out).split("/")[0] for r in done} == {"clip", "clip-2"} and done[0].path.endswith("clip_00m01s00.png")
    assert json.loads((out / "manifest.json").read_text())["count"] == 2
    with pytest.raises(FrameError) as e:
        P.export(spark, root, str(out), images)
    assert e.value.code == "GUARD"
    P.select(spark, root, options=S.SelectOptions(min_quality=1.0), tools=tools)
    with pytest.raises(FrameError) as e:
        P.export(spark, root, str(tmp_path / "y"), images)
    assert e.value.code == "EXPORT_FAILED"


def test_extract_modes(spark, tools, videos, tmp_path):
    times = lambda name, how, **k: [r.time_sec for r in by_source(P.extract(spark, videos[:1], str(tmp_path / name), how, P.Images(tools=tools), **k))["clip"]]
    assert times("count", P.Sampling(count=3)) == pytest.approx([0, 2 / 3, 4 / 3])
    assert times("at", P.Sampling(at=[1.75, 0.25, 9.0])) == [0.25, 1.75]
    assert times("all", P.Sampling(all_=True, start=0.5, end=1.0)) == pytest.approx([0.5, 0.6, 0.7, 0.8, 0.9])
    assert times("few", P.Sampling(all_=True, budget=5)) == pytest.approx([0.0, 0.5, 1.0, 1.4, 1.9])  # positions 0, 4.75, 9.5, 14.25, 19
    assert times("capped", P.Sampling(every=0.1, budget=4)) == [0.0, 0.5, 1.0, 1.5]
    assert times("range", P.Sampling(every=0.5, start=0.5, end=1.6)) == [0.5, 1.0, 1.5]
    with pytest.raises(FrameError) as e:
        times("most", P.Sampling(all_=True), most=5)
    assert e.value.exit_code == 7


def test_times_by_rate(spark, tools, videos, tmp_path):
    probe = tmp_path / "ffprobe"  # lists one frame too many
    probe.write_text(f"#!{sys.executable}\n" + PROBE.replace("n = round(float(sec) * float(fps))", "n = round(float(sec) * float(fps)) + 1"))
    probe.chmod(0o755)
    images = lambda t: P.Images(tools=t)
    short = P.Tools(tools.ffmpeg, str(probe))
    root = str(tmp_path / "w")
    frames = P.extract(spark, videos[:1], root, P.Sampling(all_=True), images(short), output=str(tmp_path / "o"))
    assert [r.time_sec for r in by_source(frames)["clip"]] == pytest.approx([i / 10 for i in range(20)])
    assert [tuple(r) for r in P.read_timing(spark, root).collect()] == [("clip", 20, "estimated-fps")]
    with pytest.raises(Exception) as e:
        P.extract(spark, videos[:1], str(tmp_path / "x"), P.Sampling(all_=True), images(short))
    assert as_frame_error(e.value).code == "EXTRACT_FAILED"
    P.extract(spark, videos[:1], str(tmp_path / "y"), P.Sampling(all_=True), images(tools), output=str(tmp_path / "p"))
    assert [r.timestamp_basis for r in P.read_timing(spark, str(tmp_path / "y")).collect()] == ["source-pts"]
    P.extract(spark, videos, str(tmp_path / "z"), P.Sampling(count=2), images(tools))
    assert sorted(tuple(r) for r in P.read_timing(spark, str(tmp_path / "z")).collect()) == [("clip", 2, "planned-interval"), ("clip-2", 2, "planned-interval")]


def test_named_output(spark, tools, videos, tmp_path):
    out = tmp_path / "o"
    images = P.Images(template="{source}-{index}", tools=tools)
    frames = P.extract(spark, videos, str(tmp_path / "w"), P.Sampling(count=2, budget=None), images, str(out)).collect()
    assert sorted(os.path.relpath(r.path, out) for r in frames) == ["clip-2/clip-0001.jpg", "clip-2/clip-0002.jpg", "clip/clip-0001.jpg", "clip/clip-0002.jpg"]
    assert all(float(open(r.path).read()) == r.time_sec for r in frames)
    with pytest.raises(FrameError) as e:
        P.analyze(spark, str(tmp_path / "w"), tools)
    assert e.value.code == "USAGE"


def test_all_probes(spark, tools, videos, tmp_path, capsys):
    where = ["--ffmpeg-path", tools.ffmpeg, "--ffprobe-path", tools.ffprobe]
    assert cli.main(["probe", *videos * 12, *where]) == 0
    assert len(json.loads(capsys.readouterr().out)["probes"]) == 24


def test_command_line(spark, tools, videos, tmp_path, capsys):
    where = ["--ffmpeg-path", tools.ffmpeg, "--ffprobe-path", tools.ffprobe]

    def call(*argv):
        code = cli.main([*argv, *where])
        got = capsys.readouterr()
        return code, json.loads(got.out or "null"), [json.loads(x) for x in got.err.splitlines() if x.startswith("{")]

    code, out, _ = call("probe", *videos)
    assert code == 0 and [(p["source_id"], p["duration_sec"], p["width"]) for p in out["probes"]] == [("clip", 2.0, 320), ("clip-2", 3.0, 1280)]
    root = str(tmp_path / "w")
    code, out, said = call("run", videos[0], "--workspace", root, "--preset", "representative", "--export", str(tmp_path / "e"), "--filename-template", "{index}")
    assert code == 0 and out["exported"] == out["count"] >= 1 and (tmp_path / "e" / "0001.jpg").exists()
    assert said[-1]["phase"] == "run" and said[-1]["percent"] == 100
    code, out, _ = call("detect", root, "--provider", "tests.test_workspaces:Detector", "--object", "dog")
    assert code == 0 and out["sources"] == [{"source_id": "clip", "frames_with_objects": 2, "detection_count": 2}]
    assert call("select", root, "--with", "dog", "--limit", "1")[1]["count"] == 1
    assert call("analyze", str(tmp_path / "none"))[0] == 3 and call("probe", "missing.mp4")[0] == 3
    assert call("detect", root, "--text")[0] == 5 and call("detect", root)[0] == 5
    assert call("export", root, "--output", str(tmp_path / "e"))[2][-1]["code"] == "GUARD"


def test_errors_of_executors(spark, videos):
    with pytest.raises(Exception) as e:
        P.probe(P.sources_of(spark, videos), P.Tools(ffprobe="/bin/false")).collect()
    assert as_frame_error(e.value).code == "PROBE_FAILED"


def test_files_without_numbers(spark, tools, tmp_path):
    rows = []
    for i, (name, t) in enumerate((("b.jpg", 0.5), ("a.jpg", 1.0), ("c.jpg", 2.0))):
        (tmp_path / name).write_text(repr(t))
        rows.append(("v", f"frame-{i:06d}", i, 500 * i, str(tmp_path / name)))
    px = P.decoded(spark.createDataFrame(rows, "source_id string, id string, index int, time_ms long, path string"), tools)
    assert [(r["index"], r.data[0]) for r in px.orderBy("index").collect()] == [(0, 30), (1, 60), (2, 120)]


def test_tools(tools, tmp_path, monkeypatch):
    monkeypatch.setenv("KEYREEL_FFMPEG_PATH", tools.ffmpeg)
    monkeypatch.setenv("KEYREEL_TOOLS_DIR", str(tmp_path))
    assert M.find_tool("ffmpeg") == tools.ffmpeg and M.find_tool("ffmpeg", tools.ffprobe) == tools.ffprobe
    assert [k for k, _ in M.tool_places("ffmpeg")] == ["explicit", "environment", "path", "managed"]
    monkeypatch.delenv("KEYREEL_FFMPEG_PATH")
    monkeypatch.setenv("PATH", "")
    for make in (lambda: None, lambda: (tmp_path / "ffmpeg").write_text("no program")):
        make()
        with pytest.raises(FrameError) as e:
            M.find_tool("ffmpeg")
        assert e.value.code == "FFMPEG_NOT_FOUND"
    (tmp_path / "ffmpeg").chmod(0o755)
    assert M.find_tool("ffmpeg") == str(tmp_path / "ffmpeg")


def test_bounded_output():
    assert M.run_tool([sys.executable, "-c", "print('x' * 9)"], 10) == b"x" * 9 + b"\n"
    with pytest.raises(FrameError, match="more than 10 bytes"):
        M.run_tool([sys.executable, "-c", "while True: print('x')"], 10)
    with pytest.raises(FrameError, match="no good"):
        M.run_tool([sys.executable, "-c", "import sys; sys.exit('no good')"])


def test_confirmation():
    asked = []
    sampling.guard_rows(10**6, confirm=lambda n: asked.append(n) or True)
    assert asked == [10**6]
    for answer in (None, lambda n: False):
        with pytest.raises(FrameError):
            sampling.guard_rows(10**6, confirm=answer)


def test_selection_documents(spark, tmp_path):
    rows = [("v", 2, "f2", 900, 0.9, [("rank", "b")]), ("v", 1, "f1", 100, 0.1, [("rank", "a")]), ("w", 1, "g", 0, 0.0, [])]
    said = S.echoed(S.SelectOptions(limit=2))
    done = W.write_selection_documents(spark.createDataFrame(rows, schemas.SELECTIONS), str(tmp_path), said).orderBy("source_id").collect()
    assert [(r.source_id, r["count"]) for r in done] == [("v", 2), ("w", 1)]
    doc = json.loads(open(done[0].path).read())
    assert [s["frame_id"] for s in doc["selections"]] == ["f1", "f2"] and doc["ranking"]["limit"] == 2 and doc["selections"][0]["reasons"] == [{"code": "rank", "message": "a"}]


def test_assets(spark, tmp_path):
    good = {"id": "m", "file": "m.onnx", "sha256": "A" * 64, "origin": "o", "upstreamVersion": "1", "license": "l", "provenance": "p", "status": "available", "sizeBytes": 5}
    path = tmp_path / "models.json"
    path.write_text(json.dumps({"schemaVersion": 1, "models": [good]}, indent=1))
    assert W.read_assets(spark, str(path), "models").first().file == "m.onnx"
    for change in ({"sha256": "x"}, {"status": "gone"}, {"origin": None}, {"sizeBytes": 0}):
        path.write_text(json.dumps({"schemaVersion": 1, "models": [{**good, **change}]}))
        with pytest.raises(Exception) as e:
            W.read_assets(spark, str(path), "models").collect()
        assert as_frame_error(e.value).code == "IO"
    path.write_text(json.dumps({"schemaVersion": 2, "models": [good]}))
    with pytest.raises(Exception, match="version 1"):
        W.read_assets(spark, str(path), "models").collect()


def test_small_values():
    assert media.select_times_filter([1.5, 3]) == "select='eq(t\\,1.500)+eq(t\\,3.000)'"
    assert scoring.recommendation_bounds() == {"min_recommendations": 5, "max_recommendations": 10}
    assert scoring.recommendation_bounds(7, 0) == {"min_recommendations": 1, "max_recommendations": 1}
