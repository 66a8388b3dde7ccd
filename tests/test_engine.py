import json
import struct
import zlib
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyreel import cli, schemas
from keyreel.errors import FrameError, as_frame_error
from keyreel.functions import media, naming
from keyreel.functions import taxonomy as T
from keyreel.operators import duplicates, scenes, scoring, vision
from keyreel.operators import select as S
from keyreel.plans import pipeline, sampling
from keyreel.sources import media as M
from keyreel.sources import workspace


def solid(spark, greys, times):
    rows = [("v", f"frame-{i:06d}", i, t, 16, 16, 3, bytes([g]) * 768) for i, (g, t) in enumerate(zip(greys, times))]
    return spark.createDataFrame(rows, schemas.PIXELS)


def test_analysis_of_solid_frames(spark):
    out = pipeline.analyze(solid(spark, [10, 12, 200, 198], [0, 500, 2000, 2500]), sensitivity=0.9, debounce_ms=100)
    rows = {r.id: r for r in out.collect()}
    assert len(rows) == 4 and sum(r.recommended for r in rows.values()) >= 1
    assert [rows[f"frame-{i:06d}"].metrics.scene_index for i in range(4)] == [0, 0, 1, 1]
    # Flat frames have equal hashes; 10 and 12 are near in colour, 10 and 200 are not.
    assert [rows[f"frame-{i:06d}"].metrics.duplicate_of_id for i in range(4)] == [None, "frame-000000", None, "frame-000002"]
    f = out.withColumn("detections", F.lit(None).cast(schemas.DETECTIONS)).withColumn("text", F.lit(None).cast(schemas.TEXT))
    chosen = pipeline.run(f, "representative").collect()
    assert [r.frame_id for r in chosen] == ["frame-000000", "frame-000002"]
    assert chosen[0].reasons[-1].code == "rank"


def frames(spark):
    person = [(0, "person", "people", 0.9, (0.0, 0.0, 1.0, 1.0)), (63, "laptop", "products", 0.8, (0.0, 0.0, 1.0, 1.0))]
    m1 = (0, 0.0, 0.9, 0.9, 1.0, 1.0, 0.9, 0.1, 0.5, 0.0, None, [1, 2, 3, 4])
    m2 = (0, 0.0, 0.5, 0.5, 0.0, 1.0, 0.5, 0.1, 0.5, 0.0, "frame-1", [1, 2, 3, 4])
    rows = [("v", "frame-1", 0, 0, 0.0, "/r/frames/frame_000001.jpg", 16, 16, m1, person, (False, 0.0, 0, [])), ("v", "frame-2", 1, 500, 0.5, "/r/frames/frame_000002.jpg", 16, 16, m2, [], (True, 0.2, 1, [(0.0, 0.0, 0.5, 0.5, 30)]))]
    return spark.createDataFrame(rows, schemas.FRAMES)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_predicates(spark):
    f = frames(spark)
    pick = lambda **o: ids(S.filter_frames(f, S.SelectOptions(**o)))
    assert pick(with_=("person",)) == ["frame-1"]
    assert pick(with_=("person",), with_any=("laptop", "dog"), without=("car",)) == ["frame-1"]
    assert pick(without=("laptop",)) == ["frame-2"]
    assert pick(with_text=True) == ["frame-2"] and pick(without_text=True) == ["frame-1"] and pick(with_text=True, without_text=True) == []
    assert pick(min_text_coverage=0.1, max_text_coverage=0.2) == ["frame-2"]
    assert pick(min_quality=0.6) == ["frame-1"] and pick(min_quality=0.0) == ["frame-1", "frame-2"]
    assert pick(with_=("person",), min_confidence=0.95) == []
    # A frame without detections or text is refused, also where another condition would leave it out.
    bare = f.withColumn("detections", F.when(F.col("id") == "frame-1", F.col("detections"))).withColumn("text", F.when(F.col("id") == "frame-1", F.col("text")))
    for bad, code in (({"without": ("car",), "min_quality": 0.6}, "VISION_NOT_READY"), ({"with_": ("person",), "without_text": True, "min_quality": 0.6}, "TEXT_VISION_BLOCKED")):
        with pytest.raises(FrameError) as e:
            S.filter_frames(bare, S.SelectOptions(**bad))
        assert (e.value.code, e.value.exit_code) == (code, 5)
    assert ids(S.filter_frames(bare, S.SelectOptions(min_quality=0.6))) == ["frame-1"]
    for bad in ({"rank": "size"}, {"min_confidence": 0.0}, {"limit": 0}, {"min_text_coverage": 0.5, "max_text_coverage": 0.1}, {"min_quality": 2.0}):
        with pytest.raises(FrameError) as e:
            S.validate(S.SelectOptions(**bad))
        assert e.value.exit_code == 2


def test_presets_and_reuse():
    o = S.apply_preset("people", S.SelectOptions(dedupe=False, limit=3))
    assert o == replace(S.PRESETS["people"], dedupe=False, limit=3)
    with pytest.raises(FrameError):
        S.apply_preset("none")
    assert [S.can_reuse(a, b) for a, b in ((0.2, 0.4), (0.4, 0.4), (0.5, 0.4), (None, 0.4))] == [True, True, False, False]
    assert S.echoed(S.SelectOptions(with_=("dog",)))["filters"]["with"] == ("dog",)


def test_limit_after_best_per_scene_is_by_time(spark):
    rows = [("v", f"f{i}", i, i * 100, (s, q)) for i, (s, q) in enumerate([(0, 0.1), (0, 0.2), (1, 0.9), (2, 0.8), (2, 0.8)])]
    f = spark.createDataFrame(rows, "source_id string, id string, index int, time_ms long, metrics struct<scene_index:int,composite:double>")
    f = f.withColumn("metrics", F.col("metrics").withField("duplicate_of_id", F.lit(None).cast("string")))
    out = S.rank_and_reduce(f, S.SelectOptions(best_per_scene=1, limit=2)).orderBy("pos").collect()
    assert [r.id for r in out] == ["f1", "f2"]
    assert [r.id for r in S.rank_and_reduce(f, S.SelectOptions(limit=2)).orderBy("pos").collect()] == ["f2", "f3"]
    assert out[0].reasons[0].message == "Top 1 in scene 0" and out[0].reasons[1].message == "Ranked by quality: 0.200"


def test_taxonomy(spark):
    assert len(T.CLASS_NAMES) == 80 and T.resolve("Laptop") == [63] and T.resolve("cell_phone") == [67] and T.resolve("person") == [0] and T.resolve("animals") == list(range(14, 24))
    with pytest.raises(FrameError):
        T.resolve("unicorn")
    d = {r.class_id: r for r in T.dimension(spark).collect()}
    assert d[79].class_name == "toothbrush" and d[9].group is None and d[79].group == "products"
    assert spark.range(1).select(T.class_name(F.lit(99)).alias("n")).first().n == "object_99"


def test_sampling(spark):
    probes = lambda d: spark.createDataFrame([("v", d, 30.0)], "source_id string, duration_sec double, fps double")
    plan = lambda d, **o: sampling.with_plan(probes(d), **o).select("plan.*").first()
    times = lambda d, **o: sampling.with_plan(probes(d), **o).select(sampling.plan_times(F.col("plan")).alias("t")).first().t
    p = plan(10_000.0, every=0.5, budget=100)
    assert (p.capped, p["count"], p.equal_density, p.interval_sec) == (True, 100, False, 100.0)
    assert times(2.0, every=0.5) == [0, 0.5, 1, 1.5]
    assert len(times(2.0, count=3)) == 3 and max(times(2.0, count=3)) < 2 and times(2.0, count=1) == [0]
    assert not plan(50.0, every=0.5, budget=100).capped
    assert times(5.0, at=[3.0, 1.0, 1.0, 9.0]) == [1, 3] and plan(5.0, all_=True, budget=None)["count"] == 150
    for bad in ({"start": 5.0}, {"at": [9.0]}):
        with pytest.raises(Exception, match="USAGE"):
            plan(5.0, **bad)
    with pytest.raises(FrameError):
        plan(5.0, every=1.0, fps=2.0)
    est = spark.range(1).select(sampling.estimate("all", F.lit(10.0), F.lit(30.0)).alias("n")).first().n
    assert est == 300
    with pytest.raises(FrameError):
        sampling.guard_rows(5001)
    sampling.guard_rows(5001, force=True)


def test_names(spark):
    row = lambda t, s="clip", i=1, ms=0: spark.range(1).select(naming.render(t, F.lit(s), F.lit(i), F.lit(ms)).alias("n")).first().n
    assert row("{source}_{index}") == "clip_0001" and row("  ") == "clip_frame_0001" and row("{time}", ms=61_234) == "01m01s23" and row("{time}", ms=59_999) == "00m60s00"
    assert row("{index}", i=123_456) == "123456" and row("a/b:{scene}{nope}") == "a-b-01{nope}"
    df = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "id int, name string")
    assert [r.name for r in naming.with_unique(df, "name", ["id"]).orderBy("id").collect()] == ["a", "A_2", "b"]
    slugs = spark.createDataFrame([(0, "/a/clip.mp4"), (1, "/b/clip.mov"), (2, "/b/other.mp4"), (3, "/c/é.mp4")], "id int, p string").select("id", naming.slug(F.col("p")).alias("s"))
    assert [r.s for r in naming.with_unique(slugs, "s", ["id"], "-").orderBy("id").collect()] == ["clip", "clip-2", "other", "video"]


def test_probe_facts(spark):
    doc = {"streams": [{"codec_type": "audio"}, {"codec_type": "video", "codec_name": "h264", "width": 1920, "height": 1080, "avg_frame_rate": "0/0", "r_frame_rate": "30000/1001", "side_data_list": [{"rotation": -90}]}],
           "format": {"duration": "2.5", "format_name": "mov", "size": "99"}}
    df = spark.createDataFrame([("v", "/v.mp4", json.dumps(doc))], "source_id string, path string, json string")
    p = M.probes(df).first()
    assert (p.width, p.height, p.rotation, p.has_audio, p.size_bytes, p.duration_sec) == (1080, 1920, -90.0, True, 99, 2.5) and p.fps == pytest.approx(29.97, abs=0.01)
    with pytest.raises(Exception, match="PROBE_FAILED"):
        M.probes(df.withColumn("json", F.lit('{"streams":[]}'))).collect()
    times = '{"frames":[{"best_effort_timestamp_time":"1"},{"best_effort_timestamp_time":"1.125"},{"best_effort_timestamp_time":"-1"},{"best_effort_timestamp_time":"N/A"},{}]}'
    assert spark.range(1).select(media.parse_timestamps(F.lit(times)).alias("t")).first().t == [1.0, 1.125]
    assert media.interval_command("i", "o", 0.01, quality=0.9)[-4:] == ["fps=1/0.05", "-q:v", "3", "o"]
    assert media.interval_command("i", "o", 0.5, start=10, end=25)[2:8] == ["-ss", "10", "-i", "i", "-t", "15"]
    assert media.all_frames_command("i", "o", start=1.5, end=4)[2:8] == ["-ss", "1.5", "-i", "i", "-t", "2.5"]
    assert media.single_frame_command("i", "o", 36000.125)[3] == "36000.125"
    assert "-read_intervals" in media.timestamp_command("i", 1, 2) and M.pts_buffer(1) == 1 << 20


def png(path, img):
    raw = b"".join(b"\0" + img[y].tobytes() for y in range(img.shape[0]))
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", img.shape[1], img.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images_and_times(spark, tmp_path):
    folder = tmp_path / "clip"
    folder.mkdir()
    imgs = [np.random.default_rng(i).integers(0, 256, (20, 30, 3), dtype=np.uint8) for i in range(3)]
    for i, img in enumerate(imgs):
        png(folder / f"frame_{i + 1:06d}.png", img)
    rows = M.read_images(spark, f"{folder}/*.png", interval_sec=0.5).orderBy("index").collect()
    assert [(r.source_id, r.id, r.time_ms) for r in rows] == [("clip", f"frame-{i:06d}", 500 * i) for i in range(3)]
    assert all(bytes(r.data) == img.tobytes() for r, img in zip(rows, imgs))
    listing = tmp_path / "times.json"
    listing.write_text(json.dumps({"frames": [{"best_effort_timestamp_time": str(t)} for t in (0.0, 0.5, 1.5, 9.0)]}))
    spark.dataSource.register(M.FrameTimes)
    times = spark.read.format("frametimes").option("path", str(listing)).option("from", "0").option("to", "9").load()
    files = spark.createDataFrame([("clip", f"f{i}") for i in range(3)], "source_id string, path string")
    got = M.with_source_times(files, times.select(F.lit("clip").alias("source_id"), "pts")).orderBy("index").collect()
    assert [(r.path, r.time_ms) for r in got] == [("f0", 0), ("f1", 500), ("f2", 1500)]
    with pytest.raises(Exception, match="differ"):
        M.with_source_times(files.limit(2), times.select(F.lit("clip").alias("source_id"), "pts")).collect()


def test_workspace(spark, tmp_path):
    out = str(tmp_path / "frames.jsonl")
    f = frames(spark)
    workspace.write_frames(f, out, root="/r")
    assert "frames/frame_000001.jpg" in "".join(p.read_text() for p in (tmp_path / "frames.jsonl").glob("part-*")) and "/r/frames" not in "".join(p.read_text() for p in (tmp_path / "frames.jsonl").glob("part-*"))
    back = workspace.read_frames(spark, out, root="/r").orderBy("index").collect()
    assert back == f.orderBy("index").collect()
    assert workspace.bounded(f, 1)["count"] == 2
    with pytest.raises(Exception, match="out of range"):
        schemas.validated(f.withColumn("index", F.lit(-1))).collect()
    folder = tmp_path / "out"
    folder.mkdir()
    for n in ("keep.txt", "frame_000001.jpg"):
        (folder / n).write_text("x")
    with pytest.raises(FrameError) as e:
        workspace.prepare_output(str(folder))
    assert e.value.exit_code == 7
    workspace.prepare_output(str(folder), overwrite=True)
    assert [p.name for p in folder.iterdir()] == ["keep.txt"]
    workspace.write_json(str(folder / "manifest.json"), {"a": 1})
    assert workspace.read_json(str(folder / "manifest.json")) == {"a": 1}


def test_pareto_and_keyframes(spark):
    f = spark.createDataFrame([("v", "a", 0, 0.9, 0.9, None), ("v", "b", 1, 0.88, 0.4, None), ("v", "e", 2, 0.91, 0.91, "a")], "source_id string, id string, index int, composite double, sharpness double, duplicate_of_id string")
    assert ids(scoring.pareto_keepers(f)) == ["a"] and ids(scoring.pareto_front(f.where("id <> 'e'"))) == ["a"]
    assert ids(scoring.scene_keyframes(f.withColumn("scene_index", F.when(F.col("id") == "b", 1).otherwise(0)))) == ["a", "b"]
    assert scoring.normalized({"sharpness": -1, "exposure": 0, "uniqueness": 0, "scene_position": 0}) == scoring.WEIGHTS


def test_adaptive_threshold_uses_the_upper_median(spark):
    rows = [("lo", i, d) for i, d in enumerate([0.01, 0.02, 0.015, 0.012])] + [("hi", i, d) for i, d in enumerate([0.2, 0.25, 0.22, 0.8])] + [("few", 0, 0.5)]
    t = {r.source_id: r.threshold for r in scenes.adaptive_thresholds(spark.createDataFrame(rows, "source_id string, index int, difference double")).collect()}
    assert t["lo"] < t["hi"] and t["few"] == pytest.approx(0.113)
    assert t["lo"] == pytest.approx(0.015 + 0.04)


def test_vision(spark):
    assert vision.cell_count() == 3549 and vision.decode(np.zeros((3549, 85)), 640, 360) == []
    raw = np.zeros((3549, 85), np.float32)
    for cell, score in ((10, 0.9), (11, 0.8), (3000, 0.7)):
        raw[cell, 4], raw[cell, 5 + 16], raw[cell, 2:4] = 1.0, score, np.log(8.0)
    got = vision.decode(raw, 416, 416)
    assert [round(d["confidence"], 2) for d in got] == [0.9, 0.7] and got[0]["class_name"] == "dog"
    m = np.zeros((8, 8), np.float32)
    m[2:6, 2:6] = 0.9
    m[0, 7] = 0.9
    t = vision.text_regions(m, 4)
    assert t["region_count"] == 1 and t["coverage"] == pytest.approx(17 / 64) and t["regions"][0]["pixel_count"] == 16
    assert vision.letterboxed(np.zeros((100, 200, 3), np.uint8)).shape == (416, 416, 3) and vision.letterboxed(np.zeros((100, 200, 3), np.uint8))[300, 0, 0] == 0x72

    class Fake:
        id = "fake"

        def is_ready(self):
            return True

        def detect_objects(self, rgb):
            return raw

    rows = vision.with_detections(solid(spark, [1], [0]), Fake).first()
    assert [d.class_id for d in rows.detections] == [16, 16]
    with pytest.raises(FrameError):
        vision.detect_text()


def test_streaming_boundaries(spark, tmp_path):
    from keyreel.streaming.boundaries import stream_boundaries

    rng = np.random.default_rng(5)
    rows = [(s, i, i * 400, float(rng.random())) for s in ("a", "b") for i in range(60)]
    schema = "source_id string, index int, time_ms bigint, difference double"
    batch = scenes.boundaries(spark.createDataFrame(rows, schema), F.lit(0.5), 1000)
    for k in range(3):
        part = [r for r in rows if r[1] // 20 == k]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = stream_boundaries(stream, 0.5, 1000).writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r.source_id, r["index"], r.time_ms) for r in df.collect())
    assert key(spark.table("found")) == key(batch) and key(batch)


def test_many_boundaries(spark):
    rng = np.random.default_rng(8)
    rows = [("a", i, i * 400, float(rng.random())) for i in range(1, 5000)] + [("b", 0, 100, 0.9), ("b", 1, None, 0.9), ("b", 2, 1200, 0.9), ("c", 0, 0, 0.9)]
    wanted = []
    for s in "abc":
        own = [r for r in rows if r[0] == s]
        last = own[0][2]
        for _, i, t, d in own[1:]:
            if d >= 0.5 and t is not None and t - last >= 700:
                wanted.append((s, i, t))
                last = t
    got = scenes.boundaries(spark.createDataFrame(rows, "source_id string, index int, time_ms bigint, difference double"), F.lit(0.5), 700).collect()
    assert len(wanted) > 4 * scenes.PIECE and sorted(tuple(r) for r in got) == sorted(wanted)


def test_duplicates_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(duplicates, "BLOCK", 4)
    rng = np.random.default_rng(2)
    values = {s: rng.integers(0, 40, n).tolist() for s, n in (("a", 30), ("b", 4), ("c", 1))}
    rows = [(s, f"{s}{i}", i, v) for s, own in values.items() for i, v in enumerate(own)]
    gap = F.abs(F.col("a.v") - F.col("b.v"))
    got = duplicates.nearest_earlier(spark.createDataFrame(rows, "source_id string, id string, index int, v int"), gap, gap <= 1).collect()
    wanted = []
    for s, own in values.items():
        for i, v in enumerate(own):
            near = [j for j in range(i) if abs(own[j] - v) <= 1]
            wanted.append((s, f"{s}{i}", min((abs(o - v) for o in own[:i]), default=128), f"{s}{near[0]}" if near else None))
    assert sorted(tuple(r) for r in got) == sorted(wanted)


def test_errors_and_command_line(capsys):
    assert as_frame_error(ValueError("x")).code == "INTERNAL" and as_frame_error(KeyboardInterrupt()).exit_code == 6
    assert FrameError("GUARD", "m").to_dict()["exit_code"] == 7
    assert cli.main(["estimate", "--duration", "10"]) == 0 and json.loads(capsys.readouterr().out) == {"frames": 300}
    args = cli.parser().parse_args(["select", "f", "--with", "dog", "--limit", "2"])
    assert cli.options_of(args) == S.SelectOptions(with_=("dog",), limit=2)
