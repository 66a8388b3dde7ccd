import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from keyreel.llm import audio as A


def test_wav_round_trip():
    for data in (b"", b"a", bytes(range(256)) * 5, b"x" * 64):
        p = A.pad(data)
        assert len(p) % 64 == 0 and len(p) >= 64 and p.startswith(data) and not p[len(data):].strip(b"\0")
        assert A.from_wav(A.to_wav(p)) == (p, A.RATE)
    with pytest.raises(ValueError):
        A.from_wav(b"RIFFxxxx")
    with pytest.raises(ValueError):
        A.from_wav(A.to_wav(b"abcd")[:-2])


def test_resample_against_plain_filter():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 256, 777, dtype=np.uint8)
    x = (s.astype(float) - 128) / 128
    h = np.zeros(A.UP * A.TAPS)
    for r in range(A.UP):
        h[r :: A.UP] = A.PHASES[r]
    up = np.zeros(len(x) * A.UP)
    up[:: A.UP] = x
    full = np.convolve(up, h)[:: A.DOWN]
    got = A.resample(s, 0, 400)
    assert np.allclose(got, full[:400])
    assert np.allclose(A.resample(s, 123, 100), full[123:223])
    tone = (128 + 100 * np.sin(2 * np.pi * 440 * np.arange(16000) / A.RATE)).astype(np.uint8)
    y = A.resample(tone, 0, 10000)
    assert abs(np.abs(np.fft.rfft(y)).argmax() - 440) <= 1


def test_blocks_do_not_show(monkeypatch):
    s = np.random.default_rng(2).integers(0, 256, 60_000, dtype=np.uint8)
    a = A.log_mel(s)
    monkeypatch.setattr(A, "BLOCK", 37)
    b = A.log_mel(s)
    assert np.allclose(a[0], b[0], atol=1e-4) and np.allclose(a[1], b[1])


def test_hysteresis():
    e = np.array([-30, -5, -3, -6, -8, -30, -9, -3, -3, -30.0])
    got = A.segments(e)
    state, want, begin = False, [], 0
    loud = np.round(e[e > -20], 6)
    hi, lo = np.quantile(loud, (0.4, 0.1), method="lower")
    for i, x in enumerate([*e, -99.0]):
        if not state and x >= hi and x > -20:
            state, begin = True, i
        elif state and (x < lo or x <= -20):
            state = False
            want.append([begin, i])
    assert got.tolist() == want and want
    assert A.segments(np.full(5, -30.0)).tolist() == []


def test_tensors_read_back():
    s = np.concatenate([np.full(9000, 128, np.uint8), np.random.default_rng(3).integers(0, 256, 30_000, dtype=np.uint8), np.full(9000, 128, np.uint8)])
    seg, spans, tensors = A.analyse(s)
    assert len(seg) and tensors.shape[1:] == A.SHAPE and (spans[:, 1] > spans[:, 0]).all()
    assert seg[0, 0] >= 500 and seg[-1, 1] <= 48_000 / 16 - 400
    back = pa.ipc.open_stream(A.tensor_bytes(spans, tensors)).read_all()
    assert (back.column("mel").combine_chunks().to_numpy_ndarray() == tensors).all()
    assert isinstance(back.schema.field("mel").type, pa.FixedShapeTensorType)


def test_digests(spark):
    texts = [None, "", "a", "é" * 40, "x" * 64, "word " * 50_000, "a"]
    df = spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    got = {r.doc_id: r for r in A.digests(df).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        p = A.pad(b)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(p) + 44, hashlib.sha256(A.to_wav(p)).hexdigest())
    assert got[2].feature == got[6].feature and got[0].feature == got[1].feature != got[2].feature
    kept = A.with_audio(df).collect()
    assert all(A.from_wav(bytes(r.media))[0] == A.pad((r.text or "").encode()) for r in kept)
    assert A.digests(df.limit(0)).count() == 0


def test_log_mel_against_plain_version():
    """Frame by frame with a plain Fourier sum and triangles built filter by filter."""
    rng = np.random.default_rng(8)
    s = np.concatenate([rng.integers(100, 156, 700, dtype=np.uint8), (128 + 90 * np.sin(np.arange(900) * 0.4)).astype(np.uint8)])
    total = -(-len(s) * A.UP // A.DOWN)
    y = A.resample(s, 0, total + A.FRAME)
    rate = A.RATE * A.UP / A.DOWN
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    hz = lambda m: 700 * (10 ** (m / 2595) - 1)
    low, high = mel(50.0), mel(rate / 2)
    edges = [hz(low + i * (high - low) / (A.MELS + 1)) for i in range(A.MELS + 2)]
    got, energy = A.log_mel(s)
    frames = max(1, -(-(total - A.FRAME) // A.HOP) + 1)
    assert got.shape == (frames, A.MELS)
    n = np.arange(A.FRAME)
    for f in range(frames):
        w = y[f * A.HOP : f * A.HOP + A.FRAME] * (0.5 - 0.5 * np.cos(2 * math.pi * n / A.FRAME))
        power = [abs(np.sum(w * np.exp(-2j * math.pi * k * n / A.FRAME))) ** 2 for k in range(A.FRAME // 2 + 1)]
        for m in range(A.MELS):
            a, b, c = edges[m : m + 3]
            e = 0.0
            for k, p in enumerate(power):
                x = k * rate / A.FRAME
                e += p * ((x - a) / (b - a) if a <= x <= b else (c - x) / (c - b) if b < x <= c else 0.0)
            assert abs(got[f, m] - math.log2(e + 1e-6)) < 1e-3
        assert abs(energy[f] - math.log2(np.mean(w * w) + 1e-9)) < 1e-6


def test_query_hashes_what_is_stored(spark):
    docs = spark.createDataFrame([(1, "hello world " * 400, 7), (2, None, 7), (3, "é" * 50, 7), (3, "é" * 50, 7)], "doc_id long, text string, media int")
    stored = {r.doc_id: r for r in A.with_audio(docs).collect()}
    for r in A.digests(docs).collect():
        t = stored[r.doc_id]
        spans, tensors = A.tensors_of(bytes(t.mel))
        seg, want_spans, want = A.analyse(np.frombuffer(A.from_wav(bytes(t.media))[0], np.uint8))
        assert (tensors == want).all() and tensors.shape == want.shape and (spans == want_spans).all()
        assert [(x.start_ms, x.end_ms) for x in t.segments] == [tuple(x) for x in seg.tolist()]
        sha = hashlib.sha256(want.tobytes() + want_spans.tobytes() + seg.tobytes()).hexdigest()
        assert r.feature == f"logmel-32x20:{len(seg)}:{len(spans)}:{sha}" and r.n_windows == len(spans)
        assert r.media_sha256 == hashlib.sha256(bytes(t.media)).hexdigest()
