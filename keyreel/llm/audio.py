"""Media columns: audio features.

A payload is stored as a WAV file of 8-bit mono samples at `RATE`; its bytes are the samples,
so storage is lossless. From the samples that are read back: polyphase resampling by
UP / DOWN with a windowed-sinc filter, log-mel energies of overlapping Hann frames, and
hysteresis segmentation: a segment begins where the frame energy reaches the upper of two
levels of the file's own energies and ends where it falls below the lower. The mel frames
of every segment are cut to windows of a fixed shape, a fixed-shape Arrow tensor column with
the windows' time spans; the last window of a segment is padded with its least value.

A null or empty payload is one block of 64 zero bytes. A silent file has no segment and no
tensor. Files with a broken header raise an error. Long files are read in blocks, so memory
grows with the energies and features, not with the frames. Equal bytes give equal results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyreel.llm.textbytes import buffers

RATE = 16_000
UP, DOWN, TAPS = 5, 8, 16  # to 10 kHz, TAPS taps in a phase
FRAME, HOP, MELS = 256, 128, 20
SHAPE = (32, MELS)
BLOCK = 2048  # frames
SCALE = 8.0  # steps of a log2 energy in the stored tensors


def pad(data: bytes) -> bytes:
    return data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n) + payload + b"\0" * (n % 2)


def from_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of an 8-bit mono WAV file; other chunks are skipped."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(media):
        name, n = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono samples")
        elif name == b"data":
            if rate is None or at + 8 + n > len(media):
                break
            return media[at + 8 : at + 8 + n], rate
        at += 8 + n + n % 2
    raise ValueError("broken WAV file")


def _phases() -> np.ndarray:
    """The filter's taps for each phase, newest sample first; each phase passes a constant as it is."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    cut = 0.9 / max(UP, DOWN)
    h = (cut * np.sinc(cut * t) * np.hamming(n)).reshape(TAPS, UP).T
    return h / h.sum(axis=1, keepdims=True)


def _mel_weights() -> np.ndarray:
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(50.0), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FRAME // 2 + 1) * rate / FRAME
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down))


PHASES, MEL_WEIGHTS, HANN = _phases(), _mel_weights(), np.hanning(FRAME + 1)[:-1]


def resample(samples: np.ndarray, first: int, count: int) -> np.ndarray:
    """Outputs first .. first + count - 1 of the resampled 8-bit samples; silence lies beyond their ends."""
    m = np.arange(first, first + count)
    newest = m * DOWN // UP
    lo, hi = int(newest[0]) - TAPS + 1, int(newest[-1]) + 1
    x = np.zeros(hi - lo)
    a, b = max(lo, 0), min(hi, len(samples))
    if b > a:
        x[a - lo : b - lo] = (samples[a:b].astype(np.float64) - 128.0) / 128.0
    windows = np.lib.stride_tricks.sliding_window_view(x, TAPS)[:, ::-1]
    out = np.empty(count)
    for r in range(UP):
        at = np.flatnonzero(m % UP == r)
        if len(at):
            out[at] = windows[newest[at] - lo - TAPS + 1] @ PHASES[(r * DOWN) % UP]
    return out


def log_mel(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log2 mel energies and log2 energy of each frame of the resampled samples."""
    total = -(-len(samples) * UP // DOWN)
    frames = max(1, -(-(total - FRAME) // HOP) + 1)
    mels, energy = np.empty((frames, MELS), np.float32), np.empty(frames)
    for f in range(0, frames, BLOCK):
        n = min(BLOCK, frames - f)
        y = resample(samples, f * HOP, (n - 1) * HOP + FRAME)
        w = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP] * HANN
        power = np.abs(np.fft.rfft(w, axis=1)) ** 2
        mels[f : f + n] = np.log2(power @ MEL_WEIGHTS + 1e-6)
        energy[f : f + n] = np.log2((w * w).mean(axis=1) + 1e-9)
    return mels, energy


def segments(energy: np.ndarray, silence: float = -20.0) -> np.ndarray:
    """Frames [begin, end) between rising to the upper and falling below the lower level."""
    energy = np.round(energy, 6)
    loud = energy[energy > silence]
    if not len(loud):
        return np.zeros((0, 2), np.int64)
    upper, lower = np.quantile(loud, (0.4, 0.1), method="lower")
    mark = np.where((energy >= upper) & (energy > silence), 1, np.where(energy < lower, -1, 0))
    mark[energy <= silence] = -1
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = (last >= 0) & (mark[np.maximum(last, 0)] > 0)
    edge = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1)


def analyse(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments in ms (n, 2), the windows' spans in ms (w, 2) and tensors (w, *SHAPE), int16 in 1 / SCALE of log2."""
    mels, energy = log_mel(samples)
    seg = segments(energy)
    if not len(seg):
        return np.zeros((0, 2), np.int64), np.zeros((0, 2), np.int64), np.zeros((0, *SHAPE), np.int16)
    quant = np.round(mels * SCALE).astype(np.int16)
    starts, ends = [], []
    for a, b in seg.tolist():
        w = np.arange(a, b, SHAPE[0])
        starts.append(w)
        ends.append(np.minimum(w + SHAPE[0], b))
    a, b = np.concatenate(starts), np.concatenate(ends)
    at = a[:, None] + np.arange(SHAPE[0])
    tensors = quant[np.minimum(at, len(quant) - 1)]
    beyond = at >= b[:, None]
    if beyond.any():
        least = np.where(beyond[:, :, None], np.iinfo(np.int16).max, tensors).min(axis=(1, 2))
        tensors = np.where(beyond[:, :, None], least[:, None, None], tensors).astype(np.int16)
    ms = lambda f: f * HOP * 1000 * DOWN // (RATE * UP)
    return ms(seg), np.stack([ms(a), ms(b)], 1), tensors


def tensor_table(spans: np.ndarray, tensors: np.ndarray) -> pa.Table:
    """start_ms, end_ms and a fixed-shape tensor column."""
    flat = pa.FixedSizeListArray.from_arrays(pa.array(tensors.reshape(-1), pa.int16()), int(np.prod(SHAPE)))
    kind = pa.fixed_shape_tensor(pa.int16(), SHAPE, dim_names=["frame", "mel"])
    return pa.table({"start_ms": pa.array(spans[:, 0], pa.int64()), "end_ms": pa.array(spans[:, 1], pa.int64()), "mel": pa.ExtensionArray.from_storage(kind, flat)})


def tensor_bytes(spans: np.ndarray, tensors: np.ndarray) -> bytes:
    """tensor_table() as an Arrow IPC stream; pa.ipc.open_stream() reads it again."""
    t = tensor_table(spans, tensors)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def with_audio(df: DataFrame, payload: str = "text") -> DataFrame:
    """df with media (WAV bytes), segments array<struct<start_ms, end_ms>> and mel (an Arrow IPC
    stream of the fixed-shape tensors with their spans)."""

    @F.arrow_udf("media binary, segments array<struct<start_ms:long,end_ms:long>>, mel binary")
    def audio(column: pa.Array) -> pa.Array:
        buf, off = buffers(column)
        out = []
        for i in range(len(off) - 1):
            media = to_wav(pad(buf[off[i] : off[i + 1]].tobytes()))
            seg, spans, tensors = analyse(np.frombuffer(from_wav(media)[0], np.uint8))
            out.append({"media": media, "segments": [{"start_ms": a, "end_ms": b} for a, b in seg.tolist()], "mel": tensor_bytes(spans, tensors)})
        kind = pa.struct([("media", pa.binary()), ("segments", pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))), ("mel", pa.binary())])
        return pa.array(out, kind)

    a = audio(F.col(payload).cast("string"))
    return df.withColumn("__a", a).select(*[F.col(f"`{c}`") for c in df.columns if c not in ("media", "segments", "mel")], "__a.media", "__a.segments", "__a.mel")


def tensors_of(mel: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Spans (n, 2) and tensors (n, *SHAPE) of a stream of tensor_bytes()."""
    t = pa.ipc.open_stream(mel).read_all().combine_chunks()
    spans = np.stack([t.column("start_ms").to_numpy(), t.column("end_ms").to_numpy()], 1)
    column = t.column("mel")
    if not len(column):
        return spans, np.zeros((0, *SHAPE), np.int16)
    return spans, column.chunk(0).to_numpy_ndarray()


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and, of the media and tensors that with_audio() stores: sizes, digests and a digest of the features."""
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_segments", "n_windows")
    kinds = ("long", "long", "string", "long", "long", "string", "string", "long", "long")

    @F.arrow_udf(", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    def digest(size: pa.Array, media: pa.Array, segments: pa.Array, mel: pa.Array) -> pa.Array:
        cols: list[list] = [[] for _ in names]
        at = segments.offsets.to_numpy()
        flat = np.stack([segments.values.field(i).to_numpy() for i in (0, 1)], 1) if len(segments.values) else np.zeros((0, 2), np.int64)
        for i, n in enumerate(size.to_pylist()):
            stored = media[i].as_py()
            payload, _ = from_wav(stored)
            spans, tensors = tensors_of(mel[i].as_py())
            seg = np.ascontiguousarray(flat[at[i] : at[i + 1]])
            sha = hashlib.sha256(np.ascontiguousarray(tensors).tobytes() + np.ascontiguousarray(spans).tobytes() + seg.tobytes()).hexdigest()
            row = (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(),
                   f"logmel-{SHAPE[0]}x{SHAPE[1]}:{len(seg)}:{len(spans)}:{sha}", len(seg), len(spans))
            for c, v in zip(cols, row):
                c.append(v)
        types = {"long": pa.int64(), "string": pa.string()}
        return pa.StructArray.from_arrays([pa.array(c, types[k]) for c, k in zip(cols, kinds)], list(names))

    stored = with_audio(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return stored.select("doc_id", digest(size, "media", "segments", "mel").alias("m")).select("doc_id", "m.*")
