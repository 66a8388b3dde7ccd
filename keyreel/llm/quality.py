"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader.

Features of a text: lower-cased words, word pairs, and pairs of word shapes (what a word
begins and ends with, whether it is in capitals or repeats the word before it), hashed into
2**bits weights. A feature's value is its count over the number of words, so a score is the
mean of a text's weights: a sparse dot product, taken over the whole text in pieces.

fit() learns from at most `sample` labelled rows, those of the smallest hashed ids; that is
the documented bound of its input, and of what reaches the driver (sparse vectors of the
sampled rows, at most 2**bits entries each). Of an id with several texts the one with the least
vector is learned from. Nothing else is bounded.

Null or empty texts, and texts of separators only, get the score of the bias alone. Rows
without a label, or with a null one, are scored but not learned from; without any
labelled row every score is 0.5. Repeated rows get equal scores. Only the id, the text and
the labels are read, whatever other columns there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyreel.llm.common import crc_mod
from keyreel.llm.textbytes import LOWER_VALUES, buffers, doc_words, mix, pieces

PIECE = 1 << 20
_CLASS = np.full(256, 6, np.uint8)  # other bytes
_CLASS[48:58] = 1
_CLASS[65:91] = 2
_CLASS[97:123] = 3
_CLASS[128:] = 3  # letters of other alphabets, as bytes
for _i, _c in enumerate(b".,;:!?"):
    _CLASS[_c] = 4
for _i, _c in enumerate(b"|#$%&*=<>~^_+/\\@"):
    _CLASS[_c] = 5
_UPPER = np.zeros(256, np.int32)
_UPPER[65:91] = 1


def features(buf: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight indices and rows of all features, and the number of words by row."""
    words, start, end, rows = doc_words(buf, offsets, LOWER_VALUES)
    n = len(offsets) - 1
    count = np.bincount(rows, minlength=n)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), count
    lo, hi = int(offsets[0]), int(offsets[-1])
    upper = np.concatenate([[0], np.cumsum(_UPPER[buf[lo:hi]])])
    caps = (upper[end - lo] - upper[start - lo] >= 2).astype(np.uint64)
    same = np.zeros(len(words), np.uint64)
    same[1:] = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
    last, before = buf[end - 1], buf[np.maximum(end - 2, start)]
    shape = (_CLASS[buf[start]].astype(np.uint64) << np.uint64(24)) | (np.where(_CLASS[last] == 3, 97, last).astype(np.uint64) << np.uint64(16))
    shape |= (_CLASS[before].astype(np.uint64) << np.uint64(8)) | (caps << np.uint64(1)) | same
    follows = np.flatnonzero(rows[1:] == rows[:-1])
    keys = [mix(words ^ np.uint64(0x11)), mix(words[follows] * np.uint64(0x9E3779B97F4A7C15) + words[follows + 1]), mix((shape[follows] << np.uint64(32)) ^ shape[follows + 1] ^ np.uint64(0x3355 << 40)), mix(shape ^ np.uint64(0x77 << 48))]
    own = [rows, rows[follows], rows[follows], rows]
    return (np.concatenate(keys) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(own), count


def _vectors(bits: int):
    def run(batches):
        for batch in batches:
            buf, off = buffers(batch.column(2))
            idx, val = [], []
            for i in range(len(batch)):
                k, _, count = features(buf, off[i : i + 2], bits)
                k, c = np.unique(k, return_counts=True)
                idx.append(k.astype(np.int32))
                val.append((c / max(1, count[0])).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x.tobytes() for x in idx], pa.binary()), pa.array([x.tobytes() for x in val], pa.binary())], ["doc_id", "label", "idx", "val"]
            )

    return run


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], bits: int, epochs: int = 4, alpha: float = 4.0, beta: float = 1.0, l1: float = 1e-5, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias after `epochs` passes of FTRL-proximal over (indices, values, label)."""
    z, g2, w = np.zeros(1 << bits), np.zeros(1 << bits), np.zeros(1 << bits, np.float64)
    zb = gb = bias = 0.0
    for _ in range(epochs):
        for idx, val, y in examples:
            p = 1 / (1 + np.exp(-np.clip(bias + w[idx] @ val, -35, 35)))
            g = (p - y) * val
            now = g2[idx] + g * g
            z[idx] += g - (np.sqrt(now) - np.sqrt(g2[idx])) / alpha * w[idx]
            g2[idx] = now
            zi = z[idx]
            w[idx] = np.where(np.abs(zi) <= l1, 0, -(zi - np.sign(zi) * l1) / ((beta * 0.01 + np.sqrt(now)) / alpha + l2))
            now = gb + (p - y) ** 2
            zb += (p - y) - (np.sqrt(now) - np.sqrt(gb)) / 0.1 * bias
            gb = now
            bias = -zb / ((beta + np.sqrt(now)) / 0.1)
    return w.astype(np.float32), float(bias)


class QualityModel:
    def __init__(self, weights: np.ndarray, bias: float, bits: int):
        self.weights, self.bias, self.bits = weights, bias, bits

    def score_arrow(self, column: pa.Array) -> pa.Array:
        buf, off = buffers(column)
        out = np.empty(len(off) - 1)
        for i, j in pieces(off, PIECE):
            idx, rows, count = features(buf, off[i : j + 1], self.bits)
            total = np.bincount(rows, weights=self.weights[idx], minlength=j - i)
            out[i:j] = self.bias + total / np.maximum(count, 1)
        return pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    def score(self, text: Column) -> Column:
        """The score of a text column, 0 to 1."""
        model = self

        @F.arrow_udf("double")
        def quality(column: pa.Array) -> pa.Array:
            return model.score_arrow(column)

        return quality(text.cast("string"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bits: int = 18, sample: int = 3000, epochs: int = 4) -> QualityModel:
    """A model of `label` (1 or 0) from at most `sample` rows of labels and their documents."""
    given = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    given = given.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(given), "doc_id").select("doc_id", "label", "text")  # at most `sample` rows
    vectors = rows.mapInArrow(_vectors(bits), "doc_id long, label int, idx binary, val binary")
    first = F.row_number().over(Window.partitionBy("doc_id", "label").orderBy("idx", "val"))
    got = vectors.withColumn("r", first).where("r = 1").drop("r").toArrow().to_pylist()
    got.sort(key=lambda r: (int(mix(np.array([r["doc_id"]], np.int64).view(np.uint64))[0]), r["label"], r["idx"]))
    examples = [(np.frombuffer(r["idx"], np.int32), np.frombuffer(r["val"], np.float32).astype(np.float64), r["label"]) for r in got]
    return QualityModel(*ftrl(examples, bits, epochs), bits)


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(crc_mod(F.col("doc_id"), 5) != 0)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, learned from labels not held out."""
    model = fit(docs, training_labels(labels))
    out = docs.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), model.score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
