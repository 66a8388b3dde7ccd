import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyreel.functions import pixels as P


def slow_luma(img, x, y):
    r, g, b = (float(v) for v in img[y, x, :3])
    return np.float32((0.2126 * r + 0.7152 * g + 0.0722 * b) / 255)


def slow_grid(img, cols, rows):
    h, w = img.shape[:2]
    return [[slow_luma(img, int((i + 0.5) * w / cols), int((j + 0.5) * h / rows)) for i in range(cols)] for j in range(rows)]


@pytest.fixture(scope="module")
def img():
    return np.random.default_rng(4).integers(0, 256, (40, 70, 3), dtype=np.uint8)


def test_luma_and_hash(img):
    assert P.luma_grid(img, 32, 18).tolist() == [[float(v) for v in row] for row in slow_grid(img, 32, 18)]
    h, v = slow_grid(img, 9, 8), slow_grid(img, 8, 9)
    words = [0, 0, 0, 0]
    bits = [h[y][x] > h[y][x + 1] for y in range(8) for x in range(8)] + [v[y][x] > v[y + 1][x] for y in range(8) for x in range(8)]
    for i, b in enumerate(bits):
        words[i // 32] |= int(b) << (i % 32)
    assert P.difference_hash(img) == words


def test_blur_and_exposure(img):
    l = np.array(slow_grid(img, 64, 36), float)
    lap = [l[y - 1][x] + l[y + 1][x] + l[y][x - 1] + l[y][x + 1] - 4 * l[y][x] for y in range(1, 35) for x in range(1, 63)]
    v = max(0, sum(a * a for a in lap) / len(lap) - (sum(lap) / len(lap)) ** 2)
    assert P.blur(img)[0] == pytest.approx(v)
    assert P.blur(img)[1] == pytest.approx(min(1, math.log1p(2000 * v) / math.log(81)))
    flat = np.full((16, 16, 3), 128, np.uint8)
    assert P.blur(flat) == (0.0, 0.0)
    mean, clipped, score = P.exposure(np.zeros((16, 16, 3), np.uint8))
    assert (mean, clipped, score) == (0.0, 1.0, 0.0)


def test_short_buffer():
    with pytest.raises(ValueError):
        P.image(b"123", 2, 2, 3)
    assert P.channels_of(12, 2, 2) == 3 and P.channels_of(16, 2, 2) == 4


def test_column_functions(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [0, 2, 3, 12], [0.0, 0.0, 0.0], [1.0, 1.0, 1.0])], "a array<bigint>, b array<bigint>, x array<double>, y array<double>")
    r = df.select(P.hamming(F.col("a"), F.col("b")).alias("h"), P.color_distance(F.col("x"), F.col("y")).alias("c")).first()
    assert r.h == 2 and r.c == pytest.approx(1.0)
    luma = df.select(P.frame_difference(F.col("x"), F.col("y"), F.col("x"), F.col("y")).alias("d")).first()
    assert luma.d == pytest.approx(1.0)
