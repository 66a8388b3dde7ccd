import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from keyreel.llm import language, quality


def model_of(counts, order):
    langs = sorted({lang for lang, _ in counts})
    rows = [(langs.index(lang), k, g, n) for (lang, k), own in counts.items() for g, n in own.items()]
    return language.LanguageModel(langs, *(np.array(c) for c in zip(*rows)), order)


def test_language_code_lengths_by_hand():
    texts = {"x": ["abab ab", "ba"], "y": ["zzz", "zaz"]}
    order = 2
    counts = {}
    for lang, ts in texts.items():
        for k in range(order + 1):
            own = counts.setdefault((lang, k), {})
            for t in ts:
                b = t.encode()
                for i in range(len(b) - k):
                    g = int.from_bytes(b[i : i + k + 1], "big")
                    own[g] = own.get(g, 0) + 1
    m = model_of(counts, order)

    def prob(lang, ctx, s):
        """P(s | ctx): escapes go to the shorter context, in proportion over what was not seen."""
        k = len(ctx)
        seen = {g & 255: n for g, n in counts[lang, k].items() if g >> 8 == int.from_bytes(ctx, "big")}
        below = (lambda c: 1 / 256) if k == 0 else (lambda c: prob(lang, ctx[1:], c))
        if not seen:
            return below(s)
        total, kinds = sum(seen.values()), len(seen)
        if s in seen:
            return seen[s] / (total + kinds)
        return kinds / (total + kinds) * below(s) / sum(below(c) for c in range(256) if c not in seen)

    data = b"abz b!a"
    bits = m.code_lengths(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]
    contexts = {c for (_, k), own in counts.items() for c in [(k, g >> 8) for g in own]}
    for li, lang in enumerate(m.langs):
        want = 0.0
        for i, s in enumerate(data):
            k = max(k for k in range(min(order, i) + 1) if (k, int.from_bytes(data[i - k : i], "big")) in contexts)
            want -= math.log2(prob(lang, data[i - k : i], s))
        assert abs(want - bits[li]) < 1e-3


def test_key_places():
    rng = np.random.default_rng(5)
    for n in (0, 1, 10, 5000):
        keys = np.unique(rng.integers(0, 1 << 40, n, dtype=np.uint64)) if n != 10 else np.arange(10, dtype=np.uint64)
        find = language._Find(keys)
        assert (find(keys) == np.arange(len(keys))).all()
        other = np.setdiff1d(rng.integers(0, 1 << 40, 1000, dtype=np.uint64), keys)
        assert (find(other) == -1).all()


def test_all_languages_are_learned(spark):
    """More languages than any fixed number of them, one with a single row, and all counts of the rows."""
    rows = [(100 * k + i, f"{chr(97 + k % 26)}{chr(97 + k // 26)} " * 4 + "x", f"l{k:02d}") for k in range(50) for i in range(3 if k else 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language.fit(docs, sample=2)
    assert m.langs == [f"l{k:02d}" for k in range(50)]
    texts = [t for _, t, _ in rows]
    got = m.predict_arrow(pa.array(texts)).to_pylist()
    assert [g["lang_pred"] for g in got] == [lang for *_, lang in rows]
    counts = {}
    for lang, t in {(lang, t): 0 for _, t, lang in rows}:
        times = 1 if lang == "l00" else 2
        b = t.encode()
        for k in range(4):
            own = counts.setdefault((lang, k), {})
            for i in range(len(b) - k):
                g = int.from_bytes(b[i : i + k + 1], "big")
                own[g] = own.get(g, 0) + times
    want = model_of(counts, 3)
    data = np.frombuffer(" ".join(texts[:40]).encode(), np.uint8)
    at = np.array([0, 7, 100, len(data)])
    assert np.allclose(m.code_lengths(data, at), want.code_lengths(data, at))


def test_language_edges(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "12 ...", "en"), (5, "the dog", None), (5, "the dog", None), (6, "", "de")]
    m = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = m.predict_arrow(pa.array(["the dog and", "und die", None, "12 34", "", "x"])).to_pylist()
    assert [g["lang_pred"] for g in got[:5]] == ["en", "de", "und", "und", "und"] and got[5]["lang_pred"] in m.langs
    assert all(0 <= g["score"] <= 1 for g in got)
    empty = language.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert empty.predict_arrow(pa.array(["a", None])).to_pylist() == [{"lang_pred": "und", "score": 0.0}] * 2


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, ("good words here today " if i % 2 else "BAD!! SPAM!! ") * (i + 1), "x") for i in range(40)] + [(100, None, "x"), (101, "", "x"), (101, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (100, None), (101, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.scored(docs, labels).collect()}
    assert all(got[i].predicted == i % 2 for i in range(2, 40)) and all(0 <= r.score <= 1 for r in got.values())
    assert got[100].score == got[101].score
    none = quality.scored(docs, labels.limit(0)).collect()
    assert len(none) == 43 and all(r.score == 0.5 for r in none)
    assert quality.scored(docs.limit(0), labels).count() == 0


def plain_hash(word):
    """The hash of a word in whole numbers: a polynomial of random byte values, then the mixing steps."""
    from keyreel.llm.textbytes import BYTE_VALUES

    top = (1 << 64) - 1
    base = 0x9E3779B97F4A7C15 | 1
    value = lambda b: int(BYTE_VALUES[b + 32 if 65 <= b <= 90 else b])
    return plain_mix(sum(value(b) * pow(base, i, 1 << 64) for i, b in enumerate(word)) + len(word) & top)


def plain_mix(x):
    top = (1 << 64) - 1
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & top
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & top
    return x ^ x >> 33


def plain_features(text, bits):
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", text.encode()) if w]
    kind = lambda b: 1 if 48 <= b <= 57 else 2 if 65 <= b <= 90 else 3 if 97 <= b <= 122 or b >= 128 else 4 if b in b".,;:!?" else 5 if b in b"|#$%&*=<>~^_+/\\@" else 6
    out, shapes = [], []
    for i, w in enumerate(words):
        caps = sum(65 <= b <= 90 for b in w) >= 2
        same = i > 0 and words[i - 1].lower() == w.lower()
        last = 97 if kind(w[-1]) == 3 else w[-1]
        shapes.append(kind(w[0]) << 24 | last << 16 | kind(w[-2] if len(w) > 1 else w[0]) << 8 | caps << 1 | same)
    top = (1 << 64) - 1
    for i, w in enumerate(words):
        out.append(plain_mix(plain_hash(w) ^ 0x11))
        out.append(plain_mix(shapes[i] ^ 0x77 << 48))
        if i:
            out.append(plain_mix(plain_hash(words[i - 1]) * 0x9E3779B97F4A7C15 + plain_hash(w) & top))
            out.append(plain_mix((shapes[i - 1] << 32) ^ shapes[i] ^ 0x3355 << 40))
    return sorted(x >> 64 - bits for x in out), len(words)


def test_quality_features_and_updates_against_plain_versions():
    texts = ["One two THREE!! three!! \u00e9t\u00e9", "buy NOW now $$$ 100% #1", "a", "word, word; other. Words\n\nof 12 lines"]
    for t in texts:
        b = np.frombuffer(t.encode(), np.uint8)
        idx, _, n = quality.features(b, np.array([0, len(b)]), 12)
        assert (sorted(idx.tolist()), int(n[0])) == plain_features(t, 12)
    # Follow the regularised leader, coordinate by coordinate.
    alpha, beta, l1, l2, epochs, bits = 4.0, 1.0, 1e-5, 1e-5, 3, 12
    examples = []
    for t, y in zip(texts * 3, [1, 0, 1, 1, 0, 0, 1, 1, 1, 0, 0, 1]):
        f, n = plain_features(t, bits)
        examples.append(({i: f.count(i) / n for i in set(f)}, y))
    z, g2, w, zb, gb, bias = {}, {}, {}, 0.0, 0.0, 0.0
    for _ in range(epochs):
        for x, y in examples:
            p = 1 / (1 + math.exp(-(bias + sum(w.get(i, 0.0) * v for i, v in x.items()))))
            for i, v in x.items():
                g = (p - y) * v
                old = g2.get(i, 0.0)
                g2[i] = old + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(g2[i]) - math.sqrt(old)) / alpha * w.get(i, 0.0)
                w[i] = 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta * 0.01 + math.sqrt(g2[i])) / alpha + l2)
            old, gb = gb, gb + (p - y) ** 2
            zb += (p - y) - (math.sqrt(gb) - math.sqrt(old)) / 0.1 * bias
            bias = -zb / ((beta + math.sqrt(gb)) / 0.1)
    got, got_bias = quality.ftrl([(np.array(sorted(x)), np.array([x[i] for i in sorted(x)]), y) for x, y in examples], bits, epochs, alpha, beta, l1, l2)
    assert abs(got_bias - bias) < 1e-9
    assert np.allclose(got, [w.get(i, 0.0) for i in range(1 << bits)], atol=1e-5)


def test_quality_learns_one_text_of_an_id(spark):
    docs = [(i, f"good calm words {i}" if i % 2 else f"BAD!! spam!! {i}") for i in range(30)] + [(3, f"another text {i}") for i in range(50)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] * 2, "doc_id long, quality int")
    a, b = (quality.fit(spark.createDataFrame(docs, "doc_id long, text string").repartition(n), labels) for n in (1, 5))
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_quality_scores_by_hand():
    rng = np.random.default_rng(1)
    m = quality.QualityModel(rng.normal(size=1 << 10).astype(np.float32), 0.3, 10)
    texts = ["one Two THREE!! three!! é", "", "a", "x " * 5000, "  b\tc\n"]
    got = m.score_arrow(pa.array(texts)).to_pylist()
    for t, s in zip(texts, got):
        b = np.frombuffer(t.encode(), np.uint8)
        idx, _, n = quality.features(b, np.array([0, len(b)]), 10)
        k, c = np.unique(idx, return_counts=True)
        assert abs(1 / (1 + math.exp(-(0.3 + (m.weights[k].astype(float) @ c) / max(1, n[0])))) - s) < 1e-9


def test_language_sample_over_tasks(spark):
    """One language in many tasks: the rows of the least hashes are learned, however tasks are drawn together."""
    docs = spark.range(0, 2000, 1, 40).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id").cast("string")).alias("text"), F.lit("x").alias("lang"))
    least = [r.doc_id for r in docs.orderBy(F.xxhash64("doc_id")).limit(150).collect()]
    got, want = language.fit(docs, sample=150), language.fit(docs.where(F.col("doc_id").isin(least)), sample=150)
    probe = docs.where("doc_id < 50")
    score = lambda m: [r[0] for r in probe.select(m.predict(F.col("text"))["score"]).collect()]
    assert score(got) == score(want) and all(np.array_equal(a, b) for a, b in zip(got.cost, want.cost))
