import random
import re

from pyspark.sql import functions as F

from keyreel.llm.ngram_join import near_duplicates


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if len(words) >= 5 else frozenset([tuple(words)])


def brute(rows):
    sets = [(i, sets_of(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    real = [(i, s) for i, s in sets if s and i is not None]
    where = {}
    for k, (_, s) in enumerate(real):
        for x in s:
            where.setdefault(x, []).append(k)
    seen = set()
    for k, (i, s) in enumerate(real):
        for j in {m for x in s for m in where[x] if m > k}:
            o, t = real[j]
            n = len(s & t)
            if 100 * n >= 75 * (len(s) + len(t) - n):
                a, b = find(i), find(o)
                root[max(a, b)] = min(a, b)
                seen.add((i, o))
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str), seen


def noisy(rng, n_docs):
    vocabulary = ["w%d" % i for i in range(40)] + ["Q%d" % i for i in range(2000)]
    line = " ".join(rng.choices(vocabulary, k=12))
    rows, base = [], []
    for i in range(n_docs):
        if base and rng.random() < 0.55:
            words = list(rng.choice(base))
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                if words:
                    at = rng.randrange(len(words))
                    words[at : at + rng.choice([0, 1])] = [rng.choice(vocabulary)] * rng.choice([0, 1])
        else:
            words = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 35, 60, 90, 150]))
            base.append(words)
        if rng.random() < 0.3:
            words = line.split() + words
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    return rows


def result(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs, **options).collect()), key=str)


def test_same_as_all_pairs(spark):
    rows = noisy(random.Random(5), 500)
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "one two"), (None, "one"), (1006, "a b c d e"), (1007, "A b\tc d e"), (1008, "x " * 30000), (1009, "x " * 20000)]
    want, links = brute(rows)
    assert len(links) > 100
    assert result(spark, rows, n_buckets=5) == want
    assert result(spark, rows, n_buckets=2) == want


def test_tiles_of_open_blocs(spark, monkeypatch):
    from keyreel.llm import ngram_join

    plain = ngram_join._open_pairs
    monkeypatch.setattr(ngram_join, "_open_pairs", lambda *a: plain(*a, tile=3))
    rng = random.Random(11)
    base = rng.choices(["w%d" % i for i in range(300)], k=120)
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 6])):
            words[rng.randrange(len(words))] = "x%d" % rng.randrange(10**6)
        rows.append((i, " ".join(words)))
    want, _ = brute(rows)
    assert 1 < len({c for _, _, c in want}) < 120
    assert result(spark, rows) == want


def test_repeated_rows_and_other_columns(spark):
    rows = [(1, "a b c d e f", 0, "s"), (1, "a b c d e f", 0, "s"), (2, "a b c d e f", 7, None), (3, "", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int, sig string")
    got = sorted(tuple(r) for r in near_duplicates(docs).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(docs).count() == 0


def test_test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where(F.length("text") < 6000)
    rows = [tuple(r) for r in docs.collect()]
    want, _ = brute(rows)
    assert result(spark, rows) == want


def test_one_id_with_two_texts_joins_their_classes(spark):
    a, b = "one two three four five six seven eight", "red green blue black white grey pink cyan"
    rows = [(2, a), (5, a), (5, b), (9, b), (7, None), (None, a), (11, "x")]
    got = {(r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(2, 2), (5, 2), (9, 2), (7, 7), (None, None), (11, 11)}


def test_reducer_in_chunks_loses_no_signature(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from keyreel.llm import ngram_join as m

    rng = np.random.default_rng(4)
    entries = [(int(s), int(c)) for s, c in zip(rng.integers(0, 400, 3000), rng.integers(0, 60, 3000))]
    entries += [(1000, c) for c in range(60)]
    blobs = []
    for i in range(0, len(entries), 170):
        part = sorted(entries[i : i + 170])
        names = sorted({c for _, c in part})
        key = np.array([[c + 1, -c] for c in names], np.int64)
        own = np.array([names.index(c) for _, c in part], "<u2")
        blobs.append(np.array([len(part), len(names)], "<i8").tobytes() + key.tobytes() + own.tobytes() + m._planes(np.array([s for s, _ in part], np.uint64)))
    batch = pa.RecordBatch.from_arrays([pa.array([3] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])
    by = {}
    for s, c in entries:
        by.setdefault(s, set()).add(c)
    want = {(s, c + 1, -c) for s, cs in by.items() if len(cs) > 1 for c in cs}
    for chunk in (300, 10**6):
        monkeypatch.setattr(m, "CHUNK", chunk)
        out = pa.Table.from_batches(list(m._shared(iter([batch]))))
        assert {tuple(r.values()) for r in out.to_pylist()} == want


def test_pairs_of_a_large_group_come_through(spark, monkeypatch):
    from keyreel.llm import ngram_join as m

    monkeypatch.setattr(m, "MEMBERS", 3)
    base = ["w%d" % i for i in range(60)]
    rows = [(i, " ".join(base[:-1] + ["end%d" % i])) for i in range(40)] + [(100 + i, " ".join("%s-%d" % (w, i) for w in base)) for i in range(5)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 for i in range(40)} | {100 + i: 100 + i for i in range(5)}


def test_reducer_holds_few_bytes_a_signature():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from keyreel.llm import ngram_join as m

    rng = np.random.default_rng(5)
    blobs = []
    for _ in range(40):
        s, names = np.sort(rng.integers(0, 1 << 48, 10_000).astype(np.uint64)), rng.integers(1, 1 << 60, (1000, 2))
        blobs.append(np.array([len(s), 1000], "<i8").tobytes() + names.tobytes() + rng.integers(0, 1000, len(s)).astype("<u2").tobytes() + m._planes(s))
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 40, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])
    tracemalloc.start()
    try:
        for _ in m._shared(iter([batch])):
            pass
        assert tracemalloc.get_traced_memory()[1] < 60 * 40 * 10_000
    finally:
        tracemalloc.stop()


def test_pairs_that_pass_are_few_files(spark):
    from keyreel.llm import ngram_join as m

    pairs = spark.range(1, 400).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    texts = spark.range(0, 400).select(F.col("id").alias("node"), F.lit("one two three four five six").alias("text"))
    good = m._met(pairs, texts, 399, m._verify(75, 100))
    t = m.cut_table(good)
    try:
        assert t.count() == 399 and len(t.inputFiles()) == 1
    finally:
        m.drop(t)
