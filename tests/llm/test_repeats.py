import hashlib
import random

from keyreel.llm import repeats as R


def brute(rows):
    L = R.LENGTH
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - L + 1):
            seen[t[p : p + L]] = seen.get(t[p : p + L], 0) + 1
    out = []
    for (i, _), t in zip(rows, texts):
        gone = bytearray(len(t))
        for p in range(len(t) - L + 1):
            if seen[t[p : p + L]] > 1:
                gone[p : p + L] = b"\1" * L
        runs = sum(1 for p in range(len(t)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in R.removed(df, **options).collect()), key=str)
    assert got == brute(rows)
    return got


def corpus(rng, n):
    words = ["".join(rng.choice("abcdefghijklmnopé") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [text(rng.randint(25, 80)) for _ in range(5)]
    rows, made = [], []
    for i in range(n):
        r = rng.random()
        if made and r < 0.15:
            t = rng.choice(made)
        elif made and r < 0.4:
            w = rng.choice(made).split(" ")
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            t = " ".join(w)
        else:
            t = text(rng.choice([1, 10, 30, 60, 200]))
        if rng.random() < 0.4:
            t += " " + rng.choice(passages) + " " + text(rng.randint(0, 30))
        made.append(t)
        rows.append((i, t))
    return rows


def test_against_brute_force(spark):
    rows = corpus(random.Random(6), 150)
    rows += [(900, None), (901, ""), (902, "Und " * 400), (903, "x" * 199), (904, "y" * 200), (905, "y" * 201), (906, "ab" * 100), (907, ("q" * 150 + "z") * 6), (None, rows[3][1]), rows[4], (908, "é" * 99), (909, "é" * 100 + "a")]
    got = check(spark, rows)
    assert sum(r[2] for r in got) > 10_000
    check(spark, rows, hot=2)


def test_periods_and_long_texts(spark, monkeypatch):
    rng = random.Random(8)
    unit = ["".join(rng.choice("abcd ") for _ in range(k)) for k in (1, 3, 50, 64, 100, 136, 137, 150, 199, 200, 210)]
    rows = [(i, u * (900 // len(u) + 1)) for i, u in enumerate(unit)]
    rows += [(50 + i, u + u[: 210 - len(u) if len(u) < 210 else 0] + "!" * i) for i, u in enumerate(unit)]
    check(spark, rows)


def test_period_of_a_span_in_one_text_only(spark):
    rng = random.Random(17)
    line = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k - 1)) + "\n"
    rows = [(k, line(k) * 5) for k in range(R.SPAN - 3, R.SPAN + 4)] + [(1000, line(R.SPAN) * 3), (1001, line(R.SPAN) + line(300))]
    got = {r[0]: r[2] for r in check(spark, rows)}
    assert got[R.SPAN] == 5 * R.SPAN and got[1000] == 3 * R.SPAN and got[1001] == 0


def test_parts_of_long_rows():
    import numpy as np

    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 5000, dtype=np.uint8)
    whole = R._token_runs(data, np.array([0, 5000]))
    old, R.PIECE = R.PIECE, 700
    try:
        found = np.zeros(5000 - R.LENGTH + 1, np.uint64)
        for _, before, cut in R._cuts(np.array([0, 5000])):
            h, row, start, n, _, place = R._token_runs(data, cut)
            assert all((R.mix(R.prefix_hash(data[a + p : a + p + R.GRAM], R.BYTE_VALUES)[-1:]) == x).all() for a, p, x in zip(start.tolist(), place.tolist(), h.astype(np.uint64)))
            for a, m, x in zip(start.tolist(), n.tolist(), h.tolist()):
                found[a : a + m] = x
    finally:
        R.PIECE = old
    want = np.zeros_like(found)
    for a, m, x in zip(whole[2].tolist(), whole[3].tolist(), whole[0].tolist()):
        want[a : a + m] = x
    assert (found == want).all() and (want != 0).all()


def test_kept_and_empty(spark):
    df = spark.createDataFrame([(1, "a" * 250 + "end", "x"), (2, "short", "y")], "doc_id long, text string, n_bytes string")
    got = {r.doc_id: r for r in R.kept_bytes(df).collect()}
    assert bytes(got[1].kept) == b"end" and bytes(got[2].kept) == b"short"
    assert R.removed(df.limit(0)).count() == 0


def test_tokens_across_bucket_boundaries(spark):
    """One passage in many texts, with as many buckets as it has copies: its suffixes lie in several of them."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(30)) + passage[i % 5 :] + " ".join(word() for _ in range(30 + i))) for i in range(60)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        check(spark, rows)
        check(spark, rows, hot=10)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_buckets_in_chunks(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = []
    for i in range(4000):
        h = rng.integers(0, 900, 2).astype(np.uint64) // np.uint64(30)
        rows.append((h.tobytes(), i))
    rows.sort()
    t = pa.table({"key": [i for _, i in rows], "at": [0] * 4000, "n": [-1] * 4000, "place": [0] * 4000, "many": [False] * 4000, "data": pa.array([h for h, _ in rows], pa.binary())})
    t = t.cast(pa.schema([("key", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("place", pa.int32()), ("many", pa.bool_()), ("data", pa.binary())]))
    count = {}
    for h, _ in rows:
        count[h] = count.get(h, 0) + 1
    want = {i for h, i in rows if count[h] > 1}
    for size in (7, 1000, 4000):
        out = pa.Table.from_batches(list(R._bucket(True)(iter(t.to_batches(max_chunksize=size)))))
        assert set(out.column("key").to_pylist()) == want


def test_names_that_two_texts_share_are_replaced(spark, monkeypatch):
    """With one name for all texts, they are told apart by the other half of the hash."""
    from pyspark.sql import functions as F

    real = F.xxhash64
    monkeypatch.setattr(R.F, "xxhash64", lambda *c: F.lit(5).cast("long") if isinstance(c[0], str) and c[0] == "text" else real(*c))
    rows = [(i, chr(97 + i % 7) * 5 + "x" * (200 + i % 7)) for i in range(20)] + [(50, "".join(chr(97 + i * i % 26) for i in range(900)))]
    check(spark, rows)
