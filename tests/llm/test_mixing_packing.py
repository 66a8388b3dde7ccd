import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from keyreel.llm.mixing import NO_ID, mix_report, mixed, stratum
from keyreel.llm.packing import boundaries, histogram, packed

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def wanted(sizes):
    """Targets by resharing until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target = {s: 0.0 for s in names}
    left, open_ = float(sum(sizes.values())), set(names)
    while open_ and left > 1e-9:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 3 * sizes[s]}
        if not over:
            for s in open_:
                target[s] = left * weight[s] / w
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix(spark):
    rng = random.Random(3)
    names = ["src%d" % i for i in range(9)] + [None, "é", "z"]
    rows = []
    for i in range(600):
        s = "src0" if i % 3 == 0 else rng.choice(names)
        rows.append((i, " ".join("w" for _ in range(rng.choice([0, 1, 3, 10, 50, 200 if s == "src0" else 5]))), s, i))
    rows += [(1000, None, "empty", 1), (1001, "  a\x0bb", "z", 1), (5, rows[5][1], rows[5][2], 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mix_report(docs).collect()
    sizes, taken, target = Counter(), Counter(), {}
    source = defaultdict(list)
    for i, t, s, _ in rows:
        source[i].append(s)
        sizes[s] += len(WORD.findall(t or ""))
    assert len(got) == len(rows)
    for r in got:
        s = source[r.doc_id][0]
        assert r.taken <= 3 * r.size and r.source_size == sizes[s]
        taken[s] += r.taken
        target[s] = r.target
    want = wanted(sizes)
    for s in want:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= 1
    places = [r.position for r in got if r.position is not None]
    assert places == sorted(places) and 0 <= places[0] and places[-1] <= 1
    assert [tuple(r) for r in mix_report(docs.repartition(5)).collect()] == [tuple(r) for r in got]
    out = mixed(docs).collect()
    words = Counter()
    for r in out:
        words[r.source] += len(WORD.findall(r.text))
    assert words == +taken


def test_rows_without_an_id_have_many_strata(spark):
    ids = spark.range(300_000).selectExpr("cast(id as string) as i").where("md5(cast(i as binary)) like 'd4%'").unionByName(spark.createDataFrame([("",)] * 6, "i string")).withColumn("size", F.expr("pmod(xxhash64(i), 9)").cast("long"))
    none = spark.range(300).selectExpr("'' as i", "id % 100 as size")
    rows = ids.unionByName(none).select(F.md5(F.col("i").cast("binary")).alias("h"), "size").withColumn("s", stratum(F.col("h"), F.col("size"))).collect()
    assert [r.s for r in sorted(rows, key=lambda r: (r.h, r.size))] == sorted(r.s for r in rows)
    most = Counter(r.s for r in rows)
    assert max(most[s] for s in most if s.startswith(NO_ID)) <= 9 and f"{NO_ID[:3]}~" in most
    docs = spark.createDataFrame([(None if i % 3 else i, "w " * (i % 7), "a" if i % 2 else None) for i in range(90)], "doc_id long, text string, source string")
    got = [tuple(r) for r in mix_report(docs).collect()]
    assert len(got) == 90 and sorted(map(str, got)) == sorted(str(tuple(r)) for r in mix_report(docs.repartition(7)).collect())
    out = packed(docs, buckets=3, budget=30).select("n_tokens", "bucket_len", "batch", "slot").collect()
    assert len(out) == len({r[1:] for r in out}) == 90


def test_mix_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_report(docs).count() == 0
    docs = spark.createDataFrame([(1, None, None), (2, "", "a")], docs.schema)
    assert sorted((r.doc_id, r.size, r.taken, r.target) for r in mix_report(docs).collect()) == [(1, 0, 0, 0.0), (2, 0, 0, 0.0)]
    assert mixed(docs).count() == 0


def test_boundaries_least_padding():
    rng = random.Random(9)
    for _ in range(120):
        n, k = rng.randint(1, 9), rng.randint(1, 4)
        lengths = rng.sample(range(1, 60), n)
        counts = [rng.randint(1, 9) for _ in lengths]

        def padding(ends):
            return sum(c * (min(e for e in ends if e >= l) - l) for l, c in zip(lengths, counts))

        least = min(padding(e) for m in range(1, k + 1) for e in itertools.combinations(sorted(lengths), min(m, n)) if max(e) == max(lengths))
        ends = boundaries(lengths, counts, k)
        assert len(ends) <= k and padding(ends) == least


def test_packed(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.choice([0, 1, 2, 30, 31, 300]))) for i in range(400)] + [(400, None), (401, ""), (401, "")]
    got = packed(spark.createDataFrame(rows, "doc_id long, text string"), buckets=4, budget=100).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    batches = defaultdict(list)
    for r in got:
        assert r.padding == r.bucket_len - r.n_tokens >= 0
        batches[r.bucket_len, r.batch].append(r.slot)
    last = {b: max(k for a, k in batches if a == b) for b, _ in batches}
    for (size, k), slots in batches.items():
        assert sorted(slots) == list(range(len(slots)))
        most = max(1, 100 // size)
        assert len(slots) == most or k == last[size] and len(slots) <= most
    assert packed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_distinct_length_counts(spark):
    lengths = spark.range(1, 21_001).selectExpr("id as n").unionByName(spark.createDataFrame([(20_000_000,), (3,)], "n long"))
    got, counts = histogram(lengths)
    assert got == [*range(1, 21_001), 20_000_000] and counts[2] == 2 and sum(counts) == 21_002
    # Two groups of equal lengths, one of them short, need no padding beside 20,000 others.
    counts = [10**9 if n in (7, 9) else 1 for n in got]
    ends = boundaries(got, counts, 16)
    assert {7, 9, 20_000_000} <= set(ends) and len(ends) == 16
