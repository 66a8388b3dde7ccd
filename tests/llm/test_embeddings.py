import math
import random

import numpy as np

from keyreel.llm.embeddings import near_duplicates


def brute(rows, least=0.98):
    ok = [(i, np.array(v, float), l) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, root = {i: set() for i, *_ in rows}, {i: i for i, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, x, l) in enumerate(ok):
        for j, y, m in ok[k + 1 :]:
            if i != j and l == m and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                links[i].add(j)
                links[j].add(i)
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(links[i]), find(i)) for i, *_ in rows if i is not None}


def check(spark, rows, kind="float", **options):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    rows = [tuple(r) for r in df.collect()]
    got = near_duplicates(df, **options).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, None)
        else:
            assert (r.n_links, r.component_id, r.kept) == (*want[r.vec_id], want[r.vec_id][1] == r.vec_id)


def test_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(25, 24)) * np.linspace(3, 0.3, 24)
    rows = []
    for i in range(700):
        c = centres[rng.integers(25)]
        v = c + rng.normal(size=24) * rng.choice([0.0, 0.05, 0.25, 2.0]) * np.linspace(1, 0.1, 24)
        rows.append((i, [float(x) for x in v * rng.choice([1.0, 2.0])], int(rng.choice([1, 1, 1, 2]))))
    n = 24
    rows += [(1000, None, 1), (1001, rows[0][1], None), (1002, [0.0] * n, 1), (1003, [float("nan")] * n, 1), (1004, [float("inf")] + [1.0] * (n - 1), 1), (1005, [None] + [1.0] * (n - 1), 1),
             (1006, [1.0, 2.0], 1), (1007, [1.0, 2.0], 1), (1008, [], 1), (None, rows[0][1], rows[0][2]), rows[5], (1009, rows[5][1], rows[5][2])]
    check(spark, rows)
    check(spark, rows, tile=40)


def test_one_common_vector(spark):
    rng = random.Random(2)
    rows = [(i, [1.0, 0.5, 0.25], 1) for i in range(200)] + [(200 + i, [1.0, 0.5, 0.25 + rng.random() / 50], 1) for i in range(100)]
    check(spark, rows, tile=16)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    df = spark.createDataFrame([(1, None, None, 3)], "vec_id long, embedding array<float>, label int, n_links int")
    assert [tuple(r) for r in near_duplicates(df).collect()] == [(1, 0, 1, True)]


def test_one_id_with_several_vectors(spark):
    near = lambda x: [1.0, x, 0.0, 0.0]
    rows = [(5, near(0.0), 1), (5, near(0.01), 1), (7, near(0.02), 1), (9, [0.0, 0.0, 1.0, 0.0], 1)]
    check(spark, rows)
    # An id joins what its vectors join, also under two labels; copies of it count once.
    rows += [(5, [0.0, 0.0, 1.0, 0.001], 2), (11, [0.0, 0.0, 1.0, 0.002], 2), (3, [0.0, 0.0, 1.0, 0.0], 2), (11, near(0.03), 1), (7, near(0.02), 1), (20, near(0.02), 3)]
    check(spark, rows)
    rng = random.Random(3)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    check(spark, [(rng.randrange(60), [x + rng.gauss(0, 0.03) for x in rng.choice(base)], rng.randrange(2)) for _ in range(150)])
