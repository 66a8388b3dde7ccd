import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as P
from keyreel.llm import pii
from tests.llm.test_ngram_join import brute
from tests.llm.test_pii import base

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(None, None, None, None, None), (900, "", "en", "src1", 0), (900, "", "en", "src1", 0), (901, None, None, None, 1), (902, "w " * 30000, "en", "src0", 60000)], docs.schema)
    docs = docs.unionByName(extra)
    rows = docs.collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    one = P.STAGES[0][1](spark, docs, SF).cache()
    assert one.columns == docs.columns
    kept = {r.doc_id for r in one.collect()}
    right = sum((i in kept) == (q == 1) for i, q in labels.items())
    assert right >= 0.97 * len(labels)

    docs_s = docs.where("length(text) < 8000 or text is null or doc_id > 800")
    rows = docs_s.collect()
    two = P.STAGES[1][1](spark, docs_s, SF)
    assert two.columns == docs.columns
    want, _ = brute([(r.doc_id, r.text) for r in rows])
    got = Counter(r.doc_id for r in two.collect())
    assert got == Counter({i for i, _, c in want if i is not None and i == c} | {None})

    three = P.STAGES[2][1](spark, docs, SF)
    assert three.columns == docs.columns and three.count() == docs.count()
    text = {r.doc_id: r.text for r in three.collect()}
    for r in docs.collect():
        spans = base(r.text)
        if r.doc_id != 902:
            assert not base(text[r.doc_id]) and ((text[r.doc_id] == r.text) or spans or "[SECRET]" in text[r.doc_id] or "[MASKED]" in text[r.doc_id])

    four = P.STAGES[3][1](spark, three, SF)
    assert four.columns == docs.columns
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = sum(words(r.text) for r in three.collect())
    assert abs(sum(words(r.text) for r in four.collect()) - total) <= 30

    five = P.STAGES[4][1](spark, four, SF)
    assert five.count() == four.count()
    assert five.where("padding < 0 or n_tokens > bucket_len").count() == 0


def test_run(spark):
    out = P.run(spark, SF)
    assert out.count() > 0
    assert {"doc_id", "bucket_len", "batch", "slot"} <= set(out.columns)


def test_all_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0
