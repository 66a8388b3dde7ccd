import math

import duckdb
import pytest

from keyreel.llm import queries

SF = "/root/testdata/sf0.01"


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([round(r[i], 6) if isinstance(r[i], float) and not math.isnan(r[i]) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), names)


def test_scored_and_identified(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in queries.op1_quality_classifier(spark, SF).collect() if r.held_out and r.doc_id in labels]
    assert len(rows) > 40 and sum(r.predicted == labels[r.doc_id] for r in rows) >= 0.97 * len(rows)
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in queries.op3_language_id(spark, SF).collect() if r.held_out]
    assert len(rows) > 150 and sum(r.lang_pred == langs[r.doc_id] for r in rows) >= 0.97 * len(rows)
