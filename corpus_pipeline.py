"""The corpus pipeline: five stages over documents, each written and read again before the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyreel.llm import mixing, ngram_join, packing, pii, quality
from keyreel.llm.common import cut_table, drop, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a score of 0.3 or more; learned from the labels that are not held out."""
    model = quality.fit(docs, quality.training_labels(table(spark, sf_dir, "labels")))
    kept = docs.withColumn("__score", model.score(F.col("text"))).where("__score >= 0.3")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id; of several rows with that id the
    first by digest of the text, then by the other columns. Rows without an id are in no group and stay."""
    groups = cut_table(ngram_join.near_duplicates(docs))
    kept = docs.join(groups.where("doc_id = component_id").select(F.col("doc_id").alias("__keep")).distinct(), F.col("doc_id") == F.col("__keep"), "left_semi")
    several = groups.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if not several.isEmpty():
        rest = [F.col(f"`{c}`").cast("string") for c in docs.columns if c != "text"]
        first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.md5(F.col("text").cast("binary")), *rest))
        kept = kept.withColumn("__first", first).where("__first = 1").drop("__first")
    return kept.unionByName(docs.where("doc_id is null"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the spans of personal data replaced by their kinds."""
    return pii.redacted(docs)


def mix_to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order, a row for each copy taken."""
    return mixing.mixed(docs)


def length_buckets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every row."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("PII", personal_data),
    ("mixing sources to target weights", mix_to_target_weights),
    ("packing", length_buckets),
]

#: SQL can express neither the trained models nor the similarity classes; tests/llm/test_pipeline.py holds
#: each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, cut_table(stage(spark, docs, sf_dir))
        drop(before)  # its table, if it is one of these
    return STAGES[-1][1](spark, docs, sf_dir)
