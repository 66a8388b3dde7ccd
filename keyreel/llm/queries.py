"""The queries of this subpackage: op<N>_<name> over whole tables of sf_dir, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keyreel.llm.common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyreel.llm.quality import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyreel.llm.quotes import linked

    return linked(table(spark, sf_dir, "conversations"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyreel.llm.language import identified

    return identified(table(spark, sf_dir, "documents"))


def op4_mix_to_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyreel.llm.mixing import mix_report

    return mix_report(table(spark, sf_dir, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyreel.llm.repeats import removed

    return removed(table(spark, sf_dir, "documents"))


def op6_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyreel.llm.audio import digests

    return digests(table(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyreel.llm.embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyreel.llm.pii import found

    return found(table(spark, sf_dir, "documents"))


def op9_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyreel.llm.packing import packed

    return packed(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyreel.llm.ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = "'[^\\x20\\x09-\\x0D]+'"

_SQL = {
    "op4_mix_to_target_weights": f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORDS})) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
  s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
  t AS (SELECT *, source_size * 3.0::DOUBLE AS top FROM s),
  r AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(top) OVER (ORDER BY top / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY top / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM t),
  g AS (SELECT source, source_size, least(top, max(rate) OVER () * weight)::DOUBLE AS target, [1.5, 1.0, 0.5][weight]::DOUBLE AS a, [0.5, 1.0, 1.5][weight]::DOUBLE AS b FROM r),
  o AS (SELECT d.doc_id, d.size, g.*, CAST(floor(target + 0.5) AS BIGINT) AS goal,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
    FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
  f AS (SELECT *, CASE WHEN source_size > 0 THEN least(goal // source_size, 3) ELSE 0 END AS k FROM o),
  q AS (SELECT *, k * size + CASE WHEN k >= 3 THEN 0 ELSE greatest(0, least(size, goal - k * source_size - before)) END AS taken, CASE WHEN goal > 0 THEN before / goal::DOUBLE END AS x FROM f)
  SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
    CASE WHEN taken > 0 THEN abs(round(CASE WHEN a = b THEN x ELSE (sqrt(greatest(a * a + (b - a) * (a + b) * x, 0)) - a) / (b - a) END, 9)) END AS position FROM q""",
    "op7_embedding_near_dedup": """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e) AND len(list_filter(e, lambda x: x <> 0)) > 0),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
  reach AS (SELECT vec_id AS node, vec_id AS other FROM v UNION SELECT r.node, l.b FROM reach r JOIN l ON l.a = r.other),
  c AS (SELECT node, min(other) AS component_id FROM reach GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
  SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.node = vec_id LEFT JOIN n ON n.a = vec_id""",
    "op10_ngram_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), {_WORDS}) AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS x FROM w),
  e AS (SELECT doc_id, len(x) AS n, unnest(x) AS x FROM s),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS n, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (n - c)), k AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  reach AS (SELECT doc_id AS node, doc_id AS other FROM s UNION SELECT r.node, k.b FROM reach r JOIN k ON k.a = r.other),
  c AS (SELECT node, min(other) AS component_id FROM reach GROUP BY 1)
  SELECT doc_id, CAST(len(x) AS BIGINT) AS n_shingles, component_id FROM s JOIN c ON c.node = s.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express, models and digests of features apart."""
    return dict(_SQL)
