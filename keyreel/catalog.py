"""Named queries over the driver's tables, each with the same query as SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyreel import adapters as A
from keyreel.functions import media, naming
from keyreel.functions import taxonomy as T
from keyreel.functions.pixels import color_distance, frame_difference, hamming, with_features
from keyreel.operators import duplicates, scenes, scoring, vision
from keyreel.operators import select as S
from keyreel.plans import sampling

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

FRAMES = """frames AS (SELECT user_id AS source_id, event_id AS id,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS "index", (epoch_us(CAST(ts AS TIMESTAMP)) // 1000) AS time_ms,
  CAST(day(ts) - 1 AS INTEGER) AS scene_index, least(1.0::DOUBLE, value / 500.0::DOUBLE) AS composite, (event_id * 7919 % 97) / 96.0::DOUBLE AS sharpness,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 100.0::DOUBLE AS exposure, CASE WHEN event_id % 7 = 0 THEN event_id - 1 END AS dup,
  CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 63 WHEN 'purchase' THEN 16 WHEN 'signup' THEN 2 WHEN 'error' THEN 39 END AS cls FROM events)"""
DETS = "dets AS (SELECT l_orderkey AS id, CAST(l_partkey % 80 AS INTEGER) AS class_id, 1 - l_discount * 10 AS confidence FROM lineitem)"
GRIDS = """grids AS (SELECT label AS source_id, vec_id AS id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS "index",
  list_transform(embedding, lambda x: least(1.0::DOUBLE, greatest(0.0::DOUBLE, CAST(x AS DOUBLE) + 0.5))) AS grid FROM embeddings)"""
SPANS = """spans AS (SELECT user_id AS source_id, (max((epoch_us(CAST(ts AS TIMESTAMP)) // 1000)) - min((epoch_us(CAST(ts AS TIMESTAMP)) // 1000))) / 3600000.0::DOUBLE AS d FROM events GROUP BY 1)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# Scans, projections, predicates

@query("scan_project", f'WITH {FRAMES} SELECT source_id, id, "index", time_ms, round(composite, 6) AS composite FROM frames WHERE time_ms >= 1704326400000')
def scan_project(spark, sf):
    f = A.event_frames(spark, sf).where("time_ms >= 1704326400000")
    return f.select("source_id", "id", "index", "time_ms", r6(F.col("metrics.composite"), "composite"))


@query("min_quality_filter", f"WITH {FRAMES} SELECT source_id, id FROM frames WHERE coalesce(composite, 0) >= 0.4")
def min_quality_filter(spark, sf):
    return S.filter_frames(A.event_frames(spark, sf), S.SelectOptions(min_quality=0.4)).select("source_id", "id")


def _orders(name: str, sql: str, **options) -> None:
    @query(name, f"WITH {DETS} {sql}")
    def run(spark, sf):
        return S.filter_frames(A.order_frames(spark, sf), S.SelectOptions(**options)).select("id", F.size("detections").cast("long").alias("n"))


_HAS = "count(*) FILTER (class_id IN ({}) AND confidence >= {})"
_orders("with_all_classes", f"SELECT id, count(*) AS n FROM dets GROUP BY id HAVING {_HAS.format('0', 0.4)} > 0 AND {_HAS.format('14,15,16,17,18,19,20,21,22,23', 0.4)} > 0", with_=("person", "animals"))
_orders("with_any_class", f"SELECT id, count(*) AS n FROM dets GROUP BY id HAVING {_HAS.format('0,16', 0.4)} > 0 AND {_HAS.format('24,25,26,27,28,39,40,41,42,43,44,45,46,47,48,49,50,51,52,53,54,55,62,63,64,65,66,67,68,69,70,72,73,74,75,76,77,78,79', 0.4)} = 0", with_any=("person", "dog"), without=("products",))
_orders("without_class", f"SELECT id, count(*) AS n FROM dets GROUP BY id HAVING {_HAS.format('1,2,3,4,5,6,7,8', 0.4)} = 0", without=("vehicle",))
_orders("class_group_filter", f"SELECT id, count(*) AS n FROM dets GROUP BY id HAVING {_HAS.format('1,2,3,4,5,6,7,8', 0.4)} > 0", with_=("vehicles",))
_orders("min_confidence", f"SELECT id, count(*) AS n FROM dets GROUP BY id HAVING {_HAS.format('67', 0.75)} > 0", with_=("phone",), min_confidence=0.75)


@query("text_coverage_range", """SELECT doc_id, round(c, 6) AS coverage FROM (SELECT doc_id, (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) / greatest(length(text), 1)::DOUBLE AS c FROM documents)
  WHERE c > 0 AND c >= 0.02 AND c <= 0.3""")
def text_coverage_range(spark, sf):
    d = A.table(spark, sf, "documents")
    c = (F.length("text") - F.length(F.regexp_replace("text", "[A-Z]", ""))) / F.greatest(F.length("text"), F.lit(1))
    f = d.select("doc_id", F.struct((c > 0).alias("has_text"), c.alias("coverage")).alias("text"))
    out = S.filter_frames(f, S.SelectOptions(with_text=True, min_text_coverage=0.02, max_text_coverage=0.3))
    return out.select("doc_id", r6(F.col("text.coverage"), "coverage"))


# Ranking and reduction

def _ranked(name: str, where: str, order: str, pick: str, options: S.SelectOptions) -> None:
    @query(name, f"WITH {FRAMES}, pool AS (SELECT * FROM frames WHERE {where}), {pick} SELECT source_id, id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY {order}) AS INTEGER) AS pos FROM kept"
           + (f" QUALIFY pos <= {options.limit}" if options.limit else ""))
    def run(spark, sf):
        f = A.event_frames(spark, sf)
        return S.rank_and_reduce(S.filter_frames(f, options), options).select("source_id", "id", "pos")


_ALL = "kept AS (SELECT * FROM pool)"
_BEST = "kept AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY source_id, scene_index ORDER BY {} DESC, time_ms, \"index\") <= {})"
for _rank, _col in S.RANKS.items():
    _ranked(f"rank_{_rank}", "true", f'{_col} DESC, time_ms, "index"', _ALL, S.SelectOptions(rank=_rank))
_ranked("dedupe_drop", "dup IS NULL", 'composite DESC, time_ms, "index"', _ALL, S.SelectOptions(dedupe=True))
_ranked("best_per_scene", "true", 'time_ms, "index"', _BEST.format("composite", 2), S.SelectOptions(best_per_scene=2))
_ranked("best_per_scene_then_limit", "dup IS NULL", 'time_ms, "index"', _BEST.format("composite", 1), S.SelectOptions(dedupe=True, best_per_scene=1, limit=5))
_ranked("limit_topk", "true", 'composite DESC, time_ms, "index"', _ALL, S.SelectOptions(limit=3))
_ranked("preset_representative", "dup IS NULL", 'time_ms, "index"', _BEST.format("composite", 1), S.apply_preset("representative"))
_ranked("preset_storyboard", "dup IS NULL", 'time_ms, "index"', _BEST.format("sharpness", 1), S.apply_preset("storyboard"))
_ranked("preset_people", "dup IS NULL AND cls = 0", 'time_ms, "index"', _BEST.format("sharpness", 1), S.apply_preset("people"))


@query("selection_reasons", f"""WITH {FRAMES}, kept AS (SELECT * FROM frames WHERE dup IS NULL AND cls = 0
  QUALIFY row_number() OVER (PARTITION BY source_id, scene_index ORDER BY exposure DESC, time_ms, "index") <= 1)
  SELECT source_id, id, 'with=Matched required: person;dedupe=Not a perceptual duplicate;best-per-scene=Top 1 in scene ' || scene_index || ';rank=Ranked by exposure: ' ||
  printf('%.3f', exposure) AS reasons FROM kept""")
def selection_reasons(spark, sf):
    o = S.apply_preset("people", S.SelectOptions(rank="exposure"))
    out = S.rank_and_reduce(S.filter_frames(A.event_frames(spark, sf), o), o)
    return out.select("source_id", "id", F.array_join(F.transform("reasons", lambda r: F.concat_ws("=", r["code"], r["message"])), ";").alias("reasons"))


# Sequences

_LAG = 'abs(value_ - lag(value_) OVER (PARTITION BY source_id ORDER BY "index")) / 500.0::DOUBLE'
_DIFF = f"{FRAMES}, vals AS (SELECT f.*, e.value AS value_ FROM frames f JOIN events e ON e.event_id = f.id), diffs AS (SELECT *, coalesce({_LAG}, 0) AS d FROM vals)"


def _with_diff(spark, sf):
    return scenes.with_difference(A.flat(A.event_frames(spark, sf)), F.abs(F.col("value") - F.lag("value").over(scenes.in_order())) / 500.0)


@query("frame_difference_lag", f"WITH {_DIFF} SELECT source_id, id, round(d, 6) AS difference FROM diffs")
def frame_difference_lag(spark, sf):
    return _with_diff(spark, sf).select("source_id", "id", r6(F.col("difference"), "difference"))


@query("adaptive_threshold", f"""WITH {_DIFF}, s AS (SELECT source_id, count(*) FILTER (d > 0) AS n, list_sort(list(d) FILTER (d > 0)) AS l, stddev_pop(d) FILTER (d > 0) AS sd FROM diffs GROUP BY 1)
  SELECT source_id, round(CASE WHEN n < 3 THEN 0.113 ELSE greatest(0.113 * 0.35, least(0.113 * 2.5, l[n // 2 + 1] + greatest(0.04, 1.5 * sd))) END, 6) AS threshold FROM s""")
def adaptive_threshold(spark, sf):
    return scenes.adaptive_thresholds(_with_diff(spark, sf)).select("source_id", r6(F.col("threshold"), "threshold"))


_BOUND = """RECURSIVE {base}, f0 AS (SELECT source_id, min("index") AS i0, min(time_ms) AS t0 FROM frames GROUP BY 1),
  hits AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY "index") AS r FROM vals WHERE value_ >= 80 AND "index" > 0),
  walk AS (SELECT source_id, 0::BIGINT AS r, 0::INTEGER AS "index", t0 AS last, t0 AS time_ms, false AS hit FROM f0
    UNION ALL SELECT h.source_id, h.r, h."index", CASE WHEN h.time_ms - w.last >= 86400000 THEN h.time_ms ELSE w.last END, h.time_ms, h.time_ms - w.last >= 86400000
    FROM walk w JOIN hits h ON h.source_id = w.source_id AND h.r = w.r + 1)"""
_BOUND = _BOUND.format(base=f"{FRAMES}, vals AS (SELECT f.*, e.value AS value_ FROM frames f JOIN events e ON e.event_id = f.id)")


def _scened(spark, sf):
    f = A.flat(A.event_frames(spark, sf)).drop("scene_index").withColumnRenamed("value", "difference")
    return f, scenes.boundaries(f, F.lit(80.0), 86_400_000)


@query("scene_boundaries", f'WITH {_BOUND} SELECT source_id, "index", time_ms FROM walk WHERE hit')
def scene_boundaries(spark, sf):
    return _scened(spark, sf)[1]


_SCENES = f'{_BOUND}, sc AS (SELECT f.*, CAST(count(w.hit) OVER (PARTITION BY f.source_id ORDER BY f."index" ROWS UNBOUNDED PRECEDING) AS INTEGER) AS scene FROM frames f LEFT JOIN walk w ON w.source_id = f.source_id AND w."index" = f."index" AND w.hit)'


@query("scene_ranges", f'WITH {_SCENES} SELECT source_id, scene AS scene_index, min("index") AS start_index, max("index") AS end_index, arg_min(time_ms, "index") AS start_ms, arg_max(time_ms, "index") AS end_ms FROM sc GROUP BY 1, 2')
def scene_ranges(spark, sf):
    f, b = _scened(spark, sf)
    return scenes.ranges(scenes.with_scenes(f, b))


@query("scene_position", f"""WITH {_SCENES} SELECT source_id, id, round(CASE WHEN count(*) OVER w = 1 THEN 0.5 ELSE (row_number() OVER (w ORDER BY "index") - 1) / (count(*) OVER w - 1)::DOUBLE END, 6) AS scene_position
  FROM sc WINDOW w AS (PARTITION BY source_id, scene)""")
def scene_position(spark, sf):
    f, b = _scened(spark, sf)
    return scenes.with_scenes(f, b).select("source_id", "id", r6(F.col("scene_position"), "scene_position"))


@query("scene_keyframe", f'WITH {FRAMES} SELECT source_id, scene_index, id FROM frames WHERE dup IS NULL QUALIFY row_number() OVER (PARTITION BY source_id, scene_index ORDER BY composite DESC, "index") = 1')
def scene_keyframe(spark, sf):
    return scoring.scene_keyframes(A.flat(A.event_frames(spark, sf))).select("source_id", "scene_index", "id")


# Pixel measures, hashes and duplicates of 8 x 8 pictures

_PIXELS = f"""{GRIDS}, px AS (SELECT source_id, id, "index", list_transform(grid, lambda x: CAST(floor(x * 255 + 0.5) AS INTEGER)) AS p FROM grids),
  lum AS (SELECT *, list_transform(p, lambda v: CAST(CAST((0.2126::DOUBLE * v + 0.7152::DOUBLE * v + 0.0722::DOUBLE * v) / 255 AS FLOAT) AS DOUBLE)) AS l FROM px)"""
# Bits: 9 x 8 samples against their right neighbours, then 8 x 9 against those below; words of 32, lowest bit first.
_BIT_A = "p[(i // 8) * 8 + CAST(floor((i % 8 + 0.5) * 8 / 9) AS INTEGER) + 1] > p[(i // 8) * 8 + CAST(floor((i % 8 + 1.5) * 8 / 9) AS INTEGER) + 1]"
_BIT_B = "p[CAST(floor((i // 8 + 0.5) * 8 / 9) AS INTEGER) * 8 + i % 8 + 1] > p[CAST(floor((i // 8 + 1.5) * 8 / 9) AS INTEGER) * 8 + i % 8 + 1]"
_WORD = "CAST(list_sum(list_transform(range({a}, {b}), lambda i: CASE WHEN {bit} THEN 1::BIGINT << CAST(i - {a} AS INTEGER) ELSE 0::BIGINT END)) AS BIGINT)"
_HASH = f"{_PIXELS}, hashed AS (SELECT *, [{', '.join(_WORD.format(a=a, b=a + 32, bit=bit) for bit in (_BIT_A, _BIT_B) for a in (0, 32))}] AS hash FROM lum)"


def _features(spark, sf):
    return with_features(A.grid_pixels(spark, sf))


@query("dhash_bits", f"WITH {_HASH} SELECT id, array_to_string(hash, ',') AS hash, CAST(list_sum(list_transform(hash, lambda x: bit_count(x))) AS INTEGER) AS bits FROM hashed")
def dhash_bits(spark, sf):
    none = F.array_repeat(F.lit(0).cast("long"), 4)
    return _features(spark, sf).select("id", F.array_join(F.transform("hash", lambda x: x.cast("string")), ",").alias("hash"), hamming(F.col("hash"), none).cast("int").alias("bits"))


_BITS = "CAST(bit_count(xor(a.hash[1], b.hash[1])) + bit_count(xor(a.hash[2], b.hash[2])) + bit_count(xor(a.hash[3], b.hash[3])) + bit_count(xor(a.hash[4], b.hash[4])) AS INTEGER)"
_PAIRS = f"""{_HASH}, pairs AS (SELECT b.source_id, b.id, a.id AS other, a."index" AS i, {_BITS} AS d, abs(list_avg(a.p) - list_avg(b.p)) / 255 AS color
  FROM hashed b LEFT JOIN hashed a ON a.source_id = b.source_id AND a."index" < b."index")"""


@query("hamming_nearest_prev", f"WITH {_PAIRS} SELECT id, coalesce(min(d), 128) AS min_distance FROM pairs GROUP BY id")
def hamming_nearest_prev(spark, sf):
    return duplicates.find_duplicates(_features(spark, sf)).select("id", F.col("min_distance").cast("int").alias("min_distance"))


@query("duplicate_of", f"WITH {_PAIRS} SELECT id, arg_min(other, i) FILTER (d <= 40 AND color <= 0.1) AS duplicate_of_id FROM pairs GROUP BY id")
def duplicate_of(spark, sf):
    """With wider limits than usual, as these pictures hold no near copies."""
    bits, color = hamming(F.col("a.hash"), F.col("b.hash")), color_distance(F.col("a.mean_rgb"), F.col("b.mean_rgb"))
    f = _features(spark, sf).select("source_id", "id", "index", "hash", "mean_rgb")
    return duplicates.nearest_earlier(f, bits, duplicates.is_duplicate(bits, color, 40, 0.1)).select("id", "duplicate_of_id")


@query("color_distance_prev", f"""WITH {GRIDS}, p AS (SELECT id, grid[1:3] AS c, lag(grid[1:3]) OVER (PARTITION BY source_id ORDER BY "index") AS o FROM grids)
  SELECT id, round(sqrt((c[1] - o[1]) ** 2 + (c[2] - o[2]) ** 2 + (c[3] - o[3]) ** 2) / sqrt(3.0), 6) AS distance FROM p WHERE o IS NOT NULL""")
def color_distance_prev(spark, sf):
    g = A.grids(spark, sf).withColumn("c", F.slice("grid", 1, 3))
    g = g.withColumn("o", F.lag("c").over(scenes.in_order())).where("o is not null")
    return g.select("id", r6(color_distance(F.col("c"), F.col("o")), "distance"))


_EXPOSURE = """SELECT *, list_avg(l) AS mean, len(list_filter(l, lambda x: x <= 0.025 OR x >= 0.975)) / 64.0::DOUBLE AS clip FROM {t}"""
_SCORE = "least(1, greatest(0, 0.65::DOUBLE * greatest(0, 1 - abs(mean - 0.5) / 0.5) + 0.35::DOUBLE * greatest(0, 1 - 2.5::DOUBLE * clip)))"


@query("exposure_score", f"WITH {_PIXELS}, m AS ({_EXPOSURE.format(t='lum')}) SELECT id, round(mean + 1e-9, 6) AS mean, round(clip, 6) AS clipped, round({_SCORE} + 1e-9, 6) AS score FROM m")
def exposure_score(spark, sf):
    f = _features(spark, sf)
    return f.select("id", r6(F.col("exposure_mean") + 1e-9, "mean"), r6(F.col("exposure_clipped_ratio"), "clipped"), r6(F.col("exposure") + 1e-9, "score"))


_LAPLACE = """SELECT *, list_transform(range(0, 36), lambda i: l[(i // 6) * 8 + i % 6 + 2] + l[(i // 6 + 2) * 8 + i % 6 + 2] + l[(i // 6 + 1) * 8 + i % 6 + 1]
  + l[(i // 6 + 1) * 8 + i % 6 + 3] - 4 * l[(i // 6 + 1) * 8 + i % 6 + 2]) AS v FROM {t}"""
_VARIANCE = "greatest(0, list_avg(list_transform(v, lambda x: x * x)) - list_avg(v) ** 2)"
_SHARPNESS = "least(1, greatest(0, ln(1 + 2000 * variance) / ln(81::DOUBLE)))"


@query("laplacian_variance", f"WITH {_PIXELS}, lap AS ({_LAPLACE.format(t='lum')}), s AS (SELECT *, {_VARIANCE} AS variance FROM lap) SELECT id, round(variance + 1e-9, 6) AS variance, round({_SHARPNESS} + 1e-9, 6) AS sharpness FROM s")
def laplacian_variance(spark, sf):
    return _features(spark, sf).select("id", r6(F.col("blur_variance") + 1e-9, "variance"), r6(F.col("sharpness") + 1e-9, "sharpness"))


# 32 x 18 samples: four to a column, and each row of the picture two or three times.
_SAMPLES = "list_avg(list_transform(range(0, 576), lambda i: abs({a}[CAST(floor((i // 32 + 0.5) * 8 / 18) AS INTEGER) * 8 + (i % 32) // 4 + 1] - {b}[CAST(floor((i // 32 + 0.5) * 8 / 18) AS INTEGER) * 8 + (i % 32) // 4 + 1])))"
_PIXEL_DIFF = f"least(1, {_SAMPLES.format(a='l', b='l0')} * 0.72::DOUBLE + abs(list_avg(p) - list_avg(p0)) / 255 * 0.28::DOUBLE)"


@query("pixel_difference", f"""WITH {_PIXELS}, b AS (SELECT *, lag(l) OVER w AS l0, lag(p) OVER w AS p0 FROM lum WINDOW w AS (PARTITION BY source_id ORDER BY "index"))
  SELECT id, round(CASE WHEN l0 IS NULL THEN 0 ELSE {_PIXEL_DIFF} END + 1e-9, 6) AS difference FROM b""")
def pixel_difference(spark, sf):
    w = scenes.in_order()
    d = frame_difference(F.col("luma"), F.lag("luma").over(w), F.col("mean_rgb"), F.lag("mean_rgb").over(w))
    return scenes.with_difference(_features(spark, sf), d).select("id", r6(F.col("difference") + 1e-9, "difference"))


_ANALYSIS = f"""RECURSIVE {_HASH}, lap AS ({_LAPLACE.format(t='hashed')}), s0 AS (SELECT *, {_VARIANCE} AS variance FROM lap), s1 AS ({_EXPOSURE.format(t='s0')}),
  frames AS (SELECT *, "index" * 500 AS time_ms, {_SHARPNESS} AS sharpness, {_SCORE} AS exposure, lag(l) OVER w AS l0, lag(p) OVER w AS p0 FROM s1 WINDOW w AS (PARTITION BY source_id ORDER BY "index")),
  diffs AS (SELECT *, CASE WHEN l0 IS NULL THEN 0 ELSE {_PIXEL_DIFF} END AS d FROM frames),
  st AS (SELECT source_id, count(*) FILTER (d > 0) AS n, list_sort(list(d) FILTER (d > 0)) AS ds, stddev_pop(d) FILTER (d > 0) AS sd FROM diffs GROUP BY 1),
  th AS (SELECT source_id, CASE WHEN n < 3 THEN 0.113::DOUBLE ELSE greatest(0.113::DOUBLE * 0.35, least(0.113::DOUBLE * 2.5, ds[n // 2 + 1] + greatest(0.04::DOUBLE, 1.5 * sd))) END AS t FROM st),
  hits AS (SELECT source_id, "index", time_ms, row_number() OVER (PARTITION BY source_id ORDER BY "index") AS r FROM diffs JOIN th USING (source_id) WHERE d >= t AND "index" > 0),
  walk AS (SELECT source_id, 0::BIGINT AS r, 0::INTEGER AS "index", 0::BIGINT AS last, false AS hit FROM st
    UNION ALL SELECT h.source_id, h.r, h."index", CASE WHEN h.time_ms - w.last >= 650 THEN h.time_ms ELSE w.last END, h.time_ms - w.last >= 650 FROM walk w JOIN hits h ON h.source_id = w.source_id AND h.r = w.r + 1),
  sc AS (SELECT f.*, CAST(count(w.hit) OVER (PARTITION BY f.source_id ORDER BY f."index" ROWS UNBOUNDED PRECEDING) AS INTEGER) AS scene FROM diffs f LEFT JOIN walk w ON w.source_id = f.source_id AND w."index" = f."index" AND w.hit),
  pos AS (SELECT *, CASE WHEN count(*) OVER w = 1 THEN 0.5::DOUBLE ELSE (row_number() OVER (w ORDER BY "index") - 1) / (count(*) OVER w - 1)::DOUBLE END AS rel FROM sc WINDOW w AS (PARTITION BY source_id, scene)),
  pairs AS (SELECT b.id, min({_BITS}) AS nearest, arg_min(a.id, a."index") FILTER ({_BITS} <= 4 AND abs(list_avg(a.p) - list_avg(b.p)) / 255 <= 0.035) AS dup
    FROM hashed b LEFT JOIN hashed a ON a.source_id = b.source_id AND a."index" < b."index" GROUP BY 1),
  u AS (SELECT pos.*, dup, CASE WHEN dup IS NOT NULL THEN 0 ELSE least(1, greatest(0, coalesce(nearest, 128) / 24.0::DOUBLE)) END AS uniqueness, greatest(0, 1 - abs(rel - 0.5) * 1.25::DOUBLE) AS position FROM pos JOIN pairs USING (id)),
  c AS (SELECT *, sharpness * 0.45::DOUBLE + exposure * 0.25::DOUBLE + uniqueness * 0.2::DOUBLE + position * 0.1::DOUBLE AS composite FROM u),
  pool AS (SELECT *, avg(composite) OVER w + greatest(0.04::DOUBLE, stddev_pop(composite) OVER w * 0.5) AS t FROM c WHERE dup IS NULL WINDOW w AS (PARTITION BY source_id)),
  front AS (SELECT id, source_id, composite >= t AS ok FROM pool a WHERE NOT EXISTS (SELECT 1 FROM pool b WHERE b.source_id = a.source_id AND b.composite >= a.composite AND b.sharpness >= a.sharpness AND (b.composite > a.composite OR b.sharpness > a.sharpness))),
  best AS (SELECT id FROM (SELECT *, bool_or(ok) OVER (PARTITION BY source_id) AS anyok FROM front) WHERE ok OR NOT anyok)"""


@query("analyze_scan", f"""WITH {_ANALYSIS} SELECT source_id, c.id, scene AS scene_index, round(d + 1e-9, 6) AS scene_difference, round(uniqueness, 6) AS uniqueness, round(position + 1e-9, 6) AS scene_position,
  round(composite + 1e-9, 6) AS composite, CAST(dup AS VARCHAR) AS duplicate_of_id, best.id IS NOT NULL AS recommended FROM c LEFT JOIN best ON best.id = c.id""")
def analyze_scan(spark, sf):
    from keyreel.plans.pipeline import analyze

    m = lambda n: r6(F.col(f"metrics.{n}") + 1e-9, n)
    a = analyze(A.grid_pixels(spark, sf))
    return a.select("source_id", "id", "metrics.scene_index", m("scene_difference"), r6(F.col("metrics.uniqueness"), "uniqueness"), m("scene_position"), m("composite"), F.col("metrics.duplicate_of_id").cast("string").alias("duplicate_of_id"), "recommended")


# Scores and fronts

_SCORED = f"""{FRAMES}, scored AS (SELECT *, 0.45 * sharpness + 0.25 * exposure + 0.2 * CASE WHEN dup IS NOT NULL THEN 0 ELSE least(1, (id % 30) / 24.0::DOUBLE) END
  + 0.1 * greatest(0, 1 - 1.25 * abs("index" % 11 / 10.0::DOUBLE - 0.5)) AS total FROM frames)"""


def _scored(spark, sf):
    f = A.flat(A.event_frames(spark, sf)).withColumn("uniqueness", scoring.uniqueness(F.col("id") % 30, F.col("duplicate_of_id")))
    f = f.withColumn("scene_position", scoring.position_score(F.col("index") % 11 / 10.0))
    return f.withColumn("total", scoring.composite())


@query("composite_score", f"WITH {_SCORED} SELECT source_id, id, round(total + 1e-9, 6) AS composite FROM scored")
def composite_score(spark, sf):
    return _scored(spark, sf).select("source_id", "id", r6(F.col("total") + 1e-9, "composite"))


@query("strongest_component", f"""WITH {_SCORED}, c AS (SELECT source_id, id, sharpness AS a, exposure AS b, CASE WHEN dup IS NOT NULL THEN 0 ELSE least(1, (id % 30) / 24.0::DOUBLE) END AS u,
  greatest(0, 1 - 1.25 * abs("index" % 11 / 10.0::DOUBLE - 0.5)) AS p FROM scored)
  SELECT source_id, id, CASE greatest(a, b, u, p) WHEN a THEN 'sharpness' WHEN b THEN 'exposure' WHEN u THEN 'uniqueness' ELSE 'scene_position' END AS reason FROM c""")
def strongest_component(spark, sf):
    return _scored(spark, sf).select("source_id", "id", scoring.strongest().alias("reason"))


@query("pareto_front", f"""WITH {FRAMES}, p AS (SELECT source_id, id, round(composite * 50) AS c, sharpness AS s FROM frames) SELECT source_id, id FROM p a
  WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.source_id = a.source_id AND b.c >= a.c AND b.s >= a.s AND (b.c > a.c OR b.s > a.s))""")
def pareto_front(spark, sf):
    f = A.flat(A.event_frames(spark, sf)).withColumn("composite", F.round(F.col("composite") * 50))
    return scoring.pareto_front(f).select("source_id", "id")


@query("pareto_keepers", f"""WITH {FRAMES}, p AS (SELECT * FROM frames WHERE dup IS NULL), t AS (SELECT source_id, avg(composite) + greatest(0.04, 0.5 * stddev_pop(composite)) AS t FROM p GROUP BY 1),
  f AS (SELECT a.source_id, a.id, a.composite >= t.t AS ok FROM p a JOIN t USING (source_id)
  WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.source_id = a.source_id AND b.composite >= a.composite AND b.sharpness >= a.sharpness AND (b.composite > a.composite OR b.sharpness > a.sharpness)))
  SELECT source_id, id FROM (SELECT *, bool_or(ok) OVER (PARTITION BY source_id) AS anyok FROM f) WHERE ok OR NOT anyok""")
def pareto_keepers(spark, sf):
    return scoring.pareto_keepers(A.flat(A.event_frames(spark, sf))).select("source_id", "id")


@query("scan_summary", f"""WITH {FRAMES} SELECT source_id, count(*) AS sampled_count, CAST(max(scene_index) + 1 AS BIGINT) AS scene_count, count(*) FILTER (sharpness < 0.28) AS blurry_count, count(dup) AS duplicate_count FROM frames GROUP BY 1""")
def scan_summary(spark, sf):
    return scoring.scan_summary(A.flat(A.event_frames(spark, sf))).drop("recommended_count")


@query("detect_summary", f"""WITH {DETS}, f AS (SELECT id, count(*) FILTER (class_id BETWEEN 14 AND 23 OR class_id = 2) AS n FROM dets GROUP BY 1)
  SELECT id % 100 AS source_id, count(*) FILTER (n > 0) AS frames_with_objects, CAST(sum(n) AS BIGINT) AS detection_count FROM f GROUP BY 1""")
def detect_summary(spark, sf):
    return vision.detect_summary(A.order_frames(spark, sf), ["animals", "car"])


@query("metrics_left_join", f"""WITH {FRAMES} SELECT f.source_id, f.id, m.sharpness IS NOT NULL AS analysed, round(m.sharpness, 6) AS sharpness FROM frames f LEFT JOIN (SELECT * FROM frames WHERE cls <> 39) m ON m.source_id = f.source_id AND m.id = f.id""")
def metrics_left_join(spark, sf):
    from keyreel.plans.pipeline import with_metrics

    f = A.event_frames(spark, sf)
    # A scan that was made without the frames of failures.
    out = with_metrics(f, f.where("detections[0].class_id <> 39"))
    return out.select("source_id", "id", F.col("metrics.sharpness").isNotNull().alias("analysed"), r6(F.col("metrics.sharpness"), "sharpness"))


# Sampling: a source's duration is its events' span, an hour taken as a second

def _spans(spark, sf):
    ms = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    e = A.table(spark, sf, "events").select(F.col("user_id").alias("source_id"), ms.alias("t"))
    return e.groupBy("source_id").agg(((F.max("t") - F.min("t")) / 3600000.0).alias("duration_sec")).withColumn("fps", F.lit(2.5))


def _sampling(name: str, n: str, step: str, extra: str = "", **options) -> None:
    budget = options.get("budget", sampling.BUDGET)
    count = f"least({n}, {budget})" if budget else n

    @query(name, f"""WITH {SPANS}, p AS (SELECT source_id, d - 3 AS span, d FROM spans WHERE d > 3), q AS (SELECT *, CAST({n} AS INTEGER) AS want, CAST({count} AS INTEGER) AS n FROM p)
      SELECT source_id, CAST(i AS INTEGER) AS "index", round(3 + i * s + 1e-9, 6) AS t, n AS planned, want > n AS capped FROM (SELECT *, {step} AS s, unnest(range(0, n)) AS i FROM q) WHERE n = 1 OR 3 + i * s < d - 1e-10""")
    def run(spark, sf):
        p = sampling.with_plan(_spans(spark, sf).where("duration_sec > 3"), start=3.0, **options)  # others end before the start
        rows = p.select("source_id", F.col("plan.count").alias("planned"), F.col("plan.capped").alias("capped"), F.posexplode(sampling.plan_times(F.col("plan"))).alias("index", "t"))
        return rows.select("source_id", "index", r6(F.col("t") + 1e-9, "t"), "planned", "capped")


_N = "greatest(1, ceil({} - 1e-10))"
_sampling("sampling_every", _N.format("span / 20"), "CASE WHEN want > n THEN span / n ELSE 20 END", every=20.0)
_sampling("sampling_capped", _N.format("span / 0.5"), "CASE WHEN want > n THEN span / n ELSE 0.5 END", budget=100)
_sampling("sampling_count", "7", "span / n", count=7)
_sampling("sampling_fps", _N.format("span / (1.0::DOUBLE / 0.05)"), "CASE WHEN want > n THEN span / n ELSE 1.0::DOUBLE / 0.05 END", fps=0.05)
_sampling("sampling_all", _N.format("span * 2.5"), "span / n", all_=True, budget=150)


@query("sampling_at", f"""WITH {SPANS}, t AS (SELECT source_id, unnest([7.5, 3.0, 250.0, 100.25, 9000.0]) AS t, d FROM spans WHERE d > 3)
  SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY t) - 1 AS INTEGER) AS "index", CAST(t * 1000 AS BIGINT) AS time_ms FROM t WHERE t >= 3 AND t < d QUALIFY "index" < 3""")
def sampling_at(spark, sf):
    p = sampling.with_plan(_spans(spark, sf).where("duration_sec > 3"), at=[100.25, 3.0, 7.5, 7.5, 1.0, 250.0, 9000.0], start=3.0, budget=3)
    return sampling.planned_rows(p).select("source_id", "index", "time_ms")


@query("pts_downsample", f"""WITH {FRAMES}, l AS (SELECT source_id, list(time_ms ORDER BY time_ms) AS t, count(*) AS n FROM frames GROUP BY 1)
  SELECT source_id, unnest(CASE WHEN n <= 20 THEN t ELSE list_transform(range(0, 20), lambda i: t[CAST(floor(i * (n - 1) / 19.0::DOUBLE + 0.5) AS BIGINT) + 1]) END) AS time_ms FROM l""")
def pts_downsample(spark, sf):
    t = A.event_frames(spark, sf).groupBy("source_id").agg(F.array_sort(F.collect_list("time_ms")).alias("t"))
    return t.select("source_id", F.explode(sampling.downsampled(F.col("t"), 20)).alias("time_ms"))


@query("estimate_rows", f"""WITH {SPANS} SELECT source_id, CASE WHEN d <= 0 THEN 0 ELSE CAST({_N.format('d * 2.5')} AS INTEGER) END AS all_rows, CASE WHEN d <= 0 THEN 0 ELSE CAST({_N.format('d / 20')} AS INTEGER) END AS every_rows,
  CASE WHEN d <= 0 THEN 0 ELSE CAST({_N.format('d * (1 / 0.5)')} AS INTEGER) END AS fps_rows, 7 AS count_rows FROM spans""")
def estimate_rows(spark, sf):
    d, fps = F.col("duration_sec"), F.col("fps")
    e = lambda s, name, **k: sampling.estimate(s, d, fps, **k).cast("int").alias(name)
    return _spans(spark, sf).select("source_id", e("all", "all_rows"), e("every", "every_rows", every=20.0), e("fps", "fps_rows", every=0.5), e("count", "count_rows", count=7))


# Names and media facts

@query("filename_template", """SELECT p_partkey AS id, trim(regexp_replace(regexp_replace(p_name || '_' || printf('%04d', p_size) || '_' || printf('%02dm%02ds%02d', ms // 60000, (ms % 60000 + 5) // 10 // 100, (ms % 60000 + 5) // 10 % 100) || '_'
  || ms || '_01_{x}', '[\\\\/:*?"<>|]', '-', 'g'), '\\s+', ' ', 'g')) AS name FROM (SELECT *, p_partkey * 977 % 600000 AS ms FROM part)""")
def filename_template(spark, sf):
    p = A.table(spark, sf, "part")
    name = naming.render("{source}_{index}_{time}_{ms}_{scene}_{x}", F.col("p_name"), F.col("p_size"), F.col("p_partkey") * 977 % 600000)
    return p.select(F.col("p_partkey").alias("id"), name.alias("name"))


@query("unique_names", """SELECT p_partkey AS id, p_type || CASE WHEN n = 1 THEN '' ELSE '_' || n END AS name FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_type) ORDER BY p_partkey) AS n FROM part)""")
def unique_names(spark, sf):
    p = A.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("name"))
    return naming.with_unique(p, "name", ["id"])


@query("source_slugs", """WITH s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '([^/\\\\]*)$', 1), '\\.[^.]+$', ''), '[^a-zA-Z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS x FROM pages),
  t AS (SELECT page_id, CASE WHEN x = '' THEN 'video' ELSE x END AS x FROM s), u AS (SELECT *, row_number() OVER (PARTITION BY lower(x) ORDER BY page_id) AS n FROM t)
  SELECT page_id AS id, x || CASE WHEN n = 1 THEN '' ELSE '-' || n END AS slug FROM u""")
def source_slugs(spark, sf):
    p = A.table(spark, sf, "pages").select(F.col("page_id").alias("id"), naming.slug(F.col("url")).alias("slug"))
    return naming.with_unique(p, "slug", ["id"], "-")


@query("parse_fps", """SELECT p_partkey AS id, round(CASE WHEN p_size % 5 = 0 THEN 0 WHEN p_size % 7 = 0 THEN p_size * 1000 ELSE p_size * 1000 / (p_size % 5 * 1001.0::DOUBLE) END, 6) AS fps FROM part""")
def parse_fps(spark, sf):
    p = A.table(spark, sf, "part")
    n, d = (F.col("p_size") * 1000).cast("string"), (F.col("p_size") % 5 * 1001).cast("string")
    rate = F.when(F.col("p_size") % 5 == 0, F.concat(n, F.lit("/0"))).when(F.col("p_size") % 7 == 0, n).otherwise(F.concat(n, F.lit("/"), d))
    return p.select(F.col("p_partkey").alias("id"), r6(media.parse_fps(rate), "fps"))


@query("display_dimensions", """SELECT p_partkey AS id, CASE WHEN p_size % 2 = 1 THEN 1080 ELSE 1920 END AS width, CASE WHEN p_size % 2 = 1 THEN 1920 ELSE 1080 END AS height FROM part""")
def display_dimensions(spark, sf):
    p = A.table(spark, sf, "part")
    size = media.display_size(F.lit(1920), F.lit(1080), F.col("p_size") * -90.0)
    return p.select(F.col("p_partkey").alias("id"), size["width"].alias("width"), size["height"].alias("height"))


@query("class_dimension", "SELECT class_id, CASE WHEN class_id = 0 THEN 'people' WHEN class_id BETWEEN 1 AND 8 THEN 'vehicles' WHEN class_id BETWEEN 14 AND 23 THEN 'animals' "
       "WHEN class_id BETWEEN 24 AND 28 OR class_id BETWEEN 39 AND 55 OR class_id BETWEEN 62 AND 70 OR class_id BETWEEN 72 AND 79 THEN 'products' END AS \"group\" FROM (SELECT CAST(i AS INTEGER) AS class_id FROM range(0, 80) t(i))")
def class_dimension(spark, sf):
    return T.dimension(spark).select("class_id", "group")


# Boxes and detector output

_BOXES = """boxes AS (SELECT l_orderkey AS id, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_extendedprice AS e, l_quantity / 100.0 AS x, (l_partkey % 50) / 100.0::DOUBLE AS y, 0.2 + l_quantity / 200.0 AS w, 0.3::DOUBLE AS h,
  1 - l_discount * 10 AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem)"""
_OVER = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"


def _boxes(spark, sf):
    l = A.table(spark, sf, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(F.col("l_discount") + 0.0, "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    box = F.struct((F.col("l_quantity") / 100.0).alias("x"), (F.col("l_partkey") % 50 / 100.0).alias("y"), (F.col("l_quantity") / 200.0 + 0.2).alias("width"), F.lit(0.3).alias("height"))
    return l.select(F.col("l_orderkey").alias("id"), F.row_number().over(w).alias("r"), box.alias("box"))


@query("iou_pairs", f"WITH {_BOXES} SELECT a.id, a.r AS r1, b.r AS r2, round(o / (a.w * a.h + b.w * b.h - o), 6) AS iou FROM (SELECT a, b, {_OVER} AS o FROM boxes a JOIN boxes b ON a.id = b.id AND a.r < b.r) WHERE o > 0")
def iou_pairs(spark, sf):
    b = _boxes(spark, sf)
    l, r = b.select("id", F.col("r").alias("r1"), F.col("box").alias("a")), b.select("id", F.col("r").alias("r2"), F.col("box").alias("b"))
    p = l.join(r, "id").where("r1 < r2").withColumn("iou", vision.box_iou(F.col("a"), F.col("b"))).where("iou > 0")
    return p.select("id", F.col("r1").cast("long").alias("r1"), F.col("r2").cast("long").alias("r2"), r6(F.col("iou"), "iou"))


@query("nms_keep", f"""WITH RECURSIVE {_BOXES}, n AS (SELECT id, max(r) AS m FROM boxes GROUP BY 1), walk AS (SELECT id, 0::BIGINT AS r, []::BIGINT[] AS kept FROM n
  UNION ALL SELECT k.id, k.r + 1, CASE WHEN EXISTS (SELECT 1 FROM boxes a, boxes b WHERE a.id = k.id AND b.id = k.id AND b.r = k.r + 1 AND list_contains(k.kept, a.r) AND {_OVER} / (a.w * a.h + b.w * b.h - {_OVER}) >= 0.45)
  THEN k.kept ELSE list_append(k.kept, k.r + 1) END FROM walk k JOIN n ON n.id = k.id AND k.r < n.m) SELECT k.id, unnest(k.kept) AS r FROM walk k JOIN n ON n.id = k.id AND n.m = k.r""")
def nms_keep(spark, sf):
    b = _boxes(spark, sf).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("r", "box"))).alias("boxes"))
    return b.select("id", F.explode(vision.suppressed(F.col("boxes"))).alias("k")).select("id", F.col("k.r").cast("long").alias("r"))


@query("yolox_decode", f"""WITH v AS (SELECT vec_id, CAST(vec_id % 3549 AS INTEGER) AS c FROM embeddings), g AS (SELECT vec_id, CASE WHEN c < 2704 THEN c % 52 WHEN c < 3380 THEN (c - 2704) % 26 ELSE (c - 3380) % 13 END AS x,
  CASE WHEN c < 2704 THEN c // 52 WHEN c < 3380 THEN (c - 2704) // 26 ELSE (c - 3380) // 13 END AS y, CASE WHEN c < 2704 THEN 8 WHEN c < 3380 THEN 16 ELSE 32 END AS s FROM v),
  b AS (SELECT vec_id, (x + 0.5) * s / 0.65::DOUBLE AS cx, (y + 0.5) * s / 0.65::DOUBLE AS cy, exp(0.5::DOUBLE) * s / 0.65::DOUBLE AS e FROM g),
  o AS (SELECT vec_id, least(1, greatest(0, (cx - e / 2) / 640)) AS x0, least(1, greatest(0, (cy - e / 2) / 360)) AS y0, least(1, greatest(0, (cx + e / 2) / 640)) AS x1, least(1, greatest(0, (cy + e / 2) / 360)) AS y1 FROM b)
  SELECT vec_id, CAST(vec_id % 80 AS INTEGER) AS class_id, {list(T.CLASS_NAMES)}[vec_id % 80 + 1] AS class_name, 0.72::DOUBLE AS confidence,
  round(x0 + 1e-9, 6) AS x, round(y0 + 1e-9, 6) AS y, round(x1 - x0 + 1e-9, 6) AS width, round(y1 - y0 + 1e-9, 6) AS height FROM o""")
def yolox_decode(spark, sf):
    v = A.table(spark, sf, "embeddings")
    cells = vision.cell_count()
    # One cell with an object for each vector, at a place and of a class that follow from its id; a second
    # one beside it, less sure and of the same class, overlaps and goes.
    place = (F.col("vec_id") % cells).cast("int")
    cell = lambda sure, x=0.5: F.transform(F.sequence(F.lit(0), F.lit(84)), lambda i: F.when(i == 0, F.lit(x)).when(i < 4, F.lit(0.5)).when(i == 4, sure).when(i - 5 == F.col("vec_id") % 80, 0.8).otherwise(0.1).cast("float"))
    none = lambda n: F.array_repeat(F.lit(0.0).cast("float"), n * 85)
    twin = (place % 13 < 12) & (place < cells - 1)  # not at the end of a row
    raw = F.concat(none(place), cell(0.9), F.when(twin, F.concat(cell(0.8, -0.3), none(cells - 2 - place))).otherwise(none(cells - 1 - place)))
    d = v.select("vec_id", vision.detections_of(raw, F.lit(640), F.lit(360)).alias("d"))
    box = [r6(F.col(f"d.box.{n}") + 1e-9, n) for n in ("x", "y", "width", "height")]
    return d.select("vec_id", F.explode("d").alias("d")).select("vec_id", "d.class_id", "d.class_name", r6(F.col("d.confidence"), "confidence"), *box)


@query("text_regions", f"""WITH RECURSIVE {GRIDS}, cell AS (SELECT id, i, CAST(grid[i + 1] AS FLOAT) > CAST(0.55 AS FLOAT) AS up FROM (SELECT id, grid, unnest(range(0, 64)) AS i FROM grids)),
  m AS (SELECT id, i FROM cell WHERE up), step AS (SELECT a.id, a.i, b.i AS j FROM m a JOIN m b ON a.id = b.id AND (abs(a.i - b.i) = 8 OR (abs(a.i - b.i) = 1 AND a.i // 8 = b.i // 8))),
  reach AS (SELECT id, i, i AS j FROM m UNION SELECT r.id, r.i, s.j FROM reach r JOIN step s ON s.id = r.id AND s.i = r.j),
  region AS (SELECT id, low, count(*) AS n FROM (SELECT id, i, min(j) AS low FROM reach GROUP BY 1, 2) GROUP BY 1, 2),
  t AS (SELECT id, count(*) AS n FROM region WHERE n >= 4 GROUP BY 1), cov AS (SELECT id, count(*) FILTER (up) / 64.0::DOUBLE AS coverage FROM cell GROUP BY 1)
  SELECT id, coalesce(n, 0) > 0 AS has_text, round(coverage, 6) AS coverage, CAST(coalesce(n, 0) AS INTEGER) AS region_count FROM cov LEFT JOIN t USING (id)""")
def text_regions(spark, sf):
    t = A.grids(spark, sf).select("id", vision.text_of(F.transform("grid", lambda x: x.cast("float")), F.lit(8), F.lit(8), 4, 0.55).alias("t"))
    return t.select("id", "t.has_text", r6(F.col("t.coverage"), "coverage"), "t.region_count")


@query("incomplete_sources", f"""WITH {FRAMES} SELECT source_id, CASE WHEN bool_or("index" % 50 = 49) THEN 'TEXT_VISION_BLOCKED' ELSE 'VISION_NOT_READY' END AS code FROM frames
  GROUP BY 1 HAVING bool_or("index" % 50 = 49) OR bool_or(id % 40 = 0)""")
def incomplete_sources(spark, sf):
    """Sources that refuse a question for persons without text, whatever their frames' quality."""
    f = A.event_frames(spark, sf).withColumn("detections", F.when(F.col("id") % 40 != 0, F.col("detections")))
    f = f.withColumn("text", F.when(F.col("index") % 50 != 49, F.struct(F.lit(False).alias("has_text"), F.lit(0.0).alias("coverage"))))
    return S.incomplete(f, S.SelectOptions(with_=("person",), without_text=True, min_quality=0.4), "source_id")


@query("completeness_check", f"WITH {FRAMES} SELECT source_id, coalesce(bool_and(exposure IS NOT NULL AND id % 500 <> 0), false) AS complete FROM frames GROUP BY 1")
def completeness_check(spark, sf):
    f = A.event_frames(spark, sf)
    f = f.withColumn("detections", F.when(F.col("id") % 500 != 0, F.col("detections"))).withColumn("metrics", F.col("metrics").withField("hash", F.lit(None).cast("array<bigint>")))
    return S.complete_for(f, S.SelectOptions(with_=("person",)))


@query("reuse_threshold", "SELECT p_partkey AS id, p_size / 50.0::DOUBLE <= 0.4 AS reusable FROM part")
def reuse_threshold(spark, sf):
    p = A.table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), S.can_reuse(F.col("p_size") / 50.0, None).alias("reusable"))
