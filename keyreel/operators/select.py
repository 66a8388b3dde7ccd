"""Frame selection: validated options, presets, predicates, ranking and reasons."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyreel.errors import FrameError
from keyreel.functions.taxonomy import resolve

RANKS = {"quality": "composite", "sharpness": "sharpness", "exposure": "exposure"}
MIN_CONFIDENCE = 0.4


@dataclass(frozen=True)
class SelectOptions:
    with_: tuple[str, ...] | None = None
    with_any: tuple[str, ...] | None = None
    without: tuple[str, ...] | None = None
    with_text: bool | None = None
    without_text: bool | None = None
    min_text_coverage: float | None = None
    max_text_coverage: float | None = None
    min_confidence: float | None = None
    min_quality: float | None = None
    rank: str | None = None
    dedupe: bool | None = None
    best_per_scene: int | None = None
    limit: int | None = None


# The named selections.
PRESETS = {
    "representative": SelectOptions(rank="quality", dedupe=True, best_per_scene=1),
    "storyboard": SelectOptions(rank="sharpness", dedupe=True, best_per_scene=1),
    "people": SelectOptions(with_=("person",), rank="sharpness", dedupe=True, best_per_scene=1),
}


def apply_preset(name: str, options: SelectOptions = SelectOptions()) -> SelectOptions:
    """The preset, with every option that is given (not None) in its place."""
    if name not in PRESETS:
        raise FrameError("USAGE", f"unknown preset {name!r}", f"available: {', '.join(PRESETS)}")
    return replace(PRESETS[name], **{f.name: v for f in fields(options) if (v := getattr(options, f.name)) is not None})


def validate(o: SelectOptions) -> None:
    def need(ok: bool, what: str) -> None:
        if not ok:
            raise FrameError("USAGE", what)

    need(o.rank is None or o.rank in RANKS, f"rank must be one of {', '.join(RANKS)}")
    need(o.min_confidence is None or 0.01 <= o.min_confidence <= 1, "min_confidence must be within 0.01 and 1")
    for name in ("min_quality", "min_text_coverage", "max_text_coverage"):
        v = getattr(o, name)
        need(v is None or 0 <= v <= 1, f"{name} must be within 0 and 1")
    if o.min_text_coverage is not None and o.max_text_coverage is not None:
        need(o.min_text_coverage <= o.max_text_coverage, "min_text_coverage is above max_text_coverage")
    for name in ("best_per_scene", "limit"):
        v = getattr(o, name)
        need(v is None or (isinstance(v, int) and not isinstance(v, bool) and v > 0), f"{name} must be a positive whole number")


def needs_detections(o: SelectOptions) -> bool:
    return bool(o.with_ or o.with_any or o.without)


def needs_text(o: SelectOptions) -> bool:
    return bool(o.with_text or o.without_text) or o.min_text_coverage is not None or o.max_text_coverage is not None


def has_class(term: str, confidence: float = MIN_CONFIDENCE, detections: str = "detections") -> Column:
    ids = F.array(*[F.lit(i) for i in resolve(term)])
    return F.exists(detections, lambda d: F.array_contains(ids, d["class_id"]) & (d["confidence"] >= confidence))


def predicate(o: SelectOptions) -> Column:
    """The conjunction of all conditions; terms are resolved once, to literals."""
    confidence = MIN_CONFIDENCE if o.min_confidence is None else o.min_confidence
    out = F.lit(True)
    if o.min_quality:
        out = out & (F.coalesce("metrics.composite", F.lit(0.0)) >= o.min_quality)
    for term in o.with_ or ():
        out = out & has_class(term, confidence)
    if o.with_any:
        some = F.lit(False)
        for term in o.with_any:
            some = some | has_class(term, confidence)
        out = out & some
    for term in o.without or ():
        out = out & ~has_class(term, confidence)
    if o.with_text:
        out = out & F.col("text.has_text")
    if o.without_text:
        out = out & ~F.col("text.has_text")
    if o.min_text_coverage is not None:
        out = out & (F.col("text.coverage") >= o.min_text_coverage)
    if o.max_text_coverage is not None:
        out = out & (F.col("text.coverage") <= o.max_text_coverage)
    return out


def incomplete(frames: DataFrame, o: SelectOptions, *by: str) -> DataFrame:
    """by, code: what keeps the options from being answered, where any frame lacks text or detections
    that they ask for. Such a frame is neither with nor without."""
    code = F.lit(None).cast("string")
    if needs_detections(o):
        code = F.when(F.bool_or(F.col("detections").isNull()), "VISION_NOT_READY").otherwise(code)
    if needs_text(o):
        code = F.when(F.bool_or(F.col("text").isNull()), "TEXT_VISION_BLOCKED").otherwise(code)
    return frames.groupBy(*by).agg(code.alias("code")).where("code is not null")


def filter_frames(frames: DataFrame, o: SelectOptions) -> DataFrame:
    """Frames that meet all conditions; an error if any frame, whether it meets the other conditions or
    not, lacks the detections or the text that are asked for. That is looked up right away."""
    validate(o)
    if needs_detections(o) or needs_text(o):
        found = incomplete(frames, o).first()
        if found:
            what = {"VISION_NOT_READY": "detections are missing", "TEXT_VISION_BLOCKED": "text analysis is missing"}
            raise FrameError(found.code, what[found.code], "analyse all frames for it first")
    return frames.where(predicate(o))


def score(rank: str | None) -> Column:
    return F.coalesce(F.col(f"metrics.{RANKS[rank or 'quality']}"), F.lit(0.0))


def _fixed3(x: Column) -> Column:
    """Three decimals; a score within 0 and 1 is exact enough in 30 digits, and halves round up."""
    return x.cast("decimal(38,30)").cast("decimal(30,3)").cast("string")


def reasons(o: SelectOptions) -> Column:
    def one(code: str, message: Column | str) -> Column:
        return F.struct(F.lit(code).alias("code"), (message if isinstance(message, Column) else F.lit(message)).alias("message"))

    out = []
    if o.with_:
        out.append(one("with", f"Matched required: {', '.join(o.with_)}"))
    if o.without_text:
        out.append(one("without-text", "No text detected"))
    if o.with_text:
        out.append(one("with-text", "Text present"))
    if o.dedupe:
        out.append(one("dedupe", "Not a perceptual duplicate"))
    if o.best_per_scene:
        out.append(one("best-per-scene", F.concat(F.lit(f"Top {o.best_per_scene} in scene "), F.coalesce("metrics.scene_index", F.lit(0)).cast("string"))))
    out.append(one("rank", F.concat(F.lit(f"Ranked by {o.rank or 'quality'}: "), _fixed3(score(o.rank)))))
    return F.array(*out)


def rank_and_reduce(frames: DataFrame, o: SelectOptions) -> DataFrame:
    """frames with pos and reasons: duplicates out, ranked by score (ties by time, then index), the
    best of each scene, then in time order, then the limit; each within its source."""
    validate(o)
    f = frames.withColumn("__score", score(o.rank))
    if o.dedupe:
        f = f.where(F.coalesce("metrics.duplicate_of_id", F.lit("")) == "")
    best_first = [F.desc("__score"), F.col("time_ms"), F.col("index")]
    order = best_first
    if o.best_per_scene:
        scene = Window.partitionBy("source_id", F.coalesce("metrics.scene_index", F.lit(0))).orderBy(*best_first)
        f = f.withColumn("__r", F.row_number().over(scene)).where(F.col("__r") <= o.best_per_scene).drop("__r")
        order = [F.col("time_ms"), F.col("index")]
    f = f.withColumn("pos", F.row_number().over(Window.partitionBy("source_id").orderBy(*order)))
    if o.limit:
        f = f.where(F.col("pos") <= o.limit)
    return f.withColumn("reasons", reasons(o)).drop("__score")


def select(frames: DataFrame, o: SelectOptions) -> DataFrame:
    """The selections table of all sources."""
    chosen = rank_and_reduce(filter_frames(frames, o), o)
    return chosen.select("source_id", "pos", F.col("id").alias("frame_id"), "time_ms", (F.col("time_ms") / 1000).alias("time_sec"), "reasons")


def echoed(o: SelectOptions) -> dict:
    """Filters and ranking as they are written beside selections."""
    d = {("with" if k == "with_" else k): v for k, v in asdict(o).items()}
    rank = ("rank", "dedupe", "best_per_scene", "limit")
    return {"filters": {k: v for k, v in d.items() if k not in rank}, "ranking": {**{k: d[k] for k in rank}, "rank": o.rank or "quality", "dedupe": bool(o.dedupe)}}


def complete_for(frames: DataFrame, o: SelectOptions) -> DataFrame:
    """source_id, complete: whether all frames have the columns that the options need."""
    ok = F.col("metrics.hash").isNotNull() | F.col("metrics.composite").isNotNull()
    if needs_detections(o):
        ok = ok & F.col("detections").isNotNull()
    if needs_text(o):
        ok = ok & F.col("text").isNotNull()
    return frames.groupBy("source_id").agg(F.coalesce(F.bool_and(F.coalesce(ok, F.lit(False))), F.lit(False)).alias("complete"))


def can_reuse(stored: float | Column | None, wanted: float | None) -> bool | Column:
    """Whether stored detections hold all that a threshold asks for; stored may be a column."""
    wanted = MIN_CONFIDENCE if wanted is None else wanted
    if isinstance(stored, Column):
        return F.coalesce(stored <= wanted, F.lit(False))
    return stored is not None and stored <= wanted
