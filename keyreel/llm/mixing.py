"""Mixing sources to target weights with a time-varying curriculum.

Sizes are words, `[^\\x20\\x09-\\x0D]+`. Sources by code point, null last, get the weights 1, 2, 3,
1, ...; they share the sum of all sizes by weight, but a target stops at `repeats` times its
source's size and the excess goes to the others by weight. A source's stream is its
documents in the order of md5 of the id and then of size, over and over, cut at the target; so a document is taken
floor(target / source size) times, and those before the cut once more (the one at the cut
in part). The stream's running totals come from totals of hash strata, then a window in
each stratum: no window holds a whole source. Rows without an id, whose hashes are equal, have
strata by size.

The curriculum: source s is drawn with the density (1 - p) * start + p * end at the position
p in 0..1 of training. Its integral is the share of s's stream used up to p; inverting the
quadratic gives the position of each offset in the stream. Rows are range-sorted by it.

Null texts have size 0, as have empty ones; documents and sources of size 0 take nothing and
have position null. Null sources are one source, the last. Repeated rows are documents of
their own; with equal ids and sizes their order in the stream may swap, the result not.
An empty table gives an empty result. Other columns are kept by mixed().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of the hash that name a stratum: strata in order are the hash in order.
STRATUM_DIGITS = 3
#: The hash of null and empty ids.
NO_ID = "d41d8cd98f00b204e9800998ecf8427e"
#: start and end of the draw densities of the sources of weight 1, 2 and 3
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def targets(sources: DataFrame, repeats: float = 3.0) -> DataFrame:
    """source, source_size (a row for each) with weight, start, end and target.

    In the order of repeats * size / weight, the sources that stop are a prefix: with the
    first k stopped, the rest share what is left at the rate (all - stopped) / weights left.
    Stopping a source that the rate is too high for raises it, stopping another lowers it,
    so the true rate is the greatest."""
    everything = Window.partitionBy()
    s = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    s = s.withColumn("weight", (F.col("rank") - 1) % 3 + 1).withColumn("top", F.col("source_size") * F.lit(repeats))
    before = Window.orderBy(F.col("top") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.col("top") / F.col("weight"), "rank").rowsBetween(0, Window.unboundedFollowing)
    rate = (F.sum("source_size").over(everything) - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("rate", rate)
    s = s.withColumn("level", F.max("rate").over(everything))
    pick = lambda i: F.element_at(F.array(*[F.lit(float(x[i])) for x in SCHEDULES]), F.col("weight").cast("int"))
    return s.select(
        "source", "source_size", F.col("weight").cast("int").alias("weight"), pick(0).alias("start"), pick(1).alias("end"),
        F.least(F.col("top"), F.coalesce(F.col("level") * F.col("weight"), F.col("top"))).cast("double").alias("target"),
    )


def position(share: Column, start: Column, end: Column) -> Column:
    """The p at which the integral of (1 - p) * start + p * end reaches `share` of the whole."""
    slope = end - start
    return F.when(slope == 0, share).otherwise((F.sqrt(F.greatest(start * start + slope * (start + end) * share, F.lit(0.0))) - start) / F.when(slope == 0, F.lit(1.0)).otherwise(slope))


def stratum(h: Column, size: Column) -> Column:
    """Strata that sort like (h, size): the first digits of h, but NO_ID's, which many rows may
    have, is one for each size, and hashes above it with its first digits have their own."""
    digits = F.substring(h, 1, STRATUM_DIGITS)
    beyond = (digits == NO_ID[:STRATUM_DIGITS]) & (h > NO_ID)
    return F.when(h == NO_ID, F.concat(h, F.lpad(size.cast("string"), 20, "0"))).when(beyond, F.concat(digits, F.lit("~"))).otherwise(digits)


def planned(docs: DataFrame, repeats: float = 3.0) -> DataFrame:
    """docs with struct columns __size, __plan(source_size, target, taken, full, offset, part, start, end)."""
    d = docs.withColumn("__size", words(F.col("text"))).withColumn("__h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    d = d.withColumn("__s", stratum(F.col("__h"), F.col("__size"))).withColumn("__src", F.col("source").cast("string"))
    strata = d.groupBy("__src", "__s").agg(F.sum("__size").alias("sum"))
    sources = strata.groupBy(F.col("__src").alias("source")).agg(F.sum("sum").alias("source_size"))
    plan = targets(sources, repeats)
    # A row for each source and stratum, as large as the documents at most.
    before = Window.partitionBy("__src").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    strata = strata.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0))).drop("sum")
    strata = strata.join(plan, F.col("__src").eqNullSafe(F.col("source"))).drop("source")
    strata = strata.withColumnRenamed("__src", "__src2").withColumnRenamed("__s", "__s2")
    strata = strata.select("__src2", "__s2", F.struct("before", "source_size", "target", "start", "end").alias("__b"))
    own = Window.partitionBy("__src", "__s").orderBy("__h", "doc_id", "__size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__in", F.coalesce(F.sum("__size").over(own), F.lit(0)))
    d = d.join(strata, (F.col("__s") == F.col("__s2")) & F.col("__src").eqNullSafe(F.col("__src2")))
    goal = F.floor(F.col("__b.target") + F.lit(0.5)).cast("long")
    full = F.when(F.col("__b.source_size") > 0, F.floor(goal / F.col("__b.source_size"))).otherwise(0).cast("long")
    full = F.least(full, F.lit(int(repeats)).cast("long"))
    offset = F.col("__b.before") + F.col("__in")
    part = F.greatest(F.lit(0), F.least(F.col("__size"), goal - full * F.col("__b.source_size") - offset)).cast("long")
    part = F.when(full >= int(repeats), F.lit(0)).otherwise(part).cast("long")
    share = F.when((F.col("__size") > 0) & (goal > 0), offset / goal)
    return d.withColumn(
        "__plan",
        F.struct(
            F.col("__b.source_size").alias("source_size"), F.col("__b.target").alias("target"), (full * F.col("__size") + part).alias("taken"),
            full.alias("full"), part.alias("part"), goal.alias("goal"), offset.alias("offset"), F.col("__b.start").alias("start"), F.col("__b.end").alias("end"), share.alias("share"),
        ),
    ).drop("__h", "__s", "__src", "__in", "__b", "__s2", "__src2")


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and the position of the first copy (to 9 places), sorted by it."""
    p = planned(docs.select("doc_id", "source", "text"))
    at = F.when(F.col("__plan.taken") > 0, position(F.col("__plan.share"), F.col("__plan.start"), F.col("__plan.end")))
    out = p.select("doc_id", F.col("__size").alias("size"), "__plan.source_size", "__plan.target", "__plan.taken", F.abs(F.round(at, 9)).alias("position"))
    return out.orderBy("position", "doc_id")


def mixed(docs: DataFrame, repeats: float = 3.0) -> DataFrame:
    """The training order: a row for each copy that the mix takes, the columns those of docs.

    The copy at a source's cut has its first words only, joined by spaces."""
    cols = docs.columns
    p = planned(docs, repeats)
    copies = F.expr("case when __size > 0 then __plan.full + if(__plan.part > 0, 1, 0) else 0 end").cast("int")
    p = p.withColumn("__n", copies).where("__n > 0")
    p = p.withColumn("__e", F.explode(F.expr("sequence(0, __n - 1)")))
    share = F.least(F.lit(1.0), (F.col("__e") * F.col("__plan.source_size") + F.col("__plan.offset")) / F.col("__plan.goal"))
    p = p.withColumn("__at", position(share, F.col("__plan.start"), F.col("__plan.end")))
    short = (F.col("__e") == F.col("__plan.full")) & (F.col("__plan.part") < F.col("__size"))
    cut = F.array_join(F.slice(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), F.lit(1), F.col("__plan.part").cast("int")), " ")
    p = p.withColumn("text", F.when(short, cut).otherwise(F.col("text")))
    if "n_chars" in cols:
        p = p.withColumn("n_chars", F.when(short, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return p.orderBy("__at", "doc_id", "__e").select(*[F.col(f"`{c}`") for c in cols])
