"""Chat formatting: quotation linking.

A message's lines are parsed for nested quote marks (`>`, with single spaces between); lines
that only announce a quote ("... wrote:") go with it. Adjacent lines of one level form a passage; blank
ones divide passages. A passage is normalised (lower case, white space to one space,
trimmed) and hashed. The paragraphs and the single lines of the unquoted part of every message are
hashed alike. A quoted passage belongs to the latest earlier message of its conversation
that has it unquoted as a paragraph or line, or else to the latest that holds all of its lines,
each as a run of words in an unquoted paragraph: so trimmed and rewrapped quotes link as well. A message answers the one that its outermost linked passages
belong to, the latest of these. From the links the conversation's reply trees are built
by doubling: each round, a message takes over the ancestor that the ancestor it knows knows, and adds the
distances. A message so gets its tree's first message and its depth in it, whatever the length of
the chain, not a list of all ancestors. Rows are range-sorted by conversation, tree, depth and turn: answers follow
what they answer, level by level.

Only SQL functions are used. Quotes look for messages by a union and a window of one
conversation and passage, without a row for every pair. Runs of words are found by their first
ANCHOR words, once for each distinct paragraph of a conversation, and then by their hash; a passage of
several lines is sought among the messages that hold the rarest of them. A text's lines are worked out
once and read by place, so the time grows with the text's length, however many lines, marks or
announcements it has.

Null or empty texts have no line: clean_text is empty. A null conv_id or turn links with
nothing. Repeated rows of one (conv_id, turn) are one message with several texts: each row
comes out, all with the same parent. Quotes of nothing known are removed, too,
and counted in n_quotes only. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyreel.llm.common import cut, join_counted, let

_MARKS = r"^[\x20\t]?(?:>[\x20\t]?)+"
_ANNOUNCES = r"(?:wrote|writes|said|schrieb|escribió|a écrit)\s*:\s*$"

ANCHOR = 4  # words by which a quoted line is sought


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _parsed(text: Column) -> Column:
    """array<struct<depth, body>>: the lines, with their level of quotation."""
    lines = F.split(F.coalesce(text.cast("string"), F.lit("")), r"\r?\n")
    return F.transform(lines, lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 0), "[^>]", "")).alias("depth"),
        F.regexp_replace(x, _MARKS, "").alias("body"),
    ))


def _marked(lines: Column) -> Column:
    """Lines without the announcements right before a quote."""

    def rest(v: Column) -> Column:
        return F.filter(v, lambda x, i: ~((x["depth"] == 0) & F.rlike(x["body"], F.lit(_ANNOUNCES)) & (F.coalesce(F.get(v, i + 1)["depth"], F.lit(0)) > 0)))

    return let(lines, rest)


def _passages(lines: Column) -> Column:
    """array<struct<depth, body>>: adjacent lines of one level joined by line ends; blank lines divide."""
    blank = lambda x: F.rlike(x["body"], F.lit(r"^\s*$"))
    none = F.expr("cast(array() as array<struct<depth:int,body:string>>)")

    def of(v: Column) -> Column:
        def begins(i: Column) -> Column:
            x, before = F.get(v, i), F.get(v, i - 1)
            return ~blank(x) & ((i == 0) | blank(before) | (before["depth"] != x["depth"]))

        def joined(starts: Column) -> Column:
            def one(i: Column, k: Column) -> Column:
                run = F.slice(v, i + 1, F.coalesce(F.get(starts, k + 1), F.size(v)) - i)
                return F.struct(F.get(v, i)["depth"].alias("depth"), F.array_join(F.transform(F.filter(run, lambda x: ~blank(x)), lambda x: x["body"]), "\n").alias("body"))

            return F.transform(starts, one)

        return F.when(F.size(v) > 0, let(F.filter(F.sequence(F.lit(0), F.size(v) - 1), begins), joined)).otherwise(none)

    return let(lines, of)


def _hash(body: Column) -> Column:
    return F.sha2(_normal(body).cast("binary"), 256)


def _held(lines: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """conv_id, turn, l: the messages that hold a quoted line, of lines (conv_id, l, body) and paragraphs
    (conv_id, turn, body); bodies are normalised."""
    words = F.split("body", " ")
    lines = lines.select("conv_id", "l", F.size(words).alias("n"), F.least(F.size(words), F.lit(ANCHOR)).alias("a"), words.alias("w"))
    lines = lines.withColumn("x", F.xxhash64(F.slice("w", F.lit(1), F.col("a"))))
    sizes = lines.groupBy("conv_id").agg(F.collect_set("a").alias("as"))
    p = paragraphs.withColumn("k", F.sha2(F.col("body").cast("binary"), 256))
    texts = cut(p.dropDuplicates(["conv_id", "k"]).join(sizes, "conv_id").select("conv_id", "k", words.alias("w"), "as"))
    at = texts.select("conv_id", "k", "w", F.explode("as").alias("a")).where("size(w) >= a")
    at = at.select("conv_id", "k", "a", F.posexplode(F.expr("transform(sequence(1, size(w) - a + 1), i -> xxhash64(slice(w, i, a)))")).alias("i", "x"))
    wanted = lines.groupBy("conv_id", "a", "x").agg(F.collect_set("n").alias("ns"))
    hits = at.join(wanted, ["conv_id", "a", "x"]).groupBy("conv_id", "k").agg(F.collect_list(F.struct("i", "ns")).alias("hits"))
    runs = hits.join(texts, ["conv_id", "k"]).select("conv_id", "k", "w", F.explode("hits").alias("hit")).select("conv_id", "k", "w", "hit.i", F.explode("hit.ns").alias("n"))
    runs = runs.where("i + n <= size(w)").select("conv_id", "k", F.sha2(F.array_join(F.slice("w", F.col("i") + 1, F.col("n")), " ").cast("binary"), 256).alias("l")).distinct()
    runs = runs.join(lines.select("conv_id", "l"), ["conv_id", "l"], "left_semi")
    return runs.join(p.select("conv_id", "turn", "k").distinct(), ["conv_id", "k"]).select("conv_id", "turn", "l").distinct()


def _holders(passages: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """conv_id, turn, h: the messages that hold all lines of a passage, of passages (conv_id, h, body)."""
    parts = F.array_distinct(F.filter(F.transform(F.split("body", "\n"), _normal), lambda x: x != ""))
    parts = cut(passages.select("conv_id", "h", F.explode(parts).alias("body")).withColumn("l", _hash(F.col("body"))))
    held = cut(_held(parts.select("conv_id", "l", "body").distinct(), paragraphs))
    count = held.groupBy("conv_id", "l").agg(F.count("*").alias("c"))
    rare = parts.join(count, ["conv_id", "l"], "left").groupBy("conv_id", "h").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "l")).alias("r"), F.count("*").alias("m"))
    found = rare.where("r.c > 0").select("conv_id", "h", "m", F.col("r.l").alias("l")).join(held, ["conv_id", "l"]).select("conv_id", "h", "m", "turn")
    every = found.join(parts.select("conv_id", "h", "l"), ["conv_id", "h"]).join(held, ["conv_id", "l", "turn"])
    return every.groupBy("conv_id", "h", "turn", "m").agg(F.count("*").alias("c")).where("c = m").select("conv_id", "turn", "h")


def _latest(quoted: DataFrame, source: DataFrame) -> DataFrame:
    """quoted with parent: the latest earlier turn of source (conv_id, turn, h)."""
    both = quoted.select("conv_id", "h", "turn", "depth", "n", "body", F.lit(None).cast("long").alias("at")).unionByName(
        source.select("conv_id", "h", "turn", F.col("turn").alias("at")), allowMissingColumns=True
    )
    before = Window.partitionBy("conv_id", "h").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    return both.withColumn("parent", F.max("at").over(before)).where("depth is not null").drop("at")


def _trees(parents: DataFrame) -> DataFrame:
    """parents (conv_id, turn, parent, n_linked) with root and depth; the known ancestor's distance doubles."""
    t = parents.select("conv_id", "turn", F.col("parent").alias("up"), F.lit(1).cast("long").alias("far"))
    while True:
        n = t.count()
        above = t.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("far").alias("far2"))
        many = t.groupBy("conv_id", "up").agg(F.count("*").alias("n")).join(above, ["conv_id", "up"], "left")
        grown = join_counted(t, many, ["conv_id", "up"], n, how="left")
        t = cut(grown.select("conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"), F.col("up2").isNotNull().alias("moved")))
        if t.where("moved").isEmpty():
            break
        t = t.drop("moved")
    return parents.join(t.select("conv_id", "turn", F.col("up").alias("root"), F.col("far").alias("depth")), ["conv_id", "turn"])


def linked(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, clean_text, n_quotes, n_linked, parent_turn, root_turn (first message of the
    tree), depth (answers between that one and this), sorted by conv_id, root_turn, depth and turn."""
    m = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), _marked(_parsed(F.col("text"))).alias("lines"))
    has = F.exists("lines", lambda x: x["depth"] > 0)
    quoted = m.where(has).select("conv_id", "turn", F.explode(_passages(F.col("lines"))).alias("p")).where("p.depth > 0")
    quoted = quoted.select("conv_id", "turn", F.col("p.depth").alias("depth"), _hash(F.col("p.body")).alias("h"), F.col("p.body").alias("body"))
    quoted = cut(quoted.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).groupBy("conv_id", "turn", "h", "body").agg(F.min("depth").alias("depth"), F.count("*").alias("n")))
    own = F.filter("lines", lambda x: x["depth"] == 0)
    bodies = F.concat(F.transform(_passages(own), lambda p: p["body"]), F.transform(own, lambda x: x["body"]))
    source = m.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    source = source.join(quoted.select("conv_id").distinct(), "conv_id", "left_semi")
    hashed = source.select("conv_id", "turn", F.explode(bodies).alias("b")).where(_normal(F.col("b")) != "").select("conv_id", "turn", _hash(F.col("b")).alias("h")).distinct()
    whole = _latest(quoted, hashed.join(quoted.select("conv_id", "h").distinct(), ["conv_id", "h"], "left_semi"))
    whole = cut(whole)
    found, rest = whole.where("parent is not null"), whole.where("parent is null")
    if not rest.isEmpty():
        # By lines: a passage is known by its hash and its lines, as equal ones may be wrapped differently.
        rest = cut(rest.drop("parent").withColumn("h", F.sha2(F.col("body").cast("binary"), 256)))
        own_paragraphs = F.transform(_passages(own), lambda p: _normal(p["body"]))
        paragraphs = source.join(rest.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", F.explode(own_paragraphs).alias("body")).where("body <> ''")
        part = _holders(rest.select("conv_id", "h", "body").distinct(), paragraphs)
        found = found.unionByName(_latest(rest, part).where("parent is not null"))
    # The outermost linked passages decide, and of their messages the latest.
    parents = cut(found.groupBy("conv_id", "turn").agg(F.min(F.struct("depth", (-F.col("parent")).alias("p"))).alias("x"), F.sum("n").alias("n_linked")).select("conv_id", "turn", (-F.col("x.p")).alias("parent"), "n_linked"))
    tree = _trees(parents)
    counts = F.size(F.filter(_passages(F.col("lines")), lambda p: p["depth"] > 0))
    clean = F.regexp_replace(F.array_join(F.transform(own, lambda x: x["body"]), "\n"), r"\n{3,}", "\n\n")
    out = m.select("conv_id", "turn", "role", F.when(has, F.regexp_replace(clean, r"^\s+|\s+$", "")).otherwise(clean).alias("clean_text"), F.when(has, counts).otherwise(0).cast("long").alias("n_quotes"))
    out = out.join(tree, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "clean_text", "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("parent").alias("parent_turn"), F.coalesce("root", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )
    return out.orderBy("conv_id", "root_turn", "depth", "turn")
