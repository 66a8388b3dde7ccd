"""Packing: optimal length buckets and token-budget batches.

A text's length is its words plus one end mark; lengths are counted in one pass over the texts and kept
as a table of the ids and lengths. One global histogram of lengths, counted
before the shuffle, goes to the driver: a row for each distinct length, of which there are
at most about the square root of twice all tokens. A dynamic program chooses at most `buckets` boundaries with the least padding in total
(lower hull of lines, in O(lengths * buckets)). Every text is padded to its bucket's
boundary, and a bucket's texts, in hashed order, form batches of as many as fit `budget`
padded tokens, but one at least. Ranks come from counts of strata and a window in each
stratum, so no task holds a whole bucket. Strata are by a hash of id, length and text: rows that share
an id, or have none, are in one only where their texts are equal, too.

Null and empty texts have length 1, the end mark. Repeated rows are packed each for itself.
An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from array import array

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyreel.llm.common import cut_table
from keyreel.llm.mixing import words

#: Hash strata at least; there are more of them for more rows, PER_STRATUM in each on average.
STRATA, PER_STRATUM = 1024, 100_000


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """The at most `buckets` lengths, the greatest among them, to pad to with the least padding."""
    order = np.argsort(lengths)
    l = [int(lengths[i]) for i in order]
    c = [int(counts[i]) for i in order]
    n = len(l)
    if not n:
        return []
    total = [0]
    for x in c:
        total.append(total[-1] + x)
    # Padded tokens of the first j lengths in k buckets: best[j] = min over i < j of best'[i] +
    # l[j - 1] * (total[j] - total[i]); lines in l[j - 1] of falling slope -total[i].
    best = [l[j - 1] * total[j] if j else 0 for j in range(n + 1)]
    choice = [array("q", bytes(8 * (n + 1)))]
    for k in range(1, min(buckets, n)):
        now, pick = [None] * (n + 1), array("q", bytes(8 * (n + 1)))
        hull: list[int] = []
        head = 0

        def value(i: int, x: int) -> int:
            return best[i] - x * total[i]

        def over(a: int, b: int, d: int) -> bool:
            """Whether line b is never below both a and d."""
            return (best[d] - best[a]) * (total[b] - total[a]) <= (best[b] - best[a]) * (total[d] - total[a])

        for j in range(k + 1, n + 1):
            i = j - 1  # the first i lengths take k buckets
            if best[i] is not None:
                while len(hull) - head >= 2 and over(hull[-2], hull[-1], i):
                    hull.pop()
                hull.append(i)
            x = l[j - 1]
            head = min(head, len(hull) - 1)
            while len(hull) - head >= 2 and value(hull[head + 1], x) <= value(hull[head], x):
                head += 1
            pick[j] = hull[head]
            now[j] = value(hull[head], x) + x * total[j]
        if now[n] is None or now[n] >= best[n] and k > 1 and now[n] == best[n]:
            break
        choice.append(pick)
        best = now
    out, j = [], n
    for pick in reversed(choice):
        out.append(l[j - 1])
        j = pick[j]
        if j == 0:
            break
    return sorted(out)


def histogram(lengths: DataFrame) -> tuple[list[int], list[int]]:
    """Distinct values of the column n and their counts."""
    rows = lengths.groupBy("n").agg(F.count("*").alias("c")).orderBy("n").toArrow()
    return rows.column("n").to_pylist(), rows.column("c").to_pylist()


def packed(docs: DataFrame, buckets: int = 16, budget: int = 65_536) -> DataFrame:
    """doc_id, n_tokens, bucket_len (padded length), padding, batch (within the bucket), slot."""
    d = cut_table(docs.select("doc_id", (words(F.col("text")) + 1).alias("n"), F.xxhash64(F.col("text").cast("string")).alias("t")))
    lengths, counts = histogram(d.select("n"))
    ends = boundaries(lengths, counts, buckets) or [1]
    size = F.lit(ends[-1])
    for e in reversed(ends[:-1]):
        size = F.when(F.col("n") <= e, F.lit(e)).otherwise(size)
    d = d.withColumn("bucket_len", size.cast("long")).withColumn("h", F.xxhash64("doc_id", "n", "t"))
    d = d.withColumn("s", F.pmod("h", F.lit(max(STRATA, sum(counts) // PER_STRATUM))).cast("int"))
    strata = d.groupBy("bucket_len", "s").agg(F.count("*").alias("c"))
    before = Window.partitionBy("bucket_len").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    strata = strata.select("bucket_len", "s", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("bucket_len", "s").orderBy("h", "doc_id", "n", "t")) - 1
    d = d.withColumn("rank", rank).join(strata, ["bucket_len", "s"])
    fit = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_len")))
    at = F.col("before") + F.col("rank")
    return d.select(
        "doc_id", F.col("n").alias("n_tokens"), "bucket_len", (F.col("bucket_len") - F.col("n")).alias("padding"),
        F.floor(at / fit).cast("long").alias("batch"), (at % fit).cast("long").alias("slot"),
    )
