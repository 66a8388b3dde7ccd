"""Language identification by prediction by partial matching over bytes.

Each language's training text gives counts of bytes after contexts of up to `order` bytes.
A byte seen after its context costs -log2(n / (total + distinct)); the escape mass
distinct / (total + distinct) goes to the other bytes, in proportion to what the context
without its first byte gives them (for the empty context: evenly). The counts are frozen.
The trees of all languages are one sparse table: a row for each (context, byte) that any
language has seen, with every language's code length, and a row for each context with
what an escape from it costs. A byte is looked up after its longest context, and after shorter ones
at the cost of the escapes, until it is found. The language with the shortest code is predicted; `score` is its share of 2 ** -bits.

fit() learns from at most `sample` rows of each language, those of the smallest hashed ids,
and from at most `most` rows in all, of which every language gets the same number as far as it
has them. These are the documented bounds of its input; all languages and all counts of these rows
are in the model.

Predicted is `und`, score 0, for texts that are null or have no letter, and for all texts
when nothing could be learned. Rows with a null language or text are not learned from.
Repeated rows get equal results. Only id, text and lang are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyreel.llm.common import crc_mod
from keyreel.llm.textbytes import buffers, pieces

PIECE = 1 << 20
#: Tasks whose ranks are drawn together at a time, and how often.
FAN_IN, STEPS = 16, 3


def _count(order: int):
    """lang, k (bytes of context), gram (context and byte, big-endian), n by task."""

    def run(batches):
        held: dict[tuple[str, int], dict[int, int]] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            buf, off = buffers(batch.column(1))
            for i, lang in enumerate(langs):
                x = buf[off[i] : off[i + 1]].astype(np.uint64)
                for k in range(order + 1):
                    if len(x) > k:
                        g = np.zeros(len(x) - k, np.uint64)
                        for j in range(k + 1):
                            g = g << np.uint64(8) | x[j : len(x) - k + j]
                        own = held.setdefault((lang, k), {})
                        for v, c in zip(*(a.tolist() for a in np.unique(g, return_counts=True))):
                            own[v] = own.get(v, 0) + c
        rows = [(lang, k, v, c) for (lang, k), own in held.items() for v, c in own.items()]
        if rows:
            a, b, c, d = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.int32()), pa.array(c, pa.int64()), pa.array(d, pa.int64())], ["lang", "k", "gram", "n"])

    return run


class _Find:
    """Places of distinct 64-bit keys: a hash table for the first keys of its slots, another one for the rest."""

    def __init__(self, keys: np.ndarray):
        self.tables = []
        at = np.arange(len(keys))
        odd = 0x9E3779B97F4A7C15
        while True:
            bits = max(4, int(8 * len(at)).bit_length())
            slot = self._slot(keys[at], odd, bits)
            _, first = np.unique(slot, return_index=True)
            key, place, more = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32), np.zeros(1 << bits, bool)
            key[slot[first]], place[slot[first]] = keys[at[first]], at[first]
            rest = np.setdiff1d(np.arange(len(at)), first)
            more[slot[rest]] = True
            self.tables.append((odd, bits, key, place, more))
            if not len(rest):
                return
            at, odd = at[rest], odd * 0xD1342543DE82EF95 + 2 & (1 << 64) - 1 | 1

    @staticmethod
    def _slot(keys: np.ndarray, odd: int, bits: int) -> np.ndarray:
        return ((keys + np.uint64(1)) * np.uint64(odd) >> np.uint64(64 - bits)).astype(np.int64)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """The place of each code among the keys, or -1."""
        out = np.full(len(codes), -1, np.int32)
        todo = None
        for odd, bits, key, place, more in self.tables:
            c = codes if todo is None else codes[todo]
            slot = self._slot(c, odd, bits)
            found = np.where(key[slot] == c, place[slot], -1)
            if todo is None:
                out = found
            else:
                out[todo] = found
            go = np.flatnonzero((found < 0) & more[slot])
            todo = go if todo is None else todo[go]
            if not len(todo):
                break
        return out


class LanguageModel:
    """Of arrays by language number, k (bytes of context), gram (context and byte, big-endian) and count."""

    def __init__(self, langs: list[str], lang: np.ndarray, k: np.ndarray, gram: np.ndarray, count: np.ndarray, order: int):
        self.langs, self.order = langs, order
        self.grams, self.contexts, self.cost, self.escape = [], [], [], []
        below_keys, below = np.zeros(0, np.uint64), np.zeros((0, len(langs)))
        for level in range(order + 1 if langs else 0):
            at = k == level
            g, own = np.unique(gram[at].astype(np.uint64), return_inverse=True)
            n = np.zeros((len(g), len(langs)))
            np.add.at(n, (own, lang[at]), count[at])
            ctx, of = np.unique(g >> np.uint64(8), return_inverse=True)
            if level == 0:
                lower = np.full(n.shape, 1 / 256)
            else:  # the same byte after the shorter context was seen too
                lower = below[np.searchsorted(below_keys, g & np.uint64((1 << 8 * level) - 1))]
            total, kinds, seen = (np.zeros((len(ctx), len(langs))) for _ in range(3))
            np.add.at(total, of, n)
            np.add.at(kinds, of, n > 0)
            np.add.at(seen, of, np.where(n > 0, lower, 0))
            left = 1 - seen
            left[left < 1e-12] = 0
            kinds[left == 0] = 0
            escape = np.ones(total.shape)
            some = total > 0
            escape[some] = (kinds / np.maximum(total + kinds, 1))[some] / np.where(left > 0, left, 1)[some]
            p = np.where(n > 0, n / np.maximum(total + kinds, 1)[of], lower * escape[of])
            self.grams.append(_Find(g))
            self.contexts.append(_Find(ctx))
            self.cost.append(-np.log2(np.maximum(p, 1e-300)).astype(np.float32))
            self.escape.append(-np.log2(np.maximum(escape, 1e-12)).astype(np.float32))
            below_keys, below = g, p

    def code_lengths(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each row in each language."""
        lo, hi = int(offsets[0]), int(offsets[-1])
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        if hi == lo:
            return out
        x = buf[lo:hi].astype(np.uint64)
        place = np.arange(hi - lo) - np.repeat(offsets[:-1] - lo, np.diff(offsets))
        bits = np.zeros((hi - lo, len(self.langs)), np.float32)
        code = x.copy()  # the byte and the `order` ones before it
        for j in range(1, self.order + 1):
            code[j:] |= x[: len(x) - j] << np.uint64(8 * j)
        todo = np.arange(hi - lo)
        for k in range(self.order, -1, -1):
            able = np.flatnonzero(place[todo] >= k) if k else np.arange(len(todo))
            own = code[todo[able]] & np.uint64((1 << 8 * (k + 1)) - 1)
            at = self.grams[k](own)
            found = at >= 0
            bits[todo[able[found]]] += self.cost[k][at[found]]
            miss = able[~found]
            ctx = self.contexts[k](own[~found] >> np.uint64(8))
            known = ctx >= 0
            bits[todo[miss[known]]] += self.escape[k][ctx[known]]
            if k == 0:
                bits[todo[miss]] += np.float32(8.0)  # evenly over all bytes
            else:
                rest = np.ones(len(todo), bool)
                rest[able[found]] = False
                todo = todo[rest]
        full = np.flatnonzero(np.diff(offsets) > 0)
        out[full] = np.add.reduceat(bits, offsets[:-1][full] - lo, axis=0, dtype=np.float64)
        return out

    def predict_arrow(self, column: pa.Array) -> pa.StructArray:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        letters = pc.match_substring_regex(column, r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False) if len(column) else np.zeros(0, bool)
        buf, off = buffers(column)
        lang, score = np.full(len(column), "und", object), np.zeros(len(column))
        if self.langs:
            for i, j in pieces(off, max(1 << 14, 4 * PIECE // len(self.langs))):
                bits = self.code_lengths(buf, off[i : j + 1])
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 900)).sum(axis=1)
                ok = letters[i:j]
                lang[i:j][ok] = np.array(self.langs, object)[best[ok]]
                score[i:j][ok] = share[ok]
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], ["lang_pred", "score"])

    def predict(self, text: Column) -> Column:
        """struct(lang_pred, score) of a text column."""
        model = self

        @F.arrow_udf("lang_pred string, score double")
        def language(column: pa.Array) -> pa.Array:
            return model.predict_arrow(column)

        return language(text.cast("string"))


def fit(docs: DataFrame, order: int = 3, sample: int = 300, most: int = 4000) -> LanguageModel:
    """A model of all languages from at most `sample` rows of each, and `most` in all."""
    known = docs.where("lang is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    # The limit of ranks leaves `sample` rows of a language in each task before a shuffle. Tasks are drawn together
    # in steps, so that none gets more than FAN_IN * `sample` rows, or of the first step the tasks' share in FAN_IN ** STEPS.
    ids = known.select("doc_id", "lang").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(FAN_IN**STEPS)))
    for step in range(STEPS, -1, -1):
        by = Window.partitionBy("lang", F.pmod("salt", F.lit(FAN_IN**step))) if step else Window.partitionBy("lang")
        ids = ids.withColumn("r", F.row_number().over(by.orderBy(F.xxhash64("doc_id"), "doc_id"))).where(F.col("r") <= sample)
    ids = ids.orderBy("r", "lang").limit(most).select(F.col("doc_id").alias("i"), F.col("lang").alias("l")).distinct()
    rows = known.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("lang") == F.col("l"))).select("doc_id", "lang", "text")
    # An id with many rows counts as so many as its language still has.
    again = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.md5(F.col("text").cast("binary"))))
    rows = rows.withColumn("r", again).where(F.col("r") <= sample)
    grams = rows.select("lang", "text").mapInArrow(_count(order), "lang string, k int, gram long, n long").groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).toArrow()
    names, lang = np.unique(np.array(grams.column("lang").to_pylist(), object).astype(str), return_inverse=True)
    return LanguageModel(names.tolist(), lang, *(grams.column(c).to_numpy() for c in ("k", "gram", "n")), order)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from the rows not held out."""
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = fit(docs.where(~held_out))
    out = docs.select("doc_id", held_out.alias("held_out"), model.predict(F.col("text")).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")
