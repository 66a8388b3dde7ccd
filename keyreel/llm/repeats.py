"""Exact substring dedup: every byte covered by a string of `LENGTH` bytes that also starts elsewhere.

A sparse suffix array over whole texts. A window is a string of LENGTH bytes; its leading token is the
gram of GRAM bytes in it with the least hash. Equal windows have the same one, and runs
of neighbouring windows share it, so a text has about one run for each 70 bytes. As a prefilter, runs
whose token occurs once, and not twice nearby in its own text, leave after a count of token hashes that is combined
before the shuffle: they hold no repeated window. Of every other run the suffix that begins
with its token is one of the sorted suffixes; it carries the bytes of the run's windows.

The suffixes are range-partitioned by their leading bytes, DEEP of them, between splitters that Spark samples; being
deeper than a token, splitters divide heavy tokens as well. In a bucket, suffixes come in their order,
and the windows of each token are sorted by multikey quicksort over words of 8 bytes: words are
compared only among windows that were equal so far. Windows equal in all words are repeated.
A bucket's first and last token may go on across its boundaries: the suffixes of these tokens go to a
second step as well, where those from all sides are compared in the same way. Tokens of more than `hot` runs
would make that step long: their windows become suffixes of their own, of which each batch of
texts sends one of a kind, and 128 bits of hash instead of bytes. Slices that are equal in one batch
leave as one, too, after a comparison of their bytes.

Texts that occur several times are one class, of which one row is compared with the rest:
its copies are repeated as a whole, if long enough. Every join with texts is by row id and
class, so that copies don't meet in one task. Classes are named by 64 bits of a hash; 64 others are
checked to be the same in each class, and names that two texts share are replaced.

Null texts are empty. Texts shorter than LENGTH lose nothing. Null doc_ids are allowed.
Repeated rows are copies of each other. Kept bytes may be no valid UTF-8 any more; they are
returned as a digest, or as binary by kept_bytes(). An empty table gives an empty result.
Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyreel.llm.common import cut_table, drop, release
from keyreel.llm.textbytes import BYTE_VALUES, buffers, mix, pieces, powers, prefix_hash

LENGTH, GRAM = 200, 64
SPAN = LENGTH - GRAM + 1  # grams in a window
PIECE = 1 << 20
DEEP = 128  # bytes by which suffixes are dealt out and sorted
#: Other random values of bytes, for the second half of a window's hash.
_VALUES2 = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, 256, dtype=np.uint64)
_NO_ID = -(1 << 63)


def _token_runs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """token, row, first window (within buf), windows, whether the token may occur twice in one window's
    neighbourhood, and the token's place in the first window, for all runs of texts buf[offsets[i]:offsets[i + 1]]."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    empty = np.zeros(0, np.int64)
    if hi - lo < LENGTH:
        return empty.view(np.uint64), empty, empty, empty, empty.astype(bool), empty
    own, off = buf[lo:hi], offsets - lo
    c = prefix_hash(own, BYTE_VALUES)
    n = len(own) - GRAM + 1
    g = mix((c[GRAM:] - c[:n]) * powers(n)[1])
    least = g
    step = 1
    while step * 2 <= SPAN:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < SPAN:
        rest = SPAN - step
        least = np.minimum(least[: len(least) - rest], least[rest:])
    m = least  # of the windows 0 .. len(own) - LENGTH
    long_ = np.flatnonzero(np.diff(off) >= LENGTH)
    if not len(long_):
        return empty.view(np.uint64), empty, empty, empty, empty.astype(bool), empty
    inside = np.zeros(len(own) + 1, np.int8)
    np.add.at(inside, off[long_], 1)
    np.add.at(inside, off[long_ + 1] - LENGTH + 1, -1)
    valid = np.cumsum(inside, dtype=np.int8)[: len(m)] > 0
    begins = np.empty(len(m), bool)
    begins[0] = True
    np.not_equal(m[1:], m[:-1], out=begins[1:])
    first = off[long_]
    begins[first] = True
    start = np.flatnonzero(begins & valid)
    row = np.searchsorted(off, start, "right") - 1
    end = np.minimum(np.append(start[1:], len(m)), off[row + 1] - LENGTH + 1)
    # A window that recurs within its own run has its token at its very beginning somewhere in
    # the run, and again at most SPAN after that: the next window covers the SPAN grams there.
    at = np.flatnonzero((g[: len(m)] == m) & valid)
    again = np.zeros(len(at), bool)
    h = g[at]
    for d in range(1, SPAN + 1):
        again |= g[np.minimum(at + d, n - 1)] == h
    again &= at < n - 1
    twice = np.zeros(len(start), bool)
    twice[np.searchsorted(start, at[again], "right") - 1] = True
    # The token's first place in the run's first window: the next one where the gram is m.
    place = np.zeros(len(start), np.int64)
    left = np.arange(len(start))
    for d in range(SPAN):
        hit = g[start[left] + d] == m[start[left]]
        place[left[hit]] = d
        left = left[~hit]
        if not len(left):
            break
    return m[start], row, start + lo, end - start, twice, place


def _cuts(offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Pieces of rows as (first row, bytes before, offsets); long rows come in overlapping parts."""
    for i, j in pieces(offsets, PIECE):
        a, b = int(offsets[i]), int(offsets[j])
        if j - i > 1 or b - a <= 2 * PIECE:
            yield i, 0, offsets[i : j + 1]
        else:
            for s in range(a, b - LENGTH + 1, PIECE):
                yield i, s - a, np.array([s, min(b, s + PIECE + LENGTH - 1)])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: set[int] = set()
    for batch in batches:
        keys = batch.column(0).to_numpy()
        fresh = np.zeros(len(keys), bool)
        for i, k in enumerate(keys.tolist()):
            if k not in known:
                known.add(k)
                fresh[i] = True
        if len(known) > 1_000_000:
            known.clear()
        keys, text = keys[fresh], batch.column(1).filter(pa.array(fresh))
        buf, off = buffers(text)
        for i, before, cut in _cuts(off):
            h, row, start, n, twice, place = _token_runs(buf, cut)
            at = start - cut[row] + before
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(keys[i + row], pa.int64()), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int16)), pa.array(twice)],
                ["token", "key", "at", "n", "place", "twice"],
            )


_SLICE = "key long, at int, n int, place int, many boolean, data binary"
_SLICE_NAMES = ["key", "at", "n", "place", "many", "data"]


def _slice_rows(key, at, n, place, many, data) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(key, pa.int64()), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(many), data], _SLICE_NAMES
    )


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, at, n, place (of the token in data), many (there is another one), data: the bytes of the run's windows,
    null where these are known to be repeated. n -1: one window of a hot token, data its hash."""
    for whole in batches:
        _, sizes = buffers(whole.column(1))
        for i, j in pieces(sizes, 4 * PIECE):
            batch = whole.slice(i, j - i)
            keys = batch.column(0).to_numpy()
            buf, off = buffers(batch.column(1))
            runs = batch.column(2).flatten()
            doc = np.repeat(np.arange(j - i), np.diff(batch.column(2).offsets.to_numpy()))
            if not len(doc):
                continue
            at, n, place, hot = (runs.field(c).to_numpy(zero_copy_only=False) for c in range(4))
            at, n, place = at.astype(np.int64), n.astype(np.int64), place.astype(np.int64)
            lo = int(off[0])
            own_bytes = buf[lo : int(off[-1])]
            c = prefix_hash(own_bytes, BYTE_VALUES)
            down = powers(len(c))[1]

            def hashes(start: np.ndarray, length: np.ndarray | int, c: np.ndarray = c) -> np.ndarray:
                s = start - lo
                return mix((c[s + length] - c[s]) * down[s] + np.uint64(7) * np.asarray(length).astype(np.uint64))

            cold = np.flatnonzero(~hot)
            start, length = off[doc[cold]] + at[cold], n[cold] + LENGTH - 1
            _, first, back, count = np.unique(hashes(start, length), return_index=True, return_inverse=True, return_counts=True)
            view = memoryview(buf)
            many = count[back] > 1
            data, firsts = [], first[back].tolist()
            for k, (s, l) in enumerate(zip(start.tolist(), length.tolist())):
                f = firsts[k]
                same = f != k and view[s : s + l] == view[start[f] : start[f] + length[f]]
                data.append(None if same else bytes(view[s : s + l]))
                if f != k and not same:  # only the hash is equal
                    many[k] = False
            alone = np.zeros(len(cold), bool)  # the first of a kind whose others were different after all
            copies = np.bincount([firsts[k] for k, d in enumerate(data) if d is None], minlength=len(cold)) if len(cold) else alone
            many[first] = copies[first] > 0
            yield _slice_rows(keys[doc[cold]], at[cold], n[cold], place[cold], many, pa.array(data, pa.binary()))
            warm = np.flatnonzero(hot)
            if len(warm):
                m = n[warm]
                own = np.repeat(warm, m)
                p = at[own] + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
                pos = off[doc[own]] + p
                h = np.stack([hashes(pos, LENGTH), hashes(pos, LENGTH, prefix_hash(own_bytes, _VALUES2))], 1)
                order = np.lexsort((h[:, 1], h[:, 0]))
                step = np.concatenate([[True], (h[order][1:] != h[order][:-1]).any(axis=1)])
                kind = np.empty(len(h), np.int64)
                kind[order] = np.cumsum(step) - 1
                once = np.zeros(len(h), bool)
                once[order[step]] = True
                many = np.bincount(kind)[kind] > 1
                # Neighbouring windows that are repeated leave as a run of their own, and one of each kind as itself.
                brk = np.concatenate([[True], (own[1:] != own[:-1]) | (p[1:] != p[:-1] + 1) | ~many[1:] | ~many[:-1]])
                s = np.flatnonzero(brk & many)
                e = np.append(np.flatnonzero(brk), len(h))
                e = e[np.searchsorted(e, s, "right")]
                yield _slice_rows(keys[doc[own[s]]], p[s], e - s, np.zeros(len(s)), np.ones(len(s), bool), pa.nulls(len(s), pa.binary()))
                w = np.flatnonzero(once)
                named = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(w), [None, pa.py_buffer(h[w].tobytes())]).cast(pa.binary())
                yield _slice_rows(keys[doc[own[w]]], p[w], np.full(len(w), -1), np.zeros(len(w)), many[w], named)


def equal_windows(buf: np.ndarray, starts: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Which of the windows buf[s : s + LENGTH] have an equal one in their group.

    Multikey quicksort, a word at a time: windows that are alone after some words leave, and
    only segments in which the next words differ are sorted by them."""
    word = np.ndarray((len(buf) - 7,), ">u8", buffer=buf, strides=(1,))
    out = np.zeros(len(starts), bool)
    order = np.argsort(groups, kind="stable")
    seg = groups[order]
    for d in range(0, LENGTH, 8):
        same = seg[1:] == seg[:-1]
        some = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        order, seg = order[some], seg[some]
        if not len(order):
            return out
        w = word[starts[order] + d].astype(np.uint64)
        differ = (seg[1:] == seg[:-1]) & (w[1:] != w[:-1])
        if differ.any():
            mixed = np.isin(seg, seg[1:][differ]) if len(order) < 64 else _members(seg, differ)
            at = np.flatnonzero(mixed)
            o = np.lexsort((w[at], seg[at]))
            order[at], w[at] = order[at][o], w[at][o]
        first = np.concatenate([[True], (seg[1:] != seg[:-1]) | (w[1:] != w[:-1])])
        seg = np.cumsum(first)
    same = seg[1:] == seg[:-1]
    some = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    out[order[some]] = True
    return out


def _members(seg: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """The elements of segments (seg is sorted) in which neighbours differ."""
    first = np.concatenate([[True], seg[1:] != seg[:-1]])
    number = np.cumsum(first) - 1
    hit = np.zeros(int(number[-1]) + 1, bool)
    hit[number[1:][differ]] = True
    return hit[number]


def _groups(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Numbers of the groups of neighbours with an equal token; the tokens begin at starts."""
    word = np.ndarray((len(buf) - 7,), ">u8", buffer=buf, strides=(1,))
    new = np.zeros(len(starts), bool)
    for d in range(0, GRAM, 8):
        w = word[starts + d]
        new[1:] |= w[1:] != w[:-1]
    return np.cumsum(new)


def _bucket(edges: bool):
    """Covered bytes [s, e) of the rows of _slices, which come sorted by their leading bytes; with edges, also
    the rows themselves of the first and the last token (s null)."""

    def tokens(t: pa.Table) -> np.ndarray:
        """Group numbers of the rows with bytes, -1 for the others."""
        data, n = t.column("data").combine_chunks(), t.column("n").to_numpy()
        out = np.full(len(n), -1, np.int64)
        rows = np.flatnonzero(~data.is_null().to_numpy(zero_copy_only=False) & (n > 0))
        if len(rows):
            buf, off = buffers(data.take(pa.array(rows)))
            out[rows] = _groups(np.concatenate([buf, np.zeros(8, np.uint8)]), off[:-1] + t.column("place").to_numpy()[rows])
        return out

    def met(t: pa.Table) -> pa.Table:
        """With `many` for windows of hot tokens that have an equal neighbour."""
        one = np.flatnonzero(t.column("n").to_numpy() < 0)
        if not len(one):
            return t
        buf, off = buffers(t.column("data").combine_chunks().take(pa.array(one)))
        h = np.frombuffer(buf[int(off[0]) : int(off[-1])].tobytes(), np.uint64).reshape(len(one), 2)
        same = (h[1:] == h[:-1]).all(axis=1)
        many = t.column("many").to_numpy(zero_copy_only=False).copy()
        many[one] |= np.concatenate([[False], same]) | np.concatenate([same, [False]])
        return t.set_column(t.column_names.index("many"), "many", pa.array(many))

    def spans(key, s, e) -> pa.RecordBatch:
        m = len(key)
        rest = [pa.nulls(m, k) for k in (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(s, pa.int64()), pa.array(e, pa.int64()), *rest], ["key", "s", "e", *_SLICE_NAMES[1:]])

    def covered(t: pa.Table, group: np.ndarray) -> pa.RecordBatch:
        key = t.column("key").to_numpy()
        at, n = t.column("at").to_numpy().astype(np.int64), t.column("n").to_numpy().astype(np.int64)
        many = t.column("many").to_numpy(zero_copy_only=False)
        data = t.column("data").combine_chunks()
        known = many & (n > 0)
        owner, s, e = [key[known]], [at[known]], [at[known] + n[known] - 1 + LENGTH]
        hit = np.flatnonzero(many & (n < 0))
        owner, s, e = [*owner, key[hit]], [*s, at[hit]], [*e, at[hit] + LENGTH]
        rows = np.flatnonzero(group >= 0)
        if len(rows):
            buf, off = buffers(data.take(pa.array(rows)))
            buf = np.concatenate([buf[int(off[0]) : int(off[-1])], np.zeros(8, np.uint8)])
            off = off - off[0]
            m = n[rows]
            own = np.repeat(np.arange(len(rows)), m)
            w = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            h = np.flatnonzero(equal_windows(buf, off[own] + w, group[rows][own]) & ~many[rows][own])
            if len(h):
                brk = np.concatenate([[True], (own[h][1:] != own[h][:-1]) | (w[h][1:] != w[h][:-1] + 1)])
                a, b = h[brk], h[np.append(np.flatnonzero(brk)[1:], len(h)) - 1]
                r = rows[own[a]]
                owner, s, e = [*owner, key[r]], [*s, at[r] + w[a]], [*e, at[r] + w[b] + LENGTH]
        return spans(np.concatenate(owner), np.concatenate(s), np.concatenate(e))

    def kept(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for b in t.combine_chunks().to_batches():
            nulls = [pa.nulls(len(b), pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *nulls, *b.columns[1:]], ["key", "s", "e", *_SLICE_NAMES[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        windows, first, last = 0, True, None

        def done(more: bool) -> Iterator[pa.RecordBatch]:
            """All groups, or with more to come all but the last one, which stays."""
            nonlocal held, windows, first, last
            t = met(pa.Table.from_batches(held)).combine_chunks()
            group = tokens(t)
            some = np.flatnonzero(group >= 0)
            end = len(group)
            if more and len(some):
                end = int(some[np.searchsorted(group[some], group[some[-1]])])
            elif more:
                end = len(group) - 1
            part, g = t.slice(0, end), group[:end]
            if end:
                yield covered(part, g)
                with_token = np.flatnonzero(g >= 0)
                if edges and len(with_token):
                    if first:
                        yield from kept(part.take(pa.array(with_token[g[with_token] == g[with_token[0]]])))
                    if not first or g[with_token[0]] != g[with_token[-1]]:
                        last = part.take(pa.array(with_token[g[with_token] == g[with_token[-1]]]))
                    first = False
            held = t.slice(end).to_batches() if end < len(group) else []
            windows = 0

        for whole in batches:
            for i in range(0, len(whole), 1000):
                if held and windows > 500_000:
                    yield from done(True)
                held.append(whole.slice(i, 1000))
                windows += int(np.abs(held[-1].column(2).to_numpy()).sum())
        if held:
            yield from done(False)
        if last is not None:
            yield from kept(last)

    return run


def _texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, key, text) of every row and the classes (key, id, copies) of the texts of LENGTH bytes or more."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), text.alias("text"))
    again = F.xxhash64(F.lit(7), "text")
    # Never null, so that no join infers a filter for one side only, and both share one shuffle of the texts.
    key = F.coalesce(F.xxhash64("text"), F.lit(0))
    shared: list[int] = []
    while True:
        named = F.when(F.col("key").isin(shared), F.xxhash64("key", again)).otherwise(F.col("key")) if shared else F.col("key")
        d2 = d.select("id", key.alias("key"), "text").select("id", named.alias("key"), "text")
        classes = d2.where(F.octet_length("text") >= LENGTH).withColumn("k2", again).groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.min("k2").alias("x"), F.max("k2").alias("y"))
        classes = cut_table(classes)
        # Names that two texts share: none are expected below some 10 ** 9 texts, a handful at 10 ** 10.
        bad = [r.key for r in classes.where("x <> y").select("key").collect()]
        if not bad:
            return d2, classes.select("key", "id", "copies")
        drop(classes)
        shared += bad


def repeated_spans(d: DataFrame, classes: DataFrame, hot: int) -> DataFrame:
    """Of the texts (id, key, text): per key the array of covered [s, e)."""
    runs = d.select("key", "text").where(F.octet_length("text") >= LENGTH).mapInArrow(_runs, "token long, key long, at int, n int, place short, twice boolean")
    count = runs.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token", (F.col("c") > hot).alias("hot"))
    again = runs.join(count, "token", "left").where("hot is not null or twice")
    again = again.groupBy("key").agg(F.collect_set(F.struct("at", "n", "place", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("runs"))
    lead = classes.join(again, "key").select("id", "key", "runs")
    cut = d.join(lead, ["id", "key"]).select("key", "text", "runs").mapInArrow(_slices, _SLICE)
    # Rows without bytes need no company: they go anywhere.
    leading = F.coalesce(F.when(F.col("n") > 0, F.expr(f"substring(data, place + 1, {DEEP})")).otherwise(F.col("data")), F.unhex(F.hex(F.xxhash64("key", "at"))))
    n_buckets = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = "key long, s long, e long, at int, n int, place int, many boolean, data binary"
    out = cut_table(cut.repartitionByRange(n_buckets, leading).sortWithinPartitions(leading).mapInArrow(_bucket(True), found))
    edge = out.where("s is null").select(*_SLICE_NAMES)
    token = F.expr(f"substring(data, place + 1, {GRAM})")
    across = edge.repartition(token).sortWithinPartitions(token).mapInArrow(_bucket(False), found)
    spans = out.where("s is not null").select("key", "s", "e").unionByName(across.select("key", "s", "e"))
    return spans.groupBy("key").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def _merged(spans: np.ndarray) -> np.ndarray:
    """Overlapping or touching [s, e) rows as maximal ones."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[first, 0], reach[np.append(np.flatnonzero(first)[1:], len(spans)) - 1]], 1)


def _apply(kept: bool):
    kind = "n_removed long, n_spans long, kept binary" if kept else "n_removed long, n_spans long, kept string"

    @F.arrow_udf(kind)
    def run(text: pa.Array, everything: pa.Array, spans: pa.Array) -> pa.Array:
        buf, off = buffers(text)
        view = memoryview(buf)
        removed, count, out = [], [], []
        for i, whole in enumerate(everything.to_pylist()):
            a, b = int(off[i]), int(off[i + 1])
            if whole:
                cuts = np.array([[0, b - a]])
            elif spans[i].is_valid and len(spans[i].values):
                v = spans[i].values
                cuts = _merged(np.stack([v.field(0).to_numpy(), v.field(1).to_numpy()], 1))
            else:
                cuts = np.zeros((0, 2), np.int64)
            left, at = [], a
            for s, e in cuts.tolist():
                left.append(view[at : a + s])
                at = a + e
            left.append(view[at:b])
            data = b"".join(left)
            removed.append(int((cuts[:, 1] - cuts[:, 0]).sum()))
            count.append(len(cuts))
            out.append(data if kept else hashlib.sha256(data).hexdigest())
        return pa.StructArray.from_arrays([pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(out, pa.binary() if kept else pa.string())], ["n_removed", "n_spans", "kept"])

    return run


def _applied(docs: DataFrame, hot: int, kept: bool) -> DataFrame:
    d, classes = _texts(docs)
    spans = repeated_spans(d, classes, hot)
    release(d.sparkSession)  # of the search; the texts are shuffled once more, to be cut
    lead = classes.join(spans, "key", "left")
    # A row without a class of its own is a copy of another row, or too short.
    rows = d.join(lead, ["id", "key"], "left")
    n = F.octet_length("text")
    whole: Column = (n >= LENGTH) & (F.col("copies").isNull() | (F.col("copies") > 1))
    rows = rows.select("id", n.cast("long").alias("n_bytes"), _apply(kept)(F.col("text"), whole, F.col("spans")).alias("r"))
    doc_id = F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id")
    return rows.select(doc_id, "n_bytes", "r.n_removed", "r.n_spans", F.col("r.kept").alias("kept" if kept else "kept_sha256"))


def removed(docs: DataFrame, hot: int = 1000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    return _applied(docs, hot, False)


def kept_bytes(docs: DataFrame, hot: int = 1000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every row."""
    return _applied(docs, hot, True)
