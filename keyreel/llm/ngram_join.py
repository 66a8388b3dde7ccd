"""Near-duplicate classes of texts by word shingles: an exact Jaccard join on PartEnum signatures.

The sets are the distinct 5-word shingles. Sets with equal contents are one class from
the start. Sizes fall into bands whose upper end is 4/3 of the lower, so linking sets
lie in the same band or in neighbouring ones: group g joins bands g and g + 1. In a group
the shingle domain is hashed into n1 partitions. Sets that link differ in at most k
shingles, hence in at most k partitions, and agree on every other one: each agreement
is a signature (group, partition, the set's shingles there). A set keeps just as many
signatures as make `slack` agreements sure, dropping its last partitions; partitions
in which a set has nothing say nothing, and the few sets with too many of these put out
signatures for them too, so no pair is missed (arguments beside the code).

Signatures leave a task as sorted, delta-coded blobs, one for each bucket of the
signature space: about six bytes each. A bucket's reducer returns the signatures of two
classes or more; it goes through the blobs in chunks and keeps one class of each signature, so
a signature that a large group shares needs no more memory than others. A class with fewer than `slack` such signatures in a group has no partner
there and leaves it, and with it most that share just a passage. The rest are compared with
the least class of each signature, which joins large groups in linear time. Signatures whose classes are then in different components are linked to blocs;
in a bloc, classes outside its largest component are compared, tile by tile, with the classes
of other components. Before two texts meet, counts of their shingles by hash cell bound the
intersection from above; only pairs that this bound lets pass are read and compared exactly.
Pairs are compared by their lesser class: it comes once for each MEMBERS of its partners. Joins by
signature broadcast what belongs to the few that very many classes have.

Classes are told by 128 bits of their sets' hashes. Tables of the steps are deleted when the next
ones are written; the one that the result reads stays.

Rows: null text, or without a word: empty set, never linked. Null doc_id: never linked,
component null. The classes of rows with one doc_id are linked to each other. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyreel.llm.common import connected_components, cut_table, drop, join_counted
from keyreel.llm.textbytes import BYTE_VALUES, buffers, distinct_shingles, mix, pieces

PIECE = 1 << 18
SIG_HASH_BITS = 48
CHUNK = 4_000_000  # signatures in a reducer's memory, besides one for each distinct signature of its bucket
PARTS = 20_000  # reducers at most; they take several buckets then, one after another
MEMBERS = 256  # partners for which a class is sent once
_RANK = mix(BYTE_VALUES.copy())


class Bands:
    """Size bands and, for each group, partitions and slack. num/den is the least similarity."""

    def __init__(self, num: int = 75, den: int = 100, largest: int = 1 << 40):
        self.num, self.den = num, den
        self.low: list[int] = []
        l = 1
        while l <= largest:
            self.low.append(l)
            l = max(l, l * den // num) + 1
        self.low.append(l)
        self.low.append(max(l, l * den // num) + 1)
        self._n1: dict[int, int] = {}

    def band(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array(self.low, np.int64), sizes, "right") - 1

    def differ(self, a: int, b: int) -> int:
        """The largest symmetric difference with which sizes a and b can link."""
        least = -(-self.num * (a + b) // (self.num + self.den))
        return a + b - 2 * least

    def slack(self, g: int) -> int:
        return 1 + min(100, self.low[g] // 10)

    def most(self, a: int, g: int) -> int:
        """Bound of the difference of a set of size a to any partner of group g.

        Pairs in one band meet in that band's group; in the group below, a set only
        meets smaller ones of the band below. differ() grows with the sizes' sum but for
        rounding, whose period is 7 here; the last 8 sums cover it."""
        if a >= self.low[g + 1]:  # the larger side
            b = self.low[g + 1] - 1
        else:
            b = min(a * self.den // self.num, self.low[g + 2] - 1)
        return max(0, max(self.differ(a, x) for x in range(max(1, b - 7), b + 1)))

    def partitions(self, g: int) -> int:
        if g not in self._n1:
            sizes = {self.low[g], self.low[g + 1] - 1, self.low[g + 1], self.low[g + 2] - 1}
            n = 1
            for a in sizes:
                need = self.most(a, g) + self.slack(g)
                if need >= a:
                    n = max(n, 4 * a * a if a < 64 else 64 * a)  # nearly a partition for each shingle
                    continue
                lo, hi = 1, 64 * a
                while lo < hi:
                    m = (lo + hi) // 2
                    empty = math.exp(-a / m)
                    spread = math.sqrt(max(0.0, m * (empty - (1 + a / m) * empty * empty)))
                    if m * (1 - empty) - 3 * spread >= need:
                        hi = m
                    else:
                        lo = m + 1
                n = max(n, lo)
            self._n1[g] = n
        return self._n1[g]


def signatures(h: np.ndarray, counts: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets given one after another: values (hash and, in the low byte, group) and set index."""
    sizes = counts.astype(np.int64)
    band = bands.band(np.maximum(sizes, 1))
    first = np.concatenate([[0], np.cumsum(sizes)])
    out_s, out_i = [], []
    for g in np.unique(np.concatenate([band, np.maximum(band - 1, 0)])).tolist():
        member = np.flatnonzero(((band == g) | (band == g + 1)) & (sizes > 0))
        if not len(member):
            continue
        n1, slack = bands.partitions(g), bands.slack(g)
        need = {a: bands.most(a, g) + slack for a in np.unique(sizes[member]).tolist()}
        length = sizes[member]
        total = int(length.sum())
        own = np.repeat(np.arange(len(member)), length)
        at = np.arange(total) - np.repeat(np.cumsum(length) - length, length) + np.repeat(first[member], length)
        x = h[at]
        part = ((x >> np.uint64(20)) % np.uint64(n1)).astype(np.int64)
        cell = own * n1 + part
        order = np.argsort(cell, kind="stable")
        cell, v = cell[order], mix(x[order] ^ np.uint64(0xA5A5_0000 + g))
        start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        value = np.add.reduceat(v, start)  # a set's order does not matter
        cell = cell[start]
        own, part = cell // n1, cell % n1
        filled = np.bincount(own, minlength=len(member))
        wanted = np.array([need[a] for a in length.tolist()])
        # Sharing `filled - k` partitions or more, with k = wanted - slack, a pair still shares
        # `slack` of them when each side drops its last `filled - wanted`: of the partitions
        # they share, these are among the last max of both surpluses.
        place = np.arange(len(own)) - np.repeat(np.cumsum(filled) - filled, filled)
        keep = place < np.repeat(wanted, filled)
        out_s.append(mix(value[keep] + part[keep].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) << np.uint64(8) | np.uint64(g & 255))
        out_i.append(member[own[keep]])
        poor = np.flatnonzero(filled < wanted)
        if len(poor):
            # Two sets that are both short agree, empty partitions counted, on n1 - k >= slack.
            for i in poor.tolist():
                none = np.setdiff1d(np.arange(n1), part[own == i])
                out_s.append(mix(none.astype(np.uint64) + np.uint64(0x0E0E_0000_0000 + (g << 50))) << np.uint64(8) | np.uint64(g & 255))
                out_i.append(np.full(len(none), member[i]))
    if not out_s:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    mask = np.uint64((1 << (SIG_HASH_BITS + 8)) - 1)
    return np.concatenate(out_s) & mask, np.concatenate(out_i)


def set_keys(h: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """A key of 2 x 64 bits for each set, the same for equal sets; the first half is 0 for empty ones only."""
    key = np.zeros((n, 2), np.uint64)
    if len(h):
        start = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        key[rows[start], 0] = mix(np.add.reduceat(mix(h ^ np.uint64(0x5E7)), start)) | np.uint64(1)
        key[rows[start], 1] = mix(np.add.reduceat(mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x27D4)), start))
    return key.view(np.int64)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = buffers(batch.column(1))
        n_all, k_all = [], []
        for i, j in pieces(off, PIECE):
            h, r, n = distinct_shingles(buf, off[i : j + 1])
            n_all.append(n)
            k_all.append(set_keys(h, r, j - i))
        if n_all:
            k = np.concatenate(k_all)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n_all), pa.int64()), pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy())], ["doc_id", "n_shingles", "k1", "k2"])


def _planes(x: np.ndarray) -> bytes:
    """Increasing values as differences, lowest bytes first; planes of zeros are left out."""
    d = np.diff(x, prepend=np.uint64(0))
    planes = np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T)
    used = max([i + 1 for i in range(8) if planes[i].any()], default=0)
    return bytes([used]) + planes[:used].tobytes()


def _unplane(blob: memoryview, n: int) -> tuple[np.ndarray, int]:
    used = blob[0]
    planes = np.zeros((8, n), np.uint8)
    planes[:used] = np.frombuffer(blob[1 : 1 + used * n], np.uint8).reshape(used, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64), 1 + used * n


def _bucket_of(sig: np.ndarray, n: int) -> np.ndarray:
    return ((sig >> np.uint64(24)) * np.uint64(n) >> np.uint64(SIG_HASH_BITS + 8 - 24)).astype(np.int64)


def _emit(n_buckets: int, num: int, den: int):
    flush = 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        sigs, owners, keys, held = [], [], [], 0
        known: set[tuple[int, int]] = set()

        def blobs() -> pa.RecordBatch:
            sig, own, key = np.concatenate(sigs), np.concatenate(owners), np.concatenate(keys)
            order = np.argsort(sig, kind="stable")
            sig, own = sig[order], own[order]
            at = np.searchsorted(_bucket_of(sig, n_buckets), np.arange(n_buckets + 1))
            ids, data = [], []
            for b in range(n_buckets):
                s, o = sig[at[b] : at[b + 1]], own[at[b] : at[b + 1]]
                if len(s):
                    names, o = np.unique(o, return_inverse=True)
                    wide = "<u2" if len(names) <= 65535 else "<u4"
                    ids.append(b)
                    data.append(np.array([len(s), len(names)], "<i8").tobytes() + key[names].tobytes() + o.astype(wide).tobytes() + _planes(s))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(data, pa.binary())], ["bucket", "blob"])

        n_keys = 0
        for batch in batches:
            buf, off = buffers(batch.column(0))
            for i, j in pieces(off, PIECE):
                h, r, n = distinct_shingles(buf, off[i : j + 1])
                key = set_keys(h, r, j - i)
                fresh = np.zeros(j - i, bool)
                for k, x in enumerate(map(tuple, key.tolist())):
                    if x[0] and x not in known:
                        known.add(x)
                        fresh[k] = True
                if not fresh.any():
                    continue
                h = h[fresh[r]]
                s, o = signatures(h, n[fresh], bands)
                sigs.append(s)
                owners.append(o + n_keys)
                keys.append(key[fresh])
                n_keys += int(fresh.sum())
                held += len(s)
                if held > flush:
                    yield blobs()
                    sigs, owners, keys, held, n_keys = [], [], [], 0, 0
                    known.clear()
        if held:
            yield blobs()

    return run


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of keys (n, 2), and for each row which of them it is."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    k = keys[order]
    fresh = np.concatenate([[True], (k[1:] != k[:-1]).any(axis=1)])
    which = np.empty(len(k), np.int32)
    which[order] = np.cumsum(fresh) - 1
    return k[fresh], which


def _meet(s: np.ndarray, c: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of signatures s of classes c: which to put out, and one class of each signature with
    whether it has been put out. A signature's classes are put out when there are two of them."""
    order = np.lexsort((~told, c, s))
    s, c, told = s[order], c[order], told[order]
    del order
    fresh = np.concatenate([[True], (s[1:] != s[:-1]) | (c[1:] != c[:-1])])
    s, c, told = s[fresh], c[fresh], told[fresh]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    alone = first & np.concatenate([first[1:], [True]])
    out = ~alone & ~told
    told = told | ~alone
    return np.flatnonzero(out), s, c, np.stack([first, told])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket, which come one after another: the signatures with two classes or more.

    In buckets of more than one chunk, a row may come twice. A signature holds 13 bytes: its class is
    told by its place among the keys of the bucket's classes."""
    sig: list[np.ndarray] = []
    own: list[np.ndarray] = []
    keys: list[np.ndarray] = []
    flags: list[np.ndarray] = []
    bucket, held = None, 0

    def read(blob: bytes) -> None:
        view = memoryview(blob)
        n, names = np.frombuffer(view[:16], "<i8").tolist()
        at = 16 + 16 * names
        width = 2 if names <= 65535 else 4
        own.append(np.frombuffer(view[at : at + width * n], f"<u{width}").astype(np.int32) + np.int32(sum(map(len, keys))))
        keys.append(np.frombuffer(view[16:at], np.int64).reshape(names, 2).copy())  # not a view: the blob can go
        sig.append(_unplane(view[at + width * n :], n)[0])
        flags.append(np.zeros(n, bool))

    def reduced(more: bool) -> pa.RecordBatch:
        key, which = _distinct(np.concatenate(keys))
        c = which[np.concatenate(own)]
        own.clear()
        s, told = np.concatenate(sig), np.concatenate(flags)
        for x in (sig, keys, flags):
            x.clear()
        out, s, c, (first, told) = _meet(s, c, told)
        if more:
            used, at = np.unique(c[first], return_inverse=True)
            for x, y in ((sig, s[first]), (own, at.astype(np.int32)), (keys, key[used]), (flags, told[first])):
                x.append(y)
        met = key[c[out]]
        return pa.RecordBatch.from_arrays([pa.array(s[out].view(np.int64)), pa.array(met[:, 0]), pa.array(met[:, 1])], ["sig", "k1", "k2"])

    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            if b != bucket and sig:
                yield reduced(False)
                held = 0
            bucket = b
            read(blob.as_py())
            held += len(sig[-1])
            if held > CHUNK:
                yield reduced(True)
                held = 0
    if sig:
        yield reduced(False)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (node, k1, k2, text) those whose set has the key: node, text, set size and counts of the
    shingles in hash cells, at most one to a cell on average."""
    for batch in batches:
        buf, off = buffers(batch.column(3))
        want = np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], 1)
        ok, sizes, data = [], [], []
        for i, j in pieces(off, PIECE):
            h, r, n = distinct_shingles(buf, off[i : j + 1])
            ok.append((set_keys(h, r, j - i) == want[i:j]).all(axis=1))
            at = 0
            for m in n.tolist():
                cells = 1 << max(3, m.bit_length())
                count = np.bincount((h[at : at + m] >> np.uint64(24)).astype(np.int64) & (cells - 1), minlength=cells)
                sizes.append(m)
                data.append(count.astype(np.uint8).tobytes() if count.max(initial=0) < 256 else None)
                at += m
        if ok:
            rows = pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())], ["node", "text", "n", "cells"])
            yield rows.filter(pa.array(np.concatenate(ok)))


def _may_link(num: int, den: int):
    """Of rows (a, b, n, cells), each a's own row (b null) before its partners: the pairs that can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, x = 0, None
        for batch in batches:
            ok = np.zeros(len(batch), bool)
            sizes = batch.column(2).to_numpy()
            for i, y in enumerate(batch.column(3).to_pylist()):
                y = None if y is None else np.frombuffer(y, np.uint8)
                if not batch.column(1)[i].is_valid:
                    m, x = int(sizes[i]), y
                    continue
                n = int(sizes[i])
                most = min(n, m)
                if most * den < max(n, m) * num:
                    continue
                if x is not None and y is not None:
                    s, l = (x, y) if len(x) <= len(y) else (y, x)
                    most = int(_bound(s, l[None, :])[0])
                ok[i] = den * most >= num * (n + m - most)
            ok = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    return run


def _verify(num: int, den: int):
    """Of rows (a, b, text), each a's own row (b null) before its partners: the pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.zeros(0, np.uint64)
        for batch in batches:
            buf, off = buffers(batch.column(2))
            own = np.flatnonzero(batch.column(1).is_null().to_numpy(zero_copy_only=False))
            ok = np.zeros(len(batch), bool)
            for i, j in pieces(off, PIECE):
                h, r, n = distinct_shingles(buf, off[i : j + 1])
                at = np.concatenate([[0], np.cumsum(n)])
                stops = [i, *own[(own > i) & (own < j)].tolist(), j]
                for p, q in zip(stops[:-1], stops[1:]):  # one a
                    if len(own) and own[np.searchsorted(own, p) % len(own)] == p:
                        x = h[at[p - i] : at[p - i + 1]]
                        p += 1
                    if p < q and len(x):
                        y = h[at[p - i] : at[q - i]]
                        hit = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
                        both = np.bincount(r[at[p - i] : at[q - i]] - (p - i), weights=hit, minlength=q - p).astype(np.int64)
                        ok[p:q] = den * both >= num * (n[p - i : q - i] + len(x) - both)
            ok = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    return run


def _met(pairs: DataFrame, of: DataFrame, total: int, test) -> DataFrame:
    """The pairs (a, b) that pass the test, which gets of's columns (node, ...) of a and then of its b's."""
    count = pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("k", F.ceil(F.col("n") / MEMBERS).cast("int"))
    dealt = join_counted(pairs, count, "a", total).select("a", F.pmod(F.xxhash64("b"), "k").cast("int").alias("salt"), "b")
    cols = [c for c in of.columns if c != "node"]
    hubs = count.select("a", F.explode(F.expr("sequence(0, k - 1)")).alias("salt"), F.lit(None).cast("long").alias("b")).join(of.withColumnRenamed("node", "a"), "a")
    both = hubs.unionByName(dealt.join(of.withColumnRenamed("node", "b"), "b")).select("a", "salt", "b", *cols)
    n_tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = both.repartition(n_tasks, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    # Many tasks for the work, but few files for the small rows that are left.
    return rows.select("a", "b", *cols).mapInArrow(test, "a long, b long").repartition("a", "b")


def classes_of(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles and the key k1, k2 (k1 0: no word) of every row's set."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_classes, "doc_id long, n_shingles long, k1 long, k2 long")


def candidates(docs: DataFrame, n_buckets: int, num: int = 75, den: int = 100) -> DataFrame:
    """sig, k1, k2 for every PartEnum signature that two classes or more have."""
    blobs = docs.select("text").where("text is not null").mapInArrow(_emit(n_buckets, num, den), "bucket int, blob binary")
    n_parts = min(n_buckets, PARTS)
    return blobs.repartitionById(n_parts, F.col("bucket") % n_parts).sortWithinPartitions("bucket").mapInArrow(_shared, "sig long, k1 long, k2 long")


def _group(sig: str = "sig"):
    return F.col(sig).bitwiseAND(F.lit(255)).cast("int")


def _slack(num: int, den: int):
    bands = Bands(num, den)
    return F.get(F.array(*[F.lit(bands.slack(g)) for g in range(len(bands.low) - 2)]), _group())


def _drop_alone(cand: DataFrame, num: int, den: int, *key: str) -> DataFrame:
    """Without the classes that have too few shared signatures in a group to link there."""
    own = Window.partitionBy(*key, _group())
    return cand.withColumn("__n", F.count("*").over(own)).where(F.col("__n") >= _slack(num, den)).drop("__n")


def _rarest(cand: DataFrame, num: int, den: int) -> DataFrame:
    """Of a node's signatures in a group, n in number, the n - slack + 1 that the fewest nodes (column
    `in`) have. Linking nodes share `slack` of theirs, so the rarest of these is kept by both."""
    own = Window.partitionBy("node", _group())
    c = cand.withColumn("at", F.row_number().over(own.orderBy("in", "sig"))).withColumn("__n", F.count("*").over(own))
    return c.where(F.col("at") <= F.col("__n") - _slack(num, den) + 1).drop("at", "__n")


def _by_signature(cand: DataFrame, total: int, keep: str, **more) -> DataFrame:
    """cand with, of its signature, the number n of rows and more; for signatures with `keep`."""
    per = cand.groupBy("sig").agg(F.count("*").alias("n"), *[c.alias(k) for k, c in more.items()])
    return join_counted(cand, per.where(keep), "sig", total)


def _bound(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Upper bounds of the intersections of x's set with those of the rows of y, which has as
    many cells or more."""
    if y.shape[1] > len(x):
        y = y.reshape(len(y), -1, len(x)).sum(axis=1)
    return np.minimum(y, x).sum(axis=1, dtype=np.int64)


def _compare_tile(num: int, den: int):
    """Pairs of a tile's outer and inner classes in different components that the cells let pass."""

    def run(tile: pa.Table) -> pa.Table:
        node, comp, n = (tile.column(c).to_numpy() for c in ("node", "comp", "n"))
        outer = tile.column("outer").to_numpy()
        cells = tile.column("cells").to_pylist()
        width = np.array([0 if c is None else len(c) for c in cells])
        stacks = {w: np.flatnonzero(width == w) for w in np.unique(width).tolist()}
        data = {w: np.frombuffer(b"".join(cells[i] for i in at), np.uint8).reshape(len(at), w) for w, at in stacks.items() if w}
        a, b = [], []
        for i in np.flatnonzero(outer).tolist():
            for w, at in stacks.items():
                ok = (comp[at] != comp[i]) & (np.minimum(n[at], n[i]) * den >= np.maximum(n[at], n[i]) * num)
                ok &= ~outer[at] | (node[at] < node[i])
                k = np.flatnonzero(ok)
                if w and width[i] and len(k):
                    x, y = np.frombuffer(cells[i], np.uint8), data[w][k]
                    if w < len(x):
                        x = x.reshape(-1, w).sum(axis=0)
                    most = _bound(x, y)
                    k = k[den * most >= num * (n[at[k]] + n[i] - most)]
                a.append(np.full(len(k), node[i]))
                b.append(node[at[k]])
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return run


def _open_pairs(open_: DataFrame, cells: DataFrame, num: int, den: int, tile: int = 256) -> DataFrame:
    """Pairs a, b of classes that share a signature, maybe by way of others, in different components.

    A bloc is what the signatures of open_ connect. Tiles are of `tile` classes, those of the
    bloc's largest component apart; these are not compared among themselves."""
    total = open_.count()
    links = cut_table(_by_signature(open_, total, "n > 1", c=F.min("node")).where("node <> c").select(F.col("node").alias("a"), F.col("c").alias("b")))
    blocs = connected_components(links)
    nodes = cut_table(open_.select("node", "comp").distinct().join(blocs.withColumnRenamed("component", "bloc"), "node").join(cells, "node"))
    drop(links, blocs)
    largest = nodes.groupBy("bloc", "comp").agg(F.count("*").alias("m")).groupBy("bloc").agg(F.max(F.struct("m", "comp")).alias("main"), F.sum("m").alias("all"))
    n = nodes.join(largest, "bloc").select(
        "bloc", "node", "comp", "n", "cells",
        (F.col("comp") != F.col("main.comp")).alias("outer"),
        F.ceil((F.col("all") - F.col("main.m")) / tile).cast("int").alias("k_out"),
        F.ceil(F.col("main.m") / tile).cast("int").alias("k_in"),
    )
    own = F.pmod(F.xxhash64("node"), F.when(F.col("outer"), F.col("k_out")).otherwise(F.col("k_in"))).cast("int")
    n = n.withColumn("own", own)
    rows = "bloc", "node", "comp", "n", "cells", "outer"
    # Tile (t, u): outer tile t against inner tile u; tile (t, -1 - u), t <= u: outer against outer.
    cross = n.select(*rows, F.explode(F.when(F.col("outer"), F.expr("transform(sequence(0, k_in - 1), u -> struct(own as t, u as u))")).otherwise(F.expr("transform(sequence(0, k_out - 1), t -> struct(t as t, own as u))"))).alias("at"))
    among = n.where("outer").select(*rows, F.explode(F.expr("transform(sequence(0, k_out - 1), u -> struct(least(own, u) as t, -1 - greatest(own, u) as u))")).alias("at"))
    tiles = cross.unionByName(among).select("bloc", "at.t", "at.u", *rows[1:])
    n_tasks = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small rows, much work
    pairs = cut_table(tiles.repartition(n_tasks, "bloc", "t", "u").groupBy("bloc", "t", "u").applyInArrow(_compare_tile(num, den), "a long, b long").distinct())
    drop(nodes)
    return pairs


def _same_id(rows: DataFrame, reps: DataFrame) -> DataFrame | None:
    """Links a, b between the classes of one doc_id, if any id has several."""
    known = rows.where("k1 <> 0 and doc_id is not null")
    several = cut_table(known.groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("x"), F.max(F.struct("k1", "k2")).alias("y"), F.count("*").alias("n")).where("x <> y"))
    if several.isEmpty():
        drop(several)
        return None
    pairs = join_counted(known, several.select("doc_id", "x", "n"), "doc_id", rows.count()).select("k1", "k2", "x.*").toDF("k1", "k2", "x1", "x2").distinct()
    pairs = pairs.join(reps.select("k1", "k2", F.col("node").alias("a")), ["k1", "k2"]).join(reps.select(F.col("k1").alias("x1"), F.col("k2").alias("x2"), F.col("node").alias("b")), ["x1", "x2"])
    links = cut_table(pairs.select("a", "b"))
    drop(several)
    return links


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", num: int = 75, den: int = 100, n_buckets: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; see the module."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = cut_table(classes_of(docs))
    n_rows, total = rows.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    if n_buckets is None:
        n_buckets = max(8, math.ceil(total / 2_000_000))
    reps = rows.where("k1 <> 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    reps = cut_table(reps.withColumn("node", F.monotonically_increasing_id()))
    met = candidates(docs, n_buckets, num, den)
    named = cut_table(_drop_alone(met.join(reps.select("k1", "k2", "node"), ["k1", "k2"]), num, den, "k1", "k2").select("sig", "node"))
    drop(met)
    n = named.count()
    cand = cut_table(_drop_alone(_by_signature(named, n, "n > 1"), num, den, "node").select("sig", "node"))
    drop(named)
    # Texts of the candidates only, one for each class.
    wanted = cand.select("node").distinct().join(reps, "node").select("node", "rep", "k1", "k2")
    texts = docs.join(wanted, docs.doc_id == wanted.rep).withColumn("m", F.md5(F.col("text").cast("binary"))).dropDuplicates(["doc_id", "node", "m"])
    texts = cut_table(texts.select("node", "k1", "k2", "text").mapInArrow(_read, "node long, text string, n long, cells binary"))
    cells = texts.select("node", "n", "cells")
    same = _same_id(rows, reps)

    def tested(pairs: DataFrame, bound: bool) -> DataFrame:
        if bound:
            passed = cut_table(_met(pairs, cells, pairs.count(), _may_link(num, den)))
            drop(pairs)
            pairs = passed
        good = cut_table(_met(pairs, texts.select("node", "text"), pairs.count(), _verify(num, den)))
        drop(pairs)
        return good

    def joined(links: list[DataFrame]) -> DataFrame:
        both = links[0]
        for x in links[1:]:
            both = both.unionByName(x)
        return connected_components(both)

    n = cand.count()
    least = _by_signature(cand, n, "n > 1", c=F.min("node")).where("node <> c").select(F.col("c").alias("a"), F.col("node").alias("b")).distinct()
    links = [tested(cut_table(least), True), *([same] if same is not None else [])]
    comp = joined(links)
    # Linking classes in different components share `slack` signatures that are mixed.
    open_ = cand.join(comp, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("comp"))
    mixed = dict(keep="c0 <> c1", c0=F.min("comp"), c1=F.max("comp"))
    open_ = cut_table(_drop_alone(_by_signature(open_, n, **mixed).select("sig", "node", "comp"), num, den, "node"))
    drop(cand, comp)
    n = open_.count()
    if n:
        rare = cut_table(_rarest(_by_signature(open_, n, "n > 1").withColumnRenamed("n", "in"), num, den).select("sig", "node", "comp"))
        left = cut_table(_by_signature(rare, rare.count(), **mixed).select("sig", "node", "comp"))
        drop(open_, rare)
        links.append(tested(_open_pairs(left, cells, num, den), False))
        drop(left)
    drop(texts)
    comp = joined(links)
    drop(*links)
    # A component's name is its least doc_id.
    linked = cut_table(comp.join(reps.select("node", "rep"), "node"))
    drop(comp)
    least = linked.groupBy("component").agg(F.min("rep").alias("least"), F.count("*").alias("n"))
    named = join_counted(linked, least, "component", linked.count()).select("node", "least")
    known = cut_table(reps.join(named, "node", "left").select("k1", "k2", "n", F.coalesce("least", "rep").alias("component")))
    drop(linked, reps)
    out = join_counted(rows, known, ["k1", "k2"], n_rows, how="left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
