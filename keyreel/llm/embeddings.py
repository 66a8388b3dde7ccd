"""Near-duplicate vectors by PCA-ordered tiled comparison.

Equal vectors of a label are one class from the start. A basis of principal components of all
unit vectors (their second moments, summed before the shuffle) orders the dimensions. Within
a label, vectors are cut into tiles by their first coordinate: two unit vectors of
cosine >= c differ by at most sqrt(2 - 2c) in any coordinate, so tiles further apart never
meet. A pair of tiles accumulates products of leading dimensions, block by block, adds the
product of both vectors' norms over the dimensions still to come, and goes on with the pairs
whose bound still reaches the threshold. What is left is decided by the cosine of the given
vectors in double precision.

A pair of tiles returns counts of links and, for components, an edge from each linked vector
to one vector of its component in the tiles, so its output is linear however dense the links.

Vectors that are null, empty, zero or hold null or non-finite components, and rows with a
null label, link with nothing: n_links 0, the component is the vector itself. Vectors of
different lengths never link. Rows with a null vec_id have component null, kept null, and
link with nothing. Rows with one vec_id are one node, which does not link to itself; other nodes count
it once. If it has several vectors or labels, its links are those of all of them: such ids are
rare, so for the classes that hold them each link is put out by itself and counted by id. (A row
whose vector links with nothing stays alone, whatever other rows its id has.) Only vec_id,
embedding and label are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyreel.llm.common import connected_components, cut, cut_table, drop, join_counted, roots

BLOCKS = (8, 16, 32)


def _vectors(column) -> np.ndarray:
    """A list column whose lists have one length, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _moments(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = batch.column(0).to_numpy()
        for d in np.unique(dims).tolist():
            x = _vectors(batch.column(1).filter(pa.array(dims == d)))
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            total[d] = total.get(d, 0) + x.T @ x
    for d, m in total.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d), pa.int32()), pa.array(np.arange(d), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], ["d", "i", "row"])


def principal_axes(vectors: DataFrame, most: int = 64) -> dict[int, np.ndarray]:
    """For each length of vectors, orthonormal columns by falling second moment, from all rows.

    Reaches the driver: d rows of d numbers for each of the `most` most frequent lengths d; for
    others the given dimensions do, since any orthonormal basis gives the same result."""
    lengths = [r.d for r in vectors.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(most).collect()]
    rows = vectors.where(F.col("d").isin(lengths)).select("d", "vec").mapInArrow(_moments, "d int, i int, row array<double>")
    cell = rows.select("d", "i", F.posexplode("row").alias("j", "x")).groupBy("d", "i", "j").agg(F.sum("x").alias("x"))
    sums = cell.toArrow()
    out = {}
    d_all = sums.column("d").to_numpy() if sums.num_rows else np.zeros(0, int)
    for d in np.unique(d_all).tolist():
        at = d_all == d
        m = np.zeros((d, d))
        m[sums.column("i").to_numpy()[at], sums.column("j").to_numpy()[at]] = sums.column("x").to_numpy()[at]
        out[d] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()
    return out


def _first_coordinate(axes: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            dims = batch.column(1).to_numpy()
            first = np.zeros(len(batch))
            for d in np.unique(dims).tolist():
                at = dims == d
                x = _vectors(batch.column(2).filter(pa.array(at)))
                axis = axes[d][:, 0] if d in axes else np.eye(d)[0]
                first[at] = (x @ axis) / np.linalg.norm(x, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(first)], ["cls", "x1"])

    return run


def linked(x: np.ndarray, y: np.ndarray, axes: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the rows of x and y whose cosine is at least `least`."""
    u, v = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
    if axes is not None:
        u, v = u @ axes, v @ axes
    d = u.shape[1]
    stops = [b for b in BLOCKS if b < d] + [d]
    i = j = None
    done, at = None, 0
    for stop in stops:
        rest_u = np.sqrt(np.maximum(1 - (u[:, :stop] ** 2).sum(1), 0)) if stop < d else np.zeros(len(u))
        rest_v = np.sqrt(np.maximum(1 - (v[:, :stop] ** 2).sum(1), 0)) if stop < d else np.zeros(len(v))
        if i is None:
            part = u[:, :stop] @ v[:, :stop].T
            i, j = np.nonzero(part + np.outer(rest_u, rest_v) >= least - 1e-7)
            done = part[i, j]
        else:
            done = done + np.einsum("ij,ij->i", u[i, at:stop], v[j, at:stop])
            ok = done + rest_u[i] * rest_v[j] >= least - 1e-7
            i, j, done = i[ok], j[ok], done[ok]
        at = stop
    cosine = np.einsum("ij,ij->i", x[i], y[j]) / (np.linalg.norm(x[i], axis=1) * np.linalg.norm(y[j], axis=1))
    ok = cosine >= least
    return i[ok], j[ok]


def _compare(axes: dict[int, np.ndarray], least: float):
    def run(pair: pa.Table) -> pa.Table:
        side = pair.column("side").to_numpy()
        cls, weight = pair.column("cls").to_numpy(), pair.column("weight").to_numpy()
        x = _vectors(pair.column("vec"))
        basis = axes.get(x.shape[1])
        mixed = pair.column("mixed").to_numpy(zero_copy_only=False)
        links = np.zeros(len(cls), np.int64)
        edges, single = [], []
        step = 1024
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # 2: one tile with itself
        alone = bool((side == 2).any())
        for p in range(0, len(left), step):
            for q in range(p if alone else 0, len(right), step):
                l, r = left[p : p + step], right[q : q + step]
                i, j = linked(x[l], x[r], basis, least)
                if alone and p == q:
                    i, j = i[i < j], j[i < j]
                a, b = l[i], r[j]
                np.add.at(links, a, weight[b])
                np.add.at(links, b, weight[a])
                if len(a):
                    root = roots(len(cls), a, b)
                    edges.append(np.unique(np.stack([a, root[a]], 1), axis=0))
                    edges.append(np.unique(np.stack([b, root[b]], 1), axis=0))
                    with_mixed = mixed[a] | mixed[b]
                    single.append(np.stack([a[with_mixed], b[with_mixed]], 1))
        e = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
        one = np.concatenate(single) if single else np.zeros((0, 2), np.int64)
        some = np.flatnonzero(links)
        # n 0: an edge for the components, -1: a link of a class with mixed ids, else a class's number of links
        return pa.table({
            "a": pa.array(np.concatenate([cls[e[:, 0]], cls[one[:, 0]], cls[some]]), pa.int64()),
            "b": pa.array(np.concatenate([cls[e[:, 1]], cls[one[:, 1]], cls[some]]), pa.int64()),
            "n": pa.array(np.concatenate([np.zeros(len(e), np.int64), np.full(len(one), -1), links[some]]), pa.int64()),
        })

    return run


def near_duplicates(df: DataFrame, least: float = 0.98, tile: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = df.sparkSession
    vec = F.transform(F.col("embedding").cast("array<double>"), lambda v: v + F.lit(0.0))  # no negative zeros
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"), "label")
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    some = F.exists("vec", lambda v: v != 0)
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & finite & some
    keys = F.xxhash64("vec", "label").alias("k1"), F.xxhash64(F.lit(1), "label", "vec").alias("k2")
    rows = rows.withColumn("ok", F.coalesce(ok, F.lit(False)))
    good = rows.where("ok")
    # One class for each vector of a label.
    classes = good.groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.countDistinct("vec_id").alias("ids"), F.count("*").alias("n"))
    classes = cut_table(classes.select("*", F.size("vec").alias("d"), *keys, F.monotonically_increasing_id().alias("cls")))
    named = good.select("vec_id", *keys)
    mixed = cut_table(named.groupBy("vec_id").agg(F.min(F.struct("k1", "k2")).alias("x"), F.max(F.struct("k1", "k2")).alias("y")).where("x <> y").select("vec_id"))
    several = not mixed.isEmpty()
    if several:  # the classes of ids with several
        held = cut_table(named.join(mixed, "vec_id").distinct().join(classes.select("k1", "k2", "cls"), ["k1", "k2"]).select("vec_id", "cls"))
        count = held.groupBy("cls").agg(F.count("*").alias("m"))
        classes = classes.join(count, "cls", "left").withColumn("weight", F.col("ids") - F.coalesce("m", F.lit(0))).withColumn("mixed", F.col("m").isNotNull()).drop("m")
    else:
        classes = classes.withColumn("weight", F.col("ids")).withColumn("mixed", F.lit(False))
    axes = principal_axes(classes)
    x1 = classes.select("cls", "d", "vec").mapInArrow(_first_coordinate(axes), "cls long, x1 double")
    c = cut_table(classes.select("cls", "label", "d", "vec", "weight", "mixed").join(x1, "cls"))
    # Bins of the first coordinate are strung to tiles of about `tile` rows; a fuller bin is split by hash.
    bins = c.withColumn("bin", F.floor((F.col("x1") + 1.0) * 1000).cast("int"))
    counts = bins.groupBy("label", "d", "bin").agg(F.count("*").alias("n"), F.min("x1").alias("lo"), F.max("x1").alias("hi"))
    own = Window.partitionBy("label", "d").orderBy("bin")  # at most 2001 rows
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = counts.withColumn("t", F.floor(F.col("before") / tile).cast("int"))
    sums = Window.partitionBy("label", "d", "t")
    counts = counts.select("label", "d", "bin", "t", F.min("lo").over(sums).alias("lo"), F.max("hi").over(sums).alias("hi"), F.ceil(F.sum("n").over(sums) / (2 * tile)).cast("int").alias("k"))
    counts = cut(counts)
    tiles = counts.select("label", "d", "t", "lo", "hi", "k").distinct().withColumn("s", F.explode(F.expr("sequence(0, k - 1)")))
    near = float(np.sqrt(2 - 2 * least)) + 1e-6
    l, r = tiles.alias("l"), tiles.alias("r")
    meet = (F.col("l.label") == F.col("r.label")) & (F.col("l.d") == F.col("r.d")) & (F.struct("l.t", "l.s") <= F.struct("r.t", "r.s"))
    meet &= (F.col("r.lo") - F.col("l.hi") <= near) & (F.col("l.lo") - F.col("r.hi") <= near)
    pairs = l.join(r, meet).select("l.label", "l.d", F.col("l.t").alias("lt"), F.col("l.s").alias("ls"), F.col("r.t").alias("rt"), F.col("r.s").alias("rs"))
    both = (F.col("lt") == F.col("rt")) & (F.col("ls") == F.col("rs"))
    sides = pairs.select("*", F.col("lt").alias("t"), F.col("ls").alias("s"), F.when(both, 2).otherwise(0).alias("side")).unionByName(
        pairs.where(~both).select("*", F.col("rt").alias("t"), F.col("rs").alias("s"), F.lit(1).alias("side"))
    )
    placed = bins.join(counts.select("label", "d", "bin", "t", "k"), ["label", "d", "bin"])
    placed = placed.withColumn("s", F.pmod(F.xxhash64("cls"), F.col("k")).cast("int")).select("label", "d", "t", "s", "cls", "weight", "mixed", "vec")
    work = placed.join(sides, ["label", "d", "t", "s"])
    key = ["label", "d", "lt", "ls", "rt", "rs"]
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # much work for few bytes
    out = cut(work.repartition(n_tasks, *key).groupBy(*key).applyInArrow(_compare(axes, least), "a long, b long, n long"))
    edges = out.where("n = 0").select("a", "b")
    if several:
        first = held.groupBy("vec_id").agg(F.min("cls").alias("b"))
        edges = edges.unionByName(held.join(first, "vec_id").select(F.col("cls").alias("a"), "b"))
    comp = connected_components(edges)
    # A component's name is its least vec_id.
    linked = cut_table(comp.join(classes.select("cls", "least"), comp.node == F.col("cls")).select("cls", "component", "least"))
    name = linked.groupBy("component").agg(F.min("least").alias("name"), F.count("*").alias("n"))
    name = join_counted(linked, name, "component", linked.count()).select("cls", "name")
    links = out.where("n > 0").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("links"))
    found = classes.join(links, "cls", "left").join(name, "cls", "left")
    n_links = F.col("weight") - 1 + F.coalesce("links", F.lit(0))
    if several:
        single = out.where("n = -1").select("a", "b")
        near = single.unionByName(single.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(held.select(F.col("cls").alias("a"), F.col("cls").alias("b")))
        near = cut_table(near.distinct())
        others = held.select(F.col("vec_id").alias("other"), F.col("cls").alias("b"))
        extra = near.join(others, "b").select("a", "other").distinct().groupBy(F.col("a").alias("cls")).agg(F.count("*").alias("extra"))
        found = found.join(extra, "cls", "left")
        n_links = n_links + F.coalesce("extra", F.lit(0))
        reach = cut_table(held.select("vec_id", F.col("cls").alias("a")).join(near, "a").select("vec_id", "b").distinct())
        ids = reach.join(others, "b").where("vec_id <> other").select("vec_id", "other").distinct().groupBy("vec_id").agg(F.count("*").alias("m"))
        own = reach.join(classes.select(F.col("cls").alias("b"), "weight"), "b").groupBy("vec_id").agg(F.sum("weight").alias("w"))
        of_mixed = cut_table(own.join(ids, "vec_id", "left").select("vec_id", (F.col("w") + F.coalesce("m", F.lit(0))).alias("of_id")))
    found = cut_table(found.select("k1", "k2", "n", n_links.cast("long").alias("n_links"), F.coalesce("name", "least").alias("component")))
    drop(linked, comp)
    res = rows.select("vec_id", *[F.when(F.col("ok"), k).alias(k_) for k, k_ in zip(keys, ("k1", "k2"))])
    res = join_counted(res, found, ["k1", "k2"], rows.count(), how="left")
    if several:
        res = res.join(of_mixed, "vec_id", "left").withColumn("n_links", F.when(F.col("n_links").isNotNull(), F.coalesce("of_id", "n_links")))
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return res.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
