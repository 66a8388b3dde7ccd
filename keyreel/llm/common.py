"""Helpers shared by the operators: tables in the shared folder, links to components, row ids."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys with more than one in HEAVY of all rows are joined by broadcast; there are fewer than HEAVY of them.
HEAVY = 1000
CHUNK = 500_000
#: Hadoop starts a process for each file and folder it makes on a local file system. Tables of the steps have no
#: checksum file beside each file, as Parquet's pages have checksums of their own, which are verified when read.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
VERIFIED = {"parquet.page.write-checksum.enabled": "true", "parquet.page.verify-checksum.enabled": "true"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where none is set, a temporary one, but only if all runs in one JVM."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="keyreel-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and drop its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_table(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Like cut(), as a Parquet table (of `parts` files at most): smaller for wide rows, columns can be
    read alone, and drop() deletes it."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/keyreel-{uuid.uuid4().hex}.parquet"
    (df.coalesce(parts) if parts else df).write.options(**PLAIN, **VERIFIED).parquet(path)
    out = spark.read.schema(df.schema).options(**VERIFIED).parquet(path)
    out._keyreel_path = path
    return out


def release(spark: SparkSession) -> None:
    """Let go of finished shuffles.

    Spark removes a shuffle's files once the driver's JVM has collected the plan that made it; by
    itself that may be long after a job of many steps is over. The first collection only lets the
    plan's handles go, so there are two of them, with some time for what they lead to."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def drop(*tables: DataFrame) -> None:
    """Delete tables of cut_table() that nothing reads any more, and let go of finished shuffles."""
    for t in tables:
        path = getattr(t, "_keyreel_path", None)
        if path:
            sc = t.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
            t._keyreel_path = None
    if tables:  # each call completes the one before
        gc.collect()
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def parts_for(df: DataFrame, rows: int) -> int:
    """Partitions for so many small rows: a chunk each, but some for every core of a small cluster."""
    spark = df.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(most, max(min(8, spark.sparkContext.defaultParallelism), -(-rows // CHUNK))))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once, also where f reads it in a lambda, which would do so for each element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def with_prefix(values: Column, zero: Column, op: Callable[[Column, Column], Column], f: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """f(before) with before(i) the fold by op of the array's first i values.

    Appending copies an array, so the folds are those of blocks of about cbrt(n) values and of
    the blocks before: n ** (4 / 3) steps, not n ** 2."""

    def grown(a: Column, x: Column) -> Column:
        return F.concat(a, F.array(op(F.element_at(a, -1), x)))

    def blocks(v: Column, b: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.size(v) - 1) / b)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.aggregate(F.slice(v, k * b + 1, b), F.array(zero), grown))

    def ready(b: Column, inner: Column, outer: Column) -> Column:
        def before(i: Column) -> Column:
            k = F.floor(i / b).cast("int")
            return op(F.get(outer, k), F.get(F.get(inner, k), i % b))

        return f(before)

    size = lambda v: F.greatest(F.lit(16), F.ceil(F.cbrt(F.size(v)))).cast("int")
    sums = lambda inner: F.aggregate(inner, F.array(zero), lambda a, x: grown(a, F.element_at(x, -1)))
    return let(values, lambda v: let(size(v), lambda b: let(blocks(v, b), lambda inner: let(sums(inner), lambda outer: ready(b, inner, outer)))))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0)).cast("int")


def join_counted(rows: DataFrame, per_key: DataFrame, key: str | list[str], total: int, n: str = "n", how: str = "inner") -> DataFrame:
    """rows join per_key on key; per_key has a row for each key, with the number n of its rows.

    The keys with more than total / HEAVY rows, fewer than HEAVY in number whatever the input, are
    broadcast, so their rows stay where they are; only the others are shuffled, and for a left
    join those without an entry."""
    key = [key] if isinstance(key, str) else key
    heavy = F.broadcast(per_key.where(F.col(n) * HEAVY > total))
    light = per_key.where(F.col(n) * HEAVY <= total)
    rest = rows.join(heavy.select(*key), key, "left_anti")
    return rows.join(heavy, key).unionByName(rest.join(light, key, how))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index in the component of each of n nodes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (u, v) of each chunk as (node, least node of its component in the chunk)."""

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u = np.concatenate([b.column(0).to_numpy() for b in held])
        v = np.concatenate([b.column(1).to_numpy() for b in held])
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = roots(len(ids), at[: len(u)], at[len(u) :])
        leaf = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[leaf], pa.int64()), pa.array(ids[root[leaf]], pa.int64())], ["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= CHUNK:
            yield star(held)
            held, n = [], 0
    if n:
        yield star(held)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of the undirected edges (a long, b long) as rows (node, component),
    component being the smallest node that is reachable; nodes without an edge don't appear.

    Edges (u, v), v < u, become stars of the chunks they come in. Each round deals them out by u, makes
    stars again, and lets every edge jump from v to the least node that v itself points to, until
    no edge moves. A node is the u of one edge a chunk at most, so none is a hot key there; a v
    with many leaves is one, and its jump is broadcast (join_counted). No step makes more edges than it
    got. Rounds are tables in the shared folder, deleted once the next is written, so a lost
    executor costs no earlier round. Empty edges give an empty result; self loops and repeated
    edges change nothing.
    """
    pair = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
    e = cut_table(pair.mapInArrow(_stars, "u long, v long"))
    for _ in range(max_rounds):
        n = e.count()
        k = parts_for(e, n)
        told = cut_table(e.coalesce(k).repartition("u").mapInArrow(_stars, "u long, v long"), k)
        low = told.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"), F.max("v").alias("x"))
        many = told.groupBy("v").agg(F.count("*").alias("n"))
        jumps = many.join(low, "v", "left").select("v", "n", "m")
        moved = join_counted(told, jumps, "v", n, how="left").select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("moved"))
        new = cut_table(moved, k)
        still = new.where("moved").isEmpty() and low.where("m <> x").isEmpty()
        drop(e, told)
        e = new.select("u", "v")
        e._keyreel_path = new._keyreel_path
        if still:
            break
    else:
        raise RuntimeError("connected components did not settle")
    top = e.select(F.col("v").alias("node")).distinct()
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(top.select("node", F.col("node").alias("component")))
    out._keyreel_path = e._keyreel_path
    return out
