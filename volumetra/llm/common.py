"""What the corpus operators share: session set-up, lineage cuts, connected components."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Make checkpoints possible and let Python workers import this package.

    The folder is the one the cluster names in spark.checkpoint.dir. Only where that is unset and Spark runs in this
    process alone (local tests) one is made; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="volumetra-"))
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there.

    The files survive lost executors; Spark's cleaner removes them when no plan uses them.
    """
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, f"_{name}"
    while out.lower() in taken:
        out += "_"
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_cache: dict[str, object] = {}


def worker_cache(name: str, make):
    """What a Python worker remembers between tasks; another operator's cache makes room for it."""
    if name not in _cache:
        release()
        _cache[name] = make()
    return _cache[name]


def release() -> None:
    """Forget what this worker remembers and give the memory back to the system; without a cache nothing is done.

    Workers outlive a query, so an operator without a cache of its own calls this before it starts.
    """
    if not _cache:
        return
    _cache.clear()
    trim()


def trim() -> None:
    """Give this process's free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps what is freed between small blocks
    if free:
        free(0)


def tidy(spark: SparkSession) -> None:
    """Free what earlier steps left in the driver: Python's garbage first, since it holds the JVM's plans, broadcasts and checkpoints."""
    trim()
    spark.sparkContext._jvm.System.gc()


def hot_join(rows: DataFrame, table: DataFrame, key: str, count: str, most: int = 1_000) -> DataFrame:
    """Inner join of rows with a table that is distinct in key, where one key may hold a third of all rows.

    count names the column of table that says how many rows have its key; it goes. Keys with more than a `most`-th of all rows are
    `most` at most, so that part of the table is broadcast; the others are dealt out by key.
    """
    least = max(10_000, (table.agg(F.sum(count)).first()[0] or 0) // most)
    loud = table.where(F.col(count) > least).drop(count)
    quiet = table.where(F.col(count) <= least).drop(count)
    if loud.isEmpty():
        return rows.join(quiet, key)
    some = loud.select(key)
    is_loud = rows.join(F.broadcast(some), key, "left_semi").join(F.broadcast(loud), key)
    return is_loud.unionByName(rows.join(F.broadcast(some), key, "left_anti").join(quiet, key))


def word_count(text: Column) -> Column:
    """Number of maximal runs of other characters than space and \\x09-\\x0D; null has none.

    Where words are parted by single blanks, as in most texts, blanks are counted; only other texts are split.
    """
    t = text.cast("string")
    for blank in "\t\n\x0b\x0c\r":
        t = F.replace(t, F.lit(blank), F.lit(" "))
    plain = (t != "") & ~t.startswith(" ") & ~t.endswith(" ") & ~t.contains("  ")
    fast = F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit(""))) + 1
    return F.when(text.isNull(), 0).when(plain, fast).otherwise(F.size(F.array_remove(F.split(t, " "), ""))).cast("long")


SMALL = 1_000_000  # rows of one long column that may be broadcast


def narrowed(rows: DataFrame, keys: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows whose key is (left_semi) or is not (left_anti) among keys, a table of one long column.

    Up to SMALL keys, as counted here, are broadcast, so that wide rows need not be dealt out; more are joined by a shuffle.
    """
    return rows.join(F.broadcast(keys) if keys.limit(SMALL + 1).count() <= SMALL else keys, key, how)


ALONE = 1_000_000  # links that one task joins; more are first joined by rounds over all tasks


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of n nodes over links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        old = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, old[a], low)
        np.minimum.at(label, old[b], low)
        label = label[label]
        if (label == old).all():
            break
    return label


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all links (a, b) at once."""
    parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
    if parts:
        a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = forest(at[: len(a)], at[len(a) :], len(node))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[label])], ["node", "component"])


def components(links: DataFrame, alone: int = ALONE) -> DataFrame:
    """Connected components of the undirected links (a, b), by alternating stars.

    links: columns a, b of longs, in any order, repeats and a = b allowed. Returns (node, component)
    for every node of a proper link; component is the smallest node reachable. Each round
    aggregates per node with map-side combining; nothing is collected but one checksum. Up to `alone` links
    are joined in one task instead, since each round is a dozen small jobs whose plans the driver holds; the result is the same.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
        if 0 < state[0] <= alone:
            return cut(edges.coalesce(1).mapInArrow(_joined, "node long, component long"))
        if state[0] == 0 or state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
