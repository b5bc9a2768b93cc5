"""Exact top-k inner products with block-at-a-time pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, prepare

K = 20
SCALE = 64
BLOCK = 64  # vectors of one block
STRIDE = 16  # blocks of its order that a query scores at a time
RANGE = 8192  # vectors of one range of blocks
CHUNK = 4096  # queries that meet a range together
SUMMARY = 2048  # ranges, or runs of ranges, whose term maxima the workers hold
NONE = -(1 << 63) + 1  # no score; its negative is a 64-bit number
LAST = (1 << 63) - 1


def quantised(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and q: floor(scale * x) of each component; vectors that are null, or hold null or non-finite components, go."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return df.where(F.col("embedding").isNotNull() & ~bad).select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("q"))


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of arrays of numbers, filled with zeros to one width."""
    flat = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes, values = flat.value_lengths().to_numpy(), flat.flatten().to_numpy()
    if (sizes == width).all():
        return values.reshape(-1, width).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _kind(queries: np.ndarray, vectors: np.ndarray):
    """The cheapest type in which all inner products are exact; Python's integers beyond 64 bits."""
    most = max(map(abs, (int(queries.max(initial=0)), int(queries.min(initial=0))))) * max(map(abs, (int(vectors.max(initial=0)), int(vectors.min(initial=0))))) * queries.shape[1]
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object


def _long(scores: np.ndarray) -> np.ndarray:
    return np.clip(scores, NONE + 1, LAST).astype(np.int64)


def bounds(q: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each query and block: the sum over the terms (components) of the greater of weight * maximum and weight * minimum."""
    return np.maximum(q, 0) @ most.T + np.minimum(q, 0) @ least.T


def _top(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k best of each line: greatest score, then smallest id, then smallest row."""
    order = np.lexsort((rows, ids, -scores), axis=1)[:, :k]
    return tuple(np.take_along_axis(x, order, 1) for x in (scores, ids, rows))


def search(queries: np.ndarray, query_rows: np.ndarray, floor: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, block: int = BLOCK, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Top k of each query among vectors (both integer matrices); scores under `floor` are not needed.

    Blocks are ranges of `block` vectors. Each query visits blocks in falling order of its bound, `stride` at a time, scores
    those whose bound reaches its k-th score through their forward index (their rows), and stops when the next bound is below
    it. Returns scores, ids and rows (-1 where there are less than k), and how many (query, block) pairs were scored.
    """
    kind = _kind(queries, vectors)
    q, v = queries.astype(kind), vectors.astype(kind)
    starts = np.arange(0, len(v), block)
    bound = _long(bounds(q, np.maximum.reduceat(v, starts, axis=0), np.minimum.reduceat(v, starts, axis=0)))
    order = np.argsort(-bound, axis=1, kind="stable")
    scores = np.full((len(q), k), NONE, np.int64)
    found, at_rows = np.full((len(q), k), LAST, np.int64), np.full((len(q), k), LAST, np.int64)
    active, visited = np.arange(len(q)), 0
    for step in range(0, len(starts), stride):
        b = order[active, step : step + stride]
        kth = np.maximum(scores[active, -1], floor[active])
        go = np.take_along_axis(bound[active], b, 1) >= kth[:, None]
        left = go[:, 0]  # bounds fall along the order
        who, b = np.repeat(active, go.sum(1)), b[go]
        active = active[left]
        if not len(who):
            break
        visited += len(who)
        by = np.argsort(b, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(b[by])) + 1):
            at, s = who[part], starts[b[part[0]]]
            there = slice(s, min(len(v), s + block))
            new = _long(q[at] @ v[there].T)
            new[query_rows[at][:, None] == rows[there][None]] = NONE
            hit = np.flatnonzero((new >= np.maximum(np.maximum(scores[at, -1], floor[at]), NONE + 1)[:, None]).any(1))
            if len(hit):
                mine, wide = at[hit], (len(hit), there.stop - there.start)
                scores[mine], found[mine], at_rows[mine] = _top(np.hstack([scores[mine], new[hit]]), np.hstack([found[mine], np.broadcast_to(ids[there], wide)]), np.hstack([at_rows[mine], np.broadcast_to(rows[there], wide)]), k)
    none = scores == NONE
    found[none], at_rows[none] = -1, -1
    return scores, found, at_rows, visited


def top_k(df: DataFrame, every: int = 20, k: int = K, scale: int = SCALE, size: int = RANGE, chunk: int = CHUNK) -> DataFrame:
    """The k greatest integer inner products of each query with all other rows, ties to the smaller vec_id.

    df: vec_id, embedding (arrays of numbers; vectors of other lengths are compared as if filled with zeros). Queries
    are the rows whose vec_id is divisible by `every`; rows with null vec_id take no part, as queries or candidates. A query's
    own row is no candidate, but other rows with its vec_id are: rows that repeat a vec_id are rows of their own. Components and
    scores beyond 64 bits are held to their ends. Returns query_id, rank, vec_id, score; an empty table gives an empty result. Extra
    columns are ignored.

    Vectors are ordered by their two largest components, so that blocks are alike, and dealt by ranges of that
    order. A first pass searches each range for the queries in it; its k-th score is a floor
    for the second. The maxima and minima of all ranges (of runs of ranges, beyond SUMMARY of them) go to the workers, and a query is
    sent only to ranges whose bound reaches its floor, a range's rows only to the chunks of queries that ask for it. Where vectors have no
    common directions no bound is below the floor, and the work is that of a stated query set against all rows, in blocks.
    """
    spark = prepare(df.sparkSession)
    rows = quantised(df, scale).where("vec_id is not null")
    lead = F.slice(F.sort_array(F.zip_with("q", F.sequence(F.lit(1), F.size("q")), lambda x, i: F.struct((-x).alias("x"), i.alias("i")))), 1, 2)
    rows = cut(rows.withColumn("o", F.when(F.size("q") > 0, F.to_json(F.transform(lead, lambda s: s["i"])))))
    total, width = rows.agg(F.count("*"), F.max(F.size("q"))).first()
    width = max(1, width or 1)
    ranges = max(1, -(-total // size))
    rows = cut(rows.repartitionByRange(ranges, "o", "vec_id").select("vec_id", "q", F.spark_partition_id().alias("s"), F.monotonically_increasing_id().alias("row")))
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    out = "query_row long, query_id long, vec_id long, row long, score long"

    def answer(qrow, qid, scores, found, at_rows) -> pa.Table:
        on = scores > NONE
        wide = lambda x: np.broadcast_to(x[:, None], found.shape)[on]
        return pa.table({"query_row": wide(qrow), "query_id": wide(qid), "vec_id": found[on], "row": at_rows[on], "score": scores[on]})

    def home(t: pa.Table) -> pa.Table:
        ids, at, m = t.column("vec_id").to_numpy(), t.column("row").to_numpy(), _matrix(t.column("q"), width)
        mine = np.flatnonzero(ids % every == 0)
        scores, found, at_rows, _ = search(m[mine], at[mine], np.full(len(mine), NONE), m, ids, at, k)
        return answer(at[mine], ids[mine], scores, found, at_rows)

    first = cut(rows.groupBy("s").applyInArrow(home, out))
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    rest = first
    if ranges > 1:
        group = -(-ranges // SUMMARY)  # ranges of one run

        def extremes(t: pa.Table) -> pa.Table:
            m = _matrix(t.column("q"), width)
            return pa.table({"g": pa.array([t.column("s")[0].as_py() // group]), "most": pa.array([m.max(0).tolist()]), "least": pa.array([m.min(0).tolist()])})

        found = rows.groupBy("s").applyInArrow(extremes, "g long, most array<long>, least array<long>").groupBy("g")
        ends = found.agg(*[F.array(*[f(F.col(c)[i]) for i in range(width)]).alias(c) for f, c in ((F.max, "most"), (F.min, "least"))]).orderBy("g").collect()
        runs, most, least = [r["g"] for r in ends], np.array([r["most"] for r in ends], np.int64), np.array([r["least"] for r in ends], np.int64)
        kth = first.groupBy("query_row").agg(F.count("*").alias("n"), F.min("score").alias("kth")).select("query_row", F.when(F.col("n") >= k, F.col("kth")).alias("kth"))
        chunks = max(1, -(-(total // every) // chunk))
        asked = queries.join(kth, F.col("row") == F.col("query_row"), "left").select(F.col("row").alias("qrow"), F.col("vec_id").alias("qid"), F.col("q").alias("qq"), F.coalesce("kth", F.lit(NONE)).alias("kth"), F.col("s").alias("qs"), F.pmod(F.xxhash64("row"), F.lit(chunks)).alias("qc"))
        names = ["qrow", "qid", "qq", "kth", "qs", "qc"]

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """One row per query and other range that its floor leaves open."""
            for b in batches:
                for i in range(0, b.num_rows, 512):
                    part = b.slice(i, 512)
                    q, floor, at = _matrix(part.column("qq"), width), part.column("kth").to_numpy(), part.column("qs").to_numpy()
                    kind = _kind(q, np.vstack([most, least]))
                    who, run = np.nonzero(_long(bounds(q.astype(kind), most.astype(kind), least.astype(kind))) >= floor[:, None])
                    to = (np.array(runs)[run][:, None] * group + np.arange(group)).reshape(-1)
                    who = np.repeat(who, group)
                    ok = (to < ranges) & (to != at[who])
                    part = part.take(pa.array(who[ok]))
                    yield pa.RecordBatch.from_arrays([part.column(c) if c != "qs" else pa.array(to[ok].astype(np.int32)) for c in names], names)

        asked = cut(asked.mapInArrow(ask, "qrow long, qid long, qq array<long>, kth long, qs int, qc long"))
        pairs = asked.select(F.col("qs").alias("s"), F.col("qc").alias("c")).distinct()
        there = rows.join(pairs, "s").select("vec_id", "q", "row", "s", "c")

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            if not len(left) or not len(right):
                return pa.table({c: pa.array([], pa.int64()) for c in ("query_row", "query_id", "vec_id", "row", "score")})
            qrow, qid, q = left.column("qrow").to_numpy(), left.column("qid").to_numpy(), _matrix(left.column("qq"), width)
            ids, at, m = right.column("vec_id").to_numpy(), right.column("row").to_numpy(), _matrix(right.column("q"), width)
            scores, found, at_rows, _ = search(q, qrow, left.column("kth").to_numpy(), m, ids, at, k)
            return answer(qrow, qid, scores, found, at_rows)

        rest = first.unionByName(asked.groupBy("qs", "qc").cogroup(there.groupBy("s", "c")).applyInArrow(meet, out))
    return rest.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
