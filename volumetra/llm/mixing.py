"""Mixing overlapping sources to target weights by min-cost flow."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, word_count

def min_cost_flow(supply: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], copies: int = 2) -> list[dict[tuple[int, int], int]]:
    """Route capacity of patterns to quotas of sources, cheapest repetition first.

    supply[p]: tokens of pattern p; members[p]: the sources it may serve. The k-th copy of a
    token costs k, so each pattern has `copies` parallel arcs of convex cost. Successive
    shortest paths with potentials. Returns per pattern {(source, copy): tokens}; flow is the
    largest possible, and of those the one with least total cost.
    """
    n_p, n_s = len(supply), len(quotas)
    start, end = n_p + n_s, n_p + n_s + 1
    graph: list[list[list[int]]] = [[] for _ in range(n_p + n_s + 2)]

    def arc(u: int, v: int, cap: int, cost: int) -> list[int]:
        graph[u].append([v, cap, cost, len(graph[v])])
        graph[v].append([u, 0, -cost, len(graph[u]) - 1])
        return graph[u][-1]

    entry = [[arc(start, p, supply[p], k + 1) for k in range(copies)] for p in range(n_p)]
    serve = [[(s, arc(p, n_p + s, copies * supply[p], 0)) for s in members[p]] for p in range(n_p)]
    for s in range(n_s):
        arc(n_p + s, end, quotas[s], 0)
    potential = [0] * len(graph)
    while True:
        far, via = [None] * len(graph), [None] * len(graph)
        far[start], heap = 0, [(0, start)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for i, (v, cap, cost, _) in enumerate(graph[u]):
                if cap > 0:
                    e = d + cost + potential[u] - potential[v]
                    if far[v] is None or e < far[v]:
                        far[v], via[v] = e, (u, i)
                        heapq.heappush(heap, (e, v))
        if far[end] is None:
            break
        for v, d in enumerate(far):
            potential[v] += d if d is not None else far[end]
        push, v = None, end
        while v != start:
            u, i = via[v]
            push = graph[u][i][1] if push is None else min(push, graph[u][i][1])
            v = u
        v = end
        while v != start:
            u, i = via[v]
            graph[u][i][1] -= push
            graph[v][graph[u][i][3]][1] += push
            v = u
    out = []
    for p in range(n_p):
        left = [supply[p] - a[1] for a in entry[p]]
        got: dict[tuple[int, int], int] = {}
        for s, a in serve[p]:
            flow = copies * supply[p] - a[1]
            for k in range(copies):
                part = min(flow, left[k])
                if part:
                    got[s, k] = part
                    flow, left[k] = flow - part, left[k] - part
        out.append(got)
    return out


def targets(sizes: Sequence[int], weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, most: float = 2.0) -> list[float]:
    """Shares of budget x all sizes by the repeating weights, none above most x its size.

    The excess of a source over its ceiling is shared out again by weight among the rest.
    """
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    total, out = budget * sum(sizes), [0.0] * len(sizes)
    open_ = set(range(len(sizes)))
    while open_:
        each = total / sum(w[i] for i in open_)
        over = {i for i in open_ if w[i] * each > most * sizes[i]}
        for i in over or open_:
            out[i] = float(most * sizes[i]) if over else w[i] * each
        if not over:
            break
        total -= sum(out[i] for i in over)
        open_ -= over
    return out


def mix(df: DataFrame, membership: str = "source", weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, most: int = 2, seed: int = 7) -> DataFrame:
    """Say how many times each document enters the mixture.

    df: any columns, among them doc_id, text and `membership`, a source name or an array of
    the sources that hold the document. Adds
    _size (words), _source_size and _target (of its first source in code-point order), _copies
    (0 to most: whole documents only) and _for (one source per copy).

    Documents are aggregated by membership pattern (map-side, so a source that holds a third
    of all rows costs no more); the driver sees one row per pattern. Flow fixes how many words
    each pattern gives to each source and at which repetition. Within a pattern documents come
    in the order of a seeded hash, each taken if it still fits: a pass ends at the first that does not, and the next goes on
    behind it over those no larger than the gap. So the error stays under the smallest of those left over (rows that repeat
    doc_id and text count as one; a null doc_id is a value like any other). Reruns agree, whatever the partitioning.

    Null or empty text has size 0 and is taken once wherever its whole pattern is. A null source, or an empty
    array, counts as one source named null, last in order. Equal rows get equal answers. An empty table gives an empty result.
    """
    kind = df.schema[membership].dataType
    names = F.array_sort(F.array_distinct(F.col(membership))) if isinstance(kind, T.ArrayType) else F.array(F.col(membership).cast("string"))
    names = F.when(F.size(F.coalesce(names, F.array())) == 0, F.array(F.lit(None).cast("string"))).otherwise(names)
    base = df.withColumn("_size", word_count(F.col("text"))).withColumn("_names", names).withColumn("_u", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), 2))
    slim = cut(base.select("_names", "_size", "_u"))
    groups = sorted((list(r["_names"]), r["s"] or 0, r["n"]) for r in [x.asDict() for x in slim.groupBy("_names").agg(F.sum("_size").alias("s"), F.count("*").alias("n")).collect()] if not any(v is None for v in r["_names"]))
    nulls = [(list(r["_names"]), r["s"] or 0, r["n"]) for r in slim.where(F.exists("_names", lambda x: x.isNull())).groupBy("_names").agg(F.sum("_size").alias("s"), F.count("*").alias("n")).collect()]
    groups += nulls
    rank = lambda v: (v is None, (v or "").encode())
    sources = sorted({v for g in groups for v in g[0]}, key=rank)
    at = {v: i for i, v in enumerate(sources)}
    held = [0] * len(sources)
    for g in groups:
        for v in g[0]:
            held[at[v]] += g[1]
    want = targets(held, weights, budget * sum(g[1] for g in groups) / max(1, sum(held)), most)
    flow = min_cost_flow([g[1] for g in groups], [[at[v] for v in g[0]] for g in groups], [round(t) for t in want], most)

    plan = []  # per pattern: whole copies, words of the last copy
    for g, f in zip(groups, flow, strict=True):
        words = sum(f.values())
        whole = min(most, words // g[1]) if g[1] else 1
        first = min(g[0], key=rank)
        shares = [[sum(v for (s, _), v in f.items() if s == i), sources[i]] for i in sorted({s for s, _ in f})]
        plan.append((g[0], int(whole), int(words - whole * g[1]), int(held[at[first]]), float(want[at[first]]), shares))
    spark = df.sparkSession
    schema = "_names array<string>, _whole int, _rest long, _source_size long, _target double, _shares array<struct<words:long,source:string>>"
    table = spark.createDataFrame([(n, w, r, s, t, [(int(a), b) for a, b in sh]) for n, w, r, s, t, sh in plan], schema)

    rows = sum(g[2] for g in groups)
    bits = max(0, (rows // 20_000).bit_length())  # hash ranges of some 20,000 rows
    key = lambda c: F.to_json(F.struct(c))  # noqa: E731  arrays with nulls as join keys
    table = table.withColumn("_key", key(F.col("_names"))).drop("_names")
    slim = slim.select(key(F.col("_names")).alias("_key"), "_size", "_u").withColumn("_b", F.shiftrightunsigned("_u", 62 - bits).cast("int"))
    slim, taken, gaps = cut(slim), {}, {}  # taken, per pattern: (after, up to, largest size), by hash
    state = [(k, -1, r) for k, r in ((r["_key"], r["_rest"]) for r in table.select("_key", "_rest").collect())]
    while state:
        bound = F.broadcast(spark.createDataFrame(state, "_key string, _after long, _gap long"))
        # in the first pass a document over the whole rest stops the order too, as it always did
        open_ = slim.join(bound, "_key").where((F.col("_u") > F.col("_after")) & ((F.col("_after") < 0) | ((F.col("_size") > 0) & (F.col("_size") <= F.col("_gap")))))
        cells = open_.groupBy("_key", "_b").agg(F.sum("_size").alias("s"))
        upto = cells.withColumn("_before", F.coalesce(F.sum("s").over(Window.partitionBy("_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        edge = F.broadcast(upto.join(bound.select("_key", "_gap"), "_key").where("_before <= _gap").groupBy("_key").agg(F.max_by(F.struct("_b", "_before"), "_b").alias("e")).select("_key", F.col("e._b").alias("_eb"), F.col("e._before").alias("_before")))
        inner = open_.join(edge, "_key").where("_b = _eb")
        run = inner.withColumn("_cum", F.col("_before") + F.sum("_size").over(Window.partitionBy("_key").orderBy("_u").rangeBetween(Window.unboundedPreceding, 0)))
        fits = F.col("_cum") <= F.col("_gap")
        ends = run.groupBy("_key").agg(F.max(F.when(fits, F.col("_u"))).alias("lu"), F.max(F.when(fits, F.col("_cum"))).alias("got"), F.min(F.when(~fits, F.col("_u"))).alias("stop"), F.first("_before").alias("before"), F.first("_eb").alias("eb")).collect()
        was, state = {k: x for k, *x in state}, []
        for r in ends:
            after, gap = was[r["_key"]]
            end = r["lu"] if r["lu"] is not None else (r["eb"] << (62 - bits)) - 1
            left = gap - (r["before"] if r["got"] is None else r["got"])
            taken.setdefault(r["_key"], []).append((after, end, gap if after >= 0 else None))
            if r["stop"] is not None and left > 0:
                state.append((r["_key"], r["stop"], left))
    ends = spark.createDataFrame(list(taken.items()), "_key string, _spans array<struct<a:long,b:long,most:long>>")
    table = F.broadcast(table.join(ends, "_key", "left"))
    within = lambda x: (F.col("_u") > x["a"]) & (F.col("_u") <= x["b"]) & (x["most"].isNull() | ((F.col("_size") > 0) & (F.col("_size") <= x["most"])))
    extra = F.exists("_spans", within) & (F.col("_rest") > 0)
    out = base.withColumn("_key", key(F.col("_names"))).join(table, "_key", "left")
    out = out.withColumn("_copies", F.col("_whole") + F.when(extra, 1).otherwise(0))
    # which source a copy counts for: sources of the pattern in proportion to their flow, by the same hash
    total = F.aggregate("_shares", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    spot = lambda i: F.floor(total * (F.pmod(F.xxhash64(F.lit(seed), F.lit("for"), i, F.col("doc_id"), F.col("text")), F.lit(1 << 30)) / F.lit(float(1 << 30))))
    chosen = F.transform(F.sequence(F.lit(1), F.greatest(F.col("_copies"), F.lit(1))), lambda i: F.aggregate("_shares", F.struct(spot(i).alias("left"), F.lit(None).cast("string").alias("s")), lambda a, x: F.when(a["left"] < 0, a).when(a["left"] < x["words"], F.struct(F.lit(-1).cast("long").alias("left"), x["source"].alias("s"))).otherwise(F.struct((a["left"] - x["words"]).alias("left"), a["s"].alias("s"))))["s"])
    out = out.withColumn("_for", F.when(F.col("_copies") > 0, chosen).otherwise(F.array().cast("array<string>")))
    return out.drop("_names", "_u", "_key", "_whole", "_rest", "_shares", "_spans")
