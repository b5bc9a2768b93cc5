"""Minimax contiguous sharding of atomic groups, in DataFrame operations only."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

BITS = 60  # of the order key
FIRST = 12  # bits of it in the first summary
FINER = 6  # more bits at each refinement


def _reach(ends: list[int], start: int, room: int) -> int:
    """The last boundary at most start + room."""
    return ends[bisect_right(ends, start + room) - 1]


def _fits(ends: list[int], shards: int, room: int, loose: list[tuple[int, int]] | None = None) -> tuple[bool, list[int]]:
    """Cut greedily with capacity room. loose: spans whose inner boundaries are unknown;
    with them every position inside counts as a boundary, which gives the optimistic answer."""
    at, cuts = 0, []
    starts = [a for a, _ in loose] if loose else []
    for _ in range(shards):
        goal = at + room
        new = _reach(ends, at, room)
        if loose:
            i = bisect_right(starts, goal) - 1
            if i >= 0 and loose[i][0] < goal < loose[i][1]:
                new = goal
        cuts.append(new)
        at = new
        if at >= ends[-1]:
            return True, cuts
    return False, cuts


def _smallest(ends: list[int], shards: int, low: int, loose: list[tuple[int, int]] | None = None) -> int:
    """Binary search for the smallest capacity with which the greedy cuts suffice."""
    high = ends[-1]
    low = min(low, high)
    while low < high:
        mid = (low + high) // 2
        if _fits(ends, shards, mid, loose)[0]:
            high = mid
        else:
            low = mid + 1
    return low


def _even(ends: list[int], shards: int, room: int) -> list[int]:
    """shards - 1 cuts that keep to the capacity, each nearest to an even share of what is left.

    Filling greedily from the end says how far each cut must reach at least.
    """
    least, at = [], ends[-1]
    for _ in range(shards - 1):
        at = ends[bisect_left(ends, max(0, at - room))]
        least.append(at)
    cuts, at = [], 0
    for j, low in enumerate(reversed(least)):
        ideal = at + (ends[-1] - at) / (shards - j)
        i = bisect_left(ends, ideal)
        near = [e for e in ends[max(0, i - 1) : i + 1] if max(low, at) <= e <= at + room]
        at = min(near, key=lambda e: (abs(e - ideal), e)) if near else max(at, low) if ideal < low else _reach(ends, at, room)
        cuts.append(at)
    return cuts


def plan_cuts(summary, shards: int) -> tuple[list[int], list[int]]:
    """Find the cuts over groups in the order of their keys.

    summary(depth, prefixes): rows (prefix, bytes, least key, greatest key) of the groups by the
    first `depth` bits of the key, of the given prefixes of the previous depth only, or of all.

    A prefix with one key is one atomic group. In the order that is cut, groups above the mean of what is left come first, the largest
    first, and each fills a shard: at most shards - 1 of them. The others follow by key, and for them the
    smallest feasible capacity is searched by bisection on the boundaries known so far, both
    pessimistically (only those) and optimistically (any position inside a prefix that still
    holds several groups). While the two differ, prefixes that a cut can fall into are
    summarised at more bits. What the driver holds is bounded by 2**FIRST rows and the windows of
    shards - 1 cuts, not by the number of groups.

    Returns keys of the groups with own shards, and for the other shards the greatest key each
    may hold.
    """
    cells = {(FIRST, r[0]): r for r in summary(FIRST, None)}  # (depth, prefix) -> row

    def refine(which: list[tuple[int, int]]) -> None:
        by: dict[int, list[int]] = {}
        for depth, prefix in which:
            by.setdefault(depth, []).append(prefix)
            del cells[depth, prefix]
        for depth, prefixes in by.items():
            finer = min(BITS, depth + FINER)
            cells.update({(finer, r[0]): r for r in summary(finer, (depth, prefixes))})

    whole = sum(r[1] for r in cells.values())
    while True:  # until no prefix of several groups may hide a group that needs its own shard
        own, rest, left = [], whole, shards
        for r in sorted((r for r in cells.values() if r[2] == r[3]), key=lambda r: (-r[1], r[2])):
            if left > 1 and r[1] * left > rest:
                own.append(r[2])
                rest, left = rest - r[1], left - 1
        vague = [k for k, r in cells.items() if r[2] != r[3] and r[1] * left > rest]
        if not vague:
            break
        refine(vague)
    held = set(own)
    while True:
        row = sorted((r[2], r[3], r[1], k) for k, r in cells.items() if not (r[2] == r[3] and r[2] in held))
        if not row:
            return own, []
        ends, loose, at = [0], [], 0
        for low, high, size, k in row:
            if low != high:
                loose.append((at, at + size, k))
            at += size
            ends.append(at)
        spans = [(a, b) for a, b, _ in loose]
        floor = -(-at // left)
        most = _smallest(ends, left, floor)
        least = _smallest(ends, left, floor, spans) if spans else most
        if least == most:
            last = {e: row[i - 1][1] for i, e in enumerate(ends) if i}
            return own, [last.get(c, -1) for c in _even(ends, left, most)]
        low_cuts, high_cuts = _fits(ends, left, least)[1], _fits(ends, left, most, spans)[1]
        which, starts = set(), [a for a, _, _ in loose]
        for j in range(left):
            lo = low_cuts[j] if j < len(low_cuts) else at
            hi = high_cuts[j] if j < len(high_cuts) else at
            i = max(0, bisect_right(starts, lo) - 1)
            while i < len(loose) and loose[i][0] <= hi:
                if loose[i][1] > lo:
                    which.add(loose[i][2])
                i += 1
        refine(sorted(which) or [loose[0][2]])


def shard(df: DataFrame, shards: int = 40, extra: int = 16) -> DataFrame:
    """Cut documents into shards of nearly equal bytes; equal texts stay together.

    df: columns doc_id, text; others are dropped. Returns doc_id, size (UTF-8 bytes of
    the text plus `extra`), text_crc32, law (`bytes`), shard, slot (gapless from 0 in each
    shard) and grown_shard (null under this law).

    A group is all rows with one text. Groups are in the order of a hash of the text, so shards are
    alike in content; the cuts have the least possible maximum for that order (plan_cuts). Null
    text is empty text. Rows that are equal stay separate rows with slots of their own; a null doc_id is a value like any other. With fewer
    groups than shards some shards stay empty; an empty table gives an empty result. Groups of one size keep the order of their hashes.

    One shuffle carries 40-byte rows to number the slots: rows are spread by a hash of doc_id, so a
    text that fills a third of the table is dealt out as evenly as any other.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")
    slim = cut(df.select("doc_id", (F.octet_length(text) + extra).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("o")))

    def summary(depth: int, within: tuple[int, list[int]] | None) -> list[tuple[int, int, int, int]]:
        rows = slim
        if within:
            asked = df.sparkSession.createDataFrame([(p,) for p in within[1]], "q long")
            rows = rows.join(F.broadcast(asked), F.shiftright("o", BITS - within[0]) == F.col("q"), "left_semi")
        return [tuple(r) for r in rows.groupBy(F.shiftright("o", BITS - depth).alias("p")).agg(F.sum("size"), F.min("o"), F.max("o")).collect()]

    own, ends = plan_cuts(summary, shards)
    rank = F.lit(len(own))
    if ends:
        rank = rank + F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e < F.col("o")))
    if own:
        rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, o in enumerate(own) for x in (o, i)]), F.col("o")), rank)
    placed = slim.select("doc_id", "size", "text_crc32", rank.cast("int").alias("shard"))
    rows = max(1, slim.count() // 20_000)
    placed = placed.withColumn("_cell", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(rows)))
    cells = placed.groupBy("shard", "_cell").count()
    before = cells.select("shard", "_cell", F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_cell", "shard").orderBy("doc_id", "text_crc32", "size"))
    return placed.withColumn("_n", number - 1).join(before, ["shard", "_cell"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_n") + F.col("_before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
