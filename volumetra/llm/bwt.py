"""Exact repeated strings, found by merging Burrows-Wheeler transforms of shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chaining import _runs
from .common import cut, prepare

LENGTH = 200  # bytes of a repeated string
SYMBOL = 8  # bytes of one symbol of a transform
GRAM = 16  # bytes of the grams whose least hash places a window
STEP = 56  # windows that share a name at most
SPAN = LENGTH - GRAM + 1  # grams in a window
LOAD = 50_000  # bytes of snippets merged together, as far as whole groups allow
SHARD = 1 << 14  # symbols of one shard's transform
HOT = 20_000  # different runs under one name from which it is split into single windows
SAMPLE = 32  # one text in so many is counted to find such names
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SALT = np.uint64(0x5851F42D4C957F2D)
BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
PIECE = 1 << 14  # windows hashed at a time
PLACE = np.uint64((1 << 15) - 1)  # low bits of a gram's hash that give way to its place
INDEX = np.arange(PIECE + LENGTH, dtype=np.uint64)
STEPS = np.arange(0, SPAN, STEP)


def _powers(x: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = x
    return np.multiply.accumulate(out)


UP, DOWN = _powers(BASE, PIECE + LENGTH), _powers(INVERSE, PIECE + LENGTH)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, by doubling."""
    out, have = h, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def segments(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Name every window of LENGTH bytes by the bytes around its least gram: (name, low, high, whole).

    A window's place is that of its leftmost gram of least hash. How far the gram lies from the window's start, in
    steps of STEP, says which bytes around it every such window has; their hash is the name. Windows low to high
    share one gram and one name, high - low < STEP, and none of them equal each other. whole hashes all bytes of the run, and how
    many; with the name it makes 128 bits. Equal windows have equal names wherever they are.
    """
    names, lows, highs, wholes = [], [], [], []
    n = len(text) - LENGTH + 1
    codes = np.frombuffer(text, np.uint8)
    for a in range(0, max(0, n), PIECE):
        many = min(PIECE, n - a)  # windows
        sums = np.zeros(many + LENGTH, np.uint64)
        np.cumsum(BYTES[codes[a : a + many + LENGTH - 1]] * UP[: many + LENGTH - 1], out=sums[1:])
        grams = _mix((sums[GRAM:] - sums[:-GRAM]) * DOWN[: many + LENGTH - GRAM])
        grams &= ~PLACE
        grams |= INDEX[: len(grams)]
        at = (_least(grams, SPAN) & PLACE).astype(np.int64)  # the leftmost least gram of each window
        low = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        high = np.concatenate([low[1:], [many]]) - 1
        g = at[low]
        split = (g[:, None] - STEPS + 1)[:, 1:]  # where the distance to the gram falls below each step
        more = split[(split > low[:, None]) & (split <= high[:, None])]
        low = np.sort(np.concatenate([low, more]))
        high = np.concatenate([low[1:], [many]]) - 1
        g = at[low]
        k = (g - low) // STEP
        start, stop = g - STEPS[k], g - np.minimum(STEPS[k] + STEP, SPAN) + 1 + LENGTH
        whole = lambda p, q: _mix((sums[q] - sums[p]) * DOWN[p])
        names.append(_mix(whole(start, stop) + k.astype(np.uint64) * BASE))
        wholes.append(_mix(whole(low, high + LENGTH) + (high - low).astype(np.uint64) * BASE + SALT))
        lows.append(low + a)
        highs.append(high + a)
    if not names:
        none = np.empty(0, np.int64)
        return none, none, none, none
    return np.concatenate(names).view(np.int64), np.concatenate(lows), np.concatenate(highs), np.concatenate(wholes).view(np.int64)


def single_windows(text: bytes, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of runs one by one: (name, place, whole), from 128 bits of a hash of all their bytes."""
    at = np.concatenate([np.arange(a, b + 1) for a, b in zip(low.tolist(), high.tolist(), strict=True)])
    digests = b"".join(xxhash.xxh3_128_digest(text[a : a + LENGTH]) for a in at.tolist())
    both = np.frombuffer(digests, np.int64).reshape(-1, 2)
    return both[:, 0], at, both[:, 1]


class Shard:
    """Burrows-Wheeler transform of a collection of symbol strings, each with an end of its own.

    symbols: all strings one after another, symbols from 1 on, each string followed by 0.
    order: suffixes sorted; transform: the symbol before each (0 before a string's first).
    """

    def __init__(self, symbols: np.ndarray, depth: int):
        ends = np.flatnonzero(symbols == 0)
        rank = symbols.astype(np.int64) + len(ends)
        rank[ends] = np.arange(len(ends))
        narrow = len(rank) + 1 < 1 << 16  # then ranks are short integers, which numpy sorts by radix
        rank = rank.astype(np.uint16 if narrow else np.int64)
        far = 1
        self.order = np.argsort(rank, kind="stable")
        while far < depth:
            ahead = np.zeros_like(rank)
            ahead[:-far] = rank[far:]
            order = np.argsort(ahead, kind="stable")
            self.order = order = order[np.argsort(rank[order], kind="stable")]
            r, h = rank[order], ahead[order]
            new = np.zeros(len(r), bool)
            new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
            rank = np.empty_like(rank)
            rank[order] = np.cumsum(new, dtype=rank.dtype)
            far *= 2
        before = np.zeros_like(symbols)
        before[1:] = symbols[:-1]
        self.transform = before[self.order]


def merge(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave the transforms of shards: (which shard each row comes from, longest common prefix with the row before).

    Round k moves every row to the place of the suffix that starts one symbol earlier, stably by that symbol; after it
    the interleave is sorted by the first k symbols. Rows that have parted there get a boundary, and the round in which it appears says how
    many symbols they have in common: k - 1. Rows that `depth` rounds leave together have `depth` or more. No suffixes are compared.
    """
    side = np.repeat(np.arange(len(transforms)), [len(x) for x in transforms])
    by_shard = np.concatenate(transforms)
    starts = np.cumsum([0, *(len(x) for x in transforms)])
    side = side.astype(np.uint16 if len(transforms) < 1 << 16 else np.int64)
    block = np.zeros(len(side), np.int32)
    common = np.full(len(side), depth, np.int32)
    common[:1] = 0
    for k in range(1, depth + 1):
        symbol = np.empty(len(side), by_shard.dtype)
        order = np.argsort(side, kind="stable")  # rows of each shard, in their order
        symbol[order] = by_shard
        order = np.argsort(symbol, kind="stable")
        symbol, block = symbol[order], block[order]
        side = side[order]
        new = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1]) | (symbol[1:] == 0)
        at = np.flatnonzero(new) + 1
        parted = at[common[at] >= k]
        common[parted] = k - 1
        block = np.concatenate([[0], np.cumsum(new, dtype=np.int32)])
    return side, common


def intervals(common: np.ndarray, depth: int) -> np.ndarray:
    """Number of the repeated interval of each row: neighbours with `depth` symbols in common are in one."""
    return np.cumsum(common < depth) - 1


def repeated_starts(snippets: list[bytes], length: int = LENGTH, symbol: int = SYMBOL) -> list[np.ndarray]:
    """Per snippet the starts whose `length` bytes also start at another place of this collection.

    A snippet is read as `symbol` strings, one per phase, of symbols of that many bytes, so length / symbol rounds decide on
    whole strings. The collection is cut into shards of some SHARD symbols, each with a transform of its own, and those are merged.
    """
    depth = length // symbol
    sizes = np.array([len(x) for x in snippets], np.int64)
    many = np.maximum(sizes - symbol + 1, 0)  # symbols that start in each snippet
    if not many.sum():
        return [np.empty(0, np.int64)] * len(snippets)
    text = b"".join(snippets) + bytes(symbol)
    who = np.repeat(np.arange(len(snippets)), many)
    at = np.arange(len(who)) - (np.cumsum(many) - many)[who]
    value = np.ndarray((len(text) - symbol + 1,), "<u8" if symbol == 8 else np.uint8, text, strides=(1,))[(np.cumsum(sizes) - sizes)[who] + at]
    # strings lie phase after phase, each with an end
    phase, base, n = at % symbol, np.cumsum(many + symbol) - many - symbol, many[who]
    slot = base[who] + phase * (n // symbol) + np.minimum(phase, n % symbol) + phase + at // symbol
    owner = np.full(int((many + symbol).sum()), -1, np.int64)
    place, raw = owner.copy(), np.zeros(len(owner), value.dtype)
    owner[slot], place[slot], raw[slot] = who, at, value
    real = owner >= 0
    values, codes = np.unique(raw[real], return_inverse=True)
    symbols = np.zeros(len(raw), np.uint16 if len(values) < 65_000 else np.int64)
    symbols[real] = codes + 1
    ends = np.flatnonzero(~real)
    cuts = [0]
    while cuts[-1] < len(symbols):  # shards of whole strings
        cuts.append(int(ends[min(len(ends) - 1, np.searchsorted(ends, cuts[-1] + SHARD))]) + 1)
    shards = [Shard(symbols[x:y], depth) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    side, common = merge([x.transform for x in shards], depth)
    where = np.empty(len(side), np.int64)
    for i, (x, at) in enumerate(zip(shards, cuts, strict=False)):
        where[side == i] = x.order + at
    interval = intervals(common, depth)
    hit = where[np.bincount(interval)[interval] > 1]
    hit = hit[owner[hit] >= 0]
    order = np.lexsort((place[hit], owner[hit]))
    hit = hit[order]
    cuts = np.searchsorted(owner[hit], np.arange(len(snippets) + 1))
    lengths = [len(s) for s in snippets]
    return [place[hit[a:b]][place[hit[a:b]] + length <= n] for a, b, n in zip(cuts[:-1], cuts[1:], lengths, strict=True)]


def _union(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint, non-touching spans with the same bytes; ends are exclusive."""
    if not len(low):
        return low, high
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.concatenate([[True], low[1:] > high[:-1]])
    start = np.flatnonzero(new)
    return low[start], high[np.concatenate([start[1:], [len(low)]]) - 1]


def _result(text: bytes, low: np.ndarray, high: np.ndarray) -> tuple[int, int, int, str]:
    sha, at = hashlib.sha256(), 0
    for a, b in zip(low.tolist(), high.tolist(), strict=True):
        sha.update(text[at:a])
        at = b
    sha.update(text[at:])
    return len(text), int((high - low).sum()), len(low), sha.hexdigest()


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
SEGMENTS = "key long, rid long, whole long, place long"  # place: low << 11 | kind << 9 | high - low


def hot_names(texts: DataFrame, least: int = HOT, sample: int = SAMPLE) -> np.ndarray:
    """Names that are likely to have `least` different runs or more, sorted; the driver gets at most (all runs / least)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                found = [segments(t) for t in b.column(0).slice(i, 256).to_pylist()]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in found])) for k in (0, 3)], ["name", "whole"])

    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(sample)) == 0).select("text").mapInArrow(count, "name long, whole long")
    many = some.distinct().groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") * sample >= least)
    return np.array(sorted(r["name"] for r in many.collect()), np.int64)


def remove_repeats(df: DataFrame, hot: int = HOT) -> DataFrame:
    """Remove every byte covered by a string of LENGTH bytes that also starts anywhere else.

    df: doc_id and text; returns doc_id, n_bytes, n_removed, n_spans and kept_sha256 per row. Texts are UTF-8 bytes, null is empty, matches
    do not cross rows, overlaps count, and all is judged on the input. Rows that are equal are two places, so each covers the
    other. doc_id may be null or repeated; extra columns, whatever their names, are ignored; an empty table gives an empty result.

    1. Every window of LENGTH bytes gets a name, a hash of some 150 bytes around its least gram: equal windows have equal names,
       and runs of some thirty windows share one. One row per run is shuffled by name, after each task has collapsed its own equal runs, so a
       passage in a third of all rows costs a row per task. Runs whose name is alone are done. Runs that are equal as a whole, by 128 bits
       of hashes, are covered whole.
    2. What differs under one name is at the edges of repeats, and only its windows' bytes can say what recurs: one run of each kind
       travels to the others of its name. Groups of snippets are cut into shards, each with its Burrows-Wheeler transform; these are merged by
       interleave refinement, which gives the longest common prefixes, and intervals of LENGTH common bytes are the repeats.
    3. A name of very many different runs (texts with one head and different tails, say) is found beforehand from a sample, by texts'
       hash, and its windows are named one by one by all their bytes, so that they are spread over all tasks. Only the layout depends on it.
    """
    prepare(df.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    base = df.select("doc_id", text.alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))
    kind = df.schema["doc_id"].dataType.simpleString()

    loud = hot_names(base, hot)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for b in batches:
            for rid, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                name, low, high, whole = segments(t)
                if len(loud) and len(name):
                    on = loud[np.minimum(np.searchsorted(loud, name), len(loud) - 1)] == name
                    if on.any():
                        more = single_windows(t, low[on], high[on])
                        name, low, high, whole = (np.concatenate([x[~on], y]) for x, y in zip((name, low, high, whole), (more[0], more[1], more[1], more[2]), strict=True))
                for p, x in zip(parts, (name, np.full(len(name), rid, np.int64), whole, low << 9 | (high - low)), strict=True):
                    p.append(x)
        if not parts[0]:
            return
        key, rid, whole, place = map(np.concatenate, parts)
        order = np.lexsort((whole, key))
        key, rid, whole, place = key[order], rid[order], whole[order], place[order]
        same = (key[1:] == key[:-1]) & (whole[1:] == whole[:-1])
        again = np.concatenate([[False], same])
        lead = ~again & np.concatenate([same, [False]])
        # 0: alone here; 1: here for its equals too; 2: one of those, decided
        state = np.where(again, 2, np.where(lead, 1, 0)).astype(np.int32)
        route = np.where(again, rid * np.int64(0x2545F4914F6CDD1D) ^ place, key)
        for i in range(0, len(key), 200_000):
            s = slice(i, i + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[s]) for x in (route, rid, whole, place >> 9 << 11 | state.astype(np.int64) << 9 | place & 511)], ["key", "rid", "whole", "place"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rid, whole, place in _runs(batches, 0):
            state, place = place >> 9 & 3, place >> 11 << 9 | place & 511
            done, at = np.flatnonzero(state == 2), np.flatnonzero(state < 2)
            at = at[np.lexsort((whole[at], key[at]))]
            k, w = key[at], whole[at]
            # each compared with the one before, and the one after
            same_key = np.concatenate([[False], k[1:] == k[:-1], [False]])
            same = same_key & np.concatenate([[False], w[1:] == w[:-1], [False]])
            same_key, next_key, same, next_same = same_key[: len(k)], same_key[1:][: len(k)], same[: len(k)], same[1:][: len(k)]
            first = ~same  # one run of each kind
            sure = same | next_same | (state[at] == 1)
            shared = same_key | next_key | (state[at] == 1)
            # names with an undecided run that has others: one run of each kind of bytes must travel, to be found
            group = np.cumsum(~same_key) - 1
            kinds = np.bincount(group[first], minlength=1)
            asked = np.zeros(len(kinds), bool)
            asked[group[~sure & shared]] = True
            send = shared & first & asked[group] & (kinds[group] > 1)
            keep = shared & (sure | send)
            i = np.concatenate([done, at[keep]])
            if len(i):
                yes, send = np.concatenate([np.ones(len(done), bool), sure[keep]]), np.concatenate([np.zeros(len(done), bool), send[keep]])
                where = place[i] >> 9 << 10 | yes.astype(np.int64) << 9 | send.astype(np.int64) << 8 | place[i] & 255
                yield pa.RecordBatch.from_arrays([pa.array(rid[i]), pa.array(where), pa.array(np.where(send, key[i], 0))], ["rid", "place", "key"])

    sent = base.select("rid", "text").mapInArrow(local, SEGMENTS).repartition("key").sortWithinPartitions("key")
    found = sent.mapInArrow(decide, "rid long, place long, key long")
    per = found.groupBy("rid").agg(F.collect_list(F.struct("place", "key")).alias("found"))
    joined = base.join(per, "rid", "left").select("doc_id", "rid", "text", F.col("found.place").alias("place"), F.col("found.key").alias("key"))
    state = f"doc_id {kind}, rid long, open boolean, {RESULT}, packed binary, low array<long>, high array<long>, snippets array<struct<key:long,start:long,bytes:binary>>"

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                b = batch.slice(i, 256)
                rows = []
                for text, place, key in zip(*(b.column(c).to_pylist() for c in range(2, 5)), strict=True):
                    place = np.array(place or [], np.int64)
                    sure, send = place & 512 > 0, place & 256 > 0
                    first, last = place >> 10, (place >> 10) + (place & 255)
                    low, high = _union(first[sure], last[sure] + LENGTH)
                    ask = np.flatnonzero(send)
                    cutouts = [{"key": int(key[a]), "start": int(first[a]), "bytes": text[first[a] : last[a] + LENGTH]} for a in ask]
                    if cutouts:
                        rows.append((True, len(text), None, None, None, press.compress(text), low, high, cutouts))
                    else:
                        rows.append((False, *_result(text, low, high), None, None, None, None))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.struct([("key", pa.int64()), ("start", pa.int64()), ("bytes", pa.binary())]))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "rid", "open", "n_bytes", "n_removed", "n_spans", "kept_sha256", "packed", "low", "high", "snippets"])

    covered = cut(joined.mapInArrow(cover, state))
    asked = covered.where("open").select("rid", F.explode("snippets").alias("s")).select(F.col("s.key").alias("key"), "rid", F.col("s.start").alias("start"), F.col("s.bytes").alias("bytes"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []

        def answer(rows):
            out = []
            for (_, rid, start, _), at in zip(rows, repeated_starts([r[3] for r in rows]), strict=True):
                low, high = _union(at + start, at + start + LENGTH)
                out += [(rid, int(a), int(b)) for a, b in zip(low, high, strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["rid", "low", "high"])

        size, group, members = 0, None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] != group:
                    held += members
                    size += sum(len(m[3]) for m in members)
                    members, group = [], row[0]
                    if size >= LOAD:
                        yield from answer(held)
                        held, size = [], 0
                members.append(row)
        held += members
        if held:
            yield from answer(held)

    more = asked.repartition("key").sortWithinPartitions("key").mapInArrow(settle, "rid long, low long, high long")
    more = more.groupBy("rid").agg(F.collect_list(F.struct("low", "high")).alias("more"))
    rest = covered.where("open").select("doc_id", "rid", "packed", "low", "high").join(more, "rid", "left").select("doc_id", "packed", "low", "high", F.col("more.low").alias("low2"), F.col("more.high").alias("high2"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for packed, low, high, low2, high2 in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                spans = _union(np.array(low + (low2 or []), np.int64), np.array(high + (high2 or []), np.int64))
                rows.append(_result(press.decompress(packed), *spans))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    closed = covered.where("not open").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return closed.unionByName(rest.mapInArrow(finish, f"doc_id {kind}, {RESULT}"))
