"""Near-duplicates by exact Jaccard similarity of word shingles: SimHash links, checked, and a prefix-filter join for what they miss."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .chaining import _runs, pack, seeds, unpack, word_hashes
from .common import components, cut, hot_join, narrowed, prepare, release, tidy, trim
from .simhash import LOWER

WORDS = 5
SHARE = 0.8  # of the union of two sets of shingles that both hold
SMALL = 16  # groups of so many texts are paired at once, larger ones first linked sparsely
SAMPLE = 4000  # texts that say which shingles are common; they only decide the order
OFTEN = 4  # texts of the sample with a common shingle
MOST = 200_000
PARITY = 512  # bits of the parities of a set, at least
ROUNDS = 4  # of verification, with one candidate for each class, before all that are left are verified
BUCKET = 100_000  # entries of prefixes that are joined together, on average
FLUSH = 1 << 19  # entries that are packed together
SLICE = 256  # texts, or pairs of them, that a worker holds at once beside the batch they came in
EPS = 1e-9


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one shingle, no words none."""
    w = word_hashes((text or b"").translate(LOWER))
    if not len(w):
        return np.empty(0, np.uint64)
    return np.unique(seeds(w, None, min(words, len(w)), 1)[0])


def prefix(s: np.ndarray, common: np.ndarray, share: float = SHARE) -> np.ndarray:
    """The first len - ceil(share * len) + 1 shingles, common ones last and else by hash. Two sets
    with a Jaccard similarity of share or more have one of these in common, whatever the order."""
    if not len(s):
        return s
    if len(common):
        s = s[np.argsort(common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s, kind="stable")]
    return s[: len(s) - ceil(share * len(s) - EPS) + 1]


def parities(s: np.ndarray) -> bytes:
    """Per bit whether an odd number of shingles fall on it, in two bits or more a shingle. Shingles of both of two sets cancel out, so
    the sets differ in as many shingles as their parities in bits, at least."""
    size = max(PARITY, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def _possible(n: int, m: int, x: np.ndarray, y: np.ndarray, share: float) -> bool:
    """Whether sets of n and m shingles may reach the share, by their parities as longs. The longer ones are folded to the size of the others."""
    while len(x) != len(y):
        long_ = max(x, y, key=len)
        half = long_[: len(long_) // 2] ^ long_[len(long_) // 2 :]
        x, y = (half, y) if long_ is x else (x, half)
    return (n + m - int(np.bitwise_count(x ^ y).sum(dtype=np.int64))) / 2 >= share / (1 + share) * (n + m) - EPS


def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and their parities, folded to PARITY bits."""
    for b in batches:
        short = [np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, PARITY // 8), axis=0).tobytes() for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(short, pa.binary())], ["rep", "bits"])


def _pairs(rep: np.ndarray, n: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs i, j those that sizes and the places of the shared shingle leave possible."""
    least = share / (1 + share) * (n[i] + n[j]) - EPS
    ok = (np.minimum(n[i] - at[i], n[j] - at[j]) >= least) & (np.minimum(n[i], n[j]) >= share * np.maximum(n[i], n[j]) - EPS)
    a, b = rep[i[ok]], rep[j[ok]]
    return np.minimum(a, b), np.maximum(a, b)


def _slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows, some at a time; at the end of a task what it held goes back to the system, since workers stay."""
    for b in batches:
        for i in range(0, b.num_rows, size):
            yield b.slice(i, size)
    trim()


def _common(df: DataFrame, words: int) -> np.ndarray:
    """Shingles of OFTEN texts or more of a sample by hash, the most frequent first to stay."""
    rows = df.count()
    part = df.where(F.pmod(F.xxhash64("text"), F.lit(max(1, rows // SAMPLE))) == 0).select(F.col("text").cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sets = [shingles(t, words) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64))], ["s"])

    best = part.mapInArrow(run, "s long").groupBy("s").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "s").limit(MOST)
    return np.sort(best.select("s").toArrow()["s"].to_numpy().astype(np.int64).view(np.uint64))


def groups(df: DataFrame, words: int = WORDS, share: float = SHARE) -> DataFrame:
    """row and component: texts joined over links of a Jaccard similarity of share or more.

    df: row (long, distinct), text. component is the smallest row reachable. Rows with one set of shingles
    are one class from the start. SimHash fingerprints of the sets, the majority bits of their shingles, are linked by
    simhash.links(), and each link is verified on its whole sets. What differs in more bits is found exactly: classes meet by equality of a shingle of
    their prefixes; of those in different components so far each candidate that size, place and parities leave possible
    is verified, so no link is missed and none is added. In groups
    of more than SMALL classes each is first paired with those 1, 2, 4, ... places on by size and the first; what then is
    in one component needs no further pair, and all pairs across components follow.

    Entries of prefixes are sent in packed columns, one row per bucket of shingles, since a row each would outweigh the text.
    """
    tidy(df.sparkSession)
    spark = prepare(df.sparkSession).sparkContext
    common = spark.broadcast(_common(df, words))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            all_ = [shingles(t, words) for t in b.column(1).to_pylist()]
            names = [xxhash.xxh3_128_digest(s.tobytes()) for s in all_]
            prints = np.array([simhash.majority(s) for s in all_], np.uint64).view(np.int64)
            heads = [pack(prefix(s, common.value, share) >> np.uint64(16)) for s in all_]
            cols = [b.column(0), pa.array(names, pa.binary()), pa.array([len(s) for s in all_], pa.int64()), pa.array(prints), pa.array([parities(s) for s in all_], pa.binary()), pa.array(heads, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["row", "name", "n", "fp", "bits", "prefix"])

    each = cut(df.select("row", F.col("text").cast("string").cast("binary")).mapInArrow(sets, "row long, name binary, n long, fp long, bits binary, prefix binary"))
    reps = each.groupBy("name").agg(F.min("row").alias("rep"), F.count("*").alias("copies"))
    classes = cut(hot_join(each.select("row", "name"), reps, "name", "copies").select("row", "rep"))
    later = cut(classes.where("row <> rep").select("row"))
    heads = narrowed(each.drop("name"), later, "row", "left_anti")
    bits = max(0, int((heads.agg(F.sum("n")).first()[0] or 0) * (1 - share) // BUCKET).bit_length())
    texts = df.select("row", F.col("text").cast("string").cast("binary").alias("t"))

    def verified(pairs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = {}  # a text may be in many pairs
            for b in _slices(batches):
                keep = []
                if len(known) > 4 * SLICE:
                    known.clear()
                for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    for t in (x, y):
                        if t not in known:
                            known[t] = shingles(t, words)
                    x, y = known[x], known[y]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both >= share * (len(x) + len(y) - both) - EPS)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        # only texts of candidates are dealt out
        one = narrowed(texts.select(F.col("row").alias("a"), F.col("t").alias("x")), pairs.select("a").distinct(), "a")
        two = narrowed(texts.select(F.col("row").alias("b"), F.col("t").alias("y")), pairs.select("b").distinct(), "b")
        both = pairs.join(one, "a").join(two, "b")
        return cut(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))

    def possible(pairs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ok = [_possible(n, m, np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), share) for n, x, m, y in zip(*(b.column(c).to_pylist() for c in range(2, 6)), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

        side = lambda key, n, x: narrowed(heads.select(F.col("row").alias(key), F.col("n").alias(n), F.col("bits").alias(x)), pairs.select(key).distinct(), key)
        pairs = cut(pairs)
        both = pairs.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b")
        return both.select("a", "b", "n", "x", "m", "y").mapInArrow(run, "a long, b long")

    def apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
        one, two = (joined.select(F.col("node").alias(key), F.col("component").alias(c)) for key, c in (("a", "ca"), ("b", "cb")))
        return pairs.join(one, "a", "left").join(two, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    def linked(pairs: DataFrame, links: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Verified links, the given ones too, that join what the pairs join, and their components. In each round every class is verified against one
        of its candidates, since most candidates by then are links and leave the others within one component."""
        joined, k = (components(links) if links is not None else None), 0
        pairs = cut(possible(apart(pairs, joined) if joined is not None else pairs))
        while joined is None or not pairs.isEmpty():
            now = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b") if k < ROUNDS else pairs
            now = cut(now)
            new = verified(now)
            links = new if links is None else cut(links.unionByName(new))
            joined, k = components(links), k + 1
            tidy(df.sparkSession)
            pairs = cut(apart(pairs.join(now, ["a", "b"], "left_anti"), joined))
        return links, joined

    prints = cut(heads.groupBy("fp").agg(F.min("row").alias("rep"), F.count("*").alias("copies")))
    same = hot_join(heads.select("row", "fp"), prints.where("copies > 1"), "fp", "copies").where("row <> rep").select(F.col("row").alias("a"), F.col("rep").alias("b"))
    near = simhash.links(prints.select("fp", "rep")).unionByName(same)
    links, joined = linked(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), None)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held, many = [], 0

        def out():
            key = np.concatenate([x[2] for x in held])
            size = np.array([len(x[2]) for x in held])
            rep, n = (np.repeat(np.array([x[c] for x in held], np.int64), size) for c in (0, 1))
            at = np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size)
            where = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
            order = np.lexsort((key, where))
            key, rep, n, at, where = key[order], rep[order], n[order].astype(np.uint32), at[order].astype(np.uint32), where[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1, [len(where)]])
            rows = [(int(where[i]), pack(np.diff(key[i:j], prepend=np.uint64(0))), pack(rep[i:j]), pack(n[i:j]), pack(at[i:j])) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["bucket", "keys", "reps", "sizes", "places"])

        for b in _slices(batches):
            for row, n, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
                p = unpack(p, np.uint64)
                if len(p):
                    held.append((row, n, p))
                    many += len(p)
                if many >= FLUSH:
                    yield out()
                    held, many = [], 0
        if held:
            yield out()

    sent = heads.select("row", "n", "prefix").mapInArrow(send, "bucket long, keys binary, reps binary, sizes binary, places binary")
    sent = sent.repartition("bucket").sortWithinPartitions("bucket")

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, held = None, []
        for b in batches:
            for bucket, keys, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != now and held:
                    yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                    held = []
                now = bucket
                rep, n, at = (unpack(x, kind) for x, kind in zip(rest, (np.int64, np.uint32, np.uint32), strict=True))
                held.append((np.cumsum(unpack(keys, np.uint64)).view(np.int64), rep, n.astype(np.int64), at.astype(np.int64)))
        if held:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for key, rep, n, at in buckets(batches):
            order = np.lexsort((rep, n, key))
            key, rep, n, at = (x[order] for x in (key, rep, n, at))
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(start, len(key)))
            end, first = np.repeat(start + size, size), np.repeat(start, size)
            small, here, found = np.repeat(size <= SMALL, size), np.arange(len(key)), []
            for d in sorted({*range(1, SMALL), *(1 << x for x in range(int(size.max()).bit_length()))}):
                i = here[(small if d & (d - 1) else True) & (here + d < end)]
                found.append(_pairs(rep, n, at, i, i + d, share))
            i = here[~small & (here > first)]
            found.append(_pairs(rep, n, at, first[i], i, share))
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            i = here[~small]
            none = lambda m: np.zeros(m, np.int64)
            pair = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.empty((0, 2), np.int64)
            m = len(pair)
            cols = [np.concatenate([none(m), key[i]]), np.concatenate([pair[:, 0], rep[i]]), np.concatenate([pair[:, 1], none(len(i))]), np.concatenate([none(m), n[i]]), np.concatenate([none(m) - 1, at[i]])]
            yield from _slices([pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "a", "b", "n", "at"])], 1 << 15)

    met = cut(sent.mapInArrow(meet, "key long, a long, b long, n long, at long"))
    links, joined = linked(met.where("at < 0").select("a", "b").distinct(), links)
    large = met.where("at >= 0").select("key", F.col("a").alias("node"), "n", "at")
    if not large.isEmpty():
        mark = large.join(joined, "node", "left").select("key", F.col("node").alias("rep"), "n", "at", F.coalesce("component", "node").alias("c"))
        open_ = mark.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
        mark = mark.join(open_, "key", "left_semi")
        brief = heads.select(F.col("row").alias("rep"), "bits").mapInArrow(folded, "rep long, bits binary")
        mark = mark.join(brief, "rep").repartition("key").sortWithinPartitions("key")

        def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for key, rep, n, at, c, sums in _runs(batches, 0):
                order = np.lexsort((rep, n, key))
                key, rep, n, at, c, sums = (x[order] for x in (key, rep, n, at, c, sums))
                sums = np.frombuffer(b"".join(sums.tolist()), np.uint64).reshape(len(key), -1)
                start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                for s, e in zip(start, np.append(start[1:], len(key)), strict=True):
                    found = []
                    for i in range(s, e - 1):
                        j = np.arange(i + 1, s + np.searchsorted(n[s:e], n[i] / share + EPS, "right"))
                        j = j[c[j] != c[i]]
                        differ = np.bitwise_count(sums[i] ^ sums[j]).sum(1, dtype=np.int64)
                        j = j[(n[i] + n[j] - differ) / 2 >= share / (1 + share) * (n[i] + n[j]) - EPS]
                        if len(j):
                            found.append(_pairs(rep, n, at, np.full(len(j), i), j, share))
                    if found:
                        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        joined = linked(mark.select("key", "rep", "n", "at", "c", "bits").mapInArrow(cross, "a long, b long").distinct(), links)[1]
    return classes.join(joined, F.col("rep") == F.col("node"), "left").select("row", F.coalesce("component", "rep").alias("component"))
