"""SimHash near-duplicates through deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, forest, hot_join, prepare, release

WORDS = 3
SEED = 42
BITS = 2  # links differ in at most so many bits
DENSE = 2048  # rows of one signature that are compared pair by pair; more are probed
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes | None, words: int = WORDS, seed: int = SEED) -> int:
    """64 majority bits over the XXH64 of all shingles, repeats included; no words: 0."""
    parts = (text or b"").translate(LOWER).split()  # splits at \x20 and \x09-\x0D
    if not parts:
        return 0
    if len(parts) < words:
        shingles, n = [b" ".join(parts)], 1
    else:
        shingles, n = map(b" ".join, zip(*(parts[k:] for k in range(words)), strict=False)), len(parts) - words + 1
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every whole text."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            values = np.array([fingerprint(t, words, seed) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values)], ["doc_id", "fp"])

    return df.select("doc_id", F.col("text").cast("string").cast("binary")).mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, fp long")


def _close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= BITS


def _masks() -> np.ndarray:
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    return np.concatenate([one, one[i] | one[j]])


def _links(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Label every row with the least row it is linked to; rows are sorted by key, whole keys only."""
    edges = np.flatnonzero(np.diff(key)) + 1
    start = np.concatenate([[0], edges])
    size = np.diff(np.concatenate([start, [len(key)]]))
    fp, n = fp.view(np.uint64), len(key)
    found_a, found_b = [], []
    room = np.repeat(start + size, size)  # end of each row's run
    thin = np.repeat(size <= DENSE, size)
    at = np.flatnonzero(thin & (room - np.arange(n) > 1))
    shift = 1
    while len(at):
        ok = _close(fp[at], fp[at + shift])
        found_a.append(at[ok])
        found_b.append(at[ok] + shift)
        shift += 1
        at = at[at + shift < room[at]]
    for s, m in zip(start[size > DENSE], size[size > DENSE], strict=True):  # exact, linear in m: look up all values within two bits
        order = np.argsort(fp[s : s + m])
        values = fp[s : s + m][order]
        for mask in _masks():
            goal = values ^ mask
            i = np.minimum(np.searchsorted(values, goal), m - 1)
            hit = np.flatnonzero(values[i] == goal)
            found_a.append(s + order[hit])
            found_b.append(s + order[i[hit]])
    cat = lambda xs: np.concatenate(xs) if xs else np.empty(0, np.int64)
    return forest(cat(found_a), cat(found_b), n)


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that join all prints within two bits; prints: fp (distinct), rep (long).

    The 64 bits are cut into two segments of 32. Two prints with at most two differing bits either
    agree in one segment, or differ in exactly one bit of each; then the first segments agree once that bit
    is deleted. So each print has 34 signatures: both whole segments, and the 32 variants of the first with one
    bit deleted. Rows meet by equality of a signature and every candidate is verified on all 64 bits. Per
    signature only a spanning forest is returned, so the output is linear however many prints share one; long runs
    are probed instead of compared pair by pair.
    """
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    variant = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: low.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), i))) + (i.cast("long") + 2) * F.lit(1 << 32))
    keyed = prints.select("fp", "rep", F.explode(F.concat(F.array(low, high + F.lit(1 << 32)), variant)).alias("key"))
    keyed = keyed.repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, np.int64)] * 3

        def emit(key, fp, rep):
            label = _links(key, fp)
            on = np.flatnonzero(label != np.arange(len(label)))
            if len(on):
                yield pa.RecordBatch.from_arrays([pa.array(rep[on]), pa.array(rep[label[on]])], ["a", "b"])

        for b in batches:
            new = [b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "rep")]
            all_ = [np.concatenate([x, y]) for x, y in zip(rest, new, strict=True)]
            last = int(np.searchsorted(all_[0], all_[0][-1])) if len(all_[0]) else 0
            if last:
                yield from emit(*(x[:last] for x in all_))
            rest = [x[last:] for x in all_]
        if len(rest[0]):
            yield from emit(*rest)

    return keyed.select("key", "fp", "rep").mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable over links).

    df: doc_id (integer), text; other columns are ignored. Null text has no words and fingerprint zero, linked like any other. Rows
    with one fingerprint are one class from the start, counted map-side, so a text that fills a third of the table is
    one print. Equal rows, and different texts under one doc_id, stay separate rows of their components. A null doc_id is linked like any
    other but is no component's smallest, unless all are null. An empty table gives an empty result.
    """
    prepare(df.sparkSession)
    each = cut(fingerprints(df))
    prints = cut(each.groupBy("fp").agg(F.min(F.col("doc_id").cast("long")).alias("least"), F.count("*").alias("n")))
    joined = components(links(prints.select("fp", F.col("fp").alias("rep"))))
    classes = prints.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("class"))
    lowest = classes.groupBy("class").agg(F.min("least").alias("component_id"), F.count("*").alias("prints"))
    table = hot_join(classes, lowest, "class", "prints").select("fp", "n", "component_id")
    return hot_join(each, table, "fp", "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
