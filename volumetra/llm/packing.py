"""Tokenizing documents and packing them by best-fit decreasing."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, prepare, worker_cache

LENGTH = 4096
END = 1
CACHED = 300_000  # words in each of the two generations that a worker remembers
APART = json.dumps(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")[1:-1]  # the cut that keeps letters and marks in different pieces
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # of ASCII, without the apostrophe, which may take letters along


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _load(path: str):
    """The tokenizer and, if it lower-cases, cuts letters, digits and marks apart and ends each piece in a token of its own, which ids are such ends."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads only spin
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        text = f.read()
    tokenizer, said = Tokenizer.from_str(text), json.loads(text)
    suffix = said["model"].get("end_of_word_suffix")
    if not suffix or APART not in json.dumps(said.get("pre_tokenizer")):
        return tokenizer, None
    letters = [chr(i) for i in range(256) if chr(i).isalpha()]
    if _encode(tokenizer, letters) != _encode(tokenizer, [x.lower() for x in letters]):
        return tokenizer, None
    vocabulary = tokenizer.get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
    return tokenizer, ends


def _encode(tokenizer, texts: list[str]) -> list[bytes]:
    return [np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _encode_letters(tokenizer, ends: np.ndarray, words: list[str]) -> list[bytes]:
    """Ids of words of letters alone, each of them one piece: encoded as one text and cut behind the ends."""
    if not words:
        return []
    ids = np.array(tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
    b, cuts = ids.tobytes(), ((np.flatnonzero(ends[ids]) + 1) * 4).tolist()
    if len(cuts) != len(words):
        return _encode(tokenizer, words)
    return [b[x:y] for x, y in zip([0, *cuts[:-1]], cuts, strict=True)]


def _encode_words(tokenizer, ends: np.ndarray | None, words: list[str], found) -> Iterator[tuple[str, bytes]]:
    """Ids of each new word. Latin-1 letters, with or without marks behind them, take those of the lower-cased letters and of the marks."""
    if ends is None:
        yield from zip(words, _encode(tokenizer, words), strict=True)
        return
    plain, rest, parts = [], [], {}
    for w in words:
        core = w.rstrip(MARKS)
        if core.isalpha() and max(core) <= "\xff":
            plain.append((w, core.lower(), w[len(core) :]))
        else:
            rest.append(w)
    for part in {x for _, core, tail in plain for x in (core, tail)}:
        parts[part] = found(part) if part else b""
    new = [x for x, ids in parts.items() if ids is None]
    letters, marks = [x for x in new if x.isalpha()], [x for x in new if not x.isalpha()]
    parts.update(zip(letters, _encode_letters(tokenizer, ends, letters), strict=True))
    parts.update(zip(marks, _encode(tokenizer, marks), strict=True))
    for w, core, tail in plain:
        yield w, parts[core] + parts[tail]
    yield from zip(rest, _encode(tokenizer, rest), strict=True)


def _ids(texts: Sequence[str], path: str, by_word: bool) -> list[bytes]:
    """Little-endian ids of each text. With by_word each distinct word is encoded once."""
    held = worker_cache(f"ids of {path}", lambda: [_load(path), {}, {}])
    tokenizer, ends = held[0]
    if not by_word:
        return _encode(tokenizer, list(texts))
    if len(held[1]) > CACHED:  # the older generation goes; words still in use come back from it
        held[1:] = {}, held[1]
    known, older = held[1:]
    # str.split() and the tokenizer's \s differ in \x1c-\x1f; those texts go whole
    split = [None if any(c in t for c in "\x1c\x1d\x1e\x1f") else t.split() for t in texts]
    new = [w for w in set().union(*(ws for ws in split if ws)) if w not in known]
    known.update((w, older[w]) for w in new if w in older)
    new = [w for w in new if w not in older]
    found = lambda x: known.get(x) or older.get(x)
    for i in range(0, len(new), 20_000):
        known.update(_encode_words(tokenizer, ends, new[i : i + 20_000], found))
    get = known.__getitem__
    return [_encode(tokenizer, [t])[0] if ws is None else b"".join(map(get, ws)) for t, ws in zip(texts, split, strict=True)]


def pieces(df: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end: int = END, by_word: bool = True, with_ids: bool = True) -> DataFrame:
    """Ids of every whole text, then `end`, cut into pieces of `length`; the last may be shorter.

    df: doc_id, text. Returns doc_id, piece, start, length, ids_crc32 and with with_ids the ids
    (binary, little-endian unsigned 32-bit). Null text counts as empty: one piece with only `end`. A null doc_id is kept, other columns are
    dropped, an empty table gives an empty result. The
    tokenizer must treat words apart (by_word), as one does that drops white space and cuts there.
    """
    prepare(df.sparkSession)
    path = tokenizer or default_tokenizer()
    ending = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts = batch.column(0), [x or "" for x in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):  # some MB of text at a time
                upto, held = at, 0
                while upto < len(texts) and (upto == at or held < 4_000_000):
                    held += len(texts[upto])
                    upto += 1
                row, piece, start, size, crc, ids = [], [], [], [], [], []
                for i, b in enumerate(_ids(texts[at:upto], path, by_word), at):
                    b += ending
                    for p, s in enumerate(range(0, len(b), 4 * length)):
                        cutout = b[s : s + 4 * length]
                        row.append(i)
                        piece.append(p)
                        start.append(s // 4)
                        size.append(len(cutout) // 4)
                        crc.append(zlib.crc32(cutout))
                        if with_ids:
                            ids.append(cutout)
                columns = [docs.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.binary())] if with_ids else []), ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)
                at = upto

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


class Tree:
    """Segment tree over remaining capacities 0..top; a leaf says whether open bins have it."""

    def __init__(self, top: int):
        self.width = 1 << top.bit_length()
        self.any = [False] * (2 * self.width)

    def set(self, at: int, there: bool) -> None:
        at += self.width
        self.any[at] = there
        while at > 1:
            at >>= 1
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest capacity that is there and at least need."""
        at = need + self.width
        if self.any[at]:
            return need
        while at > 1:
            if not at & 1 and self.any[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.width
            at >>= 1
        return None


def best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing of counts[length] items of each length, in runs of equal bins.

    Each item goes to the open bin with the least room that holds it, else to a new one. Items of
    one length and bins of one remaining capacity are interchangeable, so whole runs move at
    once: a bin that is tightest stays so until the length no longer fits, hence takes room // length items.
    Returns runs (length, first rank, first bin, items per bin, offset), in order of rank for each length, and
    the number of bins. The work depends on the number of lengths, not of items.
    """
    tree, free, runs, bins = Tree(capacity), {}, [], 0  # free: capacity -> [(first bin, bins)]
    for size in sorted((s for s in counts if counts[s]), reverse=True):
        left, rank = counts[size], 0
        while left:
            room = tree.tightest(size)
            if room is None:
                room, each = capacity, capacity // size
                first, many = bins, max(1, left // each)
                bins += many
            else:
                each = room // size
                first, have = free[room].pop()
                many = min(have, max(1, left // each))
                if many < have:
                    free[room].append((first + many, have - many))
                if not free[room]:
                    tree.set(room, False)
            each = min(each, left)
            runs.append((size, rank, first, each, capacity - room))
            rank, left = rank + each * many, left - each * many
            rest = room - each * size
            if rest:
                if not free.get(rest):
                    free[rest] = []
                    tree.set(rest, True)
                free[rest].append((first, many))
    return runs, bins


def pack(cuts: DataFrame, capacity: int = LENGTH) -> DataFrame:
    """Best-fit decreasing over all pieces at once; adds sequence_id and offset.

    cuts: doc_id, piece, length (1 to capacity) and any other columns but those of the result and _b, _n, _before, _rank. Pieces get a rank among those
    of their length from counts per (length, hash bucket), with no task that sees all of
    a length. Best fit needs only how many pieces there are of each length, so the driver holds at most
    `capacity` counts, and the broadcast runs are bounded by the number of lengths, whatever the corpus. Equal rows
    are packed each for itself, and a null doc_id is a value like any other; an empty table packs into nothing. Of pieces of one length, those
    with the smaller hash, then doc_id and piece, go into earlier sequences; of bins of one remaining capacity the first is taken.
    """
    spark = cuts.sparkSession
    cuts = cut(cuts)
    buckets = max(1, cuts.count() // 20_000)
    spread = [c for c, t in cuts.dtypes if c in ("doc_id", "piece", "start") or c == "ids_crc32"]  # rows without a doc_id are spread too
    cuts = cuts.withColumn("_b", F.pmod(F.xxhash64(*spread), F.lit(buckets)))
    cells = cuts.groupBy("length", "_b").count()
    counts = {r[0]: r[1] for r in cells.groupBy("length").agg(F.sum("count")).collect()}
    runs, _ = best_fit(counts, capacity)
    before = cells.select("length", "_b", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = cuts.withColumn("_n", F.row_number().over(Window.partitionBy("_b", "length").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before, ["length", "_b"]).withColumn("_rank", (F.col("_n") + F.col("_before")).cast("long")).drop("_b", "_n", "_before")
    array = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
    held = spark.sparkContext.broadcast(array)
    names = [c for c in ranked.columns if c != "_rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rank, first, each, offset = held.value.T
        order = (size << 44) + rank
        for b in batches:
            n, r = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            i = np.searchsorted(order, (n << 44) + r, side="right") - 1
            k = r - rank[i]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(first[i] + k // each[i]), pa.array(offset[i] + k % each[i] * n)], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name in names)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, tokens (array of ids in order of offset).

    packed: the rows of pack(pieces(...)) with their ids. A sequence holds at most `capacity` tokens, so a
    group is bounded.
    """
    prepare(packed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = [np.frombuffer(b"".join(x["ids"] for x in row), dtype="<u4").astype(np.int64) for row in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tokens, pa.list_(pa.int64()))], ["sequence_id", "tokens"])

    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.mapInArrow(run, "sequence_id long, tokens array<long>")
