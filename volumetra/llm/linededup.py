"""Repeated runs of lines, by a suffix array over line ids built with distributed prefix doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, hot_join, narrowed, prepare, release

MIN_LINES = 3  # a run of so many lines is a passage
MIN_WORDS = 50  # so is one of fewer lines with so many words
END = -1  # rank of what follows the last line: the smallest, and equal in all texts


LINES = "row long, line int, left int, a long, b long, words int, need int"


def lines(df: DataFrame, row: str, text: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """Line table. left counts lines to the end, this one too; a and b are 128 bits of a hash of the line; words counts runs of other
    characters than white space; need is how many lines from here on make a passage: those that reach min_words words, and min_lines at
    most (null if the text ends before). Null texts have no lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = [t.split(b"\n") for t in part.column(1).to_pylist()]
                sizes = np.array([len(t) for t in texts])
                flat = [x for t in texts for x in t]
                ids = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, flat)), np.int64).reshape(-1, 2)
                words = np.array([len(x.split()) for x in flat], np.int64)
                line = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                left = np.repeat(sizes, sizes) - line
                need, have = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
                for k in range(max(1, min_lines)):
                    have[: len(flat) - k] += np.where(left[: len(flat) - k] > k, words[k:], 0)
                    need[(need == 0) & (left > k) & ((have >= min_words) | (k + 1 >= min_lines))] = k + 1
                    if len(flat) <= k + 1:
                        break
                rows = np.repeat(part.column(0).to_numpy(), sizes)
                small = [pa.array(x.astype(np.int32)) for x in (line, left)]
                yield pa.RecordBatch.from_arrays([pa.array(rows), *small, pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(words.astype(np.int32)), pa.array(need.astype(np.int32), mask=need == 0)], [c.split()[0] for c in LINES.split(", ")])

    prepare(df.sparkSession)
    return df.where(F.col(text).isNotNull()).select(F.col(row).cast("long"), F.col(text).cast("string").cast("binary")).mapInArrow(run, LINES)


def _parts(table: DataFrame, rows: int | None) -> int:
    """Tasks for a table of so many rows, as far as known."""
    n = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return n if rows is None else max(1, min(n, rows // 20_000))


def _sorted(table: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """Dealt out by ranges of (keys, row, line), so that one key's rows may fill several tasks, and sorted in each."""
    n = _parts(table, rows)
    return cut(table.repartitionByRange(n, *keys, "row", "line").sortWithinPartitions(*keys, "row", "line"))


def _bounds(table: DataFrame, keys: list[str]) -> dict[int, tuple]:
    """Per partition of a sorted table: (rows before it, last keys before it, where each prefix of those began, first keys after it)."""
    many = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, last, since = 0, None, None, [0] * many
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
            first = first or [int(c[0]) for c in cols]
            new = np.zeros(b.num_rows, bool)
            for i, c in enumerate(cols):
                new[1:] |= c[1:] != c[:-1]
                new[0] |= last is None or last[i] != int(c[0])
                at = np.flatnonzero(new)
                since[i] = n + int(at[-1]) if len(at) else since[i]
            last, n = [int(c[-1]) for c in cols], n + b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (TaskContext.get().partitionId(), n, first, last, since)], ["part", "n", "first", "last", "since"])

    rows = sorted(table.mapInArrow(run, "part long, n long, first array<long>, last array<long>, since array<long>").collect(), key=lambda r: r["part"])
    out, offset, last, starts = {}, 0, None, None
    for r, following in zip(rows, [*rows[1:], None], strict=False):
        out[r["part"]] = (offset, last, starts, list(following["first"]) if following else None)
        now = [offset + x for x in r["since"]]
        for i in range(many):
            if last and r["since"][i] == 0 and last[: i + 1] == list(r["first"])[: i + 1]:
                now[i] = starts[i]
        last, starts, offset = list(r["last"]), now, offset + r["n"]
    return out


def _number(table: DataFrame, keys: list[str], h: int, rows: int | None = None) -> DataFrame:
    """Refine ranks to those by h lines. table: row, line, left, keys; returns row, line, left, rank, open.

    A rank is the number of suffixes that are smaller. With keys (rank, next), suffixes of one rank are told apart by next: the new rank
    adds how many of the same rank have a smaller one. Other keys are ranked from 0. open: another suffix agrees in all
    keys, and h lines are there.
    """
    table = _sorted(table, keys, rows)
    begin = _bounds(table, keys)
    refine = keys[0] == "rank"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offset, last, since, following = begin.get(TaskContext.get().partitionId(), (0, None, None, None))
        held = None

        def out(rest: list, joins: bool):
            row, line, left, rank, new = rest
            single = new & np.append(new[1:], not joins)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (row, line, left, rank, ~single & (left >= h))], ["row", "line", "left", "rank", "open"])

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
            new, starts = np.zeros(b.num_rows, bool), []
            for i, c in enumerate(cols):
                new = new.copy()
                new[1:] |= c[1:] != c[:-1]
                new[0] |= last is None or last[i] != int(c[0])
                at = np.where(new, offset + np.arange(len(new)), -1)
                if not new[0]:
                    at[0] = since[i]
                starts.append(np.maximum.accumulate(at))
            rank = cols[0] + starts[-1] - starts[0] if refine else starts[-1]
            if held:
                yield out(held, not new[0])
            held = [b.column(c).to_numpy() for c in ("row", "line", "left")] + [rank, new]
            offset, last, since = offset + b.num_rows, [int(c[-1]) for c in cols], [int(x[-1]) for x in starts]
        if held:
            yield out(held, following == last)

    return cut(table.mapInArrow(run, "row long, line int, left int, rank long, open boolean"))


def suffix_array(table: DataFrame) -> tuple[DataFrame, dict[int, DataFrame]]:
    """Ranks of all suffixes in texts that share a line, and the levels of shared prefixes, by prefix doubling.

    table: the result of lines(), with distinct (row, line). Returns (ranks, levels): ranks (row, line, rank) order the suffixes, equal ones
    share a rank; levels[h] has the suffixes that share their first h lines with another, with their rank by those h lines, h = 1, 2, 4, ...
    until none does. The rank by 2h lines comes from the pair (rank here, rank h lines on). A suffix that
    shares no more keeps its rank and is sorted no more, so the last levels are small.
    """
    ranks = _number(table.select("row", "line", "left", "a", "b"), ["a", "b"], 1)
    ranks = cut(ranks.join(ranks.where("open").select("row").distinct(), "row", "left_semi"))
    levels, h, names = {}, 1, ["row", "line", "left", "rank"]
    here, done = ranks.where("open").select(names), ranks.where("not open").select(names)
    many = here.count()
    while many:
        levels[h] = here
        ahead = here.unionByName(done).coalesce(_parts(table, None)).select("row", (F.col("line") - h).alias("line"), F.col("rank").alias("next"))
        pairs = here.join(ahead, ["row", "line"], "left").select(*names, F.coalesce("next", F.lit(END).cast("long")).alias("next"))
        ranks = _number(pairs, ["rank", "next"], 2 * h, many)
        here, done = ranks.where("open").select(names), done.unionByName(ranks.where("not open").select(names))
        many = here.count()
        h *= 2
    return done.coalesce(_parts(table, None)).select("row", "line", "rank"), levels


def neighbours(ranks: DataFrame, levels: dict[int, DataFrame]) -> DataFrame:
    """The suffix array with longest common prefixes: row, line, at (place in the array), lcp with the suffix before, in lines.

    ranks, levels: what suffix_array() gives. Only suffixes that share their first line are listed. Neighbours are compared by
    their ranks at falling powers of two: equal ranks by h lines, l lines on, make h more lines common.
    """
    spark = ranks.sparkSession
    if not levels:
        return spark.createDataFrame([], "row long, line int, at long, lcp int")
    depth = None
    for h in sorted(levels):  # the last level of each suffix
        part = levels[h].select("row", "line", F.lit(h).alias("depth"))
        depth = part if depth is None else depth.unionByName(part)
    depth = depth.groupBy("row", "line").agg(F.max("depth").alias("depth"))
    table = _sorted(ranks.join(depth, ["row", "line"]).select("row", "line", "rank", "depth"), ["rank"])
    ends = {r["part"]: r for r in table.mapInArrow(_last, "part long, n long, row long, line int, depth int").collect()}
    begin, before, offset = {}, (-1, -1, 0), 0
    for part in sorted(ends):
        begin[part] = (offset, before)
        offset, before = offset + ends[part]["n"], (ends[part]["row"], ends[part]["line"], ends[part]["depth"])

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = begin.get(TaskContext.get().partitionId(), (0, (-1, -1, 0)))
        for b in batches:
            if not b.num_rows:
                continue
            row, line, depth = (b.column(c).to_numpy() for c in ("row", "line", "depth"))
            prev = [np.concatenate([[x], c[:-1]]).astype(c.dtype) for x, c in zip(last, (row, line, depth), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (row, line, at + np.arange(len(row)), prev[0], prev[1], np.minimum(depth, prev[2]))], ["row", "line", "at", "prow", "pline", "depth"])
            at, last = at + len(row), (int(row[-1]), int(line[-1]), int(depth[-1]))

    out = table.mapInArrow(beside, "row long, line int, at long, prow long, pline int, depth int").withColumn("lcp", F.lit(0))
    for k, h in enumerate(sorted(levels, reverse=True)):
        level = levels[h]
        here = level.select(F.col("row"), (F.col("line") + 0).alias("l1"), F.col("rank").alias("r1"))
        there = level.select(F.col("row").alias("prow"), (F.col("line") + 0).alias("l2"), F.col("rank").alias("r2"))
        asks = F.col("depth") >= h  # a shorter shared prefix cannot hold so many lines
        out = out.withColumns({"l1": F.when(asks, F.col("line") + F.col("lcp")), "l2": F.when(asks, F.col("pline") + F.col("lcp"))})
        out = out.join(here, ["row", "l1"], "left").join(there, ["prow", "l2"], "left")
        out = out.select("row", "line", "at", "prow", "pline", "depth", (F.col("lcp") + F.when(F.col("r1") == F.col("r2"), h).otherwise(0)).alias("lcp"))
        if k % 3 == 2:
            out = cut(out)
    return out.select("row", "line", "at", "lcp")


def _last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, last = 0, None
    for b in batches:
        if b.num_rows:
            n, last = n + b.num_rows, [b.column(c)[-1].as_py() for c in ("row", "line", "depth")]
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([n]), pa.array([last[0]]), pa.array([last[1]], pa.int32()), pa.array([last[2]], pa.int32())], ["part", "n", "row", "line", "depth"])


def intervals(table: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """Occurrences of repeated passages: row, line, size (in lines), interval (its number among those of that size).

    table: the result of lines() for that min_lines, with at most one row per (row, line). An unbroken stretch of the suffix array in which
    neighbours have `size` lines in common is the interval of all occurrences of those lines. Whether they have says the rank by
    the greatest power of two that is no more than `size`, here and at the end of the run: two blocks that cover it. Longer runs are
    unions of such passages, so sizes up to min_lines are listed.
    """
    ranks, levels = suffix_array(table)
    spark = table.sparkSession
    if not levels:
        return spark.createDataFrame([], "row long, line int, size int, interval long")
    sizes = [k for k in range(1, max(1, min_lines) + 1) if 1 << (k.bit_length() - 1) in levels]
    array = levels[1].select("row", "line", F.col("rank").alias("h1_0")).join(ranks, ["row", "line"])
    blocks = {}
    for k in sizes:
        h = 1 << (k.bit_length() - 1)
        blocks[k] = (f"h{h}_0", f"h{h}_{k - h}")
        for ahead in (0, k - h):
            name = f"h{h}_{ahead}"
            if name not in array.columns:
                array = array.join(levels[h].select("row", (F.col("line") - ahead).alias("line"), F.col("rank").alias(name)), ["row", "line"], "left")
    names = sorted({c for pair in blocks.values() for c in pair})
    array = array.join(table.select("row", "line", "left", "need"), ["row", "line"])
    array = _sorted(array.select("row", "line", "rank", "left", "need", *[F.coalesce(c, F.lit(-1).cast("long")).alias(c) for c in names]), ["rank"], levels[1].count())

    def common(b: pa.RecordBatch, before: list | None) -> tuple[np.ndarray, list]:
        """Per row and size whether it opens an interval, and the last row's ranks."""
        cols = {c: b.column(c).to_numpy() for c in names}
        opens = []
        for k in sizes:
            new = np.zeros(b.num_rows, bool)
            for c in blocks[k]:
                x = cols[c]
                new |= np.concatenate([[before is None or before[names.index(c)] != x[0]], x[1:] != x[:-1]]) | (x < 0)
            opens.append(new)
        return np.array(opens).T, [int(cols[c][-1]) for c in names]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many rows open an interval of each size, per partition, but for its first row, whose ranks are given."""
        total, first, last = np.zeros(len(sizes), np.int64), None, None
        for b in batches:
            if b.num_rows:
                first = first or [b.column(c)[0].as_py() for c in names]
                opens, last = common(b, last or first)
                total += opens.sum(0)
        if first:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tolist()]), pa.array([first]), pa.array([last])], ["part", "n", "first", "last"])

    begin, total, last = {}, np.zeros(len(sizes), np.int64), None
    for r in sorted(array.mapInArrow(count, "part long, n array<long>, first array<long>, last array<long>").collect(), key=lambda r: r["part"]):
        begin[r["part"]] = (total, last)
        # the first row counts as opened by the one before, unless a missing rank has opened it already
        at = dict(zip(names, r["first"], strict=True))
        was = dict(zip(names, last, strict=True)) if last else None
        extra = [int(was is None or any(was[c] != at[c] for c in blocks[k])) if all(at[c] >= 0 for c in blocks[k]) else 0 for k in sizes]
        total, last = total + np.array(r["n"]) + np.array(extra), list(r["last"])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, last = begin.get(TaskContext.get().partitionId(), (np.zeros(len(sizes), np.int64), None))
        for b in batches:
            if not b.num_rows:
                continue
            opens, last = common(b, last)
            number = have + np.cumsum(opens, axis=0)
            have = number[-1]
            need, left = b.column("need").fill_null(1 << 30).to_numpy(), b.column("left").to_numpy()
            at, k = np.nonzero((need[:, None] <= sizes) & (left[:, None] >= sizes))
            pick = [pa.array(b.column(c).to_numpy()[at]) for c in ("row", "line")]
            yield pa.RecordBatch.from_arrays([*pick, pa.array(np.array(sizes, np.int32)[k]), pa.array(number[at, k])], ["row", "line", "size", "interval"])

    return array.mapInArrow(name, "row long, line int, size int, interval long")


def repeats(table: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """Lines to delete: row, line. In each interval the first occurrence by (row, line) stays; the others are covered.

    The passages that start in a repeated run cover it, however long it is, so what goes is whole maximal repeated runs.
    """
    found = cut(intervals(table, min_lines).select("row", "line", "size", F.struct("size", "interval").alias("of")))
    groups = found.groupBy("of").agg(F.count("*").alias("n"), F.min(F.struct("row", "line")).alias("first")).where("n > 1")
    later = hot_join(found, groups, "of", "n").where(F.struct("row", "line") > F.col("first"))
    return later.select("row", F.explode(F.sequence("line", F.col("line") + F.col("size") - 1)).alias("line")).distinct()


def dedup(df: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """Delete later copies of repeated runs of lines; adds kept_text, n_lines, n_removed and n_runs.

    df: any columns, among them doc_id and text; columns with the names of the added ones are replaced, other names may be
    any. A run is min_lines consecutive lines or more, or fewer lines with min_words words or more together,
    that also occurs earlier in the order of (doc_id, line), in the same
    document or another. Lines end at \\n and are compared whole; words are runs of other characters than white space. Null text stays null,
    with no lines; the empty text is one empty line. Rows with the same doc_id and text count as
    one document (they are kept or cut alike); rows with one doc_id and different texts are ordered by
    the text's hash. A null doc_id comes first. n_runs counts the maximal deleted runs. An empty table gives an empty result.

    Equal texts enter the suffix array once, by their first row: the later ones are repeated runs as a whole.
    """
    prepare(df.sparkSession)
    hash_, row, gone_, name = (fresh(df, x) for x in ("hash", "row", "gone", "key"))
    tag = df.withColumn(hash_, F.md5("text"))
    rows = cut(tag.where("text is not null").groupBy(F.col("doc_id").alias("id"), F.col(hash_).alias("h")).agg(F.count("*").alias("times")))
    total, ids, again = rows.agg(F.count("*"), F.countDistinct("id"), F.max("times")).first()
    plain = total == ids and again == 1 and isinstance(df.schema["doc_id"].dataType, T.IntegralType)
    key = F.struct("id", "h")
    if plain:  # doc_id itself numbers the rows
        key = F.col("id").cast("long")
    heads = cut(rows.withColumn("k", key).groupBy("h").agg(F.min("k").alias("head"), F.count("*").alias("copies")))
    later = cut(hot_join(rows.select("h", key.alias("k")), heads.where("copies > 1"), "h", "copies").where(F.col("k") != F.col("head")).select("k", "head"))
    if plain:
        texts = narrowed(df.where("text is not null").select(F.col("doc_id").cast("long").alias(row), "text"), later.select(F.col("k").alias(row)), row, "left_anti")
        named = None
    else:  # first rows in order, by number
        named = cut(heads.select("head").orderBy("head").select("head", F.monotonically_increasing_id().alias(row)))
        texts = tag.select(F.struct(F.col("doc_id").alias("id"), F.col(hash_).alias("h")).alias("head"), "text").join(named, "head").select(row, "text")
        if (again or 0) > 1:  # of rows with the same doc_id and text, one
            texts = texts.dropDuplicates([row])
    table = cut(lines(texts, row, "text", min_lines, min_words))
    gone = repeats(table, min_lines).groupBy("row").agg(F.sort_array(F.collect_list("line")).alias("gone"))
    # later copies of a text are one run from end to end, if that makes a passage
    back = (lambda t: t.withColumnRenamed("row", "k")) if plain else (lambda t: t.join(named.withColumnRenamed(row, "row"), "row").drop("row").withColumnRenamed("head", "k"))
    copied = later.groupBy("head").agg(F.count("*").alias("copies"))
    size = back(table.groupBy("row").agg(F.max("left").alias("n"), F.sum("words").alias("w"))).withColumnRenamed("k", "head").where((F.col("n") >= min_lines) | (F.col("w") >= min_words))
    whole = hot_join(later, copied.join(size, "head").select("head", "n", "copies"), "head", "copies").select("k", F.sequence(F.lit(0), F.col("n") - 1).alias("gone"))
    per = cut(back(gone).select("k", "gone").unionByName(whole))
    none = F.array().cast("array<int>")
    if plain:
        per = per.select(F.col("k").alias(row), F.col("gone").alias(gone_))
        wide = df.withColumn(row, F.when(F.col("text").isNotNull(), F.col("doc_id").cast("long")))
        hit = narrowed(wide, per.select(row), row).join(per, row)
        miss = narrowed(wide, per.select(row), row, "left_anti").withColumn(gone_, F.lit(None).cast("array<int>"))
        out = hit.select(*[F.col(f"`{c}`") for c in df.columns], gone_).unionByName(miss.select(*[F.col(f"`{c}`") for c in df.columns], gone_))
    else:
        per = per.select(F.col("k.id").alias(name), F.col("k.h").alias(row), F.col("gone").alias(gone_))
        out = tag.join(per, F.col("doc_id").eqNullSafe(F.col(name)) & (F.col(hash_) == F.col(row)), "left").drop(hash_, row, name)
    parts = F.split(F.col("text"), "\n", -1)
    # lines are split once and bound by a lambda: an expression inside one is run for each element
    left = F.element_at(F.transform(F.array(parts), lambda p: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col(gone_)), lambda i: F.element_at(p, i + 1)), "\n")), 1)
    kept = F.when(F.col(gone_).isNull(), F.col("text")).otherwise(left)
    state = F.aggregate(F.coalesce(F.col(gone_), none), F.struct(F.lit(-2).alias("at"), F.lit(0).alias("n")), lambda s, x: F.struct(x.alias("at"), (s["n"] + F.when(x == s["at"] + 1, 0).otherwise(1)).alias("n")))
    count = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1)
    added = {"kept_text": kept, "n_lines": count.cast("long"), "n_removed": F.size(F.coalesce(F.col(gone_), none)).cast("long"), "n_runs": state["n"].cast("long")}
    return out.withColumns(added).drop(gone_)
