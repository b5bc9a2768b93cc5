"""Exact top-k search against brute force."""

import math

import numpy as np
import pytest

from volumetra.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("how", [{}, {"size": 60, "chunk": 8}])
def test_top_k(spark, how):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(300)]
    rows += [(i + 300, rows[i][1]) for i in range(40)] + [(i, rows[i + 1][1]) for i in (20, 21, 40)] + [(400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, []), (405, [0.5] * 3), (None, [1.0] * 8)]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, SCHEMA), 20, 5, **how).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    v = [(i, np.pad([math.floor(64 * float(np.float32(x))) for x in e], (0, 8 - len(e)))) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    want = {}
    for a, (i, x) in enumerate(v):
        if i % 20 == 0:  # a repeated vec_id is two queries
            best = sorted((-int(x @ y), j) for b, (j, y) in enumerate(v) if a != b)[:5]
            want.setdefault(i, []).extend((n + 1, j, -s) for n, (s, j) in enumerate(best))
    assert {k: sorted(x) for k, x in got.items()} == {k: sorted(x) for k, x in want.items()}
    assert len(got[20]) == 10


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([(i, [float(i)], 1, 2, 3) for i in range(41)], SCHEMA + ", s int, row int, q int")
    assert topk.top_k(df.where("false")).count() == 0
    assert [r.vec_id for r in topk.top_k(df, 20, 3).where("query_id = 20").orderBy("rank").collect()] == [40, 39, 38]


def test_blocks_are_pruned():
    rng = np.random.default_rng(2)
    centre = rng.integers(-40, 40, (16, 12))
    m = np.repeat(centre, 64, 0) + rng.integers(-2, 3, (1024, 12))
    ids = np.arange(1024)
    scores, found, _, visited = topk.search(m[::50], ids[::50], np.full(21, topk.NONE), m, ids, ids, 10, stride=2)
    for row, i in enumerate(ids[::50]):
        best = sorted((-int(m[i] @ m[j]), j) for j in ids if j != i)[:10]
        assert [(-s, j) for s, j in zip(scores[row], found[row], strict=True)] == best
    assert visited < 21 * 16 / 2


def test_ranges_are_pruned_before_the_shuffle(spark):
    """Queries of one direction are not sent to ranges of others."""
    rows = [(i, [100.0 + i % 7 if d == i // 250 else 0.0 for d in range(8)]) for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = topk.top_k(df, 20, 5, size=250, chunk=10).collect()
    assert len(got) == 500 and all(r.vec_id // 250 == r.query_id // 250 for r in got)


def test_large_components_are_exact():
    big = 1 << 40
    m = np.array([[big, -big], [big, big], [-big, 3]], np.int64)
    scores, found, _, _ = topk.search(m, np.arange(3), np.full(3, topk.NONE), m, np.arange(3), np.arange(3), 2)
    assert scores[0].tolist() == [0, topk.NONE + 1] and found[0].tolist() == [1, 2]
