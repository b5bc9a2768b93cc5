"""The pipeline's near-duplicate stage: its SimHash links, its exact bounds, and what it writes."""

import random

import numpy as np

import corpus_pipeline
from volumetra.llm import nearcopies, simhash


def prose(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def test_stage_links_by_simhash(spark, monkeypatch):
    """The stage's links come from the SimHash operator; what it cannot see, 3 bits or more apart, is still joined."""
    rng, rows = random.Random(4), []
    for i in range(20):
        x = prose(rng, 400)
        rows.append((2 * i, " ".join(x)))
        for k in range(1 if i < 10 else 6):
            x[40 * k + 20] = "other"
        rows.append((2 * i + 1, " ".join(x)))
    sets = [nearcopies.shingles(t.encode()) for _, t in rows]
    apart = [(simhash.majority(sets[2 * i]) ^ simhash.majority(sets[2 * i + 1])).bit_count() for i in range(20)]
    assert min(apart) <= 2 < max(apart)
    asked, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda prints: asked.append({(r.a, r.b) for r in links(prints).collect()}) or links(prints))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, df, "").collect()) == list(range(0, 40, 2))
    assert len(asked) == 1
    assert {(min(x), max(x)) for x in asked[0]} >= {(2 * i, 2 * i + 1) for i in range(20) if 0 < apart[i] <= 2}


def test_parities_never_rule_out_a_link():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < rng.uniform(0.7, 1)], rng.integers(0, 1 << 63, int(rng.integers(0, n // 5 + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        bits = [np.frombuffer(nearcopies.parities(s), np.uint64) for s in (x, y)]
        assert nearcopies._possible(len(x), len(y), *bits, 0.8) or both < 0.8 * (len(x) + len(y) - both)
    for n in (300, 5000):
        far = [np.frombuffer(nearcopies.parities(rng.integers(0, 1 << 63, k).astype(np.uint64)), np.uint64) for k in (n, n * 5 // 6)]
        assert not nearcopies._possible(n, n * 5 // 6, *far, 0.8)


def test_stage_deals_out_less_than_the_text(spark, monkeypatch):
    """Texts without near copies: what is shuffled, but for the sample of a fixed size, stays below three quarters of their bytes."""
    monkeypatch.setattr(nearcopies, "SAMPLE", 50)
    rng = random.Random(8)
    rows = [(i, " ".join(prose(rng, 600))) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).localCheckpoint()
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written()
    assert corpus_pipeline.simhash_near_dedup(spark, df, "").count() == len(rows)
    spent, text = written() - before, sum(len(t) for _, t in rows)
    print(f"shuffled {spent / text:.2f} x text")
    assert spent < 0.75 * text


def test_workers_hold_few_rows_at_once():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + n))], ["x"]) for i, n in ((0, 1000), (1000, 0), (1000, 257))]
    got = list(nearcopies._slices(batches))
    assert max(b.num_rows for b in got) <= nearcopies.SLICE
    assert [x for b in got for x in b.column(0).to_pylist()] == list(range(1257))
