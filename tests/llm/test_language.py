"""Language ID: long chains are exact, and accuracy on rows that were not learned from."""

import numpy as np

from volumetra.llm import langid


def test_units_change_nothing():
    rng = np.random.default_rng(3)
    counts = np.array([0, 1, 2, 3, 7, 100, 6, 5])
    emit, move, begin = rng.random((counts.sum(), 3)) + 0.01, rng.random((3, 3)) + 0.01, rng.random(3) + 0.1
    whole = langid.posteriors(emit, counts, move, begin, 1000)
    for unit in (1, 2, 3, 50):
        assert np.allclose(langid.posteriors(emit, counts, move, begin, unit), whole)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(langid.sample(docs, langid.held_out()))
    rows = langid.identify(docs.where(langid.held_out()).where("lang is not null"), model).collect()
    right = sum(r.lang_pred == r.lang for r in rows)
    print(f"held-out accuracy {right / len(rows):.3f} of {len(rows)}")
    assert right >= 0.9 * len(rows)


def test_every_label_is_learned(spark):
    rows = [(4 * i + k, f"{chr(97 + i // 10)}{chr(97 + i % 10)}x " * 20, f"l{i}") for i in range(80) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(langid.sample(docs, langid.held_out()))
    assert len(model.labels) == 80
