"""What the corpus operators share."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from volumetra.llm import common


def test_words_are_counted_as_they_are_split(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é \t\n\x0b\x0c\r\u00a0 ") for _ in range(rng.randint(0, 12))) for _ in range(2000)] + ["", " ", "one", "a b", "a\nb c"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    got = [r[0] for r in df.select(common.word_count(F.col("text"))).collect()]
    assert got == [len(t.encode().split()) for t in texts] + [0]


def test_joins_of_hot_keys(spark, monkeypatch):
    rows = spark.createDataFrame([(i, 0 if i % 3 else i % 7) for i in range(40_000)], "id long, key long")
    table = rows.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    got = common.hot_join(rows, table, "key", "n")
    assert got.columns == ["key", "id", "least"] and got.count() == 40_000
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(table.drop("n"), "key").collect()))
    assert common.hot_join(rows.limit(0), table.limit(0), "key", "n").count() == 0


@pytest.mark.parametrize("small", [0, 100])
def test_narrowed(spark, monkeypatch, small):
    monkeypatch.setattr(common, "SMALL", small)
    rows = spark.createDataFrame([(i if i else None, "x") for i in range(50)], "id long, text string")
    keys = spark.createDataFrame([(i,) for i in range(0, 50, 5)], "id long")
    assert common.narrowed(rows, keys, "id").count() == 9 and common.narrowed(rows, keys, "id", "left_anti").count() == 41


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    class Empty:
        def isEmpty(self):
            return True

    class Context:
        master = "spark://somewhere:7077"
        environment = {}

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": lambda self: Empty()})()

    session = type("Session", (), {"sparkContext": Context(), "conf": type("C", (), {"get": lambda self, k, d=None: d})()})()
    with pytest.raises(RuntimeError, match="checkpoint"):
        common.prepare(session)


def test_released_caches_leave_the_worker():
    import psutil

    common._cache.clear()
    me = psutil.Process()
    common.worker_cache("some words", lambda: {f"word {i}" * 3: str(i) * 40 for i in range(400_000)})
    full = me.memory_info().rss
    common.release()
    assert not common._cache and me.memory_info().rss < full - 50_000_000


def test_lines_release_what_other_operators_remember(spark, monkeypatch):
    """A worker that goes on from language to lines does not keep the words of the first."""
    from volumetra.llm import linededup

    df = spark.createDataFrame([(1, "a b\nc")], "row long, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: run)
    run = linededup.lines(df, "row")
    common.worker_cache("some words", dict)["a"] = 1
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([b"a b\nc"])], ["row", "text"])
    assert sum(b.num_rows for b in run(iter([batch]))) == 2 and not common._cache


def test_components_in_few_jobs(spark):
    """The driver holds every job's plan: a long chain takes as few jobs as a short one. Rounds over all tasks give the same."""
    ids = list(range(300))
    random.Random(2).shuffle(ids)
    links = spark.createDataFrame([(ids[i], ids[i + 1]) for i in range(299)] + [(500, 400), (400, 450), (7, 7)], "a long, b long")
    want = {**dict.fromkeys(range(300), 0), **dict.fromkeys((400, 450, 500), 400)}
    sc = spark.sparkContext
    sc.setJobGroup("components", "few jobs")
    assert {r.node: r.component for r in common.components(links).collect()} == want
    jobs = len(sc.statusTracker().getJobIdsForGroup("components"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    print(f"{jobs} jobs")
    assert jobs <= 10
    for alone in (0, 100):
        assert {r.node: r.component for r in common.components(links, alone).collect()} == want
    assert common.components(links.limit(0)).count() == 0
