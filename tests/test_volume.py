"""Operators, pipeline, configuration, sources and queries of the volume engine."""

import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from volumetra import cli, config, kernels, queries, registry
from volumetra.draws import Draw, uniform, uniform_sql
from volumetra.plans.pipeline import SCHEMA, Pipeline
from volumetra.sources import nifti

DATA = "/root/testdata/sf0.001"
EXTRA = {
    "RandomDomainTransferGPU": {"bank": {"a__b": np.linspace(0, 1, 96).reshape(3, 32)}},
    "ArtifactTransform": dict.fromkeys(("motion", "ghosting", "spike", "bias_field", "blur", "noise", "swap"), True),
    "SpatialCustomTransform": dict.fromkeys(("flip", "affine", "elastic", "anisotropy"), True),
}


def volume(shape=(12, 10, 14)):
    img = np.random.default_rng(1234).random((1, *shape)).astype(np.float32)
    seg = np.zeros(shape, np.int32)
    seg[3:8, 2:6, 4:9], seg[8:11, 6:9, 9:13] = 1, 2
    return img, seg


def test_every_name_of_the_order_is_registered():
    names = [n for b in registry.BACKENDS for n in registry.PIPELINE_ORDER[b]]
    assert [e.name for e in registry.entries()] == names and len(names) == 52


@pytest.mark.parametrize("name", [e.name for e in registry.entries()])
def test_operator_is_finite_repeatable_and_keeps_labels(name):
    e, (img, seg) = registry.get(name), volume()
    for i, s in ((img, seg), (np.full_like(img, -2.709), seg * 0), (img, None)):
        kept = i.copy()
        a, t = e.apply(i, s, Draw(1, name, 7), **EXTRA.get(name, {}))
        b, _ = e.apply(i, s, Draw(1, name, 7), **EXTRA.get(name, {}))
        assert np.isfinite(a).all() and np.array_equal(a, b) and np.array_equal(i, kept)
        assert name == "ShapeTransform" or a.shape == i.shape
        assert t is None or set(np.unique(t)) <= {0, 1, 2}


def test_kernels():
    v = np.random.default_rng(0).random((5, 6, 7))
    dense = -np.ones((3, 3, 3))
    dense[1, 1, 1] = 26
    assert np.allclose(kernels.laplacian(v), kernels.correlate(v, dense))
    assert np.isclose(kernels.gaussian_taps(1.3).sum(), 1)
    assert np.allclose(kernels.kmeans(np.r_[np.full(50, 0.0), np.full(50, 1.0)], 2), [0, 1])
    assert np.allclose(kernels.resize(v, v.shape), v)
    spike = np.zeros((9, 9, 9), bool)
    spike[4, 4, 4] = True
    assert kernels.dilate(spike, 1).sum() == 27 and kernels.dilate(spike, 1, corners=False).sum() == 7
    assert kernels.quantile(np.arange(5.0), 0.3) == pytest.approx(np.quantile(np.arange(5.0), 0.3))


def test_draws_agree_in_spark_sql_and_python(spark):
    got = [r[0] for r in spark.range(5).select(uniform(3, "op", "slot", F.col("id"))).collect()]
    sql = [r[0] for r in duckdb.sql(f"SELECT {uniform_sql(3, 'op', 'slot', 'i')} FROM range(5) t(i)").fetchall()]
    assert got == sql == [Draw(3, "op", i).u("slot") for i in range(5)]


def test_config():
    good = {"GPU": {"_note": 1, "RandomGammaGPU": {"p": 0.5}, "RandomSqrtGPU": {"p": 0}}, "pipeline": {"mode": "sequential"}}
    c = config.Config(good)
    assert c.same_on_batch and c.hash() == config.config_hash(json.loads(json.dumps(good)))
    assert list(config.drop_zero_probability(good)["GPU"]) == ["_note", "RandomGammaGPU"]
    with pytest.raises(registry.InvalidConfig) as e:
        config.Config({"GPU": {"RandomGamaGPU": {}, "RandomSqrtGPU": {"x": 1}}, "other": {}, "pipeline": {"mode": "no"}})
    assert len(e.value.problems) == 4 and "RandomGammaGPU" in str(e.value)


def test_cli(tmp_path, capsys):
    assert cli.main(["list", "--backend", "CPU"]) == 0 and len(capsys.readouterr().out.splitlines()) == 22
    assert cli.main(["template", "GPU"]) == 0
    payload = json.loads(capsys.readouterr().out)
    (tmp_path / "c.json").write_text(json.dumps(payload))
    assert cli.main(["validate", str(tmp_path / "c.json")]) == 0
    assert cli.main(["show", "Nothing"]) == 1


def test_pipeline_does_not_depend_on_partitioning(spark):
    img, seg = (np.random.default_rng(1).random((1, 4, 4, 4)), np.zeros((4, 4, 4), int))
    rows = [(i, i // 3, (1, 4, 4, 4), [float(x) for x in (img * (i + 1)).ravel()], seg.ravel().tolist() if i % 2 else None) for i in range(12)] + [(12, 4, (1, 4, 4, 4), None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    pipe = Pipeline({"GPU": {"RandomGaussianNoiseGPU": {"p": 0.5}, "RandomFlipTransformGPU": {"p": 0.5}, "RandomGammaGPU": {}}, "pipeline": {"mode": "random_order", "same_on_batch": False}}, seed=4)
    key = lambda d: sorted((r.sample_id, r.img, r.seg, r.trace) for r in pipe.apply(d).collect())[:12]
    assert str(key(df.repartition(1))) == str(key(df.repartition(5)))
    shared = Pipeline({"GPU": {"RandomGammaGPU": {"p": 0.5}}}, seed=4).apply(df.where("img is not null")).collect()
    assert all(len({len(r.trace) for r in shared if r.batch_id == b}) == 1 for b in range(4))


def test_nifti(spark, tmp_path):
    v = np.arange(24, dtype=np.int16).reshape(2, 3, 4)
    m = np.diag([2.0, 1.5, 1.0, 1.0])
    (tmp_path / "a.nii.gz").write_bytes(nifti.encode(v, m, compress=True))
    r = nifti.read(spark, str(tmp_path)).first()
    assert r.shape == [2, 3, 4] and r.img == v.ravel().tolist() and r.spacing == [2.0, 1.5, 1.0] and np.allclose(r.affine, m.ravel())
    (tmp_path / "m.json").write_text(json.dumps({"TYPE": "LABEL", "DATASETS_PATH": str(tmp_path), "TRAINING": [{"IMAGE": "a.nii.gz", "LABEL": "a.nii.gz"}, {"IMAGE": "a.nii.gz", "LABEL": "gone.nii"}]}))
    found, missing = nifti.manifest(spark, str(tmp_path / "m.json"), "TRAINING")
    assert found.count() == 1 and missing.count() == 1


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "events", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want, got = con.sql(queries.ORACLES[name]).df(), queries.QUERIES[name](spark, DATA).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    order = [c for c in cols if want[c].dtype.kind != "f"] + [c for c in cols if want[c].dtype.kind == "f"]
    want, got = (x[order].sort_values(order).reset_index(drop=True) for x in (want, got))
    assert len(want) == len(got)
    for c in order:
        if want[c].dtype.kind in "iuf":
            assert np.allclose(want[c].astype(float), got[c].astype(float), atol=2e-5)
        else:
            assert (want[c] == got[c]).all()


def test_array_statistics_are_bound(spark):
    plan = queries.QUERIES["zscore_population"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_stream(spark, tmp_path):
    from volumetra.streaming import augment_stream

    queries.as_volumes(spark, DATA).limit(20).write.parquet(str(tmp_path / "in"))
    pipe = Pipeline({"GPU": {"ZscoreNormalizationGPU": {}}}, seed=1)
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    augment_stream(stream, pipe, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
