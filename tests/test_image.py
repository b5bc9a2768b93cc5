"""Orientation, resampling, voxel types, files, registry entries, pipeline order and generators."""

import numpy as np
import pytest

from volumetra import config, kernels, registry
from volumetra.draws import Draw
from volumetra.image import Image, change_type, least_type, montage, orientation, reorient, resample, slices
from volumetra.operators import clusters, generative, geometry, intensity
from volumetra.plans.pipeline import SCHEMA, Pipeline
from volumetra.plans.synthseg import SynthSegTransforms
from volumetra.sources import nifti


def image(shape=(3, 4, 5)):
    m = np.diag([2.0, 1.5, 1.0, 1.0])
    m[:3, 3] = 7, 8, 9
    return Image(np.arange(np.prod(shape), dtype=np.float32).reshape(shape), m)


def world(im, z, y, x):
    return im.affine @ [x, y, z, 1]


@pytest.mark.parametrize("target", ["LPI", "RPI", "AIL", "SRP", "IPR", "PSL"])
def test_reorient_keeps_every_voxel_in_its_place(target):
    im = image()
    out = reorient(im, target)
    assert im.orientation == "LPI" and out.orientation == target
    here = {tuple(world(im, *i)[:3]): v for i, v in np.ndenumerate(im.data)}
    assert all(here[tuple(world(out, *i)[:3])] == v for i, v in np.ndenumerate(out.data))
    assert np.array_equal(reorient(out, "LPI").data, im.data)
    with pytest.raises(ValueError):
        reorient(im, "LRP")


def test_resample():
    im = image((4, 4, 4))
    assert resample(im, (2,), "factor").data.shape == (8, 8, 8) and resample(im, (1,), "mm").data.shape == (4, 6, 8)
    ramp = Image(np.broadcast_to(np.arange(4.0), (4, 4, 4)).copy())
    assert resample(ramp, (8, 4, 4)).data[0, 0].tolist() == [0, 0.5, 1, 1.5, 2, 2.5, 3, 3]
    assert resample(ramp, (8, 4, 4), interpolation="nn").data[0, 0].tolist() == [0, 1, 1, 2, 2, 3, 3, 3]
    back = resample(resample(im, (2,), "factor"), like=im)
    assert np.allclose(back.data, im.data)
    four = Image(np.stack([im.data, im.data * 2]))
    assert resample(four, (2, 2, 2)).data.shape == (2, 2, 2, 2)
    with pytest.raises(ValueError):
        resample(im, (0, 1, 1))


def test_types_slices_and_planes():
    assert [least_type(a, b, True) for a, b in ((0, 255), (0, 256), (-1, 127), (-1, 128), (0, 2**40))] == ["uint8", "uint16", "int8", "int16", "uint64"]
    im = image()
    assert change_type(im, "minimize").data.dtype == np.uint8 and change_type(Image(im.data + 0.5), "minimize").data.dtype == np.float32
    assert change_type(Image(im.data * 100), "uint8", rescale=True).data.max() == 255 and change_type(im, None).data is not im.data
    assert np.array_equal(slices(im, "SI")[0], im.data[-1]) and np.array_equal(slices(im, "LR")[1], im.data[:, :, 1])
    assert Image.of([2, 3, 4]).data.sum() == 0 and Image.of(im).zeros("int16").data.dtype == np.int16
    assert [p.shape for p in montage(im.data)] == [(4, 5), (3, 5), (3, 4)] and orientation(np.diag([-1.0, -1, 1, 1])) == "RAI"


def test_files(spark, tmp_path):
    rows = [(i, 0, (2, 2, 3, 4), [float(x + i) for x in range(48)], [x % 3 for x in range(24)]) for i in range(3)] + [(9, 0, (1, 1, 1, 1), None, None)]
    done = nifti.write_pairs(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "out")).collect()
    assert len(done) == 9 and all(r.bytes > 0 for r in done)
    back = {r.path.rsplit("out/", 1)[1]: r for r in nifti.read(spark, str(tmp_path / "out")).collect()}
    assert back["images/2_0001.nii.gz"].img == [float(x + 2) for x in range(24, 48)] and back["labels/0.nii.gz"].dtype == "int32"


def test_registry_takes_foreign_functions():
    with registry.isolated():
        entry = registry.register_entry("Halve", lambda img, seg, draw, by, scale=1: (img / by * scale, seg), "halve", "TA", before="RandomInverseGPU", context=("by",), adapters={"scale": float})
        assert "Halve" in registry.names("GPU") and entry.accepted() >= {"scale", "p"} and "by" not in entry.accepted()
        v, _, _ = Pipeline({"GPU": {"Halve": {"scale": "3"}}}, context={"by": 2}).one(0, 0, np.full((1, 1, 1, 2), 4.0), None)
        assert v.ravel().tolist() == [6, 6]
        with pytest.raises(ValueError, match="by"):
            Pipeline({"GPU": {"Halve": {}}}).one(0, 0, np.ones((1, 1, 1, 2)), None)
        with pytest.raises(registry.InvalidConfig, match="did you mean scale"):
            config.Config({"GPU": {"Halve": {"scal": 1}}})
    assert "Halve" not in registry.names()


def test_low_resolution_leaves_the_shuffled_bucket():
    section = {n: {} for n in ("RandomGammaGPU", "RandomLowResTransformGPU", "RandomFlipTransformGPU", "RandomSqrtGPU")}
    for key in range(20):
        order = [n for n, _ in Pipeline({"GPU": section, "pipeline": {"mode": "random_order"}}).order(key)]
        assert order[:2] == ["RandomFlipTransformGPU", "RandomLowResTransformGPU"]
    order = [n for n, _ in Pipeline({"GPU": section, "pipeline": {"mode": "random_order_ta"}}).order(0)]
    assert order.index("RandomLowResTransformGPU") > order.index("RandomGammaGPU")


def test_whole_batches_fire_or_not():
    pipe = Pipeline({"GPU": {"RandomInverseGPU": {"p_batch": 0.5}}, "pipeline": {"same_on_batch": False}}, seed=3)
    fired = {(b, bool(pipe.one(10 * b + i, b, np.arange(8.0).reshape(1, 2, 2, 2), None)[2])) for b in range(40) for i in range(5)}
    assert len(fired) == 40 and 10 < sum(x for _, x in fired) < 30


@pytest.mark.parametrize("bad", [{"same_on_batch": "yes"}, {"random_choose": -1}, {"random_choose": {"XX": 1}}, {"mode": "any"}])
def test_pipeline_block_is_checked(bad):
    with pytest.raises(registry.InvalidConfig):
        config.Config({"GPU": {}, "pipeline": bad})
    with pytest.raises(registry.InvalidConfig):
        config.Config({"GPU": {"RandomInverseGPU": {"p": 1.5}}})


def test_scharr_signs_and_scale():
    v = np.broadcast_to(np.arange(6.0), (6, 6, 6))
    z, y, x = kernels.scharr(v)
    assert (x[2:-2, 2:-2, 2:-2] == 2 * 256).all() and not y[2:-2, 2:-2, 2:-2].any() and not z[2:-2, 2:-2, 2:-2].any()


def test_acquisition_does_not_shift():
    moved = []
    for at in range(8, 25):
        edge = np.zeros((32, 4, 4))
        edge[at:] = 1
        moved += [32 - geometry.acquire(edge, (f, 1, 1))[:, 0, 0].sum() - at for f in np.linspace(0.25, 0.9, 40)]
    assert abs(np.mean(moved)) < 0.2 and np.abs(moved).max() < 3


def test_remap_reads_the_foreground_alone():
    v = np.array([0.0, 0.0, 0.4, 0.6]).reshape(1, 1, 4)
    fg = v > 0
    out = clusters.remap(v, np.zeros((1, 1, 4), int), fg, Draw(1, "x", 1))
    level = Draw(1, "x", 1).rng("remap").random(1)[0]
    assert out[0, 0, :2].tolist() == [0, 0]
    if 0 < out[0, 0, 2] < 1 and 0 < out[0, 0, 3] < 1:
        assert np.isclose(out[0, 0, 2:].mean(), level)


def test_redistribution_leaves_unlabelled_samples_alone():
    img, seg = np.random.default_rng(0).normal(size=(1, 8, 8, 8)), np.zeros((8, 8, 8), int)
    for f in (clusters.redistribute, clusters.redistribute_first):
        assert f(img, seg, Draw(1, "x", 1))[0] is img
    seg[2:5, 2:5, 2:5] = 1
    out, _ = clusters.redistribute(img, seg, Draw(1, "x", 1))
    assert np.isclose(out.mean(), img.mean()) and np.isclose(out.std(), img.std()) and not np.allclose(out, img)


def test_channels_that_are_not_there():
    img, seg = np.random.default_rng(0).random((1, 6, 6, 6)), np.ones((6, 6, 6), int)
    out, _ = generative.synthetic_intensity(img, seg, Draw(1, "x", 1), apply_to_channel=(0, 3))
    assert not np.allclose(out[0], img[0])


def test_siblings_merge_within_their_parent():
    parents = [0, 0, 0, 1, 1, 2]
    assert generative.merge_siblings(parents, 0.0, Draw(1, "x", 1)) == list(range(6))
    assert generative.merge_siblings(parents, 1.0, Draw(1, "x", 1)) == [0, 0, 0, 1, 1, 2]
    for key in range(50):
        out = generative.merge_siblings(parents, 0.5, Draw(1, "x", key))
        assert sorted(set(out)) == list(range(len(set(out)))) and all(len({parents[i] for i, c in enumerate(out) if c == k}) == 1 for k in out)


def test_synthetic_pairs(spark):
    seg = np.zeros((10, 10, 10), int)
    seg[2:6, 2:6, 2:6], seg[6:9, 6:9, 6:9] = 1, 2
    rows = [(i, 0, (1, 10, 10, 10), [0.5] * 1000, seg.ravel().tolist() if i else None) for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.sample_id: r for r in SynthSegTransforms({"SynthSeg": {"probability": 0.5, "return_onehot": True, "output_shape": [8, 8, 8], "em": True, "em_merge_prob": 0.5, "flip_prob": 0.5, "left": [1], "right": [2]}}, seed=2).apply(df).collect()}
    made = [r for r in out.values() if r.trace]
    assert 2 <= len(made) <= 10 and out[0].seg is None
    for r in made:
        assert tuple(r.shape) == (1, 8, 8, 8) and len(r.img) == 512 and set(r.seg) <= {0, 1, 2} and len(r.onehot) == max(r.seg)
    with pytest.raises(ValueError, match="unknown"):
        SynthSegTransforms({"nope": 1})


def test_helpers(monkeypatch, tmp_path):
    v = np.random.default_rng(1).normal(size=(4, 4, 4))
    w, ends = intensity.minmax(v)
    assert np.allclose(intensity.from_minmax(w, ends), v) and intensity.is_zscore(v) and not intensity.is_zscore(w)
    k = np.random.default_rng(2).normal(size=(3, 3, 3))
    assert np.allclose(kernels.apply_filter(v[None, None], k)[0, 0], kernels.correlate(v, k, "zero"))
    assert kernels.apply_filter(np.ones((2, 3, 5)), np.ones((3, 3))).shape == (2, 3, 5)
    assert intensity.foreground(np.stack([v > 9, v < 9])).all() and clusters.region_masks(np.array([[[0, 2, 2, 5]]]), 2).shape == (2, 1, 1, 4)
    share = generative.smooth_share(Draw(1, "x", 1), "s", (6, 6, 6), 0.3, 3.0)
    assert ((share > 0) & (share < 1)).all()
    with pytest.raises(ValueError, match="BANK"):
        generative.load_bank()
    np.savez(tmp_path / "bank.npz", a__b=np.linspace(0, 1, 12).reshape(3, 4), c__d=np.linspace(1, 0, 12).reshape(3, 4))
    monkeypatch.setenv(generative.BANK, str(tmp_path / "bank.npz"))
    img, seg = v[None], (v > 0).astype(int)
    out, _ = generative.domain_transfer(img, seg, Draw(1, "x", 1), any_source=True, blend_targets=2, p_class_mix=1.0, p_spatial_mix=1.0)
    assert np.isfinite(out).all() and np.isclose(out.mean(), v.mean())
