"""Operators that make images: from labels, from look-up tables, from scanner faults."""

from __future__ import annotations

import os

import numpy as np

from ..kernels import affine, assign, blur, integrate, mixture, quantile, resize
from ..registry import register
from .geometry import about_centre, acquire, warp


def relabel(seg: np.ndarray, table: dict[int, int]) -> np.ndarray:
    """Labels by a table; others stay, negative results become 0."""
    out = seg.copy()
    for a, b in table.items():
        out[seg == int(a)] = max(0, int(b))
    return out


def collapse_onehot(channels: np.ndarray) -> np.ndarray:
    """(C, D, H, W) to labels 1..C, first channel on ties, background 0."""
    return np.where((channels > 0).any(0), (channels > 0).argmax(0) + 1, 0)


def onehot(seg: np.ndarray, count: int) -> np.ndarray:
    return np.stack([seg == c + 1 for c in range(count)])


def flip_with_swap(seg: np.ndarray, neutral: list[int], left: list[int], right: list[int], axis: int = 2) -> np.ndarray:
    out = np.flip(seg, axis)
    return relabel(out, {**dict(zip(left, right, strict=True)), **dict(zip(right, left, strict=True))})


def subdivide(v, seg, draw, background=(3, 10), foreground=2, most=100_000):
    """Split each label by a mixture of its intensities; returns finer labels and the parent of each."""
    fine, parent = np.zeros(seg.shape, np.int64), {}
    for i, k in enumerate(np.unique(seg)):
        on = seg == k
        n = int(draw.between("split.background", background[0], background[1] + 1 - 1e-9)) if k == 0 else foreground
        w = v[on]
        part = assign(w, *mixture(w if len(w) <= most else draw.rng(f"fit.{i}").choice(w, most, replace=False), n)) if len(w) >= 4 * n else 0
        fine[on] = i * 100 + part
        parent |= {i * 100 + j: int(k) for j in range(n)}
    return fine, parent


def merge_siblings(parents: list[int], p: float, draw) -> list[int]:
    """Classes of sub-labels: each after the first of its parent joins one of that parent's classes with probability p, else opens one."""
    taken: dict[int, list[int]] = {}
    out = []
    for i, parent in enumerate(parents):
        mine = taken.setdefault(int(parent), [])
        if mine and draw.chance(f"merge.{i}", p):
            out.append(draw.pick(f"sibling.{i}", mine))
        else:
            out.append(len(set(out)))
            mine.append(out[-1])
    return out


def random_crop(labels: np.ndarray, shape, draw, *more: np.ndarray):
    """A box of at most that shape at a random place, from each array."""
    cuts = []
    for axis, (n, m) in enumerate(zip(labels.shape, shape, strict=True)):
        m = min(int(m), n)
        start = min(int(draw.u(f"crop.{axis}") * (n - m + 1)), n - m)
        cuts.append(slice(start, start + m))
    return [x[(..., *cuts)] for x in (labels, *more)]


def smooth_share(draw, slot, shape, scale, gain):
    """A smooth field in (0, 1): the higher the gain, the sharper its regions; an offset in [-2, 2] shifts the balance."""
    return 1 / (1 + np.exp(-(gain * smooth_field(draw, slot, shape, scale, 1.0) + draw.between(f"{slot}.offset", -2, 2))))


def render(labels, draw, channels, mean_range=(0, 250), std_range=(0, 30)):
    """Mean and deviation per label and channel, then mean + deviation * noise; the background is black in 5 % and dark in 25 %."""
    values, at = np.unique(labels, return_inverse=True)
    out = []
    for c in range(channels):
        mean = np.array([draw.between(f"mean.{c}.{int(k)}", *mean_range) for k in values])
        sd = np.array([draw.between(f"std.{c}.{int(k)}", *std_range) for k in values])
        coin = draw.u(f"background.{c}")
        if values[0] == 0 and coin < 0.3:
            mean[0], sd[0] = (0, 0) if coin < 0.05 else (mean[0] / 10, sd[0] / 10)
        at3 = at.reshape(labels.shape)
        out.append(mean[at3] + sd[at3] * draw.rng(f"noise.{c}").standard_normal(labels.shape))
    return np.stack(out)


def smooth_field(draw, slot, shape, scale, sd):
    coarse = tuple(max(2, round(n * scale)) for n in shape)
    return resize(draw.rng(slot).normal(0, max(sd, 1e-12), coarse), shape, corners=True)


def finish(v, clip=300.0, gamma_std=0.5, normalise=True, gamma=0.0):
    v = np.clip(v, 0, clip)
    if normalise:
        v = (v - v.min()) / (v.max() - v.min() + 1e-7)
    return v ** np.exp(gamma * gamma_std)


def generate(img, seg, draw, deform=True, bias_field_std=0.7, nonlin_std=4.0, scaling=0.2, rotation=15.0, shearing=0.012, gamma_std=0.5, low_res=True, em=False, em_merge_prob=0.0, output_shape=None, flip_prob=0.0, left=(), right=(), classes=None, mean_range=(0, 250), std_range=(0, 30)):
    """A synthetic image and its labels, of as many channels as img has.

    output_shape crops labels at random; flip_prob mirrors them and swaps left for right labels; em splits labels by a mixture of the
    real intensities, and em_merge_prob ties siblings together again; classes maps labels that share one intensity to one class.
    """
    labels = seg.astype(np.int64)
    if output_shape is not None:
        labels, img = random_crop(labels, output_shape, draw, img)
    if flip_prob and draw.chance("flip", flip_prob):
        labels, img = flip_with_swap(labels, [], list(left), list(right)), np.flip(img, -1)
    shape = labels.shape
    if em:
        labels, parent = subdivide(img[0].astype(np.float64), labels, draw)
    else:
        parent = {int(k): int(k) for k in np.unique(labels)}
    if deform:
        m = affine([draw.between(f"scale.{a}", 1 - scaling, 1 + scaling) for a in "zyx"], [draw.between(f"angle.{a}", -rotation, rotation) for a in "zyx"], [draw.between(f"shear.{i}", -shearing, shearing) for i in range(6)], [0] * 3)
        field = np.stack([smooth_field(draw, f"velocity.{a}", shape, 0.04, draw.between("nonlinear", 0, nonlin_std)) for a in "zyx"])
        at = about_centre(m, shape)
        moved = integrate(field)
        _, labels = warp(labels[None].astype(np.float64), labels, at + moved)
    tied = {int(k): int((classes or {}).get(str(int(k)), (classes or {}).get(int(k), k))) for k in np.unique(labels)}
    if em and em_merge_prob:
        fine = sorted(tied)
        tied = dict(zip(fine, merge_siblings([parent.get(k, 0) for k in fine], em_merge_prob, draw), strict=True))
    out = render(np.vectorize(tied.get, otypes=[np.int64])(labels), draw, len(img), mean_range, std_range)
    for c in range(len(out)):
        v = out[c] * np.exp(smooth_field(draw, f"bias.{c}", shape, 0.025, draw.between("bias", 0, bias_field_std)))
        v = finish(v, gamma_std=gamma_std, gamma=float(draw.rng(f"gamma.{c}").standard_normal()))
        if low_res and not draw.chance(f"full.{c}", 0.05):
            same, f, axis = draw.chance(f"isotropic.{c}", 0.1), draw.between(f"res.{c}", 0.25, 0.9), draw.pick(f"axis.{c}", (0, 1, 2))
            factors = [f if same or a == axis else 1.0 for a in range(3)]
            v = acquire(blur(v, tuple(0.75 / x if x < 1 else 0 for x in factors)), factors)
        out[c] = v
    return out, np.vectorize(lambda k: parent.get(int(k), 0))(labels).astype(seg.dtype)


@register("RandomSynthSegGPU", "synthseg", "TA", defaults={"p": 0.5})
def synthetic_intensity(img, seg, draw, bias_field_std=0.7, gamma_std=0.5, apply_to_channel=(0,)):
    """A new image for the same labels: only intensities change. Channels that are not there are passed over."""
    if seg is None:
        return img, seg
    new, _ = generate(img, seg, draw, deform=False, bias_field_std=bias_field_std, gamma_std=gamma_std)
    out = img.copy()
    for c in apply_to_channel:
        if 0 <= c < len(img) and np.isfinite(new[c]).all():
            out[c] = new[c]
    return out, seg


BANK = "VOLUMETRA_DOMAIN_BANK"  # environment variable with the path of a bank, where none is named


def load_bank(path: str | None = None) -> dict:
    """Look-up tables of an npz file: `source__target` arrays [classes, levels]."""
    path = path or os.environ.get(BANK)
    if not path:
        raise ValueError(f"name a bank of look-up tables: bank, bank_path or the environment variable {BANK}")
    if not os.path.isfile(path):
        raise FileNotFoundError(f"no bank of look-up tables at {path!r}")
    with np.load(path, allow_pickle=False) as f:
        return {k: f[k] for k in f.files}


def _blend(bank, names, draw, slot, many, concentration):
    """One table, or a mixture of `many` with weights from a symmetric Dirichlet distribution."""
    if many <= 1 or len(names) == 1:
        return np.asarray(bank[draw.pick(slot, names)], np.float64)
    rng = draw.rng(f"{slot}.blend")
    some = rng.choice(len(names), min(many, len(names)), replace=False)
    weights = rng.dirichlet(np.full(len(some), concentration))
    return sum(w * np.asarray(bank[names[i]], np.float64) for w, i in zip(weights, some, strict=True))


@register("RandomDomainTransferGPU", "domain_transfer", "TA", defaults={"p": 0.2})
def domain_transfer(img, seg, draw, bank=None, bank_path=None, source=None, target=None, any_source=False, blend_targets=1, blend_concentration=1.0, p_class_mix=0.0, p_spatial_mix=0.0, spatial_mix_scale=0.03, spatial_mix_gain=3.0, blur_sigma=1.0, bias_std=0.0, pct=1.0, apply_to_channel=(0,)):
    """Scale by percentiles, look intensities up per class, blend the classes by blurred masks, restore mean and deviation.

    any_source takes tables of all sources; several targets may be blended, each class may draw tables of its own (p_class_mix), and two
    draws may share the volume by a smooth field (p_spatial_mix).
    """
    bank = bank or load_bank(bank_path)
    names = sorted(k for k in bank if "__" in k and (any_source or source is None or k.split("__")[0] == source) and (target is None or k.split("__")[1] == target))
    if not names:
        raise ValueError("the bank has no table for that source and target")

    def table(slot):
        lut = _blend(bank, names, draw, slot, blend_targets, blend_concentration)
        if draw.chance(f"{slot}.per_class", p_class_mix):
            lut = np.stack([_blend(bank, names, draw, f"{slot}.{k}", blend_targets, blend_concentration)[k] for k in range(len(lut))])
        return lut

    luts, out = [table("table")], img.copy()
    if draw.chance("spatial", p_spatial_mix):
        luts.append(table("table.2"))
    labels = np.clip(np.zeros(img.shape[1:], np.int64) if seg is None else seg.astype(np.int64), 0, len(luts[0]) - 1)
    for c in apply_to_channel:
        if not 0 <= c < len(img):
            raise ValueError(f"channel {c} of {len(img)}")
        old, news = img[c].astype(np.float64), []
        low, high = quantile(old, pct / 100), quantile(old, 1 - pct / 100)
        for lut in luts:
            v = np.clip((old - low) / max(high - low, 1e-8), 0, 1) * (lut.shape[1] - 1)
            total, weight = 0.0, 0.0
            for k in np.unique(labels):
                w = blur((labels == k).astype(np.float64), (blur_sigma,) * 3)
                total, weight = total + w * np.interp(v, np.arange(lut.shape[1]), lut[k]), weight + w
            news.append(total / np.maximum(weight, 1e-8))
        new = news[0]
        if len(news) > 1:
            share = smooth_share(draw, f"share.{c}", old.shape, spatial_mix_scale, spatial_mix_gain)
            new = share * news[0] + (1 - share) * news[1]
        if bias_std:
            new = new * np.exp(smooth_field(draw, f"bias.{c}", old.shape, 0.05, bias_std))
        new = (new - new.mean()) / max(new.std(), 1e-8) * old.std() + old.mean()
        if np.isfinite(new).all():
            out[c] = new
    return out, seg


@register("ArtifactTransform", "artifact", "TA", exact=False)
def artifact(img, seg, draw, motion=False, ghosting=False, spike=False, bias_field=False, blur=False, noise=False, swap=False, random_pick=False):
    """Scanner faults in k-space and image space; all enabled in order, or one of them."""
    from ..kernels import blur as smooth

    def fourier(change):
        return lambda v: np.real(np.fft.ifftn(change(np.fft.fftn(v))))

    def ghosts(k):
        k = k.copy()
        k[:: draw.pick("ghosts", (2, 3, 4))] *= 1 + draw.between("ghost", 0.2, 0.8)
        return k

    def spikes(k):
        k = k.copy()
        for i in range(draw.pick("spikes", (1, 2))):
            k[tuple(int(draw.u(f"spike.{i}.{a}") * n) for a, n in enumerate(k.shape))] += np.abs(k).max() * draw.between(f"spike.{i}", 0.1, 0.4)
        return k

    def moves(k):
        k, n = k.copy(), k.shape[1]
        cut = int(draw.between("moved", 0.3, 0.7) * n)
        k[:, cut:] *= np.exp(-2j * np.pi * np.fft.fftfreq(k.shape[0])[:, None, None] * draw.between("shift", -3, 3))
        return k

    def swaps(v):
        v = v.copy()
        for i in range(4):
            a, b = ([int(draw.u(f"swap.{i}.{s}{x}") * max(1, n - max(1, n // 6))) for x, n in enumerate(v.shape)] for s in "ab")
            cut = [tuple(slice(p, p + max(1, n // 6)) for p, n in zip(q, v.shape, strict=True)) for q in (a, b)]
            v[cut[0]], v[cut[1]] = v[cut[1]].copy(), v[cut[0]].copy()
        return v

    steps = {
        "motion": fourier(moves), "ghosting": fourier(ghosts), "spike": fourier(spikes),
        "bias_field": lambda v: v * np.exp(smooth_field(draw, "bias", v.shape, 0.1, 0.5)),
        "blur": lambda v: smooth(v, (draw.between("sigma", 0, 2),) * 3),
        "noise": lambda v: v + draw.rng("noise").normal(0, draw.between("sd", 0, 0.25), v.shape),
        "swap": swaps,
    }
    on = [k for k, v in zip(steps, (motion, ghosting, spike, bias_field, blur, noise, swap), strict=True) if v]
    out = img.astype(np.float64)
    for k in [draw.pick("one", on)] if random_pick and on else on:
        out[0] = steps[k](out[0])
    return (out.astype(img.dtype) if np.isfinite(out).all() else img), seg
