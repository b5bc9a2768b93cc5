"""Clustering, palettes and redistribution by region."""

from __future__ import annotations

import numpy as np

from ..kernels import assign, blur, dilate, kmeans, mixture, voronoi
from ..registry import register
from .intensity import keep_stats, unit


def densify(ids: np.ndarray) -> np.ndarray:
    """Sparse ids as 0, 1, ... in the same order."""
    return np.unique(ids, return_inverse=True)[1].reshape(ids.shape)


def kmeans_regions(v, fg, draw, c_choices=(2, 3, 4, 5, 6), n_kmeans_subsample=10000, skip_prob=0.1):
    """Cluster id of each voxel; one region if there are under four foreground voxels or the coin says so."""
    inside = v[fg]
    if len(inside) < 4 or draw.chance("skip", skip_prob):
        return np.zeros(v.shape, np.int64)
    some = inside if len(inside) <= n_kmeans_subsample else draw.rng("subsample").choice(inside, n_kmeans_subsample, replace=False)
    centre = kmeans(some, draw.pick("clusters", c_choices))
    return np.searchsorted((centre[1:] + centre[:-1]) / 2, v, side="left")


def mixture_regions(v, fg, draw, n_foreground_clusters=3, background_range=(3, 10)):
    out = np.zeros(v.shape, np.int64)
    for k, (on, n) in enumerate(((~fg, int(draw.between("background", background_range[0], background_range[1] + 1 - 1e-9))), (fg, n_foreground_clusters))):
        if on.sum() >= 4:
            out[on] = k * 100 + assign(v[on], *mixture(v[on], n))
    return densify(out)


def voronoi_regions(ids, fg, draw, s_choices=(2, 3, 4, 5, 6, 7, 8, 9, 10), skip_prob=0.4):
    """Split each cluster by its nearest seed, seeds drawn among its foreground."""
    out = np.zeros(ids.shape, np.int64)
    for k in np.unique(ids):
        on, base = ids == k, int(out.max()) + 1
        able = np.flatnonzero((on & fg).ravel())
        at = np.flatnonzero(on.ravel())
        part = 0
        if len(able) and not draw.chance(f"keep.{k}", skip_prob):
            n = min(len(able), draw.pick(f"seeds.{k}", s_choices))
            part = voronoi(ids.shape, at, draw.rng(f"where.{k}").choice(able, n, replace=False))
        out.ravel()[at] = base + part
    return densify(out)


def mixture_refinement(v, ids, draw, n_range=(2, 4)):
    out = np.zeros(ids.shape, np.int64)
    for k in np.unique(ids):
        on = ids == k
        n = int(draw.between(f"split.{k}", n_range[0], n_range[1] + 1 - 1e-9))
        out[on] = k * 100 + (assign(v[on], *mixture(v[on], n)) if on.sum() >= 4 else 0)
    return densify(out)


def remap(v, ids, fg, draw, magnitude=(0.5, 2.0)):
    """Around each region's foreground mean: a new level plus a signed, scaled residual; clamped to [0, 1], background 0."""
    count = int(ids.max()) + 1
    mean = np.bincount(ids.ravel(), (v * fg).ravel(), count) / np.maximum(np.bincount(ids[fg], minlength=count), 1e-7)
    rng = draw.rng("remap")
    level, scale = rng.random(count), rng.uniform(*magnitude, count) * rng.choice([-1, 1], count)
    return np.clip(level[ids] + scale[ids] * (v - mean[ids]), 0, 1) * fg


def overlay(v, seg, fg, draw, label_remap_prob=0.5, min_label_voxels=4, blend_strength=1.0):
    """Remap the voxels of each label with some probability."""
    if seg is None:
        return v
    for k in np.unique(seg[seg > 0]):
        on = (seg == k) & fg
        if on.sum() >= min_label_voxels and draw.chance(f"label.{int(k)}", label_remap_prob):
            a = draw.between(f"alpha.{int(k)}", 0.5, 2) * (1 if draw.chance(f"sign.{int(k)}", 0.5) else -1)
            new = np.clip(draw.u(f"level.{int(k)}") + a * (v[on] - v[on].mean()), 0, 1)
            b = blend_strength if np.isscalar(blend_strength) else draw.between(f"blend.{int(k)}", *blend_strength)
            v = v.copy()
            v[on] = (1 - b) * v[on] + b * new
    return v


def foreground_zscore(v, fg):
    w = v[fg] if fg.any() else v.ravel()
    return (v - w.mean()) / np.sqrt(w.var() + 1e-7)


def _palette(img, seg, draw, regions, dark, sigmas, magnitude, label_prob, voxels, strength):
    v = unit(img[0].astype(np.float64), 1e-8)
    fg = v > dark
    out = remap(v, regions(v, fg), fg, draw, magnitude)
    s = draw.pick("blur", sigmas)
    out = overlay(blur(out, (s,) * 3), seg, fg, draw, label_prob, voxels, strength)
    new = img.copy()
    new[0] = foreground_zscore(blur(out, (draw.pick("blur.2", sigmas),) * 3), fg)
    return (new if np.isfinite(new).all() else img), seg


@register("RandomPaletteGPU", "palette", "TA")
def palette(img, seg, draw, c_choices=(2, 3, 4, 5, 6), s_choices=(2, 3, 4, 5, 6, 7, 8, 9, 10), blur_sigmas=(0.0, 0.0, 0.0, 0.3, 0.5, 0.8), dark_threshold=0.01, n_kmeans_subsample=10000, skip_parcellation_prob=0.1, skip_sub_parc_prob=0.4, alpha_magnitude_range=(0.5, 2.0), label_remap_prob=0.5, min_label_voxels=4, label_classes=None, blend_strength=1.0):
    """Cluster by intensity, split by nearest seeds, remap each region, then each label; first channel."""
    regions = lambda v, fg: voronoi_regions(kmeans_regions(v, fg, draw, c_choices, n_kmeans_subsample, skip_parcellation_prob), fg, draw, s_choices, skip_sub_parc_prob)
    return _palette(img, seg, draw, regions, dark_threshold, blur_sigmas, alpha_magnitude_range, label_remap_prob, min_label_voxels, blend_strength)


INITIAL = {"KMeans1DInitial": kmeans_regions, "EMGMMInitial": mixture_regions}
REFINE = {"VoronoiRefinement": lambda v, ids, fg, d, **k: voronoi_regions(ids, fg, d, **k), "EMGMMRefinement": lambda v, ids, fg, d, **k: mixture_refinement(v, ids, d, **k), "IdentityRefinement": lambda v, ids, fg, d: ids}


@register("PaletteSynthesisGPU", "palette_composed", "TA")
def palette_synthesis(img, seg, draw, initial=None, refinement=None, blur_sigmas=(0.0,), dark_threshold=0.01, alpha_magnitude_range=(0.5, 2.0), label_remap_prob=0.5, min_label_voxels=4, blend_strength=1.0):
    """The same from blocks named in the configuration: {"type": ..., parameters}."""

    def block(spec, table, default):
        spec = dict(spec or {"type": default})
        kind = spec.pop("type", default)
        if kind not in table:
            raise ValueError(f"{kind} is not one of {', '.join(table)}")
        return table[kind], spec

    (first, a), (then, b) = block(initial, INITIAL, "KMeans1DInitial"), block(refinement, REFINE, "VoronoiRefinement")
    return _palette(img, seg, draw, lambda v, fg: then(v, densify(first(v, fg, draw, **a)), fg, draw, **b), dark_threshold, blur_sigmas, alpha_magnitude_range, label_remap_prob, min_label_voxels, blend_strength)


def bump(v, mean, sd):
    return np.exp(-((v - mean) ** 2) / (2 * sd * sd)) / (sd * np.sqrt(2 * np.pi))


def region_masks(seg: np.ndarray, most: int | None = None) -> np.ndarray:
    """(R, D, H, W): channels of a one-hot map (C, D, H, W) as they are, or one mask per distinct rounded label, background included; the first `most` of them."""
    if seg.ndim == 4:
        return seg > 0
    whole = np.rint(seg)
    return np.stack([whole == k for k in np.unique(whole)[:most]])


def spread(v, on, shell, ddof=0):
    """How far a region differs from its shell, in units of their deviations, and its mean."""
    sd = lambda m: v[m].std(ddof=ddof) if m.sum() > ddof else 0.0
    mean, inner = v[on].mean(), sd(on)
    far, outer = (v[shell].mean(), sd(shell)) if shell.any() else (mean, inner) if ddof else (0.0, 0.0)
    return mean, 0.4 * abs((mean - far) * inner / (outer + 1e-6))


@register("RandomRedistributeSegGPU", "redistribute_seg", "TA")
def redistribute(img, seg, draw, in_seg=0.2, retain_stats=True, std_noise_range=(0.1, 0.3), dilation_iterations_range=(1, 3), apply_to_channel=(0,)):
    """Add a Gaussian bump per region, scaled by a factor in [-1, 1] and as wide as the region differs from its dilated shell; background is a region too."""
    if seg is None or not (seg > 0).any():
        return img, seg
    out, times = img.copy(), int(draw.between("times", dilation_iterations_range[0], dilation_iterations_range[1] + 1 - 1e-9))
    inside, noise = draw.chance("inside", in_seg), draw.between("noise", *std_noise_range)
    for c in apply_to_channel:
        if not 0 <= c < len(img):
            raise ValueError(f"channel {c} of {len(img)}")
        old = img[c].astype(np.float64)
        v, add = (old - old.min()) / max(old.max() - old.min(), 1e-6), np.zeros(old.shape)
        for k in np.unique(seg):
            on = seg == k
            mean, far = spread(v, on, dilate(on, times) & ~on)
            wide = max(draw.u(f"wide.{c}.{int(k)}") * noise + far, 0.01)
            add += bump(v, mean, wide) * draw.between(f"factor.{c}.{int(k)}", -1, 1) * (on if inside else 1)
        low, high = add.min(), add.max()
        new = v + 2 * (add - low) / (high - low + 1e-6) if high - low > 1e-8 else v
        if retain_stats:  # deviations of the population here
            new = (new - new.mean()) / max(new.std(), 1e-7) * old.std() + old.mean()
        if np.isfinite(new).all():
            out[c] = new
    return out, seg


@register("RedistributeTransform", "redistribute_seg", "TA")
def redistribute_first(img, seg, draw, classes=None, in_seg=0.2, retain_stats=False):
    """Variant: labels only, three 6-connected dilations, the sum scaled so that its greatest magnitude is 2."""
    if seg is None or not (seg > 0).any():
        return img, seg
    groups = np.zeros_like(seg)
    for i, labels in enumerate(classes or [], 1):
        groups[np.isin(seg, labels)] = i
    seg_, old = groups if classes else seg, img[0].astype(np.float64)
    v, add = (old - old.min()) / max(old.max() - old.min(), 1e-6), np.zeros(old.shape)
    inside = draw.chance("inside", in_seg)
    for k in np.unique(seg_[seg_ > 0]):
        on = seg_ == k
        mean, far = spread(v, on, dilate(on, 3, corners=False) & ~on, 1)
        wide = max(draw.between(f"wide.{int(k)}", 0, 0.2) + far, 0.01)
        add += bump(v, mean, wide) * draw.between(f"factor.{int(k)}", -1, 1) * (on if inside else 1)
    new, out = v + 2 * add / (np.abs(add).max() + 1e-6), img.copy()
    new = keep_stats(new, old, least=1e-7) if retain_stats else new
    if np.isfinite(new).all():
        out[0] = new
    return out, seg
