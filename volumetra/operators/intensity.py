"""Pointwise intensity operators, region selection and blending."""

from __future__ import annotations

import numpy as np

from ..draws import Draw
from ..kernels import coordinates, quantile
from ..registry import register


def keep_stats(new: np.ndarray, old: np.ndarray, eps: float = 1e-8, least: float = 0.0) -> np.ndarray:
    """Bring back the mean and the sample deviation of the original. The GPU variants add eps to the new deviation, the CPU variants hold it at `least` or more."""
    sd = lambda v: v.std(ddof=1) if v.size > 1 else 0.0
    return (new - new.mean()) / (max(sd(new), least) if least else sd(new) + eps) * sd(old) + old.mean()


def region(new, old, seg, draw: Draw, c: int, in_seg: float = 0.0, out_seg: float = 0.0, mix_in_out: bool = False):
    """Keep the change in the labels, outside them, or everywhere.

    Two coins: only the first says in, only the second says out, both or neither say all. mix_in_out
    then keeps or drops each label class by a coin of its own.
    """
    a, b = draw.chance(f"in.{c}", in_seg), draw.chance(f"out.{c}", out_seg)
    if seg is None or a == b:
        return new
    on = foreground(seg)
    if mix_in_out and seg.ndim == 3:
        for k in np.unique(seg[on]):
            if draw.chance(f"class.{c}.{int(k)}", 0.5):
                on &= seg != k
    return np.where(on if a else ~on, new, old)


def each(img, seg, draw, f, apply_to_channel=(0,), retain_stats=False, mix_prob=0.0, least=0.0, **where):
    """Apply f to channels: mix with the original, restore statistics, select a region; drop non-finite results."""
    out = img.copy()
    for c in apply_to_channel:
        if not 0 <= c < len(img):
            raise ValueError(f"channel {c} of {len(img)}")
        old = img[c].astype(np.float64)
        new = f(old, c)
        if mix_prob and draw.chance(f"mix.{c}", mix_prob):
            a = draw.u(f"alpha.{c}")
            new = a * old + (1 - a) * new
        if retain_stats:
            new = keep_stats(new, old, least=least)
        new = region(new, old, seg, draw, c, **where)
        if np.isfinite(new).all():
            out[c] = new
    return out, seg


def foreground(seg: np.ndarray) -> np.ndarray:
    """Voxels with a label: positive, or in any channel of a one-hot map (C, D, H, W)."""
    return (seg > 0).any(0) if seg.ndim == 4 else seg > 0


def minmax(v: np.ndarray) -> tuple[np.ndarray, tuple[float, float]]:
    """To [0, 1], and what brings it back."""
    low, high = float(v.min()), float(v.max())
    return (v - low) / max(high - low, 1e-6), (low, high)


def from_minmax(v: np.ndarray, ends: tuple[float, float]) -> np.ndarray:
    return v * (ends[1] - ends[0]) + ends[0]


def masked_zscore(v: np.ndarray, least: float = 1e-6) -> np.ndarray:
    """Z-score over the voxels that are not empty; the others stay."""
    on = np.abs(v) > least
    if not on.any():
        return v
    out = v.copy()
    out[on] = (v[on] - v[on].mean()) / max(v[on].std(), 1e-8)
    return out


def is_zscore(v: np.ndarray, slack: float = 1e-3) -> bool:
    """Whether values leave [0, 1]."""
    return bool(v.min() < -slack or v.max() > 1 + slack)


def unit(v: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    return (v - v.min()) / (v.max() - v.min() + eps)


@register("RandomGaussianNoiseGPU", "gaussian_noise", "GE")
@register("GaussianNoiseTransform", "gaussian_noise", "GE", exact=False)
def noise(img, seg, draw, mean=0.0, std=1.0, apply_to_channel=(0,), in_seg=0.0, out_seg=0.0, mix_in_out=False):
    s = draw.between("std", 0, std)
    return each(img, seg, draw, lambda v, c: v + draw.rng(f"noise.{c}").standard_normal(v.shape) * s + mean, apply_to_channel, in_seg=in_seg, out_seg=out_seg, mix_in_out=mix_in_out)


@register("RandomBrightnessGPU", "brightness", "GE")
def brightness(img, seg, draw, brightness_range=(0.5, 1.5), apply_to_channel=(0,), in_seg=0.0, out_seg=0.0, mix_in_out=False):
    f = draw.between("factor", *brightness_range)
    return each(img, seg, draw, lambda v, c: v * f, apply_to_channel, in_seg=in_seg, out_seg=out_seg, mix_in_out=mix_in_out)


def split_range(draw: Draw, slot: str, low: float, high: float) -> float:
    """Half of the draws from [low, 1], half from [max(low, 1), high]."""
    return draw.between(slot, low, 1) if draw.chance(f"{slot}.half", 0.5) and low < 1 else draw.between(slot, max(low, 1), high)


@register("MultiplicativeBrightnessTransform", "brightness", "GE", exact=False)
def brightness_split(img, seg, draw, multiplier_range=(0.75, 1.25), apply_to_channel=(0,)):
    f = split_range(draw, "factor", *multiplier_range)
    return each(img, seg, draw, lambda v, c: v * f, apply_to_channel)


def power(v, g):
    low, wide = v.min(), v.max() - v.min()
    return ((v - low) / (wide + 1e-8)) ** g * wide + low


@register("RandomGammaGPU", "gamma", "GE")
def gamma(img, seg, draw, gamma_range=(0.7, 1.5), retain_stats=False, apply_to_channel=(0,), in_seg=0.0, out_seg=0.0, mix_in_out=False):
    g = draw.between("gamma", *gamma_range)
    return each(img, seg, draw, lambda v, c: power(v, g), apply_to_channel, retain_stats, in_seg=in_seg, out_seg=out_seg, mix_in_out=mix_in_out)


@register("RandomInvGammaGPU", "inv_gamma", "GE")
def inverse_gamma(img, seg, draw, gamma_range=(0.7, 1.5), retain_stats=False, apply_to_channel=(0,), in_seg=0.0, out_seg=0.0, mix_in_out=False):
    g = draw.between("gamma", *gamma_range)
    return each(img, seg, draw, lambda v, c: -power(-v, g), apply_to_channel, retain_stats, in_seg=in_seg, out_seg=out_seg, mix_in_out=mix_in_out)


@register("GammaTransform", "gamma", "GE", exact=False)
def gamma_split(img, seg, draw, gamma=(0.7, 1.5), p_invert_image=0.0, p_retain_stats=1.0, apply_to_channel=(0,)):
    g, flip = split_range(draw, "gamma", *gamma), draw.chance("invert", p_invert_image)
    return each(img, seg, draw, lambda v, c: -power(-v, g) if flip else power(v, g), apply_to_channel, draw.chance("keep", p_retain_stats))


@register("InvertedGammaTransform", "inv_gamma", "GE")
def gamma_inverted(img, seg, draw, gamma=(0.7, 1.5), p_retain_stats=1.0, apply_to_channel=(0,)):
    return gamma_split(img, seg, draw, gamma, 1.0, p_retain_stats, apply_to_channel)


@register("RandomContrastGPU", "contrast", "GE")
def contrast(img, seg, draw, contrast_range=(0.75, 1.25), retain_stats=False, apply_to_channel=(0,), in_seg=0.0, out_seg=0.0, mix_in_out=False):
    f = draw.between("factor", *contrast_range)
    return each(img, seg, draw, lambda v, c: (v - v.mean()) * f + v.mean(), apply_to_channel, retain_stats, in_seg=in_seg, out_seg=out_seg, mix_in_out=mix_in_out)


@register("ContrastTransform", "contrast", "GE", exact=False)
def contrast_split(img, seg, draw, contrast_range=(0.75, 1.25), preserve_range=True, apply_to_channel=(0,)):
    f = split_range(draw, "factor", *contrast_range)
    keep = lambda w, v: np.clip(w, v.min(), v.max()) if preserve_range else w
    return each(img, seg, draw, lambda v, c: keep((v - v.mean()) * f + v.mean(), v), apply_to_channel)


FUNCTIONS = {"log1p": np.log1p, "sqrt": np.sqrt, "sin": np.sin, "exp": np.exp, "sigmoid": lambda x: 1 / (1 + np.exp(-x))}


def _function(name):
    def apply(img, seg, draw, retain_stats=False, mix_prob=0.0, apply_to_channel=(0,), in_seg=0.0, out_seg=0.0, mix_in_out=False):
        return each(img, seg, draw, lambda v, c: FUNCTIONS[name](unit(v)), apply_to_channel, retain_stats, mix_prob, in_seg=in_seg, out_seg=out_seg, mix_in_out=mix_in_out)

    def first(img, seg, draw, retain_stats=False):
        return each(img, seg, draw, lambda v, c: FUNCTIONS[name](unit(v)), (0,), retain_stats, least=1e-7)

    stem = name[0].upper() + name[1:]
    register(f"Random{stem}GPU", f"func_{name}", "TA")(apply)
    register(f"{stem}Transform", f"func_{name}", "TA")(first)


for _name in FUNCTIONS:
    _function(_name)


@register("RandomInverseGPU", "inverse", "TA")
def invert(img, seg, draw, retain_stats=False, mix_prob=0.0, apply_to_channel=(0,), in_seg=0.0, out_seg=0.0, mix_in_out=False):
    return each(img, seg, draw, lambda v, c: v.max() - v, apply_to_channel, retain_stats, mix_prob, in_seg=in_seg, out_seg=out_seg, mix_in_out=mix_in_out)


def equalise(v: np.ndarray, bins: int = 256) -> np.ndarray:
    """Spread values by their cumulative histogram; the smallest non-zero count is the origin."""
    low, high = v.min(), v.max()
    if high <= low:
        return v
    at = np.clip(((v - low) / ((high - low) / bins + 1e-10)).astype(np.int64), 0, bins - 1)
    cdf = np.cumsum(np.bincount(at.ravel(), minlength=bins)).astype(np.float64)
    base = cdf[cdf > 0].min()
    return np.clip((cdf[at] - base) / max(cdf[-1] - base, 1e-10), 0, 1) * (high - low) + low


@register("RandomHistogramEqualizationGPU", "histogram_equal", "TA")
def equalisation(img, seg, draw, retain_stats=False, mix_prob=0.0, apply_to_channel=(0,), in_seg=0.0, out_seg=0.0, mix_in_out=False):
    return each(img, seg, draw, lambda v, c: equalise(v), apply_to_channel, retain_stats, mix_prob, in_seg=in_seg, out_seg=out_seg, mix_in_out=mix_in_out)


@register("HistogramEqualTransform", "histogram_equal", "TA")
def equalisation_first(img, seg, draw, retain_stats=False):
    """Variant on bin edges: a value on an edge falls to the left, the plain minimum is the origin."""

    def f(v, c):
        low, high = v.min(), v.max()
        if high <= low:
            return v
        edges = np.linspace(low, high, 257)
        count = np.histogram(v, edges)[0]
        cdf = np.cumsum(count).astype(np.float64)
        cdf = (cdf - cdf.min()) / max(cdf.max() - cdf.min(), 1e-10)
        return cdf[np.searchsorted(edges[1:-1], v, side="left")] * (high - low) + low

    return each(img, seg, draw, f, (0,), retain_stats, least=1e-7)


def terms(order: int) -> list[tuple[int, int, int]]:
    return [(i, j, k) for i in range(order + 1) for j in range(order + 1 - i) for k in range(order + 1 - i - j)]


@register("RandomBiasFieldGPU", "bias_field", "GE")
def bias_field(img, seg, draw, coefficients=0.5, order=3, invert=False, retain_stats=False, mix_prob=0.0, apply_to_channel=(0,), in_seg=0.0, out_seg=0.0, mix_in_out=False):
    """Multiply by exp of a polynomial in x, y, z over [-1, 1]."""
    low, high = (-coefficients, coefficients) if np.isscalar(coefficients) else coefficients
    shape = img.shape[1:]
    axes = [2 * g / max(1, n - 1) - 1 for g, n in zip(coordinates(shape), shape, strict=True)]
    z, y, x = axes
    field = sum(draw.between(f"c{i}{j}{k}", low, high) * x**i * y**j * z**k for i, j, k in terms(order))
    field = np.exp(-field if invert else field)
    return each(img, seg, draw, lambda v, c: v * field, apply_to_channel, retain_stats, mix_prob, in_seg=in_seg, out_seg=out_seg, mix_in_out=mix_in_out)


@register("RandomClampGPU", "clamp", "GE")
def clamp(img, seg, draw, max_clamp_amount=0.0, retain_stats=False, mix_prob=0.0, apply_to_channel=(0,), in_seg=0.0, out_seg=0.0, mix_in_out=False):
    """Clip to two random quantiles, interpolated linearly."""
    a, b = draw.between("low", 0, max_clamp_amount), 1 - draw.between("high", 0, max_clamp_amount)
    return each(img, seg, draw, lambda v, c: np.clip(v, quantile(v, a), quantile(v, b)), apply_to_channel, retain_stats, mix_prob, in_seg=in_seg, out_seg=out_seg, mix_in_out=mix_in_out)


@register("ZscoreNormalizationGPU", "zscore", "GE")
def zscore(img, seg, draw, apply_to_channel=(0,), in_seg=0.0, out_seg=0.0):
    """Population deviation; a constant channel stays as it is."""
    return each(img, seg, draw, lambda v, c: v if v.max() == v.min() else (v - v.mean()) / max(v.std(), 1e-8), apply_to_channel, in_seg=in_seg, out_seg=out_seg)


@register("ZscoreNormalization", "zscore", "GE")
def zscore_sample(img, seg, draw):
    """Sample deviation, first channel, no guard for constant channels."""
    return each(img, seg, draw, lambda v, c: (v - v.mean()) / max(v.std(ddof=1) if v.size > 1 else 0.0, 1e-8))
