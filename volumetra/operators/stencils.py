"""Convolutions."""

from __future__ import annotations

import numpy as np

from ..kernels import blur, correlate, laplacian, scharr
from ..registry import register
from .intensity import each


def _edges(v, absolute, mode):
    return sum(np.abs(s) if absolute else s for s in scharr(v, mode))


@register("RandomLaplaceGPU", "laplace", "TA")
def laplace(img, seg, draw, absolute=True, retain_stats=True, mix_prob=0.0, apply_to_channel=(0,), in_seg=0.0, out_seg=0.0, mix_in_out=False):
    """26-neighbour Laplacian with reflected borders. absolute is accepted and not read, as users' files have it."""
    return each(img, seg, draw, lambda v, c: laplacian(v), apply_to_channel, retain_stats, mix_prob, in_seg=in_seg, out_seg=out_seg, mix_in_out=mix_in_out)


@register("LaplaceConvTransform", "laplace", "TA")
def laplace_zero(img, seg, draw, absolute=False, retain_stats=False):
    return each(img, seg, draw, lambda v, c: np.abs(laplacian(v, "zero")) if absolute else laplacian(v, "zero"), (0,), retain_stats, least=1e-7)


@register("RandomScharrGPU", "scharr", "TA")
def scharr_reflect(img, seg, draw, absolute=True, retain_stats=True, mix_prob=0.0, apply_to_channel=(0,), in_seg=0.0, out_seg=0.0, mix_in_out=False):
    return each(img, seg, draw, lambda v, c: _edges(v, absolute, "reflect"), apply_to_channel, retain_stats, mix_prob, in_seg=in_seg, out_seg=out_seg, mix_in_out=mix_in_out)


@register("ScharrConvTransform", "scharr", "TA")
def scharr_zero(img, seg, draw, absolute=True, retain_stats=False):
    return each(img, seg, draw, lambda v, c: _edges(v, absolute, "zero"), (0,), retain_stats, least=1e-7)


def _sigmas(draw, sigma):
    return tuple(draw.between(f"sigma.{a}", 0, sigma) for a in "zyx")


@register("RandomGaussianBlurGPU", "gaussian_blur", "GE")
@register("GaussianBlurTransform", "gaussian_blur", "GE", exact=False)
def gaussian_blur(img, seg, draw, sigma=1.0, retain_stats=False, mix_prob=0.0, apply_to_channel=(0,), in_seg=0.0, out_seg=0.0, mix_in_out=False):
    """Three taps per axis; each axis has a sigma of its own."""
    s = _sigmas(draw, sigma)
    return each(img, seg, draw, lambda v, c: blur(v, s, 1), apply_to_channel, retain_stats, mix_prob, in_seg=in_seg, out_seg=out_seg, mix_in_out=mix_in_out)


@register("RandomUnsharpMaskGPU", "unsharp_mask", "TA")
def unsharp(img, seg, draw, sigma=1.0, unsharp_amount=1.5, retain_stats=False, mix_prob=0.0, apply_to_channel=(0,), in_seg=0.0, out_seg=0.0, mix_in_out=False):
    s, a = _sigmas(draw, sigma), draw.between("amount", 0, unsharp_amount)
    return each(img, seg, draw, lambda v, c: v + a * (v - blur(v, s, 1)), apply_to_channel, retain_stats, mix_prob, in_seg=in_seg, out_seg=out_seg, mix_in_out=mix_in_out)


@register("RandomRandConvGPU", "rand_conv", "TA")
def random_convolution(img, seg, draw, kernel_sizes=(1, 3, 5, 7), retain_stats=True, mix_prob=0.0, apply_to_channel=(0,), in_seg=0.0, out_seg=0.0, mix_in_out=False):
    """A dense kernel of random size with weights N(0, 1 / k^3), so unit variance stays."""
    k = draw.pick("size", kernel_sizes)
    kernel = draw.rng("kernel").standard_normal((k, k, k)) / np.sqrt(k**3)
    return each(img, seg, draw, lambda v, c: correlate(v, kernel), apply_to_channel, retain_stats, mix_prob, in_seg=in_seg, out_seg=out_seg, mix_in_out=mix_in_out)
