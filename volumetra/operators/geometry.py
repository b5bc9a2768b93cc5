"""Geometric operators: image and labels move with the same draw."""

from __future__ import annotations

import numpy as np

from ..kernels import affine, coordinates, integrate, resize, sample
from ..registry import register


def warp(img, seg, at, outside="zero"):
    """Trilinear image and nearest labels at (3, D, H, W) positions."""
    out = np.stack([sample(v.astype(np.float64), at, outside=outside) for v in img]).astype(img.dtype)
    return out, None if seg is None else sample(seg, at, nearest=True, outside=outside).astype(seg.dtype)


def about_centre(matrix, shape):
    mid = (np.array(shape) - 1).reshape(3, 1, 1, 1) / 2
    return np.einsum("ij,jdhw->idhw", matrix[:3, :3], coordinates(shape) - mid) + mid + matrix[:3, 3].reshape(3, 1, 1, 1)


@register("RandomFlipTransformGPU", "flip", "GEO")
@register("MirrorTransform", "mirror", "GEO", exact=False)
def flip(img, seg, draw, flip_axis=(0,)):
    """Each allowed axis (0 to 2: z, y, x) flips with probability one half; if none does, one of them must."""
    axes = [a for a in flip_axis if draw.chance(f"axis.{a}", 0.5)] or ([draw.pick("forced", list(flip_axis))] if len(flip_axis) else [])
    return np.flip(img, [a + 1 for a in axes]).copy(), None if seg is None else np.flip(seg, axes).copy()


@register("RandomAffineGPU", "affine", "GEO", defaults={"p": 0.5})
def random_affine(img, seg, draw, degrees=10, translate=(0.1, 0.1, 0.1), scale=(0.9, 1.1), shears=(-10, 10, -10, 10, -10, 10), resample="bilinear"):
    """Rotation, translation as a fraction of the size, scale and six shears about the centre; labels are nearest."""
    low, high = (-degrees, degrees) if np.isscalar(degrees) else degrees
    translate = (translate,) * 3 if np.isscalar(translate) else tuple(translate)
    angles = [draw.between(f"angle.{a}", low, high) for a in "zyx"]
    scales = [draw.between(f"scale.{a}", *scale) for a in "zyx"]
    skew = [np.tan(np.deg2rad(draw.between(f"shear.{i}", shears[2 * (i // 2)], shears[2 * (i // 2) + 1]))) for i in range(6)]
    shift = [draw.between(f"shift.{a}", -t, t) * n for a, t, n in zip("zyx", reversed(translate), img.shape[1:], strict=True)]
    return warp(img, seg, about_centre(np.linalg.inv(affine(scales, angles, skew, shift)), img.shape[1:]))


def box_of(draw, shape, crop, pos):
    """Kept box per axis; draws come in the order x, y, z. round() is half to even."""
    out = [None] * 3
    for name, axis in zip("xyz", (2, 1, 0), strict=True):
        n = shape[axis]
        size = max(1, round(draw.between(f"crop.{name}", *crop) * n))
        start = round(draw.between(f"pos.{name}", *pos) * (n - size))
        out[axis] = slice(start, start + size)
    return tuple(out)


@register("RandomCropTransformGPU", "crop", "GEO")
def crop_in_place(img, seg, draw, crop=(1, 1), pos=(0, 1), pad_value="min"):
    """Keep a random box where it is; fill the rest with the minimum over all channels, labels with 0."""
    keep = np.zeros(img.shape[1:], bool)
    keep[box_of(draw, img.shape[1:], crop, pos)] = True
    fill = img.min() if pad_value == "min" else pad_value
    return np.where(keep, img, fill).astype(img.dtype), None if seg is None else np.where(keep, seg, 0).astype(seg.dtype)


def degrade(v, factors):
    """Down and up, both trilinear with aligned sample centres; sizes round half to even."""
    small = tuple(max(1, round(n * f)) for n, f in zip(v.shape, factors, strict=True))
    return resize(resize(v, small), v.shape)


def acquire(v, factors):
    """What a scanner of that resolution would see: the nearest samples, then trilinear between aligned corners."""
    small = tuple(max(1, round(n * f)) for n, f in zip(v.shape, factors, strict=True))
    return resize(resize(v, small, nearest=True), v.shape, corners=True)


@register("RandomLowResTransformGPU", "low_res", "GE", sequential=True)
@register("SimulateLowResolutionTransform", "low_res", "GE", exact=False)
def low_resolution(img, seg, draw, scale=(0.3, 1)):
    """Down and up again, each axis by its own factor; labels stay."""
    f = [draw.between(f"scale.{a}", *scale) for a in "xyz"][::-1]
    return np.stack([degrade(v, f) for v in img]).astype(img.dtype), seg


@register("RandomAcqTransformGPU", "acq", "GE")
def acquisition(img, seg, draw, scale=(0.3, 1), one_dim=True, apply_to_channel=(0,)):
    """The same along one random axis, for chosen channels."""
    axis, f, out = draw.pick("axis", (0, 1, 2)), draw.between("scale", *scale), img.copy()
    for c in apply_to_channel:
        out[c] = degrade(img[c], [f if a == axis else 1 for a in range(3)])
    return out, seg


@register("ShapeTransform", "shape", "GEO")
def reshape(img, seg, draw, shape_min=1, ignore_axes=()):
    """A centred crop to a random size of at least shape_min per axis; the shape changes."""
    cuts = []
    for a, n in enumerate(img.shape[1:]):
        m = n if a in ignore_axes else int(draw.between(f"size.{a}", min(shape_min, n), n + 1 - 1e-9))
        cuts.append(slice((n - m) // 2, (n - m) // 2 + m))
    return img[(slice(None), *cuts)].copy(), None if seg is None else seg[tuple(cuts)].copy()


def elastic(img, seg, draw, strength, scale):
    rng, shape = draw.rng("elastic"), img.shape[1:]
    coarse = tuple(max(2, round(n * scale)) for n in shape)
    field = np.stack([resize(rng.normal(0, strength, coarse), shape, corners=True) for _ in range(3)])
    return warp(img, seg, coordinates(shape) + integrate(field), "border")


@register("SpatialTransform", "spatial", "GEO", exact=False)
def spatial(img, seg, draw, patch_center_dist_from_border=0, random_crop=False, p_elastic_deform=0.0, p_rotation=0.2, rotation=(-30.0, 30.0), p_scaling=0.2, scaling=(0.7, 1.4), p_synchronize_scaling_across_axes=1.0, bg_style_seg_sampling=False):
    angles = [draw.between(f"angle.{a}", *rotation) if draw.chance("rotate", p_rotation) else 0.0 for a in "zyx"]
    same = draw.chance("synchronous", p_synchronize_scaling_across_axes)
    scales = [draw.between("scale" if same else f"scale.{a}", *scaling) if draw.chance("rescale", p_scaling) else 1.0 for a in "zyx"]
    img, seg = warp(img, seg, about_centre(np.linalg.inv(affine(scales, angles, [0] * 6, [0] * 3)), img.shape[1:]))
    return elastic(img, seg, draw, 2.0, 0.2) if draw.chance("elastic", p_elastic_deform) else (img, seg)


@register("SpatialCustomTransform", "spatial_custom", "GEO", exact=False)
def spatial_custom(img, seg, draw, flip=False, affine=False, elastic=False, anisotropy=False, random_pick=False):
    """All enabled changes in order, or one of them at random."""
    steps = {
        "flip": lambda i, s: (np.flip(i, 3).copy(), None if s is None else np.flip(s, 2).copy()),
        "affine": lambda i, s: random_affine(i, s, draw, 10, (0.1,) * 3),
        "elastic": lambda i, s: globals()["elastic"](i, s, draw, 4.0, 0.2),
        "anisotropy": lambda i, s: acquisition(i, s, draw, (1 / 7, 1), True, tuple(range(len(i)))),
    }
    on = [k for k, v in zip(steps, (flip, affine, elastic, anisotropy), strict=True) if v]
    for k in [draw.pick("one", on)] if random_pick and on else on:
        img, seg = steps[k](img, seg)
    return img, seg
