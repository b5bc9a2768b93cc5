"""Images with a place in space: orientation, resampling, slices, voxel types. Arrays are z, y, x; affines map x, y, z."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .kernels import coordinates, sample

OPPOSITE = {"L": "R", "R": "L", "A": "P", "P": "A", "I": "S", "S": "I"}
INTEGERS = ("uint8", "uint16", "uint32", "uint64", "int8", "int16", "int32", "int64")


@dataclass
class Image:
    data: np.ndarray
    affine: np.ndarray = field(default_factory=lambda: np.eye(4))

    @classmethod
    def blank(cls, shape: tuple[int, ...], dtype="float32", affine=None) -> Image:
        return cls(np.zeros(shape, dtype), np.eye(4) if affine is None else np.asarray(affine, float).reshape(4, 4))

    @classmethod
    def of(cls, what) -> Image:
        """From a shape given as a list (blank), an array, or another image (copied)."""
        if isinstance(what, Image):
            return cls(what.data.copy(), what.affine.copy())
        return cls.blank(tuple(what)) if isinstance(what, list) else cls(np.array(what))

    @property
    def orientation(self) -> str:
        return orientation(self.affine)

    @property
    def spacing(self) -> np.ndarray:
        return np.sqrt((self.affine[:3, :3] ** 2).sum(0))

    def zeros(self, dtype=None) -> Image:
        return Image(np.zeros_like(self.data, dtype), self.affine.copy())


def orientation(affine: np.ndarray) -> str:
    """For each voxel axis x, y, z the side of the body it comes from; the identity is LPI."""
    m, free, out = affine[:3, :3] / np.maximum(np.sqrt((affine[:3, :3] ** 2).sum(0)), 1e-12), {0, 1, 2}, [""] * 3
    for axis in np.argsort(-np.abs(m).max(0), kind="stable"):  # the clearest axis chooses first
        world = max(sorted(free), key=lambda w: abs(m[w, axis]))
        free.discard(world)
        out[axis] = ("LPI" if m[world, axis] > 0 else "RAS")[world]
    return "".join(out)


def moves(source: str, target: str) -> list[tuple[int, bool]]:
    """For each axis of the target: which source axis it is, and whether that is turned round."""
    for s in (source, target):
        if sorted(min(c, OPPOSITE.get(c, "")) for c in s) != ["A", "I", "L"]:
            raise ValueError(f"{s!r} is no orientation")
    return [(source.index(c), False) if c in source else (source.index(OPPOSITE[c]), True) for c in target]


def reorient(image: Image, target: str) -> Image:
    """The same voxels in another order of axes and directions; the affine follows."""
    how, old = moves(image.orientation, target), image.data.shape[-3:][::-1]
    lead = image.data.ndim - 3
    v = image.data.transpose(*range(lead), *(lead + 2 - how[2 - k][0] for k in range(3)))
    v = np.flip(v, [lead + 2 - k for k, (_, turned) in enumerate(how) if turned])
    step = np.zeros((4, 4))
    step[3, 3] = 1
    for k, (axis, turned) in enumerate(how):
        step[axis, k] = -1 if turned else 1
        step[axis, 3] = old[axis] - 1 if turned else 0
    return Image(np.ascontiguousarray(v), image.affine @ step)


def places(shape: tuple[int, int, int], source: str, target: str) -> list[int]:
    """For each flat position after reorienting a z, y, x shape, the position before."""
    flat = np.arange(int(np.prod(shape))).reshape(shape)
    start = np.zeros((4, 4))
    start[3, 3] = 1
    for axis, c in enumerate(source):
        world = next(w for w, s in enumerate(("LR", "PA", "IS")) if c in s)
        start[world, axis] = 1 if c in "LPI" else -1
    return reorient(Image(flat, start), target).data.ravel().tolist()


def new_shape(image: Image, size, kind: str) -> tuple[int, ...]:
    """Sizes in x, y, z from voxels, factors or millimetres; one number stands for all three."""
    size, old = (list(size) * 3 if len(size) == 1 and kind != "vox" else list(size))[:3], image.data.shape[-3:][::-1]
    if kind == "vox":
        out = [int(n) for n in size]
    elif kind == "factor":
        out = [int(np.round(n * f)) for n, f in zip(old, size, strict=True)]
    elif kind == "mm":
        out = [int(np.round(n * p / f)) for n, p, f in zip(old, image.spacing, size, strict=True)]
    else:
        raise ValueError("size is given in vox, factor or mm")
    if min(out) < 1:
        raise ValueError(f"an axis would have no voxel: {out}")
    return tuple(out)


def resample(image: Image, size=None, kind: str = "vox", like: Image | None = None, interpolation: str = "linear", outside: str = "border") -> Image:
    """On another grid: a new size over the same field of view, or the grid of another image; the last three axes are resampled.

    Voxel i of the new grid lies at i * old size / new size of the old one. Interpolation is nn or linear; beyond the image is the
    nearest voxel (border) or 0 (zero).
    """
    if interpolation not in ("nn", "linear"):
        raise ValueError("interpolation is nn or linear")
    if like is None:
        shape = new_shape(image, size, kind)
        scale = np.diag([*(n / m for n, m in zip(image.data.shape[-3:][::-1], shape, strict=True)), 1.0])
        affine = image.affine @ scale
    else:
        shape, affine = like.data.shape[-3:][::-1], like.affine
        scale = np.linalg.inv(image.affine) @ affine
    grid = coordinates(tuple(shape[::-1]))[::-1]  # x, y, z
    at = (np.einsum("ij,jdhw->idhw", scale[:3, :3], grid) + scale[:3, 3].reshape(3, 1, 1, 1))[::-1]
    if interpolation == "nn":
        at = np.floor(at + 0.5)
    one = lambda v: sample(v, at, nearest=interpolation == "nn", outside=outside)
    v = image.data.astype(np.float64) if interpolation == "linear" else image.data
    flat = v.reshape(-1, *v.shape[-3:])
    out = np.stack([one(x) for x in flat]).reshape(*v.shape[:-3], *shape[::-1])
    return Image(out.astype(image.data.dtype) if interpolation == "nn" else out, affine)


def slices(image: Image, axis: str = "IS") -> list[np.ndarray]:
    """Planes across an anatomical axis, from its first letter to its second."""
    if len(axis) != 2 or OPPOSITE.get(axis[0]) != axis[1]:
        raise ValueError(f"{axis!r} is no axis")
    name = image.orientation
    k = next(i for i, c in enumerate(name) if c in axis)
    planes = np.moveaxis(image.data, image.data.ndim - 1 - k, 0)
    return list(planes if name[k] == axis[0] else planes[::-1])


def least_type(low: float, high: float, whole: bool) -> str:
    """The smallest voxel type for a range of values."""
    if not whole:
        return "float32" if max(abs(low), abs(high)) <= float(np.finfo(np.float32).max) else "float64"
    for name in INTEGERS[:4] if low >= 0 else INTEGERS[4:]:
        if np.iinfo(name).min <= low and high <= np.iinfo(name).max:
            return name
    raise ValueError("the values do not fit into an integer type")


def change_type(image: Image, dtype: str | None, rescale: bool = False) -> Image:
    """Cast voxels; `minimize` chooses the smallest type, `minimize_int` the smallest integer type. rescale spreads values that do not fit over the type's range."""
    if dtype is None:
        return Image.of(image)
    v = image.data
    low, high = float(np.nanmin(v)), float(np.nanmax(v))
    if dtype in ("minimize", "minimize_int"):
        dtype = least_type(low, high, dtype == "minimize_int" or bool((v == np.trunc(v)).all()))
    kind = np.dtype(dtype)
    if kind.kind in "iu":
        ends = np.iinfo(kind)
        if (low < ends.min or high > ends.max) and rescale:
            v = (v.astype(np.float64) - low) * ((ends.max - ends.min) / max(high - low, 1e-300)) + ends.min
        v = np.clip(np.round(v) if v.dtype.kind == "f" else v, ends.min, ends.max)
    return Image(v.astype(kind), image.affine.copy())


def montage(v: np.ndarray, low: float = 0.0, high: float = 100.0) -> list[np.ndarray]:
    """The three middle planes as bytes, scaled between two percentiles."""
    a, b = np.percentile(v, low), np.percentile(v, high)
    grey = (np.clip((v - a) / max(b - a, 1e-12), 0, 1) * 255).astype(np.uint8)
    return [np.take(grey, n // 2, axis) for axis, n in enumerate(v.shape)]
