"""Which operators there are, in which order they run, and what they accept."""

from __future__ import annotations

import contextlib
import difflib
import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

BACKENDS = ("GPU", "CPU")  # two variants that differ numerically; both run on Spark
GROUPS = ("GEO", "GE", "TA")

# fixed values: operator names in the order a pipeline applies them
PIPELINE_ORDER = {
    "GPU": (
        "RandomFlipTransformGPU", "RandomAffineGPU", "RandomSynthSegGPU", "RandomPaletteGPU", "PaletteSynthesisGPU", "RandomDomainTransferGPU",
        "RandomInverseGPU", "RandomHistogramEqualizationGPU", "RandomRedistributeSegGPU", "RandomScharrGPU", "RandomLaplaceGPU", "RandomUnsharpMaskGPU",
        "RandomRandConvGPU", "RandomClampGPU", "RandomGaussianNoiseGPU", "RandomGaussianBlurGPU", "RandomBrightnessGPU", "RandomGammaGPU",
        "RandomInvGammaGPU", "RandomContrastGPU", "RandomLog1pGPU", "RandomSqrtGPU", "RandomSinGPU", "RandomExpGPU", "RandomSigmoidGPU",
        "RandomLowResTransformGPU", "RandomAcqTransformGPU", "RandomCropTransformGPU", "RandomBiasFieldGPU", "ZscoreNormalizationGPU",
    ),
    "CPU": (
        "LaplaceConvTransform", "ScharrConvTransform", "Log1pTransform", "SqrtTransform", "SinTransform", "ExpTransform", "SigmoidTransform",
        "HistogramEqualTransform", "RedistributeTransform", "ShapeTransform", "ArtifactTransform", "SpatialCustomTransform", "SpatialTransform",
        "GaussianNoiseTransform", "GaussianBlurTransform", "MultiplicativeBrightnessTransform", "ContrastTransform", "SimulateLowResolutionTransform",
        "InvertedGammaTransform", "GammaTransform", "MirrorTransform", "ZscoreNormalization",
    ),
}
# fixed values: parameters that every operator of a backend takes
COMMON = {"GPU": {"p": 1.0, "p_batch": 1.0, "same_on_batch": False, "keepdim": True}, "CPU": {"p": 1.0}}


class UnknownOperator(KeyError):
    """No operator of that name."""


class InvalidConfig(ValueError):
    """A configuration with problems; all of them are listed."""

    def __init__(self, source: str, problems: list[str]):
        self.problems = problems
        super().__init__(f"{source}: {len(problems)} problem(s)\n" + "\n".join(f"- {p}" for p in problems))


@dataclass(frozen=True)
class Entry:
    name: str
    apply: Callable
    backend: str
    concept: str
    group: str
    exact: bool = True  # False: an external algorithm, re-expressed from its description
    params: dict = field(default_factory=dict)
    required: frozenset = frozenset()
    context: frozenset = frozenset()  # parameters that the pipeline fills in, not the configuration
    adapters: dict = field(default_factory=dict)  # parameter -> function of its configured value
    sequential: bool = False  # never shuffled into the enhancement bucket: runs with the geometry where there is one

    def accepted(self) -> set[str]:
        return (set(self.params) | set(COMMON[self.backend]) | set(self.required)) - self.context

    def problem(self, name: str) -> str | None:
        """What is wrong with a parameter of that name, with near names."""
        if name in self.accepted():
            return None
        if name in self.context:
            return f"{self.name}: {name} is filled in by the pipeline"
        near = difflib.get_close_matches(name, sorted(self.accepted()), 3, 0.5)
        return f"{self.name}: unknown parameter {name!r}" + (f"; did you mean {', '.join(near)}?" if near else "")

    def arguments(self, params: dict, context: dict | None = None) -> dict:
        """Arguments of apply() from configured parameters and the pipeline's context."""
        out = {k: self.adapters.get(k, lambda x: x)(v) for k, v in params.items() if not k.startswith("_") and k not in COMMON[self.backend]}
        missing = self.context - set(context or {})
        if missing:
            raise ValueError(f"{self.name} needs {', '.join(sorted(missing))} from the pipeline")
        return out | {k: context[k] for k in self.context}

    def defaults(self) -> dict:
        return COMMON[self.backend] | self.params


_entries: dict[str, Entry] = {}


def register(name: str, concept: str, group: str, *, defaults: dict | None = None, exact: bool = True, context: tuple = (), adapters: dict | None = None, sequential: bool = False):
    """Register apply(img, seg, draw, **params) -> (img, seg). img is (C, D, H, W), seg (D, H, W) or None.

    Parameters are read from the signature; `defaults` overrides them, so one function serves several names.
    """
    backend = next((b for b in BACKENDS if name in PIPELINE_ORDER[b]), None)
    if backend is None:
        raise UnknownOperator(f"{name} has no place in the order; see extend_order")

    def add(f: Callable) -> Callable:
        if name in _entries:
            raise ValueError(f"{name} is registered already")
        if group not in GROUPS:
            raise ValueError(f"unknown group {group}")
        found = list(inspect.signature(f).parameters.values())[3:]
        params = {q.name: q.default for q in found if q.default is not q.empty and not q.name.startswith("_")}
        needed = frozenset(q.name for q in found if q.default is q.empty)
        _entries[name] = Entry(name, f, backend, concept, group, exact, params | (defaults or {}), needed - set(context), frozenset(context), dict(adapters or {}), sequential)
        return f

    return add


def extend_order(name: str, backend: str = "GPU", before: str | None = None) -> None:
    """Give an operator of your own a place, so that it can be registered."""
    order = list(PIPELINE_ORDER[backend])
    if name not in order:
        order.insert(order.index(before) if before else len(order), name)
        PIPELINE_ORDER[backend] = tuple(order)


def register_entry(name: str, apply: Callable, concept: str, group: str, *, backend: str = "GPU", before: str | None = None, **how) -> Entry:
    """Register a function of another library under a name of its own, and give it a place in the order."""
    extend_order(name, backend, before)
    register(name, concept, group, exact=how.pop("exact", False), **how)(apply)
    return _entries[name]


def names(backend: str | None = None) -> list[str]:
    """Registered names, in pipeline order."""
    return [e.name for e in entries(backend)]


def _load() -> None:
    from .operators import clusters, generative, geometry, intensity, stencils  # noqa: F401


def get(name: str, backend: str | None = None) -> Entry:
    _load()
    e = _entries.get(name)
    if e is None or (backend and e.backend != backend):
        known = [n for n, x in _entries.items() if not backend or x.backend == backend]
        near = difflib.get_close_matches(name, known, 3, 0.5)
        raise UnknownOperator(f"unknown {backend or ''} operator {name!r}" + (f"; did you mean {', '.join(near)}?" if near else ""))
    return e


def entries(backend: str | None = None, group: str | None = None, concept: str | None = None) -> list[Entry]:
    """Matching entries, in pipeline order."""
    _load()
    return [_entries[n] for b in BACKENDS for n in PIPELINE_ORDER[b] if n in _entries and (not backend or b == backend) and (not group or _entries[n].group == group) and (not concept or _entries[n].concept == concept)]


def as_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e.name, e.backend, e.concept, e.group, e.exact) for e in entries()], "name string, backend string, concept string, grp string, exact boolean")


def matrix(spark: SparkSession) -> DataFrame:
    """One row per concept, one column per backend."""
    from pyspark.sql import functions as F

    return as_table(spark).groupBy("concept").pivot("backend", list(BACKENDS)).agg(F.min("name"))


def template(backend: str) -> dict:
    """A configuration with every operator at its defaults."""
    return {backend: {e.name: e.defaults() for e in entries(backend)}}


@contextlib.contextmanager
def isolated():
    """Undo registrations made inside, for tests."""
    kept, order = dict(_entries), dict(PIPELINE_ORDER)
    try:
        yield
    finally:
        _entries.clear()
        _entries.update(kept)
        PIPELINE_ORDER.clear()
        PIPELINE_ORDER.update(order)
