"""Compile a configuration into one Spark stage over a table of volumes.

volumes: sample_id, batch_id, shape struct<c,d,h,w>, img array<float> (row-major), seg array<int> or null.
Operators are folded inside a single mapInArrow: a row is read once, all operators run on it, and it is written once.
There is no shuffle, and results do not depend on partitioning, because every draw is a hash of seed, operator and key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .. import registry
from ..config import Config
from ..draws import Draw

SCHEMA = "sample_id long, batch_id long, shape struct<c:int,d:int,h:int,w:int>, img array<float>, seg array<int>"
TRACE = "array<struct<op:string,target:string,changed:boolean,params:string>>"


BATCH = 8 << 20  # bytes of images sent back together
STEP = pa.struct([("op", pa.string()), ("target", pa.string()), ("changed", pa.bool_()), ("params", pa.string())])


def _lists(arrays: list, kind: pa.DataType) -> pa.Array:
    """A list column from numpy arrays, null for None, without a Python object per element."""
    offsets = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in arrays])])
    values = [x for x in arrays if x is not None and len(x)]
    flat = pa.array(np.concatenate(values) if values else np.empty(0), kind)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat, mask=pa.array([x is None for x in arrays]))


def batch(rows: list[tuple]) -> pa.RecordBatch:
    sid, bid, shape, img, seg, trace = zip(*rows, strict=True)
    cols = [pa.array(sid, pa.int64()), pa.array(bid, pa.int64()), pa.array(shape, pa.struct([(k, pa.int32()) for k in "cdhw"])), _lists(img, pa.float32()), _lists(seg, pa.int32()), pa.array(trace, pa.list_(STEP))]
    return pa.RecordBatch.from_arrays(cols, ["sample_id", "batch_id", "shape", "img", "seg", "trace"])


class Pipeline:
    def __init__(self, config: Config | dict, backend: str = "GPU", seed: int = 0, context: dict | None = None):
        self.context = context or {}
        self.config = config if isinstance(config, Config) else Config(config)
        self.backend, self.seed = backend, seed
        section = self.config.section(backend)
        names = list(section)
        if self.config.pipeline.get("order", "registry") == "registry":
            names.sort(key=registry.PIPELINE_ORDER[backend].index)
        # rewrite before planning: an operator that never fires costs nothing
        self.steps = [(n, registry.get(n, backend).defaults() | section[n]) for n in names if section[n].get("p", 1.0) > 0]
        self.mode = self.config.pipeline.get("mode", "sequential")

    @classmethod
    def from_json(cls, path: str, backend: str = "GPU", seed: int = 0) -> Pipeline:
        return cls(Config.load(path), backend, seed)

    def order(self, key) -> list[tuple[str, dict]]:
        """Steps for one key: geometry leads in the random modes, then the buckets, shuffled unless the mode keeps TA in order.

        Operators that must not be shuffled run with the geometry where the enhancement bucket is shuffled, and keep their place elsewhere.
        """
        if self.mode == "sequential":
            return self.steps
        kind = lambda s: "GEO" if self.mode != "random_order_ta" and registry.get(s[0]).sequential else registry.get(s[0]).group
        by = {g: [s for s in self.steps if kind(s) == g] for g in registry.GROUPS}
        if self.mode == "random_order_ta":
            return by["GEO"] + [s for s in self.steps if registry.get(s[0]).group != "GEO"]
        out, most = by["GEO"], self.config.pipeline.get("random_choose") or {}
        for g in ("TA", "GE"):
            draw = Draw(self.seed, f"bucket.{g}", key)
            mixed = [s for _, s in sorted(((draw.u(n), (n, p)) for n, p in by[g]), key=lambda x: x[0])]
            out = out + mixed[: most.get(g, len(mixed)) if isinstance(most, dict) else int(most)]
        return out

    def one(self, sample_id, batch_id, img: np.ndarray, seg: np.ndarray | None):
        """Apply to one sample; returns image, labels and the trace of what fired."""
        shared, trace = self.config.same_on_batch, []
        for name, params in self.order(batch_id if shared else sample_id):
            entry = registry.get(name)
            key = batch_id if shared or params.get("same_on_batch") else sample_id
            draw = Draw(self.seed, name, key)
            if not Draw(self.seed, name, batch_id).chance("p_batch", params.get("p_batch", 1.0)) or not draw.chance("p", params.get("p", 1.0)):
                continue
            new, labels = entry.apply(img, seg, draw, **entry.arguments(params, self.context))
            target = "image" if labels is seg else "image+labels"
            trace.append({"op": name, "target": target, "changed": new.shape != img.shape or not np.array_equal(new, img), "params": json.dumps({k: v for k, v in list(draw.log.items())[:8]}, default=float)})
            img, seg = new, labels
        return img, seg, trace

    def apply(self, df: DataFrame) -> DataFrame:
        """Rows of `volumes` after all operators, with the trace; other columns are dropped. Null images stay null."""
        from ..functions import ship

        ship(df.sparkSession)
        me = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for b in batches:
                for i in range(b.num_rows):
                    sid, bid, shape = (b.column(k)[i].as_py() for k in range(3))
                    img, seg, trace = b.column(3)[i], b.column(4)[i], []
                    if img.is_valid:
                        dims = (shape["c"], shape["d"], shape["h"], shape["w"])
                        v = img.values.to_numpy(zero_copy_only=False).astype(np.float32).reshape(dims)
                        s = seg.values.to_numpy(zero_copy_only=False).reshape(dims[1:]) if seg.is_valid else None
                        v, s, trace = me.one(sid, bid, v, s)
                        shape = dict(zip("cdhw", map(int, v.shape), strict=True))
                        img, seg = np.ascontiguousarray(v, np.float32).ravel(), None if s is None else np.ascontiguousarray(s, np.int32).ravel()
                    else:
                        img, seg = None, None if not seg.is_valid else seg.values.to_numpy(zero_copy_only=False)
                    held.append((sid, bid, shape, img, seg, trace))
                    size += 1_000 + (0 if img is None else img.nbytes)
                    if size > BATCH:
                        yield batch(held)
                        held, size = [], 0
            if held:
                yield batch(held)

        return df.select("sample_id", "batch_id", "shape", "img", "seg").mapInArrow(run, f"{SCHEMA}, trace {TRACE}")


def repeated(df: DataFrame, times: int) -> DataFrame:
    """`times` rows per sample, each a batch and sample of its own, for offline generation; the draw index is bounded, so this is an explode."""
    from pyspark.sql import functions as F

    out = df.withColumn("_n", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return out.withColumns({"batch_id": F.col("batch_id") * times + F.col("_n"), "sample_id": F.col("sample_id") * times + F.col("_n")}).drop("_n")
