"""Whole images from label maps, driven by a configuration of their own."""

from __future__ import annotations

import inspect
import json

from pyspark.sql import DataFrame

from ..draws import Draw
from ..operators.generative import generate
from .pipeline import Pipeline

NAME = "SynthSegTransformsGPU"


class SynthSegTransforms(Pipeline):
    """Replace image and labels of a sample by a synthetic pair, with some probability per sample.

    config: parameters of generate(), flat or under "SynthSeg", with probability (1.0) and return_onehot (false). The real image is read only
    where em is on; otherwise its number of channels counts. Samples without labels stay.
    """

    def __init__(self, config: dict | str, seed: int = 0):
        if isinstance(config, str):
            with open(config, encoding="utf-8") as f:
                config = json.load(f)
        config = dict(config.get("SynthSeg", config))
        self.probability, self.onehot, self.seed = float(config.pop("probability", 1.0)), bool(config.pop("return_onehot", False)), seed
        known = set(list(inspect.signature(generate).parameters)[3:])
        unknown = sorted(k for k in config if k not in known and not k.startswith("_"))
        if unknown:
            raise ValueError(f"unknown parameters: {', '.join(unknown)}")
        self.params = {k: v for k, v in config.items() if k in known}

    def one(self, sample_id, batch_id, img, seg):
        draw = Draw(self.seed, NAME, sample_id)
        if seg is None or not draw.chance("p", self.probability):
            return img, seg, []
        new, labels = generate(img, seg, draw, **self.params)
        trace = [{"op": NAME, "target": "image+labels", "changed": True, "params": json.dumps({k: v for k, v in list(draw.log.items())[:8]}, default=float)}]
        return new.astype(img.dtype), labels, trace

    def apply(self, df: DataFrame) -> DataFrame:
        """Rows of `volumes`; with return_onehot also onehot, an array of one array per label up to the greatest in the row."""
        from pyspark.sql import functions as F

        out = super().apply(df)
        if not self.onehot:
            return out
        count = F.greatest(F.coalesce(F.array_max("seg"), F.lit(0)), F.lit(0))
        masks = F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda k: F.transform("seg", lambda x: (x == k).cast("int")))).otherwise(F.array().cast("array<array<int>>"))
        return out.withColumn("onehot", F.when(F.col("seg").isNotNull(), masks))
