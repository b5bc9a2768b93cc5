"""Reproducible random draws: hashes of (seed, operator, slot, key), whatever the partitioning."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = 4294967296.0


def uniform(seed: int, op: str, slot: str, key: Column) -> Column:
    """Uniform in [0, 1), the same in Spark, SQL and Python."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(op), F.lit(slot), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(UNIT)


def uniform_sql(seed: int, op: str, slot: str, key: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', '{op}', '{slot}', ({key})::VARCHAR)), 1, 8))::UBIGINT / {UNIT:.1f}::DOUBLE)"


def normal(seed: int, op: str, slot: str, key: Column) -> Column:
    """Standard normal by Box-Muller on two slots."""
    a = F.greatest(uniform(seed, op, f"{slot}.a", key), F.lit(1e-12))
    return F.sqrt(-2 * F.log(a)) * F.cos(2 * math.pi * uniform(seed, op, f"{slot}.b", key))


def normal_sql(seed: int, op: str, slot: str, key: str) -> str:
    return f"(sqrt(-2 * ln(greatest({uniform_sql(seed, op, slot + '.a', key)}, 1e-12))) * cos(2 * {math.pi!r} * {uniform_sql(seed, op, slot + '.b', key)}))"


class Draw:
    """Draws of one operator for one key, in Python; scalars agree with uniform() on columns."""

    def __init__(self, seed: int, op: str, key):
        self.seed, self.op, self.key, self.log = seed, op, key, {}

    def u(self, slot: str) -> float:
        text = "|".join((str(self.seed), self.op, slot, str(self.key)))
        return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / UNIT

    def between(self, slot: str, low: float, high: float) -> float:
        self.log[slot] = low + (high - low) * self.u(slot)
        return self.log[slot]

    def chance(self, slot: str, p: float) -> bool:
        return self.u(slot) < p

    def pick(self, slot: str, values):
        self.log[slot] = v = values[min(int(self.u(slot) * len(values)), len(values) - 1)]
        return v

    def rng(self, slot: str) -> np.random.Generator:
        """A stream for fields of noise."""
        text = "|".join((str(self.seed), self.op, slot, str(self.key)))
        return np.random.Generator(np.random.Philox(key=int(hashlib.md5(text.encode()).hexdigest(), 16)))
