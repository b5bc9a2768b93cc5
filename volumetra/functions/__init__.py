"""Array expressions that stay in the JVM, and the bridge between array and long form."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where it lies beside the driver's."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def bind(value: Column, f) -> Column:
    """f(value) with value computed once. An alias would be pasted into every lambda and run per element."""
    return F.transform(F.array(value), f)[0]


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def stats(a: Column) -> Column:
    """struct(low, high, mean, n)."""
    return F.struct(F.array_min(a).alias("low"), F.array_max(a).alias("high"), (total(a) / F.size(a)).alias("mean"), F.size(a).cast("double").alias("n"))


def spread(a: Column, mean: Column, ddof: int = 0) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / (F.size(a) - ddof))


def with_stats(a: Column, f) -> Column:
    """transform(a, x -> f(x, stats of a)), the statistics bound."""
    return bind(a, lambda v: bind(stats(v), lambda s: F.transform(v, lambda x: f(x, s))))


def zscore(a: Column, ddof: int = 0) -> Column:
    return bind(a, lambda v: bind(stats(v), lambda s: bind(F.greatest(spread(v, s["mean"], ddof), F.lit(1e-8)), lambda d: F.transform(v, lambda x: F.when(s["low"] == s["high"], x).otherwise((x - s["mean"]) / d) if ddof == 0 else (x - s["mean"]) / d))))


def unit(a: Column, eps: float = 1e-5) -> Column:
    return with_stats(a, lambda x, s: (x - s["low"]) / (s["high"] - s["low"] + eps))


def gamma(a: Column, g: Column) -> Column:
    return bind(g, lambda e: with_stats(a, lambda x, s: F.pow((x - s["low"]) / (s["high"] - s["low"] + 1e-8), e) * (s["high"] - s["low"]) + s["low"]))


def inverse_gamma(a: Column, g: Column) -> Column:
    return F.transform(gamma(F.transform(a, lambda x: -x), g), lambda x: -x)


def contrast(a: Column, f: Column) -> Column:
    return bind(f, lambda k: with_stats(a, lambda x, s: (x - s["mean"]) * k + s["mean"]))


def inverse(a: Column) -> Column:
    return with_stats(a, lambda x, s: s["high"] - x)


def restored(new: Column, old: Column, eps: float = 1e-8) -> Column:
    """Back to the mean and sample deviation of old."""
    part = lambda v: F.struct((total(v) / F.size(v)).alias("m"), spread(v, total(v) / F.size(v), 1).alias("d"))
    return bind(new, lambda n: bind(total(n) / F.size(n), lambda m: bind(spread(n, m, 1), lambda d: bind(old, lambda o: bind(total(o) / F.size(o), lambda om: bind(spread(o, om, 1), lambda od: F.transform(n, lambda x: (x - m) / (d + eps) * od + om)))))))


def quantile(a: Column, q: Column) -> Column:
    """Linear interpolation between order statistics; q may be a column."""
    return bind(F.sort_array(a), lambda s: bind(q * (F.size(s) - 1), lambda at: bind(F.floor(at).cast("int"), lambda i: s[i] + (at - i) * (s[F.least(i + 1, F.size(s) - 1)] - s[i]))))


def kmeans(a: Column, count: int, rounds: int = 10) -> Column:
    """Ascending centroids; the state of each round is an array, bound before the next."""
    low_high = lambda v: F.struct(F.array_min(v).alias("a"), F.array_max(v).alias("b"))
    start = lambda v: bind(low_high(v), lambda s: F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: s["a"] + (s["b"] - s["a"]) * i / max(1, count - 1)))

    def step(v, c):
        mid = F.transform(F.sequence(F.lit(0), F.lit(count - 2)), lambda i: (c[i] + c[i + 1]) / 2)
        pick = lambda m, i: F.filter(v, lambda x: F.size(F.filter(m, lambda y: y < x)) == i)
        return bind(mid, lambda m: F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: bind(pick(m, i), lambda p: F.when(F.size(p) > 0, total(p) / F.size(p)).otherwise(c[i]))))

    return bind(a, lambda v: F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start(v), lambda c, _: step(v, c)))


def to_long(df: DataFrame, key: str, array: str, shape: tuple[int, int, int]) -> DataFrame:
    """(key, pos, z, y, x, v) of each element."""
    d, h, w = shape
    out = df.select(key, F.posexplode(array).alias("pos", "v"))
    return out.select(key, "pos", (F.floor(F.col("pos") / (h * w)) % d).cast("int").alias("z"), (F.floor(F.col("pos") / w) % h).cast("int").alias("y"), (F.col("pos") % w).alias("x"), F.col("v").cast("double"))


def from_long(df: DataFrame, key: str) -> DataFrame:
    """Arrays in order of pos."""
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("img"))
