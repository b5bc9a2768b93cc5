"""Queries over whole tables, each with an independent SQL oracle.

`embeddings` are read as volumes of 4 x 4 x 4 (z = pos div 16), labels by octant; `events` as ragged
signals of users; `lineitem` as groups of suppliers. Spark works on arrays in the JVM where an operator is per
volume, and on long form where it is relational; the oracle is always long-form SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import functions as A
from .draws import normal, normal_sql, uniform, uniform_sql
from .image import places

SEED = 11
SHAPE = (4, 4, 4)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
V = """WITH v AS (SELECT vec_id, pos, pos // 16 AS z, pos // 4 % 4 AS y, pos % 4 AS x, v FROM (SELECT vec_id, unnest(range(len(embedding)))::INTEGER AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)),
s AS (SELECT vec_id, min(v) AS lo, max(v) AS hi, avg(v) AS m, stddev_pop(v) AS sp, stddev_samp(v) AS ss FROM v GROUP BY vec_id)"""


def volumes(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("img"))


def long(spark: SparkSession, d: str) -> DataFrame:
    return A.to_long(volumes(spark, d), "vec_id", "img", SHAPE)


def out(df: DataFrame, *cols: Column | str) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    df = df.select(*cols) if cols else df
    return df.select(*[(F.round(c, 5) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def pointwise(name: str, f: Callable[[Column], Column], sql: str, join: str = "") -> None:
    """A per-volume operator: array expression here, long form there."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return out(volumes(spark, d).select("vec_id", F.posexplode(f(F.col("img"))).alias("pos", "v")))

    QUERIES[name] = run
    ORACLES[name] = f"{V}{join}\nSELECT vec_id, pos, round({sql}, 5) + 0.0 AS v FROM v JOIN s USING (vec_id)" + (" JOIN t USING (vec_id)" if join else "")


def u(op: str, slot: str, low: float, high: float) -> tuple[Callable[[], Column], str]:
    """A uniform draw per volume, as a column (made when asked for: columns need a session) and in SQL."""
    return lambda: F.lit(low) + F.lit(high - low) * uniform(SEED, op, slot, F.col("vec_id")), f"({low!r} + {high - low!r} * {uniform_sql(SEED, op, slot, 'vec_id')})"


UNIT = "((v - lo) / (hi - lo + 1e-5))"
pointwise("zscore_population", A.zscore, "CASE WHEN lo = hi THEN v ELSE (v - m) / greatest(sp, 1e-8) END")
pointwise("zscore_sample", lambda a: A.zscore(a, 1), "(v - m) / greatest(ss, 1e-8)")
for _name, _f, _s in (("log1p", lambda x: F.log1p(x), "ln(1 + {})"), ("sqrt", lambda x: F.sqrt(x), "sqrt({})"), ("sin", F.sin, "sin({})"), ("exp", F.exp, "exp({})"), ("sigmoid", lambda x: 1 / (1 + F.exp(-x)), "1 / (1 + exp(-{}))")):
    pointwise(f"function_{_name}", lambda a, f=_f: F.transform(A.unit(a), f), _s.format(UNIT))
pointwise("inverse", A.inverse, "hi - v")
_c, _q = u("brightness", "factor", 0.5, 1.5)
pointwise("brightness", lambda a, c=_c: A.bind(c(), lambda k: F.transform(a, lambda x: x * k)), f"v * {_q}")
_c, _q = u("contrast", "factor", 0.75, 1.25)
pointwise("contrast", lambda a, c=_c: A.contrast(a, c()), f"(v - m) * {_q} + m")
_c, _q = u("gamma", "gamma", 0.7, 1.5)
pointwise("gamma", lambda a, c=_c: A.gamma(a, c()), f"pow((v - lo) / (hi - lo + 1e-8), {_q}) * (hi - lo) + lo")
pointwise("inverse_gamma", lambda a, c=_c: A.inverse_gamma(a, c()), f"-(pow((-v + hi) / (hi - lo + 1e-8), {_q}) * (hi - lo) - hi)")
pointwise("sqrt_retain_stats", lambda a: A.restored(F.transform(A.unit(a), F.sqrt), a), "(sqrt(" + UNIT + ") - nm) / (ns + 1e-8) * ss + m", f",\nt AS (SELECT vec_id, avg(sqrt({UNIT})) AS nm, stddev_samp(sqrt({UNIT})) AS ns FROM v JOIN s USING (vec_id) GROUP BY vec_id)")
_c, _q = u("mix", "alpha", 0.0, 1.0)
pointwise("mix_with_original", lambda a, c=_c: A.bind(c(), lambda k: F.zip_with(a, A.inverse(a), lambda x, y: k * x + (1 - k) * y)), f"{_q} * v + (1 - {_q}) * (hi - v)")
pointwise("clip_minmax", lambda a: A.unit(F.transform(a, lambda x: F.least(F.greatest(x, F.lit(-0.1)), F.lit(0.1))), 1e-7), "(least(greatest(v, -0.1), 0.1) - greatest(lo, -0.1)) / (least(hi, 0.1) - greatest(lo, -0.1) + 1e-7)")
_lo, _lq = u("clamp", "low", 0.0, 0.2)
_hi, _hq = u("clamp", "high", 0.0, 0.2)
pointwise("clamp_quantiles", lambda a, p=_lo, q=_hi: A.bind(A.quantile(a, p()), lambda l: A.bind(A.quantile(a, 1 - q()), lambda h: F.transform(a, lambda x: F.least(F.greatest(x, l), h)))), "least(greatest(v, ql), qh)", f""",
o AS (SELECT vec_id, list_sort(list(v)) AS a, {_lq} * 63 AS p, (1 - {_hq}) * 63 AS q FROM v GROUP BY vec_id),
t AS (SELECT vec_id, a[floor(p)::INT + 1] + (p - floor(p)) * (a[least(floor(p)::INT + 2, 64)] - a[floor(p)::INT + 1]) AS ql, a[floor(q)::INT + 1] + (q - floor(q)) * (a[least(floor(q)::INT + 2, 64)] - a[floor(q)::INT + 1]) AS qh FROM o)""")
pointwise("flip_x", lambda a: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda r: F.reverse(F.slice(a, r * 4 + 1, 4)))), "v")
ORACLES["flip_x"] = f"{V}\nSELECT vec_id, z * 16 + y * 4 + 3 - x AS pos, round(v, 5) + 0.0 AS v FROM v"


@query("gaussian_noise", f"{V}\nSELECT vec_id, pos, round(v + {uniform_sql(SEED, 'noise', 'std', 'vec_id')} * {normal_sql(SEED, 'noise', 'n', 'vec_id * 64 + pos')}, 5) + 0.0 AS v FROM v")
def gaussian_noise(spark, d):
    key = F.col("vec_id") * 64 + F.col("pos")
    return out(long(spark, d), "vec_id", "pos", (F.col("v") + uniform(SEED, "noise", "std", F.col("vec_id")) * normal(SEED, "noise", "n", key)).alias("v"))


AXES = "2 * z / 3.0 - 1 AS a, 2 * y / 3.0 - 1 AS b, 2 * x / 3.0 - 1 AS c"
POLY = [(i, j, k) for i in range(4) for j in range(4 - i) for k in range(4 - i - j)]


@query("bias_field", f"{V}\nSELECT vec_id, pos, round(v * exp(" + " + ".join(f"(-0.5 + {uniform_sql(SEED, 'bias', f'c{i}{j}{k}', 'vec_id')}) * pow(c, {i}) * pow(b, {j}) * pow(a, {k})" for i, j, k in POLY) + f"), 5) + 0.0 AS v FROM (SELECT *, {AXES} FROM v)")
def bias_field(spark, d):
    coefficients = F.array(*[uniform(SEED, "bias", f"c{i}{j}{k}", F.col("vec_id")) - 0.5 for i, j, k in POLY])
    df = A.to_long(volumes(spark, d), "vec_id", "img", SHAPE).join(volumes(spark, d).select("vec_id", coefficients.alias("k")), "vec_id")
    c, b, a = (2 * F.col(n) / 3.0 - 1 for n in "xyz")
    field = sum(F.col("k")[n] * F.pow(c, F.lit(i)) * F.pow(b, F.lit(j)) * F.pow(a, F.lit(k)) for n, (i, j, k) in enumerate(POLY))
    return out(df, "vec_id", "pos", (F.col("v") * F.exp(field)).alias("v"))


@query("crop_in_place", f"{V}\nSELECT vec_id, pos, round(CASE WHEN z BETWEEN 1 AND 2 AND x >= 1 THEN v ELSE lo END, 5) + 0.0 AS v FROM v JOIN s USING (vec_id)")
def crop_in_place(spark, d):
    inside = lambda i: F.floor(i / 16).between(1, 2) & (i % 4 >= 1)
    cropped = A.bind(F.array_min("img"), lambda low: F.transform("img", lambda x, i: F.when(inside(i), x).otherwise(low)))
    return out(volumes(spark, d).select("vec_id", F.posexplode(cropped).alias("pos", "v")))


OCTANT = "(z // 2 * 4 + y // 2 * 2 + x // 2)"
def octant() -> Column:
    return (F.floor(F.col("z") / 2) * 4 + F.floor(F.col("y") / 2) * 2 + F.floor(F.col("x") / 2)).cast("int")


@query("region_moments", f"{V}\nSELECT vec_id, {OCTANT} AS region, count(*) AS n, round(avg(v), 5) + 0.0 AS mean, round(stddev_pop(v), 5) + 0.0 AS sd FROM v GROUP BY ALL")
def region_moments(spark, d):
    return out(long(spark, d).groupBy("vec_id", octant().alias("region")).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd")))


@query("region_select", f"""{V}, c AS (SELECT vec_id, {uniform_sql(SEED, 'region', 'in', 'vec_id')} < 0.5 AS i, {uniform_sql(SEED, 'region', 'out', 'vec_id')} < 0.5 AS o FROM s)
SELECT vec_id, pos, round(CASE WHEN i = o OR i = ({OCTANT} > 0) THEN hi - v ELSE v END, 5) + 0.0 AS v FROM v JOIN s USING (vec_id) JOIN c USING (vec_id)""")
def region_select(spark, d):
    key = F.col("vec_id")
    coins = volumes(spark, d).select("vec_id", "img", (uniform(SEED, "region", "in", key) < 0.5).alias("i"), (uniform(SEED, "region", "out", key) < 0.5).alias("o"))
    label = lambda p: F.floor(p / 32) * 4 + F.floor(p / 8) % 2 * 2 + F.floor(p / 2) % 2
    new = A.bind(F.array_max("img"), lambda h: F.transform("img", lambda x, p: F.when((F.col("i") == F.col("o")) | (F.col("i") == (label(p) > 0)), h - x).otherwise(x)))
    return out(coins.select("vec_id", F.posexplode(new).alias("pos", "v")))


@query("segment_sum", f"{V}\nSELECT r.region, coalesce(count(v), 0) AS n, round(coalesce(sum(v), 0), 4) + 0.0 AS total FROM (SELECT unnest(range(10)) AS region) r LEFT JOIN v ON {OCTANT} = r.region GROUP BY ALL")
def segment_sum(spark, d):
    sums = long(spark, d).groupBy(octant().alias("region")).agg(F.count("v").alias("n"), F.sum("v").alias("total"))
    return spark.range(10).select(F.col("id").alias("region")).join(sums, "region", "left").select("region", F.coalesce("n", F.lit(0)).alias("n"), (F.round(F.coalesce("total", F.lit(0.0)), 4) + 0.0).alias("total"))


@query("histogram_cdf", f"{V}, b AS (SELECT vec_id, least(floor((v - lo) / ((hi - lo) / 256 + 1e-10)), 255)::INTEGER AS bin FROM v JOIN s USING (vec_id))\nSELECT vec_id, bin, count(*) AS n, (sum(count(*)) OVER (PARTITION BY vec_id ORDER BY bin))::BIGINT AS cdf FROM b GROUP BY vec_id, bin")
def histogram_cdf(spark, d):
    bins = A.with_stats(F.col("img"), lambda x, s: F.least(F.floor((x - s["low"]) / ((s["high"] - s["low"]) / 256 + 1e-10)), F.lit(255)).cast("int"))
    n = volumes(spark, d).select("vec_id", F.explode(bins).alias("bin")).groupBy("vec_id", "bin").agg(F.count("*").alias("n"))
    return n.withColumn("cdf", F.sum("n").over(Window.partitionBy("vec_id").orderBy("bin")))


@query("histogram_equalisation", f"""{V}, b AS (SELECT vec_id, pos, lo, hi, least(floor((v - lo) / ((hi - lo) / 256 + 1e-10)), 255) AS bin FROM v JOIN s USING (vec_id)),
c AS (SELECT *, count(*) OVER (PARTITION BY vec_id ORDER BY bin) AS cdf FROM b), e AS (SELECT *, min(cdf) OVER (PARTITION BY vec_id) AS base FROM c)
SELECT vec_id, pos, round((cdf - base) / greatest(64 - base, 1e-10) * (hi - lo) + lo, 5) + 0.0 AS v FROM e""")
def histogram_equalisation(spark, d):
    """Counts per bin, their running sum over 256 bins at most, and a look-up: linear in the voxels."""
    stats = volumes(spark, d).select("vec_id", F.array_min("img").alias("lo"), F.array_max("img").alias("hi"), F.size("img").alias("size"), "img")
    b = stats.select("vec_id", "lo", "hi", "size", F.posexplode("img").alias("pos", "v")).withColumn("bin", F.least(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 256 + 1e-10)), F.lit(255)))
    w = Window.partitionBy("vec_id").orderBy("bin")
    cdf = b.groupBy("vec_id", "bin").agg(F.count("*").alias("n")).select("vec_id", "bin", F.sum("n").over(w).alias("cdf"), F.first("n").over(w).alias("base"))
    new = (F.col("cdf") - F.col("base")) / F.greatest(F.col("size") - F.col("base"), F.lit(1e-10)) * (F.col("hi") - F.col("lo")) + F.col("lo")
    return out(b.join(cdf, ["vec_id", "bin"]), "vec_id", "pos", new.alias("v"))


def _reflect(c: str) -> str:
    return f"CASE {c} WHEN -1 THEN 1 WHEN 4 THEN 2 ELSE {c} END"


def along(a: Column, taps: tuple[float, float, float], axis: int, reflect: bool) -> Column:
    """Three taps along one axis of a 4 x 4 x 4 array. Which elements are neighbours is fixed when the plan is made; beyond the border is the mirror image, or 0."""
    step = (16, 4, 1)[axis]
    near = [(p - step if p // step % 4 else p + step if reflect else 64, p + step if p // step % 4 < 3 else p - step if reflect else 64) for p in range(64)]
    low, high = (F.array(*[F.lit(x[k]) for x in near]) for k in (0, 1))
    full = a if reflect else F.concat(a, F.array(F.lit(0.0)))
    return A.bind(full, lambda v: A.bind(low, lambda i: A.bind(high, lambda j: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: taps[0] * v[i[p]] + taps[1] * v[p] + taps[2] * v[j[p]]))))


def separable(a: Column, taps: list[tuple[float, float, float]], reflect: bool) -> Column:
    for axis, t in enumerate(taps):
        a = along(a, t, axis, reflect)
    return a


CUBE = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]


def _taps(weights: dict) -> str:
    return "(VALUES " + ", ".join(f"({i}, {j}, {k}, {w!r}::DOUBLE)" for (i, j, k), w in weights.items()) + ") AS k(i, j, k, w)"


def _stencil_sql(weights: dict, reflect: bool) -> str:
    at = [_reflect(f"(v.{c} + k.{o})") if reflect else f"(v.{c} + k.{o})" for c, o in zip("zyx", "ijk", strict=True)]
    return f"{V}\nSELECT v.vec_id, v.pos, round(sum(coalesce(n.v, 0) * w), 5) + 0.0 AS v FROM v CROSS JOIN {_taps(weights)} LEFT JOIN v n ON n.vec_id = v.vec_id AND n.z = {at[0]} AND n.y = {at[1]} AND n.x = {at[2]} GROUP BY v.vec_id, v.pos"


LAPLACE = {c: 26.0 if c == (0, 0, 0) else -1.0 for c in CUBE}
SCHARR_X = {(i, j, k): k * (10.0 if i == 0 else 3.0) * (10.0 if j == 0 else 3.0) for i, j, k in CUBE if k}  # 9, 30 or 100, as defined
GAUSS = {(i, j, k): 2.0 ** -(3 + abs(i) + abs(j) + abs(k)) for i, j, k in CUBE}
ONES, HALVES, SMOOTH, DIFFER = (1.0, 1.0, 1.0), (0.25, 0.5, 0.25), (3.0, 10.0, 3.0), (-1.0, 0.0, 1.0)
for _name, _w, _r, _f in (
    ("laplace_reflect", LAPLACE, True, lambda a: F.zip_with(a, separable(a, [ONES] * 3, True), lambda x, y: 27 * x - y)),
    ("laplace_zero", LAPLACE, False, lambda a: F.zip_with(a, separable(a, [ONES] * 3, False), lambda x, y: 27 * x - y)),
    ("scharr_x", SCHARR_X, True, lambda a: separable(a, [SMOOTH, SMOOTH, DIFFER], True)),
    ("gaussian_blur_3tap", GAUSS, True, lambda a: separable(a, [HALVES] * 3, True)),
    ("box_filter", dict.fromkeys(CUBE, 1.0), False, lambda a: separable(a, [ONES] * 3, False)),
    ("unsharp_mask", GAUSS, True, lambda a: F.zip_with(a, separable(a, [HALVES] * 3, True), lambda x, y: x + 1.5 * (x - y))),
):
    QUERIES[_name] = lambda spark, d, f=_f: out(volumes(spark, d).select("vec_id", F.posexplode(f(F.col("img"))).alias("pos", "v")))
    ORACLES[_name] = _stencil_sql(_w, _r)


_BLUR = _stencil_sql(GAUSS, True).replace("round(sum(coalesce(n.v, 0) * w), 5) + 0.0", "sum(n.v * w)")
ORACLES["unsharp_mask"] = f"SELECT vec_id, pos, round(2.5 * e.v - 1.5 * b.v, 5) + 0.0 AS v FROM ({_BLUR}) b JOIN (SELECT vec_id, unnest(range(64))::INTEGER AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings) e USING (vec_id, pos)"


@query("dilate_26", f"{V}\nSELECT v.vec_id, v.pos, bool_or(n.v > 0.2)::INTEGER AS on FROM v JOIN v n ON n.vec_id = v.vec_id AND abs(n.z - v.z) <= 1 AND abs(n.y - v.y) <= 1 AND abs(n.x - v.x) <= 1 GROUP BY v.vec_id, v.pos".replace(" AS on ", ' AS "on" '))
def dilate_26(spark, d):
    """Separable: a running maximum along each axis, over windows of one volume."""
    df = long(spark, d).withColumn("on", (F.col("v") > 0.2).cast("int"))
    for axis in "zyx":
        rest = [c for c in "zyx" if c != axis]
        df = df.withColumn("on", F.max("on").over(Window.partitionBy("vec_id", *rest).orderBy(axis).rowsBetween(-1, 1)))
    return df.select("vec_id", "pos", "on")


KM = "WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda q: q::DOUBLE) AS a FROM embeddings), r(vec_id, a, i, c) AS (SELECT vec_id, a, 0, list_transform(range(3), lambda k: list_min(a) + (list_max(a) - list_min(a)) * k / 2) FROM e UNION ALL SELECT vec_id, a, i + 1, list_transform(range(3), lambda k: coalesce(list_avg(list_filter(a, lambda q: (k = 0 OR q > (c[k] + c[k + 1]) / 2) AND (k = 2 OR q <= (c[k + 1] + c[k + 2]) / 2))), c[k + 1])) FROM r WHERE i < 10)"


@query("kmeans_1d", f"{KM} SELECT vec_id, round(c[1], 5) + 0.0 AS c0, round(c[2], 5) + 0.0 AS c1, round(c[3], 5) + 0.0 AS c2 FROM r WHERE i = 10")
def kmeans_1d(spark, d):
    c = volumes(spark, d).select("vec_id", A.kmeans(F.col("img"), 3).alias("c"))
    return out(c, "vec_id", *[F.col("c")[i].alias(f"c{i}") for i in range(3)])


SEEDS = [(0, 0, 0), (3, 3, 3), (0, 3, 1), (2, 0, 3)]


@query("voronoi_nearest_seed", f"{V}, k(s, a, b, c) AS (VALUES {', '.join(f'({n}, {a}, {b}, {c})' for n, (a, b, c) in enumerate(SEEDS))}), r AS (SELECT vec_id, pos, s, row_number() OVER (PARTITION BY vec_id, pos ORDER BY (z - a) ** 2 + (y - b) ** 2 + (x - c) ** 2, s) AS n FROM v CROSS JOIN k)\nSELECT vec_id, pos, s AS seed FROM r WHERE n = 1")
def voronoi_nearest_seed(spark, d):
    far = [F.struct((F.pow(F.col("z") - a, F.lit(2)) + F.pow(F.col("y") - b, F.lit(2)) + F.pow(F.col("x") - c, F.lit(2))).alias("d"), F.lit(s).alias("s")) for s, (a, b, c) in enumerate(SEEDS)]
    return long(spark, d).select("vec_id", "pos", F.least(*far)["s"].alias("seed"))


@query("dense_region_ids", f"{V}\nSELECT vec_id, pos, (dense_rank() OVER (PARTITION BY vec_id ORDER BY {OCTANT} * 7) - 1)::INTEGER AS id FROM v")
def dense_region_ids(spark, d):
    return long(spark, d).select("vec_id", "pos", (F.dense_rank().over(Window.partitionBy("vec_id").orderBy(octant() * 7)) - 1).alias("id"))


@query("signed_affine_remap", f"""{V}, g AS (SELECT *, {OCTANT} AS r, (v - lo) / (hi - lo + 1e-8) AS w FROM v JOIN s USING (vec_id)), h AS (SELECT *, avg(w) OVER (PARTITION BY vec_id, r) AS rm FROM g)
SELECT vec_id, pos, round(least(greatest({uniform_sql(SEED, 'remap', 'level', 'vec_id * 8 + r')} + (0.5 + 1.5 * {uniform_sql(SEED, 'remap', 'alpha', 'vec_id * 8 + r')}) * (w - rm), 0), 1), 5) + 0.0 AS v FROM h""")
def signed_affine_remap(spark, d):
    unit = A.to_long(volumes(spark, d).withColumn("img", A.unit(F.col("img"), 1e-8)), "vec_id", "img", SHAPE).withColumn("r", octant())
    mean = unit.groupBy("vec_id", "r").agg(F.avg("v").alias("rm"))
    key = F.col("vec_id") * 8 + F.col("r")
    new = uniform(SEED, "remap", "level", key) + (0.5 + 1.5 * uniform(SEED, "remap", "alpha", key)) * (F.col("v") - F.col("rm"))
    return out(unit.join(mean, ["vec_id", "r"]), "vec_id", "pos", F.least(F.greatest(new, F.lit(0.0)), F.lit(1.0)).alias("v"))


@query("labels_to_image", f"""{V}\nSELECT vec_id, pos, round(250 * {uniform_sql(SEED, 'gmm', 'mean', f'vec_id * 8 + {OCTANT}')} + 30 * {uniform_sql(SEED, 'gmm', 'std', f'vec_id * 8 + {OCTANT}')} * {normal_sql(SEED, 'gmm', 'n', 'vec_id * 64 + pos')}, 5) + 0.0 AS v FROM v""")
def labels_to_image(spark, d):
    df = long(spark, d).withColumn("r", octant())
    key = F.col("vec_id") * 8 + F.col("r")
    table = df.select("vec_id", "r").distinct().select("vec_id", "r", (250 * uniform(SEED, "gmm", "mean", key)).alias("mean"), (30 * uniform(SEED, "gmm", "std", key)).alias("sd"))
    return out(df.join(table, ["vec_id", "r"]), "vec_id", "pos", (F.col("mean") + F.col("sd") * normal(SEED, "gmm", "n", F.col("vec_id") * 64 + F.col("pos"))).alias("v"))


@query("relabel", f"{V}\nSELECT CASE {OCTANT} WHEN 1 THEN 10 WHEN 2 THEN 10 WHEN 3 THEN 0 ELSE {OCTANT} END AS label, count(*) AS n FROM v GROUP BY ALL")
def relabel(spark, d):
    table = F.create_map(*[F.lit(x) for x in (1, 10, 2, 10, 3, 0)])
    return long(spark, d).groupBy(F.coalesce(table[octant()], octant()).alias("label")).agg(F.count("*").alias("n"))


@query("onehot", f"{V}\nSELECT vec_id, {', '.join(f'sum(({OCTANT} = {k + 1})::INTEGER * v) AS c{k}' for k in range(3))} FROM v GROUP BY vec_id".replace("sum(", "round(sum(").replace(" * v)", " * v), 5) + 0.0"))
def onehot(spark, d):
    return out(long(spark, d).groupBy("vec_id").agg(*[F.sum((octant() == k + 1).cast("int") * F.col("v")).alias(f"c{k}") for k in range(3)]))


@query("nonzero_coordinates", f"{V}\nSELECT vec_id, x, y, z, round(v, 5) + 0.0 AS v FROM v WHERE v > 0")
def nonzero_coordinates(spark, d):
    return out(long(spark, d).where("v > 0"), "vec_id", "x", "y", "z", "v")


@query("z_extent", f"{V}\nSELECT vec_id, min(z) AS first, max(z) AS last FROM v WHERE v > 0.1 GROUP BY vec_id")
def z_extent(spark, d):
    return long(spark, d).where("v > 0.1").groupBy("vec_id").agg(F.min("z").alias("first"), F.max("z").alias("last"))


@query("dice", f"{V}\nSELECT vec_id, round(coalesce(2.0 * sum((v > 0)::INT * (x > 1)::INT) / nullif(sum((v > 0)::INT) + sum((x > 1)::INT), 0), 0), 5) AS dice FROM v GROUP BY vec_id")
def dice(spark, d):
    a, b = (F.col("v") > 0).cast("int"), (F.col("x") > 1).cast("int")
    return long(spark, d).groupBy("vec_id").agg(F.round(F.coalesce(2.0 * F.sum(a * b) / F.nullif(F.sum(a) + F.sum(b), F.lit(0)), F.lit(0.0)), 5).alias("dice"))


@query("soft_histogram", f"{V}, b AS (SELECT vec_id, (v - lo) / (hi - lo + 1e-10) * 15 AS q FROM v JOIN s USING (vec_id)), w AS (SELECT vec_id, floor(q)::INT AS bin, 1 - (q - floor(q)) AS w FROM b UNION ALL SELECT vec_id, least(floor(q)::INT + 1, 15), q - floor(q) FROM b)\nSELECT vec_id, bin, round(sum(w), 5) + 0.0 AS w FROM w GROUP BY vec_id, bin")
def soft_histogram(spark, d):
    q = volumes(spark, d).select("vec_id", F.explode(F.transform(A.unit(F.col("img"), 1e-10), lambda x: x * 15)).alias("q"))
    low = F.floor("q").cast("int")
    two = F.array(F.struct(low.alias("bin"), (1 - (F.col("q") - low)).alias("w")), F.struct(F.least(low + 1, F.lit(15)).alias("bin"), (F.col("q") - low).alias("w")))
    return out(q.select("vec_id", F.explode(two).alias("t")).groupBy("vec_id", "t.bin").agg(F.sum("t.w").alias("w")))


@query("downsample_nearest", f"{V}\nSELECT vec_id, z // 2 * 4 + y // 2 * 2 + x // 2 AS pos, round(v, 5) + 0.0 AS v FROM v WHERE z % 2 = 1 AND y % 2 = 1 AND x % 2 = 1")
def downsample_nearest(spark, d):
    at = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.col("img")[((F.floor(i / 4) * 2 + 1) * 16 + (F.floor(i / 2) % 2 * 2 + 1) * 4 + i % 2 * 2 + 1).cast("int")])
    return out(volumes(spark, d).select("vec_id", F.posexplode(at).alias("pos", "v")).select("vec_id", F.col("pos").cast("int").alias("pos"), "v"))


@query("signal_zscore", "SELECT event_id, round((value - avg(value) OVER u) / greatest(stddev_pop(value) OVER u, 1e-8), 5) + 0.0 AS v FROM events WINDOW u AS (PARTITION BY user_id)")
def signal_zscore(spark, d):
    """Ragged signals in long form: aggregate with map-side combining, then join, so a hot user is no single task."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "value")
    s = e.groupBy("user_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    return out(e.join(s, "user_id"), "event_id", ((F.col("value") - F.col("m")) / F.greatest("sd", F.lit(1e-8))).alias("v"))


@query("signal_label_stats", "SELECT user_id, event_type, count(*) AS n, round(avg(value), 3) + 0.0 AS mean, round(max(value), 5) + 0.0 AS top FROM events GROUP BY ALL")
def signal_label_stats(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return out(e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 3).alias("mean"), F.max("value").alias("top")))


@query("table_quantiles", "SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.01), 1) AS q01, round(quantile_cont(l_extendedprice, 0.99), 1) AS q99 FROM lineitem GROUP BY l_suppkey")
def table_quantiles(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    return t.groupBy("l_suppkey").agg(*[F.round(F.percentile("l_extendedprice", F.lit(q)), 1).alias(n) for n, q in (("q01", 0.01), ("q99", 0.99))])


@query("table_region_moments", "SELECT l_suppkey, l_returnflag AS label, count(*) AS n, round(avg(l_extendedprice), 3) AS mean, round(stddev_pop(l_extendedprice), 3) AS sd FROM lineitem GROUP BY ALL")
def table_region_moments(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    return t.groupBy("l_suppkey", F.col("l_returnflag").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 3).alias("mean"), F.round(F.stddev_pop("l_extendedprice"), 3).alias("sd"))


def picked(places: list[int]) -> Callable[[SparkSession, str], DataFrame]:
    """Voxels in another order, fixed when the plan is made."""
    def run(spark: SparkSession, d: str) -> DataFrame:
        at = A.bind(F.array(*map(F.lit, places)), lambda p: A.bind(F.col("img"), lambda v: F.transform(p, lambda i: v[i])))
        return out(volumes(spark, d).select("vec_id", F.posexplode(at).alias("pos", "v")))

    return run


# from LPI (x, y, z from left, back, below) to axes z, x, y with x turned round; slices from above
QUERIES["change_orientation"] = picked(places(SHAPE, "LPI", "IRP"))
ORACLES["change_orientation"] = f"{V}\nSELECT vec_id, y * 16 + (3 - x) * 4 + z AS pos, round(v, 5) + 0.0 AS v FROM v"
QUERIES["slice_from_above"] = picked([p for k in (3, 2, 1, 0) for p in range(k * 16, k * 16 + 16)])
ORACLES["slice_from_above"] = f"{V}\nSELECT vec_id, (3 - z) * 16 + y * 4 + x AS pos, round(v, 5) + 0.0 AS v FROM v"


def _resampled(interpolation: str) -> None:
    sizes = (6, 3, 8)  # x, y, z

    def run(spark: SparkSession, d: str) -> DataFrame:
        def many(batches):
            import pyarrow as pa

            from .image import Image, resample

            for b in batches:
                flat = [resample(Image(x.reshape(SHAPE)), sizes, "vox", interpolation=interpolation).data.ravel() for x in b.column(1).flatten().to_numpy().reshape(-1, 64)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(flat, pa.list_(pa.float64()))], ["vec_id", "img"])

        A.ship(spark)
        done = volumes(spark, d).where(F.size("img") == 64).mapInArrow(many, "vec_id long, img array<double>")
        return out(done.select("vec_id", F.posexplode("img").alias("pos", "v")))

    near = [f"least(floor({c} * 4.0 / {n} + 0.5), 3)" for c, n in zip("xyz", sizes, strict=True)]
    grid = f"g AS (SELECT z, y, x, (z * {sizes[1]} + y) * {sizes[0]} + x AS pos FROM (SELECT unnest(range({sizes[2]})) AS z) CROSS JOIN (SELECT unnest(range({sizes[1]})) AS y) CROSS JOIN (SELECT unnest(range({sizes[0]})) AS x))"
    if interpolation == "nn":
        sql = f"{V}, {grid}\nSELECT vec_id, g.pos::INTEGER AS pos, round(v, 5) + 0.0 AS v FROM g JOIN v ON v.x = {near[0].replace('x', 'g.x')} AND v.y = {near[1].replace('y', 'g.y')} AND v.z = {near[2].replace('z', 'g.z')}"
    else:
        weight = " * ".join(f"greatest(0, 1 - abs(least(g.{c} * 4.0 / {n}, 3) - v.{c}))" for c, n in zip("xyz", sizes, strict=True))
        sql = f"{V}, {grid}\nSELECT vec_id, g.pos::INTEGER AS pos, round(sum(v * {weight}), 5) + 0.0 AS v FROM g CROSS JOIN v GROUP BY vec_id, g.pos"
    QUERIES[f"resample_{interpolation}"], ORACLES[f"resample_{interpolation}"] = run, sql


_resampled("nn")
_resampled("linear")


@query("least_voxel_type", f"""{V}, q AS (SELECT vec_id, floor(v * 1000) AS q FROM v), e AS (SELECT vec_id, min(q) AS lo, max(q) AS hi FROM q GROUP BY vec_id)
SELECT vec_id, CASE WHEN lo >= 0 AND hi <= 255 THEN 'uint8' WHEN lo >= 0 THEN 'uint16' WHEN lo >= -128 AND hi <= 127 THEN 'int8' WHEN lo >= -32768 AND hi <= 32767 THEN 'int16' ELSE 'int32' END AS dtype FROM e""")
def least_voxel_type(spark, d):
    """The smallest integer type that holds every voxel."""
    ends = volumes(spark, d).select("vec_id", F.transform("img", lambda x: F.floor(x * 1000)).alias("q")).select("vec_id", F.array_min("q").alias("lo"), F.array_max("q").alias("hi"))
    fits = lambda low, high: (F.col("lo") >= low) & (F.col("hi") <= high)
    kind = F.when(fits(0, 255), "uint8").when(F.col("lo") >= 0, "uint16").when(fits(-128, 127), "int8").when(fits(-32768, 32767), "int16").otherwise("int32")
    return ends.select("vec_id", kind.alias("dtype"))


@query("masked_zscore", f"{V}, e AS (SELECT vec_id, avg(v) AS em, stddev_pop(v) AS es FROM v WHERE abs(v) > 0.05 GROUP BY vec_id)\nSELECT vec_id, pos, round(CASE WHEN abs(v) > 0.05 THEN (v - em) / greatest(es, 1e-8) ELSE v END, 5) + 0.0 AS v FROM v LEFT JOIN e USING (vec_id)")
def masked_zscore(spark, d):
    """Z-score over the voxels that are not empty; the others stay."""
    df = long(spark, d)
    e = df.where("abs(v) > 0.05").groupBy("vec_id").agg(F.avg("v").alias("em"), F.stddev_pop("v").alias("es"))
    new = F.when(F.abs("v") > 0.05, (F.col("v") - F.col("em")) / F.greatest("es", F.lit(1e-8))).otherwise(F.col("v"))
    return out(df.join(e, "vec_id", "left"), "vec_id", "pos", new.alias("v"))


@query("nonfinite_verdict", f"""{V}, b AS (SELECT vec_id // 10 AS batch_id, count(*) AS n, count(*) FILTER (WHERE NOT isfinite(ln(v))) AS bad FROM v GROUP BY ALL)
SELECT batch_id, n, bad, CASE WHEN bad = 0 THEN 'clean' WHEN bad = n THEN 'lost' ELSE 'partial' END AS verdict FROM b""".replace("NOT isfinite(ln(v))", "v <= 0"))
def nonfinite_verdict(spark, d):
    """How many results of a batch are not finite, here of a logarithm, and what that makes of it."""
    x = F.log("v")
    bad = F.count_if(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    b = long(spark, d).groupBy(F.floor(F.col("vec_id") / 10).alias("batch_id")).agg(F.count("*").alias("n"), bad.alias("bad"))
    return b.withColumn("verdict", F.when(F.col("bad") == 0, "clean").when(F.col("bad") == F.col("n"), "lost").otherwise("partial"))


@query("batch_mean_loss", f"""{V}, l AS (SELECT vec_id, avg(pow(v - 0.1, 2)) AS loss FROM v WHERE v > 0.3 GROUP BY vec_id)
SELECT b.batch_id, count(loss) AS n, coalesce(round(avg(loss), 7), 'nan'::DOUBLE) AS mean FROM (SELECT DISTINCT vec_id, vec_id // 5 AS batch_id FROM v) b LEFT JOIN l USING (vec_id) GROUP BY b.batch_id""")
def batch_mean_loss(spark, d):
    """Mean over the losses of a batch; NaN where it has none."""
    df = long(spark, d)
    loss = df.where("v > 0.3").groupBy("vec_id").agg(F.avg(F.pow(F.col("v") - 0.1, F.lit(2))).alias("loss"))
    ids = volumes(spark, d).select("vec_id", F.floor(F.col("vec_id") / 5).alias("batch_id"))
    return ids.join(loss, "vec_id", "left").groupBy("batch_id").agg(F.count("loss").alias("n"), F.coalesce(F.round(F.avg("loss"), 7), F.lit(float("nan"))).alias("mean"))


@query("region_masks", f"{V}, k AS (SELECT DISTINCT vec_id // 10 AS batch_id, {OCTANT} AS label FROM v WHERE v > 0), r AS (SELECT batch_id, label, row_number() OVER (PARTITION BY batch_id ORDER BY label) AS n FROM k)\nSELECT v.vec_id, r.label, count(*) FILTER (WHERE {OCTANT} = r.label) AS voxels FROM v JOIN r ON r.batch_id = v.vec_id // 10 AND r.n <= 5 GROUP BY v.vec_id, r.label".replace(f"WHERE {OCTANT} = r.label", f"WHERE {OCTANT} = r.label AND v.v > 0"))
def region_masks(spark, d):
    """Size of the mask of each label that occurs in a sample's batch, the five smallest labels of it."""
    df = long(spark, d).where("v > 0").select("vec_id", F.floor(F.col("vec_id") / 10).alias("batch_id"), octant().alias("label"))
    labels = df.groupBy("batch_id").agg(F.slice(F.array_sort(F.collect_set("label")), 1, 5).alias("labels"))
    ids = volumes(spark, d).select("vec_id", F.floor(F.col("vec_id") / 10).alias("batch_id")).join(labels, "batch_id")
    sizes = df.groupBy("vec_id", "label").agg(F.count("*").alias("n"))
    return ids.select("vec_id", F.explode("labels").alias("label")).join(sizes, ["vec_id", "label"], "left").select("vec_id", "label", F.coalesce("n", F.lit(0)).alias("voxels"))


def as_volumes(spark: SparkSession, d: str) -> DataFrame:
    """The table a pipeline takes, ten samples to a batch."""
    seg = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: (F.floor(p / 32) * 4 + F.floor(p / 8) % 2 * 2 + F.floor(p / 2) % 2).cast("int"))
    shape = F.struct(F.lit(1).alias("c"), F.lit(4).alias("d"), F.lit(4).alias("h"), F.lit(4).alias("w"))
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("sample_id"), F.floor(F.col("vec_id") / 10).alias("batch_id"), shape.alias("shape"), F.col("embedding").alias("img"), seg.alias("seg"))


def compiled(config: dict, backend: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        from .plans.pipeline import Pipeline

        return Pipeline(config, backend, SEED).apply(as_volumes(spark, d))

    return run


def _flagship() -> None:
    from .registry import entries
    from .volume_sql import PARAMS, oracles

    config = {"GPU": {"ZscoreNormalizationGPU": {}, "RandomSqrtGPU": {}, "RandomBrightnessGPU": {"in_seg": 1.0}}, "pipeline": {"same_on_batch": False}}

    def flagship(spark: SparkSession, d: str) -> DataFrame:
        done = compiled(config, "GPU")(spark, d)
        return out(done.select("sample_id", F.size("trace").alias("fired"), A.total(F.transform("img", lambda x, i: x.cast("double") * (i + 1))).alias("total"), F.size("img").alias("n")))

    QUERIES["pipeline_flagship"] = flagship
    for e in entries():  # every registered operator through the compiled pipeline, voxel by voxel
        config_ = {e.backend: {e.name: PARAMS.get(e.name, {}) | {"p": 1.0}}, "pipeline": {"same_on_batch": False}}

        def voxels(spark: SparkSession, d: str, f=compiled(config_, e.backend)) -> DataFrame:
            done = f(spark, d).select("sample_id", F.posexplode(F.arrays_zip("img", "seg")).alias("pos", "x"))
            return out(done.select("sample_id", "pos", F.col("x.img").cast("double").alias("v"), F.col("x.seg").alias("label")))

        QUERIES[f"volume_{e.name}"] = voxels
    ORACLES.update(oracles(SEED))


_flagship()
