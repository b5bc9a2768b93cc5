"""SQL oracles of the registered operators: long-form definitions, independent of the kernels.

Volumes are the 4 x 4 x 4 arrays of `embeddings` with octants as labels. Every draw is a hash that SQL can make too, so each
operator whose draws are scalars is compared voxel by voxel. Results are single precision on both sides.
"""

from __future__ import annotations

import math

from .draws import UNIT as WORD

V = """WITH v AS (SELECT vec_id, pos, pos // 16 AS z, pos // 4 % 4 AS y, pos % 4 AS x, (pos // 32 * 4 + pos // 8 % 2 * 2 + pos // 2 % 2)::INTEGER AS label, v FROM (SELECT vec_id, unnest(range(len(embedding)))::INTEGER AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)),
s AS (SELECT vec_id, min(v) AS lo, max(v) AS hi, avg(v) AS m, stddev_pop(v) AS sp, stddev_samp(v) AS ss FROM v GROUP BY vec_id)"""
TABLES = 8

#: Parameters of the queries, where the defaults would change nothing or name no input.
PARAMS = {
    "RandomDomainTransferGPU": {"bank": {"a__b": [[i / 15 * (k + 1) / TABLES for i in range(16)] for k in range(TABLES)]}},
    "ArtifactTransform": dict.fromkeys(("motion", "ghosting", "spike", "bias_field", "blur", "noise", "swap"), True),
    "SpatialCustomTransform": dict.fromkeys(("flip", "affine", "elastic", "anisotropy"), True),
    "RandomClampGPU": {"max_clamp_amount": 0.2},
    "RandomCropTransformGPU": {"crop": [0.3, 0.9]},
    "RandomFlipTransformGPU": {"flip_axis": [0, 1, 2]},
    "MirrorTransform": {"flip_axis": [0, 1, 2]},
    "RedistributeTransform": {"retain_stats": True},
}


def _table(values: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"{x!r}::DOUBLE" if isinstance(x, float) else str(x) for x in v) + ")" for v in values) + ")"


def _mirror(c: str) -> str:
    return f"(CASE WHEN {c} < 0 THEN -({c}) WHEN {c} > 3 THEN 6 - ({c}) ELSE {c} END)"


def _hat(sizes_in: int, sizes_out: int, corners: bool = False) -> list[list[float]]:
    """Linear resampling as a matrix: weight of each old sample in each new one."""
    out = []
    for i in range(sizes_out):
        at = i * (sizes_in - 1) / max(1, sizes_out - 1) if corners else min(max((i + 0.5) * sizes_in / sizes_out - 0.5, 0.0), sizes_in - 1.0)
        out.append([max(0.0, 1 - abs(at - p)) for p in range(sizes_in)])
    return out


def oracles(seed: int) -> dict[str, str]:
    def u(op: str, slot: str, key: str = "vec_id") -> str:
        """A uniform draw; slot is text, with {k} for a label."""
        parts = slot.split("{k}")
        text = f"'{slot}'" if len(parts) == 1 else f"('{parts[0]}' || label || '{parts[1]}')"
        return f"(('0x' || substr(md5(concat_ws('|', '{seed}', '{op}', {text}, ({key})::VARCHAR)), 1, 8))::UBIGINT / {WORD:.1f}::DOUBLE)"

    def between(op: str, slot: str, low: float, high: float) -> str:
        return f"({low!r}::DOUBLE + {high - low!r}::DOUBLE * {u(op, slot)})"

    def halves(op: str, slot: str, low: float, high: float) -> str:
        return f"(CASE WHEN {u(op, slot + '.half')} < 0.5 THEN {between(op, slot, low, 1.0)} ELSE {between(op, slot, 1.0, high)} END)"

    def full(n: str, keep: str = "", ctes: str = "", label: str = "label") -> str:
        """n: a query for vec_id, pos, label, w. keep: bring back mean and deviation, as the GPU or CPU variants do."""
        value, more = "w", ""
        if keep:
            more = ", r AS (SELECT vec_id, avg(w) AS nm, stddev_samp(w) AS ns FROM n GROUP BY vec_id)"
            value = "(w - nm) / " + ("(ns + 1e-8)" if keep == "GPU" else "greatest(ns, 1e-7)") + " * ss + m"
        join = " JOIN s USING (vec_id) JOIN r USING (vec_id)" if keep else ""
        return f"{V}{ctes}, n AS ({n}){more}\nSELECT vec_id AS sample_id, pos, round(({value})::FLOAT::DOUBLE, 5) + 0.0 AS v, {label} AS label FROM n{join}"

    def point(expr: str, keep: str = "", ctes: str = "", join: str = "") -> str:
        return full(f"SELECT vec_id, pos, label, {expr} AS w FROM v JOIN s USING (vec_id){join}", keep, ctes)

    out: dict[str, str] = {}
    unit = "((v - lo) / (hi - lo + 1e-5))"
    out["ZscoreNormalizationGPU"] = point("CASE WHEN lo = hi THEN v ELSE (v - m) / greatest(sp, 1e-8) END")
    out["ZscoreNormalization"] = point("(v - m) / greatest(ss, 1e-8)")
    for stem, f in (("Log1p", "ln(1 + {})"), ("Sqrt", "sqrt({})"), ("Sin", "sin({})"), ("Exp", "exp({})"), ("Sigmoid", "1 / (1 + exp(-{}))")):
        out[f"Random{stem}GPU"] = out[f"{stem}Transform"] = point(f.format(unit))
    out["RandomInverseGPU"] = point("hi - v")
    out["RandomBrightnessGPU"] = point("v * " + between("RandomBrightnessGPU", "factor", 0.5, 1.5))
    out["MultiplicativeBrightnessTransform"] = point("v * " + halves("MultiplicativeBrightnessTransform", "factor", 0.75, 1.25))
    power = "(pow((v - lo) / (hi - lo + 1e-8), {g}) * (hi - lo) + lo)"
    negative = "(-(pow((hi - v) / (hi - lo + 1e-8), {g}) * (hi - lo) - hi))"
    out["RandomGammaGPU"] = point(power.format(g=between("RandomGammaGPU", "gamma", 0.7, 1.5)))
    out["RandomInvGammaGPU"] = point(negative.format(g=between("RandomInvGammaGPU", "gamma", 0.7, 1.5)))
    out["GammaTransform"] = point(power.format(g=halves("GammaTransform", "gamma", 0.7, 1.5)), "GPU")
    out["InvertedGammaTransform"] = point(negative.format(g=halves("InvertedGammaTransform", "gamma", 0.7, 1.5)), "GPU")
    out["RandomContrastGPU"] = point(f"(v - m) * {between('RandomContrastGPU', 'factor', 0.75, 1.25)} + m")
    out["ContrastTransform"] = point(f"least(greatest((v - m) * {halves('ContrastTransform', 'factor', 0.75, 1.25)} + m, lo), hi)")

    bins = ",\nb AS (SELECT vec_id, pos, least(floor((v - lo) / ((hi - lo) / 256 + 1e-10)), 255) AS bin FROM v JOIN s USING (vec_id)), c AS (SELECT vec_id, pos, count(*) OVER (PARTITION BY vec_id ORDER BY bin) AS cdf FROM b), e AS (SELECT vec_id, pos, cdf, min(cdf) OVER (PARTITION BY vec_id) AS base FROM c)"
    out["RandomHistogramEqualizationGPU"] = point("CASE WHEN hi <= lo THEN v ELSE least(greatest((cdf - base) / greatest(64 - base, 1e-10), 0), 1) * (hi - lo) + lo END", "", bins, " JOIN e USING (vec_id, pos)")
    edge = "(i * ((hi - lo) / 256) + lo)"
    bins = f""",
b AS (SELECT vec_id, pos, len(list_filter(range(1, 256), lambda i: {edge} <= v)) AS bin, len(list_filter(range(1, 256), lambda i: {edge} < v)) AS at FROM v JOIN s USING (vec_id)),
c AS (SELECT a.vec_id, a.pos, count(*) FILTER (WHERE o.bin <= a.at) AS cdf, count(*) FILTER (WHERE o.bin = 0) AS base FROM b a JOIN b o USING (vec_id) GROUP BY a.vec_id, a.pos)"""
    out["HistogramEqualTransform"] = point("CASE WHEN hi <= lo THEN v ELSE (cdf - base) / greatest(64 - base, 1e-10) * (hi - lo) + lo END", "", bins, " JOIN c USING (vec_id, pos)")

    terms = [(i, j, k) for i in range(4) for j in range(4 - i) for k in range(4 - i - j)]
    axis = {c: f"(2 * {c} / 3.0 - 1)" for c in "xyz"}
    out["RandomBiasFieldGPU"] = point("v * exp(" + " + ".join(f"{between('RandomBiasFieldGPU', f'c{i}{j}{k}', -0.5, 0.5)} * pow({axis['x']}, {i}) * pow({axis['y']}, {j}) * pow({axis['z']}, {k})" for i, j, k in terms) + ")")
    quantile = lambda p: f"a[floor({p})::INT + 1] + ({p} - floor({p})) * (a[least(floor({p})::INT + 2, 64)] - a[floor({p})::INT + 1])"
    low, high = u("RandomClampGPU", "low"), u("RandomClampGPU", "high")
    ordered = f",\no AS (SELECT vec_id, list_sort(list(v)) AS a, 0.2::DOUBLE * {low} * 63 AS p, (1 - 0.2::DOUBLE * {high}) * 63 AS q FROM v GROUP BY vec_id), t AS (SELECT vec_id, {quantile('p')} AS ql, {quantile('q')} AS qh FROM o)"
    out["RandomClampGPU"] = point("least(greatest(v, ql), qh)", "", ordered, " JOIN t USING (vec_id)")

    cube = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]

    def near(expr: str, taps: str, reflect: bool, join: str = "") -> str:
        """Sums over neighbours: expr of n.v and the taps k."""
        at = [_mirror(f"(v.{c} + k.{o})") if reflect else f"(v.{c} + k.{o})" for c, o in zip("zyx", "ijk", strict=True)]
        return f"SELECT v.vec_id, v.pos, v.label, {expr} AS w FROM v CROSS JOIN {taps}{join} LEFT JOIN v o ON o.vec_id = v.vec_id AND o.z = {at[0]} AND o.y = {at[1]} AND o.x = {at[2]} GROUP BY ALL"

    laplace = _table([(*c, 26.0 if c == (0, 0, 0) else -1.0) for c in cube]) + " AS k(i, j, k, w)"
    total = "sum(coalesce(o.v, 0) * k.w)"
    out["RandomLaplaceGPU"] = full(near(total, laplace, True), "GPU")
    out["LaplaceConvTransform"] = full(near(total, laplace, False))
    # fixed values: 9, 30 and 100 along the middle of each face, as the operator is defined
    face = lambda a, b: (9.0, 30.0, 100.0)[(a == 0) + (b == 0)]
    scharr = _table([(i, j, k, i * face(j, k), j * face(i, k), k * face(i, j)) for i, j, k in cube]) + " AS k(i, j, k, a, b, c)"
    edges = " + ".join(f"abs(sum(coalesce(o.v, 0) * k.{c}))" for c in "abc")
    out["RandomScharrGPU"] = full(near(edges, scharr, True), "GPU")
    out["ScharrConvTransform"] = full(near(edges, scharr, False))
    plain = _table(cube) + " AS k(i, j, k)"
    for op in ("RandomGaussianBlurGPU", "GaussianBlurTransform", "RandomUnsharpMaskGPU"):
        weights = [f"exp(-1 / (2 * pow({between(op, f'sigma.{c}', 0.0, 1.0)}, 2)))" for c in "zyx"]
        ctes = f",\ng AS (SELECT vec_id, {', '.join(f'{w} AS g{c}' for w, c in zip(weights, 'zyx', strict=True))} FROM s)"
        product = " * ".join(f"(CASE WHEN k.{o} = 0 THEN 1 ELSE g{c} END) / (1 + 2 * g{c})" for c, o in zip("zyx", "ijk", strict=True))
        at = [_mirror(f"(v.{c} + k.{o})") for c, o in zip("zyx", "ijk", strict=True)]
        blur = f"SELECT v.vec_id, v.pos, v.label, v.v, sum(o.v * {product}) AS w FROM v CROSS JOIN {plain} JOIN g ON g.vec_id = v.vec_id JOIN v o ON o.vec_id = v.vec_id AND o.z = {at[0]} AND o.y = {at[1]} AND o.x = {at[2]} GROUP BY v.vec_id, v.pos, v.label, v.v"
        out[op] = full(blur if op != "RandomUnsharpMaskGPU" else f"SELECT vec_id, pos, label, v + {between(op, 'amount', 0.0, 1.5)} * (v - w) AS w FROM ({blur})", "", ctes)

    for op in ("RandomFlipTransformGPU", "MirrorTransform"):
        none = " AND ".join(f"{u(op, f'axis.{a}')} >= 0.5" for a in range(3))
        flips = [f"CASE WHEN {u(op, f'axis.{a}')} < 0.5 OR ({none} AND least(floor({u(op, 'forced')} * 3), 2) = {a}) THEN 3 - {c} ELSE {c} END" for a, c in enumerate("zyx")]
        out[op] = full(f"SELECT vec_id, ({flips[0]}) * 16 + ({flips[1]}) * 4 + ({flips[2]}) AS pos, label, v AS w FROM v")
    op = "RandomCropTransformGPU"
    sizes = {c: f"greatest(1, round_even({between(op, f'crop.{c}', 0.3, 0.9)} * 4, 0))" for c in "xyz"}
    box = f",\nc AS (SELECT vec_id, {', '.join(f'{sizes[c]} AS n{c}, round_even({u(op, f"pos.{c}")} * (4 - {sizes[c]}), 0) AS p{c}' for c in 'xyz')} FROM s)"
    inside = " AND ".join(f"{c} >= p{c} AND {c} < p{c} + n{c}" for c in "xyz")
    out[op] = full(f"SELECT vec_id, pos, CASE WHEN {inside} THEN label ELSE 0 END AS label, CASE WHEN {inside} THEN v ELSE lo END AS w FROM v JOIN s USING (vec_id) JOIN c USING (vec_id)", "", box)

    resample = []
    for m in range(1, 5):
        down, up = _hat(4, m), _hat(m, 4)
        resample += [(m, i, p, sum(up[i][j] * down[j][p] for j in range(m))) for i in range(4) for p in range(4)]
    mix = _table([r for r in resample if r[3]])
    for op in ("RandomLowResTransformGPU", "SimulateLowResolutionTransform", "RandomAcqTransformGPU"):
        if op == "RandomAcqTransformGPU":
            f = {c: f"(CASE WHEN least(floor({u(op, 'axis')} * 3), 2) = {a} THEN {between(op, 'scale', 0.3, 1.0)} ELSE 1.0 END)" for a, c in enumerate("zyx")}
        else:
            f = {c: between(op, f"scale.{c}", 0.3, 1.0) for c in "zyx"}
        ctes = f",\nc AS (SELECT vec_id, {', '.join(f'greatest(1, round_even(4 * {f[c]}, 0)) AS m{c}' for c in 'zyx')} FROM s), k(m, i, p, w) AS {mix}"
        joins = " ".join(f"JOIN k k{c} ON k{c}.m = c.m{c} AND k{c}.i = v.{c}" for c in "zyx")
        out[op] = full(f"SELECT v.vec_id, v.pos, v.label, sum(o.v * kz.w * ky.w * kx.w) AS w FROM v JOIN c ON c.vec_id = v.vec_id {joins} JOIN v o ON o.vec_id = v.vec_id AND o.z = kz.p AND o.y = ky.p AND o.x = kx.p GROUP BY v.vec_id, v.pos, v.label", "", ctes)
    op = "ShapeTransform"
    box = f",\nc AS (SELECT vec_id, {', '.join(f'floor(1 + {4 - 1e-9!r}::DOUBLE * {u(op, f"size.{a}")})::INT AS m{c}' for a, c in enumerate('zyx'))} FROM s)"
    start = {c: f"((4 - m{c}) // 2)" for c in "zyx"}
    inside = " AND ".join(f"{c} >= {start[c]} AND {c} < {start[c]} + m{c}" for c in "zyx")
    out[op] = full(f"SELECT vec_id, ((z - {start['z']}) * my + y - {start['y']}) * mx + x - {start['x']} AS pos, label, v AS w FROM v JOIN c USING (vec_id) WHERE {inside}", "", box)

    pdf = "exp(-pow(a.q - g.mean, 2) / (2 * g.wide * g.wide)) / (g.wide * sqrt(2 * pi()))"
    op = "RandomRedistributeSegGPU"
    ctes = f""",
a AS (SELECT v.*, (v - lo) / greatest(hi - lo, 1e-6) AS q FROM v JOIN s USING (vec_id)),
h AS (SELECT vec_id, floor({between(op, 'times', 1, 4 - 1e-9)})::INT AS times, {u(op, 'inside')} < 0.2 AS inside, {between(op, 'noise', 0.1, 0.3)} AS noise FROM s),
i AS (SELECT vec_id, label, avg(q) AS mean, stddev_pop(q) AS sd FROM a GROUP BY vec_id, label),
e AS (SELECT DISTINCT a.vec_id, r.label, a.pos, a.q FROM a JOIN h ON h.vec_id = a.vec_id JOIN v r ON r.vec_id = a.vec_id AND r.label <> a.label AND greatest(abs(r.z - a.z), abs(r.y - a.y), abs(r.x - a.x)) <= times),
f AS (SELECT vec_id, label, avg(q) AS mean, stddev_pop(q) AS sd FROM e GROUP BY vec_id, label),
g AS (SELECT i.vec_id, i.label, i.mean, greatest({u(op, 'wide.0.{k}', 'i.vec_id').replace('|| label ||', '|| i.label ||')} * noise + 0.4 * abs((i.mean - coalesce(f.mean, 0)) * i.sd / (coalesce(f.sd, 0) + 1e-6)), 0.01) AS wide, -1 + 2 * {u(op, 'factor.0.{k}', 'i.vec_id').replace('|| label ||', '|| i.label ||')} AS factor FROM i JOIN h USING (vec_id) LEFT JOIN f ON f.vec_id = i.vec_id AND f.label = i.label),
d AS (SELECT a.vec_id, a.pos, a.label, a.q, sum(CASE WHEN inside AND g.label <> a.label THEN 0 ELSE {pdf} * g.factor END) AS t FROM a JOIN h USING (vec_id) JOIN g ON g.vec_id = a.vec_id GROUP BY a.vec_id, a.pos, a.label, a.q),
l AS (SELECT *, min(t) OVER (PARTITION BY vec_id) AS tl, max(t) OVER (PARTITION BY vec_id) AS th FROM d),
k AS (SELECT vec_id, pos, label, CASE WHEN th - tl > 1e-8 THEN q + 2 * (t - tl) / (th - tl + 1e-6) ELSE q END AS w FROM l),
r AS (SELECT vec_id, avg(w) AS nm, stddev_pop(w) AS ns FROM k GROUP BY vec_id)"""
    out[op] = full("SELECT vec_id, pos, label, (w - nm) / greatest(ns, 1e-7) * sp + m AS w FROM k JOIN r USING (vec_id) JOIN s USING (vec_id)", "", ctes)
    op = "RedistributeTransform"
    ctes = f""",
a AS (SELECT v.*, (v - lo) / greatest(hi - lo, 1e-6) AS q FROM v JOIN s USING (vec_id)),
h AS (SELECT vec_id, {u(op, 'inside')} < 0.2 AS inside FROM s),
i AS (SELECT vec_id, label, avg(q) AS mean, stddev_samp(q) AS sd FROM a WHERE label > 0 GROUP BY vec_id, label),
e AS (SELECT DISTINCT a.vec_id, r.label, a.pos, a.q FROM a JOIN v r ON r.vec_id = a.vec_id AND r.label <> a.label AND r.label > 0 AND abs(r.z - a.z) + abs(r.y - a.y) + abs(r.x - a.x) <= 3),
f AS (SELECT vec_id, label, avg(q) AS mean, stddev_samp(q) AS sd FROM e GROUP BY vec_id, label),
g AS (SELECT i.vec_id, i.label, i.mean, greatest(0.2::DOUBLE * {u(op, 'wide.{k}', 'i.vec_id').replace('|| label ||', '|| i.label ||')} + 0.4 * abs((i.mean - f.mean) * i.sd / (f.sd + 1e-6)), 0.01) AS wide, -1 + 2 * {u(op, 'factor.{k}', 'i.vec_id').replace('|| label ||', '|| i.label ||')} AS factor FROM i JOIN f ON f.vec_id = i.vec_id AND f.label = i.label),
d AS (SELECT a.vec_id, a.pos, a.label, a.q, sum(CASE WHEN inside AND g.label <> a.label THEN 0 ELSE {pdf} * g.factor END) AS t FROM a JOIN h USING (vec_id) JOIN g ON g.vec_id = a.vec_id GROUP BY a.vec_id, a.pos, a.label, a.q)"""
    out[op] = full("SELECT vec_id, pos, label, q + 2 * t / (max(abs(t)) OVER (PARTITION BY vec_id) + 1e-6) AS w FROM d", "CPU", ctes)

    op = "RandomDomainTransferGPU"
    taps = [math.exp(-(t * t) / 2) for t in range(-3, 4)]
    gauss = _table([(t - 3, x / sum(taps)) for t, x in enumerate(taps)])
    at = [_mirror(f"(b.{c} + k{c}.t)") for c in "zyx"]
    ctes = f""",
k(t, w) AS {gauss}, b AS (SELECT pos, z, y, x, label FROM v WHERE vec_id = (SELECT min(vec_id) FROM v)),
f AS (SELECT b.pos, sum(kz.w * ky.w * kx.w * (o.label + 1) / {TABLES}.0) AS level FROM b CROSS JOIN k kz CROSS JOIN k ky CROSS JOIN k kx JOIN b o ON o.z = {at[0]} AND o.y = {at[1]} AND o.x = {at[2]} GROUP BY b.pos),
o AS (SELECT vec_id, list_sort(list(v)) AS a, 0.01::DOUBLE * 63 AS p, 0.99::DOUBLE * 63 AS q FROM v GROUP BY vec_id),
t AS (SELECT vec_id, {quantile('p')} AS ql, {quantile('q')} AS qh FROM o),
e AS (SELECT vec_id, pos, label, least(greatest((v - ql) / greatest(qh - ql, 1e-8), 0), 1) * level AS w FROM v JOIN t USING (vec_id) JOIN f USING (pos)),
r AS (SELECT vec_id, avg(w) AS nm, stddev_pop(w) AS ns FROM e GROUP BY vec_id)"""
    out[op] = full("SELECT vec_id, pos, label, (w - nm) / greatest(ns, 1e-8) * sp + m AS w FROM e JOIN r USING (vec_id) JOIN s USING (vec_id)", "", ctes)
    flagship = f"""{V},
a AS (SELECT vec_id, pos, (CASE WHEN label > 0 THEN v * {between('RandomBrightnessGPU', 'factor', 0.5, 1.5)} ELSE v END)::FLOAT::DOUBLE AS w FROM v),
b AS (SELECT vec_id, pos, sqrt((w - min(w) OVER p) / (max(w) OVER p - min(w) OVER p + 1e-5))::FLOAT::DOUBLE AS w FROM a WINDOW p AS (PARTITION BY vec_id)),
c AS (SELECT vec_id, pos, (CASE WHEN min(w) OVER p = max(w) OVER p THEN w ELSE (w - avg(w) OVER p) / greatest(stddev_pop(w) OVER p, 1e-8) END)::FLOAT::DOUBLE AS w FROM b WINDOW p AS (PARTITION BY vec_id))
SELECT vec_id AS sample_id, 3 AS fired, round(sum((pos + 1) * w), 5) + 0.0 AS total, count(*)::INTEGER AS n FROM c GROUP BY vec_id"""
    return {f"volume_{k}": v for k, v in out.items()} | {"pipeline_flagship": flagship}
