"""Edge kernels: isotropic, and anisotropic from wavelet energy pooled around each edge.

Edges are (src, dst, d, x1, y1, x2, y2, r, sigma); pixels are one wide table
(y, x, value columns), with the mask applied.  Edges and pixels meet on tiles as
wide as the largest pool, then an ordinary filter; one grouped sum per edge
gives all pooled energies.
"""

from __future__ import annotations

from math import cos, radians

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import dbl, pool_size, sigma_floor

from .scoring import normalise_k

EDGE = ["src", "dst"]


def iso(edges: DataFrame, h: float, kappa: float = 1.0, normalise: bool = False) -> DataFrame:
    """edges with k = exp(-d^2 / 2 sigma^2), sigma = kappa h."""
    sigma = max(kappa * h, 1e-12)
    out = edges.withColumn("k", F.exp(-F.col("d") * F.col("d") / dbl(2 * sigma * sigma)))
    return normalise_k(out) if normalise else out


def framed(edges: DataFrame, points: DataFrame, h: float, policy: str = "fixed", **sizes) -> DataFrame:
    """Edges with both ends' coordinates and their pool's radius and spread."""
    a = points.select(F.col("id").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = points.select(F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    r, sigma = pool_size(policy, F.col("d"), dbl(h), **sizes)
    return edges.join(a, "src").join(b, "dst").withColumn("r", r).withColumn("sigma", sigma)


def _meet(edges: DataFrame, pixels: DataFrame, at: tuple[Column, Column], reach: Column) -> DataFrame:
    """Edges with the pixels of the 3 x 3 tiles around a point of theirs; a tile is as wide as the furthest reach of all edges.

    Pixels are spread over the tiles around them, not edges, of which there are many more: an edge is in one tile only.
    """
    tile = max(edges.agg(F.max(reach)).first()[0] or 0.0, 1e-9)
    step = F.explode(F.array(*(F.lit(k) for k in (-1, 0, 1))))
    own = edges.withColumn("_tx", F.floor(at[0] / dbl(tile))).withColumn("_ty", F.floor(at[1] / dbl(tile)))
    px = pixels.withColumn("_gx", F.floor(F.col("x") / dbl(tile))).withColumn("_gy", F.floor(F.col("y") / dbl(tile))).withColumn("_ox", step).withColumn("_oy", step)
    px = px.withColumn("_tx", F.col("_gx") + F.col("_ox")).withColumn("_ty", F.col("_gy") + F.col("_oy")).drop("_gx", "_gy", "_ox", "_oy")
    return own.join(px, ["_tx", "_ty"]).drop("_tx", "_ty")


def _along() -> tuple[Column, Column]:
    """Unit vector from source to target; null for no length."""
    d = F.when(F.col("d") < 1e-9, None).otherwise(F.col("d"))
    return (F.col("x2") - F.col("x1")) / d, (F.col("y2") - F.col("y1")) / d


def half_disk(edges: DataFrame, pixels: DataFrame, values: list[str]) -> DataFrame:
    """(src, dst, n, values): weighted means over the half disk ahead of the source, or the whole disk if that is empty."""
    ux, uy = _along()
    dx, dy = F.col("x") - F.col("x1"), F.col("y") - F.col("y1")
    rows = _meet(edges, pixels, (F.col("x1"), F.col("y1")), F.col("r")).withColumn("_d2", dx * dx + dy * dy).where(F.col("_d2") <= F.col("r") * F.col("r"))
    rows = rows.withColumn("_w", F.exp(-F.col("_d2") / (dbl(2) * F.col("sigma") * F.col("sigma")))).withColumn("_f", dx * ux + dy * uy >= 0)
    front = lambda e: F.sum(F.when(F.col("_f"), e))
    got = rows.groupBy(*EDGE).agg(F.count("*").alias("n_all"), front(F.lit(1)).alias("n_front"), F.sum("_w").alias("w_all"), front(F.col("_w")).alias("w_front"), *(x for v in values for x in (F.sum(F.col("_w") * F.col(v)).alias(f"{v}_all"), front(F.col("_w") * F.col(v)).alias(f"{v}_front"))))
    pick = lambda c: F.when(F.col("n_front") > 0, F.col(f"{c}_front")).otherwise(F.col(f"{c}_all"))
    return got.select(*EDGE, pick("n").cast("bigint").alias("n"), *((pick(v) / (pick("w") + dbl(1e-12))).alias(v) for v in values))


def _corridor(lateral: float, across: float, along: float) -> tuple[Column, Column]:
    """Whether a pixel is in an edge's corridor, and its weight there before shares are taken."""
    ux, uy = _along()
    dx, dy = F.col("x") - F.col("x1"), F.col("y") - F.col("y1")
    s, l, sp, sl = dx * ux + dy * uy, dy * ux - dx * uy, dbl(across) * F.col("sigma"), dbl(along) * F.col("d")  # noqa: E741
    mid = s - F.col("d") / 2
    return (s >= 0) & (s <= F.col("d")) & (F.abs(l) <= dbl(lateral) * sp), F.exp(-l * l / (dbl(2) * sp * sp)) * F.exp(-mid * mid / (dbl(2) * sl * sl))


def _cap(angle: float) -> tuple[Column, Column]:
    """Whether a pixel is in the cap around an edge's target, and its weight there before shares are taken."""
    ux, uy = _along()
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    d2 = dx * dx + dy * dy
    inside = (d2 <= F.col("r") * F.col("r")) & (d2 > 0) & (-(dx * ux + dy * uy) / F.sqrt(d2) >= dbl(cos(radians(angle))))
    return inside, F.exp(-d2 / (dbl(2) * F.col("sigma") * F.col("sigma")))


def corridor_weights(edges: DataFrame, pixels: DataFrame, lateral: float = 2.0, across: float = 0.5, along: float = 0.5) -> DataFrame:
    """(src, dst, y, x, w): pixels between both ends, within ``lateral`` spreads of the line; weights sum to one.

    The spread across is ``across`` * sigma, along ``along`` * d.  Edges without length have none.
    """
    inside, w = _corridor(lateral, across, along)
    rows = _meet(edges.where("d >= 1e-9"), pixels, ((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2), F.hypot(F.col("d") / 2, dbl(lateral * across) * F.col("sigma")))
    return _shares(rows.where(inside).select(*EDGE, "y", "x", w.alias("w")))


def cap_weights(edges: DataFrame, pixels: DataFrame, angle: float = 20.0) -> DataFrame:
    """(src, dst, y, x, w): pixels around the target within the angle of the way back to the source; weights sum to one."""
    inside, w = _cap(angle)
    rows = _meet(edges.where("d >= 1e-9"), pixels, (F.col("x2"), F.col("y2")), F.col("r"))
    return _shares(rows.where(inside).select(*EDGE, "y", "x", w.alias("w")))


def corridor_and_cap(edges: DataFrame, pixels: DataFrame, values: list[str], lateral: float = 2.0, across: float = 0.5, along: float = 0.5, angle: float = 20.0) -> DataFrame:
    """(src, dst, n, values): what ``pooled`` gives of ``combined`` corridor and cap weights, from sums by edge.

    An edge meets its pixels once, with their values; shares are quotients of the sums, so no row is kept for a pixel of an edge.
    """
    (inner, wc), (capped, wp) = _corridor(lateral, across, along), _cap(angle)
    mid = ((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2)
    reach = F.greatest(F.hypot(F.col("d") / 2, dbl(lateral * across) * F.col("sigma")), F.col("d") / 2 + F.col("r"))
    rows = _meet(edges.where("d >= 1e-9"), pixels.select("y", "x", *values), mid, reach).withColumn("_c", F.when(inner, wc)).withColumn("_p", F.when(capped, wp)).where("_c is not null or _p is not null")
    sums = rows.groupBy(*EDGE).agg(F.count("*").alias("n"), *(F.coalesce(F.sum(w), dbl(0)).alias(f"{w}_t") for w in ("_c", "_p")), *(F.coalesce(F.sum(F.col(w) * F.col(v)), dbl(0)).alias(f"{w}_{v}") for v in values for w in ("_c", "_p")))
    share = lambda v: F.col(f"_c_{v}") / (F.col("_c_t") + dbl(1e-12)) + F.col(f"_p_{v}") / (F.col("_p_t") + dbl(1e-12))
    return sums.select(*EDGE, "n", *((share(v) / (share("t") + dbl(1e-12))).alias(v) for v in values))


def _shares(rows: DataFrame) -> DataFrame:
    total = rows.groupBy(*EDGE).agg(F.sum("w").alias("_t"))
    return rows.join(total, EDGE).withColumn("w", F.col("w") / (F.col("_t") + dbl(1e-12))).drop("_t")


def combined(one: DataFrame, other: DataFrame) -> DataFrame:
    """Weights added pixel by pixel, and shares again."""
    return _shares(one.unionByName(other).groupBy(*EDGE, "y", "x").agg(F.sum("w").alias("w")))


def pooled(weights: DataFrame, pixels: DataFrame, values: list[str]) -> DataFrame:
    """(src, dst, n, values): weighted sums of pixel values."""
    return weights.join(pixels, ["y", "x"]).groupBy(*EDGE).agg(F.count("*").alias("n"), *(F.sum(F.col("w") * F.col(v)).alias(v) for v in values))


def pool(edges: DataFrame, pixels: DataFrame, values: list[str], mode: str = "half") -> DataFrame:
    if mode == "half":
        return half_disk(edges, pixels, values)
    if mode == "corridor":
        return corridor_and_cap(edges, pixels, values)
    raise ValueError(f"no such pool mode: {mode}")


def _stretch(ratio: Column, a_min: float, a_max: float, gamma: float) -> Column:
    a = dbl(1) + dbl(a_max - 1) * F.pow(ratio, dbl(gamma))
    return F.when(a < a_min, dbl(1)).otherwise(F.least(a, dbl(a_max)))


def _turned(edges: DataFrame, h: float) -> DataFrame:
    """k from direction theta and diffusivities along and across it, floored."""
    vx, vy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    p = vx * F.cos("theta") + vy * F.sin("theta")
    q = vy * F.cos("theta") - vx * F.sin("theta")
    along, across = sigma_floor(F.lit(1.0).cast("double"), dbl(1) / F.col("a"))
    return edges.withColumn("k", F.exp(dbl(-0.5) * (p * p / along + q * q / across) / dbl(h * h)))


def wv2_kernel(edges: DataFrame, pixels: DataFrame, h: float, a_min: float = 1.05, a_max: float = 3.0, gamma: float = 1.0, mode: str = "half") -> DataFrame:
    """(src, dst, d, k, a, ratio, theta) from horizontal, vertical and diagonal energy: pixels carry eh, ev and ed."""
    got = edges.join(pool(edges, pixels, ["eh", "ev", "ed"], mode), EDGE, "left")
    sx, sy = F.col("ev") + 0.5 * F.col("ed"), F.col("eh") + 0.5 * F.col("ed")
    got = got.withColumn("ratio", F.coalesce(F.abs(sx - sy) / (sx + sy + dbl(1e-12)), dbl(0)))
    got = got.withColumn("a", F.when(F.col("n").isNull(), dbl(1)).otherwise(_stretch(F.col("ratio"), a_min, a_max, gamma)))
    got = got.withColumn("theta", F.when(F.col("n").isNull() | (sx >= sy), dbl(0)).otherwise(F.acos(dbl(0))))
    return _turned(got, h).select(*EDGE, "d", "k", "a", "ratio", "theta")


def angular_kernel(edges: DataFrame, energies: DataFrame, bands: DataFrame, h: float, a_min: float = 1.05, a_max: float = 3.0, gamma: float = 1.0, least_kappa: float = 0.2) -> DataFrame:
    """(src, dst, d, k, a, ratio, theta) from band energies (src, dst, band, p) and bands (band, theta in radians, kappa).

    Bands under the least concentration are skipped; edges without energy are isotropic.
    """
    got = _directions(energies.groupBy(*EDGE).agg(F.collect_list(F.struct("band", "p")).alias("_terms")), bands, least_kappa)
    return _angular(edges, got, h, a_min, a_max, gamma)


def _directions(terms: DataFrame, bands: DataFrame, least_kappa: float) -> DataFrame:
    """(src, dst, c, s, e) from rows with an array _terms of (band, p): sums formed within the row; the few bands go to every task as one row."""
    own = bands.where(F.col("kappa") >= least_kappa).agg(F.collect_list(F.struct("band", "theta", "kappa")).alias("_bands"))
    term = lambda b: F.transform(F.filter("_terms", lambda t: (t["band"] == b["band"]) & (b["kappa"] * t["p"]).isNotNull()), lambda t: F.struct((b["kappa"] * t["p"]).alias("kp"), b["theta"].alias("theta")))
    rows = terms.crossJoin(F.broadcast(own)).select(*EDGE, F.flatten(F.transform("_bands", term)).alias("_t"))
    total = lambda f: F.when(F.size("_t") > 0, F.aggregate("_t", dbl(0), lambda x, t: x + f(t)))
    return rows.select(*EDGE, total(lambda t: t["kp"] * F.cos(2 * t["theta"])).alias("c"), total(lambda t: t["kp"] * F.sin(2 * t["theta"])).alias("s"), total(lambda t: t["kp"]).alias("e"))


def _angular(edges: DataFrame, got: DataFrame, h: float, a_min: float = 1.05, a_max: float = 3.0, gamma: float = 1.0) -> DataFrame:
    rows = edges.join(got, EDGE, "left")
    rows = rows.withColumn("ratio", F.coalesce(F.least(F.hypot("c", "s") / (F.col("e") + dbl(1e-12)), dbl(0.995)), dbl(0)))
    rows = rows.withColumn("theta", F.coalesce(dbl(0.5) * F.atan2("s", "c"), dbl(0))).withColumn("a", F.when(F.col("e").isNull(), dbl(1)).otherwise(_stretch(F.col("ratio"), a_min, a_max, gamma)))
    return _turned(rows, h).select(*EDGE, "d", "k", "a", "ratio", "theta")


def wv4_kernel(edges: DataFrame, pixels: DataFrame, columns: dict[str, tuple[str, str | None]], bands: DataFrame, h: float, gains: tuple[float, float] = (0.8, 0.2), mode: str = "half", **shape) -> DataFrame:
    """Kernel of an M-band transform; ``columns``: for each band its normalised level-1 and level-2 pixel columns."""
    values = list(dict.fromkeys(c for pair in columns.values() for c in pair if c))
    got = pool(edges, pixels, values, mode)
    terms = []
    for name, (one, two) in columns.items():
        p = F.col(one) * gains[0] + F.col(two) * gains[1] if two else F.col(one) * 1.0
        terms.append(F.struct(F.lit(name).alias("band"), p.cast("double").alias("p")))
    least = shape.pop("least_kappa", 0.2)
    return _angular(edges, _directions(got.select(*EDGE, F.array(*terms).alias("_terms")), bands, least), h, **shape)


def dtcwt_kernel(edges: DataFrame, pixels: DataFrame, bands: dict[str, list[tuple[str, str, str]]], angles: DataFrame, h: float, gains: tuple[float, ...] = (0.7, 0.3), beta: float = 2.0, mode: str = "half", **shape) -> DataFrame:
    """Kernel of complex subbands; ``bands``: for each angle and level the columns of power, real and imaginary part.

    A level counts by its gain times its coherence |sum w W| / sum w |W| to the power beta.
    """
    own = pixels
    for levels in bands.values():
        for _, re, im in levels:
            own = own.withColumn(f"_abs_{re}", F.hypot(re, im))
    values = list(dict.fromkeys(c for levels in bands.values() for p, re, im in levels for c in (p, re, im, f"_abs_{re}")))
    got = pool(edges, own, values, mode)
    terms = []
    for name, levels in bands.items():
        total = dbl(0)
        for gain, (p, re, im) in zip(gains, levels, strict=False):
            total = total + dbl(gain) * F.pow(F.hypot(re, im) / (F.col(f"_abs_{re}") + dbl(1e-12)), dbl(beta)) * F.col(p)
        terms.append(F.struct(F.lit(name).alias("band"), total.alias("p")))
    least = shape.pop("least_kappa", 0.2)
    return _angular(edges, _directions(got.select(*EDGE, F.array(*terms).alias("_terms")), angles, least), h, **shape)
