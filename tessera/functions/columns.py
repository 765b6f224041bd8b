"""Scalar rules as Columns: gene names, interaction modes, responses, edge weights, pool sizes, colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark an interaction as bound to the membrane, or as secreted.
MEMBRANE = ["membrane", "membranous", "juxtacrine", "contact", "cadherin", "integrin", "itga", "itgb", "desmosome", "tight junction", "gap junction", "adhesion", "cell-cell", "cell–cell", "receptor complex"]
SECRETED = ["secreted", "soluble", "paracrine", "endocrine", "chemokine"]


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dbl(x: float) -> Column:
    return F.lit(float(x)).cast("double")


def gene_name(x: str | Column) -> Column:
    """Trimmed, in upper case, without a version suffix."""
    return F.regexp_replace(F.upper(F.trim(_c(x).cast("string"))), r"\.\d+$", "")


def is_complex(x: str | Column) -> Column:
    """Names of several genes at once."""
    return _c(x).rlike(r"(?:^COMPLEX:)|[_/+\s;]")


def mode_of(x: str | Column, default: str | None = None) -> Column:
    """'mb' if any membrane word occurs, else 'secreted' if any of its words does, else the default."""
    low = F.lower(_c(x))
    return F.when(low.rlike("|".join(MEMBRANE)), "mb").when(low.rlike("|".join(SECRETED)), "secreted").otherwise(F.lit(default))


def hill(x: Column, k: float) -> Column:
    up = F.greatest(x, dbl(0))
    return up / (dbl(k) + up + dbl(1e-12))


def tf_gain(delta: Column) -> Column:
    """Between 1 and 2, rising with the activity of the receiver's transcription factors."""
    return F.least(F.greatest(dbl(1) + delta / (dbl(0.5) + delta + dbl(1e-12)), dbl(1)), dbl(2))


def gate(z: Column, beta_plus: Column, beta_minus: float = 0.0) -> Column:
    return F.exp(F.greatest(beta_plus, dbl(0)) * F.greatest(z, dbl(0)) - dbl(max(beta_minus, 0.0)) * F.greatest(-z, dbl(0)))


def radial(d: Column, reach: Column) -> Column:
    return F.exp(-F.pow(d / F.greatest(reach, dbl(1e-9)), dbl(2)))


def in_contact(d: Column, h: Column, share: float = 0.9) -> Column:
    return (d <= dbl(share) * h).cast("double")


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, dbl(low)), dbl(high))


def grid_bin(v: Column, low: Column, high: Column, cells: int, factor: int = 1) -> Column:
    """Cell of a coordinate when [low, high) is cut in ``cells / factor`` cells; truncated towards zero."""
    return (dbl(cells) * (v - low) / (dbl(factor) * (high - low))).cast("int")


def pixel_of(v: Column, low: Column, high: Column, length: int) -> Column:
    return ((v - low) / (high - low) * dbl(length - 1)).cast("int")


def sigma_floor(along: Column, across: Column, least: float = 0.68) -> tuple[Column, Column]:
    """The smaller of two diffusivities is raised to least**2."""
    low = dbl(least * least)
    return F.when(along < across, F.greatest(along, low)).otherwise(along), F.when(along < across, across).otherwise(F.greatest(across, low))


def pool_size(policy: str, d: Column, h: Column, r_rel: float = 1.0, sigma_rel: float = 0.5, k: float = 1.0, c: float = 0.5, r_min: float = 0.5, r_max: float = 3.0) -> tuple[Column, Column]:
    """Radius and spread of an edge's pixel pool."""
    if policy == "fixed":
        return dbl(r_rel) * h, dbl(sigma_rel) * h
    if policy == "edge":
        r = dbl(k) * d
    elif policy == "edge_clip":
        r = F.least(F.greatest(dbl(k) * d, dbl(r_min) * h), dbl(r_max) * h)
    elif policy == "adaptive":
        r = F.least(dbl(k) * d, dbl(3.0) * h)
    else:
        raise ValueError(f"no such policy: {policy}")
    return r, dbl(c) * r


def to_uint8(v: Column, is_float: bool) -> Column:
    """Floats from 0..1 to 0..255, truncated; other numbers unchanged."""
    return (clip(v, 0, 1) * dbl(255)).cast("int") if is_float else v.cast("int")


def rgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L*a*b* (D65) of sRGB in 0..1."""
    lin = [F.when(x > 0.04045, F.pow((x + 0.055) / 1.055, dbl(2.4))).otherwise(x / 12.92) for x in (r, g, b)]
    rows = ((0.412453, 0.357580, 0.180423, 0.95047), (0.212671, 0.715160, 0.072169, 1.0), (0.019334, 0.119193, 0.950227, 1.08883))
    f = []
    for p, q, s, white in rows:
        t = (lin[0] * p + lin[1] * q + lin[2] * s) / white
        f.append(F.when(t > 0.008856, F.cbrt(t)).otherwise(dbl(7.787) * t + dbl(16 / 116)))
    return dbl(116) * f[1] - dbl(16), dbl(500) * (f[0] - f[1]), dbl(200) * (f[1] - f[2])


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """Saturation and value of RGB in 0..1."""
    v, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(v > 0, (v - low) / v).otherwise(dbl(0)), v
