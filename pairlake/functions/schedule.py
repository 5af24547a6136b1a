"""Time schedules of the training objective as Column math."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlake.functions.util import col


def time_shift(t, dim, base: int = 4096) -> Column:
    """s = sqrt(dim / base); s*t / (1 + (s - 1) t), clamped to [0, 1]."""
    d = F.lit(dim) if isinstance(dim, int) else col(dim)
    s = F.sqrt(d.cast("double") / F.lit(float(base)))
    tt = col(t).cast("double")
    shifted = (s * tt) / (F.lit(1.0) + (s - F.lit(1.0)) * tt)
    return F.least(F.greatest(shifted, F.lit(0.0)), F.lit(1.0))


def interpolant(t, path: str = "linear") -> Column:
    """struct(alpha, sigma, d_alpha, d_sigma) of the path at t."""
    tt = col(t).cast("double")
    if path == "linear":
        return F.struct((F.lit(1.0) - tt).alias("alpha"), tt.alias("sigma"),
                        F.lit(-1.0).alias("d_alpha"), F.lit(1.0).alias("d_sigma"))
    if path == "cosine":
        a = tt * F.lit(math.pi / 2)
        return F.struct(F.cos(a).alias("alpha"), F.sin(a).alias("sigma"),
                        (F.lit(-math.pi / 2) * F.sin(a)).alias("d_alpha"),
                        (F.lit(math.pi / 2) * F.cos(a)).alias("d_sigma"))
    raise ValueError(f"unknown path {path!r}")


def lognormal_time(z, path: str = "linear") -> Column:
    """sigma = exp(z); linear sigma / (1 + sigma); cosine (2/pi) atan(sigma)."""
    s = F.exp(col(z).cast("double"))
    if path == "linear":
        return s / (F.lit(1.0) + s)
    if path == "cosine":
        return F.lit(2 / math.pi) * F.atan(s)
    raise ValueError(f"unknown path {path!r}")
