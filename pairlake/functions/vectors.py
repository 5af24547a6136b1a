"""Row-vector kernels as higher-order Column expressions.

Everything is ``transform`` / ``zip_with`` / ``aggregate`` so it stays in the
JVM; arrays are promoted to double before arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlake.functions.util import as_double_array, col

FLOAT32_MAX = 3.4028234663852886e38


def arr_sum(x) -> Column:
    return F.aggregate(as_double_array(x), F.lit(0.0), lambda a, v: a + v)


def row_sum(x) -> Column:
    """Sum over all non-batch dims of a flattened tensor."""
    return arr_sum(x)


def row_mean(x) -> Column:
    """Mean over all non-batch dims (NULL for an empty array)."""
    return arr_sum(x) / F.nullif(F.size(col(x)), F.lit(0))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(as_double_array(a), as_double_array(b), lambda u, v: u * v),
                       F.lit(0.0), lambda s, v: s + v)


def sq_norm(x) -> Column:
    return F.aggregate(as_double_array(x), F.lit(0.0), lambda s, v: s + v * v)


def sq_dist(a, b) -> Column:
    """F23/V1 (expression form): squared Euclidean distance, summed directly."""
    return F.aggregate(
        F.zip_with(as_double_array(a), as_double_array(b), lambda u, v: (u - v) * (u - v)),
        F.lit(0.0), lambda s, v: s + v)


def l2_normalise(x, eps: float = 1e-12) -> Column:
    """x / max(||x||, eps)."""
    n = F.greatest(F.sqrt(sq_norm(x)), F.lit(eps))
    return F.transform(as_double_array(x), lambda v: v / n)


def softmax(x) -> Column:
    """numerically stable softmax of a row vector."""
    d = as_double_array(x)
    m = F.array_max(d)
    e = F.transform(d, lambda v: F.exp(v - m))
    s = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / s)


def clamp(x, lo=None, hi=None) -> Column:
    """F24 for scalars."""
    c = col(x)
    if lo is not None:
        c = F.greatest(c, F.lit(lo))
    if hi is not None:
        c = F.least(c, F.lit(hi))
    return c


def clamp_array(x, lo=None, hi=None) -> Column:
    return F.transform(as_double_array(x), lambda v: clamp(v, lo, hi))


def nan_to_num(x, posinf: float = FLOAT32_MAX, neginf: float = -FLOAT32_MAX) -> Column:
    """NaN -> 0, +inf -> posinf, -inf -> neginf, element-wise."""
    def fix(v):
        return (F.when(F.isnan(v), F.lit(0.0))
                .when(v == F.lit(float("inf")), F.lit(posinf))
                .when(v == F.lit(float("-inf")), F.lit(neginf))
                .otherwise(v))
    return F.transform(as_double_array(x), fix)


def product(x) -> Column:
    """product of an integer array (1 for an empty one)."""
    return F.aggregate(col(x).cast("array<long>"), F.lit(1).cast("long"), lambda a, v: a * v)


def shape_violation(shape, ref) -> Column:
    """True when ``shape`` does not match ``ref`` (same rank, each dim equal
    unless the reference dim is NULL)."""
    s, r = col(shape), col(ref)
    same = (F.size(s) == F.size(r)) & F.forall(
        F.zip_with(s, r, lambda a, b: b.isNull() | (a == b)), lambda ok: ok)
    return ~F.coalesce(same, F.lit(False))


def assert_shape(shape, ref) -> Column:
    return F.when(shape_violation(shape, ref),
                  F.raise_error(F.lit("tensor shape does not match the reference shape"))).otherwise(F.lit(True))


def slice_channels(x, channels: int, keep: int = 7) -> Column:
    """first ``keep`` channels of a channels-last map, flattened."""
    return F.filter(col(x), lambda v, i: (i % F.lit(channels)) < F.lit(keep))


def affine(x, scale: float = 1.0, bias: float = 0.0) -> Column:
    """x * scale + bias."""
    return F.transform(as_double_array(x), lambda v: v * F.lit(float(scale)) + F.lit(float(bias)))


def pixel_to_unit(x, mode: str = "symmetric", mean=None, std=None, hw: int | None = None) -> Column:
    """uint8 pixels to model input.

    ``symmetric``: x / 127.5 - 1.  ``channel``: (x / 255 - mean[c]) / std[c] with
    c = position div hw (channels-first layout).
    """
    d = as_double_array(x)
    if mode == "symmetric":
        return F.transform(d, lambda v: v / F.lit(127.5) - F.lit(1.0))
    if mode == "channel":
        if mean is None or std is None or hw is None:
            raise ValueError("channel mode needs mean, std and hw")
        m = F.array(*[F.lit(float(v)) for v in mean])
        s = F.array(*[F.lit(float(v)) for v in std])
        return F.transform(d, lambda v, i: (v / F.lit(255.0) - F.element_at(m, (i / hw).cast("int") + 1))
                           / F.element_at(s, (i / hw).cast("int") + 1))
    raise ValueError(f"unknown mode {mode!r}")


def unit_to_pixel(x, mode: str = "sample") -> Column:
    """model output back to uint8 range, truncating like a uint8 cast.

    ``sample``: 255 * (x + 1) / 2; ``decoder``: 127.5 * x + 128;
    ``grid``: 255 * clamp(x, 0, 1) + 0.5 -- each clamped to [0, 255].
    """
    d = as_double_array(x)
    if mode == "sample":
        f = lambda v: F.lit(255.0) * ((v + F.lit(1.0)) / F.lit(2.0))
    elif mode == "decoder":
        f = lambda v: F.lit(127.5) * v + F.lit(128.0)
    elif mode == "grid":
        f = lambda v: F.lit(255.0) * clamp(v, 0.0, 1.0) + F.lit(0.5)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return F.transform(d, lambda v: clamp(f(v), 0.0, 255.0).cast("int"))


def to_rgb(x, channels, hw) -> Column:
    """a 1-channel (channels-first) image becomes 3 channels by repeating
    the channel; 3 channels pass; anything else is an error."""
    c, n = col(channels), col(hw) if not isinstance(hw, int) else F.lit(hw)
    rep = F.flatten(F.array_repeat(F.slice(col(x), F.lit(1), n), 3))
    return (F.when(c == 3, col(x)).when(c == 1, rep)
            .otherwise(F.raise_error(F.lit("to_rgb: expected 1 or 3 channels"))))


def pad_truncate(tokens, length: int = 77, pad=0) -> Column:
    """right-pad with ``pad`` and truncate to ``length``."""
    padded = F.concat(col(tokens), F.array_repeat(F.lit(pad), length))
    return F.slice(padded, 1, length)


def was_truncated(tokens, length: int = 77) -> Column:
    return F.size(col(tokens)) > F.lit(length)
