"""Offline scoring of prediction tables (L1-L7).  Predictions are an input
column; no network runs.  Per-row work is ``zip_with`` / ``aggregate``; the
only shuffles are the per-batch groupings of L4/L5 (batches are bounded)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlake.functions.rand import hash_normal, hash_uniform
from pairlake.functions.schedule import interpolant, lognormal_time, time_shift
from pairlake.functions.util import as_double_array, col
from pairlake.functions.vectors import l2_normalise, row_mean
from pairlake.operators.batching import roll


def sample_time(key, weighting: str = "uniform", path: str = "linear", seed: int = 0, fast: bool = False) -> Column:
    """t per row: uniform B1 draw, or F19 of a normal draw (lognormal sigma)."""
    if weighting == "uniform":
        return hash_uniform(key, seed, 0, fast)
    if weighting == "lognormal":
        return lognormal_time(hash_normal(key, seed, 0, fast), path)
    raise ValueError(f"unknown weighting {weighting!r}")


def noise(x, key, seed: int = 1, fast: bool = False) -> Column:
    """Element-wise standard normal draws keyed by (row key, position)."""
    return F.transform(as_double_array(x), lambda v, i: hash_normal(key, seed, i, fast))


def noised_pairs(df: DataFrame, x: str, key: str, weighting: str = "uniform", path: str = "linear",
                 shift: bool = False, shift_base: int = 4096, seed: int = 0, fast: bool = False) -> DataFrame:
    """L1: t (optionally time-shifted with dim = tensor size), noise eps,
    x_t = alpha x + sigma eps and the velocity target d_alpha x + d_sigma eps.
    ``fast`` draws by xxhash64 instead of the portable md5."""
    t = sample_time(key, weighting, path, seed, fast)
    if shift:
        t = time_shift(t, F.size(x), shift_base)
    out = df.withColumn("t", t).withColumn("eps", noise(x, key, seed + 1, fast))
    ip = interpolant("t", path)
    out = out.withColumn("_ip", ip)
    xs = as_double_array(x)
    out = out.withColumn("x_t", F.zip_with(xs, "eps", lambda a, e: F.col("_ip.alpha") * a + F.col("_ip.sigma") * e))
    out = out.withColumn("target", F.zip_with(xs, "eps",
                                              lambda a, e: F.col("_ip.d_alpha") * a + F.col("_ip.d_sigma") * e))
    return out.drop("_ip")


def sq_err(pred, target) -> Column:
    return F.zip_with(as_double_array(pred), as_double_array(target), lambda p, q: (p - q) * (p - q))


def denoise_loss(pred, target) -> Column:
    """L2: per-row mean of (pred - target)^2."""
    return row_mean(sq_err(pred, target))


def projection_loss(z, z_tilde, dim: int) -> Column:
    """L3 per row: mean over tokens of -cos(z_j, z~_j), tokens being
    consecutive ``dim``-wide slices of the flattened rows."""
    a, b = as_double_array(z), as_double_array(z_tilde)
    n_tok = (F.size(a) / F.lit(dim)).cast("int")
    per_tok = F.transform(F.sequence(F.lit(0), n_tok - 1), lambda j: F.aggregate(
        F.zip_with(l2_normalise(F.slice(a, j * dim + 1, dim)), l2_normalise(F.slice(b, j * dim + 1, dim)),
                   lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v))
    return -F.aggregate(per_tok, F.lit(0.0), lambda s, v: s + v) / n_tok


def contrastive_loss(df: DataFrame, batch: str, pos: str, pred: str, target: str, t: str | None = None,
                     weighting: str = "uniform") -> DataFrame:
    """L4 per batch: -mean over rows and elements of (pred - rolled target)^2,
    the target rolled by one row inside the batch (W2); ``linear`` weights
    each row's errors by its t."""
    r = roll(df, batch, pos, target, "_rolled")
    e = sq_err(pred, "_rolled")
    if weighting == "linear":
        if t is None:
            raise ValueError("linear weighting needs t")
        e = F.transform(e, lambda v: v * F.col(t))
    elif weighting != "uniform":
        raise ValueError(f"unknown weighting {weighting!r}")
    per_row = r.select(batch, F.aggregate(e, F.lit(0.0), lambda s, v: s + v).alias("_s"), F.size(e).alias("_n"))
    return per_row.groupBy(batch).agg((-F.sum("_s") / F.sum("_n")).alias("cfm_loss"))


def total_loss(per_row: DataFrame, batch: str, cfm: DataFrame, proj_coeff: float = 0.5,
               cfm_coeff: float = 0.05) -> DataFrame:
    """L5 per batch: mean denoising loss + proj_coeff * mean projection loss +
    cfm_coeff * contrastive loss."""
    m = per_row.groupBy(batch).agg(F.avg("denoise").alias("denoise"), F.avg("proj").alias("proj"))
    j = m.join(cfm, batch)
    return j.withColumn("loss", F.col("denoise") + F.lit(proj_coeff) * F.col("proj")
                        + F.lit(cfm_coeff) * F.col("cfm_loss"))


def batch_losses(df: DataFrame, batch: str, pos: str, pred: str, target: str, dim: int, t: str | None = None,
                 proj_coeff: float = 0.5, cfm_coeff: float = 0.05) -> DataFrame:
    """L2-L5 per batch from one roll window and one aggregation, which share
    the shuffle on ``batch``: mean denoising and projection losses, the
    contrastive loss (and its ``t``-weighted form if ``t`` is given), total."""
    e = roll(df, batch, pos, target, "_rolled").select(
        batch, denoise_loss(pred, target).alias("_d"), projection_loss(pred, target, dim).alias("_p"),
        F.aggregate(sq_err(pred, "_rolled"), F.lit(0.0), lambda s, v: s + v).alias("_s"), F.size(pred).alias("_n"),
        (F.col(t) if t else F.lit(None).cast("double")).alias("_t"))
    out = e.groupBy(batch).agg(F.avg("_d").alias("denoise"), F.avg("_p").alias("proj"),
                               (-F.sum("_s") / F.sum("_n")).alias("cfm_loss"),
                               (-F.sum(F.col("_s") * F.col("_t")) / F.sum("_n")).alias("cfm_linear"))
    out = out if t else out.drop("cfm_linear")
    return out.withColumn("loss", F.col("denoise") + F.lit(proj_coeff) * F.col("proj")
                          + F.lit(cfm_coeff) * F.col("cfm_loss"))


# ---------------------------------------------------------------- posterior


def posterior(params, deterministic: bool = False) -> Column:
    """Channels split in halves -> mean / logvar; logvar clamped to
    [-30, 20]; std = exp(logvar/2), var = exp(logvar); zeros when
    deterministic.  Returns struct(mean, logvar, std, var)."""
    p = as_double_array(params)
    half = (F.size(p) / 2).cast("int")
    mean = F.slice(p, 1, half)
    logvar = F.transform(F.slice(p, half + 1, half), lambda v: F.least(F.greatest(v, F.lit(-30.0)), F.lit(20.0)))
    if deterministic:
        std = var = F.transform(mean, lambda v: F.lit(0.0))
    else:
        std = F.transform(logvar, lambda v: F.exp(F.lit(0.5) * v))
        var = F.transform(logvar, lambda v: F.exp(v))
    return F.struct(mean.alias("mean"), logvar.alias("logvar"), std.alias("std"), var.alias("var"))


def _sum(arr) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)


def posterior_kl(post, other=None) -> Column:
    """0.5 * sum(mu^2 + var - 1 - logvar), or against another posterior
    0.5 * sum((mu - mu_o)^2 / var_o + var / var_o - 1 - logvar + logvar_o)."""
    p = col(post)
    if other is None:
        terms = F.zip_with(F.zip_with(p["mean"], p["var"], lambda m, v: m * m + v),
                           p["logvar"], lambda a, lv: a - F.lit(1.0) - lv)
        return F.lit(0.5) * _sum(terms)
    o = col(other)
    first = F.zip_with(F.zip_with(p["mean"], o["mean"], lambda a, b: (a - b) * (a - b)), o["var"], lambda d, vo: d / vo)
    second = F.zip_with(p["var"], o["var"], lambda v, vo: v / vo)
    third = F.zip_with(p["logvar"], o["logvar"], lambda lv, lvo: lvo - lv)
    s = F.zip_with(F.zip_with(first, second, lambda a, b: a + b), third, lambda a, b: a + b - F.lit(1.0))
    return F.lit(0.5) * _sum(s)


def posterior_nll(post, sample) -> Column:
    """0.5 * sum(ln 2 pi + logvar + (x - mu)^2 / var)."""
    p = col(post)
    x = as_double_array(sample)
    sq = F.zip_with(x, p["mean"], lambda a, m: (a - m) * (a - m))
    t = F.zip_with(F.zip_with(sq, p["var"], lambda d, v: d / v), p["logvar"],
                   lambda a, lv: a + lv + F.lit(math.log(2 * math.pi)))
    return F.lit(0.5) * _sum(t)


def posterior_mode(post) -> Column:
    """The mean."""
    return col(post)["mean"]


def posterior_sample(post, key, seed: int = 0, fast: bool = False) -> Column:
    """Mean + std * eps with eps keyed by (row key, position)."""
    p = col(post)
    pairs = F.arrays_zip(p["mean"].alias("m"), p["std"].alias("s"))
    return F.transform(pairs, lambda z, i: z["m"] + z["s"] * hash_normal(key, seed, i, fast))
