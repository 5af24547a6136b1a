"""A1 per-channel statistics of flattened tensors and J6 (de)normalisation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlake.functions.util import as_double_array, col
from pairlake.operators.sampling import sample_exact


def _merge(a, b):
    """(n, mean, sum of squared deviations) of two sets together."""
    n = a[0] + b[0]
    if not n:
        return a
    shift = b[1] - a[1]
    return n, a[1] + shift * b[0] / n, a[2] + b[2] + shift * shift * a[0] * b[0] / n


def _channel_partials(channels: int):
    """Arrow batches of tensors -> one row (channel, elements, n, mean, m2) per
    channel and task; ``n`` leaves out null elements."""
    def run(batches):
        acc: dict[int, list] = {}
        for batch in batches:
            x = batch.column(0).drop_null()
            sizes = pc.list_value_length(x).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes[sizes > 0]).tolist():
                per = size // channels
                if not per:
                    raise ValueError(f"a tensor of {size} elements has no {channels} channels")
                flat = x.filter(pa.array(sizes == size)).flatten()
                absent = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, size)
                values = flat.fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
                for c in range(-(-size // per)):
                    block = values[:, c * per:(c + 1) * per][~absent[:, c * per:(c + 1) * per]]
                    have = acc.setdefault(c, [0, (0, 0.0, 0.0)])
                    have[0] += len(values) * min(per, size - c * per)
                    if len(block):
                        mean = block.mean()
                        have[1] = _merge(have[1], (len(block), mean, float(np.square(block - mean).sum())))
        if acc:
            rows = [(c, elements, *part) for c, (elements, part) in acc.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), _PARTIAL_TYPES, strict=True)],
                names=["channel", "elements", "n", "mean", "m2"])
    return run


_PARTIAL_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64())


def _channel_total(t: pa.Table) -> pa.Table:
    rows = t.to_pylist()
    total = (0, 0.0, 0.0)
    for r in rows:
        total = _merge(total, (r["n"], r["mean"], r["m2"]))
    n, mean, m2 = total
    return pa.table({"channel": pa.array([rows[0]["channel"]], pa.int32()),
                     "n": pa.array([sum(r["elements"] for r in rows)], pa.int64()),
                     "mean": pa.array([mean if n else None], pa.float64()),
                     "std": pa.array([(m2 / (n - 1)) ** 0.5 if n > 1 else None], pa.float64())})


def channel_stats(df: DataFrame, value: str, channels: int, key: str | None = None,
                  max_n: int | None = None, seed: int = 0) -> DataFrame:
    """Per channel: element count, mean and unbiased std over (batch, H, W) of
    every tensor; ``max_n`` draws so many of them without replacement by T3.

    Each task reduces its Arrow batches to one row per channel, so what is
    shuffled is channels x tasks rows whatever the tensors' size."""
    if max_n is not None:
        if key is None:
            raise ValueError("sampling needs a key column")
        df = sample_exact(df, max_n, key, seed)
    partials = df.select(as_double_array(value).alias("_x")).mapInArrow(
        _channel_partials(channels), "channel int, elements long, n long, mean double, m2 double")
    return partials.groupBy("channel").applyInArrow(_channel_total, "channel int, n long, mean double, std double")


def stats_arrays(stats: DataFrame) -> tuple[list[float], list[float]]:
    """Collect a channel_stats table (C rows: O(#channels)) as mean/std lists."""
    rows = sorted(stats.select("channel", "mean", "std").collect(), key=lambda r: r["channel"])
    if [r["channel"] for r in rows] != list(range(len(rows))):
        raise ValueError("channel statistics must cover channels 0..C-1")
    return [float(r["mean"]) for r in rows], [float(r["std"]) for r in rows]


def safe_div(num: Column, den: Column) -> Column:
    """num / den with IEEE results for a zero denominator (ANSI mode raises):
    0/0 -> NaN, x/0 -> +-inf."""
    return (F.when(den != 0, num / den)
            .when(num == 0, F.lit(float("nan")))
            .when(num > 0, F.lit(float("inf")))
            .otherwise(F.lit(float("-inf"))))


def _per_channel(x, mean, std, inverse: bool) -> Column:
    c = len(mean)
    m = F.array(*[F.lit(float(v)) for v in mean])
    s = F.array(*[F.lit(float(v)) for v in std])
    d = as_double_array(x)
    per = (F.size(d) / F.lit(c)).cast("int")

    def f(v, i):
        ch = F.floor(i / per).cast("int") + 1
        if inverse:
            return v * F.element_at(s, ch) + F.element_at(m, ch)
        return safe_div(v - F.element_at(m, ch), F.element_at(s, ch))
    return F.transform(d, f)


def normalise(x, mean, std) -> Column:
    """(x - mean[c]) / std[c] with c = position div (H*W).

    The C statistics are inlined as literal arrays (bounded by the channel
    count), so no join is planned and the expression stays in codegen.
    """
    return _per_channel(col(x), mean, std, inverse=False)


def denormalise(x, mean, std) -> Column:
    """J6 inverse: x * std[c] + mean[c]."""
    return _per_channel(col(x), mean, std, inverse=True)
