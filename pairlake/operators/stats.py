"""Statistics collector semantics on tables (A3, A4, A7, A9, A10, W3-W5,
P7, P8, R4 batch twins).

Reports are long rows (name, value[, rank, round]); moments
``(num, sum, sumsq)`` are plain sums, so Catalyst's partial aggregation merges
them map-side and a name holding a third of all rows costs one partial row
per task, not one task holding the third.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlake.operators.index import global_index

from pairlake.functions.util import col
from pairlake.functions.vectors import FLOAT32_MAX


def finite_square(x) -> Column:
    """Keep x only when float32(x)^2 is finite (NaN, +-inf and |x| beyond
    ~1.8e19 are dropped)."""
    f = col(x).cast("float")
    sq = f * f
    return F.coalesce(~F.isnan(sq) & (sq <= F.lit(FLOAT32_MAX).cast("float")), F.lit(False))


def moments(df: DataFrame, keys, value: str) -> DataFrame:
    """A3 partials: per key group, (num, sum, sumsq) of the finite values."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    ok = finite_square(value)
    v = F.col(value).cast("double")
    return df.groupBy(*keys).agg(
        F.sum(ok.cast("long")).alias("num"),
        F.sum(F.when(ok, v).otherwise(F.lit(0.0))).alias("sum"),
        F.sum(F.when(ok, v * v).otherwise(F.lit(0.0))).alias("sumsq"))


def moments_to_stats(df: DataFrame, num: str = "num", s: str = "sum", sq: str = "sumsq") -> DataFrame:
    """num, mean and population std from moments: num = 0 -> NaN mean and std,
    non-finite sum -> NaN std, num = 1 -> std 0, else sqrt(max(E[x^2] - E[x]^2, 0))."""
    n, sm, ss = F.col(num), F.col(s), F.col(sq)
    nan = F.lit(float("nan"))
    mean = F.when(n == 0, nan).otherwise(sm / n)
    finite_sum = ~F.isnan(sm) & (F.abs(sm) != F.lit(float("inf")))
    std = (F.when((n == 0) | ~finite_sum, nan).when(n == 1, F.lit(0.0))
           .otherwise(F.sqrt(F.greatest(ss / n - (sm / n) * (sm / n), F.lit(0.0)))))
    others = [c for c in df.columns if c not in (num, s, sq)]
    return df.select(*others, n.alias("num"), mean.alias("mean"), std.alias("std"))


def collect_stats(df: DataFrame, name: str = "name", value: str = "value", by=()) -> DataFrame:
    """A3: per name (and optional extra keys) num, mean, std."""
    return moments_to_stats(moments(df, [*by, name], value))


def merge_moments(df: DataFrame, keys=("name",)) -> DataFrame:
    """A4: add moment vectors reported by several devices / ranks."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(F.sum("num").alias("num"), F.sum("sum").alias("sum"), F.sum("sumsq").alias("sumsq"))


def filter_names(df: DataFrame, regex: str, name: str = "name") -> DataFrame:
    """Names that fully match ``regex``."""
    return df.filter(F.col(name).rlike(f"^(?:{regex})$"))


def report0(df: DataFrame, rank: str = "rank") -> DataFrame:
    """R4 (batch form): only rank 0 reports count."""
    return df.filter(F.col(rank) == 0)


def rank_mean(df: DataFrame, step: str = "step", metric: str = "metric", rank: str = "rank",
              value: str = "value") -> DataFrame:
    """Mean of a metric over workers per step, every rank weighted equally
    (each rank's own mean first, then the mean over ranks)."""
    per_rank = df.groupBy(step, metric, rank).agg(F.avg(value).alias("_v"))
    return per_rank.groupBy(step, metric).agg(F.avg("_v").alias("value"))


def stat_deltas(df: DataFrame, name: str = "name", rnd: str = "round", value: str = "value") -> DataFrame:
    """Per name and round, the moments accumulated in that round (the
    cumulative counter minus its previous value); rounds without finite
    values give no row."""
    m = moments(df, [name, rnd], value)
    return m.filter(F.col("num") != 0)


def cumulative_stats(deltas: DataFrame, name: str = "name", rnd: str = "round") -> DataFrame:
    """Running moment totals per name over rounds."""
    w = Window.partitionBy(name).orderBy(rnd).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return deltas.select(name, rnd, *[F.sum(c).over(w).alias(c) for c in ("num", "sum", "sumsq")])


def keep_previous(deltas: DataFrame, name: str = "name", rnd: str = "round", step: int | None = None) -> DataFrame:
    """A round without data keeps the name's previous moments.  The
    distinct rounds are numbered; a name gets the numbers from its first round
    with data on, so the spine has names x existing rounds rows however far
    apart the rounds lie; ``last(ignorenulls)`` carries the moments forward.
    A round whose moments count nothing is a round without data.  With ``step``
    rounds are ``step`` apart, and those in which no name reported count too,
    up to the last round of ``deltas``."""
    data = deltas.filter(F.col("num") != 0)
    first = data.groupBy(name).agg(F.min(rnd).alias("_f"))
    if step is not None:
        last = deltas.agg(F.max(rnd)).scalar()
        spine = first.select(name, F.explode(F.sequence("_f", last, F.lit(step))).alias(rnd))
        return _carried(spine, data, name, rnd)
    # one row per round: a table as long as the history, not as the reports
    rounds = global_index(deltas.select(rnd).distinct(), rnd, "_i")
    numbers = F.sequence(F.col("_i"), rounds.agg(F.max("_i")).scalar())
    spine = first.withColumnRenamed("_f", rnd).join(rounds, rnd).select(name, F.explode(numbers).alias("_i"))
    return _carried(spine.join(rounds, "_i").drop("_i"), data, name, rnd)


def _carried(spine: DataFrame, data: DataFrame, name: str, rnd: str) -> DataFrame:
    """The moments of every (name, round) of ``spine``, or those before."""
    j = spine.join(data, [name, rnd], "left")
    w = Window.partitionBy(name).orderBy(rnd).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return j.select(name, rnd, *[F.last(c, ignorenulls=True).over(w).alias(c) for c in ("num", "sum", "sumsq")])


def _nan_to_num_scalar(v: Column) -> Column:
    return (F.when(F.isnan(v), F.lit(0.0)).when(v == F.lit(float("inf")), F.lit(FLOAT32_MAX))
            .when(v == F.lit(float("-inf")), F.lit(-FLOAT32_MAX)).otherwise(v))


def replica_consistency(df: DataFrame, name: str = "name", replica: str = "replica", value: str = "value",
                        ignore_regex: str | None = None) -> DataFrame:
    """Names whose value differs from replica 0 on some replica, after
    NaN/inf replacement, and names that replica 0 does not report; names fully
    matching ``ignore_regex`` are skipped.  One aggregation: a name is
    consistent when all replicas agree."""
    d = df if ignore_regex is None else df.filter(~F.col(name).rlike(f"^(?:{ignore_regex})$"))
    v = _nan_to_num_scalar(F.col(value).cast("double"))
    per = d.groupBy(name).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"),
                              F.max(F.when(F.col(replica) == 0, v)).alias("_ref"))
    return per.filter(F.col("_ref").isNull() | (F.col("_lo") != F.col("_ref")) | (F.col("_hi") != F.col("_ref"))).select(
        name, F.col("_ref").alias("replica0"), F.col("_lo").alias("min_value"), F.col("_hi").alias("max_value"))


def name_set_fingerprints(df: DataFrame, rank: str = "rank", pos: str = "pos", name: str = "name") -> DataFrame:
    """A10: per rank, an order-sensitive fingerprint of its (position, name)
    sequence -- the count and a sum of 32-bit md5 prefixes -- so no rank's
    name list is ever collected."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(pos).cast("string"), F.col(name))), 1, 8), 16, 10).cast("long")
    return df.groupBy(rank).agg(F.count(F.lit(1)).alias("n_names"), F.sum(h).alias("fingerprint"))


def name_set_consistency(df: DataFrame, rank: str = "rank", pos: str = "pos", name: str = "name") -> bool:
    """A10: True when every rank reported the same names in the same order;
    raises otherwise (as the collector's sync does)."""
    wide = F.bit_xor(F.xxhash64(pos, name)).alias("wide")  # two independent fingerprints: sums of 32 bits can collide
    fp = name_set_fingerprints(df, rank, pos, name).join(df.groupBy(rank).agg(wide), rank)
    n = fp.select("n_names", "fingerprint", "wide").distinct().count()
    if n > 1:
        raise ValueError("the ranks do not report the same names in the same order")
    return True
