"""Exact-size sampling without replacement, keyed by a portable hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlake.functions.rand import hash_uniform
from pairlake.operators.index import global_index


def sample_exact(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """The ``n`` rows with the smallest ``hash_uniform(key, seed)``, ties broken
    by key and then by a hash of the row; every row when there are at most ``n``.

    A narrow table (draw, key, row hash) is ranked by W1; the rows before the
    n-th triple are a filter of the input, and of the rows equal to it (copies
    of one row) as many are added as are missing.  One plan at every size."""
    if n <= 0:
        return df.limit(0)
    u = hash_uniform(key, seed)
    row = F.xxhash64(*[F.col(c) for c in df.columns])
    narrow = df.select(u.alias("_u"), F.col(key).alias("_k"), row.alias("_h"))
    ranked = global_index(narrow, ["_u", "_k", "_h"], "_r")
    cut = ranked.filter(F.col("_r") == n - 1).first()
    if cut is None:
        return df
    same = (F.col("_u") == cut["_u"]) & F.col("_k").eqNullSafe(F.lit(cut["_k"])) & (F.col("_h") == cut["_h"])
    first = ranked.filter(same).agg(F.min("_r")).first()[0]
    full = df.withColumns({"_u": u, "_k": F.col(key), "_h": row})
    later = F.struct("_u", "_k", "_h") < F.struct(F.lit(cut["_u"]), F.lit(cut["_k"]).cast(df.schema[key].dataType),
                                                  F.lit(cut["_h"]))
    before = full.filter(later).drop("_u", "_k", "_h")
    return before.union(full.filter(same).limit(n - first).drop("_u", "_k", "_h"))
