"""Set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_values(df: DataFrame, *cols) -> DataFrame:
    """Distinct rows of a projection."""
    return df.select(*cols).distinct()


def concat_batches(*dfs: DataFrame, order: str | None = None) -> DataFrame:
    """Append batch results by column name; order is restored by an index
    column when one is given (a union has no order of its own)."""
    out = reduce(lambda a, b: a.unionByName(b), dfs)
    return out.orderBy(order) if order else out


def sample_diff(plan: DataFrame, existing: DataFrame) -> DataFrame:
    """Multiset difference both ways, tagged 'missing' (planned, absent)
    and 'extra' (present, not planned)."""
    missing = plan.exceptAll(existing).select(F.lit("missing").alias("kind"), "*")
    extra = existing.exceptAll(plan).select(F.lit("extra").alias("kind"), "*")
    return missing.unionByName(extra)


def common_names(df: DataFrame, rank: str, name: str) -> DataFrame:
    """U4: names reported by every rank (count of distinct ranks per name equals
    the number of ranks).  Two aggregations, no per-rank collection."""
    n_ranks = df.select(rank).distinct().count()
    per = df.groupBy(name).agg(F.count_distinct(rank).alias("_r"))
    return per.filter(F.col("_r") == n_ranks).select(name)
