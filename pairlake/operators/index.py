"""A 0-based global position in a total order, without a single partition.

Plan: range-partition on the order key, sort inside partitions, checkpoint to
the shared folder (the range bounds are sampled, so the layout has to be
pinned before rows are counted), count rows per partition, turn the counts into
prefix offsets (a table of one row per partition, which is small enough to
broadcast) and add each row's position inside its partition.  ``Window.orderBy`` without ``partitionBy``
would move the whole table into one task; this never does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlake.session import checkpoint_dir

_POS_BITS = 33  # monotonically_increasing_id = partition << 33 | row-in-partition


def _order_cols(order):
    return [order] if isinstance(order, str) else list(order)


def pin(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the session's shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def global_index(df: DataFrame, order, name: str = "index", partitions: int | None = None,
                 tiebreak: bool = False) -> DataFrame:
    """Append ``name`` = position of each row in ``order`` (ascending columns or
    Column expressions).  ``tiebreak`` appends a row hash to the sort key so a
    heavily repeated key value can still be split across range partitions."""
    cols = _order_cols(order)
    if tiebreak:
        df = df.withColumn("_tb", F.xxhash64(*[F.col(c) for c in df.columns]))
        cols = cols + ["_tb"]
    # the planner chooses the partition count (shuffle setting, coalesced by AQE
    # to the data); nothing is executed to size the plan
    parts = [partitions] if partitions else []
    laid_out = df.repartitionByRange(*parts, *cols).sortWithinPartitions(*cols)
    pinned = pin(laid_out)
    with_pid = pinned.withColumn("_mid", F.monotonically_increasing_id())
    pid = F.shiftright("_mid", _POS_BITS)
    counts = with_pid.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_c"))
    # one row per partition: its rows, then the rows of the partitions before it
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    within = F.col("_mid") - F.shiftleft(pid, _POS_BITS)
    out = (with_pid.withColumn("_pid", pid).join(F.broadcast(offsets), "_pid")
           .withColumn(name, F.col("_before") + within).drop("_mid", "_pid", "_before"))
    return out.drop("_tb") if tiebreak else out


def first_n(df: DataFrame, order, n: int) -> DataFrame:
    """The first min(count, n) rows in ``order`` (n = 0 gives none), ranked
    by W1, so no task merges n rows of every partition."""
    if n <= 0:
        return df.limit(0)
    return global_index(df, _order_cols(order), "_first_n").filter(F.col("_first_n") < n).drop("_first_n")
