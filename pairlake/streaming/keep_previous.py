"""The collector's keep-previous rule as a stateful stream.

Rounds are tumbling event-time windows.  When the watermark passes a round's
end, every name that has reported before emits that round's moments, or -- if
it had no finite report in the round -- the moments it emitted last.  A name's
rounds begin at its first one with a finite report.

The reports of a micro-batch are summed to one row of moments a task, round
and name before they are shuffled, so a name with a third of all reports costs
one row a task.  The state of a name is a map of its open rounds' moments, the
moments emitted last and the next round to close; an event-time timer at that
round's end lets a silent name emit without input.

When the input ends, rounds are still open: nothing has moved the watermark
past them.  ``run_keep_previous`` then writes one closing row to a folder that
the stream reads beside its input, with a time at which the last round that
anybody reported in ends, and lets the stream go on.

Late data: a report of a round that is closed is dropped; a late report of an
open round counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pairlake.functions.timefmt import utc_instant
from pairlake.operators.stats import finite_square
from pairlake.sinks.committed import read_committed, run_committed
from pairlake.streaming.collector import stream_folder

OUT = T.StructType([T.StructField("name", T.StringType()), T.StructField("round_start", T.LongType()),
                    T.StructField("num", T.LongType()), T.StructField("sum", T.DoubleType()),
                    T.StructField("sumsq", T.DoubleType())])
REPORT = "ts timestamp, name string, value double"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MOST_GROUPS = 1 << 17  # rows of moments a task holds before it passes them on


class KeepPrevious(StatefulProcessor):
    def __init__(self, round_secs: int):
        self.round_secs = round_secs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "round long", "num long, sum double, sumsq double")
        self.last = handle.getValueState("last", "num long, sum double, sumsq double")
        self.next = handle.getValueState("next", "round long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        for df in rows:
            df = df[df["round"].notna() & (df["num"] > 0)]
            for r, n, s, q in zip(df["round"], df["num"], df["sum"], df["sumsq"], strict=True):
                if (r + self.round_secs) * 1000 > mark:  # open
                    at = (int(r),)
                    n0, s0, q0 = self.open.getValue(at) if self.open.containsKey(at) else (0, 0.0, 0.0)
                    self.open.updateValue(at, (n0 + int(n), s0 + float(s), q0 + float(q)))
        yield from self._close(key[0], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._close(key[0], timerValues)

    def close(self) -> None:
        pass

    def _close(self, name: str | None, timerValues) -> Iterator[pd.DataFrame]:
        """Emit every round that the watermark has passed."""
        mark = timerValues.getCurrentWatermarkInMs()
        at = self.next.get()[0] if self.next.exists() else min((k[0] for k in self.open.keys()), default=None)
        if at is None:
            return
        first, end, out = at, self.round_secs, []
        last = self.last.get() if self.last.exists() else None
        while (at + end) * 1000 <= mark:
            if self.open.containsKey((at,)):
                last = self.open.getValue((at,))
                self.open.removeKey((at,))
            out.append((name, at, *last))
            at += end
        if at != first:
            self.last.update(tuple(last))
            self.next.update((at,))
        self.handle.registerTimer((at + end) * 1000)
        if out:
            yield pd.DataFrame(out, columns=OUT.names)


def _sum_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["name", "round", "num", "sum", "sumsq", "ts"]

    def summed(tables: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(tables).group_by(names[:2]).aggregate(
            [("num", "sum"), ("sum", "sum"), ("sumsq", "sum"), ("ts", "max")])
        return t.select(["name", "round", "num_sum", "sum_sum", "sumsq_sum", "ts_max"]).rename_columns(names)

    kept: list[pa.Table] = []
    for batch in batches:
        # by name and without Spark's nullability, which sums do not keep
        kept = [summed([*kept, pa.Table.from_arrays(batch.columns, names=names)])]
        if len(kept[0]) > MOST_GROUPS:
            yield from kept.pop().combine_chunks().to_batches()
    for t in kept:
        yield from t.combine_chunks().to_batches()


def stream_keep_previous(reports: DataFrame, ts: str = "ts", name: str = "name", value: str = "value",
                         round_secs: int = 86400, watermark: str = "1 hour") -> DataFrame:
    """Closed rounds per name with kept-previous moments (append mode).  A
    report without a name and time belongs to no round."""
    at, ok, v = utc_instant(reports, ts), finite_square(value), F.col(value).cast("double")
    rows = reports.select(
        F.col(name).cast("string").alias("name"),
        (F.floor(F.unix_seconds(at) / round_secs) * round_secs).cast("long").alias("round"), ok.cast("long").alias("num"),
        F.when(ok, v).otherwise(0.0).alias("sum"), F.when(ok, v * v).otherwise(0.0).alias("sumsq"), at.alias("ts"))
    rows = rows.withColumn("num", F.coalesce("num", F.lit(0))).mapInArrow(
        _sum_in_task, "name string, round long, num long, sum double, sumsq double, ts timestamp")
    return (rows.withWatermark("ts", watermark).select("name", "round", "num", "sum", "sumsq").groupBy("name")
            .transformWithStateInPandas(KeepPrevious(round_secs), OUT, "append", "eventtime"))


def run_keep_previous(reports: DataFrame, ts: str = "ts", name: str = "name", value: str = "value",
                      round_secs: int = 86400, delay_secs: int = 3600) -> DataFrame:
    """R3 over all input available now, every round up to the last one that
    was reported in, through the committed sink (R6)."""
    spark = reports.sparkSession
    folder = stream_folder(spark, "keep-previous")
    spark.createDataFrame([], REPORT).write.parquet(f"{folder}/end")
    plain = reports.select(utc_instant(reports, ts).alias("ts"), F.col(name).cast("string").alias("name"),
                           F.col(value).cast("double").alias("value"))
    both = plain.unionByName(spark.readStream.schema(REPORT).parquet(f"{folder}/end"))
    closed = stream_keep_previous(both, round_secs=round_secs, watermark=f"{delay_secs} seconds")
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)  # the store that maps and timers need
    try:
        seen = [_seconds(p["eventTime"]["max"]) for p in run_committed(closed, folder) if "max" in p["eventTime"]]
        if seen:
            end = int(max(seen) // round_secs + 1) * round_secs
            mark = datetime.fromtimestamp(end + delay_secs + 1, UTC)
            spark.range(1).select(F.lit(mark).cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("name"),
                                  F.lit(None).cast("double").alias("value")).write.mode("append").parquet(f"{folder}/end")
            run_committed(closed, folder)
    finally:
        spark.conf.set(PROVIDER, before)
    return read_committed(spark, folder, OUT)


def _seconds(text: str) -> float:
    return datetime.fromisoformat(text.replace("Z", "+00:00")).timestamp()
