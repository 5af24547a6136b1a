"""The statistics collector as Structured Streaming.

report -> update -> delta -> query becomes: a stream of (ts, name, value,
rank) reports, a tumbling event-time window per "update" round, moments as
plain sums (mergeable in the state store), and stats derived per window.
Late rows (older than the watermark) are dropped, as Structured Streaming
documents; the reference has no late-data rule.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlake.functions.timefmt import utc_instant
from pairlake.operators.stats import finite_square, moments_to_stats
from pairlake.session import checkpoint_dir


def _moment_aggs(value: str):
    ok = finite_square(value)
    v = F.col(value).cast("double")
    return [F.sum(ok.cast("long")).alias("num"),
            F.sum(F.when(ok, v).otherwise(F.lit(0.0))).alias("sum"),
            F.sum(F.when(ok, v * v).otherwise(F.lit(0.0))).alias("sumsq")]


def stream_moments(stream: DataFrame, ts: str = "ts", name: str = "name", value: str = "value",
                   window: str = "1 day", watermark: str = "1 hour", rank: str | None = None) -> DataFrame:
    """The moments of the finite reports per tumbling window and name; with
    ``rank`` only that column's zero (R4)."""
    s = stream.withColumn(ts, utc_instant(stream, ts))
    if rank is not None:
        s = s.filter(F.col(rank) == 0)
    agg = (s.withWatermark(ts, watermark)
           .groupBy(F.window(ts, window).alias("w"), F.col(name))
           .agg(*_moment_aggs(value)))
    return agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), name,
                      "num", "sum", "sumsq")


def stream_stats(stream: DataFrame, ts: str = "ts", name: str = "name", value: str = "value",
                 window: str = "1 day", watermark: str = "1 hour", rank: str | None = None) -> DataFrame:
    """R1 (+R4 when ``rank`` is given): per name and tumbling window, num /
    mean / std of the finite reports.  Append mode emits a window once the
    watermark passes its end; update mode also gives the open ones."""
    return moments_to_stats(stream_moments(stream, ts, name, value, window, watermark, rank))


def stream_cumulative(stream: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """R2: running moments per name since the start (complete / update mode)."""
    return moments_to_stats(stream.groupBy(name).agg(*_moment_aggs(value)))


def stream_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder for a stream's output and checkpoint, inside the shared
    checkpoint folder of the session."""
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{label}-{uuid.uuid4().hex[:12]}"


def run_append_to_parquet(df: DataFrame, label: str) -> DataFrame:
    """Run a streaming DataFrame to completion (``availableNow``) into a
    Parquet file sink with a checkpoint, then read the sink back.  The file
    sink's log makes the output exactly-once across restarts."""
    spark = df.sparkSession
    base = stream_folder(spark, label)
    q = (df.writeStream.format("parquet").outputMode("append")
         .option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def run_complete_to_parquet(df: DataFrame, label: str) -> DataFrame:
    """Complete-mode aggregate run with ``foreachBatch``: every micro-batch
    overwrites the table with the full current result (idempotent, so a
    replayed batch writes the same rows)."""
    spark = df.sparkSession
    base = stream_folder(spark, label)
    out = f"{base}/out"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = (df.writeStream.outputMode("complete").foreachBatch(write)
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.schema(df.schema).parquet(out)


def run_update_to_parquet(df: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Update-mode aggregate over all data available now: every micro-batch
    writes the rows it changed under its own number (a replayed batch writes
    the same folder again), and the latest row of each key is the result.
    Windows that are still open when the input ends are therefore in it."""
    spark = df.sparkSession
    base = stream_folder(spark, label)
    out = f"{base}/out"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    q = (df.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    schema = T.StructType([*df.schema.fields, T.StructField("epoch", T.LongType())])
    if not q.lastProgress:  # no input, so no batch
        return spark.createDataFrame([], df.schema)
    last = F.max_by(F.struct(*[F.col(c) for c in df.columns if c not in keys]), "epoch")
    return spark.read.schema(schema).parquet(out).groupBy(*keys).agg(last.alias("_r")).select(*keys, "_r.*")


def events_stream(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """A file stream over one driver table, a file or a folder of part files
    (schema taken from the batch read)."""
    path = f"{sf_dir.rstrip('/')}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    # a stream wants folders: a pattern that only this name matches stands for either
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
