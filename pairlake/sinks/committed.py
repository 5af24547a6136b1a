"""A streaming sink of metric rows with a commit protocol.

Tasks write their rows to Parquet files of names of their own and report the
names; the driver commits an epoch by publishing one manifest that lists them.
Rows are read back through the manifests alone, so files of tasks that failed,
were repeated or were aborted are never seen.  An epoch that is replayed after
a restart finds its manifest, and its new files go: one copy of every epoch is
kept however often it runs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from pairlake.sinks.blobs import fs_and_path, publish

FORMAT = "pairlake_committed"


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


class CommittedSink(DataSource):
    """``writeStream.format(FORMAT).option("path", folder)``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> CommittedWriter:
        return CommittedWriter(self.options["path"], schema)


class CommittedWriter(DataSourceStreamArrowWriter):
    def __init__(self, folder: str, schema: T.StructType):
        self.folder, self.schema = folder.rstrip("/"), schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        schema = to_arrow_schema(self.schema)
        fs, base = fs_and_path(self.folder)
        name, rows, writer = f"{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in iterator:
                if batch.num_rows:
                    if writer is None:
                        fs.create_dir(f"{base}/data", recursive=True)
                        writer = pq.ParquetWriter(f"{base}/data/{name}", schema, filesystem=fs)
                    writer.write_table(pa.Table.from_batches([batch]).cast(schema))
                    rows += batch.num_rows
        finally:
            if writer is not None:
                writer.close()
        return Written(name if rows else None, rows)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        fs, base = fs_and_path(self.folder)
        manifest = f"{base}/commits/{batchId:012d}.json"
        if fs.get_file_info(manifest).is_file:  # replayed: the first copy stays
            self.abort(messages, batchId)
            return
        lines = [json.dumps({"epoch": batchId, "file": m.file, "rows": m.rows}) for m in messages if m and m.file]
        publish(fs, manifest, "\n".join(lines).encode())

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        fs, base = fs_and_path(self.folder)
        for m in messages:
            if m and m.file:
                fs.delete_file(f"{base}/data/{m.file}")


def run_committed(stream: DataFrame, folder: str) -> list:
    """Run a streaming DataFrame over all input available now into the sink
    ``folder``/out; returns the progress reports of its micro-batches.  Called
    again with the same folder, it goes on where it stopped."""
    stream.sparkSession.dataSource.register(CommittedSink)
    fs, base = fs_and_path(f"{folder}/out/commits")
    fs.create_dir(base, recursive=True)  # without input there is no epoch
    q = (stream.writeStream.format(FORMAT).option("path", f"{folder}/out").outputMode("append")
         .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return list(q.recentProgress)


def read_committed(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The rows of all committed epochs."""
    manifest = "epoch long, file string, rows long"
    files = spark.read.schema(manifest).json(f"{folder}/out/commits").select(F.col("file").alias("_file"))
    if files.isEmpty():
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(f"{folder}/out/data").withColumn("_file", F.col("_metadata.file_name"))
    return rows.join(files, "_file", "left_semi").drop("_file")
