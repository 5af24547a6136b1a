"""Sinks (K1-K6).  All writes go through Spark's commit protocol (task
output is published atomically), partitioned so no single task writes the
whole table."""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlake.functions.paths import shard_name
from pairlake.operators.index import pin
from pairlake.sinks.blobs import fs_and_path

SHARD_ROWS = 1000


def write_dataset(df: DataFrame, dest: str, index: str = "index", kind: str = "image",
                  shard_folders: bool = False) -> None:
    """K1: the destination must not exist; rows carry ``shard`` = index div
    1000 and the member name of F6.  Files are range-partitioned by index so
    each file holds a contiguous index range; one folder per shard only on
    request (it makes many small files at scale)."""
    if not dest:
        raise ValueError("the dataset needs a destination path")
    out = (df.withColumn("shard", F.floor(F.col(index) / SHARD_ROWS).cast("long"))
           .withColumn("member", shard_name(index, kind)))
    out = out.repartitionByRange(index).sortWithinPartitions(index)
    w = out.write.mode("errorifexists")
    if shard_folders:
        w = w.partitionBy("shard")
    w.parquet(dest)


def manifest_flag(df: DataFrame, label: str = "label") -> bool:
    """K2 flag: every row labelled (True for zero rows, as ``all([])``)."""
    return bool(df.agg(F.coalesce(F.bool_and(F.col(label).isNotNull()), F.lit(True))).first()[0])


def write_class_manifest(df: DataFrame, dest: str, fname: str = "member", label: str = "label") -> bool:
    """K2: ``labels`` is the full list only when every row has a label, else
    null.  Written as sharded JSON Lines rows ``{fname, label}`` plus a
    one-row ``_flag`` table; returns the flag."""
    flag = manifest_flag(df, label)
    spark = df.sparkSession
    spark.createDataFrame([(flag,)], "labels_present boolean").write.mode("errorifexists").json(f"{dest}/_flag")
    rows = df.select(F.col(fname).alias("fname"), F.col(label).alias("label"))
    if not flag:
        rows = rows.limit(0)
    rows.write.mode("errorifexists").json(f"{dest}/labels")
    return flag


def pack_samples_frame(df: DataFrame, n: int, index: str = "sample_index", shape: str = "shape") -> DataFrame:
    """K4 checks: keep indices 0..n-1 (extras discarded); every index present
    exactly once and every shape equal, else an error.  One aggregation."""
    kept = df.filter((F.col(index) >= 0) & (F.col(index) < n))
    each = kept.groupBy(index).agg(F.count(F.lit(1)).alias("c"), F.min(shape).alias("a"), F.max(shape).alias("b"))
    chk = each.agg(F.count(F.lit(1)).alias("d"), F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.min("a").alias("a"),
                   F.max("b").alias("b")).first()
    if chk["d"] != n or chk["c"] != n:
        raise ValueError(f"sample pack needs indices 0..{n - 1} exactly once: {chk['d']} distinct of {chk['c']} rows")
    if n and chk["a"] != chk["b"]:
        raise ValueError("all samples in a pack must have the same shape")
    return kept


def pack_samples(df: DataFrame, n: int, dest: str, index: str = "sample_index") -> None:
    """K4: write exactly samples 0..n-1, range-partitioned by index."""
    kept = pack_samples_frame(df, n, index)
    kept.repartitionByRange(index).sortWithinPartitions(index).write.mode("errorifexists").parquet(dest)


def _with_params(df: DataFrame, run_id: str, params: dict | None) -> DataFrame:
    pm = F.create_map(*[x for k, v in sorted((params or {}).items()) for x in (F.lit(k), F.lit(str(v)))]) \
        if params else F.create_map().cast("map<string,string>")
    return df.select(F.lit(run_id).alias("run_id"), pm.alias("params"), "*")


def append_eval_report(metrics: DataFrame, path: str, run_id: str, params: dict | None = None) -> None:
    """K5: append one row of five metrics to the reports table of all runs;
    run parameters are a map column instead of being packed in a file name."""
    cols = ["inception_score", "fid", "sfid", "precision", "recall"]
    _with_params(metrics.select(*cols), run_id, params).write.mode("append").parquet(path)


def append_metrics(df: DataFrame, path: str, run_id: str, params: dict | None = None) -> None:
    """K6: append per-step metric rows (step, metric, value) with the run's
    parameters beside them."""
    _with_params(df.select("step", "metric", "value"), run_id, params).write.mode("append").parquet(path)


def write_latent_stats(stats: DataFrame, path: str, fingerprint: str) -> None:
    """K3: append a channel statistics table under a dataset fingerprint."""
    stats.select(F.lit(fingerprint).alias("fingerprint"), "channel", "n", "mean", "std").write.mode("append").parquet(path)


def write_json_document(df: DataFrame, path: str, record: str, order: str, key: str | None = None) -> int:
    """One JSON document: a list of the ``record`` texts (JSON values) in
    ``order``, or an object whose ``key`` holds that list; returns how many
    there were.

    The rows are sorted in ranges, whose lengths tell where in the file each
    begins (one row a range on the driver); then every range is written at its
    place by a task of its own, under a temporary name until the last is done.
    A store that cannot write in the middle of a file gets the sorted rows from
    one writer."""
    head, tail = (b"[", b"]\n") if key is None else (b"{" + json.dumps(key).encode() + b": [", b"]}\n")
    fs, name = fs_and_path(path)
    rows = df.select(record, order)
    if not isinstance(fs, pafs.LocalFileSystem):
        return _write_in_one(rows, path, record, order, head, tail)
    tie = F.xxhash64(record)  # a much repeated place is still split
    rows = pin(rows.repartitionByRange(order, tie).sortWithinPartitions(order, tie).select(record))

    def measure(batches):
        n = size = 0
        for batch in batches:
            n, size = n + batch.num_rows, size + (pc.sum(pc.binary_length(batch.column(0))).as_py() or 0)
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (TaskContext.get().partitionId(), n, size)],
                                         ["part", "n", "size"])

    total, at, places = 0, len(head), {}
    for part, n, size in sorted(rows.mapInArrow(measure, "part long, n long, size long").collect()):
        if n:
            places[part] = (at, b",\n" if total else b"")
            at += size + 2 * (n if total else n - 1)
            total += n
    hidden = f"{name}.{uuid.uuid4().hex}"
    fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with open(hidden, "wb") as out:
        out.write(head)
        out.seek(at)
        out.write(tail)

    def run(batches):
        n = 0
        place = places.get(TaskContext.get().partitionId())
        if place is not None:
            with open(hidden, "r+b", buffering=1 << 20) as out:
                out.seek(place[0])
                before = place[1]
                for batch in batches:
                    for text in batch.column(0):
                        out.write(before + text.as_py().encode())
                        n, before = n + 1, b",\n"
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    written = sum(r["n"] for r in rows.mapInArrow(run, "n long").collect())
    if written != total:
        raise AssertionError(f"{written} of {total} records were written to {path}")
    fs.move(hidden, name)
    return total


def _write_in_one(rows: DataFrame, path: str, record: str, order: str, head: bytes, tail: bytes) -> int:
    def run(batches):
        fs, name = fs_and_path(path)
        hidden, n = f"{name}.{uuid.uuid4().hex}", 0
        fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(hidden) as out:
            out.write(head)
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    out.write((b",\n" if n else b"") + text.encode())
                    n += 1
            out.write(tail)
        fs.move(hidden, name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    one = rows.repartition(1).sortWithinPartitions(order).select(record)
    return sum(r["n"] for r in one.mapInArrow(run, "n long").collect())
