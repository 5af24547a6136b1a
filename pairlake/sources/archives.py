"""Archive sources in byte-balanced tasks (S3, S6, X3): zip members and rows
of npz arrays, from one archive or a folder of them.

Executors read the central directories first, an archive a task, and report
where every wanted member lies.  From that plan (one row a member or row range;
the driver holds a total an archive) the work is cut into tasks of equal bytes
across all archives: a huge archive is shared by many tasks and many small ones
by few.  A task seeks to its members and never reads a directory again.

npz rows: a stored member is read in row ranges; in Fortran order a range is
one stretch of every column.  A compressed member cannot be entered in the
middle, so one task inflates it from its beginning, a few rows at a time; only
one that is compressed and in Fortran order is held whole, as its first row is
spread over all of it.
"""

from __future__ import annotations

import ast
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlake.functions.paths import IMAGE_EXTS
from pairlake.operators.index import pin
from pairlake.sinks.blobs import fs_and_path

TASK_BYTES = 64 << 20  # of archive bytes in a task, at most (one member that is larger is a task's)
BATCH_BYTES = 8 << 20  # of content handed to Spark at a time


def _open(path: str):
    fs, p = fs_and_path(path)
    return fs.open_input_file(p)


def _archives(path: str, ext: str) -> list[str]:
    """The archive itself, or the sorted ``*.ext`` files of a folder."""
    fs, p = fs_and_path(path)
    info = fs.get_file_info(p)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [path]
    sel = pafs.FileSelector(p, recursive=False)
    prefix = path.rstrip("/")
    return sorted(f"{prefix}/{i.base_name}" for i in fs.get_file_info(sel)
                  if i.type == pafs.FileType.File and i.base_name.endswith(ext))


def _is_image(name: str) -> bool:
    return ("." + name.split(".")[-1].lower()) in IMAGE_EXTS


def _plan(spark: SparkSession, path: str, ext: str, directory, schema: str, tasks: int) -> DataFrame:
    """The rows of ``directory(archive)`` (which end in ``at``, the bytes
    before them in their archive, and ``bytes``) with ``task``, their share of
    all bytes."""
    files = _archives(path, ext)
    some = max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism))
    names = schema.replace(",", " ").split()[::2]

    def run(batches):
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows = [(archive, *r) for r in directory(archive)]
                for s in range(0, len(rows), 1 << 14):
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[s:s + (1 << 14)]],
                                                     schema=kinds)

    from pyspark.sql.pandas.types import to_arrow_schema
    kinds = to_arrow_schema(spark.createDataFrame([], schema).schema)
    listed = spark.createDataFrame([(f,) for f in files], "archive string").repartition(some)
    plan = pin(listed.mapInArrow(run, schema))
    totals = {r["archive"]: r["n"] for r in plan.groupBy("archive").agg(F.sum("bytes").alias("n")).collect()}
    total = sum(totals.values())
    n = max(tasks, -(-total // TASK_BYTES), 1)
    before, bases = 0, []
    for f in files:
        bases.append((f, before))
        before += totals.get(f, 0)
    placed = plan.join(F.broadcast(spark.createDataFrame(bases, "archive string, base long")), "archive")  # a row an archive
    task = F.least(F.floor((F.col("base") + F.col("at")) / F.lit(max(1, total)) * n).cast("int"), F.lit(n - 1))
    return placed.withColumn("task", task).repartitionById(n, "task").sortWithinPartitions("archive", "at")


# --- zip members

def _directory(wanted, archive: str) -> list[tuple]:
    """(index, member, offset, packed, size, method, at, bytes) of the wanted members, by name."""
    with _open(archive) as fh, zipfile.ZipFile(fh) as z:
        members, at, out = sorted((i for i in z.infolist() if wanted(i.filename)), key=lambda i: i.filename), 0, []
        for k, i in enumerate(members):
            out.append((k, i.filename, i.header_offset, i.compress_size, i.file_size, i.compress_type, at, i.compress_size + 64))
            at += i.compress_size + 64
    return out


def _content(fh, offset: int, packed: int, method: int, member: str) -> bytes:
    fh.seek(offset)
    local = fh.read(30)
    if local[:4] != b"PK\x03\x04":
        raise ValueError(f"no member at {offset} for {member!r}")
    name_len, extra_len = struct.unpack("<HH", local[26:30])
    fh.seek(offset + 30 + name_len + extra_len)
    raw = fh.read(packed)
    if len(raw) != packed:
        raise ValueError(f"member {member!r} is truncated")
    if method == zipfile.ZIP_STORED:
        return raw
    if method == zipfile.ZIP_DEFLATED:
        return zlib.decompress(raw, -15)
    raise ValueError(f"member {member!r} has compression method {method}")


def _read_members(batches) -> Iterator[pa.RecordBatch]:
    archive, fh, rows, size = None, None, [], 0
    schema = pa.schema([("index", pa.int64()), ("archive", pa.string()), ("member", pa.string()), ("size", pa.int64()),
                        ("content", pa.binary())])
    try:
        for batch in batches:
            for r in batch.to_pylist():
                if r["archive"] != archive:
                    if fh is not None:
                        fh.close()
                    archive, fh = r["archive"], _open(r["archive"])
                content = _content(fh, r["offset"], r["packed"], r["method"], r["member"])
                rows.append({"index": r["index"], "archive": archive, "member": r["member"], "size": r["size"], "content": content})
                size += len(content)
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
    finally:
        if fh is not None:
            fh.close()
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _members(spark: SparkSession, path: str, wanted, partitions: int) -> DataFrame:
    plan = _plan(spark, path, ".zip", lambda archive: _directory(wanted, archive),
                 "archive string, index long, member string, offset long, packed long, size long, method int, at long, bytes long",
                 partitions)
    return plan.mapInArrow(_read_members, "index long, archive string, member string, size long, content binary")


def read_zip_members(spark: SparkSession, path: str, partitions: int = 8) -> DataFrame:
    """S3: (index, archive, member, size, content) of the image members of a
    zip (or a folder of zips), numbered in name order inside each archive."""
    return _members(spark, path, _is_image, partitions)


def read_zip_manifest(spark: SparkSession, path: str, member: str = "dataset.json") -> DataFrame:
    """S3 labels: the class manifest stored inside the archive (no
    top-level-folder fallback for zips); later duplicates win."""
    from pairlake.operators.pairing import latest_wins
    raw = _members(spark, path, lambda name: name == member, 1)
    doc = raw.select(F.from_json(F.col("content").cast("string"), "labels array<array<string>>").alias("d"))
    rows = doc.select(F.posexplode("d.labels").alias("_pos", "p")).select(
        "_pos", F.col("p")[0].alias("fname"), F.col("p")[1].cast("long").alias("label"))
    return latest_wins(rows, "fname", "label", "_pos")


# --- npz rows

def _npy_header(fh):
    """The header of a .npy stream, by its declared length, and how long it is."""
    magic = fh.read(8)
    if magic[:6] != b"\x93NUMPY":
        raise ValueError("member is not a .npy array")
    size_bytes = 2 if magic[6] == 1 else 4
    length = int.from_bytes(fh.read(size_bytes), "little")
    text = fh.read(length)
    if len(text) != length:
        raise ValueError("npz member is truncated")
    return ast.literal_eval(text.decode("latin1" if magic[6] < 3 else "utf-8")), 8 + size_bytes + length


def _ranges(archive: str, member: str, rows_per: int) -> list[tuple]:
    """(key, descr, shape, fortran, start, lo, hi, at, bytes) of the row ranges
    of a member; ``start`` is where its data lie in the archive, -1 if packed."""
    with _open(archive) as fh, zipfile.ZipFile(fh) as z:
        names = z.namelist()
        key = member if member in names else member + ".npy"
        if key not in names:
            raise KeyError(f"npz has no member {member!r}")
        info, start = z.getinfo(key), -1
        with z.open(key) as m:
            header, length = _npy_header(m)
        if np.dtype(header["descr"]).hasobject:
            raise ValueError("object arrays need pickle; refused")
        if np.dtype(header["descr"]).fields:
            raise ValueError("structured records are no rows of numbers; refused")
        if not header["shape"]:
            raise ValueError("scalar member has no rows")
        if info.compress_type == zipfile.ZIP_STORED:
            fh.seek(info.header_offset + 26)
            name_len, extra_len = struct.unpack("<HH", fh.read(4))
            start = info.header_offset + 30 + name_len + extra_len + length
            whole = int(np.prod(header["shape"])) * np.dtype(header["descr"]).itemsize
            if length + whole > info.compress_size:
                raise ValueError("npz member is truncated")
    n = header["shape"][0]
    per = rows_per if start >= 0 else max(n, 1)
    cuts = [*range(0, n, per), n]
    each = info.compress_size / max(n, 1)
    return [(key, np.dtype(header["descr"]).str, list(header["shape"]), header["fortran_order"], start, lo, hi, int(lo * each),
             int((hi - lo) * each) + 64) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _blocks(r: dict) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows) of a range, in pieces of bounded size."""
    dt, shape, lo, hi = np.dtype(r["descr"]), r["shape"], r["lo"], r["hi"]
    items = int(np.prod(shape[1:])) if len(shape) > 1 else 1
    step = max(1, BATCH_BYTES // max(1, items * dt.itemsize))

    def whole(raw: bytes, want: int) -> np.ndarray:
        if len(raw) != want * dt.itemsize:
            raise ValueError("npz member is truncated")
        return np.frombuffer(raw, dt)

    with _open(r["archive"]) as fh:
        if r["start"] < 0:
            with zipfile.ZipFile(fh) as z, z.open(r["key"]) as m:
                _npy_header(m)
                if r["fortran"]:
                    yield 0, whole(m.read(), shape[0] * items).reshape(shape, order="F")
                    return
                for s in range(0, hi, step):
                    n = min(step, hi - s)
                    yield s, whole(m.read(n * items * dt.itemsize), n * items).reshape([n, *shape[1:]])
            return
        for s in range(lo, hi, step):
            n = min(step, hi - s)
            if r["fortran"]:  # a stretch of each column
                columns = []
                for c in range(items):
                    fh.seek(r["start"] + (c * shape[0] + s) * dt.itemsize)
                    columns.append(whole(fh.read(n * dt.itemsize), n))
                yield s, np.stack(columns, axis=1).reshape([n, *shape[:0:-1]]).transpose(0, *range(len(shape) - 1, 0, -1))
            else:
                fh.seek(r["start"] + s * items * dt.itemsize)
                yield s, whole(fh.read(n * items * dt.itemsize), n * items).reshape([n, *shape[1:]])


def _read_rows(as_binary: bool):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                for first, block in _blocks(r):
                    n = len(block)
                    rows = np.ascontiguousarray(block).reshape(n, -1)
                    data = (pa.array([x.tobytes() for x in rows], pa.binary()) if as_binary else
                            pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * rows.shape[1], pa.int32()),
                                                     pa.array(rows.astype(np.float32).ravel())))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.arange(first, first + n)), pa.array([r["archive"]] * n, pa.string()),
                         pa.array([r["shape"][1:]] * n, pa.list_(pa.int32())), data], ["row_index", "archive", "shape", "data"])
    return run


def read_npz_rows(spark: SparkSession, path: str, name: str = "arr_0", rows_per_partition: int = 65536,
                  as_binary: bool = False, partitions: int = 8) -> DataFrame:
    """(row_index, archive, shape, data): the axis-0 rows of an npz member
    (one archive or a folder of them), in ranges of up to
    ``rows_per_partition`` rows."""
    plan = _plan(spark, path, ".npz", lambda archive: _ranges(archive, name, rows_per_partition),
                 "archive string, key string, descr string, shape array<long>, fortran boolean, start long, lo long, hi long, "
                 "at long, bytes long", partitions)
    kind = "binary" if as_binary else "array<float>"
    return plan.mapInArrow(_read_rows(as_binary), f"row_index long, archive string, shape array<int>, data {kind}")
