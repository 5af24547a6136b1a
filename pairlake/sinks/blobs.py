"""Writing one file per row (images, tensors) or one archive per partition
from executors, through pyarrow filesystems (local, HDFS, S3 ...), so the
driver never touches the bytes."""

from __future__ import annotations

import io
import struct
import uuid
import zipfile
import zlib
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ARCHIVE_BYTES = 64 << 20  # of content in an archive that is written, about
ARCHIVE_ROWS = 1 << 15  # of rows in it, as a directory entry stays in memory for each


def fs_and_path(uri: str):
    """pyarrow filesystem and path for a local path or URI (file:/x too)."""
    from pyarrow import fs
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def png_bytes(pixels: np.ndarray) -> bytes:
    """Minimal PNG encoder (8-bit grey / RGB / RGBA, no filtering)."""
    h, w = pixels.shape[:2]
    c = 1 if pixels.ndim == 2 else pixels.shape[2]
    color = {1: 0, 3: 2, 4: 6}[c]
    rows = pixels.reshape(h, w * c).astype(np.uint8)
    raw = b"".join(b"\x00" + rows[r].tobytes() for r in range(h))

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data) & 0xFFFFFFFF)
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def npy_bytes(arr: np.ndarray) -> bytes:
    buf = io.BytesIO()
    np.save(buf, arr)
    return buf.getvalue()


@contextmanager
def publishing(fs, path: str):
    """A stream that writes under a temporary name, which is moved to the final
    one at the end, so that a lost or repeated task never leaves a torn file."""
    folder, name = path.rsplit("/", 1)
    fs.create_dir(folder, recursive=True)
    hidden = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(hidden, buffer_size=1 << 20) as out:
        yield out
    fs.move(hidden, path)


def publish(fs, path: str, data: bytes) -> None:
    """Write a whole file under its final name or not at all."""
    with publishing(fs, path) as out:
        out.write(data)


def write_files(df: DataFrame, folder: str, name: str, content: str) -> DataFrame:
    """One file per row: ``folder/<name>`` gets the row's ``content`` bytes.
    Returns (name, size) rows; the files are written when it is evaluated."""
    def run(batches):
        fs, base = fs_and_path(folder)
        for rb in batches:
            names = rb.column(name).to_pylist()
            sizes = []
            for n, data in zip(names, rb.column(content).to_pylist()):
                publish(fs, f"{base.rstrip('/')}/{n}", data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())],
                                             names=["name", "size"])
    return df.select(name, content).mapInArrow(run, "name string, size long")


def write_archives(df: DataFrame, folder: str, kind: str, name: str, content: str | None = None,
                   matrix: str | None = None, key: str | None = None) -> DataFrame:
    """The rows of each partition in archives of about ``ARCHIVE_BYTES`` and up
    to ``ARCHIVE_ROWS`` rows, so that a task holds no more however large its
    partition is: ``kind='zip'`` stores (name, content) rows as members, passed
    on as they come; ``kind='npz'`` stacks ``matrix`` rows as ``arr_0`` (stored,
    uncompressed, so it can be read back in row ranges) with ``key`` as
    ``ids``.  Returns (archive, rows)."""
    if kind not in ("zip", "npz"):
        raise ValueError(f"unknown archive kind {kind!r}")
    most_bytes, most_rows = ARCHIVE_BYTES, ARCHIVE_ROWS

    def run(batches):
        from pyspark import TaskContext
        fs, base = fs_and_path(folder)
        part, written = TaskContext.get().partitionId(), 0
        for write in (zips if kind == "zip" else stacks)(batches):
            fname = f"part-{part:05d}{f'_{written:05d}' if written else ''}.{kind}"
            with publishing(fs, f"{base.rstrip('/')}/{fname}") as out:
                rows = write(out)
            written += 1
            yield pa.RecordBatch.from_arrays([pa.array([fname]), pa.array([rows], pa.int64())], names=["archive", "rows"])

    def zips(batches):
        rows = ((n.as_py(), c.as_py()) for rb in batches for n, c in zip(rb.column(name), rb.column(content), strict=True))
        ahead = next(rows, None)

        def write(out) -> int:
            nonlocal ahead
            n = size = 0
            with zipfile.ZipFile(out, "w", compression=zipfile.ZIP_STORED) as z:
                while ahead is not None and n < most_rows and size < most_bytes:
                    z.writestr(*ahead)
                    n, size, ahead = n + 1, size + len(ahead[1]), next(rows, None)
            return n
        while ahead is not None:
            yield write

    def stacks(batches):
        from pairlake.operators.linalg import to_matrix
        kept: list[pa.Table] = []

        def write(out) -> int:
            t = pa.concat_tables(kept)
            kept.clear()
            np.savez(out, arr_0=to_matrix(t.column(matrix)).astype(np.float32),
                     ids=np.asarray(t.column(key).to_pylist(), dtype=np.int64))
            return t.num_rows
        for rb in batches:
            for s in range(0, rb.num_rows, most_rows):
                kept.append(pa.Table.from_batches([rb.slice(s, most_rows)]))
                if sum(t.nbytes for t in kept) >= most_bytes or sum(t.num_rows for t in kept) >= most_rows:
                    yield write
        if kept:
            yield write
    cols = list(dict.fromkeys(c for c in (name, content, matrix, key) if c))
    return df.select(*cols).mapInArrow(run, "archive string, rows long")
