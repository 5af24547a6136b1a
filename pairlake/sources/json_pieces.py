"""Records of one large JSON document, read in byte ranges by many tasks.

A range that begins in the middle of a document does not know whether it
begins inside a string, nor how deep.  Three short passes settle that:

1. every range sums up its bytes for both cases: whether its quotes turn
   "outside" into "inside", and by how much its brackets change the depth.
   Composed in order, the sums give each range its true start (one row a
   range on the driver);
2. where the wanted list is the value of a top-level key, the ranges look for
   that key and report where its list opens and closes;
3. each range gives the records that begin in it, reading on past its end to
   close the last one.

Bytes are looked at in numpy; a record's text leaves a task as it stands and
is parsed by Spark.  Memory is bounded by a range and its last record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlake.sinks.blobs import fs_and_path

PIECE = 4 << 20  # bytes of a range
_OPEN, _CLOSE = np.zeros(256, bool), np.zeros(256, bool)
_OPEN[[ord("["), ord("{")]], _CLOSE[[ord("]"), ord("}")]] = True, True


class _Bytes:
    """A range of a file, with what stands before it that matters."""

    def __init__(self, file, start: int, end: int):
        file.seek(start)
        self.raw = file.read(end - start)
        self.data = np.frombuffer(self.raw, np.uint8)
        slash = self.data == 0x5C
        quote = self.data == 0x22
        # a quote is escaped by an odd run of backslashes before it
        at = np.arange(len(self.data))
        last_other = np.maximum.accumulate(np.where(slash, -1, at)) if len(at) else at
        run = np.where(slash, at - last_other, 0)
        ahead = _slashes_before(file, start) if len(slash) and (slash[0] or quote[0]) else 0
        run = np.where(slash & (last_other < 0), at + 1 + ahead, run)
        before = np.r_[ahead, run[:-1]] if len(at) else run
        self.turns = quote & (before % 2 == 0)
        self.inside = np.cumsum(self.turns, dtype=np.int32) % 2 == 1  # after each byte, if it begins outside

    def change(self, begins_inside: bool) -> np.ndarray:
        """Change of depth at each byte."""
        outside = self.inside == begins_inside
        return np.where(outside, _OPEN[self.data].astype(np.int8) - _CLOSE[self.data].astype(np.int8), np.int8(0))

    def depth(self, begins_inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
        change = self.change(begins_inside)
        return change, depth + np.cumsum(change, dtype=np.int32)


def _slashes_before(file, start: int) -> int:
    n = 0
    while start - n > 0:
        step = min(64, start - n)
        file.seek(start - n - step)
        block = file.read(step)
        tail = len(block) - len(block.rstrip(b"\\"))
        n += tail
        if tail < step:
            break
    return n


def _sum_up(path: str, size: int, piece: int):
    def run(batches):
        fs, name = fs_and_path(path)
        with fs.open_input_file(name) as file:
            for batch in batches:
                rows = []
                for k in batch.column(0).to_pylist():
                    b = _Bytes(file, k * piece, min(size, (k + 1) * piece))
                    rows.append((k, bool(b.turns.sum() % 2), int(b.change(False).sum()), int(b.change(True).sum())))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)],
                                                 ["k", "turns", "outside", "inside"])
    return run


def _locate(path: str, size: int, piece: int, key: bytes):
    """Offsets at which the list of a top-level ``key`` opens (+) and top-level
    values close (-)."""
    def run(batches):
        fs, name = fs_and_path(path)
        with fs.open_input_file(name) as file:
            for batch in batches:
                out = []
                for k, inside, depth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    start = k * piece
                    b = _Bytes(file, start, min(size, start + piece))
                    change, after = b.depth(inside, depth)
                    for i in np.flatnonzero((change == 1) & (after == 2) & (b.data == ord("["))).tolist():
                        if _key_before(file, start + i) == key:
                            out.append((start + i, True))
                    out += [(start + i, False) for i in np.flatnonzero((change == -1) & (after == 1)).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()),
                                                  pa.array([x for _, x in out], pa.bool_())], ["at", "opens"])
    return run


def _key_before(file, at: int) -> bytes | None:
    """The key whose value begins at ``at``, as it is written."""
    step = 256
    while True:
        start = max(0, at - step)
        file.seek(start)
        block = file.read(at - start).rstrip()
        key = re.search(rb'(?<!\\)(?:\\\\)*"((?:[^"\\]|\\.)*)"\s*:$', block, re.S)
        if key or start == 0:
            return key and key[1]
        step *= 8


def _records(path: str, size: int, piece: int, level: int, opener: str, first: int, last: int):
    """Texts of the records that begin in a range: values that open with
    ``opener`` at depth ``level`` between the offsets."""
    def run(batches):
        fs, name = fs_and_path(path)
        with fs.open_input_file(name) as file:
            for batch in batches:
                for k, inside, depth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield from one(file, k * piece, inside, depth)

    def one(file, start, inside, depth) -> Iterator[pa.RecordBatch]:
        b = _Bytes(file, start, min(size, start + piece))
        change, after = b.depth(inside, depth)
        begins = np.flatnonzero((change == 1) & (after == level + 1) & (b.data == ord(opener)))
        begins = begins[(begins + start > first) & (begins + start < last)]
        ends = np.flatnonzero((change == -1) & (after == level))
        if not len(begins):
            return
        close = np.searchsorted(ends, begins)
        texts = [b.raw[i:ends[c] + 1] for i, c in zip(begins.tolist(), close.tolist(), strict=True) if c < len(ends)]
        if len(texts) < len(begins):  # the last one goes on
            parts, at = [b.raw[begins[-1]:]], start + len(b.raw)
            inside, depth = bool(b.inside[-1]) != inside, int(after[-1])
            while at < size:
                b = _Bytes(file, at, min(size, at + piece))
                change, after = b.depth(inside, depth)
                end = np.flatnonzero((change == -1) & (after == level))
                if len(end):
                    parts.append(b.raw[:end[0] + 1])
                    break
                parts.append(b.raw)
                inside, depth, at = bool(b.inside[-1]) != inside, int(after[-1]), at + len(b.raw)
            texts.append(b"".join(parts))
        yield pa.RecordBatch.from_arrays([pa.array(begins[:len(texts)] + start, pa.int64()),
                                          pa.array(texts, pa.binary()).cast(pa.string())], ["offset", "record"])
    return run


def read_records(spark: SparkSession, path: str, opener: str = "{", key: str | None = None, piece: int = PIECE) -> DataFrame:
    """(offset, record): the texts of the values that open with ``opener`` in
    the top-level list of a JSON document, or in the list that is the value of
    its top-level ``key`` (the last one, if it repeats).  A null or absent list
    has no records."""
    fs, name = fs_and_path(path)
    info = fs.get_file_info(name)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    size, none = info.size, spark.createDataFrame([], "offset long, record string")
    n = -(-size // piece)
    if not n:
        return none
    tasks = min(n, 4 * spark.sparkContext.defaultParallelism)
    sums = spark.range(0, n, 1, tasks).mapInArrow(_sum_up(path, size, piece), "k long, turns boolean, outside long, inside long")
    starts, inside, depth = [], False, 0
    for r in sorted(sums.collect()):
        starts.append((r["k"], inside, depth))
        depth += r["inside"] if inside else r["outside"]
        inside ^= r["turns"]
    if inside or depth:
        raise ValueError(f"{path} is not a whole JSON document")
    ranges = spark.createDataFrame(starts, "k long, inside boolean, depth int")
    ranges = ranges.repartitionById(tasks, (F.col("k") % tasks).cast("int")) if tasks > 1 else ranges
    first, last, level = -1, size, 1
    if key is not None:
        marks = ranges.mapInArrow(_locate(path, size, piece, key.encode()), "at long, opens boolean")
        first = marks.filter("opens").agg(F.max("at")).first()[0]
        if first is None:
            return none
        last = marks.filter((~F.col("opens")) & (F.col("at") > first)).agg(F.min("at")).first()[0]
        level = 2
    return ranges.mapInArrow(_records(path, size, piece, level, opener, first, last), "offset long, record string")
