"""Exact distance work between feature sets without all pairs.

A set is cut into cells around pivots, rows of the set itself: every row lies
in the cell of its nearest pivot, and a cell knows its number of rows and its
reach, the largest distance of a row from the pivot.  A row at distance d from
a pivot is at least d - reach from every row of that cell (triangle
inequality), so whole (row, cell) pairs are left out:

1. *home*: every visiting row meets the cell whose pivot is nearest, which
   gives a first answer (a k-th distance, the nearest row, a ball it lies in);
2. *away*: it visits the other cells that can still change the answer, judged
   by that lower bound; a row that no cell can help any more visits none.

Visits meet the rows of a cell in tiles of bounded size, one float64 GEMM per
chunk; a crowded cell is split by hash, and so are the visitors of one cell,
whose number is counted first.  Pivots only steer what is left out: results
are the same, and exact, for any pivots.  A set of up to ``block_rows`` rows is
one cell, i.e. one tile.

Sets are told apart by a column ``_g``; all sets of a table share each pass.
Pivots are bounded by ``PIVOT_BYTES`` and the cells' figures by their number,
which is what the driver holds.  Rows with values that are not finite are
never left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlake.operators.index import pin
from pairlake.operators.linalg import sq_dists, to_matrix

PIVOT_BYTES = 8 << 20  # of all pivots of a set, as doubles
TILE_BLOCKS = 16  # a tile's side holds up to this many times ``block_rows`` rows
TILE_ROWS = 1 << 14  # rows of several cells that are met together, where cells are small
SLACK = 1e-6  # of the largest distance: rounding of the norm expansion near zero


@dataclass
class Cells:
    """Pivots and figures of the cells; those of set ``g`` are numbered from
    ``first[g]``."""

    first: dict[str, int]
    pivots: dict[str, np.ndarray | None]  # None: one cell
    tile_rows: int
    count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    reach: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rows: DataFrame | None = None  # id, x, _g, cell and what else the set has

    def size(self, g: str) -> int:
        return 1 if self.pivots[g] is None else len(self.pivots[g])

    def several(self) -> bool:
        return any(p is not None for p in self.pivots.values())

    def pivot_distances(self, g: str, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, distances to the pivots of ``g``) in chunks of bounded size."""
        p = self.pivots[g]
        step = max(1, (1 << 21) // len(p))
        for s in range(0, len(x), step):
            yield s, np.sqrt(sq_dists(x[s:s + step], p))


def build(df: DataFrame, block_rows: int, counts: dict[str, int] | None = None) -> Cells:
    """Cells of the sets in ``df`` (id, x, _g and other columns)."""
    if counts is None:
        counts = {r[0]: r[1] for r in df.groupBy("_g").count().collect()}
    wanted = {g: math.ceil(n / block_rows) for g, n in counts.items()}
    pivots: dict[str, np.ndarray | None] = dict.fromkeys(counts)
    many = [g for g in counts if wanted[g] > 1]
    if many:
        share = F.lit(0.0)
        for g in many:
            share = F.when(F.col("_g") == g, F.lit(wanted[g] / counts[g])).otherwise(share)
        draw = F.pmod(F.xxhash64("id", "x"), F.lit(1 << 30)) / float(1 << 30)
        drawn: dict[str, list] = {}
        for r in df.filter(F.col("_g").isin(many)).filter(draw < share).select("_g", "x").toLocalIterator():
            kept = drawn.setdefault(r["_g"], [])
            if len(kept) * 8 * max(1, len(r["x"])) < PIVOT_BYTES and all(v is not None and math.isfinite(v) for v in r["x"]):
                kept.append(r["x"])
        pivots |= {g: np.unique(np.array(p, np.float64), axis=0) for g, p in drawn.items() if len(p) > 1}
    first, at = {}, 0
    for g in sorted(counts):
        first[g] = at
        at += 1 if pivots[g] is None else len(pivots[g])
    cells = Cells(first, pivots, block_rows * TILE_BLOCKS)
    rows = assign(df, cells, "_g")
    cells.rows = pin(rows) if cells.several() else rows
    cells.count, cells.reach = np.zeros(at, np.int64), np.zeros(at)
    if cells.several():
        for r in cells.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("reach")).collect():
            cells.count[r["cell"]], cells.reach[r["cell"]] = r["n"], r["reach"]
    else:
        for g, n in counts.items():
            cells.count[first[g]] = n
    return cells


def assign(df: DataFrame, cells: Cells, g: str) -> DataFrame:
    """Append ``cell``, that of the nearest pivot of the set named by column
    ``g``, and ``away``, the distance from it."""
    if not cells.several():
        number = F.lit(None).cast("int")
        for name, k in cells.first.items():
            number = F.when(F.col(g) == name, F.lit(k)).otherwise(number)
        return df.withColumn("cell", number).withColumn("away", F.lit(0.0)).filter("cell is not null")
    schema = df.select("*", F.lit(0).alias("cell"), F.lit(0.0).alias("away")).schema
    parts = Cells(cells.first, cells.pivots, cells.tile_rows)  # without the table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, of = to_matrix(batch.column("x")), np.array(batch.column(g).to_pylist(), object)
            cell, away = np.full(len(x), -1, np.int32), np.zeros(len(x))
            for name, first in parts.first.items():
                mine = np.flatnonzero(of == name)
                if not len(mine):
                    continue
                if parts.pivots[name] is None:
                    cell[mine] = first
                    continue
                for s, d in parts.pivot_distances(name, x[mine]):
                    here = mine[s:s + len(d)]
                    near = np.argmin(d, axis=1)
                    cell[here] = first + near
                    away[here] = np.nan_to_num(d[np.arange(len(d)), near], nan=0.0, posinf=0.0)
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], schema.names)
            yield out.filter(pa.array(cell >= 0))
    return df.mapInArrow(run, schema)


def home(cells: Cells, visitors: DataFrame, index: DataFrame, kernel, schema: str, work: dict | None = None) -> DataFrame:
    """``kernel`` on every visitor (columns ``cell``, ``id``, ``x``, ...) and its own cell's rows."""
    if work is None and visitors is index and not cells.several():
        visits = cells.count
    else:
        visits = _per_cell(visitors.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), len(cells.count))
    if work is not None:
        work["home"] = work.get("home", 0) + int((visits * cells.count).sum())
    return _meet(cells, visitors, visits, index, kernel, schema)


Need = Callable[[np.ndarray, np.ndarray, dict[str, np.ndarray], slice], np.ndarray]


def _in_groups(cells: Cells, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The group of each cell, neighbours by number in a set of up to ``most``
    rows together (a larger cell is one alone), and the groups' rows."""
    of, rows, ends = np.zeros(len(cells.count), np.int64), [], set(cells.first.values())
    for c, n in enumerate(cells.count.tolist()):
        if not rows or c in ends or rows[-1] + n > most:
            rows.append(0)
        rows[-1] += n
        of[c] = len(rows) - 1
    return of, np.array(rows, np.int64)


def _each_cell(kernel, merge, most: int):
    """``kernel`` on each cell of a group and the visitors that want it, up to
    ``most`` of either at a time; what it gives is merged to a row a visitor
    before it leaves the tile."""
    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return kernel(a.slice(0, 0), b.slice(0, 0))
        b = b.take(pa.array(np.argsort(b.column("_cell").to_numpy(), kind="stable")))
        numbers, begins = np.unique(b.column("_cell").to_numpy(), return_index=True)
        lists = a.column("_cells").combine_chunks()
        wanted = lists.flatten().to_numpy()
        order = np.argsort(wanted, kind="stable")
        rows, wanted = np.repeat(np.arange(a.num_rows), lists.value_lengths().to_numpy())[order], wanted[order]
        lows, highs = np.searchsorted(wanted, numbers), np.searchsorted(wanted, numbers, "right")
        out, held, a = [], 0, a.drop_columns(["_cells"])
        for begin, end, low, high in zip(begins, [*begins[1:], b.num_rows], lows, highs, strict=True):
            for s in range(low, high, most):
                some = a.take(pa.array(rows[s:min(s + most, high)]))
                for t in range(begin, end, most):
                    out.append(kernel(some, b.slice(t, min(most, end - t))))
                    held += some.num_rows
                    if held > 1 << 18:
                        out, held = [merge(pa.concat_tables(out))], 0
        return merge(pa.concat_tables(out)) if out else kernel(a.slice(0, 0), b.slice(0, 0))
    return run


def away(cells: Cells, visitors: DataFrame, g: str, need: Need, state: list[str], index: DataFrame, kernel, schema: str,
         merge, work: dict | None = None) -> DataFrame | None:
    """``kernel`` on every visitor and each other cell it needs.  A visitor is
    sent once to each group of cells that holds some it needs, with their
    numbers; ``merge`` makes one row a visitor of what the cells of a group gave.

    ``need(least, most, state, cells)`` tells, for visitors (rows) and the
    cells of a set (columns, numbered by the slice), which are needed, from
    the least and most squared distance of the cell's rows and the visitors'
    ``state`` columns.  None where no set has a second cell."""
    if not cells.several():
        return None
    plain = Cells(cells.first, cells.pivots, cells.tile_rows, cells.count, cells.reach)

    def pairs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        x, of = to_matrix(batch.column("x")), np.array(batch.column(g).to_pylist(), object)
        at, own = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in state}, batch.column("cell").to_numpy()
        for name, first in plain.first.items():
            mine = np.flatnonzero(of == name)
            if plain.pivots[name] is None or not len(mine):
                continue
            numbers = slice(first, first + plain.size(name))
            for s, d in plain.pivot_distances(name, x[mine]):
                here = mine[s:s + len(d)]
                slack = SLACK * max(1.0, float(np.nanmax(d, initial=0.0)))
                least = np.maximum(d - plain.reach[numbers] - slack, 0.0) ** 2
                most = (d + plain.reach[numbers] + slack) ** 2
                wanted = need(least, most, {c: v[here] for c, v in at.items()}, numbers)
                wanted[np.arange(len(here)), own[here] - first] = False
                rows, to = np.nonzero(wanted)
                yield here[rows], (first + to).astype(np.int32)

    group, group_rows = _in_groups(cells, max(cells.tile_rows, TILE_ROWS))
    rows_of = cells.count

    def calls(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(visitors, their groups, where their cells begin and end, cells)."""
        for rows, to in pairs(batch):
            if len(rows):
                at = np.flatnonzero(np.r_[True, (np.diff(rows) != 0) | (np.diff(group[to]) != 0)])
                yield rows[at], group[to[at]], np.r_[at, len(rows)], to

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met = np.zeros(len(group_rows), np.int64), np.zeros(len(group_rows))
        for batch in batches:
            for _, groups, _, to in calls(batch):
                total += np.bincount(groups, minlength=len(total))
                met += np.bincount(group[to], weights=rows_of[to], minlength=len(met))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some]), pa.array(met[some].astype(np.int64))], ["cell", "n", "met"])

    keep = visitors.drop("cell")
    names = keep.columns

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.select(names)
            for rows, groups, at, to in calls(batch):
                for s in range(0, len(rows), 1 << 14):
                    e = min(s + (1 << 14), len(rows))
                    some = rest.take(pa.array(rows[s:e]))
                    lists = pa.ListArray.from_arrays(pa.array((at[s:e + 1] - at[s]).astype(np.int32)), pa.array(to[at[s]:at[e]]))
                    yield pa.RecordBatch.from_arrays([*some.columns, lists, pa.array(groups[s:e].astype(np.int32))],
                                                     [*names, "_cells", "cell"])

    visits = np.zeros(len(group_rows), np.int64)
    counted = visitors.mapInArrow(count, "cell int, n bigint, met bigint").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("met").alias("met"))
    for r in counted.collect():
        visits[r["cell"]] = r["n"]
        if work is not None:
            work["away"] = work.get("away", 0) + r["met"]
    if not visits.any():
        return None
    going = visitors.mapInArrow(visit, keep.select("*", F.array(F.lit(0)).alias("_cells"), F.lit(0).alias("cell")).schema)
    numbers = F.broadcast(visitors.sparkSession.createDataFrame(  # a row a cell
        [(c, int(k)) for c, k in enumerate(group)], "_cell int, _group int"))
    grouped = index.withColumnRenamed("cell", "_cell").join(numbers, "_cell").withColumnRenamed("_group", "cell")
    groups = Cells(cells.first, cells.pivots, max(cells.tile_rows, TILE_ROWS), group_rows)
    return _meet(groups, going, visits, grouped, _each_cell(kernel, merge, cells.tile_rows), schema)


def largest(cells: Cells, index: DataFrame, value: str) -> np.ndarray:
    """The largest value of a column in each cell (-inf in an empty one)."""
    out = np.full(len(cells.count), -np.inf)
    for r in index.groupBy("cell").agg(F.max(value).alias("m")).collect():
        out[r["cell"]] = np.inf if r["m"] is None or math.isnan(r["m"]) else r["m"]
    return out


def _per_cell(counted: DataFrame, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for r in counted.collect():
        out[r["cell"]] = r["n"]
    return out


def _meet(cells: Cells, visitors: DataFrame, visits: np.ndarray, index: DataFrame, kernel, schema: str) -> DataFrame:
    """Visitors and index rows of each cell in tiles: the cell's rows in
    ``splits`` parts by hash, its visitors in ``chunks``."""
    spark = visitors.sparkSession
    splits = np.maximum(1, -(-cells.count // cells.tile_rows))
    chunks = np.maximum(1, -(-visits // cells.tile_rows))
    before = np.r_[0, np.cumsum(splits * chunks)]
    if len(splits) == before[-1]:  # a cell is a tile
        a, b = visitors.withColumn("t", F.col("cell").cast("long")), index.withColumn("t", F.col("cell").cast("long"))
    else:
        meta = F.broadcast(spark.createDataFrame(  # a row a cell, whose number the pivots' bytes bound
            [(c, *map(int, v)) for c, v in enumerate(zip(splits, chunks, before, strict=False))],
            "cell int, splits long, chunks long, before long"))

        def tiles(df, own, other, key):
            part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.col(own))
            wide = df.withColumn("_part", F.lit(0)).join(meta, "cell").withColumn("_part", part)
            return wide.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).withColumn(
                "t", F.col("before") + key).select(*df.columns, "t")
        a = tiles(visitors, "chunks", "splits", F.col("_other") * F.col("chunks") + F.col("_part"))
        b = tiles(index, "splits", "chunks", F.col("_part") * F.col("chunks") + F.col("_other"))
    b = b.select(*[F.col(c).alias(c) for c in b.columns])  # columns of its own where both sides are one table
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    parts = max(1, min(int(before[-1]), width))
    if parts > 1:
        a, b = a.repartition(parts, "t"), b.repartition(parts, "t")
    return a.drop("cell").groupBy("t").cogroup(b.drop("cell").groupBy("t")).applyInArrow(kernel, schema)
