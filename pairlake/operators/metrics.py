"""Set-level evaluation of two feature tables.

Distance work goes through the cells of ``cells.py``: a row meets its home
cell, and then only those cells that the triangle inequality leaves open.
What leaves a tile is already reduced per row (k smallest distances,
any-within flags, best realism ratio, nearest id), and the final per-row merge
is an ordinary ``groupBy``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlake.functions.util import as_double_array
from pairlake.operators import cells as C
from pairlake.operators.index import global_index, pin
from pairlake.operators.linalg import collect_grouped_moments, feature_moments, sq_dists, to_matrix


def _chunk(others: int) -> int:
    """Rows of A per GEMM inside a tile: bounds the distance block to 4M doubles."""
    return max(1, min(1024, (1 << 22) // max(1, others)))


def _ids(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


# ---------------------------------------------------------------- V3 radii


def _knn_kernel(k: int):
    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows == 0 or b.num_rows == 0:
            return pa.table({"id": pa.array([], pa.int64()), "d": pa.array([], pa.list_(pa.float64())),
                             "_g": pa.array([], pa.string())})
        xa, xb, ids = to_matrix(a.column("x")), to_matrix(b.column("x")), _ids(a, "id")
        m = min(k + 1, len(xb))
        out = []
        step = _chunk(len(xb))
        for s in range(0, len(xa), step):
            d = sq_dists(xa[s:s + step], xb)
            part = np.partition(d, m - 1, axis=1)[:, :m] if m < d.shape[1] else d
            out.extend(np.sort(part, axis=1).tolist())
        return pa.table({"id": pa.array(ids, pa.int64()), "d": pa.array(out, pa.list_(pa.float64())), "_g": a.column("_g")})
    return run


def _knn_merge(k: int):
    def run(t: pa.Table) -> pa.Table:
        ids, first, row = np.unique(_ids(t, "id"), return_index=True, return_inverse=True)
        lists = t.column("d").combine_chunks()
        d, row = lists.flatten().to_numpy(), np.repeat(row, lists.value_lengths().to_numpy())
        order = np.lexsort((d, row))
        d, row = d[order], row[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) <= k
        ends = np.cumsum(np.bincount(row[kept], minlength=len(ids)))
        return pa.table({"id": pa.array(ids, pa.int64()), "d": pa.ListArray.from_arrays(
            pa.array(np.r_[0, ends].astype(np.int32)), pa.array(d[kept])), "_g": t.column("_g").take(pa.array(first))})
    return run


def _vectors(df: DataFrame, id_col: str, vec: str, *extra) -> DataFrame:
    """(id, x[, extra]) for the tile operator.  float32 vectors stay float32
    through the replicated shuffle (half the bytes); the kernels widen to
    float64 in numpy, which gives the same values as casting first."""
    t = df.schema[vec].dataType.simpleString() if vec in df.columns else ""
    x = F.col(vec) if t in ("array<float>", "array<double>") else as_double_array(vec)
    return df.select(F.col(id_col).cast("long").alias("id"), x.alias("x"), *extra)


def _nearest(cells: C.Cells, visitors: DataFrame, k: int, work: dict | None) -> DataFrame:
    """(_g, id, d): the k + 1 smallest squared distances of each visitor (id,
    x, _g, cell) to the rows of set ``_g``, sorted."""
    kernel, schema = _knn_kernel(k), "id long, d array<double>, _g string"
    index = cells.rows.select("id", "x", "cell")

    def merge(found: DataFrame) -> DataFrame:
        best = found.groupBy("_g", "id").agg(F.array_sort(F.flatten(F.collect_list("d"))).alias("d"))
        return best.select("_g", "id", F.slice("d", 1, k + 1).alias("d"))

    best = merge(C.home(cells, visitors.select("id", "x", "_g", "cell"), index, kernel, schema, work))
    if not cells.several():
        return best
    best = pin(best)
    enough = cells.count > k

    def need(least, most, state, numbers):
        # the k-th distance so far, or the farthest that k + 1 rows of one cell can be
        sure = np.where(enough[numbers], most, np.inf).min(axis=1)
        return ~(least > np.fmin(state["kth"], sure)[:, None])

    kth = F.coalesce(F.try_element_at("d", F.lit(k + 1)), F.lit(float("inf")))
    roam = visitors.select("id", "x", "_g", "cell").join(best.select("_g", "id", kth.alias("kth")), ["_g", "id"])
    more = C.away(cells, roam, "_g", need, ["kth"], index, kernel, schema, _knn_merge(k), work)
    return best if more is None else merge(best.select("id", "d", "_g").unionByName(more))


def knn_distances(a: DataFrame, b: DataFrame, id_col: str, vec: str, k: int, block_rows: int = 4096,
                  b_id: str | None = None, work: dict | None = None) -> DataFrame:
    """For each row of ``a``: its k+1 smallest squared distances to ``b``
    (sorted).  With a == b the row itself is included (distance 0), as the
    radius definition requires.  ``work`` receives the row pairs that met at
    ``home`` and ``away``."""
    one = F.lit("").alias("_g")
    cells = C.build(_vectors(b, b_id or id_col, vec, one), block_rows)
    visitors = cells.rows if a is b and (b_id or id_col) == id_col else C.assign(_vectors(a, id_col, vec, one), cells, "_g")
    return _nearest(cells, visitors, k, work).select("id", "d")


def manifold_radii(df: DataFrame, id_col: str, vec: str, k: int = 3, block_rows: int = 4096,
                   work: dict | None = None) -> DataFrame:
    """V3: squared distance to the k-th neighbour; index k of the 0-based
    ascending order including the row itself, so duplicates count."""
    nn = knn_distances(df, df, id_col, vec, k, block_rows, work=work)
    return nn.select(F.col("id").alias(id_col), F.try_element_at("d", F.lit(k + 1)).alias("radius"))


def manifold_radii_grouped(df: DataFrame, group: str, id_col: str, vec: str, k: int = 3, block_rows: int = 4096,
                           counts: dict | None = None) -> DataFrame:
    """V3 for several feature sets at once: each row's radius among the rows
    of its own ``group`` (all groups share the passes).  Returns (group, id,
    radius)."""
    v = _vectors(df, id_col, vec, F.col(group).cast("string").alias("_g"))
    cells = C.build(v, block_rows, None if counts is None else {str(g): n for g, n in counts.items()})
    return _nearest(cells, cells.rows, k, None).select(
        F.col("_g").alias(group), F.col("id").alias(id_col), F.try_element_at("d", F.lit(k + 1)).alias("radius"))


def kth_smallest(a: DataFrame, b: DataFrame, id_col: str, vec: str, k: int, block_rows: int = 4096) -> DataFrame:
    """T4: the k-th smallest (1-based) squared distance from each row of ``a``
    to the rows of ``b``, by per-tile partial selection."""
    nn = knn_distances(a, b, id_col, vec, k - 1, block_rows)
    return nn.select(F.col("id").alias(id_col), F.try_element_at("d", F.lit(k)).alias("kth"))


def kth_smallest_long(df: DataFrame, key: str, dist: str, k: int) -> DataFrame:
    """T4 for an already long (key, dist) table: rank inside each key with a
    per-key window (planned as WindowGroupLimit), keep rank k."""
    w = Window.partitionBy(key).orderBy(F.col(dist).asc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == k).select(key, F.col(dist).alias("kth"))


# ---------------------------------------------------------------- percentiles


SELECT_ROWS = 4096  # values that are sorted on the driver once a rank is known to lie among them
NARROW = 1.0 / 2000  # share of the rows on either side of a rank that stays in each round


def select_ranks(v: DataFrame, ranks: list[int], n: int) -> dict[int, float]:
    """The values at 0-based ``ranks`` of the ascending order of column ``v``
    (no nulls and no NaN; ``n`` rows), without sorting it.

    Every rank lies in an open interval, first the whole line.  A round takes
    two approximate percentiles around it inside the interval and counts, over
    all rows, how many values lie below and at either, which gives the value or
    a narrower interval.  Heavily repeated values end a round rather than
    stall it, as values at the ends are told from those between.  All ranks
    share the two aggregations of a round, whose partial results are one row a
    task; once at most ``SELECT_ROWS`` values are left they are sorted."""
    found: dict[int, float] = {}
    open_ = {r: (None, None, 0, n) for r in ranks}  # below, above, rows up to below, rows between

    def inside(lo, hi):
        c = F.lit(True)
        c = c if lo is None else c & (F.col("v") > lo)
        return c if hi is None else c & (F.col("v") < hi)

    while open_:
        for r, (lo, hi, before, between) in list(open_.items()):
            if between <= SELECT_ROWS:
                found[r] = sorted(x["v"] for x in v.filter(inside(lo, hi)).collect())[r - before]
                del open_[r]
        if not open_:
            break
        cuts = []
        for r, (lo, hi, before, between) in open_.items():
            at = [min(1.0, max(0.0, (r - before) / between + d)) for d in (-NARROW, NARROW)]
            cuts.append(F.percentile_approx(F.when(inside(lo, hi), F.col("v")), at, int(4 / NARROW)))
        cuts = v.agg(*[c.alias(f"c{i}") for i, c in enumerate(cuts)]).first()
        counts = [F.count(F.when(test, 1)) for a, b in cuts
                  for test in (F.col("v") < a, F.col("v") <= a, F.col("v") < b, F.col("v") <= b)]
        counts = v.agg(*[c.alias(f"n{i}") for i, c in enumerate(counts)]).first()
        for i, (r, (lo, hi, before, between)) in enumerate(list(open_.items())):
            (a, b), (under_a, to_a, under_b, to_b) = cuts[i], counts[4 * i:4 * i + 4]
            if r < under_a:
                open_[r] = (lo, a, before, under_a - before)
            elif r < to_a:
                found[r] = a
            elif r < under_b:
                open_[r] = (a, b, to_a, under_b - to_a)
            elif r < to_b:
                found[r] = b
            else:
                open_[r] = (b, hi, to_b, before + between - to_b)
            if r in found:
                del open_[r]
    return found


def percentiles_frame(df: DataFrame, value: str, pcts: dict[str, float]) -> DataFrame:
    """Numpy-style linear-interpolated percentiles as one row (one column
    per name), by distributed selection of the two neighbouring ranks: neither
    a sort nor an exchange of the values.  Nulls are left out, NaN ranks last."""
    v = df.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull()).persist()
    try:
        n, real = v.agg(F.count(F.lit(1)), F.count(F.when(~F.isnan("v"), 1))).first()
        at = {name: (n - 1) * pct / 100.0 for name, pct in pcts.items()}
        ends = {r for p in at.values() for r in (math.floor(p), math.ceil(p))} if n else set()
        values = select_ranks(v.filter(~F.isnan("v")), sorted(r for r in ends if r < real), real)
    finally:
        v.unpersist()

    def column(p: float):
        if not n:
            return F.lit(None)
        lo, hi = (values.get(r, float("nan")) for r in (math.floor(p), math.ceil(p)))
        return F.lit(lo if lo == hi else lo + (hi - lo) * (p - math.floor(p)))
    return df.sparkSession.range(1).select(*[column(p).cast("double").alias(name) for name, p in at.items()])


def percentile_frame(df: DataFrame, value: str, pct: float, name: str = "percentile") -> DataFrame:
    return percentiles_frame(df, value, {name: pct})


def exact_percentile(df: DataFrame, value: str, pct: float) -> float | None:
    return percentile_frame(df, value, pct, "p").first()["p"]


def clamp_radii(radii: DataFrame, pct: float | None, value: str = "radius") -> DataFrame:
    """V4: radii strictly above the percentile become 0 (no-op for None)."""
    if pct is None:
        return radii
    radii = pin(radii)
    cut = exact_percentile(radii, value, pct)
    return radii.withColumn(value, F.when(F.col(value) > F.lit(cut), F.lit(0.0)).otherwise(F.col(value)))


# ---------------------------------------------------------------- V5 evaluate


def _manifold_kernel(eps: float):
    def run(e: pa.Table, r: pa.Table) -> pa.Table:
        if e.num_rows == 0 or r.num_rows == 0:
            return pa.table({"id": pa.array([], pa.int64()), "inside": pa.array([], pa.bool_()),
                             "realism": pa.array([], pa.float64()), "min_d": pa.array([], pa.float64()),
                             "nearest": pa.array([], pa.int64())})
        xe, xr = to_matrix(e.column("x")), to_matrix(r.column("x"))
        rr = r.column("r").to_numpy(zero_copy_only=False).astype(np.float64)
        rid = _ids(r, "id")
        ins, real, mind, near = [], [], [], []
        step = _chunk(len(xr))
        for s in range(0, len(xe), step):
            d = sq_dists(xe[s:s + step], xr)
            ins.append((d <= rr[None, :]).any(axis=1))
            real.append((rr[None, :] / (d + eps)).max(axis=1))
            # nearest: smallest distance, then smallest id on ties
            dmin = d.min(axis=1)
            tied = np.where(d == dmin[:, None], rid[None, :], np.iinfo(np.int64).max)
            mind.append(dmin)
            near.append(tied.min(axis=1))
        return pa.table({"id": pa.array(_ids(e, "id"), pa.int64()), "inside": pa.array(np.concatenate(ins)),
                         "realism": pa.array(np.concatenate(real)), "min_d": pa.array(np.concatenate(mind)),
                         "nearest": pa.array(np.concatenate(near), pa.int64())})
    return run


def _manifold_merge(t: pa.Table) -> pa.Table:
    ids, at = _ids(t, "id"), [t.column(c).to_numpy() for c in ("inside", "realism", "min_d", "nearest")]
    order = np.lexsort((at[3], at[2], ids))  # the nearest row first, then by id; NaN last
    inside, realism, min_d, nearest = (v[order] for v in at)
    ids, first = np.unique(ids[order], return_index=True)
    return pa.table({"id": pa.array(ids, pa.int64()), "inside": pa.array(np.logical_or.reduceat(inside, first)),
                     "realism": pa.array(np.maximum.reduceat(realism, first)), "min_d": pa.array(min_d[first]),
                     "nearest": pa.array(nearest[first], pa.int64())})


def manifold_evaluate(ref: DataFrame, radii: DataFrame, evals: DataFrame, id_col: str, vec: str,
                      eps: float = 1e-5, block_rows: int = 4096, work: dict | None = None) -> DataFrame:
    """V5: per evaluated row -- inside any reference ball (d <= r), realism
    max r/(d + eps), squared distance to and id of the nearest reference
    (first id on ties).  A cell is visited only if it can hold a nearer row, a
    ball around the row or a better ratio than the home cell gave."""
    one = F.lit("").alias("_g")
    cells = C.build(_vectors(ref.join(pin(radii), id_col), id_col, vec, F.col("radius").cast("double").alias("r"), one),
                    block_rows)
    index = cells.rows.select("id", "x", "r", "cell")
    visitors = C.assign(_vectors(evals, id_col, vec, one), cells, "_g")
    kernel, schema = _manifold_kernel(eps), "id long, inside boolean, realism double, min_d double, nearest long"

    def merge(found: DataFrame) -> DataFrame:
        best = found.groupBy("id").agg(F.bool_or("inside").alias("inside"), F.max("realism").alias("realism"),
                                       F.min(F.struct("min_d", "nearest")).alias("_b"))
        return best.select("id", "inside", "realism", "_b.min_d", "_b.nearest")

    best = merge(C.home(cells, visitors.select("id", "x", "cell"), index, kernel, schema, work))
    if cells.several():
        best = pin(best)
        ball = C.largest(cells, cells.rows, "r")

        def need(least, most, state, numbers):
            r = ball[numbers]
            nearer = ~(least > state["min_d"][:, None])
            around = ~(least > r) & ~state["inside"].astype(bool)[:, None]
            return nearer | around | ~(r / (least + eps) < state["realism"][:, None])

        roam = visitors.select("id", "x", "_g", "cell").join(best.select("id", "inside", "realism", "min_d"), "id", "left")
        roam = roam.fillna(float("inf"), ["min_d"]).fillna(-1.0, ["realism"]).fillna(False, ["inside"])
        more = C.away(cells, roam, "_g", need, ["inside", "realism", "min_d"], index, kernel, schema, _manifold_merge, work)
        best = best if more is None else merge(best.unionByName(more))
    return best.withColumnRenamed("id", id_col)


def manifold_join(a: DataFrame, b: DataFrame, radii_b: DataFrame, id_col: str, vec: str,
                  block_rows: int = 4096) -> DataFrame:
    """Rows of ``a`` within the ball of at least one row of ``b``."""
    ev = manifold_evaluate(b, radii_b, a, id_col, vec, block_rows=block_rows)
    inside = ev.filter("inside").select(id_col)
    return a.join(inside, id_col, "left_semi")


# ---------------------------------------------------------------- V6 P / R


def _inside_kernel():
    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        inside = np.zeros(a.num_rows, bool)
        if a.num_rows and b.num_rows:
            xa, xb = to_matrix(a.column("x")), to_matrix(b.column("x"))
            rb = b.column("r").to_numpy(zero_copy_only=False).astype(np.float64)
            step = _chunk(len(xb))
            for s in range(0, len(xa), step):
                inside[s:s + step] = (sq_dists(xa[s:s + step], xb) <= rb[None, :]).any(axis=1)
        names = {"id": a.column("id"), "_g": a.column("_g")} if a.num_rows else {
            "id": pa.array([], pa.int64()), "_g": pa.array([], pa.string())}
        return pa.table({**names, "inside": pa.array(inside)})
    return run


def _inside_merge(t: pa.Table) -> pa.Table:
    ids, first, row = np.unique(_ids(t, "id"), return_index=True, return_inverse=True)
    hits = np.bincount(row[t.column("inside").to_numpy()], minlength=len(ids))
    return pa.table({"id": pa.array(ids, pa.int64()), "_g": t.column("_g").take(pa.array(first)), "inside": pa.array(hits > 0)})


def precision_recall_flags(ref: DataFrame, sample: DataFrame, id_col: str, vec: str, k: int = 3,
                           block_rows: int = 4096, work: dict | None = None) -> DataFrame:
    """V6 per row: a reference row is recalled when it lies in some sample
    ball, a sample row is precise when it lies in some reference ball (both
    boundaries inclusive).  Both sets share every pass; a row that lies in a
    ball of its home cell visits no other, and the rest only cells whose
    largest ball can reach them."""
    both = (ref.select(F.lit("ref").alias("_g"), id_col, vec)
            .unionByName(sample.select(F.lit("sample").alias("_g"), id_col, vec)))
    cells = C.build(_vectors(both, id_col, vec, "_g"), block_rows)
    radii = pin(_nearest(cells, cells.rows, k, work).select("_g", "id", F.try_element_at("d", F.lit(k + 1)).alias("r")))
    index = cells.rows.join(radii, ["_g", "id"]).select("id", "x", "r", "cell")
    other = F.when(F.col("_g") == "ref", "sample").otherwise("ref")
    visitors = C.assign(cells.rows.select("id", "x", other.alias("_g")), cells, "_g").select("id", "x", "_g", "cell")
    schema = "id long, _g string, inside boolean"

    def merge(found: DataFrame) -> DataFrame:
        return found.groupBy("_g", "id").agg(F.bool_or("inside").alias("inside"))

    flags = merge(C.home(cells, visitors, index, _inside_kernel(), schema, work))
    if cells.several():
        flags, index = pin(flags), pin(index)
        ball = C.largest(cells, index, "r")
        outside = visitors.join(flags.filter("inside").select("_g", "id"), ["_g", "id"], "left_anti")
        more = C.away(cells, outside, "_g", lambda least, most, state, numbers: ~(least > ball[numbers]), [], index,
                      _inside_kernel(), schema, _inside_merge, work)
        flags = flags if more is None else merge(flags.unionByName(more))
    return flags.select(other.alias("side"), "id", "inside")  # _g is the set that a row was held against


def precision_recall(ref: DataFrame, sample: DataFrame, id_col: str, vec: str, k: int = 3,
                     block_rows: int = 4096) -> DataFrame:
    flags = precision_recall_flags(ref, sample, id_col, vec, k, block_rows)
    return flags.agg(
        F.avg(F.when(F.col("side") == "sample", F.col("inside").cast("double"))).alias("precision"),
        F.avg(F.when(F.col("side") == "ref", F.col("inside").cast("double"))).alias("recall"))


# ---------------------------------------------------------------- V7 Frechet


def _spectrum(m: np.ndarray, what: str) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of a covariance-like matrix; rounding below zero
    is cleared, a truly negative direction is an error."""
    w, v = np.linalg.eigh((m + m.T) / 2)
    if w.min(initial=0.0) < -1e-3 * max(1.0, float(w.max(initial=0.0))):
        raise ValueError(f"{what} is not positive semi-definite: least eigenvalue {w.min():.3g}")
    return w.clip(min=0.0), v


def _trace_root(a: np.ndarray, b: np.ndarray) -> float:
    """tr sqrt(A B) = sum of sqrt(eigenvalues of R B R), R the root of A."""
    w, v = _spectrum(a, "the first covariance")
    root = (v * np.sqrt(w)) @ v.T
    return float(np.sqrt(_spectrum(root @ b @ root, "the product of the covariances")[0]).sum())


def frechet_from_stats(mu1, sigma1, mu2, sigma2, eps: float = 1e-6) -> float:
    """|mu1 - mu2|^2 + tr(S1 + S2) - 2 tr sqrt(S1 S2), D x D algebra on the
    driver.  Sets of one row have no covariance (NaN) and are an error, as is a
    covariance with a negative direction.  ``eps`` is added to both diagonals
    when the root of nearly singular matrices does not converge."""
    m = np.stack([np.ravel(mu1), np.ravel(mu2)])
    s = np.stack([np.atleast_2d(sigma1), np.atleast_2d(sigma2)])
    if not (np.isfinite(m).all() and np.isfinite(s).all()):
        raise ValueError("the moments hold values that are not finite (fewer than two rows?)")
    try:
        cross = _trace_root(*s)
    except np.linalg.LinAlgError:
        cross = _trace_root(*(s + eps * np.eye(s.shape[-1])))
    return float(np.square(m[0] - m[1]).sum() + np.trace(s.sum(axis=0)) - 2.0 * cross)


def frechet_distance(a: DataFrame, b: DataFrame, vec: str, eps: float = 1e-6) -> float:
    """V7 between two feature tables; both sets' moments from one job (A2
    grouped by set), D x D algebra on the driver."""
    both = (a.select(F.lit("a").alias("_set"), F.col(vec).alias("_v"))
            .unionByName(b.select(F.lit("b").alias("_set"), F.col(vec).alias("_v"))))
    m = collect_grouped_moments(feature_moments(both, "_v", by="_set"), "_set")
    if "a" not in m or "b" not in m:
        raise ValueError("both feature sets must be non-empty")
    (_, mu1, s1), (_, mu2, s2) = m["a"], m["b"]
    return frechet_from_stats(mu1, s1, mu2, s2, eps)


# ---------------------------------------------------------------- V8 IS


MOST_SPLITS = 1 << 20  # whose first ids (8 MB of numbers) are sent to the tasks


def _split_partials(splits_of):
    """Rows -> partial sums of their splits: count, sum of p ln p and sum of p
    (softmax of the logits).  A batch's rows of one split become one row."""
    def run(batches):
        for batch in batches:
            z = to_matrix(batch.column("z"))
            if not len(z):
                continue
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            e = np.where(p > 0, p * np.log(np.where(p > 0, p, 1.0)), 0.0).sum(axis=1)
            split, inverse = np.unique(splits_of(batch), return_inverse=True)
            sums = np.zeros((len(split), p.shape[1]))
            np.add.at(sums, inverse, p)
            yield pa.RecordBatch.from_arrays(
                [pa.array(split.astype(np.int64)), pa.array(np.bincount(inverse).astype(np.int64)),
                 pa.array(np.bincount(inverse, weights=e)), pa.array(list(sums), pa.list_(pa.float64()))],
                ["split", "n", "e", "p"])
    return run


def _merge_split(t: pa.Table) -> pa.Table:
    """Partial sums of one split -> exp(mean_i sum_c p ln p - sum_c m_c ln m_c), m the mean of p."""
    n = int(np.sum(t.column("n").to_numpy()))
    m = to_matrix(t.column("p")).sum(axis=0) / n
    entropy = np.sum(t.column("e").to_numpy()) / n
    score = np.exp(entropy - np.where(m > 0, m * np.log(np.where(m > 0, m, 1.0)), 0.0).sum())
    return pa.table({"split": t.column("split").slice(0, 1), "n": pa.array([n], pa.int64()),
                     "score": pa.array([score], pa.float64())})


def inception_score_splits(df: DataFrame, id_col: str, logits: str, split_size: int = 5000) -> DataFrame:
    """V8 per split: exp(mean_i KL(p_i || mean p)).  Splits are contiguous in
    ``id_col`` order, the last one may be short; ids are unique.  ``p = 0``
    contributes 0 (the reference would give NaN).

    Only the ids are ranked (W1).  The first id of every split goes to the
    tasks, which sum C + 2 numbers a split and batch where the logits are; those
    sums merge in any order, so no logits are shuffled.  Beyond ``MOST_SPLITS``
    splits the rank is joined to the rows instead of the boundaries sent."""
    ranked = global_index(df.select(id_col), id_col, "_pos")
    split = F.floor(F.col("_pos") / split_size).cast("long").alias("split")
    rows = df.select(F.col(id_col).alias("id"), as_double_array(logits).alias("z"))
    starts = [r[0] for r in ranked.filter(F.col("_pos") % split_size == 0).select(id_col).limit(MOST_SPLITS + 1).collect()]
    if len(starts) <= MOST_SPLITS:
        shared = df.sparkSession.sparkContext.broadcast(np.array(sorted(starts)))

        def splits_of(batch):
            return np.searchsorted(shared.value, batch.column("id").to_numpy(zero_copy_only=False), side="right") - 1
    else:
        rows = rows.join(ranked.select(F.col(id_col).alias("id"), split), "id")

        def splits_of(batch):
            return batch.column("split").to_numpy()
    partial = rows.mapInArrow(_split_partials(splits_of), "split long, n long, e double, p array<double>")
    return partial.groupBy("split").applyInArrow(_merge_split, "split long, n long, score double")


def inception_score(df: DataFrame, id_col: str, logits: str, split_size: int = 5000) -> DataFrame:
    """Unweighted mean of the split scores."""
    return inception_score_splits(df, id_col, logits, split_size).agg(F.avg("score").alias("inception_score"))


def logits_from_features(df: DataFrame, vec: str, weights: np.ndarray, out: str = "logits") -> DataFrame:
    """Features x weight matrix (no bias) with one GEMM per Arrow batch; the
    weight matrix is a model parameter of fixed size, shipped in the closure."""
    w = np.asarray(weights, dtype=np.float64)
    cols = df.columns

    def run(batches):
        for rb in batches:
            x = to_matrix(rb.column(vec))
            z = x @ w if len(x) else np.zeros((0, w.shape[1]))
            arrays = [rb.column(c) for c in cols] + [pa.array(z.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=cols + [out])
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
    schema = StructType(list(df.schema.fields) + [StructField(out, ArrayType(DoubleType()))])
    return df.mapInArrow(run, schema)


# ---------------------------------------------------------------- V9


def evaluate(ref: DataFrame, sample: DataFrame, id_col: str, vec: str, logits: str,
             spatial: str | None = None, k: int = 3, split_size: int = 5000, block_rows: int = 4096) -> dict:
    """V9: Inception Score (sample only), FID, sFID (on ``spatial`` when
    given), precision and recall, as one dict."""
    ref = ref.persist()
    sample = sample.persist()
    try:
        out = {"inception_score": inception_score(sample, id_col, logits, split_size).first()[0]}
        # all moment sets (pooled and, when given, spatial features of both
        # sides) from one grouped scan
        sets = {"ref|v": (ref, vec), "smp|v": (sample, vec)}
        if spatial:
            sets.update({"ref|s": (ref, spatial), "smp|s": (sample, spatial)})
        parts = [d.select(F.lit(g).alias("_set"), F.col(c).cast("array<double>").alias("_v"))
                 for g, (d, c) in sets.items()]
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p)
        m = collect_grouped_moments(feature_moments(both, "_v", by="_set"), "_set")
        out["fid"] = frechet_from_stats(m["ref|v"][1], m["ref|v"][2], m["smp|v"][1], m["smp|v"][2])
        out["sfid"] = (frechet_from_stats(m["ref|s"][1], m["ref|s"][2], m["smp|s"][1], m["smp|s"][2])
                       if spatial else None)
        pr = precision_recall(ref, sample, id_col, vec, k, block_rows).first()
        out["precision"], out["recall"] = pr["precision"], pr["recall"]
        return out
    finally:
        ref.unpersist()
        sample.unpersist()
