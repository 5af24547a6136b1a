"""Dense linear algebra on executors: feature moments (A2) and pairwise
distances (V1).

A2: every partition accumulates (n, sum, centred Gram) around a pilot mean
with numpy, emits its D x D scatter as row blocks, and the blocks are merged
per block id on executors (Chan's pairwise update), so the driver receives
only the final D x D covariance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- helpers


def to_matrix(arr) -> np.ndarray:
    """Arrow list<float|double> column -> (n, D) float64 matrix."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    if n == 0:
        return np.zeros((0, 0))
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if flat.size % n:
        raise ValueError("feature vectors must all have the same length")
    return flat.reshape(n, flat.size // n)


def sq_dists(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """||u||^2 - 2 u.v + ||v||^2 clamped at 0, in float64, after shifting both
    blocks by a common centre (distances are shift invariant; the shift cuts
    cancellation in the norm expansion).  Only rows with values that are not
    finite have distances that are not."""
    c = a.mean(axis=0) if len(a) else np.zeros(b.shape[1:])
    if not np.isfinite(c).all():
        c = np.nan_to_num(a[np.isfinite(a).all(axis=1)].sum(axis=0) / len(a))
    a = a - c
    b = b - c
    na = np.einsum("ij,ij->i", a, a)[:, None]
    nb = np.einsum("ij,ij->i", b, b)[None, :]
    with np.errstate(invalid="ignore"):
        d = na - 2.0 * (a @ b.T) + nb
    np.maximum(d, 0.0, out=d)
    return d


# ---------------------------------------------------------------- A2 moments


_PARTIAL = ["g", "block", "part", "n", "dim", "mean", "m2"]
_PARTIAL_SCHEMA = "g string, block int, part long, n long, dim int, mean array<double>, m2 binary"


def _partial_batch(g: str, block: int, part: int, n: int, mean: np.ndarray, m2_rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([g], pa.string()), pa.array([block], pa.int32()), pa.array([part], pa.int64()),
        pa.array([n], pa.int64()), pa.array([len(mean)], pa.int32()),
        pa.array([mean.tolist()], pa.list_(pa.float64())),
        pa.array([np.ascontiguousarray(m2_rows).tobytes()], pa.binary()),
    ], names=_PARTIAL)


def _merge_block(t: pa.Table, dim_block: int):
    """Chan et al. merge of partial (n, mean, M2 rows of one block)."""
    ns = np.asarray(t.column("n").to_pylist(), dtype=np.float64)
    d = int(t.column("dim")[0].as_py())
    b = int(t.column("block")[0].as_py())
    means = to_matrix(t.column("mean"))
    n = ns.sum()
    mean = (ns[:, None] * means).sum(axis=0) / n
    r0, r1 = b * dim_block, min(d, (b + 1) * dim_block)
    m2 = np.zeros((r1 - r0, d))
    for k, raw in enumerate(t.column("m2").to_pylist()):
        delta = means[k] - mean
        m2 += np.frombuffer(raw, dtype=np.float64).reshape(r1 - r0, d)
        m2 += ns[k] * np.outer(delta[r0:r1], delta)
    return t.column("g")[0].as_py(), b, n, mean, m2, r0, r1


def _moment_combine(dim_block: int, fanout: int):
    def run(t: pa.Table) -> pa.Table:
        g, b, n, mean, m2, _, _ = _merge_block(t, dim_block)
        part = int(t.column("part")[0].as_py()) // fanout
        return pa.Table.from_batches([_partial_batch(g, b, part, int(n), mean, m2)])
    return run


def _moment_partials(dim_block: int):
    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        acc = {}  # group -> [n, pilot, s1, s2]
        for rb in batches:
            if rb.num_rows == 0:
                continue
            x_all = to_matrix(rb.column("x"))
            groups = np.asarray(rb.column("g").to_pylist(), dtype=object)
            for g in np.unique(groups):
                x = x_all[groups == g]
                a = acc.get(g)
                if a is None:
                    pilot = x.mean(axis=0)
                    a = acc[g] = [0, pilot, np.zeros_like(pilot), np.zeros((len(pilot), len(pilot)))]
                xc = x - a[1]
                a[2] += xc.sum(axis=0)
                a[3] += xc.T @ xc
                a[0] += len(x)
        for g, (n, pilot, s1, s2) in acc.items():
            mean = pilot + s1 / n
            m2 = s2 - np.outer(s1, s1) / n
            for b0 in range(0, len(mean), dim_block):
                yield _partial_batch(g, b0 // dim_block, part, n, mean, m2[b0:b0 + dim_block])
    return run


def _moment_merge(dim_block: int):
    def run(t: pa.Table) -> pa.Table:
        g, _, n, mean, m2, r0, r1 = _merge_block(t, dim_block)
        cov = m2 / (n - 1) if n > 1 else np.full_like(m2, np.nan)
        return pa.table({
            "g": pa.array([g] * (r1 - r0), pa.string()),
            "i": pa.array(range(r0, r1), pa.int32()),
            "n": pa.array([int(n)] * (r1 - r0), pa.int64()),
            "mu": pa.array(mean[r0:r1], pa.float64()),
            "cov": pa.array([row.tolist() for row in cov], pa.list_(pa.float64())),
        })
    return run


def feature_moments(df: DataFrame, vec: str, dim_block: int = 64, fanout: int = 64,
                    max_partials: int | None = None, by: str | None = None) -> DataFrame:
    """A2: mean vector and sample covariance (ddof 1) of a vector column, as D
    rows ``(i, n, mu, cov)`` where ``cov`` is row i of the covariance; with
    ``by``, one such set of rows per group value (column ``by`` added), all
    from one scan.

    Each partition ships its scatter as D/dim_block row blocks.  The blocks
    are merged in two levels: ``fanout`` partials of a block id a task (fanout x
    dim_block x D doubles), then what remains of them.  ``max_partials``
    optionally coalesces the scan (no shuffle) to fewer, larger partials."""
    g = F.col(by).cast("string") if by else F.lit("")
    vt = df.schema[vec].dataType.simpleString()
    xv = F.col(vec) if vt in ("array<float>", "array<double>") else F.col(vec).cast("array<double>")
    x = df.select(g.alias("g"), xv.alias("x")).filter(
        F.col("x").isNotNull() & F.col("g").isNotNull())
    if max_partials:
        x = x.coalesce(max_partials)
    partials = x.mapInArrow(_moment_partials(dim_block), _PARTIAL_SCHEMA)
    # one level of ``fanout`` partials a task; nothing is executed to learn how
    # many there are
    partials = (partials.withColumn("part", F.floor(F.col("part") / fanout).cast("long") * fanout)
                .groupBy("g", "block", "part").applyInArrow(_moment_combine(dim_block, fanout), _PARTIAL_SCHEMA))
    out_schema = "g string, i int, n long, mu double, cov array<double>"
    out = partials.groupBy("g", "block").applyInArrow(_moment_merge(dim_block), out_schema)
    return out.withColumnRenamed("g", by) if by else out.drop("g")


def collect_moments(moments: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Driver side: (n, mu, sigma) from ``feature_moments`` output (O(D^2))."""
    rows = sorted(moments.collect(), key=lambda r: r["i"])
    if not rows:
        raise ValueError("no feature vectors")
    mu = np.array([r["mu"] for r in rows])
    sigma = np.array([r["cov"] for r in rows])
    return int(rows[0]["n"]), mu, sigma


def collect_grouped_moments(moments: DataFrame, by: str) -> dict:
    """Driver side: {group: (n, mu, sigma)} (O(#groups x D^2))."""
    out: dict = {}
    for r in moments.collect():
        out.setdefault(r[by], []).append(r)
    res = {}
    for g, rows in out.items():
        rows.sort(key=lambda r: r["i"])
        res[g] = (int(rows[0]["n"]), np.array([r["mu"] for r in rows]), np.array([r["cov"] for r in rows]))
    return res
