"""Vector-set evaluation queries: reference set = embeddings with
label < 5, sample set = label >= 5."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlake.functions.vectors import slice_channels
from pairlake.operators import metrics as M
from pairlake.operators.linalg import feature_moments
from pairlake.plans.registry import register
from pairlake.session import load_table

K = 3
SPLIT = 100
LOGIT_SCALE = 10.0
SPATIAL_C = 16


def _sets(spark, sf):
    e = load_table(spark, sf, "embeddings")
    return e.filter(F.col("label") < 5), e.filter(F.col("label") >= 5), e


def _logits(df):
    return df.withColumn("logits", F.transform(F.col("embedding").cast("array<double>"),
                                               lambda v: v * F.lit(LOGIT_SCALE)))


_E = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
ref AS (SELECT * FROM e WHERE label < 5), smp AS (SELECT * FROM e WHERE label >= 5)"""
_DIST = "list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _radii_sql(src: str, name: str, k: int = K) -> str:
    return f"""{name} AS (SELECT vec_id, d AS radius FROM (
  SELECT a.vec_id, {_DIST} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DIST}) AS rn
  FROM {src} a, {src} b) WHERE rn = {k + 1})"""


@register("knn_radii", ids=("V3", "V1", "V2", "X5"), sql=f"""
WITH {_E}, {_radii_sql('e', 'r')} SELECT vec_id, round(radius, 6) AS radius FROM r
""")
def q_knn_radii(spark, sf):
    _, _, e = _sets(spark, sf)
    return M.manifold_radii(e, "vec_id", "embedding", K).select("vec_id", F.round("radius", 6).alias("radius"))


@register("kth_smallest", ids=("T4", "V2"), sql=f"""
WITH {_E}
SELECT vec_id, round(d, 6) AS kth FROM (
  SELECT a.vec_id, {_DIST} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DIST}) AS rn
  FROM smp a, ref b) WHERE rn = 5
""")
def q_kth_smallest(spark, sf):
    ref, smp, _ = _sets(spark, sf)
    return M.kth_smallest(smp, ref, "vec_id", "embedding", 5).select("vec_id", F.round("kth", 6).alias("kth"))


@register("kth_smallest_long", ids=("T4",), sql="""
SELECT l_suppkey, round(CAST(l_extendedprice AS DOUBLE), 2) AS kth
FROM (SELECT l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS rn FROM lineitem)
WHERE rn = 7
""")
def q_kth_smallest_long(spark, sf):
    li = load_table(spark, sf, "lineitem")
    return M.kth_smallest_long(li, "l_suppkey", "l_extendedprice", 7).select(
        "l_suppkey", F.round(F.col("kth").cast("double"), 2).alias("kth"))


@register("manifold_evaluate", ids=("V5", "T5"), sql=f"""
WITH {_E}, {_radii_sql('ref', 'rr')},
pr AS (SELECT a.vec_id, b.vec_id AS rid, {_DIST} AS d FROM smp a, ref b)
SELECT pr.vec_id, bool_or(d <= rr.radius) AS inside, round(max(rr.radius / (d + 1e-5)), 6) AS realism,
       round(min(d), 6) AS min_d, first(rid ORDER BY d, rid) AS nearest
FROM pr JOIN rr ON pr.rid = rr.vec_id GROUP BY pr.vec_id
""")
def q_manifold_evaluate(spark, sf):
    ref, smp, _ = _sets(spark, sf)
    radii = M.manifold_radii(ref, "vec_id", "embedding", K)
    ev = M.manifold_evaluate(ref, radii, smp, "vec_id", "embedding")
    return ev.select("vec_id", "inside", F.round("realism", 6).alias("realism"), F.round("min_d", 6).alias("min_d"),
                     "nearest")


CELL_ROWS = 64  # small cells, so that the driver tables have many


@register("manifold_cells", ids=("V2", "V3", "V5", "X5"), sql=f"""
WITH {_E}, {_radii_sql('ref', 'rr')},
pr AS (SELECT a.vec_id, b.vec_id AS rid, {_DIST} AS d FROM smp a, ref b)
SELECT pr.vec_id, bool_or(d <= rr.radius) AS inside, round(max(rr.radius / (d + 1e-5)), 6) AS realism,
       round(min(d), 6) AS min_d, first(rid ORDER BY d, rid) AS nearest
FROM pr JOIN rr ON pr.rid = rr.vec_id GROUP BY pr.vec_id
""")
def q_manifold_cells(spark, sf):
    """V3 and V5 over many cells: home cells, then the cells that bounds leave open."""
    ref, smp, _ = _sets(spark, sf)
    radii = M.manifold_radii(ref, "vec_id", "embedding", K, CELL_ROWS)
    ev = M.manifold_evaluate(ref, radii, smp, "vec_id", "embedding", block_rows=CELL_ROWS)
    return ev.select("vec_id", "inside", F.round("realism", 6).alias("realism"), F.round("min_d", 6).alias("min_d"),
                     "nearest")


@register("manifold_join", ids=("J8",), sql=f"""
WITH {_E}, {_radii_sql('ref', 'rr')}
SELECT a.vec_id, a.label FROM smp a WHERE EXISTS (
  SELECT 1 FROM ref b JOIN rr ON b.vec_id = rr.vec_id WHERE {_DIST} <= rr.radius)
""")
def q_manifold_join(spark, sf):
    ref, smp, _ = _sets(spark, sf)
    radii = M.manifold_radii(ref, "vec_id", "embedding", K)
    return M.manifold_join(smp, ref, radii, "vec_id", "embedding").select("vec_id", "label")


@register("precision_recall", ids=("V6", "V3"), sql=f"""
WITH {_E}, {_radii_sql('ref', 'rr')}, {_radii_sql('smp', 'sr')},
pairs AS (SELECT a.vec_id AS rid, b.vec_id AS sid, {_DIST} AS d FROM ref a, smp b),
p AS (SELECT sid, bool_or(d <= rr.radius) AS ins FROM pairs JOIN rr ON rid = rr.vec_id GROUP BY sid),
r AS (SELECT rid, bool_or(d <= sr.radius) AS ins FROM pairs JOIN sr ON sid = sr.vec_id GROUP BY rid)
SELECT round((SELECT avg(CAST(ins AS DOUBLE)) FROM p), 6) AS precision,
       round((SELECT avg(CAST(ins AS DOUBLE)) FROM r), 6) AS recall
""")
def q_precision_recall(spark, sf):
    ref, smp, _ = _sets(spark, sf)
    pr = M.precision_recall(ref, smp, "vec_id", "embedding", K)
    return pr.select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@register("radii_percentile", ids=("A13",), sql=f"""
WITH {_E}, {_radii_sql('ref', 'rr')}
SELECT round(quantile_cont(radius, 0.5), 6) AS p50, round(quantile_cont(radius, 0.9), 6) AS p90 FROM rr
""")
def q_radii_percentile(spark, sf):
    ref, _, _ = _sets(spark, sf)
    radii = M.manifold_radii(ref, "vec_id", "embedding", K)
    p = M.percentiles_frame(radii, "radius", {"p50": 50.0, "p90": 90.0})
    return p.select(F.round("p50", 6).alias("p50"), F.round("p90", 6).alias("p90"))


@register("clamp_radii", ids=("V4", "A13"), sql=f"""
WITH {_E}, {_radii_sql('ref', 'rr')}
SELECT vec_id, round(CASE WHEN radius > (SELECT quantile_cont(radius, 0.9) FROM rr) THEN 0 ELSE radius END, 6)
  AS radius FROM rr
""")
def q_clamp_radii(spark, sf):
    ref, _, _ = _sets(spark, sf)
    radii = M.manifold_radii(ref, "vec_id", "embedding", K)
    return M.clamp_radii(radii, 90.0).select("vec_id", F.round("radius", 6).alias("radius"))


_MOMENT_X = """x AS (SELECT vec_id, CASE WHEN label < 5 THEN 'ref' ELSE 'sample' END AS set_id,
  unnest(range(len(embedding))) AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings)"""


def _moments_long(df, set_id):
    m = feature_moments(df, "embedding")
    return m.select(F.lit(set_id).alias("set_id"), "i", F.posexplode("cov").alias("j", "cov")).select(
        "set_id", "i", F.col("j").cast("int").alias("j"), F.round("cov", 9).alias("cov"))


@register("feature_moments", ids=("A2", "X4"), sql=f"""
WITH {_MOMENT_X}
SELECT a.set_id, CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(covar_samp(a.v, b.v), 9) AS cov
FROM x a JOIN x b ON a.vec_id = b.vec_id GROUP BY ALL
""")
def q_feature_moments(spark, sf):
    ref, smp, _ = _sets(spark, sf)
    return _moments_long(ref, "ref").unionByName(_moments_long(smp, "sample"))


@register("frechet_terms", ids=("V7", "A2"), sql=f"""
WITH {_MOMENT_X},
m AS (SELECT set_id, i, avg(v) AS mu, var_samp(v) AS var FROM x GROUP BY ALL)
SELECT round(sum((a.mu - b.mu) * (a.mu - b.mu)), 9) AS mean_term, round(sum(a.var), 9) AS trace_ref,
       round(sum(b.var), 9) AS trace_sample
FROM m a JOIN m b ON a.i = b.i AND a.set_id = 'ref' AND b.set_id = 'sample'
""")
def q_frechet_terms(spark, sf):
    ref, smp, _ = _sets(spark, sf)
    a = feature_moments(ref, "embedding").select("i", F.col("mu").alias("mu1"),
                                                 F.element_at("cov", F.col("i") + 1).alias("v1"))
    b = feature_moments(smp, "embedding").select("i", F.col("mu").alias("mu2"),
                                                 F.element_at("cov", F.col("i") + 1).alias("v2"))
    j = a.join(b, "i")
    return j.agg(F.round(F.sum((F.col("mu1") - F.col("mu2")) ** 2), 9).alias("mean_term"),
                 F.round(F.sum("v1"), 9).alias("trace_ref"), F.round(F.sum("v2"), 9).alias("trace_sample"))


ROOT_STEPS = 24  # Newton-Schulz steps; each multiplies a small eigenvalue's root by about 1.5


def _times(a: str, b_transposed: str) -> str:
    """Matrix product of nested lists, the right one given by its columns."""
    return f"list_transform({a}, lambda r: list_transform({b_transposed}, lambda c: list_dot_product(r, c)))"


def _columns(m: str) -> str:
    return f"list_transform(range(1, len({m}) + 1), lambda j: list_transform({m}, lambda r: r[j]))"


def _frechet_sql(name: str, keep: str = "true") -> str:
    """CTEs ending in ``{name} (fid)`` over ``x (set_id, vec_id, i, v)``: moments
    as nested lists, then the root of S1 S2 by the coupled Newton-Schulz
    iteration of the product scaled to unit Frobenius norm."""
    p = name
    steps = [f"""{p}x AS (SELECT * FROM x WHERE {keep}),
{p}c AS (SELECT a.set_id, a.i, b.i AS j, covar_samp(a.v, b.v) AS c
  FROM {p}x a JOIN {p}x b ON a.vec_id = b.vec_id AND a.set_id = b.set_id GROUP BY ALL),
{p}r AS (SELECT set_id, i, list(c ORDER BY j) AS r FROM {p}c GROUP BY ALL),
{p}s AS (SELECT set_id, list(r ORDER BY i) AS s, sum(r[k]) AS tr
  FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY i) AS k FROM {p}r) GROUP BY set_id),
{p}m AS (SELECT sum((a.mu - b.mu) * (a.mu - b.mu)) AS d
  FROM (SELECT i, avg(v) AS mu FROM {p}x WHERE set_id = 'ref' GROUP BY i) a
  JOIN (SELECT i, avg(v) AS mu FROM {p}x WHERE set_id = 'sample' GROUP BY i) b USING (i)),
{p}a AS MATERIALIZED (SELECT {_times('a.s', 'b.s')} AS a, a.tr + b.tr AS tr  -- the right factor is symmetric
  FROM {p}s a JOIN {p}s b ON a.set_id = 'ref' AND b.set_id = 'sample'),
{p}f AS MATERIALIZED (SELECT a, tr, sqrt(list_sum(list_transform(a, lambda r: list_dot_product(r, r)))) AS f FROM {p}a),
{p}0 AS MATERIALIZED (SELECT list_transform(a, lambda r: list_transform(r, lambda v: v / f)) AS y,
  list_transform(range(len(a)), lambda i: list_transform(range(len(a)), lambda j: CAST(i = j AS DOUBLE))) AS z
  FROM {p}f)"""]
    for k in range(ROOT_STEPS):
        steps.append(f"""{p}t{k} AS MATERIALIZED (SELECT y, z, list_transform({_times('z', 'yc')}, lambda r, i:
  list_transform(r, lambda v, j: 1.5 * CAST(i = j AS DOUBLE) - 0.5 * v)) AS t
  FROM (SELECT y, z, {_columns('y')} AS yc FROM {p}{k})),
{p}{k + 1} AS MATERIALIZED (SELECT {_times('y', 'tc')} AS y, {_times('t', 'zc')} AS z
  FROM (SELECT y, z, t, {_columns('t')} AS tc, {_columns('z')} AS zc FROM {p}t{k}))""")
    steps.append(f"""{name} AS (SELECT m.d + f.tr - 2 * sqrt(f.f) * list_sum(list_transform(l.y, lambda r, i: r[i])) AS fid
  FROM {p}m m, {p}f f, {p}{ROOT_STEPS} l)""")
    return ",\n".join(steps)


_SPATIAL = f"i % {SPATIAL_C} < 7"


@register("frechet_distance", ids=("V7", "F27"), sql=f"""
WITH {_MOMENT_X}, {_frechet_sql('pooled')}, {_frechet_sql('spatial', _SPATIAL)}
SELECT round((SELECT fid FROM pooled), 6) AS fid, round((SELECT fid FROM spatial), 6) AS sfid
""")
def q_frechet_distance(spark, sf):
    ref, smp, _ = _sets(spark, sf)
    fid = M.frechet_distance(ref, smp, "embedding")
    sp = lambda d: d.withColumn("spatial", slice_channels("embedding", SPATIAL_C, 7))
    sfid = M.frechet_distance(sp(ref), sp(smp), "spatial")
    return spark.createDataFrame([(round(float(fid), 6), round(float(sfid), 6))], "fid double, sfid double")


_IS_LOGITS = f"""
l AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda v: v * {LOGIT_SCALE}) AS z FROM embeddings),"""
_IS_TAIL = f"""
ex AS (SELECT vec_id, list_transform(z, lambda v: exp(v - list_max(z))) AS ez FROM l),
q AS (SELECT vec_id, list_transform(ez, lambda v: v / list_sum(ez)) AS p FROM ex),
r AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1) // {SPLIT} AS split, vec_id, p FROM q),
u AS (SELECT split, vec_id, unnest(range(len(p))) AS c, unnest(p) AS v FROM r),
m AS (SELECT split, c, avg(v) AS m FROM u GROUP BY ALL),
kl AS (SELECT u.split, u.vec_id, sum(CASE WHEN v > 0 THEN v * (ln(v) - ln(m.m)) ELSE 0 END) AS kl
       FROM u JOIN m ON u.split = m.split AND u.c = m.c GROUP BY ALL),
s AS (SELECT CAST(split AS BIGINT) AS split, count(*) AS n, exp(avg(kl)) AS score FROM kl GROUP BY split)"""
_IS_SQL = _IS_LOGITS + _IS_TAIL


@register("inception_score_splits", ids=("V8", "W7", "F23"), sql=f"""
WITH {_IS_SQL} SELECT split, n, round(score, 6) AS score FROM s
""")
def q_is_splits(spark, sf):
    e = _logits(load_table(spark, sf, "embeddings"))
    s = M.inception_score_splits(e, "vec_id", "logits", SPLIT)
    return s.select("split", "n", F.round("score", 6).alias("score"))


@register("inception_score", ids=("V8", "A14"), sql=f"""
WITH {_IS_SQL} SELECT round(avg(score), 6) AS inception_score FROM s
""")
def q_inception_score(spark, sf):
    e = _logits(load_table(spark, sf, "embeddings"))
    return M.inception_score(e, "vec_id", "logits", SPLIT).select(
        F.round("inception_score", 6).alias("inception_score"))


def evaluate_frame(spark, sf):
    """V9 flagship: all five metrics of the sample half against the reference
    half as one row."""
    ref, smp, _ = _sets(spark, sf)
    sp = lambda d: _logits(d).withColumn("spatial", slice_channels("embedding", SPATIAL_C, 7))
    r = M.evaluate(sp(ref), sp(smp), "vec_id", "embedding", "logits", spatial="spatial", k=K, split_size=SPLIT)
    cols = ["inception_score", "fid", "sfid", "precision", "recall"]
    return spark.createDataFrame([tuple(round(float(r[c]), 6) for c in cols)], ", ".join(f"{c} double" for c in cols))


# the score of the sample half alone; precision and recall from the radii of either half
EVALUATE_SQL = f"""
WITH {_MOMENT_X}, {_frechet_sql('pooled')}, {_frechet_sql('spatial', _SPATIAL)}, {_E},
{_IS_LOGITS.replace('FROM embeddings)', 'FROM embeddings WHERE label >= 5)')} {_IS_TAIL},
{_radii_sql('ref', 'rr')}, {_radii_sql('smp', 'sr')},
pairs AS (SELECT a.vec_id AS rid, b.vec_id AS sid, {_DIST} AS d FROM ref a, smp b),
pp AS (SELECT sid, bool_or(d <= rr.radius) AS ins FROM pairs JOIN rr ON rid = rr.vec_id GROUP BY sid),
rc AS (SELECT rid, bool_or(d <= sr.radius) AS ins FROM pairs JOIN sr ON sid = sr.vec_id GROUP BY rid)
SELECT (SELECT round(avg(score), 6) FROM s) AS inception_score, round((SELECT fid FROM pooled), 6) AS fid,
  round((SELECT fid FROM spatial), 6) AS sfid,
  round((SELECT avg(CAST(ins AS DOUBLE)) FROM pp), 6) AS precision,
  round((SELECT avg(CAST(ins AS DOUBLE)) FROM rc), 6) AS recall"""

register("evaluate", ids=("V9", "V6", "V7", "V8"), sql=EVALUATE_SQL)(evaluate_frame)


def classifier_weights(dim: int = 64, classes: int = 10):
    """Fixed stand-in classifier head: W[i, j] = ((3 i + 5 j) mod 11 - 5) / 5."""
    import numpy as np
    i = np.arange(dim)[:, None]
    j = np.arange(classes)[None, :]
    return (((3 * i + 5 * j) % 11) - 5) / 5.0


@register("inception_score_weights", ids=("V8", "A14"), sql=f"""
WITH l AS (SELECT vec_id, list_transform(range(10), lambda j: list_sum(list_transform(range(64),
    lambda i: embedding[i + 1]::DOUBLE * (((3 * i + 5 * j) % 11) - 5) / 5.0))) AS z
  FROM embeddings WHERE label >= 5),{_IS_TAIL}
SELECT round(avg(score), 6) AS inception_score FROM s
""")
def q_inception_score_weights(spark, sf):
    """V8 with the softmax over features x weight matrix (no bias), sample
    half only."""
    _, smp, _ = _sets(spark, sf)
    lg = M.logits_from_features(smp.select("vec_id", "embedding"), "embedding", classifier_weights())
    return M.inception_score(lg, "vec_id", "logits", SPLIT).select(
        F.round("inception_score", 6).alias("inception_score"))
