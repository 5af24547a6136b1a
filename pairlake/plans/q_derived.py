"""Derived-table queries: transform geometry, schedules, pixel
and vector kernels, losses and posteriors."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlake.functions import schedule as SC
from pairlake.functions import vectors as V
from pairlake.functions.rand import hash_normal, hash_uniform
from pairlake.functions.util import round_array
from pairlake.operators import geometry as G
from pairlake.operators import losses as L
from pairlake.operators.index import global_index
from pairlake.plans import sqlfrag as S
from pairlake.plans import standins as T
from pairlake.plans.registry import register
from pairlake.session import load_table

RES = 256


def _sizes(spark, sf):
    d = load_table(spark, sf, "documents")
    return d.select("doc_id", (1 + F.col("n_chars") % 4000).alias("w"), (1 + (F.col("doc_id") * 37) % 3000).alias("h"))


_SIZES_SQL = "sz AS (SELECT doc_id, 1 + n_chars % 4000 AS w, 1 + (doc_id * 37) % 3000 AS h FROM documents)"
_PLAN_COLS = ("ok", "crop_x", "crop_y", "crop_w", "crop_h", "halvings", "resize_w", "resize_h", "out_w", "out_h",
              "pad_y")


def _plans(spark, sf):
    s = _sizes(spark, sf)
    parts = []
    for mode in G.MODES:
        height = None if mode == "scale" else RES
        p = s.select("doc_id", F.lit(mode).alias("mode"), G.crop_plan("w", "h", mode, RES, height).alias("p"))
        parts.append(p.select("doc_id", "mode", *[F.col(f"p.{c}").alias(c) for c in _PLAN_COLS]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_PLANS_SQL = f"""{_SIZES_SQL},
dh AS (SELECT doc_id, w, h, CASE WHEN least(w, h) // {RES} >= 1 THEN length(bin(least(w, h) // {RES})) - 1 ELSE 0 END
       AS n FROM sz),
dh2 AS (SELECT doc_id, n, w >> n AS hw, h >> n AS hh FROM dh),
dh3 AS (SELECT doc_id, n, CAST(round_even(hw * ({RES}.0 / least(hw, hh)), 0) AS BIGINT) AS rw,
        CAST(round_even(hh * ({RES}.0 / least(hw, hh)), 0) AS BIGINT) AS rh FROM dh2),
wd AS (SELECT doc_id, w, h, CAST(round_even({RES}.0 * h / w, 0) AS BIGINT) AS ch FROM sz),
plans AS (
  SELECT doc_id, 'scale' AS mode, true AS ok, 0::BIGINT AS crop_x, 0::BIGINT AS crop_y, w::BIGINT AS crop_w,
    h::BIGINT AS crop_h, 0 AS halvings, {RES}::BIGINT AS resize_w, h::BIGINT AS resize_h, {RES}::BIGINT AS out_w,
    h::BIGINT AS out_h, NULL::BIGINT AS pad_y FROM sz
  UNION ALL
  SELECT doc_id, 'center-crop', true, (w - least(w, h)) // 2, (h - least(w, h)) // 2, least(w, h), least(w, h), 0,
    {RES}, {RES}, {RES}, {RES}, NULL FROM sz
  UNION ALL
  SELECT doc_id, 'center-crop-wide', NOT (w < {RES} OR ch < {RES}), 0, CAST(floor((h - ch) / 2) AS BIGINT), w, ch, 0,
    {RES}, {RES}, {RES},
    {RES}, 0 FROM wd
  UNION ALL
  SELECT doc_id, 'center-crop-dhariwal', true, (rw - {RES}) // 2, (rh - {RES}) // 2, {RES}, {RES}, n, rw, rh, {RES},
    {RES}, NULL FROM dh3)"""


@register("crop_plan", ids=("F9",), sql=f"""
WITH {_PLANS_SQL} SELECT doc_id, mode, ok, crop_x, crop_y, crop_w, crop_h, CAST(halvings AS INTEGER) AS halvings,
  resize_w, resize_h, out_w, out_h, pad_y FROM plans
""")
def q_crop_plan(spark, sf):
    return _plans(spark, sf)


@register("size_ok", ids=("P3", "F9"), sql=f"""
WITH {_PLANS_SQL} SELECT doc_id, crop_h FROM plans WHERE mode = 'center-crop-wide' AND ok
""")
def q_size_ok(spark, sf):
    s = _sizes(spark, sf)
    p = s.select("doc_id", G.crop_plan("w", "h", "center-crop-wide", RES, RES).alias("p"))
    return p.filter(G.size_ok("p")).select("doc_id", F.col("p.crop_h").alias("crop_h"))


@register("validate_uniform", ids=("P5",), sql=f"""
WITH {_PLANS_SQL}
SELECT mode, count(DISTINCT (out_w, out_h)) AS n_sizes, min(out_w) AS width, min(out_h) AS height,
  COALESCE(bool_and(out_w = out_h), true) AS square,
  COALESCE(bool_and(out_w > 0 AND (out_w & (out_w - 1)) = 0), true) AS pow2
FROM plans WHERE ok GROUP BY mode
""")
def q_validate_uniform(spark, sf):
    p = _plans(spark, sf).filter("ok")
    w, h = F.col("out_w"), F.col("out_h")
    return p.groupBy("mode").agg(
        F.count_distinct(F.struct(w, h)).alias("n_sizes"), F.min(w).alias("width"), F.min(h).alias("height"),
        F.coalesce(F.bool_and(w == h), F.lit(True)).alias("square"),
        F.coalesce(F.bool_and((w > 0) & (w.bitwiseAND(w - 1) == 0)), F.lit(True)).alias("pow2"))


@register("drop_failed", ids=("P4", "W1"), sql="""
WITH f AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS idx FROM documents)
SELECT doc_id, idx FROM f WHERE doc_id % 101 <> 0
""")
def q_drop_failed(spark, sf):
    d = global_index(load_table(spark, sf, "documents").select("doc_id"), "doc_id", "idx")
    d = d.withColumn("ok", F.col("doc_id") % 101 != 0).withColumn(
        "error", F.when(~F.col("ok"), F.lit("transform failed")))
    kept, _ = G.drop_failed(d)
    return kept.select("doc_id", "idx")


_T_SQL = f"""tt AS (SELECT event_id, {S.hash_uniform('event_id', 21)} AS t,
  sqrt(-2 * ln(1 - {S.hash_uniform('event_id', 22, "'0'")})) * cos(2 * pi() * {S.hash_uniform('event_id', 22, "'1'")}) AS z,
  2048 * (1 << (user_id % 3)) AS dim FROM events)"""


@register("time_schedule", ids=("F17", "F18", "F19"), sql=f"""
WITH {_T_SQL},
s AS (SELECT event_id, t, z, least(greatest(sqrt(dim / 4096.0) * t / (1 + (sqrt(dim / 4096.0) - 1) * t), 0), 1) AS ts
      FROM tt)
SELECT event_id, round(ts, 9) AS t_shift,
  round(1 - ts, 9) AS lin_alpha, round(cos(ts * pi() / 2), 9) AS cos_alpha, round(sin(ts * pi() / 2), 9) AS cos_sigma,
  round(-pi() / 2 * sin(ts * pi() / 2), 9) AS cos_d_alpha, round(pi() / 2 * cos(ts * pi() / 2), 9) AS cos_d_sigma,
  round(exp(z) / (1 + exp(z)), 9) AS logn_linear, round(2 / pi() * atan(exp(z)), 9) AS logn_cosine
FROM s
""")
def q_time_schedule(spark, sf):
    ev = load_table(spark, sf, "events")
    t = ev.select("event_id", hash_uniform("event_id", 21).alias("t"), hash_normal("event_id", 22).alias("z"),
                  (F.lit(2048) * F.pow(F.lit(2), F.col("user_id") % 3).cast("long")).alias("dim"))
    s = t.withColumn("ts", SC.time_shift("t", "dim")).withColumn("lin", SC.interpolant("ts", "linear")).withColumn(
        "cos", SC.interpolant("ts", "cosine"))
    r = lambda c, n: F.round(c, 9).alias(n)
    return s.select("event_id", r(F.col("ts"), "t_shift"), r(F.col("lin.alpha"), "lin_alpha"),
                    r(F.col("cos.alpha"), "cos_alpha"), r(F.col("cos.sigma"), "cos_sigma"),
                    r(F.col("cos.d_alpha"), "cos_d_alpha"), r(F.col("cos.d_sigma"), "cos_d_sigma"),
                    r(SC.lognormal_time("z", "linear"), "logn_linear"), r(SC.lognormal_time("z", "cosine"), "logn_cosine"))


# Per-channel image normalisation (the common ImageNet mean/std).
IMAGENET_MEAN = (0.485, 0.456, 0.406)
IMAGENET_STD = (0.229, 0.224, 0.225)

_PIX_SQL = """px AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 3 END AS ch,
  list_transform(range(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 3 END * 16), lambda i: CAST((doc_id * 31 + i) % 256 AS INTEGER))
  AS x FROM documents),
rgb AS (SELECT doc_id, ch, x, CASE WHEN ch = 3 THEN x ELSE list_concat(x, x, x) END AS x3 FROM px)"""


@register("pixel_kernels", ids=("F20", "F21", "F22", "F25", "F30"), sql=f"""
WITH {_PIX_SQL}
SELECT doc_id,
  list_transform(x3, lambda v: round(v / 127.5 - 1, 6)) AS unit,
  list_transform(x3, lambda v: CAST(trunc(least(greatest(255.0 * ((v / 127.5 - 1 + 1.0) / 2.0), 0), 255)) AS INTEGER))
    AS back_sample,
  list_transform(x3, lambda v: CAST(trunc(least(greatest(127.5 * (v / 127.5 - 1) + 128.0, 0), 255)) AS INTEGER))
    AS back_decoder,
  list_transform(x3, lambda v: CAST(trunc(least(greatest(255.0 * least(greatest(v / 255.0, 0), 1) + 0.5, 0), 255))
    AS INTEGER)) AS back_grid,
  list_transform(x3, lambda v, i: round((v / 255.0 - [{', '.join(map(str, IMAGENET_MEAN))}][(i - 1) // 16 + 1])
    / [{', '.join(map(str, IMAGENET_STD))}][(i - 1) // 16 + 1], 6)) AS imagenet,
  list_transform(x3, lambda v: round(v * 0.18215::DOUBLE + 0.1::DOUBLE, 6)) AS affine,
  ch <> 3 AS shape_violation
FROM rgb
""")
def q_pixel_kernels(spark, sf):
    d = T.split_single_file(load_table(spark, sf, "documents"))
    ch = F.when(F.col("doc_id") % 3 == 0, 1).otherwise(3)
    px = d.select("doc_id", ch.alias("ch"), F.transform(F.sequence(F.lit(0), ch * 16 - 1),
                                                     lambda i: ((F.col("doc_id") * 31 + i) % 256).cast("int")).alias("x"))
    rgb = px.withColumn("x3", V.to_rgb("x", "ch", 16))
    unit = V.pixel_to_unit("x3", "symmetric")
    shape = F.array(F.col("ch"), F.lit(4), F.lit(4))
    ref = F.array(F.lit(3), F.lit(None).cast("int"), F.lit(4))
    return rgb.select(
        "doc_id", round_array(unit).alias("unit"),
        V.unit_to_pixel(unit, "sample").alias("back_sample"), V.unit_to_pixel(unit, "decoder").alias("back_decoder"),
        V.unit_to_pixel(F.transform("x3", lambda v: v / F.lit(255.0)), "grid").alias("back_grid"),
        round_array(V.pixel_to_unit("x3", "channel", IMAGENET_MEAN, IMAGENET_STD, 16)).alias("imagenet"),
        round_array(V.affine("x3", 0.18215, 0.1)).alias("affine"),
        V.shape_violation(shape, ref).alias("shape_violation"))


_BAD_SQL = """bad AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda v, i: CASE
    WHEN vec_id % 5 = 0 AND i = 1 THEN 'NaN'::DOUBLE WHEN vec_id % 5 = 0 AND i = 2 THEN 'inf'::DOUBLE
    WHEN vec_id % 5 = 0 AND i = 3 THEN '-inf'::DOUBLE ELSE v END) AS x, embedding::DOUBLE[] AS e FROM embeddings)"""


@register("vector_kernels", ids=("F23", "F24", "V1"), sql=f"""
WITH {_BAD_SQL}
SELECT vec_id,
  list_transform(x, lambda v: round(CASE WHEN isnan(v) THEN 0 WHEN v = 'inf'::DOUBLE THEN 3.4028234663852886e38
    WHEN v = '-inf'::DOUBLE THEN -3.4028234663852886e38 ELSE v END, 6)) AS finite,
  list_transform(e, lambda v: round(least(greatest(v, -0.1), 0.1), 6)) AS clamped,
  list_transform(e, lambda v: round(exp(v * 10 - list_max(e) * 10)
    / list_sum(list_transform(e, lambda u: exp(u * 10 - list_max(e) * 10))), 6)) AS softmax,
  list_transform(e, lambda v: round(v / greatest(sqrt(list_sum(list_transform(e, lambda u: u * u))), 1e-12), 6)) AS unit,
  round(list_sum(list_transform(e, lambda v: v * v)), 6) AS sq_norm,
  CAST((label + 1) * 2 * (vec_id % 7 + 1) AS BIGINT) AS prod
FROM bad
""")
def q_vector_kernels(spark, sf):
    e = T.split_single_file(load_table(spark, sf, "embeddings"))
    bad = F.transform(F.col("embedding").cast("array<double>"), lambda v, i: (
        F.when((F.col("vec_id") % 5 == 0) & (i == 0), F.lit(float("nan")))
        .when((F.col("vec_id") % 5 == 0) & (i == 1), F.lit(float("inf")))
        .when((F.col("vec_id") % 5 == 0) & (i == 2), F.lit(float("-inf"))).otherwise(v)))
    logits = F.transform(F.col("embedding").cast("array<double>"), lambda v: v * 10)
    shape = F.array((F.col("label") + 1).cast("long"), F.lit(2).cast("long"), (F.col("vec_id") % 7 + 1).cast("long"))
    return e.select("vec_id", round_array(V.nan_to_num(bad)).alias("finite"),
                    round_array(V.clamp_array("embedding", -0.1, 0.1)).alias("clamped"),
                    round_array(V.softmax(logits)).alias("softmax"),
                    round_array(V.l2_normalise("embedding")).alias("unit"),
                    F.round(V.sq_norm("embedding"), 6).alias("sq_norm"), V.product(shape).alias("prod"))


@register("slice_channels", ids=("F27",), sql="""
SELECT vec_id, list_transform(list_filter(list_zip(embedding::DOUBLE[], range(64)), lambda p: p[2] % 16 < 7),
  lambda p: round(p[1], 6)) AS spatial FROM embeddings
""")
def q_slice_channels(spark, sf):
    e = load_table(spark, sf, "embeddings")
    return e.select("vec_id", round_array(V.slice_channels(F.col("embedding").cast("array<double>"), 16, 7))
                    .alias("spatial"))


def _noise_sql(key: str, seed: int, arr: str) -> str:
    u0 = S.hash_uniform(key, seed, "2 * i")
    u1 = S.hash_uniform(key, seed, "2 * i + 1")
    return f"list_transform(range(len({arr})), lambda i: sqrt(-2 * ln(1 - {u0})) * cos(2 * pi() * {u1}))"


@register("noised_pairs", ids=("L1", "F17", "F18"), sql=f"""
WITH b AS (SELECT vec_id, embedding::DOUBLE[] AS x, {S.hash_uniform('vec_id', 31)} AS t0 FROM embeddings),
c AS (SELECT vec_id, x, least(greatest(sqrt(len(x) / 4096.0) * t0 / (1 + (sqrt(len(x) / 4096.0) - 1) * t0), 0), 1) AS t,
      {_noise_sql('vec_id', 32, 'x')} AS eps FROM b)
SELECT vec_id, round(t, 9) AS t,
  list_transform(list_zip(x, eps), lambda p: round((1 - t) * p[1] + t * p[2], 6)) AS x_t,
  list_transform(list_zip(x, eps), lambda p: round(-1.0 * p[1] + 1.0 * p[2], 6)) AS target
FROM c
""")
def q_noised_pairs(spark, sf):
    e = load_table(spark, sf, "embeddings")
    n = L.noised_pairs(e, "embedding", "vec_id", "uniform", "linear", shift=True, seed=31)
    return n.select("vec_id", F.round("t", 9).alias("t"), round_array("x_t").alias("x_t"),
                    round_array("target").alias("target"))


def _pred_table(spark, sf):
    e = load_table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("pred"))
    n = e.count()
    tgt = e.select(F.pmod(F.col("vec_id") - 1, F.lit(n)).alias("vec_id"), F.col("pred").alias("target"))
    j = e.join(tgt, "vec_id")
    j = global_index(j, "vec_id", "idx")
    return j.select("vec_id", "pred", "target", F.floor(F.col("idx") / 50).cast("long").alias("batch"),
                    F.pmod(F.col("idx"), F.lit(50)).cast("int").alias("pos"),
                    hash_uniform("vec_id", 41).alias("t"))


_PRED_SQL = f"""e AS (SELECT vec_id, embedding::DOUBLE[] AS pred FROM embeddings),
j AS (SELECT a.vec_id, a.pred, b.pred AS target FROM e a JOIN e b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM e)),
p AS (SELECT *, CAST((row_number() OVER (ORDER BY vec_id) - 1) // 50 AS BIGINT) AS batch,
  CAST((row_number() OVER (ORDER BY vec_id) - 1) % 50 AS INTEGER) AS pos, {S.hash_uniform('vec_id', 41)} AS t FROM j),
r AS (SELECT *, COALESCE(lag(target) OVER (PARTITION BY batch ORDER BY pos),
  last(target) OVER (PARTITION BY batch ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS rolled
  FROM p),
rl AS (SELECT *,
  list_sum(list_transform(list_zip(pred, target), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) / len(pred) AS denoise,
  -list_sum(list_transform(range(len(pred) // 8), lambda j: list_sum(list_transform(list_zip(
      list_transform(pred[j * 8 + 1: j * 8 + 8], lambda v: v / greatest(sqrt(list_sum(list_transform(pred[j * 8 + 1: j * 8 + 8], lambda u: u * u))), 1e-12)),
      list_transform(target[j * 8 + 1: j * 8 + 8], lambda v: v / greatest(sqrt(list_sum(list_transform(target[j * 8 + 1: j * 8 + 8], lambda u: u * u))), 1e-12))),
    lambda q: q[1] * q[2])))) / (len(pred) // 8) AS proj,
  list_sum(list_transform(list_zip(pred, rolled), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) AS cfm_s,
  len(pred) AS cfm_n FROM r)"""


@register("row_losses", ids=("L2", "L3"), sql=f"""
WITH {_PRED_SQL} SELECT vec_id, round(denoise, 6) AS denoise, round(proj, 6) AS proj FROM rl
""")
def q_row_losses(spark, sf):
    p = _pred_table(spark, sf)
    return p.select("vec_id", F.round(L.denoise_loss("pred", "target"), 6).alias("denoise"),
                    F.round(L.projection_loss("pred", "target", 8), 6).alias("proj"))


@register("batch_losses", ids=("L4", "L5", "W2"), sql=f"""
WITH {_PRED_SQL},
bl AS (SELECT batch, avg(denoise) AS denoise, avg(proj) AS proj, -sum(cfm_s) / sum(cfm_n) AS cfm_loss,
       -sum(cfm_s * t) / sum(cfm_n) AS cfm_linear FROM rl GROUP BY batch)
SELECT batch, round(denoise, 6) AS denoise, round(proj, 6) AS proj, round(cfm_loss, 6) AS cfm_loss,
  round(cfm_linear, 6) AS cfm_linear, round(denoise + 0.5 * proj + 0.05 * cfm_loss, 6) AS loss FROM bl
""")
def q_batch_losses(spark, sf):
    p = _pred_table(spark, sf)
    tot = L.batch_losses(p, "batch", "pos", "pred", "target", 8, t="t")
    return tot.select("batch", *[F.round(c, 6).alias(c) for c in ("denoise", "proj", "cfm_loss", "cfm_linear", "loss")])


@register("total_loss", ids=("L4", "L5"), sql=f"""
WITH {_PRED_SQL},
bl AS (SELECT batch, avg(denoise) AS denoise, avg(proj) AS proj, -sum(cfm_s * t) / sum(cfm_n) AS cfm_loss FROM rl GROUP BY batch)
SELECT batch, round(cfm_loss, 6) AS cfm_loss, round(denoise + 0.7 * proj + 0.1 * cfm_loss, 6) AS loss FROM bl
""")
def q_total_loss(spark, sf):
    """L4 on its own, weighted by t, and L5 over per-row losses."""
    p = _pred_table(spark, sf)
    rows = p.select("batch", L.denoise_loss("pred", "target").alias("denoise"), L.projection_loss("pred", "target", 8).alias("proj"))
    cfm = L.contrastive_loss(p, "batch", "pos", "pred", "target", t="t", weighting="linear")
    tot = L.total_loss(rows, "batch", cfm, proj_coeff=0.7, cfm_coeff=0.1)
    return tot.select("batch", *[F.round(c, 6).alias(c) for c in ("cfm_loss", "loss")])


@register("posterior", ids=("L6", "L7"), sql=f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS p FROM embeddings),
q AS (SELECT vec_id, p[1:32] AS mu, list_transform(p[33:64], lambda v: least(greatest(v, -30.0), 20.0)) AS lv FROM e),
qq AS (SELECT a.*, b.mu AS mu_o, b.lv AS lv_o FROM q a JOIN q b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM e)),
smp AS (SELECT *, list_transform(range(32), lambda i: mu[i + 1] + exp(0.5 * lv[i + 1])
          * sqrt(-2 * ln(1 - {S.hash_uniform('vec_id', 51, '2 * i')})) * cos(2 * pi() * {S.hash_uniform('vec_id', 51, '2 * i + 1')}))
        AS x FROM qq)
SELECT vec_id,
  round(0.5 * list_sum(list_transform(range(32), lambda i: mu[i + 1] * mu[i + 1] + exp(lv[i + 1]) - 1.0 - lv[i + 1])), 6)
    AS kl,
  round(0.5 * list_sum(list_transform(range(32), lambda i: (mu[i + 1] - mu_o[i + 1]) * (mu[i + 1] - mu_o[i + 1])
    / exp(lv_o[i + 1]) + exp(lv[i + 1]) / exp(lv_o[i + 1]) + (lv_o[i + 1] - lv[i + 1]) - 1.0)), 6) AS kl_pair,
  round(0.5 * list_sum(list_transform(range(32), lambda i: (x[i + 1] - mu[i + 1]) * (x[i + 1] - mu[i + 1])
    / exp(lv[i + 1]) + lv[i + 1] + ln(2 * pi()))), 6) AS nll,
  round(list_sum(mu), 6) AS mode_sum,
  round(list_sum(list_transform(lv, lambda v: exp(0.5 * v))), 6) AS std_sum
FROM smp
""")
def q_posterior(spark, sf):
    e = load_table(spark, sf, "embeddings")
    n = e.count()
    q = e.select("vec_id", L.posterior("embedding").alias("post"))
    o = q.select(F.pmod(F.col("vec_id") - 1, F.lit(n)).alias("vec_id"), F.col("post").alias("other"))
    j = q.join(o, "vec_id").withColumn("x", L.posterior_sample("post", "vec_id", seed=51))
    return j.select("vec_id", F.round(L.posterior_kl("post"), 6).alias("kl"),
                    F.round(L.posterior_kl("post", "other"), 6).alias("kl_pair"),
                    F.round(L.posterior_nll("post", "x"), 6).alias("nll"),
                    F.round(V.arr_sum(L.posterior_mode("post")), 6).alias("mode_sum"),
                    F.round(V.arr_sum("post.std"), 6).alias("std_sum"))
