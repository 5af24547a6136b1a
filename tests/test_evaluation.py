"""Evaluation operators against numpy twins, with many tiles."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlake.operators import metrics as M
from pairlake.operators.linalg import collect_moments, feature_moments, sq_dists

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def sets(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    rows = sorted(e.collect(), key=lambda r: r["vec_id"])
    x = np.array([r["embedding"] for r in rows], dtype=np.float64)
    lab = np.array([r["label"] for r in rows])
    ids = np.array([r["vec_id"] for r in rows])
    return e, x, lab, ids


def _np_radii(x, k):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    return np.sort(d, axis=1)[:, k]


def test_radii_match_numpy_with_many_tiles(spark, sets):
    e, x, _, ids = sets
    got = {r["vec_id"]: r["radius"] for r in M.manifold_radii(e, "vec_id", "embedding", 3, block_rows=64).collect()}
    want = _np_radii(x, 3)
    assert np.allclose([got[i] for i in ids], want, rtol=0, atol=1e-10)


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_results_do_not_depend_on_partitioning(spark, sets, parts):
    e, x, lab, ids = sets
    d = e.repartition(parts)
    radii = {r["vec_id"]: r["radius"] for r in M.manifold_radii(d, "vec_id", "embedding", 3, block_rows=100).collect()}
    assert np.allclose([radii[i] for i in ids], _np_radii(x, 3), atol=1e-10)
    pr = M.precision_recall(d.filter("label < 5"), d.filter("label >= 5"), "vec_id", "embedding", 3,
                            block_rows=100).first()
    base = M.precision_recall(e.filter("label < 5"), e.filter("label >= 5"), "vec_id", "embedding", 3).first()
    assert (pr["precision"], pr["recall"]) == (base["precision"], base["recall"])


def test_manifold_evaluate_matches_numpy_over_many_cells(spark, sets):
    e, x, lab, ids = sets
    ref, smp, r = x[lab < 5], x[lab >= 5], _np_radii(x[lab < 5], 3)
    d = ((smp[:, None, :] - ref[None, :, :]) ** 2).sum(-1)
    radii = M.manifold_radii(e.filter("label < 5"), "vec_id", "embedding", 3, block_rows=40)
    got = {g["vec_id"]: g for g in M.manifold_evaluate(e.filter("label < 5"), radii, e.filter("label >= 5"), "vec_id",
                                                       "embedding", block_rows=40).collect()}
    got = [got[i] for i in ids[lab >= 5]]
    assert [g["inside"] for g in got] == (d <= r).any(axis=1).tolist()
    assert [g["nearest"] for g in got] == ids[lab < 5][d.argmin(axis=1)].tolist()
    assert np.allclose([g["realism"] for g in got], (r / (d + 1e-5)).max(axis=1))
    assert np.allclose([g["min_d"] for g in got], d.min(axis=1))


def test_grouped_radii_match_numpy_per_group(spark, sets):
    e, x, lab, ids = sets
    got = {(r["label"], r["vec_id"]): r["radius"]
           for r in M.manifold_radii_grouped(e, "label", "vec_id", "embedding", 3, block_rows=16).collect()}
    for g in np.unique(lab):
        want = _np_radii(x[lab == g], 3)
        assert np.allclose([got[(str(g), i)] for i in ids[lab == g]], want, atol=1e-10)


def test_precision_recall_match_numpy(spark, sets):
    e, x, lab, _ = sets
    ref, smp = x[lab < 5], x[lab >= 5]
    r1, r2 = _np_radii(ref, 3), _np_radii(smp, 3)
    d = ((ref[:, None, :] - smp[None, :, :]) ** 2).sum(-1)
    precision = (d <= r1[:, None]).any(axis=0).mean()
    recall = (d <= r2[None, :]).any(axis=1).mean()
    pr = M.precision_recall(e.filter("label < 5"), e.filter("label >= 5"), "vec_id", "embedding", 3,
                            block_rows=50).first()
    assert pr["precision"] == pytest.approx(precision, abs=1e-12)
    assert pr["recall"] == pytest.approx(recall, abs=1e-12)


def test_moments_match_numpy_cov(spark, sets):
    e, x, _, _ = sets
    for parts, fanout in ((7, 16), (9, 2)):  # (9, 2): three merge levels
        n, mu, sigma = collect_moments(feature_moments(e.repartition(parts), "embedding", dim_block=10,
                                                       fanout=fanout))
        assert n == len(x)
        assert np.allclose(mu, x.mean(0), atol=1e-12)
        assert np.allclose(sigma, np.cov(x, rowvar=False), atol=1e-12)


def test_frechet_matches_eig_form_and_is_zero_on_itself(spark, sets):
    e, x, lab, _ = sets
    a, b = x[lab < 5], x[lab >= 5]
    s1, s2 = np.cov(a, rowvar=False), np.cov(b, rowvar=False)
    ev = np.linalg.eigvals(s1 @ s2)
    tr = np.sqrt(np.clip(ev.real, 0, None)).sum()
    diff = a.mean(0) - b.mean(0)
    want = diff @ diff + np.trace(s1) + np.trace(s2) - 2 * tr
    got = M.frechet_distance(e.filter("label < 5"), e.filter("label >= 5"), "embedding")
    assert got == pytest.approx(want, rel=1e-8, abs=1e-10)
    assert abs(M.frechet_distance(e, e, "embedding")) < 1e-8


def test_frechet_shape_mismatch_raises():
    with pytest.raises(ValueError):
        M.frechet_from_stats(np.zeros(3), np.eye(3), np.zeros(4), np.eye(4))


def test_inception_score_two_pass_twin(spark, sets):
    e, x, _, _ = sets
    z = x[:, :10] * 10.0
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    scores = []
    for i in range(0, len(p), 70):
        part = p[i:i + 70]
        kl = part * (np.log(part) - np.log(part.mean(0, keepdims=True)))
        scores.append(np.exp(kl.sum(1).mean()))
    logits = e.withColumn("logits", F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 10),
                                                lambda v: v * 10.0))
    got = M.inception_score(logits, "vec_id", "logits", 70).first()[0]
    assert got == pytest.approx(float(np.mean(scores)), rel=1e-10)


def test_manifold_of_reference_against_itself_is_full(spark, sets):
    e, _, _, _ = sets
    radii = M.manifold_radii(e, "vec_id", "embedding", 3, block_rows=100)
    ev = M.manifold_evaluate(e, radii, e, "vec_id", "embedding", block_rows=100)
    r = ev.agg(F.avg(F.col("inside").cast("double")).alias("f"),
               F.sum((F.col("nearest") == F.col("vec_id")).cast("int")).alias("self")).first()
    assert r["f"] == 1.0
    assert r["self"] == e.count()


def test_tile_kernel_distances_are_exact_enough():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(30, 16)) + 100.0, rng.normal(size=(20, 16)) + 100.0
    direct = ((a[:, None, :] - b[None, :, :]) ** 2).sum(-1)
    assert np.allclose(sq_dists(a, b), direct, atol=1e-9)


def test_percentile_matches_numpy(spark):
    df = spark.range(0, 1001).select((F.col("id") * 3 % 1001).cast("double").alias("v"))
    vals = np.arange(1001, dtype=float)
    for pct in (0, 12.5, 50, 90, 100):
        assert M.exact_percentile(df, "v", pct) == pytest.approx(np.percentile(vals, pct))


@pytest.mark.parametrize("small", [1, 7, 4096])
def test_selection_of_skewed_and_tied_values(spark, monkeypatch, small):
    monkeypatch.setattr(M, "SELECT_ROWS", small)
    rng = np.random.default_rng(small)
    sets = {"ties": np.repeat([1.0, 2.0, 5.0], [300, 400, 301]), "wide": np.exp(rng.normal(size=900) * 50),
            "one": np.full(50, 3.5), "two": np.array([2.0, 1.0]), "ends": np.r_[-np.inf, np.arange(600.0), np.inf, np.inf]}
    for name, vals in sets.items():
        df = spark.createDataFrame([(float(x),) for x in rng.permutation(vals)] + [(None,)], "v double").repartition(3)
        pcts = {f"p{i}": p for i, p in enumerate((0, 0.1, 33.3, 50, 90, 99.9, 100))}
        got = M.percentiles_frame(df, "v", pcts).first()
        with np.errstate(invalid="ignore"):
            want = [np.percentile(vals, p) for p in pcts.values()]
        sure = np.isfinite(want) if name == "ends" else np.ones(len(want), bool)  # inf - inf is not compared
        assert np.allclose(np.array(got)[sure], np.array(want)[sure], rtol=1e-12)
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "v double")
    got = M.percentiles_frame(nan, "v", {"a": 0.0, "b": 50.0, "c": 100.0}).first()
    assert got["a"] == 1.0 and got["b"] == 2.0 and np.isnan(got["c"])
    assert M.percentiles_frame(nan.limit(0), "v", {"a": 50.0}).first()["a"] is None


def test_selection_and_split_scores_shuffle_no_rows(spark, sets, monkeypatch):
    e, x, _, ids = sets
    logits = e.select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda v: v * 10.0).alias("logits"))
    parts = M.inception_score_splits(logits.repartition(5), "vec_id", "logits", 70)
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(split") == 1 and "Join" not in plan
    near = parts.orderBy("split").collect()
    monkeypatch.setattr(M, "MOST_SPLITS", 2)
    joined = M.inception_score_splits(logits, "vec_id", "logits", 70).orderBy("split").collect()
    assert [r["n"] for r in near] == [r["n"] for r in joined] == [70] * (len(x) // 70) + ([len(x) % 70] if len(x) % 70 else [])
    assert np.allclose([r["score"] for r in near], [r["score"] for r in joined], rtol=1e-12)
    names = logits.select(F.format_string("k%06d", "vec_id").alias("vec_id"), "logits")
    monkeypatch.setattr(M, "MOST_SPLITS", 1000)
    assert np.allclose([r["score"] for r in M.inception_score_splits(names, "vec_id", "logits", 70).orderBy("split").collect()],
                       [r["score"] for r in near], rtol=1e-12)
