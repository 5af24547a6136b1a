"""Rules that hold at every size: no caps, no hidden passes, complete streams."""

from __future__ import annotations

from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlake import plans
from pairlake.operators import losses as L
from pairlake.operators import metrics as M
from pairlake.operators.channels import channel_stats
from pairlake.operators.index import first_n, global_index
from pairlake.operators import cells as C
from pairlake.operators.linalg import feature_moments
from pairlake.operators.sampling import sample_exact
from pairlake.operators import stats as ST
from pairlake.operators.pairing import repeated_ids
from pairlake.operators.stats import keep_previous
from tools.oracle_check import digest


def test_channel_stats_use_every_tensor(spark):
    df = spark.range(30_000).select(F.array(*[(F.col("id") % 97 + i).cast("double") for i in range(6)]).alias("x"))
    got = {r["channel"]: r for r in channel_stats(df, "x", 3).collect()}
    x = np.arange(30_000)[:, None] % 97 + np.arange(6)
    for c in range(3):
        block = x[:, 2 * c:2 * c + 2]
        assert got[c]["n"] == 60_000
        assert got[c]["mean"] == pytest.approx(block.mean()) and got[c]["std"] == pytest.approx(block.std(ddof=1))


def test_channel_stats_of_null_elements_and_mixed_sizes(spark):
    df = spark.createDataFrame([([1.0, None, 3.0, 4.0],), (None,), ([5.0, 7.0],), ([],)], "x array<double>")
    got = {r["channel"]: (r["n"], r["mean"], r["std"]) for r in channel_stats(df, "x", 2).collect()}
    assert got[0] == (3, 3.0, pytest.approx(8 ** 0.5))
    assert got[1][0] == 3 and got[1][1] == pytest.approx(14 / 3)
    assert channel_stats(df.limit(0), "x", 2).collect() == []


def test_exact_sample_of_repeated_keys_and_copies(spark):
    df = spark.range(500).select((F.col("id") % 5).alias("k"), (F.col("id") % 50).alias("v"))
    for n in (1, 25, 101, 499, 500, 900):
        assert sample_exact(df, n, "k", 3).count() == min(n, 500)


def test_first_n_at_any_n(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x"))
    for n in (0, 1, 999, 1000, 5000):
        assert sorted(r[0] for r in first_n(df, "x", n).collect()) == list(range(min(n, 1000)))


def test_index_of_empty_table(spark):
    assert global_index(spark.range(0), "id").collect() == []


def jobs(spark, build):
    """Job ids that building a plan starts."""
    sc = spark.sparkContext
    sc.setJobGroup("plan-only", "plan-only")
    try:
        build()
        return list(sc.statusTracker().getJobIdsForGroup("plan-only"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_moments_and_scores_build_without_running(spark):
    e = spark.range(200).select("id", F.array(*[F.rand(i) for i in range(4)]).alias("x")).repartition(4, "id")
    assert jobs(spark, lambda: feature_moments(e, "x")) == []
    assert jobs(spark, lambda: channel_stats(e, "x", 2)) == []


def test_tile_pass_runs_once_per_query(spark, monkeypatch):
    e = spark.range(300).select("id", F.array(*[F.rand(i) for i in range(4)]).alias("x")).repartition(3, "id")
    ref, smp = M.pin(e.filter("id % 2 = 0")), M.pin(e.filter("id % 2 = 1"))
    runs = spark.sparkContext.accumulator(0)
    base = M._knn_kernel

    def counted(k):
        kernel = base(k)

        def run(a, b):
            runs.add(1)
            return kernel(a, b)
        return run
    monkeypatch.setattr(M, "_knn_kernel", counted)
    for name, run in {
        "clamp": lambda: M.clamp_radii(M.manifold_radii(ref, "id", "x"), 90.0).collect(),
        "evaluate": lambda: M.manifold_evaluate(ref, M.manifold_radii(ref, "id", "x"), smp, "id", "x").collect(),
        "pr": lambda: M.precision_recall(ref, smp, "id", "x").collect(),
    }.items():
        before = runs.value
        run()
        assert runs.value - before == (2 if name == "pr" else 1), name


def clustered(spark, n, clusters, spread=0.01, dim=8):
    """Rows around centres on a wide lattice."""
    centre = F.pmod(F.xxhash64("id"), F.lit(clusters))
    x = F.array(*[(F.pmod(F.xxhash64(centre, F.lit(i)), F.lit(1000)) + F.rand(i + 1) * spread).cast("double") for i in range(dim)])
    return M.pin(spark.range(n).select("id", x.alias("x")))


def test_share_of_pairs_falls_as_a_clustered_set_grows(spark):
    shares = []
    for n in (800, 8000):
        df, work = clustered(spark, n, 12), {}
        got = {r["id"]: r["radius"] for r in M.manifold_radii(df, "id", "x", 3, block_rows=100, work=work).collect()}
        x = np.array([r["x"] for r in df.orderBy("id").collect()])
        some = range(0, n, 97)
        want = [np.sort(((x - x[i]) ** 2).sum(axis=1))[3] for i in some]
        assert np.allclose([got[i] for i in some], want, rtol=1e-6, atol=1e-9)
        shares.append((work["home"] + work.get("away", 0)) / n**2)
    assert shares[1] < shares[0] / 2 and shares[1] < 0.2


def test_rows_of_a_crowded_cell_are_split(spark, monkeypatch):
    monkeypatch.setattr(C, "TILE_BLOCKS", 1)
    rows = [(i, [0.0, 0.0]) for i in range(400)] + [(400 + i, [float(i), 1.0]) for i in range(200)] + [(600, [1e6, 1e6])]
    df = M.pin(spark.createDataFrame(rows, "id long, x array<double>").repartition(3))
    sizes = spark.sparkContext.accumulator(0)
    base = M._knn_kernel

    def watched(k):
        kernel = base(k)

        def run(a, b):
            if max(a.num_rows, b.num_rows) > 200:  # hash parts of 50 rows on average
                sizes.add(1)
            return kernel(a, b)
        return run
    monkeypatch.setattr(M, "_knn_kernel", watched)
    got = {r["id"]: r["radius"] for r in M.manifold_radii(df, "id", "x", 3, block_rows=50).collect()}
    x = np.array([r[1] for r in rows])
    want = np.sort(((x[:, None] - x[None]) ** 2).sum(-1), axis=1)[:, 3]
    assert np.allclose([got[i] for i in range(601)], want, rtol=1e-6, atol=1e-6) and sizes.value == 0


def test_visitors_are_sent_once_to_a_group_of_cells(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(900, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    sent, plain = [], C._meet

    def meet(cells, visitors, visits, *rest):
        sent.append(int(visits.sum()))
        return plain(cells, visitors, visits, *rest)
    monkeypatch.setattr(C, "_meet", meet)
    work = {}
    got = {r["id"]: r["radius"] for r in M.manifold_radii(df, "id", "x", 3, block_rows=8, work=work).collect()}
    d = np.sort(((x[:, None] - x[None]) ** 2).sum(-1), axis=1)
    assert np.allclose([got[i] for i in range(900)], d[:, 3], atol=1e-9)
    assert work["away"] > 100_000 and sent[0] == 900 and sent[1] <= 900
    ref, smp, sent[:] = df.filter("id < 500"), df.filter("id >= 500"), []
    ev = M.manifold_evaluate(ref, M.manifold_radii(ref, "id", "x", 3), smp, "id", "x", block_rows=8).collect()
    d, r = ((x[500:, None] - x[None, :500]) ** 2).sum(-1), np.sort(((x[:500, None] - x[None, :500]) ** 2).sum(-1), axis=1)[:, 3]
    for row in ev:
        mine = d[row["id"] - 500]
        assert row["inside"] == bool((mine <= r).any()) and row["nearest"] == int(mine.argmin())
        assert row["realism"] == pytest.approx((r / (mine + 1e-5)).max()) and row["min_d"] == pytest.approx(mine.min())
    assert len(ev) == 400 and sent[-1] <= 400


def test_cells_with_values_that_are_not_finite(spark):
    rows = [(i, [float(i % 7), float(i)]) for i in range(60)] + [(60, [float("nan"), 0.0]), (61, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    got = {r["id"]: r["radius"] for r in M.manifold_radii(df, "id", "x", 2, block_rows=10).collect()}
    x = np.array([r[1] for r in rows[:60]])
    want = np.sort(((x[:, None] - x[None]) ** 2).sum(-1), axis=1)[:, 2]
    assert len(got) == 62 and np.allclose([got[i] for i in range(60)], want, atol=1e-9)


@pytest.mark.parametrize("name", ["stream_stats", "stream_stats_rank0", "stream_cumulative", "stream_keep_previous"])
def test_streams_read_a_folder_like_a_file(spark, sf, tmp_dir, name):
    spark.read.parquet(f"{sf}/events.parquet").repartition(5).write.parquet(f"{tmp_dir}/events.parquet")
    folder, file = (plans.QUERIES[name].fn(spark, d) for d in (tmp_dir, sf))
    assert digest(folder.columns, folder.collect()) == digest(file.columns, file.collect())


def test_keep_previous_stream_of_many_batches_a_task(spark, sf):
    query, small = plans.QUERIES["stream_keep_previous"].fn, "spark.sql.execution.arrow.maxRecordsPerBatch"
    whole = query(spark, sf)
    want, before = digest(whole.columns, whole.collect()), spark.conf.get(small)
    spark.conf.set(small, "64")
    try:
        got = query(spark, sf)
        assert digest(got.columns, got.collect()) == want
    finally:
        spark.conf.set(small, before)


def test_keep_previous_of_far_rounds(spark):
    rows = [("a", 0, 1, 2.0, 4.0), ("a", 10**12, 0, 0.0, 0.0), ("b", 10**12, 2, 6.0, 20.0), ("a", 2 * 10**12, 1, 5.0, 25.0)]
    df = spark.createDataFrame(rows, "name string, round long, num long, sum double, sumsq double")
    got = sorted((r["name"], r["round"], r["num"], r["sum"]) for r in keep_previous(df).collect())
    assert got == [("a", 0, 1, 2.0), ("a", 10**12, 1, 2.0), ("a", 2 * 10**12, 1, 5.0), ("b", 10**12, 2, 6.0),
                   ("b", 2 * 10**12, 2, 6.0)]


def test_keep_previous_stream_fills_rounds_without_any_report(spark, sf, tmp_dir):
    events, day = spark.read.parquet(f"{sf}/events.parquet"), F.dayofmonth("ts")
    events.filter((day < 10) | ((day >= 13) & (day < 16))).write.parquet(f"{tmp_dir}/events.parquet")
    got = {}
    for r in plans.QUERIES["stream_keep_previous"].fn(spark, tmp_dir).collect():
        got.setdefault(r["name"], {})[r["round_start"]] = (r["num"], r["mean"], r["std"])
    end = max(max(rounds) for rounds in got.values())
    for rounds in got.values():
        assert sorted(rounds) == list(range(min(rounds), end + 1, 86400))
    silent = [d for d in range(min(min(r) for r in got.values()), end, 86400)
              if datetime.fromtimestamp(d, UTC).day in (10, 11, 12)]
    assert len(silent) >= 3
    for rounds in got.values():
        assert all(rounds[d] == rounds[d - 86400] for d in silent if d - 86400 in rounds)


def test_frechet_guards():
    one = np.eye(2)
    with pytest.raises(ValueError, match="not finite"):
        M.frechet_from_stats(np.zeros(2), one * np.nan, np.zeros(2), one)
    with pytest.raises(ValueError, match="semi-definite"):
        M.frechet_from_stats(np.zeros(3), np.diag([1.0, -1.0, 2.0]), np.zeros(3), np.eye(3))
    assert M.frechet_from_stats(np.zeros(2), one * 0, np.ones(2), one * 0) == pytest.approx(2.0)


def test_fast_draws_keep_the_distribution(spark):
    df = spark.range(4000).select("id", F.array(F.lit(0.0)).alias("x"))
    eps = np.array([r[0] for r in L.noised_pairs(df, "x", "id", fast=True).select(F.col("eps")[0]).collect()])
    assert abs(eps.mean()) < 0.06 and abs(eps.std() - 1) < 0.05


def test_replica_zero_must_report(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 1.0), ("b", 1, 2.0)], "name string, replica int, value double")
    assert [r["name"] for r in ST.replica_consistency(df).collect()] == ["b"]


def test_repeated_ids_are_reported(spark):
    images = spark.createDataFrame([("x/img1.png",), ("x/img1.jpg",), ("x/img2.png",)], "path string")
    features = spark.createDataFrame([("x/img-latents-1.npy",), ("x/img-latents-2.npy",)], "path string")
    assert [tuple(r) for r in repeated_ids(images, features).collect()] == [("x/1", 2, 1)]
