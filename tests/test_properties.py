"""Invariants: partition-count independence, permutations, shards, inverse
transforms, moment merging, sampling."""

from __future__ import annotations

import os
import posixpath

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlake.functions import paths as P
from pairlake.functions.timefmt import format_time, format_time_brief
from pairlake.operators import batching as B
from pairlake.operators import stats as ST
from pairlake.operators.channels import channel_stats, denormalise, normalise, stats_arrays
from pairlake.operators.geometry import crop_plan
from pairlake.operators.index import global_index
from pairlake.operators.sampling import sample_exact

from .conftest import SF_SMALL


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_global_index_is_layout_independent(spark, parts):
    # skewed: most rows share one prefix, some partitions empty after the filter
    df = spark.range(0, 3000).select((F.col("id") * 7919 % 3000).alias("k")).repartition(parts)
    df = df.filter((F.col("k") < 200) | (F.col("k") > 2500))
    idx = global_index(df, "k", "i", partitions=parts).collect()
    got = sorted((r["k"], r["i"]) for r in idx)
    assert [i for _, i in got] == list(range(len(got)))


def test_global_index_with_repeated_keys_and_tiebreak(spark):
    df = spark.range(0, 500).select((F.col("id") % 3).alias("k"), "id")
    idx = global_index(df, "k", "i", partitions=5, tiebreak=True).collect()
    assert sorted(r["i"] for r in idx) == list(range(500))
    by = sorted(idx, key=lambda r: r["i"])
    assert [r["k"] for r in by] == sorted(r["k"] for r in by)


def test_epoch_order_is_a_permutation_per_epoch(spark):
    d = spark.range(0, 123).withColumnRenamed("id", "key")
    e = B.epoch_order(d, "key", epochs=3, seed=1).collect()
    for ep in range(3):
        rows = [r for r in e if r["epoch"] == ep]
        assert sorted(r["key"] for r in rows) == list(range(123))
        assert sorted(r["position"] for r in rows) == list(range(123))
    orders = [[r["key"] for r in sorted([r for r in e if r["epoch"] == ep], key=lambda r: r["position"])]
              for ep in range(3)]
    assert orders[0] != orders[1] != orders[2]


def test_rank_shards_are_disjoint_and_cover(spark):
    d = spark.range(0, 50).withColumnRenamed("id", "key")
    e = B.epoch_order(d, "key", epochs=2, seed=3)
    got = []
    for r in range(3):
        got += [row["global_position"] for row in B.rank_shard(e, "global_position", r, 3, start_idx=4).collect()]
    assert sorted(got) == list(range(4, 100))


def test_normalise_then_denormalise_is_identity(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    mean, std = stats_arrays(channel_stats(e, "embedding", 4, key="vec_id"))
    back = e.select("embedding", denormalise(normalise("embedding", mean, std), mean, std).alias("b")).collect()
    for r in back[:50]:
        assert np.allclose(r["embedding"], r["b"], atol=1e-12)


def test_zero_std_gives_ieee_results(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0, 3.0],)], "x array<double>")
    out = [r["z"] for r in df.select(normalise("x", [1.0], [0.0]).alias("z")).collect()]
    flat = [v for row in out for v in row]
    assert any(np.isnan(v) for v in flat) and all(np.isnan(v) or np.isinf(v) for v in flat)


def test_moments_merge_in_any_grouping(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select(
        F.col("event_type").alias("name"), "value", (F.col("user_id") % 5).alias("g"))
    direct = {r["name"]: (r["num"], r["sum"]) for r in ST.moments(ev, "name", "value").collect()}
    merged = ST.merge_moments(ST.moments(ev.repartition(9), ["name", "g"], "value"), "name").collect()
    for r in merged:
        assert r["num"] == direct[r["name"]][0]
        assert r["sum"] == pytest.approx(direct[r["name"]][1], rel=1e-12)


def test_collect_stats_edge_rules(spark):
    rows = [("a", float("nan")), ("a", 1e20), ("b", 2.0), ("c", 1.0), ("c", 3.0), ("d", float("inf"))]
    df = spark.createDataFrame(rows, "name string, value double")
    got = {r["name"]: r for r in ST.collect_stats(df).collect()}
    assert got["a"]["num"] == 0 and np.isnan(got["a"]["mean"]) and np.isnan(got["a"]["std"])
    assert got["b"]["num"] == 1 and got["b"]["std"] == 0.0
    assert got["c"]["mean"] == 2.0 and got["c"]["std"] == 1.0


def test_name_set_consistency(spark):
    ok = spark.createDataFrame([(r, p, n) for r in range(3) for p, n in enumerate("xyz")], "rank int, pos int, name string")
    assert ST.name_set_consistency(ok)
    bad = ok.union(spark.createDataFrame([(1, 3, "w")], "rank int, pos int, name string"))
    with pytest.raises(ValueError):
        ST.name_set_consistency(bad)


def test_sample_exact_size_and_stability(spark):
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id")
    a = sorted(r[0] for r in sample_exact(d, 37, "doc_id", seed=5).collect())
    b = sorted(r[0] for r in sample_exact(d.repartition(13), 37, "doc_id", seed=5).collect())
    assert len(a) == 37 and a == b


NAMES = ["a/b.c", "a.b/c", ".bashrc", "a/.hidden", "x..y", "file.", "..a.b", "noext", "a/b/c.tar.gz", "png",
         "dir.d/x", "a/b.", "...", "a\\b.c"]


def test_splitext_semantics(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "p string")
    got = {r["p"]: (r["stem"], r["ext"]) for r in df.select("p", P.path_stem("p").alias("stem"),
                                                             P.path_ext("p").alias("ext")).collect()}
    for n in NAMES:
        assert got[n] == posixpath.splitext(n), n


def test_extract_id_examples(spark):
    rows = [("data_000000/img-latents-flux_512_100k_00000014.npy",), ("data_000000/flux_512_100k_00000014.png",),
            ("data_000000/imgur_1.png",), ("img-latents-x.npy",), ("a\\img7.png",)]
    df = spark.createDataFrame(rows, "p string")
    got = [r[0] for r in df.select(P.extract_id("p")).collect()]
    assert got == ["data_000000/flux_512_100k_00000014", "data_000000/flux_512_100k_00000014",
                   "data_000000/ur_1", "img-latents-x", "a/7"]


def _py_time(s, brief):
    s = int(np.rint(s))
    if s < 60:
        return f"{s}s"
    if s < 3600:
        return f"{s // 60}m {s % 60:02}s"
    if s < 86400:
        return f"{s // 3600}h {(s // 60) % 60:02}m" + ("" if brief else f" {s % 60:02}s")
    return f"{s // 86400}d {(s // 3600) % 24:02}h" + ("" if brief else f" {(s // 60) % 60:02}m")


def test_format_time_matches_python(spark):
    vals = [0, 0.5, 1.5, 59.4, 59.6, 61, 3599.5, 3600, 86399, 86400, 987654.5, 12345678]
    df = spark.createDataFrame([(float(v),) for v in vals], "s double")
    got = df.select(format_time("s").alias("a"), format_time_brief("s").alias("b")).collect()
    for v, r in zip(vals, got):
        assert (r["a"], r["b"]) == (_py_time(v, False), _py_time(v, True))


def _dhariwal_loop(w, h, s):
    while min(w, h) >= 2 * s:
        w, h = w // 2, h // 2
    scale = s / min(w, h)
    return round(w * scale), round(h * scale)


def test_dhariwal_closed_form_matches_loop(spark):
    rng = np.random.default_rng(1)
    sizes = [(int(a), int(b)) for a, b in rng.integers(1, 5000, size=(3000, 2))]
    df = spark.createDataFrame(sizes, "w long, h long")
    got = df.select("w", "h", crop_plan("w", "h", "center-crop-dhariwal", 256, 256).alias("p")).collect()
    for r in got:
        assert (r["p"]["resize_w"], r["p"]["resize_h"]) == _dhariwal_loop(r["w"], r["h"], 256)


def test_zero_pad_never_truncates(spark):
    df = spark.createDataFrame([(7,), (123456789,)], "i long")
    assert [r[0] for r in df.select(P.zero_pad("i", 8)).collect()] == ["00000007", "123456789"]


def test_fixed_environment_is_local():
    assert os.path.isdir(SF_SMALL)


@pytest.mark.parametrize("fast", [False, True])
def test_drop_tokens_keeps_distinct_positions(spark, fast):
    from pairlake.operators.batching import drop_tokens, pad_with_mask
    d = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", F.split("text", " ").alias("tok"))
    out = drop_tokens(d, "tok", "doc_id", 4, 0.5, 17, fast=fast)
    rows = out.select("tok", "ids", "kept", pad_with_mask("kept", "ids", 4, F.size("tok") - 4, "<m>").alias("back")).collect()
    for r in rows:
        rest = len(r["tok"]) - 4
        keep = max(1, int(rest * 0.5))
        if r["ids"] is None:
            assert rest <= 1 or keep >= rest
            continue
        assert len(set(r["ids"])) == len(r["ids"]) == keep and all(0 <= i < rest for i in r["ids"])
        assert r["kept"][4:] == [r["tok"][4 + i] for i in r["ids"]]
        assert [t for t in r["back"][4:] if t != "<m>"] == [r["tok"][4 + i] for i in sorted(r["ids"])
                                                              if r["tok"][4 + i] != "<m>"]


@pytest.mark.parametrize("fast", [False, True])
def test_keyed_permutation_is_one_at_every_size(spark, fast):
    from pairlake.functions.rand import permute
    for n in (1, 2, 3, 7, 16, 17, 101, 1000, 4099):
        df = spark.range(n).select("id", *[permute("id", n, 5, e, fast).alias(f"p{e}") for e in range(2)])
        rows = df.collect()
        assert all(sorted(r[k] for r in rows) == list(range(n)) for k in (1, 2))
        if n > 100:  # epochs and neighbours are unrelated
            assert sum(r[1] == r[2] for r in rows) < n * 0.02 + 3
            places = [r[1] for r in sorted(rows, key=lambda r: r["id"])]
            up = sum(b > a for a, b in zip(places, places[1:]))
            assert 0.4 < up / (n - 1) < 0.6
            half = sum(p < n // 2 for p in places[:n // 2])
            assert abs(half - n / 4) < 4 * (n ** 0.5) / 4 + 1


def test_permuted_epochs_exchange_nothing(spark):
    df = B.permuted_epochs(spark.range(500).withColumnRenamed("id", "i"), "i", 500, epochs=3, seed=2)
    plan = B.rank_shard(df, "global_position", 1, 4, 7)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    seen = [r["global_position"] for k in range(4) for r in B.rank_shard(df, "global_position", k, 4).collect()]
    assert sorted(seen) == list(range(1500))
