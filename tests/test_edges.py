"""Edge rows: empty input, one row, all-NULL labels, duplicate keys, ties,
failing contracts that must raise."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pairlake.functions import paths as P
from pairlake.functions import vectors as V
from pairlake.operators import metrics as M
from pairlake.operators import pairing as J
from pairlake.operators.geometry import validate_uniform
from pairlake.operators.index import global_index
from pairlake.operators.sampling import sample_exact
from pairlake.operators.stats import collect_stats


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "k long, name string, value double, label long")
    assert global_index(empty.select("k"), "k", "i").count() == 0
    assert sample_exact(empty, 5, "k").count() == 0
    assert collect_stats(empty).count() == 0
    counts, flag = J.label_coverage(empty)
    assert counts.count() == 0 and flag.first()["all_labelled"] is True


def test_one_row_radius_is_null(spark):
    one = spark.createDataFrame([(1, [0.0, 1.0])], "vec_id long, embedding array<float>")
    r = M.manifold_radii(one, "vec_id", "embedding", 3).first()
    assert r["radius"] is None


def test_nearest_breaks_ties_by_smallest_id(spark):
    ref = spark.createDataFrame([(5, [1.0, 0.0]), (2, [-1.0, 0.0]), (9, [3.0, 0.0])], "vec_id long, embedding array<float>")
    ev = spark.createDataFrame([(100, [0.0, 0.0])], "vec_id long, embedding array<float>")
    radii = spark.createDataFrame([(5, 1.0), (2, 1.0), (9, 1.0)], "vec_id long, radius double")
    r = M.manifold_evaluate(ref, radii, ev, "vec_id", "embedding").first()
    assert r["nearest"] == 2 and r["min_d"] == 1.0 and r["inside"] is True


def test_missing_label_and_caption_contracts(spark):
    files = spark.createDataFrame([("a/x.png",), ("a/y.png",)], "path string")
    man = spark.createDataFrame([("a/x.png", 1)], "fname string, label long")
    assert J.attach_class_labels(files, man).filter("label IS NULL").count() == 1
    with pytest.raises(Exception, match="no class label"):
        J.attach_class_labels(files, man, on_missing="error").collect()
    feats = spark.createDataFrame([("d/img-latents-7.npy",)], "path string")
    caps = spark.createDataFrame([("d/8", "c")], "id string, caption string")
    with pytest.raises(Exception, match="d/7"):
        J.attach_captions(feats, caps).collect()


def test_positional_pairing_refuses_unequal_counts(spark):
    a = spark.createDataFrame([("x/1.png",), ("x/2.png",)], "path string")
    b = spark.createDataFrame([("x/1.npy",)], "path string")
    with pytest.raises(ValueError):
        J.pair_by_position(a, b)


def test_single_folder_gives_no_labels(spark):
    files = spark.createDataFrame([("only/a.png",), ("only/b.png",)], "path string")
    assert J.infer_labels_from_dirs(files).filter("label IS NOT NULL").count() == 0


def test_duplicate_manifest_keys_latest_wins(spark):
    m = spark.createDataFrame([(0, "a", 1), (1, "a", 2), (2, "b", 3), (3, "a", 4)], "pos long, fname string, label long")
    got = {r["fname"]: r["label"] for r in J.latest_wins(m, "fname", "label", "pos").collect()}
    assert got == {"a": 4, "b": 3}


def test_contract_errors(spark):
    df = spark.createDataFrame([("4 x 2",)], "r string")
    with pytest.raises(Exception, match="not a size of two numbers"):
        df.select(P.parse_resolution("r")).collect()
    assert df.select(P.parse_resolution("r", strict=False).alias("p")).first()["p"] is None
    px = spark.createDataFrame([([1, 2, 3, 4], 4)], "x array<int>, c int")
    with pytest.raises(Exception, match="to_rgb"):
        px.select(V.to_rgb("x", "c", 1)).collect()
    sizes = spark.createDataFrame([(256, 256), (128, 128)], "out_w long, out_h long")
    with pytest.raises(ValueError, match="uniform"):
        validate_uniform(sizes)
    with pytest.raises(ValueError, match="square"):
        validate_uniform(spark.createDataFrame([(256, 128)], "out_w long, out_h long"))
    with pytest.raises(ValueError, match="power-of-two"):
        validate_uniform(spark.createDataFrame([(96, 96)], "out_w long, out_h long"))


def test_shape_assert(spark):
    df = spark.createDataFrame([([3, 16, 16], [3, None, 16]), ([3, 16], [3, None, 16])],
                               "s array<int>, r array<int>")
    assert [r[0] for r in df.select(V.shape_violation("s", "r")).collect()] == [False, True]


def test_softmax_and_normalise_are_stable(spark):
    df = spark.createDataFrame([([1000.0, 1000.0],), ([0.0, 0.0],)], "x array<double>")
    rows = df.select(V.softmax("x").alias("p"), V.l2_normalise("x").alias("u")).collect()
    assert rows[0]["p"] == [0.5, 0.5] and rows[1]["u"] == [0.0, 0.0]


def test_index_over_a_hundred_million_pads_without_truncation(spark):
    df = spark.range(123456789, 123456790).select(P.shard_name("id").alias("n"))
    assert df.first()["n"] == "12345/img123456789.png"


def test_all_null_labels_flag(spark):
    df = spark.createDataFrame([(None,), (None,)], "label long")
    counts, flag = J.label_coverage(df)
    assert flag.first()["all_labelled"] is False and counts.first()["n"] == 2


def test_uniform_draws_have_the_right_spread(spark):
    from pairlake.functions.rand import hash_normal, hash_uniform
    r = spark.range(0, 20000).select(hash_uniform("id", 3).alias("u"), hash_normal("id", 3).alias("z")).agg(
        F.avg("u").alias("mu"), F.min("u").alias("lo"), F.max("u").alias("hi"),
        F.avg("z").alias("mz"), F.stddev("z").alias("sz")).first()
    assert abs(r["mu"] - 0.5) < 0.01 and r["lo"] >= 0 and r["hi"] < 1
    assert abs(r["mz"]) < 0.03 and abs(r["sz"] - 1) < 0.03
