"""Exact top-k by KD-trees (op 4) against all pairs."""

import math

import numpy as np
import pytest

from pairlake.llm import knn


def brute(rows, k):
    vectors = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
               if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in {i for i, _ in vectors if i % 50 == 0}:
        near = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for p, x in vectors if p == q
                      for i, y in vectors if i != q and len(y) == len(x))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near[:k])]
    return sorted(out)


@pytest.mark.parametrize(("n", "dim", "most", "shard_rows"), [(400, 8, 3, 60), (300, 1, 2, 1000), (900, 16, 4, 100)])
def test_equals_all_pairs_with_ties_and_copies(spark, n, dim, most, shard_rows):
    x = np.random.default_rng(n).integers(-most, most, (n, dim))
    x[:n // 3] = x[0]  # a third of all rows are one vector
    rows = [(i, [c / 256 + 0.001 for c in v]) for i, v in enumerate(x.tolist())]
    rows += [(None, [0.0] * dim), (5000, None), (5050, [None] + [0.0] * (dim - 1)), (5100, [math.nan] * dim),
             (5150, [math.inf] * dim), (6000, [0.01] * (dim + 1)), (6050, [0.02] * (dim + 1)), rows[0], rows[50],
             (100, [9.0] * dim)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, shard string")
    got = knn.top_k(df, df.filter("vec_id % 50 = 0"), 5, shard_rows=shard_rows).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 5)


def test_repeated_ids_equal_sql(spark):
    import duckdb

    from pairlake.llm import queries
    rows = [(50, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.5, 0.0]), (2, [0.25, 0.0]), (50, [0.0, 9.0]), (100, [1.0, 1.0]),
            (3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    want = sorted(con.execute(queries.SQL["op4_kd_tree"]).fetchall())
    assert sorted(tuple(r) for r in knn.top_k(df, df.filter("vec_id % 50 = 0"), 5).collect()) == want == brute(rows, 5)


def test_numbers_beyond_float_precision(spark):
    rows = [(0, [3.0e6, 1.0]), (1, [3.0e6, 1.0]), (2, [3.0e6, 2.0]), (3, [-3.0e6, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in knn.top_k(df, df.filter("vec_id = 0"), 2).collect()) == brute(rows, 2)


def test_empty_and_lonely(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert knn.top_k(df, df).collect() == []
    one = spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<float>")
    assert knn.top_k(one, one).collect() == []
