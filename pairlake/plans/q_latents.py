"""Latent-tensor queries: embeddings read as C=4, H=4, W=4 latents."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlake.functions.util import round_array
from pairlake.operators.channels import channel_stats, denormalise, normalise, stats_arrays
from pairlake.plans.registry import register
from pairlake.session import load_table

LATENT_C = 4


def _stats_rounded(df):
    return df.select("channel", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@register("channel_stats", ids=("A1",), sql="""
WITH x AS (SELECT unnest(range(len(embedding))) AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings)
SELECT CAST(i // 16 AS INTEGER) AS channel, count(*) AS n, round(avg(v), 6) AS mean,
       round(stddev_samp(v), 6) AS std
FROM x GROUP BY 1
""")
def q_channel_stats(spark, sf):
    emb = load_table(spark, sf, "embeddings")
    return _stats_rounded(channel_stats(emb, "embedding", LATENT_C))


@register("channel_stats_sampled", ids=("A1", "T3", "B1"), sql="""
WITH s AS (
  SELECT * FROM embeddings
  ORDER BY ('0x' || substr(md5(concat_ws('|', CAST(vec_id AS VARCHAR), '7', '0')), 1, 8))::BIGINT, vec_id
  LIMIT 300),
x AS (SELECT unnest(range(len(embedding))) AS i, unnest(embedding::DOUBLE[]) AS v FROM s)
SELECT CAST(i // 16 AS INTEGER) AS channel, count(*) AS n, round(avg(v), 6) AS mean,
       round(stddev_samp(v), 6) AS std
FROM x GROUP BY 1
""")
def q_channel_stats_sampled(spark, sf):
    emb = load_table(spark, sf, "embeddings")
    return _stats_rounded(channel_stats(emb, "embedding", LATENT_C, key="vec_id", max_n=300, seed=7))


_NORM_SQL = """
WITH x AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding::DOUBLE[]) AS v
           FROM embeddings),
s AS (SELECT i // 16 AS c, avg(v) AS m, stddev_samp(v) AS sd FROM x GROUP BY 1)
SELECT vec_id, list(round({expr}, 6) ORDER BY i) AS z
FROM x JOIN s ON x.i // 16 = s.c GROUP BY vec_id
"""


@register("normalise", ids=("J6",), sql=_NORM_SQL.format(expr="(v - m) / sd"))
def q_normalise(spark, sf):
    emb = load_table(spark, sf, "embeddings")
    mean, std = stats_arrays(channel_stats(emb, "embedding", LATENT_C))
    return emb.select("vec_id", round_array(normalise("embedding", mean, std)).alias("z"))


@register("denormalise", ids=("J6",), sql=_NORM_SQL.format(expr="v * sd + m"))
def q_denormalise(spark, sf):
    emb = load_table(spark, sf, "embeddings")
    mean, std = stats_arrays(channel_stats(emb, "embedding", LATENT_C))
    return emb.select("vec_id", round_array(denormalise("embedding", mean, std)).alias("z"))


def flagship_normalised(spark, sf):
    """entry(): per-channel statistics then normalised latents."""
    return q_normalise(spark, sf)
