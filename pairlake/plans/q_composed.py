"""Queries that run several operators as one plan: converting a labelled image
set, and the input of a training step."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlake.functions.paths import shard_name
from pairlake.functions.vectors import arr_sum
from pairlake.operators import batching as B
from pairlake.operators import pairing as J
from pairlake.operators.channels import channel_stats, normalise, stats_arrays
from pairlake.operators.geometry import crop_plan, drop_failed, size_ok
from pairlake.operators.index import global_index
from pairlake.plans import sqlfrag as S
from pairlake.plans import standins as T
from pairlake.plans.registry import register
from pairlake.session import load_table
from pairlake.sinks.files import SHARD_ROWS, manifest_flag

WIDTH, HEIGHT = 64, 32
BATCH, WORLD, RANK = 16, 4, 1


@register("convert_dataset", ids=("J1", "S7", "T1", "W1", "F9", "P3", "P4", "F6", "K1", "K2"), sql=f"""
WITH f AS ({T.image_files_sql()}),
m AS ({T.CLASS_MANIFEST_SQL}),
d AS (SELECT fname, max_by(label, pos) AS label FROM m GROUP BY fname),
s AS (SELECT f.path, d.label, 1 + t.n_chars % 4000 AS w, 1 + (f.doc_id * 37) % 3000 AS h,
        row_number() OVER (ORDER BY f.path) - 1 AS idx
      FROM f JOIN documents t USING (doc_id) LEFT JOIN d ON f.path = d.fname),
k AS (SELECT *, CAST(round_even({WIDTH}.0 * h / w, 0) AS BIGINT) AS ch FROM s
      WHERE w >= {WIDTH} AND round_even({WIDTH}.0 * h / w, 0) >= {HEIGHT})
SELECT path, CAST(idx AS BIGINT) AS "index", CAST(idx // {SHARD_ROWS} AS BIGINT) AS shard,
  printf('%05d/img%08d.png', idx // {SHARD_ROWS}, idx) AS member,
  CASE WHEN (SELECT bool_and(label IS NOT NULL) FROM k) THEN label END AS label,
  CAST(w AS BIGINT) AS crop_w, ch AS crop_h, CAST((h - ch) // 2 - CASE WHEN (h - ch) % 2 < 0 THEN 1 ELSE 0 END AS BIGINT)
    AS crop_y, CAST({WIDTH} AS BIGINT) AS out_w
FROM k
""")
def q_convert_dataset(spark, sf):
    """Open, label, index, plan the crop, drop what it rejects (survivors keep
    their index), name the members; labels only if every survivor has one."""
    manifest = J.latest_wins(T.class_manifest(spark, sf), "fname", "label", "pos")
    files = J.attach_class_labels(T.image_files(spark, sf), manifest)
    sizes = load_table(spark, sf, "documents").select(
        "doc_id", (F.col("n_chars") % 4000 + 1).alias("w"), ((F.col("doc_id") * 37) % 3000 + 1).alias("h"))
    indexed = global_index(files.join(sizes, "doc_id").select("path", "label", "w", "h"), "path", "index")
    planned = indexed.withColumn("plan", crop_plan("w", "h", "center-crop-wide", WIDTH, HEIGHT))
    kept, _ = drop_failed(planned.withColumn("ok", size_ok("plan")).withColumn("error", F.lit(None).cast("string")))
    label = F.col("label") if manifest_flag(kept) else F.lit(None).cast(kept.schema["label"].dataType)
    return kept.select("path", "index", F.floor(F.col("index") / SHARD_ROWS).cast("long").alias("shard"),
                       shard_name("index", "image").alias("member"), label.alias("label"), "plan.crop_w", "plan.crop_h",
                       "plan.crop_y", "plan.out_w")


_Z_SQL = """x AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings),
st AS (SELECT i // 16 AS c, avg(v) AS m, stddev_samp(v) AS sd FROM x GROUP BY 1),
z AS (SELECT vec_id, sum((v - m) / sd) AS z_sum FROM x JOIN st ON x.i // 16 = st.c GROUP BY vec_id)"""


@register("training_input", ids=("J2", "A1", "J6", "B2", "W6", "B3", "B5"), sql=f"""
WITH {_Z_SQL},
o AS (SELECT vec_id, row_number() OVER (ORDER BY {S.hash_uniform('vec_id', 21, "'0'")}, vec_id) - 1 AS g FROM embeddings)
SELECT o.vec_id, CAST(g // {BATCH} AS BIGINT) AS batch, CAST(g % {BATCH} AS INTEGER) AS pos_in_batch,
  CAST((g - {RANK}) // {WORLD} AS BIGINT) AS step,
  CASE WHEN {S.hash_uniform('o.vec_id', 22, "'0'")} < 0.1 THEN 10 ELSE e.label END AS label,
  md5(d.text) AS caption_md5, round(z_sum, 6) AS z_sum
FROM o JOIN embeddings e USING (vec_id) JOIN z USING (vec_id) LEFT JOIN documents d ON d.doc_id = o.vec_id
WHERE g < ((SELECT count(*) FROM embeddings) // {BATCH}) * {BATCH} AND g >= {RANK} AND (g - {RANK}) % {WORLD} = 0
""")
def q_training_input(spark, sf):
    """One rank's share of an epoch: shuffled batches of normalised latents with
    their captions and class labels after dropout."""
    e = load_table(spark, sf, "embeddings")
    mean, std = stats_arrays(channel_stats(e, "embedding", 4))
    order = B.epoch_order(e.select("vec_id"), "vec_id", epochs=1, seed=21)
    mine = B.rank_shard(B.batch_rows(order, "position", BATCH, n=e.count()), "position", RANK, WORLD)
    captions = load_table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.md5("text").alias("caption_md5"))
    rows = mine.join(e, "vec_id").join(captions, "vec_id", "left")
    return rows.select("vec_id", "batch", "pos_in_batch", "step",
                       B.label_dropout("label", "vec_id", 0.1, 10, seed=22).alias("label"), "caption_md5",
                       F.round(arr_sum(normalise("embedding", mean, std)), 6).alias("z_sum"))
