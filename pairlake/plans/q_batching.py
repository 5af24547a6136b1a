"""Index, randomness, batching and sample-plan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlake.functions.rand import hash_normal, hash_uniform, sql_permute
from pairlake.functions.vectors import pad_truncate, row_mean, row_sum, was_truncated
from pairlake.operators import batching as B
from pairlake.operators.index import global_index
from pairlake.operators.pairing import missing_samples, null_condition
from pairlake.operators.sampling import sample_exact
from pairlake.plans import sqlfrag as S
from pairlake.plans import standins as T
from pairlake.plans.registry import register
from pairlake.session import load_table


def _hu(k, seed, i):
    return S.hash_uniform(k, seed, i)


@register("hash_draws", ids=("B1",), sql=f"""
SELECT event_id, round({_hu('event_id', 42, "'0'")}, 9) AS u0, round({_hu('event_id', 42, "'1'")}, 9) AS u1,
  round(sqrt(-2 * ln(1 - {_hu('event_id', 42, "'0'")})) * cos(2 * pi() * {_hu('event_id', 42, "'1'")}), 9) AS z0
FROM events
""")
def q_hash_draws(spark, sf):
    ev = load_table(spark, sf, "events")
    return ev.select("event_id", F.round(hash_uniform("event_id", 42, 0), 9).alias("u0"),
                     F.round(hash_uniform("event_id", 42, 1), 9).alias("u1"),
                     F.round(hash_normal("event_id", 42, 0), 9).alias("z0"))


@register("sample_exact", ids=("T3", "B1"), sql=f"""
SELECT doc_id, lang FROM documents ORDER BY {_hu('doc_id', 3, "'0'")}, doc_id LIMIT 100
""")
def q_sample_exact(spark, sf):
    return sample_exact(load_table(spark, sf, "documents").select("doc_id", "lang"), 100, "doc_id", seed=3)


_EPOCH_SQL = f"""eo AS (
  SELECT doc_id, CAST(epoch AS INTEGER) AS epoch,
         CAST(row_number() OVER (PARTITION BY epoch ORDER BY {_hu('doc_id', 5, 'epoch')}, doc_id) - 1 AS BIGINT)
           AS position
  FROM documents, range(2) t(epoch)),
eg AS (SELECT *, position + epoch * (SELECT count(*) FROM documents) AS global_position FROM eo)"""


def _epochs(spark, sf, epochs=2):
    d = load_table(spark, sf, "documents").select("doc_id")
    return B.epoch_order(d, "doc_id", epochs=epochs, seed=5)


@register("epoch_order", ids=("B2", "W1"), sql=f"""
WITH {_EPOCH_SQL} SELECT doc_id, epoch, position, global_position FROM eg
""")
def q_epoch_order(spark, sf):
    return _epochs(spark, sf).select("doc_id", "epoch", "position", "global_position")


@register("rank_shard", ids=("B3",), sql=f"""
WITH {_EPOCH_SQL}
SELECT doc_id, epoch, CAST((global_position - 5 - 2) // 3 AS BIGINT) AS step FROM eg
WHERE global_position - 5 >= 2 AND (global_position - 5 - 2) % 3 = 0
""")
def q_rank_shard(spark, sf):
    return B.rank_shard(_epochs(spark, sf), "global_position", rank=2, world=3, start_idx=5).select(
        "doc_id", "epoch", "step")


_PERMUTED_SQL = f"""d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents),
pe AS (SELECT doc_id, epoch, n, {sql_permute('i', 'n', 9, 'epoch')} AS position FROM d, (SELECT unnest([0, 1]) AS epoch))"""


def _permuted(spark, sf):
    d = load_table(spark, sf, "documents").select("doc_id")
    return B.permuted_epochs(global_index(d, "doc_id", "i"), "i", d.count(), epochs=2, seed=9)


@register("epoch_permutation", ids=("B2", "B3"), sql=f"""
WITH {_PERMUTED_SQL}
SELECT doc_id, CAST(epoch AS INTEGER) AS epoch, position, CAST((epoch * n + position - 3) // 4 AS BIGINT) AS step
FROM pe WHERE epoch * n + position >= 3 AND (epoch * n + position - 3) % 4 = 0
""")
def q_epoch_permutation(spark, sf):
    """Rank 3 of 4 over two epochs, whose order needs no sort."""
    return B.rank_shard(_permuted(spark, sf), "global_position", rank=3, world=4).select("doc_id", "epoch", "position", "step")


_BATCH_SQL = f"""{_EPOCH_SQL},
b AS (SELECT doc_id, position, CAST(position // 64 AS BIGINT) AS batch, CAST(position % 64 AS INTEGER) AS pos_in_batch,
      CAST(position % 8 AS INTEGER) AS worker
      FROM eg WHERE epoch = 0 AND position < ((SELECT count(*) FROM documents) // 64) * 64)"""


def _batches(spark, sf):
    e = _epochs(spark, sf, epochs=1)
    n = load_table(spark, sf, "documents").count()
    return B.assign_workers(B.batch_rows(e, "position", 64, drop_last=True, n=n), "position", 8)


@register("batch_rows", ids=("W6", "B4"), sql=f"""
WITH {_BATCH_SQL} SELECT doc_id, batch, pos_in_batch, worker FROM b
""")
def q_batch_rows(spark, sf):
    return _batches(spark, sf).select("doc_id", "batch", "pos_in_batch", "worker")


@register("roll_in_batch", ids=("W2", "B11"), sql=f"""
WITH {_BATCH_SQL}
SELECT doc_id, batch, COALESCE(lag(doc_id) OVER (PARTITION BY batch ORDER BY pos_in_batch),
                               last(doc_id) OVER (PARTITION BY batch ORDER BY pos_in_batch
                                                  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS rolled,
       {_hu('batch', 9, "'0'")} < 0.3 AS batch_drop
FROM b
""")
def q_roll(spark, sf):
    b = B.roll(_batches(spark, sf), "batch", "pos_in_batch", "doc_id")
    return b.select("doc_id", "batch", "rolled", B.batch_flag("batch", 0.3, seed=9).alias("batch_drop"))


@register("class_dropout", ids=("B5", "B7", "B12", "J9"), sql=f"""
SELECT vec_id, label,
  CASE WHEN {_hu('vec_id', 11, "'0'")} < 0.1 THEN 10 ELSE label END AS dropped,
  CASE WHEN vec_id % 9 = 0 THEN 10 ELSE label END AS forced,
  CAST(vec_id % 10 AS BIGINT) AS balanced,
  {_hu('vec_id', 12, "'0'")} < 0.5 AS flip
FROM embeddings
""")
def q_class_dropout(spark, sf):
    e = load_table(spark, sf, "embeddings")
    e = e.withColumn("_force", (F.col("vec_id") % 9 == 0).cast("int"))
    out = e.select("vec_id", "label",
                   B.label_dropout("label", "vec_id", 0.1, 10, seed=11).alias("dropped"),
                   "_force", B.balanced_labels("vec_id", 10).alias("balanced"),
                   B.flip_flag("vec_id", 0.5, seed=12).alias("flip"))
    out = out.withColumn("forced", F.col("label"))
    out = null_condition(out, F.col("_force") == 1, "forced", 10)
    return out.select("vec_id", "label", "dropped", "forced", "balanced", "flip")


@register("caption_dropout", ids=("B6", "J9"), sql=f"""
SELECT vec_id, {_hu('vec_id', 13, "'0'")} < 0.1 AS dropped,
  CASE WHEN {_hu('vec_id', 13, "'0'")} < 0.1 THEN 0.0 ELSE round(list_sum(embedding::DOUBLE[]), 6) END AS total
FROM embeddings
""")
def q_caption_dropout(spark, sf):
    e = load_table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("m"))
    zeros = F.array_repeat(F.lit(0.0), 64)
    out = B.caption_dropout(e, "vec_id", "m", zeros, p=0.1, seed=13)
    return out.select("vec_id", (hash_uniform("vec_id", 13) < 0.1).alias("dropped"),
                      F.round(row_sum("m"), 6).alias("total"))


@register("row_reductions", ids=("A11",), sql="""
SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 6) AS row_sum,
       round(list_sum(embedding::DOUBLE[]) / len(embedding), 6) AS row_mean FROM embeddings
""")
def q_row_reductions(spark, sf):
    e = load_table(spark, sf, "embeddings")
    return e.select("vec_id", F.round(row_sum("embedding"), 6).alias("row_sum"),
                    F.round(row_mean("embedding"), 6).alias("row_mean"))


_TOK_SQL = f"""t AS (SELECT doc_id, string_split(text, ' ') AS tok FROM documents),
k AS (SELECT doc_id, tok, len(tok) - 4 AS rest,
      greatest(1, CAST(floor((len(tok) - 4) * 0.5) AS INTEGER)) AS keep FROM t),
d AS (SELECT doc_id, tok, rest, keep,
      CASE WHEN rest <= 1 OR keep >= rest THEN NULL ELSE
        list_transform(list_sort(list_transform(range(rest),
          lambda i: ('0x' || substr(md5(concat_ws('|', CAST(doc_id AS VARCHAR), '17', CAST(i // 4 AS VARCHAR))),
                                    (i % 4) * 8 + 1, 8))::BIGINT * 2147483648 + i))[1:keep],
          lambda s: CAST(s % 2147483648 AS INTEGER)) END AS ids
      FROM k),
kk AS (SELECT doc_id, tok, ids, CASE WHEN ids IS NULL THEN tok
       ELSE list_concat(tok[1:4], list_transform(ids, lambda i: tok[i + 5])) END AS kept FROM d)"""


@register("drop_tokens", ids=("B9", "B10", "F26"), sql=f"""
WITH {_TOK_SQL}
SELECT doc_id, CAST(len(tok) AS INTEGER) AS n_tokens, len(tok) > 77 AS truncated,
  md5(array_to_string(list_concat(tok, list_transform(range(77), lambda i: '<pad>'))[1:77], ' ')) AS padded_md5,
  CAST(len(kept) AS INTEGER) AS n_kept, md5(array_to_string(kept, ' ')) AS kept_md5,
  md5(array_to_string(CASE WHEN ids IS NULL THEN kept ELSE list_concat(kept[1:4],
      list_transform(range(len(tok) - 4), lambda p: COALESCE(
        kept[list_position(ids, CAST(p AS INTEGER)) + 4], '<mask>'))) END, ' ')) AS restored_md5
FROM kk
""")
def q_drop_tokens(spark, sf):
    d = T.split_single_file(load_table(spark, sf, "documents")).select("doc_id", F.split("text", " ").alias("tok"))
    dr = B.drop_tokens(d, "tok", "doc_id", head=4, ratio=0.5, seed=17)
    full = F.size("tok") - 4
    padded = pad_truncate("tok", 77, "<pad>")
    restored = B.pad_with_mask("kept", "ids", 4, full, "<mask>")
    return dr.select("doc_id", F.size("tok").alias("n_tokens"), was_truncated("tok", 77).alias("truncated"),
                     F.md5(F.array_join(padded, " ")).alias("padded_md5"),
                     F.size("kept").alias("n_kept"), F.md5(F.array_join("kept", " ")).alias("kept_md5"),
                     F.md5(F.array_join(restored, " ")).alias("restored_md5"))


_PLAN_N = "(SELECT max(o_orderkey) + 3 FROM orders)"


def _plan(spark, sf):
    """A plan for as many samples as the highest order key and three more."""
    n = load_table(spark, sf, "orders").agg(F.max("o_orderkey")).first()[0] + 3
    return B.sample_plan(spark, n, per_worker=10, world=8), n


def _existing(spark, sf):
    """Samples already on disk: one for each order, its key being the index."""
    return load_table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_index"))


_PLAN_SQL = f"""p AS (SELECT range AS sample_index FROM range(CAST(ceil({_PLAN_N} / 80.0) * 80 AS BIGINT))),
ex AS (SELECT o_orderkey AS sample_index FROM orders)"""


@register("sample_plan", ids=("B8", "F28", "B7"), sql=f"""
WITH {_PLAN_SQL}
SELECT sample_index, CAST(sample_index // 80 AS BIGINT) AS iteration, CAST(sample_index % 80 % 8 AS INTEGER) AS rank,
       CAST(sample_index % 80 // 8 AS INTEGER) AS slot, CAST(sample_index % 10 AS BIGINT) AS label,
       CAST({_PLAN_N} + 79 - ({_PLAN_N} + 79) % 80 AS BIGINT) AS total, ex.sample_index IS NOT NULL AS done
FROM p LEFT JOIN ex USING (sample_index)
""")
def q_sample_plan(spark, sf):
    plan, n = _plan(spark, sf)
    done = _existing(spark, sf).withColumn("done", F.lit(True))
    return plan.join(done, "sample_index", "left").select(
        "sample_index", "iteration", "rank", "slot", B.balanced_labels("sample_index", 10).alias("label"),
        B.ceil_multiple(F.lit(n), 80).alias("total"), F.coalesce("done", F.lit(False)).alias("done"))


@register("missing_samples", ids=("J7",), sql=f"""
WITH {_PLAN_SQL}
SELECT sample_index FROM p WHERE sample_index < {_PLAN_N} AND sample_index NOT IN (SELECT sample_index FROM ex)
""")
def q_missing_samples(spark, sf):
    plan, n = _plan(spark, sf)
    return missing_samples(plan.filter(F.col("sample_index") < n), _existing(spark, sf)).select("sample_index")


# line items are samples that one line each was planned for: the second and
# later lines of an order, and orders beyond the plan, are extra
@register("sample_diff", ids=("U3",), sql="""
WITH p AS (SELECT o_orderkey AS sample_index FROM orders),
ex AS (SELECT l_orderkey AS sample_index FROM lineitem)
SELECT 'missing' AS kind, sample_index FROM (SELECT sample_index FROM p EXCEPT ALL SELECT sample_index FROM ex)
UNION ALL
SELECT 'extra', sample_index FROM (SELECT sample_index FROM ex EXCEPT ALL SELECT sample_index FROM p)
""")
def q_sample_diff(spark, sf):
    from pairlake.operators.sets import sample_diff
    lines = load_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sample_index"))
    return sample_diff(_existing(spark, sf), lines)


@register("sample_completion", ids=("J7",), sql=f"""
WITH {_PLAN_SQL}
SELECT count(sample_index) AS n_existing, count(sample_index) >= {_PLAN_N} AS is_complete FROM ex
""")
def q_sample_completion(spark, sf):
    from pairlake.operators.pairing import sample_completion
    _, n = _plan(spark, sf)
    return sample_completion(_existing(spark, sf), n)


# the embeddings are the samples: the last three are beyond the pack
@register("pack_samples", ids=("K4",), sql="""
SELECT vec_id AS sample_index, list_transform(embedding::DOUBLE[], lambda v: round(v, 6)) AS sample
FROM embeddings WHERE vec_id < (SELECT count(*) - 3 FROM embeddings)
""")
def q_pack_samples(spark, sf):
    from pairlake.plans.q_derived import round_array
    from pairlake.plans.q_files import _scratch
    from pairlake.sinks.files import pack_samples
    e = load_table(spark, sf, "embeddings")
    s = e.select(F.col("vec_id").alias("sample_index"), F.array(F.size("embedding")).alias("shape"),
                 round_array(F.col("embedding").cast("array<double>")).alias("sample"))
    path = _scratch(spark, "samples")
    pack_samples(s, e.count() - 3, path)
    return spark.read.parquet(path).select("sample_index", "sample")
