"""File round-trip and encoder queries.  Files are written from
the driver tables into a fresh folder under the session's shared
checkpoint folder and read back with the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pairlake.functions.util import round_array
from pairlake.operators.catalog import format_metric_log
from pairlake.operators.encode import encode_features, linear_model_factory
from pairlake.operators.pairing import infer_labels_from_dirs
from pairlake.operators.stats import rank_mean
from pairlake.plans import standins as T
from pairlake.plans.q_eval import EVALUATE_SQL, evaluate_frame
from pairlake.plans.q_stats import _A7, _metric_rows
from pairlake.plans.registry import register
from pairlake.session import checkpoint_dir, load_table
from pairlake.sinks.files import write_class_manifest, write_json_document
from pairlake.sources import files as SRC


def _scratch(spark, label: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/tables/{label}-{uuid.uuid4().hex[:12]}"


@register("encode_features", ids=("V10", "X1"), sql="""
SELECT vec_id, list_transform(range(8), lambda j: round(list_sum(list_transform(range(64),
  lambda i: embedding[i + 1]::DOUBLE * (((7 * i + 13 * j) % 17) - 8) / 8.0)), 6)) AS features
FROM embeddings
""")
def q_encode_features(spark, sf):
    e = load_table(spark, sf, "embeddings")
    out = encode_features(e, "embedding", linear_model_factory(64, 8), 64)
    return out.select("vec_id", round_array("features").alias("features"))


@register("captions_file", ids=("S8", "J2"), sql=f"""
WITH c AS ({T.CAPTIONS_SQL}) SELECT id, md5(max_by(caption, pos)) AS caption_md5 FROM c GROUP BY id
""")
def q_captions_file(spark, sf):
    path = _scratch(spark, "captions")
    caps = T.captions(spark, sf)
    caps.orderBy("pos").select("id", F.col("caption").alias("en")).write.json(path)
    back = SRC.read_captions(spark, path)
    return back.select("id", F.md5("caption").alias("caption_md5"))


DOCUMENT_PIECE = 1 << 12  # bytes of a range, so that the small documents of the driver tables have many


@register("captions_document", ids=("S8", "J2"), sql=f"""
WITH c AS ({T.CAPTIONS_SQL}) SELECT id, md5(max_by(caption, pos)) AS caption_md5 FROM c GROUP BY id
""")
def q_captions_document(spark, sf):
    """One JSON array, read in byte ranges."""
    path = f"{_scratch(spark, 'captions')}/captions.json"
    rows = T.captions(spark, sf).select("pos", F.to_json(F.struct("id", F.col("caption").alias("en"))).alias("record"))
    write_json_document(rows, path, "record", "pos")
    back = SRC.read_captions(spark, path, piece=DOCUMENT_PIECE)
    return back.select("id", F.md5("caption").alias("caption_md5"))


@register("manifest_document", ids=("S7",), sql=f"""
WITH f AS ({T.SOURCE_FILES_SQL}),
t AS (SELECT path, CASE WHEN instr(path, '/') > 0 THEN split_part(path, '/', 1) ELSE '' END AS top FROM f),
r AS (SELECT top, CAST(row_number() OVER (ORDER BY top) - 1 AS BIGINT) AS label FROM (SELECT DISTINCT top FROM t))
SELECT path AS fname, label FROM t JOIN r USING (top)
""")
def q_manifest_document(spark, sf):
    """One JSON object with a label list, read in byte ranges."""
    path = f"{_scratch(spark, 'manifest')}/dataset.json"
    labelled = infer_labels_from_dirs(T.source_files(spark, sf))
    pair = F.to_json(F.array(F.col("path"), F.col("label").cast("string")))
    write_json_document(labelled.select("path", pair.alias("record")), path, "record", "path", key="labels")
    return SRC.read_class_manifest(spark, path, piece=DOCUMENT_PIECE).select("fname", "label")


@register("manifest_file", ids=("S7", "K2", "A5"), sql=f"""
WITH f AS ({T.SOURCE_FILES_SQL}),
t AS (SELECT path, CASE WHEN instr(path, '/') > 0 THEN split_part(path, '/', 1) ELSE '' END AS top FROM f),
r AS (SELECT top, CAST(row_number() OVER (ORDER BY top) - 1 AS BIGINT) AS label FROM (SELECT DISTINCT top FROM t))
SELECT path AS fname, label FROM t JOIN r USING (top)
""")
def q_manifest_file(spark, sf):
    path = _scratch(spark, "manifest")
    labelled = infer_labels_from_dirs(T.source_files(spark, sf))
    flag = write_class_manifest(labelled, path, fname="path")
    if not flag:
        raise AssertionError("every file has a folder label, the manifest flag must be set")
    return SRC.read_class_manifest(spark, f"{path}/labels").select("fname", "label")


def _npy_rows(spark, sf):
    """Embeddings as (1, 4, 4, 4) float32 latent files named like the
    converter names them."""
    import numpy as np
    import pandas as pd

    from pairlake.sinks.blobs import npy_bytes
    e = T.split_single_file(load_table(spark, sf, "embeddings"))
    name = F.concat(F.lit("data_"), F.format_string("%06d", F.floor(F.col("vec_id") / 100).cast("long")),
                    F.lit("/img-latents-"), F.format_string("%08d", "vec_id"), F.lit(".npy"))

    def encode(it):
        for pdf in it:
            yield pd.DataFrame({"name": pdf["name"], "content": [
                npy_bytes(np.asarray(v, dtype=np.float32).reshape(1, 4, 4, 4)) for v in pdf["embedding"]]})
    return e.select(name.alias("name"), "embedding").mapInPandas(encode, "name string, content binary")


_NPY_NAME = "'data_' || printf('%06d', vec_id // 100) || '/img-latents-' || printf('%08d', vec_id) || '.npy'"


@register("npy_files", ids=("S5", "S1", "X2"), sql=f"""
SELECT {_NPY_NAME} AS path, CAST(384 AS BIGINT) AS length, [1, 4, 4, 4] AS shape,
  list_transform(embedding, lambda v: round(v, 6)) AS data FROM embeddings
""")
def q_npy_files(spark, sf):
    from pairlake.sinks.blobs import write_files
    folder = _scratch(spark, "npy")
    write_files(_npy_rows(spark, sf), folder, "name", "content").write.format("noop").mode("overwrite").save()
    listing = SRC.list_files(spark, folder).select("path", "length")
    tensors = SRC.read_npy(spark, folder)
    rel = F.regexp_extract("path", r"(data_[0-9]+/[^/]+)$", 1)
    t = tensors.select(rel.alias("path"), "shape", round_array("data").alias("data"))
    return listing.join(t, "path")


def _png_rows(spark, sf):
    import numpy as np
    import pandas as pd

    from pairlake.sinks.blobs import png_bytes
    d = T.split_single_file(load_table(spark, sf, "documents"))
    name = F.concat(F.col("source"), F.lit("/img"), F.format_string("%08d", "doc_id"), F.lit(".png"))

    def encode(it):
        for pdf in it:
            out = []
            for i in pdf["doc_id"]:
                px = (np.arange(48) + int(i) * 31) % 256
                out.append(png_bytes(px.reshape(4, 4, 3).astype(np.uint8)))
            yield pd.DataFrame({"name": pdf["name"], "content": out})
    return d.select(name.alias("name"), "doc_id").mapInPandas(encode, "name string, content binary")


_PNG_SQL = """SELECT source || '/img' || printf('%08d', doc_id) || '.png' AS member,
  CAST(4 AS INTEGER) AS width, CAST(4 AS INTEGER) AS height, CAST(3 AS INTEGER) AS n_channels,
  CAST(list_sum(list_transform(range(48), lambda i: (doc_id * 31 + i) % 256)) AS BIGINT) AS pixel_sum,
  [CAST(doc_id * 31 % 256 AS INTEGER), CAST((doc_id * 31 + 1) % 256 AS INTEGER), CAST((doc_id * 31 + 2) % 256 AS INTEGER)]
    AS first_rgb
FROM documents"""


@register("png_files", ids=("S2", "S4", "S1"), sql=_PNG_SQL)
def q_png_files(spark, sf):
    from pairlake.sinks.blobs import write_files
    folder = _scratch(spark, "png")
    write_files(_png_rows(spark, sf), folder, "name", "content").write.format("noop").mode("overwrite").save()
    listed = SRC.open_dataset(spark, folder.replace("file:", "", 1) if folder.startswith("file:") else folder)
    imgs = SRC.read_images(spark, folder)
    rel = F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)
    bytes_ = F.transform(F.sequence(F.lit(1), F.length("data")),
                         lambda k: F.conv(F.hex(F.substring("data", k, 1)), 16, 10).cast("int"))
    out = imgs.select(rel.alias("member"), "width", "height", "n_channels",
                      F.aggregate(bytes_, F.lit(0).cast("long"), lambda s, v: s + v).alias("pixel_sum"),
                      F.slice(bytes_, 1, 3).alias("first_rgb"))
    return out.join(listed.select(F.col("path").alias("member")), "member", "left_semi")


@register("zip_shards", ids=("S3", "X3", "S4"), sql="""
SELECT source || '/img' || printf('%08d', doc_id) || '.png' AS member, CAST(4 AS BIGINT) AS width,
  CAST(4 AS BIGINT) AS height FROM documents
""")
def q_zip_shards(spark, sf):
    from pairlake.sinks.blobs import write_archives
    from pairlake.sources.archives import read_zip_members
    folder = _scratch(spark, "zip")
    write_archives(_png_rows(spark, sf), folder, "zip", "name", "content").write.format("noop").mode(
        "overwrite").save()
    m = read_zip_members(spark, folder)
    be32 = lambda off: F.conv(F.hex(F.substring("content", off, 4)), 16, 10).cast("long")
    return m.select("member", be32(17).alias("width"), be32(21).alias("height"))


@register("zip_contents", ids=("S3", "X3"), sql="""
SELECT source || '/' || printf('%06d', doc_id) || '.png' AS member, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size,
  md5(coalesce(text, '')) AS content_md5 FROM documents
""")
def q_zip_contents(spark, sf):
    """Whole members of several archives, whose bytes are the documents' texts."""
    from pairlake.sinks.blobs import write_archives
    from pairlake.sources.archives import read_zip_members
    folder = _scratch(spark, "zip")
    name = F.concat(F.col("source"), F.lit("/"), F.format_string("%06d", "doc_id"), F.lit(".png"))
    rows = load_table(spark, sf, "documents").select(name.alias("name"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))
    write_archives(rows, folder, "zip", "name", "content").write.format("noop").mode("overwrite").save()
    return read_zip_members(spark, folder).select("member", "size", F.md5("content").alias("content_md5"))


@register("npz_shards", ids=("S6", "X3"), sql="""
SELECT vec_id, list_transform(embedding, lambda v: round(v, 6)) AS data FROM embeddings
""")
def q_npz_shards(spark, sf):
    from pairlake.sinks.blobs import write_archives
    from pairlake.sources.archives import read_npz_rows
    folder = _scratch(spark, "npz")
    e = T.split_single_file(load_table(spark, sf, "embeddings"))
    write_archives(e, folder, "npz", "vec_id", matrix="embedding", key="vec_id").write.format("noop").mode(
        "overwrite").save()
    rows = read_npz_rows(spark, folder, rows_per_partition=128)
    ids = read_npz_rows(spark, folder, name="ids").select("archive", "row_index",
                                                          F.col("data")[0].cast("long").alias("vec_id"))
    return rows.join(ids, ["archive", "row_index"]).select("vec_id", round_array("data").alias("data"))


@register("dataset_shards", ids=("K1", "W1", "F6"), sql=f"""
WITH f AS ({T.image_files_sql()})
SELECT CAST(row_number() OVER (ORDER BY path) - 1 AS BIGINT) AS "index", path,
  CAST((row_number() OVER (ORDER BY path) - 1) // 1000 AS BIGINT) AS shard,
  substr(printf('%08d', row_number() OVER (ORDER BY path) - 1), 1, 5) || '/img'
    || printf('%08d', row_number() OVER (ORDER BY path) - 1) || '.png' AS member
FROM f
""")
def q_dataset_shards(spark, sf):
    from pairlake.operators.index import global_index
    from pairlake.sinks.files import write_dataset
    dest = _scratch(spark, "dataset")
    files = global_index(T.image_files(spark, sf).select("path"), "path", "index")
    write_dataset(files, dest, "index")
    return spark.read.parquet(dest).select("index", "path", "shard", "member")


_COV_SQL = """WITH x AS (SELECT vec_id, CASE WHEN label < 5 THEN 'ref' ELSE 'sample' END AS set_id,
  unnest(range(len(embedding))) AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings)
SELECT a.set_id, CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(covar_samp(a.v, b.v), 9) AS cov
FROM x a JOIN x b ON a.vec_id = b.vec_id GROUP BY ALL"""


@register("distribution_stats", ids=("S11", "A2"), sql=_COV_SQL)
def q_distribution_stats(spark, sf):
    from pairlake.operators.linalg import feature_moments
    path = _scratch(spark, "fid-stats")
    e = load_table(spark, sf, "embeddings")
    ref, smp = e.filter("label < 5"), e.filter("label >= 5")
    feature_moments(ref, "embedding").withColumn("set_id", F.lit("ref")).write.parquet(path)
    out = None
    for set_id, acts in (("ref", None), ("sample", smp)):  # the sample set is not stored: computed
        m = SRC.read_distribution_stats(spark, path, set_id, acts)
        m = m.select(F.lit(set_id).alias("set_id"), "i", F.posexplode("cov").alias("j", "cov"))
        m = m.select("set_id", "i", F.col("j").cast("int").alias("j"), F.round("cov", 9).alias("cov"))
        out = m if out is None else out.unionByName(m)
    return out


@register("latent_stats_cache", ids=("S12", "K3", "A1"), sql="""
WITH x AS (SELECT unnest(range(len(embedding))) AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings)
SELECT CAST(i // 16 AS INTEGER) AS channel, count(*) AS n, round(avg(v), 6) AS mean,
       round(stddev_samp(v), 6) AS std
FROM x GROUP BY 1
""")
def q_latent_stats_cache(spark, sf):
    from pairlake.operators.channels import channel_stats
    from pairlake.sinks.blobs import write_files
    folder = _scratch(spark, "latents")
    write_files(_npy_rows(spark, sf), folder, "name", "content").write.format("noop").mode("overwrite").save()
    files = SRC.list_files(spark, folder)
    cache = _scratch(spark, "latent-stats")

    def compute():
        return channel_stats(SRC.read_npy(spark, folder), "data", 4, key="path")
    SRC.read_latent_stats(spark, cache, files, compute)  # miss: computes and appends
    hit = SRC.read_latent_stats(spark, cache, files, compute)  # hit: served from the cache
    return hit.select("channel", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@register("concat_batches", ids=("U2",), sql="""
SELECT vec_id, label FROM embeddings
""")
def q_concat_batches(spark, sf):
    from pairlake.operators.sets import concat_batches
    e = load_table(spark, sf, "embeddings")
    return concat_batches(e.filter("label < 5").select("vec_id", "label"),
                          e.filter("label >= 5").select("vec_id", "label"), order="vec_id")


@register("eval_report", ids=("K5", "S10", "V9"), sql=f"""
SELECT *, true AS cfg_cond, CAST(1 AS INTEGER) AS stored_runs FROM ({EVALUATE_SQL})
""")
def q_eval_report(spark, sf):
    from pairlake.operators.catalog import format_eval_report
    from pairlake.sinks.files import append_eval_report
    metrics = evaluate_frame(spark, sf).withColumn("run_id", F.lit("halves"))
    table = _scratch(spark, "reports-table")
    append_eval_report(metrics, table, "halves", {"k": 3, "split": 100})
    root = _scratch(spark, "reports-text")
    lines = format_eval_report(metrics).orderBy("line_no").select("line")
    lines.coalesce(1).write.text(f"{root}/halves-cfg_cond_true.txt")
    parsed = SRC.read_eval_reports(spark, root)
    stored_runs = spark.read.parquet(table).count()
    return parsed.drop("path").withColumn("stored_runs", F.lit(stored_runs))


@register("metric_log_file", ids=("S9", "F29", "K6"), sql=f"""
WITH {_A7} SELECT step, metric, round(value, 6) AS value FROM a7
""")
def q_metric_log_file(spark, sf):
    path = _scratch(spark, "train-log")
    lines = format_metric_log(rank_mean(_metric_rows(spark, sf)))
    lines.select("line").write.text(path)
    back = SRC.read_metric_log(spark, path)
    return back.select("step", "metric", F.round("value", 6).alias("value"))
