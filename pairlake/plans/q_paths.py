"""Path, listing, labelling and pairing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlake.functions import paths as P
from pairlake.functions.timefmt import format_time, format_time_brief
from pairlake.operators import pairing as J
from pairlake.operators.index import first_n, global_index
from pairlake.plans import sqlfrag as S
from pairlake.plans import standins as T
from pairlake.plans.registry import register
from pairlake.session import load_table

_p = "path"

register_paths_sql = f"""
WITH f AS ({T.ODD_NAMES_SQL})
SELECT doc_id, path,
  {S.ext(_p)} AS ext,
  {S.stem(_p)} AS stem,
  {S.norm(_p)} AS norm,
  {S.top_dir(_p)} AS top,
  {S.extract_id(_p)} AS id,
  {S.last_dot_ext(_p)} AS dot_ext,
  lower({S.ext(_p)}) IN {S.supported_exts()} AS supported,
  ('.' || {S.last_dot_ext(_p)}) IN {S.image_exts()} AS is_image,
  printf('%08d', doc_id * 1000003) AS padded,
  substr(printf('%08d', doc_id), 1, 5) || '/img' || printf('%08d', doc_id) || '.png' AS shard_image,
  COALESCE(NULLIF({S.stem(_p)}, '') || '.npy',
           substr(printf('%08d', doc_id), 1, 5) || '/img-latents-' || printf('%08d', doc_id) || '.npy') AS latent
FROM f
"""


@register("path_functions", ids=("F1", "F2", "F3", "F4", "F5", "F6", "F7", "P1", "P2"), sql=register_paths_sql)
def q_path_functions(spark, sf):
    f = T.odd_names(spark, sf)
    return f.select(
        "doc_id", "path",
        P.path_ext("path").alias("ext"),
        P.path_stem("path").alias("stem"),
        P.norm_path("path").alias("norm"),
        P.top_dir("path").alias("top"),
        P.extract_id("path").alias("id"),
        P.last_dot_ext("path").alias("dot_ext"),
        P.is_supported_file("path").alias("supported"),
        P.is_image_file("path").alias("is_image"),
        P.zero_pad(F.col("doc_id") * 1000003, 8).alias("padded"),
        P.shard_name("doc_id", "image").alias("shard_image"),
        P.latent_name(P.path_stem("path"), "doc_id").alias("latent"),
    )


@register("filter_supported", ids=("P1",), sql=f"""
WITH f AS ({T.ODD_NAMES_SQL}) SELECT doc_id, path FROM f WHERE lower({S.ext(_p)}) IN {S.supported_exts()}
""")
def q_filter_supported(spark, sf):
    return T.odd_names(spark, sf).filter(P.is_supported_file("path"))


@register("filter_image_ext", ids=("P2",), sql=f"""
WITH f AS ({T.ODD_NAMES_SQL}) SELECT doc_id, path FROM f WHERE ('.' || {S.last_dot_ext(_p)}) IN {S.image_exts()}
""")
def q_filter_image_ext(spark, sf):
    return T.odd_names(spark, sf).filter(P.is_image_file("path"))


@register("sorted_index", ids=("T1", "W1"), sql=f"""
WITH f AS ({T.FEATURE_FILES_SQL})
SELECT path, CAST(row_number() OVER (ORDER BY path) - 1 AS BIGINT) AS "index" FROM f
""")
def q_sorted_index(spark, sf):
    return global_index(T.feature_files(spark, sf).select("path"), "path", "index")


@register("limit_images", ids=("T2", "T1"), sql=f"""
WITH f AS ({T.image_files_sql()}) SELECT path FROM f ORDER BY path LIMIT 37
""")
def q_limit_images(spark, sf):
    return first_n(T.image_files(spark, sf).select("path"), "path", 37)


@register("attach_class_labels", ids=("J1", "S7"), sql=f"""
WITH f AS ({T.image_files_sql()}),
m AS ({T.CLASS_MANIFEST_SQL}),
d AS (SELECT fname, max_by(label, pos) AS label FROM m GROUP BY fname)
SELECT f.path, d.label FROM f LEFT JOIN d ON replace(f.path, '\\', '/') = d.fname
""")
def q_attach_class_labels(spark, sf):
    m = J.latest_wins(T.class_manifest(spark, sf), "fname", "label", "pos")
    return J.attach_class_labels(T.image_files(spark, sf), m).select("path", "label")


_LABELLED = f"""f AS ({T.image_files_sql()}),
m AS ({T.CLASS_MANIFEST_SQL}),
d AS (SELECT fname, max_by(label, pos) AS label FROM m GROUP BY fname),
l AS (SELECT f.path, d.label FROM f LEFT JOIN d ON f.path = d.fname)"""


@register("label_coverage", ids=("A6",), sql=f"""
WITH {_LABELLED} SELECT label, count(*) AS n FROM l GROUP BY label
""")
def q_label_coverage(spark, sf):
    m = J.latest_wins(T.class_manifest(spark, sf), "fname", "label", "pos")
    counts, _ = J.label_coverage(J.attach_class_labels(T.image_files(spark, sf), m))
    return counts


@register("manifest_flag", ids=("K2", "A6"), sql=f"""
WITH {_LABELLED} SELECT COALESCE(bool_and(label IS NOT NULL), true) AS all_labelled FROM l
""")
def q_manifest_flag(spark, sf):
    m = J.latest_wins(T.class_manifest(spark, sf), "fname", "label", "pos")
    _, flag = J.label_coverage(J.attach_class_labels(T.image_files(spark, sf), m))
    return flag


@register("attach_captions", ids=("J2", "S8", "F4"), sql=f"""
WITH f AS ({T.FEATURE_FILES_SQL}),
c AS ({T.CAPTIONS_SQL}),
d AS (SELECT id, max_by(caption, pos) AS caption FROM c GROUP BY id)
SELECT f.path, {S.extract_id('f.path')} AS id, md5(d.caption) AS caption_md5,
  CAST(length(d.caption) AS INTEGER) AS caption_len
FROM f LEFT JOIN d ON {S.extract_id('f.path')} = d.id
""")
def q_attach_captions(spark, sf):
    caps = J.latest_wins(T.captions(spark, sf), "id", "caption", "pos")
    out = J.attach_captions(T.feature_files(spark, sf), caps)
    return out.select("path", "id", F.md5("caption").alias("caption_md5"),
                      F.length("caption").alias("caption_len"))


@register("unused_captions", ids=("J2",), sql=f"""
WITH f AS ({T.FEATURE_FILES_SQL}),
c AS ({T.CAPTIONS_SQL}),
d AS (SELECT id, max_by(caption, pos) AS caption FROM c GROUP BY id)
SELECT d.id FROM d WHERE d.id NOT IN (SELECT {S.extract_id('path')} FROM f)
""")
def q_unused_captions(spark, sf):
    caps = J.latest_wins(T.captions(spark, sf), "id", "caption", "pos")
    return J.unused_captions(T.feature_files(spark, sf), caps).select("id")


@register("pair_by_position", ids=("J3", "W1"), sql=f"""
WITH a AS (SELECT path AS image_path, row_number() OVER (ORDER BY path) - 1 AS pos FROM ({T.image_files_sql(False)})),
b AS (SELECT path AS feature_path, row_number() OVER (ORDER BY path) - 1 AS pos FROM ({T.FEATURE_FILES_SQL}))
SELECT CAST(a.pos AS BIGINT) AS pos, image_path, feature_path FROM a JOIN b USING (pos)
""")
def q_pair_by_position(spark, sf):
    return J.pair_by_position(T.image_files(spark, sf, with_gaps=False), T.feature_files(spark, sf))


@register("pair_by_id", ids=("J4", "F4"), sql=f"""
WITH a AS (SELECT {S.extract_id('path')} AS id, path AS image_path FROM ({T.image_files_sql()})),
b AS (SELECT {S.extract_id('path')} AS id, path AS feature_path FROM ({T.FEATURE_FILES_SQL}))
SELECT COALESCE(a.id, b.id) AS id, image_path, feature_path,
  CASE WHEN image_path IS NOT NULL AND feature_path IS NOT NULL THEN 'matched'
       WHEN image_path IS NOT NULL THEN 'image_only' ELSE 'feature_only' END AS status
FROM a FULL OUTER JOIN b ON a.id = b.id
""")
def q_pair_by_id(spark, sf):
    return J.pair_by_id(T.image_files(spark, sf), T.feature_files(spark, sf))


@register("pairing_audit", ids=("J5", "J3", "J4"), sql=f"""
WITH ai AS (SELECT path AS image_path, row_number() OVER (ORDER BY path) AS pos FROM ({T.image_files_sql()})),
bi AS (SELECT path AS feature_path, row_number() OVER (ORDER BY path) AS pos FROM ({T.FEATURE_FILES_SQL})),
p AS (SELECT image_path, feature_path AS positional_partner FROM ai JOIN bi USING (pos)),
a AS (SELECT {S.extract_id('path')} AS id, path AS image_path FROM ({T.image_files_sql()})),
b AS (SELECT {S.extract_id('path')} AS id, path AS feature_path FROM ({T.FEATURE_FILES_SQL})),
i AS (SELECT a.image_path, b.feature_path AS id_partner FROM a LEFT JOIN b ON a.id = b.id)
SELECT i.image_path, id_partner, positional_partner FROM i LEFT JOIN p USING (image_path)
WHERE positional_partner IS DISTINCT FROM id_partner
""")
def q_pairing_audit(spark, sf):
    return J.pairing_audit(T.image_files(spark, sf), T.feature_files(spark, sf))


@register("dataset_size", ids=("A12",), sql=f"""
SELECT (SELECT count(*) FROM ({T.image_files_sql()})) AS n_images,
       (SELECT count(*) FROM ({T.FEATURE_FILES_SQL})) AS n_features,
       (SELECT count(*) FROM ({T.image_files_sql()})) = (SELECT count(*) FROM ({T.FEATURE_FILES_SQL})) AS equal
""")
def q_dataset_size(spark, sf):
    return J.dataset_size(T.image_files(spark, sf), T.feature_files(spark, sf))


@register("infer_labels_from_dirs", ids=("A5", "F3"), sql=f"""
WITH f AS ({T.SOURCE_FILES_SQL}),
t AS (SELECT path, {S.top_dir('path')} AS top FROM f),
r AS (SELECT top, CAST(row_number() OVER (ORDER BY top) - 1 AS BIGINT) AS label FROM (SELECT DISTINCT top FROM t))
SELECT path, label FROM t JOIN r USING (top)
""")
def q_infer_labels(spark, sf):
    return J.infer_labels_from_dirs(T.source_files(spark, sf)).select("path", "label")


@register("distinct_dirs", ids=("U1", "F3"), sql=f"""
SELECT DISTINCT {S.top_dir('path')} AS top FROM ({T.ODD_NAMES_SQL})
""")
def q_distinct_dirs(spark, sf):
    return T.odd_names(spark, sf).select(P.top_dir("path").alias("top")).distinct()


_COLLISION_SQL = f"""
SELECT path, COALESCE(NULLIF({S.stem('path')}, '') || '.npy', '') AS out_name FROM (
  SELECT path FROM ({T.image_files_sql(False)})
  UNION ALL
  SELECT replace(path, '.png', '.jpg') FROM ({T.image_files_sql(False)}) WHERE doc_id % 50 = 0)"""


@register("output_key_audit", ids=("A8", "F7"), sql=f"""
SELECT out_name, count(*) AS n, min(path) AS first_path, max(path) AS last_path
FROM ({_COLLISION_SQL}) GROUP BY out_name HAVING count(*) > 1
""")
def q_output_key_audit(spark, sf):
    imgs = T.image_files(spark, sf, with_gaps=False)
    both = imgs.select("path").unionByName(
        imgs.filter(F.col("doc_id") % 50 == 0).select(F.regexp_replace("path", r"\.png", ".jpg").alias("path")))
    named = both.withColumn("out_name", P.latent_name(P.path_stem("path"), F.lit(0)))
    return J.output_key_audit(named)


@register("latest_checkpoint", ids=("T6",), sql=r"""
WITH f AS (
  SELECT o_orderstatus AS folder,
         CASE WHEN o_orderstatus = 'P' THEN printf('%07d', o_orderkey) || '.pt'
              WHEN o_orderkey % 3 = 0 THEN 'training-state-' || printf('%07d', o_orderkey) || '.pt.tmp'
              ELSE 'training-state-' || printf('%07d', o_orderkey) || '.pt' END AS name
  FROM orders),
m AS (SELECT folder, name, CAST(regexp_extract(name, '^training-state-(\d+).pt$', 1) AS DOUBLE) AS step
      FROM f WHERE regexp_matches(name, '^training-state-(\d+).pt$'))
SELECT d.folder, max_by(m.name, m.step) AS latest FROM (SELECT DISTINCT folder FROM f) d
LEFT JOIN m ON d.folder = m.folder GROUP BY d.folder
""")
def q_latest_checkpoint(spark, sf):
    from pairlake.operators.catalog import latest_checkpoint
    o = load_table(spark, sf, "orders")
    key7 = P.zero_pad("o_orderkey", 7)
    name = (F.when(F.col("o_orderstatus") == "P", F.concat(key7, F.lit(".pt")))
            .when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("training-state-"), key7, F.lit(".pt.tmp")))
            .otherwise(F.concat(F.lit("training-state-"), key7, F.lit(".pt"))))
    files = o.select(F.col("o_orderstatus").alias("folder"), name.alias("name"))
    return latest_checkpoint(files, "folder", "name").withColumnRenamed("latest_name", "latest")


_RUN_SQL = """
SELECT o_orderkey,
  'SiT-XL-2-' || printf('%07d', o_orderkey) || '-size-256-vae-invae-cfg-' || CAST(o_custkey % 4 AS VARCHAR) || '.'
  || CAST(o_orderkey % 10 AS VARCHAR) || '-seed-' || CAST(o_custkey % 7 AS VARCHAR) || '-'
  || (CASE WHEN o_orderkey % 2 = 0 THEN 'sde' ELSE 'ode' END) || '-0.' || CAST(o_custkey % 9 AS VARCHAR)
  || '-1.5-pathdrop-' || (CASE WHEN o_orderkey % 4 < 2 THEN 'True' ELSE 'False' END)
  || (CASE WHEN o_orderstatus = 'F' THEN '-balanced' ELSE '' END) AS name
FROM orders"""


@register("parse_run_name", ids=("F14", "F5"), sql=f"""
WITH r AS ({_RUN_SQL})
SELECT o_orderkey, name,
  regexp_extract(name, '^(.+)-([^-]+)-size-', 1) AS model,
  regexp_extract(name, '-([^-]+)-size-', 1) AS ckpt,
  CAST(regexp_extract(name, '-size-(\\d+)-', 1) AS INTEGER) AS resolution,
  CAST(regexp_extract(name, '-cfg-([^-]+)-', 1) AS DOUBLE) AS cfg_scale,
  CAST(regexp_extract(name, '-seed-(-?\\d+)-', 1) AS BIGINT) AS seed,
  regexp_extract(name, '-seed-[^-]+-([^-]+)-', 1) AS mode,
  CAST(regexp_extract(name, '-seed-[^-]+-[^-]+-([^-]+)-', 1) AS DOUBLE) AS guidance_high,
  CAST(regexp_extract(name, '-([^-]+)-pathdrop-', 1) AS DOUBLE) AS cls_cfg_scale,
  regexp_extract(name, '-pathdrop-(True|False)', 1) = 'True' AS path_drop,
  name LIKE '%-balanced' AS balanced
FROM r
""")
def q_parse_run_name(spark, sf):
    o = T.split_single_file(load_table(spark, sf, "orders"))
    name = F.concat(
        F.lit("SiT-XL-2-"), P.zero_pad("o_orderkey", 7), F.lit("-size-256-vae-invae-cfg-"),
        (F.col("o_custkey") % 4).cast("string"), F.lit("."), (F.col("o_orderkey") % 10).cast("string"),
        F.lit("-seed-"), (F.col("o_custkey") % 7).cast("string"), F.lit("-"),
        F.when(F.col("o_orderkey") % 2 == 0, "sde").otherwise("ode"), F.lit("-0."),
        (F.col("o_custkey") % 9).cast("string"), F.lit("-1.5-pathdrop-"),
        F.when(F.col("o_orderkey") % 4 < 2, "True").otherwise("False"),
        F.when(F.col("o_orderstatus") == "F", "-balanced").otherwise(""))
    r = o.select("o_orderkey", name.alias("name"))
    return r.select("o_orderkey", "name", P.parse_run_name("name").alias("p")).select("o_orderkey", "name", "p.*")


@register("url_functions", ids=("F11", "F12", "F13"), sql=r"""
WITH u AS (SELECT page_id, url,
  CASE WHEN page_id % 2 = 0 THEN 'attachment; filename="page ' || CAST(page_id AS VARCHAR) || '.html"' ELSE '' END
  AS header FROM pages)
SELECT page_id,
  (instr(url, '://') > 0 AND regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)')
   AND instr(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '.') > 0) AS is_url,
  md5(url) || '_' || substr(regexp_replace(
     CASE WHEN regexp_matches(header, 'filename="([^"]*)"') THEN regexp_extract(header, 'filename="([^"]*)"', 1)
          ELSE url END, '[^0-9a-zA-Z\-._]', '_', 'g'), 1, 128) AS cache_name,
  CASE WHEN regexp_matches(header, 'filename="([^"]*)"') THEN regexp_extract(header, 'filename="([^"]*)"', 1)
       ELSE url END AS url_name
FROM u
""")
def q_url_functions(spark, sf):
    p = load_table(spark, sf, "pages")
    header = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('attachment; filename="page '),
                                                       F.col("page_id").cast("string"), F.lit('.html"'))
                    ).otherwise(F.lit(""))
    u = p.select("page_id", "url", header.alias("header"))
    name = P.disposition_name("header", "url")
    return u.select("page_id", P.is_url("url").alias("is_url"), P.cache_name("url", name).alias("cache_name"),
                    name.alias("url_name"))


@register("format_time", ids=("F10",), sql="""
WITH s AS (SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity * 3607 * (1 + l_discount * 300), 0) AS BIGINT) AS s
           FROM lineitem)
SELECT l_orderkey, l_linenumber,
  CASE WHEN s < 60 THEN printf('%ds', s)
       WHEN s < 3600 THEN printf('%dm %02ds', s // 60, s % 60)
       WHEN s < 86400 THEN printf('%dh %02dm %02ds', s // 3600, (s // 60) % 60, s % 60)
       ELSE printf('%dd %02dh %02dm', s // 86400, (s // 3600) % 24, (s // 60) % 60) END AS t,
  CASE WHEN s < 60 THEN printf('%ds', s)
       WHEN s < 3600 THEN printf('%dm %02ds', s // 60, s % 60)
       WHEN s < 86400 THEN printf('%dh %02dm', s // 3600, (s // 60) % 60)
       ELSE printf('%dd %02dh', s // 86400, (s // 3600) % 24) END AS tb
FROM s
""")
def q_format_time(spark, sf):
    li = T.split_single_file(load_table(spark, sf, "lineitem"))
    secs =F.col("l_quantity") * 3607 * (1 + F.col("l_discount") * 300)
    return li.select("l_orderkey", "l_linenumber", format_time(secs).alias("t"), format_time_brief(secs).alias("tb"))


@register("parse_resolution", ids=("F8",), sql=r"""
WITH r AS (SELECT p_partkey, CASE p_partkey % 5
    WHEN 0 THEN CAST(p_size AS VARCHAR) || 'x' || CAST(p_size * 2 AS VARCHAR)
    WHEN 1 THEN CAST(p_size AS VARCHAR) || ',' || CAST(p_size AS VARCHAR)
    WHEN 2 THEN CAST(p_size AS VARCHAR) || ' x ' || CAST(p_size AS VARCHAR)
    WHEN 3 THEN 'x' || CAST(p_size AS VARCHAR)
    ELSE p_brand END AS res FROM part)
SELECT p_partkey, res,
  CASE WHEN regexp_matches(res, '^(\d+)[x,](\d+)$') THEN CAST(regexp_extract(res, '^(\d+)[x,](\d+)$', 1) AS BIGINT) END
    AS width,
  CASE WHEN regexp_matches(res, '^(\d+)[x,](\d+)$') THEN CAST(regexp_extract(res, '^(\d+)[x,](\d+)$', 2) AS BIGINT) END
    AS height
FROM r
""")
def q_parse_resolution(spark, sf):
    p = load_table(spark, sf, "part")
    s = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 5
    res = (F.when(k == 0, F.concat(s, F.lit("x"), (F.col("p_size") * 2).cast("string")))
           .when(k == 1, F.concat(s, F.lit(","), s)).when(k == 2, F.concat(s, F.lit(" x "), s))
           .when(k == 3, F.concat(F.lit("x"), s)).otherwise(F.col("p_brand")))
    r = p.select("p_partkey", res.alias("res"))
    return r.select("p_partkey", "res", P.parse_resolution("res", strict=False).alias("wh")).select(
        "p_partkey", "res", "wh.width", "wh.height")
