"""Stand-in inputs derived from the driver tables (see FIXTURES.md part 3).

Each builder has a Spark form and the same derivation as DuckDB SQL, so a
query and its oracle start from identical rows.  Nothing is written back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlake.functions.paths import zero_pad
from pairlake.session import load_table


def split_single_file(df: DataFrame) -> DataFrame:
    """A table that is one file (one row group, one scan task) is dealt round
    robin to the cores; a table of many files is left as its scan splits it."""
    if len(df.inputFiles()) > 1:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def _shard_dir(doc_id) -> F.Column:
    return F.concat(F.lit("data_"), zero_pad(F.floor(F.col(doc_id) / 100), 6))


def feature_files(spark, sf) -> DataFrame:
    """Latent files: data_<%06d doc_id div 100>/img-latents-<%08d doc_id>.npy"""
    d = load_table(spark, sf, "documents")
    return d.select("doc_id", F.concat(_shard_dir("doc_id"), F.lit("/img-latents-"), zero_pad("doc_id", 8),
                                       F.lit(".npy")).alias("path"))


FEATURE_FILES_SQL = """SELECT doc_id, 'data_' || printf('%06d', doc_id // 100) || '/img-latents-'
       || printf('%08d', doc_id) || '.npy' AS path FROM documents"""


def image_files(spark, sf, with_gaps: bool = True) -> DataFrame:
    """Image files with the same ids; with gaps, ids divisible by 97 have no
    image (so pairing by position and by id disagree)."""
    d = load_table(spark, sf, "documents")
    if with_gaps:
        d = d.filter(F.col("doc_id") % 97 != 0)
    return d.select("doc_id", F.concat(_shard_dir("doc_id"), F.lit("/img"), zero_pad("doc_id", 8),
                                       F.lit(".png")).alias("path"))


def image_files_sql(with_gaps: bool = True) -> str:
    where = "WHERE doc_id % 97 <> 0" if with_gaps else ""
    return f"""SELECT doc_id, 'data_' || printf('%06d', doc_id // 100) || '/img' || printf('%08d', doc_id)
       || '.png' AS path FROM documents {where}"""


def class_manifest(spark, sf) -> DataFrame:
    """(pos, fname, label): quality + 2*toxic for the labelled documents, plus a
    later duplicate entry (label 4 + toxic) for every quality document."""
    lab = load_table(spark, sf, "labels")
    name = F.concat(_shard_dir("doc_id"), F.lit("/img"), zero_pad("doc_id", 8), F.lit(".png"))
    first = lab.select(F.col("doc_id").alias("pos"), name.alias("fname"),
                       (F.col("quality") + 2 * F.col("toxic")).cast("long").alias("label"))
    later = lab.filter(F.col("quality") == 1).select(
        (F.col("doc_id") + 1000000).alias("pos"), name.alias("fname"),
        (F.col("toxic") + 4).cast("long").alias("label"))
    return first.unionByName(later)


CLASS_MANIFEST_SQL = """
SELECT doc_id AS pos, 'data_' || printf('%06d', doc_id // 100) || '/img' || printf('%08d', doc_id) || '.png' AS fname,
       CAST(quality + 2 * toxic AS BIGINT) AS label FROM labels
UNION ALL
SELECT doc_id + 1000000, 'data_' || printf('%06d', doc_id // 100) || '/img' || printf('%08d', doc_id) || '.png',
       CAST(toxic + 4 AS BIGINT) FROM labels WHERE quality = 1"""


def captions(spark, sf) -> DataFrame:
    """(pos, id, caption): the document text under its pairing id; German
    documents get a second, later caption (text + ' [v2]') that must win;
    benchmark items add captions for ids without any file."""
    d = load_table(spark, sf, "documents")
    b = load_table(spark, sf, "benchmark")
    cid = F.concat(_shard_dir("doc_id"), F.lit("/"), zero_pad("doc_id", 8))
    first = d.select(F.col("doc_id").alias("pos"), cid.alias("id"), F.col("text").alias("caption"))
    later = d.filter(F.col("lang") == "de").select((F.col("doc_id") + 10000000).alias("pos"), cid.alias("id"),
                                                   F.concat("text", F.lit(" [v2]")).alias("caption"))
    extra = b.select((F.col("item_id") + 20000000).alias("pos"),
                     F.concat(F.lit("bench/"), F.col("item_id").cast("string")).alias("id"),
                     F.col("text").alias("caption"))
    return first.unionByName(later).unionByName(extra)


CAPTIONS_SQL = """
SELECT doc_id AS pos, 'data_' || printf('%06d', doc_id // 100) || '/' || printf('%08d', doc_id) AS id,
       text AS caption FROM documents
UNION ALL
SELECT doc_id + 10000000, 'data_' || printf('%06d', doc_id // 100) || '/' || printf('%08d', doc_id), text || ' [v2]'
FROM documents WHERE lang = 'de'
UNION ALL
SELECT item_id + 20000000, 'bench/' || CAST(item_id AS VARCHAR), text FROM benchmark"""


def source_files(spark, sf) -> DataFrame:
    """Image files under one top-level folder per document source."""
    d = load_table(spark, sf, "documents")
    return d.select("doc_id", F.concat(F.col("source"), F.lit("/img"), zero_pad("doc_id", 8),
                                       F.lit(".png")).alias("path"))


SOURCE_FILES_SQL = """SELECT doc_id, source || '/img' || printf('%08d', doc_id) || '.png' AS path FROM documents"""


def odd_names(spark, sf) -> DataFrame:
    """Path edge cases (several dots, none, leading dots, trailing dot,
    backslashes, upper-case extension, bare extension), one per document."""
    d = load_table(spark, sf, "documents")
    i8 = zero_pad("doc_id", 8)
    k = F.col("doc_id") % 7
    name = (F.when(k == 0, F.concat(F.col("source"), F.lit("/img"), i8, F.lit(".png")))
            .when(k == 1, F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/.hidden"),
                                   F.col("doc_id").cast("string")))
            .when(k == 2, F.concat(F.col("lang"), F.lit(".v"), F.col("doc_id").cast("string"), F.lit(".tar.gz")))
            .when(k == 3, F.concat(F.col("source"), F.lit("\\sub\\img-latents-"), i8, F.lit(".NPY")))
            .when(k == 4, F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/file"),
                                   F.col("doc_id").cast("string"), F.lit(".")))
            .when(k == 5, F.concat(F.lit("..img"), i8, F.lit(".JPEG")))
            .otherwise(F.concat(F.col("source"), F.lit("/png"))))
    return d.select("doc_id", name.alias("path"))


ODD_NAMES_SQL = """SELECT doc_id, CASE doc_id % 7
  WHEN 0 THEN source || '/img' || printf('%08d', doc_id) || '.png'
  WHEN 1 THEN source || '/' || lang || '/.hidden' || CAST(doc_id AS VARCHAR)
  WHEN 2 THEN lang || '.v' || CAST(doc_id AS VARCHAR) || '.tar.gz'
  WHEN 3 THEN source || '\\sub\\img-latents-' || printf('%08d', doc_id) || '.NPY'
  WHEN 4 THEN source || '/' || lang || '/file' || CAST(doc_id AS VARCHAR) || '.'
  WHEN 5 THEN '..img' || printf('%08d', doc_id) || '.JPEG'
  ELSE source || '/png' END AS path FROM documents"""
