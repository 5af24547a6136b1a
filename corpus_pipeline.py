"""The training-corpus pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet into the session's shared folder and reads again as the next
stage's documents.  All stages but the last keep the columns of ``documents``.

1. quality          documents that the compression classifier scores below 0.3 go
2. near_duplicates  of each SimHash component one document stays (3-word
                    shingles, up to 2 differing bits): that of least id, those
                    without an id last; among rows that share it, that of
                    least row hash
3. decontamination  documents with a 10-word window of a benchmark item go
4. pii              personal data becomes its kind in brackets; n_chars follows
5. encode           doc_id, ids (little-endian unsigned 32-bit integers), n_tokens

Defined results: a null text is scored, kept and encoded like an empty one;
texts of any length are read whole; rows alike in every column are one, rows
that share an id but differ stay apart; input columns of any name, with dots
or equal but for case, come through the first four stages unchanged; empty
tables give an empty table.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlake.llm import bpe, decontam, pii, quality, simhash
from pairlake.llm.queries import multi_ranks
from pairlake.llm.scratch import scratch_path
from pairlake.llm.text import Numbered, pick
from pairlake.session import checkpoint_dir, load_table, ship_package

#: SQL has no compression, XXH64 or byte-pair merges; tests hold the rows against brute force.
ORACLE_SQL = None

KEEP_FROM = 0.3  # least quality score that stays


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = Numbered(docs)
    labels = load_table(spark, sf_dir, "labels").filter(~quality.held_out())
    scored = quality.score(rows.df, quality.fit(docs, labels), text=rows("text"))
    return rows.named(scored.filter(F.col("score") >= KEEP_FROM))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # a row is known by the hash of all its columns, so neither ids that repeat nor missing ones lose it
    rows = Numbered(docs)
    doc_id, text = rows("doc_id"), rows("text")
    rest = F.to_json(F.struct(*[F.col(c).cast("string") for c in rows.df.columns if c != text]))
    row = F.unhex(F.sha2(F.concat(F.coalesce(F.sha2(text, 256), F.lit("")), F.lit(" "), rest), 256))
    marked = rows.df.withColumn("row", row)
    place = F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), "row").alias("place")
    groups = simhash.near_duplicates(marked.select(place, F.col(text).alias("text")), "place", shingle=3, max_bits=2)
    first = groups.filter("place = component_id").select("place.row")
    # rows alike in every column are one; only those that repeat go through the grouping
    times = marked.groupBy("row").agg(F.count(F.lit(1)).alias("n")).join(first, "row", "left_semi")
    kept = marked.join(times, "row")
    once = kept.filter("n > 1").groupBy("row").agg(*[F.first(c).alias(c) for c in rows.df.columns])
    return rows.named(kept.filter("n = 1").select(rows.df.columns).unionByName(once.select(rows.df.columns)))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, load_table(spark, sf_dir, "benchmark"), n=10)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = Numbered(pii.redact(docs))
    return rows.named(rows.df.withColumn(rows("n_chars"), F.length(rows("text")).cast("long")))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks, pattern = multi_ranks()
    return bpe.encode(pick(docs, doc_id="doc_id", text="text"), ranks, pattern).select(
        "doc_id", "ids", (F.length("ids") / 4).cast("long").alias("n_tokens"))


def _stage(fn):
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        checkpoint_dir(spark)
        ship_package(spark)
        return fn(spark, docs, sf_dir)
    return stage


STAGES = [("quality", _stage(quality_stage)), ("near_duplicates", _stage(near_duplicates_stage)),
          ("decontamination", _stage(decontamination_stage)), ("pii", _stage(pii_stage)),
          ("encode", _stage(encode_stage))]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
