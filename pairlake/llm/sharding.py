"""Operator 8: shards by jump consistent hashing, in DataFrame functions only.

A key's shard follows from the key and the number of shards alone: the key
seeds a linear congruential generator whose draws are the shard counts at
which the key would move, and the last one below the wanted count is its
shard.  Going from n to n + 1 shards moves about 1 / (n + 1) of the keys, all
of them into the new shard, and needs no ring table.

Slots number the rows of a shard without gaps.  A shard is cut into 4,096
buckets by a hash of the key and the text's checksum, so that the rows of one
key are spread as well; rows are numbered inside (shard, bucket), and the rows
of the earlier buckets are added from a table of at most shards x 4,096 counts,
so no task ever holds a whole shard unless a third of all rows are one key and
one text.

Defined results: a null text has no bytes; a null key is hashed as 0; rows
that repeat a key fall into one shard and get slots of their own, in the order
of their text's checksum; ties between equal rows are free; other columns are
passed through, one named like an added column is replaced; an empty table
gives an empty table.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlake.llm.text import Numbered

BUCKET_DIGITS = 3  # hexadecimal digits of the bucket hash: 4,096 buckets


def jump_hash(key: str, shards: int) -> Column:
    """Shard 0 .. ``shards`` - 1 of the long column ``key``.

    The generator is ``k * 2862933555777941757 + 1`` modulo 2**64 (fixed
    values of the published algorithm), in exact decimals."""
    step = "(s.k * 2862933555777941757BD + 1BD) % 18446744073709551616BD"
    return F.expr(f"""
        int(aggregate(
          sequence(1, {shards}),
          named_struct('k', cast(pmod(cast(coalesce({key}, 0) AS decimal(20, 0)), 18446744073709551616BD)
                                 AS decimal(38, 0)),
                       'b', -1L, 'j', 0L),
          (s, i) -> if(s.j >= {shards}, s, named_struct(
            'k', cast({step} AS decimal(38, 0)),
            'b', s.j,
            'j', bigint(floor((s.j + 1) * (2147483648D / double(1 + (({step}) div 8589934592BD))))))),
          s -> s.b))""")


def shard(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text",
          keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all of them if None) with ``size`` (UTF-8 bytes of
    the text plus 1), ``text_crc32``, ``law`` ("key"), ``shard``, ``slot`` and
    ``grown_shard`` (the shard if there were one more).  Leave the text out of
    ``keep`` where it need not move with its row."""
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    raw = F.encode(F.coalesce(F.col("_text"), F.lit("")), "utf-8")
    numbered = Numbered(df)
    gone = {a.lower() for a in added}
    kept = {n: f"c{i}" for i, n in enumerate(numbered.names) if n.lower() not in gone} if keep is None else {
        n: numbered(n) for n in keep}
    df = numbered.df.withColumns({"_key": F.col(numbered(key)), "_text": F.col(numbered(text))})
    mark = F.concat(F.coalesce(F.col("_key"), F.lit(0)).cast("string"), F.lit(":"), F.crc32(raw).cast("string"))
    bucket = F.substring(F.md5(mark.cast("binary")), 1, BUCKET_DIGITS)
    placed = df.withColumn("_shard", jump_hash("_key", shards)).withColumn("_bucket", bucket)
    before = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = (placed.groupBy("_shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
              .select("_shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    inside = Window.partitionBy("_shard", "_bucket").orderBy("_key", "_crc", "_size")
    rows = placed.select(*kept.values(), "_shard", "_bucket", "_key", F.crc32(raw).alias("_crc"),
                         (F.length(raw).cast("long") + 1).alias("_size"), jump_hash("_key", shards + 1).alias("_grown"))
    return (rows.withColumn("_in", F.row_number().over(inside).cast("long") - 1)
            .join(counts, ["_shard", "_bucket"])
            .select(*[F.col(c).alias(n) for n, c in kept.items()], F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("key").alias("law"),
                    F.col("_shard").alias("shard"), (F.col("_before") + F.col("_in")).alias("slot"),
                    F.col("_grown").alias("grown_shard")))
