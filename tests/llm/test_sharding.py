"""Jump consistent hashing (op 8) against the published loop."""

import zlib

from pyspark.sql import functions as F

from pairlake.llm import sharding


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_sizes_and_slots(spark):
    rows = [(i, "é" * (i % 5)) for i in range(-300, 1500)] + [(None, "x"), (None, None), (7, "again"), (7, "é" * 2),
                                                             (1 << 62, None), (-(1 << 63), "")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, Slot string")
    got = sharding.shard(df, 16).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        assert r["shard"] == jump(r["doc_id"] or 0, 16) and r["grown_shard"] == jump(r["doc_id"] or 0, 17)
        assert r["grown_shard"] in (r["shard"], 16)
        raw = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) < 1.5 * len(rows) / 16


def test_rows_of_a_hot_key_are_spread(spark):
    df = spark.createDataFrame([(7 if i % 3 else None, f"t{i}", "x", 1) for i in range(6000)], "doc_id long, text string, `a.b` string, Size int")
    got = sharding.shard(df, 16)
    assert got.columns == ["doc_id", "text", "a.b", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    slots = {}
    for r in got.collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) <= 2
    mark = F.concat(F.coalesce("doc_id", F.lit(0)).cast("string"), F.lit(":"), F.crc32("text").cast("string"))
    sizes = df.groupBy(F.substring(F.md5(mark.cast("binary")), 1, sharding.BUCKET_DIGITS)).count().agg(F.max("count")).first()[0]
    assert sizes < 20


def test_a_key_alone_decides(spark):
    df = spark.createDataFrame([(i, "t") for i in range(500)], "doc_id long, text string")
    a = {r["doc_id"]: r["shard"] for r in sharding.shard(df, 5, keep=["doc_id"]).collect()}
    b = {r["doc_id"]: r["shard"] for r in sharding.shard(df.filter("doc_id % 3 = 0"), 5).collect()}
    assert all(a[k] == v for k, v in b.items())
    assert sharding.shard(df.limit(0), 5).collect() == []
    assert {r["shard"] for r in sharding.shard(df, 1).collect()} == {0}
