"""Compression classifier (op 7): held-out accuracy and edges."""

import random
import zlib

from pyspark.sql import functions as F

from pairlake.llm import quality


def corpus(n=900, seed=6):
    draw = random.Random(seed)
    syllables = ["ta", "ren", "mo", "lis", "ver", "an", "os", "qui", "del", "for"]
    words = ["".join(draw.choice(syllables) for _ in range(draw.randint(1, 4))) for _ in range(500)]
    out = []
    for i in range(n):
        body = [draw.choice(words) for _ in range(draw.randint(10, 200))]
        good = i % 4 != 0
        if not good:
            body = [w.upper() + "!!" for w in body] if i % 8 else [draw.choice(body)] * len(body)
        out.append((i, " ".join(body), int(good)))
    return out


def auc(scored):
    ordered = sorted(scored)
    ones = sum(y for _, y in ordered)
    below = sum(sum(1 - y for _, y in ordered[:i]) for i, (_, y) in enumerate(ordered) if y)
    return below / (ones * (len(ordered) - ones))


def test_held_out_accuracy_and_equal_scores(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(5000, None, "x"), (5001, "", "x")],
                                 "doc_id long, text string, SCORE string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, 7), (2, None), (None, 1)],
                                   "doc_id long, quality int").filter(~quality.held_out())
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert auc(held) > 0.95
    assert sum((s >= 0.3) == bool(y) for s, y in held) / len(held) > 0.9
    assert all(0 <= s <= 1 for s in got.values()) and got[5000] == got[5001]
    again = {r["doc_id"]: r["score"] for r in quality.score(docs.repartition(3), quality.fit(docs, labels)).collect()}
    assert again == got


def test_held_out_rule(spark):
    df = spark.range(200).select(F.col("id").alias("doc_id")).withColumn("h", quality.held_out())
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in df.collect())


def test_little_or_one_sided_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 7)) for i in range(40)], "doc_id long, text string")
    few = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    assert quality.score(docs, quality.fit(docs, few)).filter("score between 0 and 1").count() == 40
    ones = few.filter("quality = 1")
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, ones)).collect()} == {16 / 17}
    none = quality.fit(docs, few.limit(0))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.limit(0), quality.fit(docs, few)).collect() == []


def test_contradictory_labels_are_not_used(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows], "doc_id long, text string, `_id` string, `a.b` int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    both = spark.createDataFrame([(i, 1 - y) for i, _, y in rows if i % 3 == 0], "doc_id long, quality int")
    a, b = quality.fit(docs, labels.filter("doc_id % 3 <> 0")), quality.fit(docs, labels.union(both).union(labels))
    assert a == b
    scored = quality.score(docs.withColumn("Score", F.lit("mine")), a, out="q")
    assert scored.columns == ["doc_id", "text", "_id", "a.b", "Score", "q"] and {r["Score"] for r in scored.collect()} == {"mine"}


def test_features_by_hand():
    """Size differences by zstandard itself, segment by segment."""
    import zstandard
    bad, good = b"junk!! " * 200, b"fine words " * 200
    measure = quality.Measure(quality.Model(bad, good, True, (), (), ()))
    raw = (b"fine words and junk!! " * 100)[:1300]
    parts = [raw[:512], raw[512:1024], raw[1024:]]

    def sizes(data):
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        c = zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        return [len(c.compress(p)) for p in parts]
    b, g = sizes(bad), sizes(good)
    difference = [(x - y) / len(p) for x, y, p in zip(b, g, parts)]
    share = [min(x, y) / len(p) for x, y, p in zip(b, g, parts)]
    want = [(sum(b) - sum(g)) / 1300, min(difference), sum(share) / 3, min(share)]
    assert all(abs(x - y) < 0.02 for x, y in zip(measure(raw), want))


def test_long_text_is_scored_whole():
    model = quality.Model(b"junk!! " * 200, b"fine words " * 200, True, (), (), ())
    measure = quality.Measure(model)
    body = b"".join(b"fine words %d " % i for i in range(20_000))
    assert measure(body)[0] > measure(body[:len(body) // 2] + b"JUNK!! " * 20_000)[0]
