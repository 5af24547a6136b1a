"""Ranked lexical search (op 12) against scores of every document."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pairlake.llm import lexical

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    bags = [(d, words(t)) for d, t in docs]
    many, total = sum(bool(w) for _, w in bags), sum(len(w) for _, w in bags)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for i, ts in asked.items():
        weight = {t: math.floor(1000 * math.log((2 * many + 2) / (2 * sum(t in w for _, w in bags) + 1))) for t in ts}
        scores = []
        for d, w in bags:
            m = 50 + 50 * len(w) * many // max(total, 1)
            s = sum(weight[t] * (10**9 * w.count(t) // (1000 * w.count(t) + 20 * m)) for t in ts)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def got(spark, docs, items, k, **kw):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in lexical.search(df, asked, k, **kw).collect()), key=str)


def corpus(seed, n, words_=80, longest=60):
    rng = random.Random(seed)
    ws = [f"w{i}" for i in range(words_)]
    return [(i, " ".join(rng.choices(ws, weights=[1 / (j + 1) for j in range(words_)], k=rng.randrange(longest)))) for i in range(n)]


@pytest.mark.parametrize("k,block,group", [(5, 1 << 21, 1 << 20), (50, 300, 500), (1, 1, 1 << 20), (1000, 2000, 1 << 20)])
def test_against_brute_force(spark, k, block, group):
    docs, items = corpus(k, 200), [(i, t) for i, t in corpus(k + 1, 8, longest=25)]
    assert got(spark, docs, items, k, block_postings=block, group_bytes=group) == brute(docs, items, k)


def test_edges(spark):
    docs = [(1, "a b"), (1, "a b"), (2, "A_B"), (None, "a b"), (None, None), (3, ""), (4, "--"), (5, "é É straße İ"), (6, "a " * 50_000),
            (7, "a b"), (-3, "b a"), (9, "c"), (10, "c c"), (11, "only")]
    items = [(1, "a B a"), (1, "c"), (None, "é"), (None, "straße"), (2, None), (3, ""), (4, "unknown"), (5, "İ")]
    for k in (1, 3, 50):
        assert got(spark, docs, items, k) == brute(docs, items, k)
    assert got(spark, docs[:0], items, 5) == [] and got(spark, docs, items[:0], 5) == []


def test_clashing_names_and_text_ids(spark):
    docs = spark.createDataFrame([("d2", "a b", 1, 2), ("d1", "a b", 1, 2), ("d3", "z", 0, 0)], "doc_id string, text string, n int, Score int")
    docs = docs.selectExpr("*", "1 as `x.y`", "'no' as Text")
    asked = spark.createDataFrame([("i", "a", 1)], "item_id string, text string, rank int")
    assert [tuple(r)[:3] for r in lexical.search(docs, asked, 2).orderBy("rank").collect()] == [("i", 1, "d1"), ("i", 2, "d2")]


def test_reading_stops_early():
    """With one clear winner the lists are not read to their ends."""
    n = 20_000
    block = pa.table({"doc_id": pa.array(range(n)), "n": pa.array([100] * n, pa.int64()),
                      "terms": pa.array([[0, 1]] * n, pa.list_(pa.int32())),
                      "times": pa.array([[50, 50] if i < 3 else [1 + i % 3] * 2 for i in range(n)], pa.list_(pa.int64()))})
    lists = lexical._Lists(block, np.array([1000, 2000]), n, 100 * n)
    reads = []
    docs = lists.doc
    lists.doc = type("Counted", (), {"__getitem__": lambda _, s: reads.append(s.stop - s.start) or docs[s]})()
    best, scores = lists.top([0, 1], 3, block["doc_id"].combine_chunks())
    assert sorted(best) == [0, 1, 2] and sum(reads) <= 2 * lexical.FIRST_STEP and len(set(scores)) == 1
