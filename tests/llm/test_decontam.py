"""Benchmark decontamination (op 5): brute force, edges, removal."""

import random
import re

import pytest

from pairlake.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, n):
    out = []
    for d, text in docs:
        w, hit, ids = words(text), set(), set()
        for i, t in items:
            v = words(t)
            size = min(n, len(v))
            grams = {tuple(v[a:a + size]) for a in range(len(v) - size + 1)} if size else set()
            for a in range(len(w) - size + 1 if size else 0):
                if tuple(w[a:a + size]) in grams:
                    hit |= set(range(a, a + size))
                    if i is not None:
                        ids.add(i)
        out.append((d, len(w), len(hit), sorted(ids)))
    return sorted(out, key=str)


def tables():
    draw = random.Random(4)
    v = ["a", "b", "C", "é", "d1", "漢字", "x"]
    items = [(i, draw.choice([" ", "--", "\n"]).join(draw.choice(v) for _ in range(draw.randint(1, 9))))
             for i in range(25)]
    items += [(30, None), (31, ""), (32, "!!"), (None, "x x x b b"), (3, items[3][1]), (33, items[4][1])]
    docs = [(i, draw.choice([" ", ", ", "\t"]).join(draw.choice(v) for _ in range(draw.randint(0, 40))))
            for i in range(60)]
    docs += [(100, None), (101, ""), (None, "x X x B b"), (102, "zz " * 5000 + items[0][1]), docs[5]]
    return docs, items


@pytest.mark.parametrize("set_bytes", [decontam.SET_BYTES, 150])
def test_equals_brute_force_for_any_number_of_sets(spark, set_bytes):
    docs, items = tables()
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, N_HIT int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(df, bench, 4, set_bytes=set_bytes).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=str) == brute(docs, items, 4)
    for r in got:
        assert sum(h["last"] - h["first"] + 1 for h in r["hits"]) == r["n_hit"]


def test_removal_of_documents_and_spans(spark):
    df = spark.createDataFrame([(1, "Keep this. One, TWO three four! and that", "s"), (2, "clean text", None),
                                (3, None, None)], "doc_id long, text string, source string")
    bench = spark.createDataFrame([("i", "one two three four")], "item_id string, text string")
    kept = decontam.decontaminate(df, bench, 4)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
    cut = {r["doc_id"]: r["text"] for r in decontam.decontaminate(df, bench, 4, action="spans").collect()}
    assert cut == {1: "Keep this. ! and that", 2: "clean text", 3: None}


@pytest.mark.parametrize("set_bytes", [decontam.SET_BYTES, 40])
def test_columns_of_any_name_keep_their_values(spark, set_bytes):
    columns = ["doc_id", "text", "n_words", "N_HIT", "items", "hits", "_set0"]
    rows = [(1, "a b c d e", "n", 2.5, "i", True, "s"), (2, "x y", None, 0.0, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string, N_HIT double, items string, hits boolean, "
                               "_set0 string")
    bench = spark.createDataFrame([(1, "b c d"), (2, "u v w"), (3, "p q r s t u v w")], "item_id long, text string")
    kept = decontam.decontaminate(df, bench, 3, set_bytes=set_bytes)
    assert kept.schema == df.schema and list(map(tuple, kept.collect())) == rows[1:]
    cut = decontam.decontaminate(df, bench, 3, action="spans", set_bytes=set_bytes)
    assert cut.columns == columns and {tuple(r)[2:] for r in cut.collect()} == {r[2:] for r in rows}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [(r["n_words"], r["n_hit"], r["items"]) for r in decontam.contamination(docs, bench).collect()] == [(2, 0, [])]
    assert decontam.contamination(docs.limit(0), bench).collect() == []
