"""SimHash near-duplicates (op 3) against all pairs, and the components."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pairlake.llm import simhash
from pairlake.llm.components import components


def brute_print(text, k=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, seed=42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(prints, most):
    """(id, fingerprint) rows -> set of (id, hex, least reachable id)."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= most:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f"{f:016x}", least.get(find(i))) for i, (d, f) in enumerate(prints)), key=str)


def texts():
    draw = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    out = [None, "", " \n", "one", "One", "two words", "A b C", "é É"]
    for _ in range(25):
        base = [draw.choice(words) for _ in range(draw.randint(20, 300))]
        for _ in range(draw.randint(1, 6)):
            copy = list(base)
            for _ in range(draw.randint(0, 3)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            out.append(" ".join(copy))
    return out + ["tick " * 4000]


@pytest.mark.parametrize("block_rows", [simhash.BLOCK_ROWS, 4])
def test_near_duplicates_equal_all_pairs(spark, block_rows):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "one"), (3, "other text here"), (2, " \n")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df, block_rows=block_rows).collect()
    want = brute_components([(d, brute_print(t)) for d, t in rows], 2)
    assert sorted((tuple(r) for r in got), key=str) == want


@pytest.mark.parametrize("block_rows", [10_000, 40])
def test_crowded_top_nodes_lose_no_link(spark, block_rows):
    draw = random.Random(5)
    centre = draw.getrandbits(64)
    prints = {centre, 0, (1 << 64) - 1}
    while len(prints) < 700:  # a cloud whose chains hang together by few bits
        p = draw.choice(list(prints)) if draw.random() < 0.8 else centre
        for _ in range(draw.randint(1, 4)):
            p ^= 1 << draw.randrange(64)
        prints.add(p)
    signed = [(simhash._signed(p),) for p in prints]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"), 2, block_rows)
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    want = brute_components([(simhash._signed(p), p) for p in prints], 2)
    groups, seen = {}, {}
    for p, _, least in want:
        assert groups.setdefault(least, roots.get(p, p)) == roots.get(p, p)
        assert seen.setdefault(roots.get(p, p), least) == least


def test_gray_rank_is_the_inverse_of_the_gray_code(spark):
    n = np.arange(1000, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()
    df = spark.createDataFrame([(simhash._signed(x),) for x in (0, 1, 3, 2, 1 << 63, (1 << 64) - 1)], "fp long")
    column = [r[0] + (1 << 63) for r in df.select(simhash._gray_rank_column(F.col("fp"))).collect()]
    assert column == simhash.gray_rank(np.array([0, 1, 3, 2, 1 << 63, (1 << 64) - 1], dtype=np.uint64)).tolist()


def test_empty_table_and_no_links(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).collect() == []


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(50)]
    random.Random(1).shuffle(chain)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{1000 + i: 1000 for i in range(1, 50)}}
