"""Prefix trie (op 13) against a dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest

from pairlake.llm import queries, trie


def brute(sequences):
    """Rows a node from {conversation: [(role, text)]}."""
    members = {}
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    rows = []
    for p, m in members.items():
        below = [q for q in members if q[:len(p)] == p]
        kids = {q[:-1] for q in members if q}
        ends = sorted(c for c in m if len(sequences[c]) == len(p))
        rows.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), sum(len(q) == len(p) + 1 for q in below),
                     sum(q not in kids for q in below),
                     sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q),
                     hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(rows, key=str)


def sequences_of(rows):
    out = {}
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "")):
        out.setdefault(c, []).append((r or "", x or ""))
    return out


def rebuild(own):
    out = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + s[h:]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def plain(spark, rows, most=trie.MOST_NODES):
    turns = trie.digest_turns(frame(spark, rows))
    lengths = turns.groupBy("conv_id").agg({"length": "max"}).toDF("conv_id", "length")
    return sorted((tuple(r) for r in trie.prefix_trie(turns, lengths, most).collect()), key=str)


def random_rows(seed, n=60, deep=9):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        hot = rng.random() < 0.5
        for t in range(rng.randrange(1, deep)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if not hot else "user", "é" * rng.randrange(3) if not hot else f"hot{min(t, 3)}"))
    return rows


@pytest.mark.parametrize("most", [1, 5, 40, 1 << 15])
def test_rounds_and_tasks_agree_with_brute_force(spark, most):
    rows = random_rows(most)
    assert plain(spark, rows, most) == brute(sequences_of(rows))


def test_long_path_and_broad_hub(spark):
    rows = [(0, t, "user", f"{t}") for t in range(300)] + [(c, 0, "user", f"hub{c}") for c in range(1, 200)]
    rows += [(c, t, "user", f"{t}") for c in (300, 301) for t in range(150 + c % 2)]
    assert plain(spark, rows, 64) == brute(sequences_of(rows))


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [(1, None, None, None), (1, 0, "user", "a"), (2, None, "", ""), (2, 5, "user", "a"), (None, 0, "user", "a"),
            (None, None, None, None), (3, 0, "user", "x" * 200_000), (4, 0, "user", "x" * 200_000), (4, 0, "user", "x" * 200_000),
            (-7, 1, "b", "t"), (-7, 1, "a", "t")]
    assert plain(spark, rows) == brute(sequences_of(rows))
    assert plain(spark, rows[:0]) == [] and plain(spark, [(None, 0, "u", "t")]) == []


def test_query_rebuilds(spark, tmp_dir):
    rows = random_rows(7, n=200, deep=12)
    rows = [r for r in rows if r[0] % 5 or r[0] % 3]  # some conversations have no base
    frame(spark, rows).write.parquet(f"{tmp_dir}/conversations.parquet")
    got = sorted((tuple(r) for r in queries.QUERIES["op13_prefix_trie"](spark, tmp_dir).collect()), key=str)
    want = brute(rebuild(sequences_of(rows)))
    assert got == want and any(not s for s in rebuild(sequences_of(rows)).values())


def test_clashing_names(spark):
    df = frame(spark, random_rows(3)).selectExpr("*", "1 as node", "2 as place", "3 as a", "4 as top", "5 as `x.y`", "6 as Role")
    a = sorted(map(tuple, trie.digest_turns(df).collect()))
    assert a == sorted(map(tuple, trie.digest_turns(frame(spark, random_rows(3))).collect()))


def test_subtree_sums():
    rng = random.Random(1)
    for n in (1, 2, 7, 300):
        parents = [-1, *(rng.randrange(max(0, i - 3), i) for i in range(1, n))]
        depth = [0] * n
        for i in range(1, n):
            depth[i] = depth[parents[i]] + 1
        order = sorted(range(n), key=depth.__getitem__)
        place = {v: i for i, v in enumerate(order)}
        parents = [place.get(parents[v], -1) if parents[v] >= 0 else -1 for v in order]
        values = [(rng.randrange(5), rng.randrange(1 << 40)) for _ in range(n)]
        want = [list(v) for v in values]
        for i in range(n - 1, 0, -1):
            want[parents[i]][0] += want[i][0]
            want[parents[i]][1] += want[i][1]
        assert trie.subtree_sums(parents, values) == want
