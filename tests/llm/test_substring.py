"""Substring dedup (op 9) against all windows, and the suffix automaton."""

import random

import pytest

from pairlake.llm import substring


def brute(rows, length):
    least = {}
    for d, t in rows:
        w = (t or "").split()
        for i in range(len(w) - length + 1 if d is not None else 0):
            g = tuple(w[i:i + length])
            least[g] = min(least.get(g, d), d)
    out = []
    for d, t in rows:
        w, gone = (t or "").split(), set()
        for i in range(len(w) - length + 1 if d is not None else 0):
            if least[tuple(w[i:i + length])] < d:
                gone |= set(range(i, i + length))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def table(seed):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    base = [draw.choice(words) for _ in range(400)]
    rows = []
    for d in range(60):
        parts = []
        for _ in range(draw.randint(0, 4)):
            kind = draw.random()
            if kind < 0.5:
                a = draw.randint(0, 380)
                parts += base[a:a + draw.randint(1, 40)]
            elif kind < 0.6:
                parts += ["z"] * draw.randint(1, 30)
            elif kind < 0.7:
                parts += base[100:112]  # a passage that many quote
            else:
                parts += [draw.choice(words) for _ in range(draw.randint(1, 15))]
        rows.append((draw.choice([d, d, d + 1]), draw.choice([" ", "\n", " \t"]).join(parts) + draw.choice(["", " "])))
    return rows + [(None, rows[1][1]), (100, None), (101, ""), (-5, rows[2][1]), rows[3], rows[4],
                   (200, " ".join(base * 20))]


@pytest.mark.parametrize("shard_pieces", [substring.SHARD_PIECES, 3])
@pytest.mark.parametrize(("seed", "length"), [(5, 6), (8, 12)])
def test_equals_all_windows(spark, seed, length, shard_pieces):
    rows = table(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string")
    got = substring.remove_repeats(df, length, shard_pieces=shard_pieces).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, length)


@pytest.mark.parametrize("shard_pieces", [2, 40])
def test_a_phrase_quoted_everywhere_is_split_by_further_anchors(spark, shard_pieces):
    draw = random.Random(4)
    phrase = [f"p{i}" for i in range(9)]
    rows = []
    for d in range(150):  # the phrase in surroundings of their own, some of which repeat, and a text of one period
        around = [f"v{draw.randrange(d // 3 + 1)}x{i}" for i in range(6)]
        rows.append((d, " ".join(around[:draw.randint(0, 6)] + phrase + around[draw.randint(0, 6):] + ["a", "b", "a"] * (d % 9))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.remove_repeats(df, 12, shard_pieces=shard_pieces).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 12)


def test_further_anchors_belong_to_the_windows_words():
    words = [b"w%d" % (i * i % 37) for i in range(70)]
    text = substring.Windows(b" ".join(words))
    used = []
    for _ in range(7):  # windows of 14 words hold 7 grams
        anchors = {}
        for a, first, wins, _ in text.runs(14, used):
            for i in range(first, first + wins):
                assert anchors.setdefault(tuple(words[i:i + 14]), a) == a
        new = set(anchors.values()) - {-1}  # -1: no gram is left
        assert not new & set(used)
        used += sorted(new)
    assert {a for a, *_ in text.runs(14, used)} == {-1}


def test_automaton_gives_longest_matches():
    draw = random.Random(2)
    for _ in range(60):
        known = [[draw.choice("abc") for _ in range(draw.randint(0, 25))] for _ in range(3)]
        automaton = substring.SuffixAutomaton()
        for words in known:
            automaton.add(words)
        text = [draw.choice("abcd") for _ in range(30)]
        parts = {tuple(k[i:j]) for k in known for i in range(len(k)) for j in range(i + 1, len(k) + 1)} | {()}
        want = [max(n for n in range(e + 2) if tuple(text[e + 1 - n:e + 1]) in parts) for e in range(len(text))]
        assert automaton.matches(text) == want


def test_empty_table(spark):
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
