"""Byte-level BPE (op 1) and token files (op 6) against the plain libraries."""

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import types as T
from tokenizers import Tokenizer

from pairlake.llm import bpe, tokenfile
from pairlake.llm.scratch import scratch_path

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
MESSY = list("abc s'tre 12.,!\n\t\r  \x00\x1c　\x85\xa0​漢字é²½一か🙂𐐀՘֋'ve'll ") + ["<|endoftext|>", "the ", "  "]


def messy_texts(n=300, seed=1):
    draw = random.Random(seed)
    out = [None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "x" * 5000, "ab " * 2000, "漢" * 300, "1" * 400]
    for i in range(n):
        if i % 3:
            out.append("".join(draw.choice(MESSY) for _ in range(draw.randint(0, 80))))
        else:
            out.append("".join(chr(draw.choice([draw.randrange(1, 0x300), draw.randrange(0x300, 0xD800),
                                                draw.randrange(0x10000, 0x20000)])) for _ in range(20)))
    return out + out[5:9]


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_encode_equals_rank_encoder_and_decodes_back(spark, plain):
    texts = messy_texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, IDS string")
    rows = bpe.decode(bpe.encode(df, RANKS, PATTERN), RANKS).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        want = plain.encode_ordinary(text)
        assert bytes(r["ids"]) == struct.pack(f"<{len(want)}I", *want)
        assert bytes(r["decoded"]) == text.encode()
    assert set(rows[0].asDict()) == {"doc_id", "text", "ids", "decoded"}  # the clashing column is replaced


def test_id_array_and_empty_table(spark, plain):
    df = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in bpe.id_array(bpe.encode(df, RANKS, PATTERN)).collect()}
    assert got == {1: plain.encode_ordinary("some text"), 2: []}
    assert bpe.decode(bpe.encode(df.limit(0), RANKS, PATTERN), RANKS).collect() == []


@pytest.mark.parametrize("n", [0, 1, 59, 60, 61, 4095, 4096, 4097, 9000])
@pytest.mark.parametrize("most", [1, 2, 300, 50_000, 2**32, 2**60, 2**63])
def test_pack_round_trip(n, most):
    ids = np.random.default_rng(n).integers(0, most, n, dtype=np.uint64) * np.uint64(1 + (most == 2**63))
    words, offsets, escapes = tokenfile.pack(ids)
    assert (tokenfile.unpack(words, offsets, escapes, n) == ids).all()
    if n and most == 2:
        assert len(words) * 60 <= n + 60 * len(offsets)  # sixty one-bit ids a word


def token_rows(spark, df, encoder):
    path = scratch_path(spark, "test-tokens")
    tokenfile.write_tokens(df, path, encoder, end_id=2)
    fields = T.StructType([T.StructField("crc", T.LongType())])
    return tokenfile.read_tokens(spark, path, lambda ids: (zlib.crc32(ids.tobytes()),), fields).collect()


def test_file_round_trip_in_order(spark, monkeypatch):
    texts = messy_texts(120, seed=2)
    df = spark.createDataFrame([(7 * i - 300, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, part int")
    plain = Tokenizer.from_file(VOCABULARY)
    plain.encode_special_tokens = True
    start = 0
    want = []
    for i, t in enumerate(texts):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((7 * i - 300, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    vocabulary = VOCABULARY
    got = token_rows(spark, df.repartition(5), lambda: tokenfile.library_encoder(vocabulary))
    assert sorted(tuple(r) for r in got) == want


def test_word_encoder_is_the_library_on_every_kind_of_cut():
    parts = ["word", "Straße", "end.", "a.b", ".", "don't", "'s", "I'm", "12", "3456", "ab,", "\n", " ", "  ", "", "\x85", "\u180e",
             "\u200b", "\x1c", "\u3000", "中文", "é", "e\u0301", "²", "🙂", "<|endoftext|>", "\0", "x\ny"]
    draw = random.Random(3)
    texts = [draw.choice(["", " "]).join(draw.choice(parts) for _ in range(draw.randint(0, 12))) for _ in range(4000)]
    texts += ["word. " * 3000 + " word", None, *(f"{a} {b}" for a in parts for b in parts)]
    plain = Tokenizer.from_file(VOCABULARY)
    plain.encode_special_tokens = True
    encoder = tokenfile.WordEncoder(VOCABULARY)
    want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    assert encoder(texts) == want
    column = pa.array(texts)
    assert encoder.encode(column.slice(17, 400)).to_pylist() == want[17:417]
    assert encoder([]) == [] and encoder([None]) == [b""]


def test_file_edges(spark):
    def encoder():
        return lambda texts: [struct.pack(f"<{len(t or '')}I", *map(ord, t or "")) for t in texts]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_rows(spark, empty, encoder) == []
    rows = spark.createDataFrame([(None, "b"), (4, "a" * 100_000), (4, "a" * 100_000), (5, None)],
                                 "doc_id long, text string")
    got = [(r["doc_id"], r["start"], r["n_tokens"]) for r in token_rows(spark, rows, encoder)]
    assert sorted(got, key=lambda r: r[1]) == [(None, 0, 2), (4, 2, 100_001), (4, 100_003, 100_001), (5, 200_004, 1)]


@pytest.mark.parametrize("pattern", [r"\S+|\s+", r"..?", r"[A-Z]?[a-z]+| ?[^a-zA-Z]+|[A-Z]", r" ?\p{L}+|\p{N}{1,3}|[^\p{L}\p{N}]+", r"(a)|."])
def test_patterns_without_clean_cuts_are_refused(pattern):
    with pytest.raises(ValueError, match="cut at blanks"):
        bpe.BytePairEncoder({bytes([b]): b for b in range(256)}, pattern)
    assert bpe.clean_cuts(PATTERN)
