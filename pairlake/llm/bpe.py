"""Operator 1: byte-level BPE encoding and decoding through sentencepiece.

A rank file (``base64(token bytes) rank`` per line) is serialised directly as
a sentencepiece BPE model: every token becomes a piece whose characters stand
for its bytes, its score is the negative rank, and normalisation is the
identity.  sentencepiece then merges the adjacent pair of best score, leftmost
first, which is the merge order of the ranks.  Pre-tokens are the matches of
the pattern; one that is itself a token is taken whole, as rank-based encoders
do.  Decoding is the inverse map from id to bytes.

Defined results: a null text encodes like an empty one (no ids, empty bytes);
a text of any length is encoded whole; equal texts give equal rows; other
columns are passed through, and an input column named like an added one is
replaced; an empty table gives an empty table.
"""

import base64
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlake.llm.text import Numbered, arrow_column

# The white space of Unicode (property White_Space).
BLANKS = frozenset("\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                   "\u2028\u2029\u202f\u205f\u3000")
# Below this code point every Unicode version in use agrees on letters and numbers.
STABLE = "ɐ"
RARE = re.compile(f"[^\0-{chr(ord(STABLE) - 1)}]")
MARKS = ".,;:!?"


def byte_characters() -> list[str]:
    """A printable, non-blank character for each byte value: U+0100 + byte."""
    return [chr(0x100 + b) for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece ModelProto (protocol-buffer wire format) of a rank
    table.  Piece 0 is the mandatory unknown piece; token of rank r in rank
    order is piece 1 + position."""
    def varint(n):
        out = bytearray()
        while n >= 0x80:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        return bytes(out) + bytes([n])

    def field(number, payload):  # length-delimited
        return varint(number << 3 | 2) + varint(len(payload)) + payload

    def number(no, n):
        return varint(no << 3) + varint(n)

    chars = byte_characters()
    model = [field(1, field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + number(3, 2))]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = "".join(map(chars.__getitem__, token)).encode()
        model.append(field(1, field(1, piece) + b"\x15" + struct.pack("<f", -float(rank)) + number(3, 1)))
    # TrainerSpec: model_type (3) = BPE (2), vocab_size (4), no bos / eos / pad pieces
    none = (1 << 64) - 1
    trainer = (number(3, 2) + number(4, len(ranks) + 1) + number(40, 0) + number(41, none) + number(42, none)
               + number(43, none))
    # NormalizerSpec: identity, and no dummy prefix, space folding or space escaping
    normalizer = field(1, b"identity") + number(3, 0) + number(4, 0) + number(5, 0)
    return b"".join(model) + field(2, trainer) + field(3, normalizer)


def character_class():
    """``kind(c)`` -> "L", "N", "S" or "O" for a character, as the pattern
    engine of the rank-based encoder sees it: engines carry different Unicode
    versions, so each rare character is asked once and remembered."""
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    engines = [(k, tiktoken.Encoding(f"class-{k}", pat_str=p, mergeable_ranks=single, special_tokens={}))
               for k, p in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s"))]
    known: dict[str, str] = {}

    def kind(c: str) -> str:
        if c not in known:
            known[c] = next((k for k, e in engines if e.encode_ordinary(c)), "O")
        return known[c]

    return kind


# Representatives of the four classes for rare characters (not ASCII, so that
# contractions such as 's stay what they are).
_STAND_IN = {"L": "ñ", "N": "²", "S": "　", "O": "§"}


#: Where texts and chunks may be cut, on samples that other patterns split otherwise: a blank before a non-blank begins
#: a match that takes in a run of letters, and a closing mark stands apart from letters before it.
_CUTS = [("one two", ["one", " two"]), ("oneTwo threeFour", ["oneTwo", " threeFour"]), ("a supercalifragilistic", ["a", " supercalifragilistic"]),
         *[(f"a word{m}", ["a", " word", m]) for m in MARKS], ("x 1234567", ["x", " 1234567"]), ("x §§ñ", ["x", " §§", "ñ"])]


def clean_cuts(pattern: str) -> bool:
    """Whether texts may be cut at blanks and words taken whole under a pattern."""
    find = regex.compile(pattern).findall
    try:
        return all(find(text) == parts for text, parts in _CUTS)
    except TypeError:  # groups
        return False


class PreTokenizer:
    """``split(text)`` -> the pattern's matches, in order."""

    def __init__(self, pattern: str):
        self._pattern, self._kind = regex.compile(pattern), None

    def split(self, text: str) -> list[str]:
        if not RARE.search(text):
            return self._pattern.findall(text)
        if self._kind is None:
            self._kind = character_class()
        alike = text.translate({ord(c): _STAND_IN[self._kind(c)] for c in set(text) if c >= STABLE})
        return [text[m.start():m.end()] for m in self._pattern.finditer(alike)]


class ChunkEncoder:
    """Encode many texts at once, remembering what repeats.

    A blank between two non-blank characters always starts a new match of the
    pattern (it can only be the optional leading blank of one), so texts are
    cut there; the chunks, and the pre-tokens within them, repeat a lot.
    ``split(chunk)`` gives the pre-tokens of a chunk and
    ``encode_words(list, common) -> list of bytes`` their ids as little-endian
    unsigned 32-bit integers, called once for all new pre-tokens of a piece
    (``common``: none holds a rare character).  Two
    generations of remembered chunks bound the memory."""

    def __init__(self, split, encode_words, entries: int = 120_000, max_key: int = 48):
        self._split, self._encode_words, self._entries, self._max_key = split, encode_words, entries, max_key
        self._known: dict[str, bytes] = {}  # ids of a blank and the key; empty: no clean cut beside the key
        self._old: dict[str, bytes] = {}
        self._marks = dict(zip(MARKS, encode_words(list(MARKS)), strict=True))

    def _encode(self, chunks: list[str]) -> list[bytes]:
        tokens = [self._split(c) for c in chunks]
        words = list({w for found in tokens for w in found})
        ids = dict(zip(words, self._encode_words(words), strict=True))
        return [b"".join(map(ids.__getitem__, found)) for found in tokens]

    def _learn(self, common: list[str], rare: set[str]) -> None:
        known, old, marked, other = self._known, self._old, [], []
        if old:
            known.update({p: old[p] for p in common if p in old})
            common = [p for p in common if p not in old]
        words = [p for p in common if p.isalpha()]
        for p in [p for p in common if not p.isalpha()]:
            if not p or p[0] in BLANKS or p[-1] in BLANKS:
                known[p] = b""
            elif p[-1] in MARKS and p[:-1].isalpha():
                marked.append(p)
            else:
                other.append(p)
        for p in rare:
            if not p or p[0] in BLANKS or p[-1] in BLANKS:
                known[p] = b""
            else:
                other.append(p)
        have = set(words)
        words += {p[:-1] for p in marked if p[:-1] not in known and p[:-1] not in have}
        known.update(zip(words, self._encode_words([" " + w for w in words], True), strict=True))
        for p in marked:
            known[p] = known[p[:-1]] + self._marks[p[-1]]
        known.update(zip(other, self._encode([" " + p for p in other]), strict=True))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        return self.encode(pa.array(texts, pa.string())).to_pylist()

    def encode(self, texts: pa.Array) -> pa.Array:
        """Texts -> their ids as bytes.  Arrow cuts, numbers and joins the
        chunks; only those that are new are looked at one by one."""
        if len(self._known) > self._entries:
            self._known, self._old = {}, self._known
        lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
        offsets, numbered = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
        base, chunks, number = offsets[0], numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
        ids = list(map(self._known.get, chunks))
        new = [i for i, x in enumerate(ids) if x is None]
        if new:
            missing = [chunks[i] for i in new]
            rare = {c for c in missing if RARE.search(c)} if RARE.search("".join(missing)) else set()
            self._learn([c for c in missing if c not in rare] if rare else missing, rare)
            for i in new:
                ids[i] = self._known[chunks[i]]
        first = number[offsets[:-1] - base]
        starts = self._encode([chunks[i] for i in first.tolist()])
        # a text is joined from its parts unless one of them has no clean cut beside it
        unclean = np.fromiter((not x for x in ids), bool, len(ids))
        opens = np.fromiter((not c or c[-1] in BLANKS for c in map(chunks.__getitem__, first.tolist())), bool, len(first))
        part = unclean[number]
        part[offsets[:-1] - base] = opens & (np.diff(offsets) > 1)
        plain = np.add.reduceat(part, offsets[:-1] - base) == 0
        picked = number.astype(np.int64)
        picked[offsets[:-1] - base] = len(ids) + np.arange(len(first))
        parts = pa.array([*ids, *starts], pa.binary()).take(pa.array(picked))
        out = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets - base, pa.int32()), parts), b"")
        if not plain.all():
            rows = out.to_pylist()
            for i in np.flatnonzero(~plain).tolist():
                mine = number[offsets[i] - base:offsets[i + 1] - base].tolist()
                rows[i] = self._text([chunks[k] for k in mine], [ids[k] for k in mine], starts[i])
            out = pa.array(rows, pa.binary())
        for c in [chunks[i] for i in new if len(chunks[i]) > self._max_key]:
            self._known.pop(c, None)
        return out

    def _text(self, parts: list[str], ids: list[bytes], start: bytes) -> bytes:
        ids[0] = start
        out, first = [], 0  # parts that meet at an unclean blank are encoded together
        for i in range(1, len(parts) + 1):
            if i == len(parts) or (parts[i - 1] and parts[i - 1][-1] not in BLANKS
                                   and parts[i] and parts[i][0] not in BLANKS):
                if i - first == 1 and first and ids[first]:
                    out.append(ids[first])
                else:
                    out += self._encode([(" " if first else "") + " ".join(parts[first:i])])
                first = i
        return b"".join(out)


class BytePairEncoder:
    """The tokenizer of one rank file; built once per task.
    ``encode(list of texts) -> list of id bytes``."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import sentencepiece

        self._ids = {token: struct.pack("<I", rank) for token, rank in ranks.items()}
        self._of_piece = [b"", *(struct.pack("<I", rank) for rank in sorted(ranks.values()))]
        self._model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self._chars = byte_characters()
        if not clean_cuts(pattern):
            raise ValueError("texts can't be cut at blanks under this pattern: its matches must begin at a blank before a "
                             "non-blank, take a run of letters whole and part it from a mark behind it")
        self.encode = ChunkEncoder(PreTokenizer(pattern).split, self._encode_words, entries=60_000)

    def _encode_words(self, words: list[str], common: bool = False) -> list[bytes]:
        out = [self._ids.get(w.encode()) for w in words]  # a token taken whole
        merged = [i for i, ids in enumerate(out) if ids is None]
        pieces = self._model.encode(["".join(map(self._chars.__getitem__, words[i].encode())) for i in merged],
                                    out_type=int, num_threads=1)
        for i, found in zip(merged, pieces, strict=True):
            out[i] = b"".join(map(self._of_piece.__getitem__, found))
        return out


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Append ``ids``: binary, the token ids of ``text`` as little-endian
    unsigned 32-bit integers (:func:`id_array` turns them into an array)."""
    def kernel():
        encoder = BytePairEncoder(load_ranks(ranks_path), pattern)
        return encoder.encode.encode

    rows = Numbered(df)
    return rows.named(rows.df.withColumn("ids", arrow_column(kernel, "binary")(F.col(rows(text)))), **{ids: "ids"})


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Append ``out``: binary, the bytes of the ids (null ids: empty bytes)."""
    def kernel():
        tokens = {rank: token for token, rank in load_ranks(ranks_path).items()}
        one = lambda raw: b"".join(map(tokens.__getitem__, memoryview(raw or b"").cast("I")))
        return lambda column: pa.array(map(one, column.to_pylist()), type=pa.binary())

    rows = Numbered(df)
    return rows.named(rows.df.withColumn("out", arrow_column(kernel, "binary")(F.col(rows(ids)))), **{out: "out"})


def id_array(df: DataFrame, ids: str = "ids") -> DataFrame:
    """Turn the binary ids into ``array<int>``."""
    def kernel():
        return lambda column: pa.array([None if r is None else np.frombuffer(r, "<u4").astype("i4")
                                        for r in column.to_pylist()], type=pa.list_(pa.int32()))

    rows = Numbered(df)
    return rows.named(rows.df.withColumn(rows(ids), arrow_column(kernel, "array<int>")(F.col(rows(ids)))))
