"""Operator 6: token ids in a compact binary file, Simple-8b words.

File format: a folder of Parquet files written by Spark's committed writer,
one row per *block*, in ascending document order inside a ``part`` and over
the parts.  A block holds whole documents:

==============  ==========================================================
part, block     position of the block
first           ids before it in its part
doc_ids         the documents, in order
lengths         their id counts, end id included
words           packed 64-bit little-endian words
word_offsets    first word of each run of ``RUN`` ids, so any run can be
                decoded alone; the last entry is the number of words
escapes         the ids of 2**60 and more, which an escape word points to
==============  ==========================================================

A word has a 4-bit selector in its top bits and then ``count`` values of
``bits`` bits, lowest first (``SELECTORS``).  The last word of a run is padded
with zeros.

Defined results: a null text is empty, so its document has the end id alone;
repeated documents are written as often as they occur, in the order of id and
then text; a null document id comes first; a document of any length lies in
one block; columns other than id and text are not read; an empty table gives
an empty folder with the schema.
"""

import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlake.llm.bpe import BLANKS, MARKS
from pairlake.llm.text import pick, pieces
from pairlake.operators.index import pin

RUN = 4096  # ids coded on their own
PIECE = 16 << 20  # bytes of text encoded at a time; the more, the fewer chunks are encoded twice
BLOCK_IDS = 65_536  # a block closes at the first document end after so many ids
#: (ids per word, bits per id) by selector; selector 15 is the escape, 14 is free.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20),
             (2, 30), (1, 60))
ESCAPE = 15
_COUNT = [n for n, _ in SELECTORS] + [1, 1]
_LIMITS = np.array([1 << k for k in range(64)], dtype=np.uint64)
_WIDTH = np.array([k.bit_length() for k in range(1 << 16)], dtype=np.uint8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unsigned ids -> (words, word offset of each run, escaped ids)."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    runs = -(-len(ids) // RUN)
    grid = np.zeros((runs, RUN + 60), dtype=np.uint64)
    full = np.zeros(runs * RUN, np.uint64)
    full[:len(ids)] = ids
    grid[:, :RUN] = full.reshape(runs, RUN)
    if len(ids) and ids.max() >= len(_WIDTH):
        bits = np.searchsorted(_LIMITS, grid.ravel(), side="right").astype(np.uint8).reshape(grid.shape)
    else:
        bits = _WIDTH[grid.astype(np.uint16)]
    widest = {1: bits}  # over the next n ids; built from shorter stretches
    choice = np.where(bits > 60, ESCAPE, len(SELECTORS) - 1).astype(np.uint8)
    for s in range(len(SELECTORS) - 2, -1, -1):
        n, b = SELECTORS[s]
        half = max(k for k in widest if k <= n)
        rest = min(k for k in widest if half + k >= n)
        m = widest[half].copy()
        np.maximum(m[:, :m.shape[1] - (n - rest)], widest[rest][:, n - rest:], out=m[:, :m.shape[1] - (n - rest)])
        widest[n] = m
        choice[m <= b] = s
    starts, offsets = [], [0]
    for r in range(runs):
        row, i, end = choice[r].tobytes(), 0, min(RUN, len(ids) - r * RUN)
        base = r * (RUN + 60)
        while i < end:
            starts.append(base + i)
            i += _COUNT[row[i]]
        offsets.append(len(starts))
    at = np.array(starts, dtype=np.int64)
    flat, chosen = grid.ravel(), choice.ravel()[at]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s, (n, b) in enumerate(SELECTORS):
        mine = np.flatnonzero(chosen == s)
        if len(mine):
            values = flat[at[mine][:, None] + np.arange(n)] << (np.arange(n, dtype=np.uint64) * np.uint64(b))
            words[mine] |= np.bitwise_or.reduce(values, axis=1)
    mine = np.flatnonzero(chosen == ESCAPE)
    words[mine] |= np.arange(len(mine), dtype=np.uint64)
    return words, np.array(offsets, dtype=np.int32), flat[at[mine]]


def unpack(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of a block."""
    runs = len(offsets) - 1
    grid = np.zeros((runs, RUN + 60), dtype=np.uint64)
    flat = grid.ravel()
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = np.array(_COUNT, dtype=np.int64)[selector]
    before = np.cumsum(count) - count
    run = np.repeat(np.arange(runs), np.diff(offsets))
    at = before - before[offsets[:-1]][run] + run * (RUN + 60) if len(words) else before
    for s, (k, b) in enumerate(SELECTORS):
        mine = np.flatnonzero(selector == s)
        if len(mine):
            shifted = words[mine][:, None] >> (np.arange(k, dtype=np.uint64) * np.uint64(b))
            flat[at[mine][:, None] + np.arange(k)] = shifted & np.uint64((1 << b) - 1)
    mine = np.flatnonzero(selector == ESCAPE)
    flat[at[mine]] = escapes[(words[mine] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return grid[:, :RUN].ravel()[:n]


#: Characters that some version of Unicode or some engine takes for white space; a chunk that begins or ends with one is
#: encoded together with its neighbours.
_EDGES = "".join(sorted(BLANKS | set("\x1c\x1d\x1e\x1f\u180e\u200b\u200c\u200d\u2060\ufeff")))
#: Runs of letters on which all versions agree, and a mark that stands apart from them.
_WORD = "^[A-Za-zªµºÀ-ÖØ-öø-ɏ]+[.,;:!?]?$"
_AT_ONCE = 20_000  # distinct chunks in one call of the library


class WordEncoder:
    """Texts -> ids by a byte-level BPE tokenizer of the tokenizers library,
    each distinct chunk of a piece of texts once.

    A blank between two non-blank characters always starts a new match of the
    library's pattern, so texts are cut there, and no token but a chunk's first
    begins with a blank: many chunks go to the library as one text, and the ids
    of each are told by the blanks that tokens begin with.  Runs of letters, with
    or without a closing mark, are pre-tokens already and skip the pattern.
    The strings of special tokens in a text are ordinary text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        self._library = Tokenizer.from_file(path)
        self._library.encode_special_tokens = True
        # the library's byte alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = iter(range(0x100, 0x200))
        self._alphabet = {b: chr(b) if b in own else chr(next(others)) for b in range(256)}
        blank = self._alphabet[0x20]
        self._merges = Tokenizer(self._library.model)  # pre-tokens in the byte alphabet, cut before each blank
        self._merges.pre_tokenizer = Split(blank, "merged_with_next")
        vocabulary = self._library.get_vocab()
        self._opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self._opens[[i for token, i in vocabulary.items() if token[:1] == blank]] = True
        self._marks = self._apart(list(MARKS))

    def _apart(self, texts: list[str]) -> pa.Array:
        """Ids of each text by itself."""
        found = self._library.encode_batch_fast(texts, add_special_tokens=False)
        return pa.array([np.array(x.ids, "<u4").tobytes() for x in found], pa.binary())

    def _chunks(self, chunks: pa.Array, words: bool) -> pa.Array:
        """Ids of a blank and each chunk; ``words``: they are runs of letters."""
        found = [pa.array([], pa.binary())]
        for at in range(0, len(chunks), _AT_ONCE):
            mine = chunks.slice(at, _AT_ONCE)
            text = " " + pc.binary_join(pa.ListArray.from_arrays([0, len(mine)], mine), " ")[0].as_py()
            if words:
                text, library = text.encode().decode("latin-1").translate(self._alphabet), self._merges
            else:
                library = self._library
            ids = np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            starts = np.flatnonzero(self._opens[ids])
            if len(starts) != len(mine):
                raise ValueError("a chunk is not told by the blank before it under this tokenizer")
            offsets = np.r_[starts, len(ids)].astype("i4") * np.int32(4)
            found.append(pa.BinaryArray.from_buffers(pa.binary(), len(mine), [
                None, pa.py_buffer(offsets), pa.py_buffer(ids)]))
        return pa.concat_arrays(found)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        return self.encode(pa.array(texts, pa.string())).to_pylist()

    def encode(self, texts: pa.Array) -> pa.Array:
        """Texts (null: empty) -> their ids as bytes."""
        if not len(texts):
            return pa.array([], pa.binary())
        texts = pc.fill_null(texts, "")
        lists = pc.split_pattern(texts, " ")
        offsets, numbered = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
        offsets = offsets - offsets[0]
        chunks, number = numbered.dictionary, numbered.indices.to_numpy()
        size = pc.binary_length(chunks)
        first_clean = pc.equal(pc.binary_length(pc.utf8_ltrim(chunks, _EDGES)), size)
        last_clean = pc.and_(pc.equal(pc.binary_length(pc.utf8_rtrim(chunks, _EDGES)), size), pc.greater(size, 0))
        clean = np.asarray(pc.and_(first_clean, last_clean))
        simple = np.asarray(pc.match_substring_regex(chunks, _WORD)) & clean
        # ids of the distinct chunks: words with and without a mark, then the others, then none for unclean ones
        marked = chunks.filter(pa.array(simple))
        bare = pc.utf8_rtrim(marked, MARKS)
        words = bare.dictionary_encode()
        word_ids = self._chunks(words.dictionary, True).take(words.indices)
        mark = pc.utf8_slice_codeunits(marked, -1)
        mark_ids = self._marks.take(pc.index_in(mark, pa.array(list(MARKS))))
        simple_ids = pc.binary_join_element_wise(word_ids, pc.fill_null(mark_ids, b""), pa.scalar(b"", pa.binary()))
        other = clean & ~simple
        other_ids = self._chunks(chunks.filter(pa.array(other)), False)
        known = pa.concat_arrays([simple_ids, other_ids, pa.array([b""], pa.binary())])
        place = np.full(len(chunks), len(known) - 1)
        place[simple] = np.arange(len(simple_ids))
        place[other] = len(simple_ids) + np.arange(len(other_ids))
        # the first chunk of a text has no blank before it
        opening = number[offsets[:-1]]
        distinct, which = np.unique(opening, return_inverse=True)
        starts = self._apart(chunks.take(pa.array(distinct)).to_pylist())
        picked = place[number]
        picked[offsets[:-1]] = len(known) + which
        out = pc.binary_join(pa.ListArray.from_arrays(
            pa.array(offsets, pa.int32()), pa.concat_arrays([known, starts]).take(pa.array(picked))), b"")
        # texts with a chunk that has no clean cut beside it: such chunks go with their neighbours
        unclean = ~clean[number]
        unclean[offsets[:-1]] = ~np.asarray(last_clean)[opening] & (np.diff(offsets) > 1)
        rows = np.flatnonzero(np.add.reduceat(unclean, offsets[:-1]))
        if len(rows):
            mended = pa.array(self._mended(texts.take(pa.array(rows)).to_pylist()), pa.binary())
            mask = np.zeros(len(texts), bool)
            mask[rows] = True
            out = pc.replace_with_mask(out, pa.array(mask), mended)
        return out

    def _mended(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, cut only where a blank stands between characters
        that are surely not white space; each distinct stretch once."""
        import regex

        edge = regex.escape(_EDGES, special_only=True)
        cut = regex.compile(f"(?<=[^{edge}]) (?=[^{edge}])")
        split = [cut.split(t) for t in texts]
        numbers: dict[str, int] = {}
        for parts in split:
            for part in parts[1:]:
                numbers.setdefault(part, len(numbers))
        ids = self._apart([" " + part for part in numbers]).to_pylist()
        return [b"".join([start, *[ids[numbers[p]] for p in parts[1:]]])
                for start, parts in zip(self._apart([parts[0] for parts in split]).to_pylist(), split, strict=True)]


@lru_cache(maxsize=1)
def library_encoder(path: str) -> WordEncoder:
    """One per Python worker."""
    return WordEncoder(path)


def _block_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()),
        T.StructField("first", T.LongType()), T.StructField("doc_ids", T.ArrayType(id_type)),
        T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("words", T.BinaryType()),
        T.StructField("word_offsets", T.ArrayType(T.IntegerType())), T.StructField("escapes", T.BinaryType())])


def write_tokens(df: DataFrame, path: str, make_encoder, end_id: int, doc_id: str = "doc_id",
                 text: str = "text") -> None:
    """Encode every text, append ``end_id`` and write the blocks to ``path`` in
    ascending order of ``doc_id``.  ``make_encoder()`` runs once per task and
    returns ``encode(list of texts) -> list of little-endian uint32 bytes``.

    One range shuffle of (id, text); encoding and packing follow it in the same
    task, so nothing is encoded twice and the writer commits whole tasks."""
    rows = pick(df, id=doc_id, text=text)
    schema = _block_schema(rows.schema["id"].dataType)

    def blocks(batches):
        encode, end = make_encoder(), struct.pack("<I", end_id)
        from_arrow = encode.encode if isinstance(encode, WordEncoder) else None
        part, block, first = TaskContext.get().partitionId(), 0, 0
        ids, docs, lengths, n = [], [], [], 0

        def row():
            words, offsets, escapes = pack(np.frombuffer(b"".join(ids), "<u4"))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()),
                 pa.ListArray.from_arrays([0, len(docs)], pa.concat_arrays(docs).cast(kind)),
                 pa.array([lengths], pa.list_(pa.int64())), pa.array([words.astype("<u8").tobytes()], pa.binary()),
                 pa.array([offsets], pa.list_(pa.int32())), pa.array([escapes.astype("<u8").tobytes()], pa.binary())],
                names=schema.names)

        for batch in batches:
            at, kind = 0, batch.column(0).type
            for piece in pieces(batch.column(1), PIECE):
                for raw in from_arrow(piece).to_pylist() if from_arrow else encode(piece.to_pylist()):
                    ids += [raw, end]
                    docs.append(batch.column(0).slice(at, 1))
                    lengths.append(len(raw) // 4 + 1)
                    n += lengths[-1]
                    at += 1
                    if n >= BLOCK_IDS:
                        yield row()
                        block, first = block + 1, first + n
                        ids, docs, lengths, n = [], [], [], 0
        if docs:
            yield row()

    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    ordered.mapInArrow(blocks, schema).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str, kernel, fields: T.StructType, doc_id: str = "doc_id") -> DataFrame:
    """Decode the blocks: one row per document with ``doc_id``, ``start`` (ids
    of all documents before it), ``n_tokens`` and the fields that
    ``kernel(ids) -> tuple`` computes from its ids (uint32 array)."""
    table = spark.read.parquet(path)
    id_type = table.schema["doc_ids"].dataType.elementType
    parts = pin(table.groupBy("part").agg(F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)")).alias("_n")))
    # a row per file part: its ids, then the ids of the parts before it, summed in groups of parts
    wide = parts.withColumn("_g", F.floor(F.sqrt("part")))
    inside = Window.partitionBy("_g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    groups = wide.groupBy("_g").agg(F.sum("_n").alias("_n"))  # as many as the square root of the parts
    above = groups.select(F.col("_g").alias("_h"), "_n")
    earlier = groups.select("_g").join(F.broadcast(above), F.col("_h") < F.col("_g"), "left").groupBy("_g").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("_far"))
    bases = wide.withColumn("_near", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(earlier, "_g").select(
        "part", (F.col("_near") + F.col("_far")).alias("_base"))
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField(doc_id, id_type),
                           T.StructField("_at", T.LongType()), T.StructField("n_tokens", T.LongType()), *fields.fields])

    def documents(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part, _, first, docs, lengths, words, offsets, escapes = (c[i] for c in batch.columns)
                sizes = np.array(lengths.as_py(), dtype=np.int64)
                ids = unpack(np.frombuffer(words.as_py(), "<u8"), np.array(offsets.as_py()),
                             np.frombuffer(escapes.as_py(), "<u8"), int(sizes.sum())).astype("<u4")
                ends = np.cumsum(sizes)
                found = [kernel(ids[e - k:e]) for e, k in zip(ends, sizes, strict=True)]
                columns = [pa.array([part.as_py()] * len(sizes), pa.int32()), docs.values,
                           pa.array(first.as_py() + ends - sizes), pa.array(sizes)]
                columns += [pa.array(c) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    decoded = table.select("part", "block", "first", "doc_ids", "lengths", "words", "word_offsets", "escapes")
    return (decoded.mapInArrow(documents, schema).join(bases, "part")
            .select(doc_id, (F.col("_at") + F.col("_base")).alias("start"), "n_tokens",
                    *[F.col(f.name) for f in fields.fields]))
