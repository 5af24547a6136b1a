"""Operator 12: ranked lexical search by NRA (no random access).

Terms are runs of letters, digits and non-ASCII characters, A-Z in lower case.
A query's score of a document sums, over the query's distinct terms, a term
weight (rarer terms weigh more) times a saturating share of the term's count,
damped by the document's length; all in whole numbers.

1. One pass over the documents writes, for every document, its id, its number
   of terms and the counts of the query terms in it, to a table in the shared
   folder; numbers of documents and terms and the terms' document counts are
   sums over that table.
2. Each task cuts its rows of the table into blocks of bounded size.  A block
   has one list a term, its documents by falling impact on the score.  A query
   reads its lists step by step in that order and never looks a document up.
   What a document was read with is the lower end of its score; the upper end
   adds, for each list in which it was not read, the impact at which that list
   stands.  A document whose upper end is below the k-th best lower end is out.
   Reading goes on until no document that is left has an open interval, so the
   membership, all ties and the scores of a block's best are final.
3. The best of all blocks are ranked, first in parts and then as a whole.

Queries are taken in groups of at most ``GROUP_BYTES`` of text (one longer
query is a group of its own), so that the terms sent to the tasks are bounded;
every group runs over all documents.

Defined results: a null or empty text has no terms; such documents do not
count and match nothing; a query without terms has no row; queries that share
an id are one query of all their terms, and queries without id are one; every
row of the documents is a document of its own, equal ids are listed as often as
they score; an id that is missing ranks after all others of its score; columns
that are not named are left out, whatever their names; empty tables give an
empty table.
"""

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pairlake.llm.scratch import written
from pairlake.llm.text import as_bytes, pick, pieces

GROUP_BYTES = 8 << 20  # query text whose terms are sent to the tasks at a time
BLOCK_POSTINGS = 1 << 21  # postings of one block, at most (one document has at most a group's terms)
FIRST_STEP = 64  # postings read of each list in the first step; every step reads twice as many
PARTS = 64  # parts of the first ranking over all blocks

_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
                    for b in range(256))


def terms(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(_TERM_BYTES).split()


def search(docs: DataFrame, queries: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", group_bytes: int = GROUP_BYTES,
           block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """(item_id, rank from 1, doc_id, score): the ``k`` best documents of each
    query with a score above 0, ties by ascending id."""
    rows = pick(docs, doc_id=doc_id, text=text)
    asked = pick(queries, item_id=item_id, text=item_text)
    found = [_search_group(rows, group, asked, k, block_postings) for group in _groups(asked, group_bytes)]
    best = found[0]
    for f in found[1:]:
        best = best.unionByName(f)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = Window.partitionBy("item_id", "part").orderBy(*order)
    whole = Window.partitionBy("item_id").orderBy(*order)
    some = best.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    some = some.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= k).drop("rank", "part")
    return (some.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))


def _groups(asked: DataFrame, group_bytes: int) -> list[list[tuple[object, list[bytes]]]]:
    """The queries (id, distinct terms) in groups of bounded size; the number
    of groups follows from the measured size, and dealing is by the id's hash."""
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = -(-size * 2 // group_bytes) or 1
    dealt = asked.withColumn("g", F.pmod(F.xxhash64("item_id"), F.lit(groups)))
    out = []
    for g in range(groups):
        items: dict[object, dict[bytes, None]] = {}
        for r in dealt.filter(F.col("g") == g).select("item_id", F.encode("text", "utf-8").alias("t")).toLocalIterator():
            items.setdefault(r["item_id"], {}).update(dict.fromkeys(terms(r["t"])))
        out.append([(i, list(t)) for i, t in items.items() if t])
    return out


def _search_group(docs: DataFrame, group: list, asked: DataFrame, k: int, block_postings: int) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    vocabulary: dict[bytes, int] = {}
    items = [(i, [vocabulary.setdefault(t, len(vocabulary)) for t in ts]) for i, ts in group]
    counted = written(_count(docs, sc.broadcast(vocabulary)), "lexical-counts")
    many, total = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
    held = np.zeros(len(vocabulary), np.int64)
    partial = counted.select("terms").mapInArrow(_held(len(vocabulary)), "term int, held bigint")
    for r in partial.groupBy("term").agg(F.sum("held").alias("held")).toLocalIterator():
        held[r["term"]] = r["held"]
    weights = [math.floor(1000 * math.log((2 * many + 2) / (2 * h + 1))) for h in held.tolist()]
    shared = sc.broadcast((items, np.array(weights, np.int64), many, total or 0))
    ids, item_type = docs.schema["doc_id"].dataType, asked.schema["item_id"].dataType
    schema = f"item_id {item_type.simpleString()}, doc_id {ids.simpleString()}, score bigint"
    return counted.mapInArrow(_rank(shared, k, block_postings, to_arrow_type(item_type)), schema)


# --- pass 1: counts of the query terms

def _count(docs: DataFrame, vocabulary) -> DataFrame:
    kind = docs.schema["doc_id"].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value.get
        for batch in batches:
            at = 0
            for piece in pieces(batch.column(1)):
                n, found, times, ends = [], [], [], [0]
                for raw in as_bytes(piece):
                    words = terms(raw)
                    counts = Counter(map(known, words))
                    counts.pop(None, None)
                    n.append(len(words))
                    found += counts
                    times += counts.values()
                    ends.append(len(found))
                ends = pa.array(ends, pa.int32())
                table = pa.table({"doc_id": batch.column(0).slice(at, len(piece)), "n": pa.array(n, pa.int64()),
                                  "terms": pa.ListArray.from_arrays(ends, pa.array(found, pa.int32())),
                                  "times": pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))})
                at += len(piece)
                yield from table.to_batches()

    schema = f"doc_id {kind.simpleString()}, n bigint, terms array<int>, times array<bigint>"
    return docs.select("doc_id", "text").mapInArrow(count, schema).filter("n > 0")


def _held(size: int):
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["term", "held"])
    return held


# --- pass 2: blocks of impact-sorted lists

def _rank(shared, k: int, block_postings: int, item_type: pa.DataType):
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, many, total = shared.value
        for block in _blocks(batches, block_postings):
            ids, lists = block.column("doc_id").combine_chunks(), _Lists(block, weights, many, total)
            item, doc, score = [], [], []
            for i, ts in items:
                best, scores = lists.top(ts, k, ids)
                item += [i] * len(best)
                doc.append(best)
                score.append(scores)
            yield pa.RecordBatch.from_arrays([
                pa.array(item, item_type), ids.take(pa.array(np.concatenate(doc) if doc else [], pa.int64())),
                pa.array(np.concatenate(score) if score else [], pa.int64())], ["item_id", "doc_id", "score"])
    return rank


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    kept, size = [], 0
    for batch in batches:
        ends = np.cumsum(np.diff(batch.column("terms").offsets.to_numpy()))
        start, before = 0, 0
        while start < len(batch):
            stop = max(int(np.searchsorted(ends, before + most - size, side="right")), start + (not kept))
            if stop > start:
                kept.append(batch.slice(start, stop - start))
                size, before, start = size + int(ends[stop - 1]) - before, int(ends[stop - 1]), stop
            if start < len(batch):
                yield pa.Table.from_batches(kept)
                kept, size = [], 0
    if kept:
        yield pa.Table.from_batches(kept)


class _Lists:
    """A block's documents by term, by falling impact."""

    def __init__(self, block: pa.Table, weights: np.ndarray, many: int, total: int):
        self.size = len(block)
        length = block["n"].to_numpy()
        lists = block["terms"].combine_chunks()
        times = block["times"].combine_chunks().flatten().to_numpy()
        term = lists.flatten().to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(self.size, dtype=np.int64), np.diff(lists.offsets.to_numpy()))
        damp = 20 * (50 + (50 * length * many) // max(total, 1))
        impact = weights[term] * ((1_000_000_000 * times) // (1000 * times + damp[doc]))
        order = np.lexsort((-impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.start = np.searchsorted(term[order], np.arange(len(weights) + 1))

    def top(self, terms: list[int], k: int, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the ``k`` best documents with a score above 0."""
        at = [(int(self.start[t]), int(self.start[t + 1])) for t in terms]
        at = [(a, b) for a, b in at if a < b]
        low = np.zeros(self.size, np.int64)
        place = np.arange(self.size)  # of a document among those that are left, -1: out
        left = np.arange(self.size)
        seen = np.zeros((len(at), self.size), bool)
        read, step = 0, FIRST_STEP
        while at:
            bounds = np.zeros(len(at), np.int64)
            for i, (a, b) in enumerate(at):
                docs, impact = self.doc[a + read:min(a + read + step, b)], self.impact[a + read:min(a + read + step, b)]
                where = place[docs]
                inside = where >= 0
                low[docs[inside]] += impact[inside]
                seen[i, where[inside]] = True
                if a + read + step < b:
                    bounds[i] = self.impact[a + read + step]
            read, step = read + step, step * 2
            open_to = bounds.sum() - np.einsum("i,ij->j", bounds, seen)
            lower = low[left]
            kth = np.partition(lower, len(lower) - k)[len(lower) - k] if len(lower) >= k else 0
            stay = (lower + open_to >= max(kth, 1))
            if not stay.all():
                place[left[~stay]] = -1
                left, seen, open_to = left[stay], seen[:, stay], open_to[stay]
                place[left] = np.arange(len(left))
            if not open_to.any():
                break
        left = left[low[left] > 0]
        scores = low[left]
        if len(left) > k:  # ties at the k-th place go to the smaller id
            kth = np.partition(scores, len(scores) - k)[len(scores) - k]
            sure, tied = left[scores > kth], left[scores == kth]
            by_id = pc.sort_indices(ids.take(pa.array(tied)), null_placement="at_end").to_numpy()
            left = np.concatenate([sure, tied[by_id[:k - len(sure)]]])
            scores = low[left]
        return left, scores
