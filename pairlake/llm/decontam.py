"""Operator 5: benchmark decontamination by a broadcast hash set of n-grams.

Benchmark items are normalised to words (A-Z in lower case; everything but
letters, digits and non-ASCII characters separates) and cut into windows of
``n`` words; an item of fewer words is one window.  The windows form a hash set
of word-number tuples, which is broadcast; each task walks the word windows of
its documents.  A window all of whose words are benchmark words is looked up
and so verified word by word.  Hit words, matching items and word spans come
back, and documents or spans are removed.

The size of the benchmark is measured before anything is broadcast: items are
dealt to as many sets as keep each below ``SET_BYTES`` of text.  The first set
is scanned where the documents are; every further one reads the documents once
more and passes on only the texts that it hits, which are joined to the
documents by the hash of the text, so nothing of the corpus is written.

Defined results: a null text has no words; an item without words has no
window; an item without id marks words but is not listed; repeated items and
ids count once; other columns are passed through, one named like an added
column is replaced by ``contamination`` and kept by ``decontaminate``; an empty
table gives an empty table, and an empty benchmark no hits.
"""

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pairlake.llm.text import Numbered, arrow_column, as_bytes, pick

ADDED = ("n_words", "n_hit", "items", "hits")
SET_BYTES = 16 << 20  # benchmark text in one broadcast hash set, at most (one longer item is a set of its own)

_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
                    for b in range(256))


def normalised_words(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(_WORD_BYTES).split()


class NgramSet:
    """The windows of some items, by their length."""

    def __init__(self, items: list[tuple[object, bytes | None]], n: int):
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        self.windows: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for number, (_, raw) in enumerate(items):
            words = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in normalised_words(raw)]
            size = min(n, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                self.windows.setdefault(size, {}).setdefault(tuple(words[i:i + size]), set()).add(number)

    def scan(self, raw: bytes | None) -> tuple[int, np.ndarray, set]:
        """(words, mask of hit words, item ids)."""
        words = normalised_words(raw)
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words], dtype=np.int64)
        edge = np.zeros(len(words) + 1, np.int64)  # +1 where a hit begins, -1 after its end
        foreign = np.r_[0, np.cumsum(ids < 0)]
        items: set[int] = set()
        for size, known in self.windows.items():
            for i in np.flatnonzero(foreign[size:] == foreign[:-size]).tolist():
                found = known.get(tuple(ids[i:i + size].tolist()))
                if found:
                    edge[i] += 1
                    edge[i + size] -= 1
                    items |= found
        return len(words), np.cumsum(edge[:-1]) > 0, {self.ids[k] for k in items}


def _spans(mask: np.ndarray) -> list[dict]:
    at = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return [{"first": int(a), "last": int(b) - 1} for a, b in zip(at[::2], at[1::2], strict=True)]


def _sets(asked: DataFrame, set_bytes: int) -> list[list[tuple]]:
    """The items (i, t) dealt to sets of bounded size; the number of sets
    follows from the measured size."""
    items = asked.select("i", F.encode("t", "utf-8").alias("t"))
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    sets = -(-total * 2 // set_bytes) or 1  # half full on average, as dealing is by hash
    dealt = items.distinct().withColumn("s", F.pmod(F.xxhash64("i", "t"), F.lit(sets)))
    return [[(r["i"], r["t"]) for r in dealt.filter(F.col("s") == s).toLocalIterator()] for s in range(sets)]


def contamination(df: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", set_bytes: int = SET_BYTES) -> DataFrame:
    """Append ``n_words``, ``n_hit``, ``items`` (ids of the items with a window
    in the text, sorted) and ``hits`` (runs of hit words: first and last)."""
    rows = Numbered(df)
    return rows.named(_found(rows.df, rows(text), benchmark, n, item_id, item_text, set_bytes), **{c: c for c in ADDED})


def _found(df: DataFrame, text: str, benchmark: DataFrame, n: int, item_id: str = "item_id", item_text: str = "text",
           set_bytes: int = SET_BYTES) -> DataFrame:
    """A numbered table with the columns of :func:`contamination`."""
    sc = df.sparkSession.sparkContext
    asked = pick(benchmark, i=item_id, t=item_text)
    kind = T.StructType([
        T.StructField("n", T.LongType()),
        T.StructField("hits", T.ArrayType(T.StructType([T.StructField("first", T.LongType()),
                                                        T.StructField("last", T.LongType())]))),
        T.StructField("items", T.ArrayType(asked.schema["i"].dataType))])
    arrow = to_arrow_type(kind)

    def scanned(items):
        shared = sc.broadcast(items)

        def kernel():
            grams = NgramSet(shared.value, n)

            def one(raw):
                words, mask, ids = grams.scan(raw)
                return {"n": words, "hits": _spans(mask), "items": sorted(i for i in ids if i is not None)}
            return lambda texts: pa.array([one(t) for t in as_bytes(texts)], type=arrow)

        return arrow_column(kernel, kind)(F.col(text))

    sets = _sets(asked, set_bytes)
    found = df.withColumn("found", scanned(sets[0]))
    if len(sets) == 1:
        n_words, hits, items = F.col("found.n"), F.col("found.hits"), F.col("found.items")
    else:
        # every further set reads the documents once and sends on only the texts with hits, known by their hash
        key = F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("key")
        more = [df.select(key, scanned(items).alias("more")).filter("size(more.hits) > 0 or size(more.items) > 0")
                .groupBy("key").agg(F.first("more").alias("more")) for items in sets[1:]]
        every = more[0]
        for m in more[1:]:
            every = every.unionByName(m)
        every = every.groupBy("key").agg(F.flatten(F.collect_list("more.hits")).alias("hits"),
                                         F.flatten(F.collect_list("more.items")).alias("items"))
        none = [F.array().cast(kind[c].dataType) for c in ("hits", "items")]
        found = found.withColumn("key", key).join(every, "key", "left")
        both = [F.concat(f"found.{c}", F.coalesce(c, e)) for c, e in zip(("hits", "items"), none, strict=True)]
        words = F.array_sort(F.array_distinct(F.flatten(F.transform(both[0], lambda h: F.sequence(h["first"], h["last"])))))
        n_words, items = F.col("found.n"), F.array_sort(F.array_distinct(both[1]))
        hits = F.transform(words, lambda w: F.struct(w.alias("first"), w.alias("last")))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["last"] - h["first"] + 1)
    return found.select(*df.columns, n_words.alias("n_words"), items.alias("items"), hits.alias("hits")).withColumn("n_hit", n_hit)


def decontaminate(df: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", action: str = "documents",
                  **names) -> DataFrame:
    """The input columns without what the benchmark contaminates: the hit
    ``documents``, or the hit ``spans`` (from the first byte of a run of hit
    words to its last)."""
    rows = Numbered(df)
    found = _found(rows.df, rows(text), benchmark, n, **names)
    if action == "documents":
        return rows.named(found.filter("n_hit = 0"))
    if action != "spans":
        raise ValueError(f"no such action: {action}")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, hits: pd.Series) -> pd.Series:
        return pd.Series([t if h is None or not len(h) else _without_words(t, h)
                          for t, h in zip(texts, hits, strict=True)], dtype=object)

    return rows.named(found.withColumn(rows(text), cut(F.col(rows(text)), F.col("hits"))))


def _without_words(text: str, hits) -> str:
    raw = text.encode()
    at = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(_WORD_BYTES))]
    out, end = [], 0
    for h in hits:
        out.append(raw[end:at[h["first"]][0]])
        end = at[h["last"]][1]
    return b"".join([*out, raw[end:]]).decode()
