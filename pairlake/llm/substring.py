"""Operator 9: repeated-substring removal with suffix automata.

A window is ``length`` consecutive words of a document.  Every word goes that
is covered by a window whose word sequence also starts in a document of a
smaller id; all windows are judged on the input.

Reference shards: the least hash of the ``GRAM``-word grams of a window (its
anchor) depends on its words alone, so equal windows have equal anchors.  Runs
of windows with one anchor are cut out as pieces; the pieces of one anchor are
a reference shard.  Only anchors that two documents share go on:

* an anchor whose pieces all have the same words needs no search: the piece
  stands first in the least document;
* for the others a suffix automaton is built over the shard's distinct pieces
  in ascending document order; each piece is streamed through the automaton of
  the smaller documents for its matching statistics, and the windows that end
  where the match is ``length`` words or longer are repeats;
* a shard of more than ``shard_pieces`` distinct pieces (a phrase that a large
  part of the corpus quotes in other surroundings) is split: its windows also
  have the least of their other gram hashes in common if they are equal, so that
  second anchor deals their runs to smaller shards, then a third, until every
  shard fits a task.  Windows without a further gram have all their grams in
  common and stay together.

Thus no shard is larger than a task holds, every shard of different pieces is
searched by its automaton, nothing is compared across shards, and each
automaton goes to the task that streams its shard instead of being broadcast to
all documents: with the corpus as its own reference, a broadcast of every
automaton would read the corpus once per shard.

Defined results: a null or blank text has no words; rows without an id keep all
their words and are no reference; rows that repeat an id are one document;
repeats within a document stay; a text of any length is taken whole; other
columns are not used; an empty table gives an empty table.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlake.llm.scratch import written
from pairlake.llm.text import arrow_column, as_bytes, pick

GRAM = 8  # words of the grams whose least hash is the anchor
SHARD_PIECES = 2000  # distinct pieces of a shard beyond which it is split by a further anchor
_NONE = (1 << 64) - 1  # the anchor of windows all of whose grams are anchors already


def split_words(raw: bytes | None) -> list[bytes]:
    """What ASCII white space separates."""
    return (raw or b"").split()


class SuffixAutomaton:
    """Of several word sequences, added one after the other."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, following: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.link) - 1

    def _clone(self, p: int, word, q: int) -> int:
        c = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = c
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = c
            p = self.link[p]
        return c

    def add(self, words: list) -> None:
        last = 0
        for word in words:
            p, q = last, self.next[last].get(word)
            if q is not None:  # known from an earlier sequence
                last = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
                continue
            last = self._state(self.length[p] + 1, 0, {})
            while p != -1 and word not in self.next[p]:
                self.next[p][word] = last
                p = self.link[p]
            if p != -1:
                q = self.next[p][word]
                self.link[last] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)

    def matches(self, words: list) -> list[int]:
        """Matching statistics: the longest known sequence that ends at each word."""
        state, length, out = 0, 0, []
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            following = self.next[state].get(word)
            if following is not None:
                state, length = following, length + 1
            out.append(length)
        return out


class Windows:
    """The words of a text, the anchors of its windows and the hashes of parts."""

    def __init__(self, raw: bytes | None):
        import xxhash

        self._hash = xxhash.xxh3_64_intdigest
        self.words = split_words(raw)
        self.joined = b" ".join(self.words)
        self.starts = np.r_[0, np.cumsum([len(w) + 1 for w in self.words])] if self.words else np.zeros(1, np.int64)

    def part(self, first: int, count: int) -> bytes:
        return self.joined[self.starts[first]:self.starts[first + count] - 1]

    def runs(self, length: int, used=()) -> list[tuple[int, int, int, int]]:
        """(anchor, first word, windows, hash of the piece's words) per run.
        Gram hashes among ``used`` are no anchors any more."""
        windows = len(self.words) - length + 1
        if windows <= 0:
            return []
        gram = min(GRAM, length)
        joined, h = self.joined, self._hash
        least = np.array([h(joined[a:b]) for a, b in zip(
            self.starts[:-gram].tolist(), (self.starts[gram:] - 1).tolist(), strict=True)], dtype=np.uint64)
        if len(used):
            least[np.isin(least, np.array(used, np.int64).view(np.uint64))] = _NONE
        span = length - gram + 1  # grams of a window
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[:windows], least[span - width:span - width + windows])
        begin = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        size = np.diff(np.r_[begin, windows])
        cuts = -(-size // span)  # a run longer than a gram can stay in sight is cut
        place = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        first = np.repeat(begin, cuts) + place * span
        count = np.minimum(np.repeat(size, cuts) - place * span, span)
        return [(a, f, n, h(self.part(f, n + length - 1))) for a, f, n in zip(
            least[first].view(np.int64).tolist(), first.tolist(), count.tolist(), strict=True)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _anchor_rows(length: int):
    kind = pa.list_(pa.struct([("anchor", pa.int64()), ("first", pa.int32()), ("wins", pa.int32()),
                               ("piece", pa.int64())]))
    names = ("anchor", "first", "wins", "piece")

    def kernel():
        return lambda texts: pa.array([[dict(zip(names, (a, f, n, _signed(p)), strict=True))
                                        for a, f, n, p in Windows(t).runs(length)] for t in as_bytes(texts)], type=kind)
    return arrow_column(kernel, "array<struct<anchor: bigint, first: int, wins: int, piece: bigint>>")


def _cut_rows(length: int):
    """(text, wanted pieces) -> their words."""
    kind = pa.list_(pa.struct([("anchor", pa.int64()), ("piece", pa.int64()), ("words", pa.binary())]))

    def kernel():
        def cut(raw, wanted):
            text = Windows(raw)
            return [{"anchor": w["anchor"], "piece": w["piece"], "words": text.part(w["first"], w["wins"] + length - 1)}
                    for w in wanted]
        return lambda texts, wanted: pa.array(map(cut, as_bytes(texts), wanted.to_pylist()), type=kind)

    return arrow_column(kernel, "array<struct<anchor: bigint, piece: bigint, words: binary>>")


def _split_rows(length: int):
    """(words of a piece, anchors so far) -> its runs under the next anchor."""
    kind = pa.list_(pa.struct([("next", pa.int64()), ("first", pa.int32()), ("wins", pa.int32()), ("part", pa.int64()),
                               ("words", pa.binary())]))

    def kernel():
        def cut(raw, used):
            text = Windows(raw)
            return [{"next": a, "first": f, "wins": n, "part": _signed(p), "words": text.part(f, n + length - 1)}
                    for a, f, n, p in text.runs(length, used)]
        return lambda words, used: pa.array(map(cut, as_bytes(words), used.to_pylist()), type=kind)

    return arrow_column(kernel, "array<struct<next: bigint, first: int, wins: int, part: bigint, words: binary>>")


def _automata(length: int):
    """Rows (key, doc, piece, words) sorted by key, the anchors of a shard, and
    document -> for each piece the windows (numbers within the piece) that a
    smaller document has, if any."""
    def kernel(batches):
        key = doc = automaton = None
        pending: list[list[bytes]] = []  # the pieces of the current document
        for batch in batches:
            found = []
            for a, d, piece, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if a != key:
                    key, doc, automaton, pending = a, d, SuffixAutomaton(), []
                elif d != doc:
                    for words in pending:
                        automaton.add(words)
                    doc, pending = d, []
                words = raw.split(b" ")
                repeats = [i for i, n in enumerate(automaton.matches(words)[length - 1:]) if n >= length]
                if repeats:
                    found.append((a, piece, repeats))
                pending.append(words)
            if found:
                columns = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.list_(pa.int64())),
                                                  pa.array(columns[1], pa.int64()),
                                                  pa.array(columns[2], pa.list_(pa.int32()))],
                                                 names=["key", "piece", "repeats"])
    return kernel


def _search(pieces: DataFrame, length: int, shard_pieces: int) -> DataFrame:
    """``pieces`` (key: anchors of the shard, piece, _id: its least document,
    words), distinct by key and piece -> (key, piece, repeats): the windows of a
    piece that a smaller document has in another piece of the shard."""
    large = written(pieces.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
                    .filter((F.col("n") > shard_pieces) & (F.element_at("key", -1) != -1)).select("key"), "large")
    fitting = pieces.join(large, "key", "left_anti").select("key", "_id", "piece", "words")
    found = (fitting.repartition("key").sortWithinPartitions("key", "_id")
             .mapInArrow(_automata(length), "key array<long>, piece long, repeats array<int>"))
    if large.isEmpty():
        return found
    runs = written(pieces.join(large, "key", "left_semi")
                   .select("key", "piece", "_id", F.explode(_split_rows(length)(F.col("words"), F.col("key"))).alias("r"))
                   .select("key", "piece", "_id", F.concat("key", F.array("r.next")).alias("key2"), "r.first", "r.wins",
                           "r.part", "r.words"), "runs")
    parts = written(runs.groupBy("key2", "part").agg(F.min("_id").alias("least"), F.first("words").alias("words")), "parts")
    deeper = parts.select(F.col("key2").alias("key"), F.col("part").alias("piece"), F.col("least").alias("_id"), "words")
    inside = written(_search(deeper, length, shard_pieces), "inside")  # plans don't grow with the depth
    known = parts.select("key2", "part", "least").join(
        inside.select(F.col("key").alias("key2"), F.col("piece").alias("part"), "repeats"), ["key2", "part"], "left")
    split = (runs.drop("words").join(known, ["key2", "part"]).filter("_id > least or repeats is not null")
             .select("key", "piece", F.explode(F.expr(
                 "if(_id > least, sequence(first, first + wins - 1), transform(repeats, i -> first + i))")).alias("i"))
             .groupBy("key", "piece").agg(F.collect_list("i").alias("repeats")))
    return found.union(split)


def repeated_windows(docs: DataFrame, length: int, shard_pieces: int) -> DataFrame:
    """``docs`` (_id, _t, _text) -> (_id, _t, runs): the first words and counts
    of the windows that a smaller document also has."""
    named = docs.filter("_id is not null")
    rows = written(named.select("_id", "_t", F.explode(_anchor_rows(length)(F.col("_text"))).alias("r"))
                   .select("_id", "_t", "r.*"), "anchors")
    shared = (rows.groupBy("anchor").agg(F.min("_id").alias("least"), F.max("_id").alias("most"),
                                         F.min("piece").alias("p0"), F.max("piece").alias("p1"))
              .filter("least < most").select("anchor", "least", (F.col("p0") == F.col("p1")).alias("same")))
    live = written(rows.join(shared, "anchor"), "pieces")
    alike = live.filter("same and _id > least").select("_id", "_t", "first", "wins")
    # the other anchors: distinct pieces, at their first place in their least document
    mixed = live.filter("not same").select("_id", "_t", "anchor", "piece", "first", "wins")
    firsts = mixed.groupBy("anchor", "piece").agg(F.min(F.struct("_id", "_t", "first", "wins")).alias("at"))
    wanted = firsts.select("at._id", "at._t", F.struct("anchor", "piece", "at.first", "at.wins").alias("w"))
    places = named.join(wanted.groupBy("_id", "_t").agg(F.collect_list("w").alias("w")), ["_id", "_t"])
    cut = written(places.select("_id", F.explode(_cut_rows(length)(F.col("_text"), F.col("w"))).alias("c"))
                  .select(F.array("c.anchor").alias("key"), "c.piece", "_id", "c.words"), "cut")
    # equal rows of the same id and text give a piece twice; a piece is searched once
    flagged = _search(cut.dropDuplicates(["key", "piece"]), length, shard_pieces).select(
        F.element_at("key", 1).alias("anchor"), "piece", "repeats")
    known = firsts.select("anchor", "piece", F.col("at._id").alias("least")).join(flagged, ["anchor", "piece"], "left")
    resolved = (mixed.join(known, ["anchor", "piece"]).filter("_id > least or repeats is not null")
                .select("_id", "_t", F.explode(F.expr(
                    "if(_id > least, array(named_struct('first', first, 'wins', wins)), "
                    "transform(repeats, i -> named_struct('first', first + i, 'wins', 1)))"
                )).alias("r")).select("_id", "_t", "r.first", "r.wins"))
    return alike.union(resolved).groupBy("_id", "_t").agg(F.collect_list(F.struct("first", "wins")).alias("runs"))


def _kept(length: int):
    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])

    def kernel():
        def one(raw, runs):
            words = split_words(raw)
            if not runs:
                return {"n_words": len(words), "n_removed": 0, "kept": b" ".join(words)}
            edge = np.zeros(len(words) + 1, np.int64)
            for r in runs:
                edge[r["first"]] += 1
                edge[r["first"] + r["wins"] + length - 1] -= 1
            stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
            return {"n_words": len(words), "n_removed": len(words) - len(stay),
                    "kept": b" ".join([words[i] for i in stay.tolist()])}
        return lambda texts, runs: pa.array(map(one, as_bytes(texts), runs.to_pylist()), type=kind)

    return arrow_column(kernel, "struct<n_words: bigint, n_removed: bigint, kept: binary>")


def remove_repeats(df: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text",
                   shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """(doc_id, ``n_words``, ``n_removed``, ``kept``: the words that stay, joined
    by one blank) of every document."""
    docs = pick(df, _id=doc_id, _text=text).select("_id", F.xxhash64("_text").alias("_t"), "_text")
    runs = repeated_windows(docs, length, shard_pieces)
    done = docs.join(runs, ["_id", "_t"], "left").select("_id", _kept(length)(F.col("_text"), F.col("runs")).alias("k"))
    return done.select(F.col("_id").alias(doc_id), "k.n_words", "k.n_removed", F.col("k.kept").cast("string").alias("kept"))
