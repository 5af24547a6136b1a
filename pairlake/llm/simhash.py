"""Operator 3: SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints: the majority bits of the XXH64 values of a text's word shingles.

Index: the top nodes are bit patterns that a group of fingerprints shares
(``max_bits + 1`` bands of bits: two fingerprints at most ``max_bits`` apart
agree on a whole band, so they meet below that node with no difference yet).
Below a top node the fingerprints stand in Gray order, in which neighbours
share long patterns; runs of them are factored into nodes that keep the bits
all their members agree on.  A search adds up the differences on the bits that
each level adds and leaves out every node whose sum exceeds ``max_bits``.

At scale: equal fingerprints are one row before anything else.  The members of
a top node are cut into Gray-order blocks of about ``BLOCK_ROWS`` when there
are more; a fingerprint is sent only to the blocks whose shared pattern it can
match.  A block's task returns a spanning forest of the links it found, never
the pairs, and the forests meet in :mod:`components`.

Defined results: a null, empty or blank text has fingerprint zero and links
like any other; a text of fewer words than a shingle is one shingle; rows that
repeat an id each get a row (their texts decide); an empty table gives an
empty table; other columns are not used.
"""

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlake.llm.components import components
from pairlake.llm.text import Numbered, arrow_column, as_bytes, pick
from pairlake.operators.index import pin

BLOCK_ROWS = 4096  # fingerprints below a top node that one block holds, about
MOST_BLOCKS = 1024  # cut points kept for one top node
LEAF, FAN = 16, 16  # members of a leaf, children of an inner node
FRONTIER = 1 << 20  # (fingerprint, node) pairs a task looks at together


def fingerprint_bits(words: list[bytes], shingle: int) -> int:
    """The 64 majority bits, as an unsigned number."""
    import xxhash

    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(min(shingle, len(words)))), strict=False))
    hashes = np.array(list(map(partial(xxhash.xxh64_intdigest, seed=42), shingles)), dtype=">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", shingle: int = 3, out: str = "fingerprint") -> DataFrame:
    """Append ``out``: the fingerprint as a long (two's complement).  Words are
    what ASCII white space separates, A-Z in lower case."""
    def kernel():
        def one(raw):
            return fingerprint_bits((raw or b"").lower().split(), shingle)
        return lambda texts: pa.array(np.array([one(t) for t in as_bytes(texts)], dtype=np.uint64).view(np.int64))

    rows = Numbered(df)
    return rows.named(rows.df.withColumn("out", arrow_column(kernel, "long")(F.col(rows(text)))), **{out: "out"})


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


def _gray_rank_column(c):
    """The same rank as a long whose order is that of the unsigned rank."""
    for shift in (1, 2, 4, 8, 16, 32):
        c = c.bitwiseXOR(F.shiftrightunsigned(c, shift))
    return c.bitwiseXOR(F.lit(-(1 << 63)))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class GrayIndex:
    """The index over the members of many blocks at once.  ``codes`` and their
    ``block`` numbers are sorted by block and Gray rank."""

    def __init__(self, codes: np.ndarray, block: np.ndarray):
        self.codes = codes
        # level 0: leaves of up to LEAF neighbours of a block; each next level joins up to FAN nodes
        self.levels = []  # (first child, one past the last, shared bits, mask of shared bits)
        low, high, owner = codes, codes, block
        fan = LEAF
        while True:
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            place = np.arange(len(owner)) - np.repeat(begin, np.diff(np.r_[begin, len(owner)]))
            first = np.flatnonzero(place % fan == 0)
            low, high = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first)
            self.levels.append((first, np.r_[first[1:], len(owner)], low, ~(low ^ high)))
            owner = owner[first]
            fan = FAN
            if len(np.unique(owner)) == len(owner):
                break
        self.roots = dict(zip(owner.tolist(), range(len(owner)), strict=True))

    def search(self, queries: np.ndarray, block: np.ndarray, most: int):
        """Yield (query number, member number) arrays of all pairs in a block
        at most ``most`` bits apart."""
        for begin in range(0, len(queries), 4096):
            q = np.arange(begin, min(begin + 4096, len(queries)))
            node = np.array([self.roots.get(b, -1) for b in block[q].tolist()], dtype=np.int64)
            q, node = q[node >= 0], node[node >= 0]
            yield from self._below(queries, q, node, len(self.levels) - 1, np.zeros(len(q), np.int64),
                                   np.zeros(len(q), np.uint64), most)

    def _below(self, queries, q, node, level, differ, seen, most):
        if len(q) > FRONTIER and level >= 0:
            half = len(q) // 2
            for part in (slice(None, half), slice(half, None)):
                yield from self._below(queries, q[part], node[part], level, differ[part], seen[part], most)
            return
        if level < 0:  # node numbers are member numbers
            rest = (queries[q] ^ self.codes[node]) & ~seen
            near = differ + _popcount(rest) <= most
            yield q[near], node[near]
            return
        first, last, bits, mask = self.levels[level]
        differ = differ + _popcount((queries[q] ^ bits[node]) & mask[node] & ~seen)  # only what this level adds
        alive = differ <= most
        q, node, differ = q[alive], node[alive], differ[alive]
        seen = mask[node]
        width = last[node] - first[node]
        child = np.repeat(first[node] - np.r_[0, np.cumsum(width)[:-1]], width) + np.arange(width.sum())
        yield from self._below(queries, np.repeat(q, width), child, level - 1, np.repeat(differ, width),
                               np.repeat(seen, width), most)


class Forest:
    """Union-find over numbers 0 to n - 1, in whole arrays."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            while True:
                up = self.parent[self.parent]
                if np.array_equal(up, self.parent):
                    break
                self.parent = up
            a, b = self.parent[a], self.parent[b]
            apart = a != b
            a, b = np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart])
            np.minimum.at(self.parent, a, b)


def _block_links(most: int):
    """Kernel over rows (block key, block, fp, member) sorted by block key and
    block: a spanning forest of the links of each block."""
    def links(codes, block, member):
        order = np.lexsort((gray_rank(codes), block))
        codes, block, member = codes[order], block[order], member[order]
        index = GrayIndex(codes[member], block[member])
        at = np.flatnonzero(member)
        forest = Forest(len(codes))
        for q, m in index.search(codes, block, most):
            forest.unite(q, at[m])
        forest.unite(np.array([0]), np.array([0]))
        child = np.flatnonzero(forest.parent != np.arange(len(codes)))
        return codes[child], codes[forest.parent[child]]

    def kernel(batches):
        held = []  # the rows of blocks that may go on

        def flush(rows):
            codes = np.concatenate([r[1] for r in rows])
            member = np.concatenate([r[2] for r in rows])
            key = np.concatenate([r[0] for r in rows])
            if member.any():
                a, b = links(codes, key, member)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        serial = 0  # blocks get consecutive numbers within the task
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [np.asarray(batch.column(i)) for i in range(3)]
            change = np.ones(batch.num_rows, bool)
            change[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            change[0] = last != tuple(k[0] for k in keys)
            last = tuple(k[-1] for k in keys)
            number = serial + np.cumsum(change)
            serial = int(number[-1])
            held.append((number, np.asarray(batch.column(3)).view(np.uint64),
                         batch.column(4).to_numpy(zero_copy_only=False).astype(bool)))
            if sum(len(h[0]) for h in held) >= 1 << 16 and held[0][0][0] != serial:
                whole = [tuple(c[h[0] != serial] for c in h) for h in held]
                yield from flush([h for h in whole if len(h[0])])
                held = [h for h in (tuple(c[h[0] == serial] for c in h) for h in held) if len(h[0])]
        if held:
            yield from flush(held)

    return kernel


def _bands(most: int) -> list[int]:
    """``most + 1`` masks that share out the 64 bits."""
    cut = [64 * i // (most + 1) for i in range(most + 2)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cut, cut[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_links(distinct: DataFrame, max_bits: int = 2, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``distinct`` (fp) -> (a, b): links whose components are those of all
    pairs at most ``max_bits`` apart."""
    nodes = F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                      for i, m in enumerate(_bands(max_bits))])
    rows = distinct.select("fp", F.explode(nodes).alias("n")).select("n.band", "n.key", "fp")
    # cut points in Gray order below crowded top nodes
    rank = _gray_rank_column(F.col("fp"))
    steps = [i / MOST_BLOCKS for i in range(1, MOST_BLOCKS)]
    crowded = (rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block_rows))
    cuts = (rows.join(crowded, ["band", "key"]).withColumn("r", rank).groupBy("band", "key")
            .agg(F.percentile_approx("r", steps, F.lit(4 * MOST_BLOCKS)).alias("q"), F.first("n").alias("n"))
            .select("band", "key", F.expr(
                f"array_distinct(filter(q, (x, i) -> (i + 1) % greatest(1, int({MOST_BLOCKS}L * {block_rows} / n)) = 0))"
            ).alias("cut")))
    cuts = pin(cuts)
    placed = (rows.join(cuts, ["band", "key"], "left").withColumn("r", rank)
              .withColumn("block", F.expr("coalesce(size(filter(cut, x -> x < r)), 0)")).drop("r"))
    plain = placed.filter("cut is null").select("band", "key", "block", "fp", F.lit(True).alias("member"))
    cut_rows = placed.filter("cut is not null").drop("cut")
    shared = (cut_rows.groupBy("band", "key", "block").agg(F.bit_and("fp").alias("lo"), F.bit_or("fp").alias("hi"))
              .groupBy("band", "key").agg(F.collect_list(F.struct("block", "lo", "hi")).alias("blocks")))
    sent = (cut_rows.join(shared, ["band", "key"])
            .withColumn("to", F.explode(F.expr(
                f"filter(blocks, x -> bit_count((fp ^ x.lo) & ~(x.lo ^ x.hi)) <= {int(max_bits)})")))
            .select("band", "key", "to.block", "fp", (F.col("to.block") == F.col("block")).alias("member")))
    keys = ["band", "key", "block"]
    return (plain.unionByName(sent).repartition(*keys).sortWithinPartitions(*keys)
            .mapInArrow(_block_links(max_bits), "a long, b long"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id): the smallest id
    that a chain of links from the document's fingerprint reaches."""
    prints = pin(fingerprints(pick(df, _id=doc_id, _text=text), "_text", shingle,
                              "fp").select("_id", "fp"))
    firsts = prints.groupBy("fp").agg(F.min("_id").alias("first"))
    roots = components(fingerprint_links(firsts.select("fp"), max_bits, block_rows))
    linked = firsts.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    linked = linked.withColumn("root", F.coalesce("root", "fp"))
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = linked.join(least, "root").select("fp", "component_id")
    return (prints.join(of_print, "fp")
            .select(F.col("_id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    "component_id"))
