"""Operator 4: exact top-k inner products with a KD-tree per shard.

Vectors become integers, floor(scale * x).  They are dealt to shards by a hash
of their id, so equal vectors spread evenly.  A shard's tree splits at the
median of its widest dimension down to leaves; every node has the tight box of
its members and their least id.  A search goes through the nodes in the order
of the largest inner product their box allows and stops when that cannot beat
the k-th result so far; equal scores go to the smaller id.

Two rounds: every query first searches the shard its own id falls into, which
gives a k-th score; that score travels with the query to the other shards,
whose trees prune by it from the root on.  Members come before queries in a
shard's rows, so a task holds one shard's vectors and streams the queries.
Only results that beat the propagated score leave a task.

Shards: as many as give ``SHARD_ROWS`` vectors each, but no more than the
session's shuffle partitions until they would exceed ``MOST_ROWS``.

Defined results: vectors that are null or hold null, NaN or infinite
components, and rows without an id, take no part; a query's own id is never a
candidate, nor any other row of that id; rows that repeat an id are candidates
each, and queries that repeat one are answered together, by the best of all
their pairs; only vectors of equal length are compared; scores must fit a long; other columns are not used;
fewer candidates than k give fewer rows; an empty table gives an empty table.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlake.llm.text import pick
from pairlake.operators.index import pin

LEAF = 128
SHARD_ROWS = 4096
MOST_ROWS = 1 << 18
EXACT = float(1 << 53)  # whole numbers below it are exact in float64


class KDTree:
    """Over integer vectors (float64 if every product sum is exact in it)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.most, self._as = float(np.abs(vectors).max(initial=0)), {}
        self.low, self.high, self.least, self.children, self.rows = [], [], [], [], []
        if len(ids):
            self._node(np.arange(len(ids)))
            self.low, self.high = np.array(self.low), np.array(self.high)

    def _node(self, rows: np.ndarray) -> int:
        here = self.vectors[rows]
        number = len(self.low)
        self.low.append(here.min(0, initial=np.iinfo(np.int64).max))
        self.high.append(here.max(0, initial=np.iinfo(np.int64).min))
        self.least.append(int(self.ids[rows].min()))
        self.children.append(None)
        self.rows.append(rows)
        spread = (self.high[number].astype(float) - self.low[number]) if here.shape[1] else np.zeros(1)
        if len(rows) > LEAF and spread.max() > 0:
            axis = int(spread.argmax())
            place = np.argpartition(here[:, axis], len(rows) // 2)
            halves = np.sort(rows[place[:len(rows) // 2]]), np.sort(rows[place[len(rows) // 2:]])
            self.children[number] = tuple(self._node(h) for h in halves)
            self.rows[number] = None
        return number

    def prepared(self, queries: np.ndarray):
        """The tree's and the queries' numbers in the fastest exact type."""
        most = self.most * float(np.abs(queries).max(initial=0)) * max(1, queries.shape[1])
        kind = np.float64 if most < EXACT else np.int64
        if kind not in self._as:  # the tree is converted once, not for every block of queries
            self._as[kind] = tuple(x.astype(kind) for x in (self.vectors, self.low, self.high))
        return (*self._as[kind], queries.astype(kind))

    def search(self, queries: np.ndarray, own: np.ndarray, bounds: list, k: int):
        """Per query the results that beat its bound (score, id of the k-th so
        far, or None): lists of (-score, id), best first, k at most."""
        if not len(self.ids):
            return [[] for _ in own]
        vectors, low, high, queries = self.prepared(queries)
        # the largest inner product a vector inside each box can have
        reach = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
        return [self._one(vectors, q, int(o), b, [-int(x) for x in r], k)
                for q, o, b, r in zip(queries, own, bounds, reach, strict=True)]

    def _one(self, vectors, query, own, bound, reach, k):
        """``reach`` is negated, like all scores here, so that less is better."""
        best: list[tuple[int, int]] = []  # ascending (-score, id)
        kth = (-bound[0], bound[1]) if bound else None  # results must come before it
        nodes = [(reach[0], self.least[0], 0)]
        while nodes:
            nearest, least, node = heapq.heappop(nodes)
            if kth and (nearest, least) >= kth:
                if nearest > kth[0]:
                    break
                continue
            if self.children[node]:
                for child in self.children[node]:
                    if not kth or (reach[child], self.least[child]) < kth:
                        heapq.heappush(nodes, (reach[child], self.least[child], child))
                continue
            rows = self.rows[node]
            rows = rows[self.ids[rows] != own]
            scores = vectors[rows] @ query
            if kth:
                near = scores >= -kth[0]
                rows, scores = rows[near], scores[near]
            if len(rows) > 4 * k:  # rows ascend by id, so a stable sort keeps the smaller id first
                top = np.argsort(-scores, kind="stable")[:k]
                rows, scores = rows[top], scores[top]
            found = [(-int(s), i) for s, i in zip(scores, self.ids[rows].tolist(), strict=True)]
            best = sorted([*best, *(f for f in found if not kth or f < kth)])[:k]
            if len(best) == k and (not kth or best[-1] < kth):
                kth = best[-1]
        return best


def _unpack(column: pa.Array) -> np.ndarray:
    """List array of one length -> matrix."""
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _shard_search(k: int):
    """Rows (dim, shard, kind, id, vector, bound score, bound id) sorted by the
    first three; kind 0 is a member, 1 a query."""
    def kernel(batches):
        here, members, tree = None, [], None
        for batch in batches:
            dims, shards, kinds = (np.asarray(batch.column(i)) for i in range(3))
            change = np.flatnonzero(np.r_[True, (np.diff(dims) != 0) | (np.diff(shards) != 0) | (np.diff(kinds) != 0)])
            for begin, end in zip(change, np.r_[change[1:], batch.num_rows], strict=True):
                part = batch.slice(begin, end - begin)
                if here != (dims[begin], shards[begin]):
                    here, members, tree = (dims[begin], shards[begin]), [], None
                ids, vectors = np.asarray(part.column(3)), _unpack(part.column(4))
                if kinds[begin] == 0:
                    members.append((ids, vectors))
                    continue
                if tree is None:
                    tree = KDTree(*_together(members, vectors.shape[1]))
                bounds = [None if s is None else (s, i) for s, i in
                          zip(part.column(5).to_pylist(), part.column(6).to_pylist(), strict=True)]
                for at in range(0, len(ids), 256):
                    found = tree.search(vectors[at:at + 256], ids[at:at + 256], bounds[at:at + 256], k)
                    rows = [(q, i, -s) for q, best in zip(ids[at:at + 256].tolist(), found, strict=True)
                            for s, i in best]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)],
                                                         names=["query_id", "vec_id", "score"])

    return kernel


def _together(members: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
    if not members:
        return np.zeros(0, np.int64), np.zeros((0, dim), np.int64)
    ids = np.concatenate([m[0] for m in members])
    return ids, np.concatenate([m[1] for m in members])


def top_k(df: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
          scale: int = 256, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the ``k``
    best rows of ``df`` by inner product, ties to the smaller id."""
    spark = df.sparkSession
    at_once = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = df.count()  # of a table: its footers
    shards = max(1, -(-n // MOST_ROWS), min(-(-n // shard_rows), at_once))

    def whole(rows: DataFrame) -> DataFrame:
        x = F.col("x")
        valid = F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
        return (pick(rows, i=vec_id, x=vector).filter(F.col("i").isNotNull() & x.isNotNull() & valid)
                .select(F.col("i").cast("long").alias("id"),
                        F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v")))

    home = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    none = F.lit(None).cast("long")
    members = whole(df).select(F.size("v").alias("dim"), home.alias("shard"), F.lit(0).alias("kind"), "id", "v",
                               none.alias("s"), none.alias("i"))
    asked = whole(queries).withColumn("dim", F.size("v"))
    schema = "query_id long, vec_id long, score long"

    def search(sent: DataFrame) -> DataFrame:
        rows = members.unionByName(sent.select(members.columns))
        # a shard is a partition: hashed, some partitions would hold several shards and others none
        return (rows.repartitionById(shards, "shard").sortWithinPartitions("dim", "shard", "kind")
                .mapInArrow(_shard_search(k), schema))

    kind = F.lit(1).alias("kind")
    first = pin(search(asked.select("dim", home.alias("shard"), kind, "id", "v", none.alias("s"), none.alias("i"))))
    last = F.max(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("i")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    bound = (first.withColumn("r", place).filter(F.col("r") <= k)
             .groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), last.alias("b"))
             .filter(F.col("n") == k).select("id", (-F.col("b.s")).alias("s"), "b.i"))
    others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != home)
    rest = search(asked.join(bound, "id", "left").withColumn("shard", F.explode(others))
                  .select("dim", "shard", kind, "id", "v", "s", "i"))
    return (first.union(rest).withColumn("rank", place).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
