"""Operator 13: a trie of conversation prefixes, with subtree totals by
centroid decomposition.

A node is a distinct sequence of first turns (role, text); the node of a
conversation's first d turns has depth d, and all begin at the textless root.
Texts are hashed where they are read, so only digests of turns move: a prefix
is known by two 64-bit sums (exclusive or) of its turns' digests, each salted
with the turn's place, which is one running window a conversation.

Totals over subtrees come from a centroid decomposition of the parent edges.
In each component the centroid is the deepest node that holds at least half of
the component's weight below or at itself.  The nodes that hold as much are
the path from it to the component's top, so the path needs no walk.  Without
the centroid the component falls into pieces of at most half its weight; the
total of the centroid and the pieces below it is added to the centroid and all
nodes of the path, and each piece is split in turn.  A node's additions over
all rounds are its subtree's total, after about log2(weight) rounds however
deep or broad the trie is.

* Components of more than ``most`` nodes are split by joins over all of them at
  once, a round at a time.  A node weighs as many as its conversations, whose
  sums over subtrees follow from the conversations' lengths, so no total is
  needed to find a centroid.  Below a centroid, a node's piece is looked up on
  the path of its least conversation.
* Components of up to ``most`` nodes are split inside tasks, one in memory at
  a time, with every node weighing one.

Sets of conversation ids are hashed from sorted rows as they stream by, so a
node at which a third of all conversations end is never collected.  Parents of
more than a thousandth of all nodes (fewer than 1,000, so broadcast) hand their
ids to their children apart from the others.

Defined results: a null role or text is empty; rows without a conversation id
take no part; turns of one place are ordered by role and then by digest, and
repeated rows are turns of their own; a conversation may have no turns and is
then a member of the root alone; columns that are not named are left out,
whatever their names; an empty table gives no nodes.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlake.llm.scratch import written
from pairlake.llm.text import pick

MOST_NODES = 1 << 15  # nodes of a component that is split inside one task
HEAVY = 1000  # a parent of more than 1 / HEAVY of all nodes is heavy

NODE = "struct<a: bigint, b: bigint>"


def _node(a: str | Column, b: str | Column) -> Column:
    return F.struct(*[(F.col(x) if isinstance(x, str) else x).cast("long").alias(n) for x, n in ((a, "a"), (b, "b"))])


def _root() -> Column:
    return _node(F.lit(0), F.lit(0))


def digest_turns(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """-> (conv_id, place, a, b, size, length): place of the turn from 1, its
    digests, the bytes of its text and the turns of its conversation."""
    raw = [F.coalesce(F.col(c), F.lit("")) for c in ("role", "text")]
    rows = pick(df, conv_id=conv_id, turn=turn, role=role, text=text).filter("conv_id is not null").select(
        "conv_id", "turn", raw[0].alias("role"), F.xxhash64(F.lit(1), *raw).alias("a"),
        F.xxhash64(F.lit(2), *raw).alias("b"), F.octet_length(raw[1]).cast("long").alias("size"))
    mine = Window.partitionBy("conv_id")
    return rows.select("conv_id", F.row_number().over(mine.orderBy("turn", "role", "a", "b")).cast("long").alias("place"),
                       "a", "b", "size", F.count(F.lit(1)).over(mine).alias("length"))


def prefix_trie(turns: DataFrame, conversations: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """``turns`` (conv_id, place from 1, a, b, size) and ``conversations``
    (conv_id, length; one row each) -> a row a node: conv_id (least member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256."""
    paths = _paths(turns, conversations)
    nodes = _nodes(paths, conversations)
    totals = _subtree_totals(nodes, paths, most)
    ends = _ends(paths.filter("rest = 1").select("node", "conv_id").union(
        conversations.filter("length = 0").select(_root().alias("node"), "conv_id")))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return (_parent_ids(nodes).join(totals, "node").join(ends, "node", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
                    F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256")))


def _paths(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The node of every conversation at every depth from 1, with its parent
    and the turns from there to the end (``rest``)."""
    upto = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    salted = turns.select("conv_id", "place", "size", F.xxhash64("place", "a", "b").alias("s"),
                          F.xxhash64("b", "place", "a").alias("t"))
    keyed = salted.withColumn("a", F.bit_xor("s").over(upto)).withColumn("b", F.bit_xor("t").over(upto))
    return written(keyed.join(conversations.select("conv_id", "length"), "conv_id").select(
        "conv_id", F.col("place").alias("depth"), _node("a", "b").alias("node"),
        _node(F.col("a").bitwiseXOR(F.col("s")), F.col("b").bitwiseXOR(F.col("t"))).alias("parent"),
        "size", (F.col("length") - F.col("place") + 1).alias("rest")), "trie-paths")


def _nodes(paths: DataFrame, conversations: DataFrame) -> DataFrame:
    own = paths.groupBy("depth", "node").agg(
        F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.min("size").alias("size"), F.sum("rest").alias("weight"))
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
                             F.sum(F.col("length") + 1).alias("weight")).filter("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"), _root().alias("node"), F.lit(None).cast(NODE).alias("parent"), "conv_id",
        "n_convs", F.lit(0).cast("long").alias("size"), "weight")
    both = own.unionByName(root)
    children = own.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    return written(both.join(children, "node", "left").fillna(0, ["n_children"]), "trie-nodes")


def _parent_ids(nodes: DataFrame) -> DataFrame:
    ids = nodes.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"),
                                                "n_children")
    many = nodes.count() // HEAVY
    heavy = ids.filter(F.col("n_children") > many).drop("n_children")
    light = ids.filter(F.col("n_children") <= many).drop("n_children")
    first = nodes.join(F.broadcast(heavy), "parent", "left")
    return first.filter("parent_conv_id is not null or parent is null").unionByName(
        nodes.join(F.broadcast(heavy), "parent", "left_anti").filter("parent is not null").join(light, "parent"))


# --- totals over subtrees

def _subtree_totals(nodes: DataFrame, paths: DataFrame, most: int) -> DataFrame:
    """-> (node, leaves, saved), over the subtree of each node."""
    state = written(nodes.select(
        "node", "parent", "depth", "conv_id", "weight", _root().alias("top"),
        (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("own"),
        F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved")), "trie-state")
    done, small = [], []
    while True:
        large = written(state.groupBy("top").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("total"))
                        .filter(F.col("n") > most).drop("n"), "trie-large")
        small.append(state.join(large, "top", "left_anti"))
        if large.isEmpty():
            break
        split = _split(state.join(large, "top"), paths)
        done.append(split.filter("found").select("node", "leaves", "saved"))
        state = split.filter("not found").drop("found")
    out = _split_inside_tasks(_union(small))
    return _union([*done, out])


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _split(state: DataFrame, paths: DataFrame) -> DataFrame:
    """One round: every component without its centroid, whose row is ``found``."""
    heavy = F.col("weight") * 2 >= F.col("total")  # the path from the top to the centroid
    centroids = state.filter(heavy).groupBy("top").agg(F.max(F.struct("depth", "node", "weight")).alias("c"))
    rows = state.join(centroids, "top").withColumn(
        "part", F.when(F.col("node") == F.col("c.node"), "centroid").when(heavy, "path")
        .when(F.col("depth") > F.col("c.depth"), "deeper").otherwise("other"))
    step = paths.select("conv_id", F.col("depth").alias("at"), F.col("node").alias("piece"), F.col("parent").alias("over"))
    deeper = (rows.filter("part = 'deeper'").withColumn("at", F.col("c.depth") + 1).join(step, ["conv_id", "at"])
              .withColumn("part", F.when(F.col("over") == F.col("c.node"), "below").otherwise("other"))
              .withColumn("piece", F.when(F.col("part") == "below", F.col("piece")).otherwise(F.col("top")))
              .drop("at", "over"))
    parts = written(deeper.unionByName(rows.filter("part <> 'deeper'").withColumn("piece", F.col("top"))), "trie-parts")
    totals = parts.filter("part in ('centroid', 'below')").groupBy("top").agg(
        F.sum("leaf").alias("add_leaves"), F.sum("own").alias("add_saved"))
    added = F.col("part").isin("centroid", "path").cast("long")
    return written(parts.join(totals, "top").select(
        "node", "parent", "depth", "conv_id",
        F.when(F.col("part") == "path", F.col("weight") - F.col("c.weight")).otherwise(F.col("weight")).alias("weight"),
        F.col("piece").alias("top"), "leaf", "own", (F.col("leaves") + added * F.col("add_leaves")).alias("leaves"),
        (F.col("saved") + added * F.col("add_saved")).alias("saved"), (F.col("part") == "centroid").alias("found")),
        "trie-state")


def _split_inside_tasks(state: DataFrame) -> DataFrame:
    flat = state.select(F.col("top.a").alias("ta"), F.col("top.b").alias("tb"), "depth", F.col("node.a").alias("a"),
                        F.col("node.b").alias("b"), F.col("parent.a").alias("pa"), F.col("parent.b").alias("pb"),
                        "leaf", "own", "leaves", "saved")
    schema = "a bigint, b bigint, leaves bigint, saved bigint"
    return (flat.repartition("ta", "tb").sortWithinPartitions("ta", "tb", "depth").mapInArrow(_components, schema)
            .select(_node("a", "b").alias("node"), "leaves", "saved"))


def _components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rest = None
    for batch in batches:
        table = pa.table(batch) if rest is None else pa.concat_tables([rest, pa.table(batch)]).combine_chunks()
        ta, tb = table["ta"].to_numpy(), table["tb"].to_numpy()
        cuts = np.flatnonzero((ta[1:] != ta[:-1]) | (tb[1:] != tb[:-1])) + 1
        if len(cuts):  # the last component may go on in the next batch
            yield from _totals(table.slice(0, cuts[-1]), cuts)
        rest = table.slice(cuts[-1]) if len(cuts) else table
    if rest is not None and len(rest):
        yield from _totals(rest, np.array([len(rest)]))


def _totals(table: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    keys = list(zip(table["a"].to_pylist(), table["b"].to_pylist(), strict=True))
    above = list(zip(table["pa"].to_pylist(), table["pb"].to_pylist(), strict=True))
    leaf, own = table["leaf"].to_pylist(), table["own"].to_pylist()
    leaves, saved, at = table["leaves"].to_pylist(), table["saved"].to_pylist(), 0
    for end in cuts.tolist():
        place = {k: i for i, k in enumerate(keys[at:end])}
        sums = subtree_sums([place.get(p, -1) for p in above[at:end]], list(zip(leaf[at:end], own[at:end], strict=True)))
        for i, (x, y) in enumerate(sums, at):
            leaves[i] += x
            saved[i] += y
        at = end
    yield pa.RecordBatch.from_arrays([table["a"].combine_chunks(), table["b"].combine_chunks(),
                                      pa.array(leaves, pa.int64()), pa.array(saved, pa.int64())], ["a", "b", "leaves", "saved"])


def subtree_sums(parents: list[int], values: list[tuple[int, int]]) -> list[list[int]]:
    """Sums of the pairs ``values`` over the subtree of each node of one tree
    by centroid decomposition; nodes come in order of depth, the top's parent
    is -1."""
    n = len(parents)
    sums = [[0, 0] for _ in range(n)]
    home, size, homes = [0] * n, [0] * n, 1
    todo = [list(range(n))]
    while todo:
        part = todo.pop()
        here = home[part[0]]
        for v in part:
            size[v] = 1
        for v in reversed(part):
            p = parents[v]
            if p >= 0 and home[p] == here:
                size[p] += size[v]
        centroid = next(v for v in reversed(part) if 2 * size[v] >= len(part))
        x, y = values[centroid]
        above, below = [], {}
        home[centroid] = -1
        for v in part:
            p = parents[v]
            if v == centroid:
                continue
            if p == centroid:
                home[v], homes = homes, homes + 1
                below[home[v]] = [v]
            elif p >= 0 and home[p] in below:
                home[v] = home[p]
                below[home[v]].append(v)
            else:
                above.append(v)
                continue
            x, y = x + values[v][0], y + values[v][1]
        for v in (centroid, *(v for v in above if 2 * size[v] >= len(part))):
            sums[v][0] += x
            sums[v][1] += y
        todo += [*below.values(), *([above] if above else [])]
    return sums


# --- ends

def _ends(rows: DataFrame) -> DataFrame:
    """(node, conv_id) -> (node, ends_sha256) of the ascending ids, comma-joined."""
    flat = rows.select(F.col("node.a").alias("a"), F.col("node.b").alias("b"), "conv_id")
    return (flat.repartition("a", "b").sortWithinPartitions("a", "b", "conv_id")
            .mapInArrow(_hash_ids, "a bigint, b bigint, ends_sha256 string")
            .select(_node("a", "b").alias("node"), "ends_sha256"))


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, digest = None, None
    for batch in batches:
        out = []
        a, b, ids = (batch.column(k).to_pylist() for k in range(3))
        for key, i in zip(zip(a, b, strict=True), ids, strict=True):
            if key == node:
                digest.update(b",%d" % i)
            else:
                if node is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256(b"%d" % i)
        yield _rows(out)
    if node is not None:
        yield _rows([(*node, digest.hexdigest())])


def _rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    a, b, s = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.string())],
                                      ["a", "b", "ends_sha256"])
