"""Reproducible shuffles, batches, shards and per-row random decisions
(B2-B12, W2, W6, W7).  Every draw is B1 on a row key, never a generator
stream, so the result does not depend on partitioning or retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlake.functions.rand import hash_uniform, permute
from pairlake.functions.util import col
from pairlake.operators.index import global_index


def epoch_order(df: DataFrame, key: str, epochs: int = 1, seed: int = 0, shuffle: bool = True,
                name: str = "position", fast: bool = False) -> DataFrame:
    """B2: each epoch is an independent full permutation of the rows (sort key
    B1(key, seed, epoch), ties by key); ``shuffle=False`` keeps key order.
    Keys are replicated per epoch with ``explode`` and indexed with W1 on
    (epoch, draw, key), so one global position = epoch * N + position.  Only
    the key travels through the index (join payload columns back by key)."""
    e = df.select(key, F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    u = hash_uniform(key, seed, F.col("epoch"), fast) if shuffle else F.lit(0.0)
    e = e.withColumn("_u", u)
    idx = global_index(e, ["epoch", "_u", key], "_g")
    n = F.col("_g") - F.col("epoch") * F.lit(df.count())
    return idx.withColumn(name, n).drop("_u").withColumnRenamed("_g", "global_position")


def permuted_epochs(df: DataFrame, index: str, n: int, epochs: int = 1, seed: int = 0, name: str = "position",
                    fast: bool = False) -> DataFrame:
    """B2 for rows that are numbered 0..n-1 (W1, once): each epoch's place is
    a keyed permutation of the row's number, so an epoch costs neither a sort
    nor an exchange and a rank finds its rows (B3) by a filter where they are."""
    e = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    place = permute(index, n, seed, F.col("epoch"), fast)
    return e.withColumn(name, place).withColumn("global_position", F.col("epoch") * F.lit(n) + F.col(name))


def rank_shard(df: DataFrame, global_pos: str, rank: int, world: int, start_idx: int = 0) -> DataFrame:
    """Positions start_idx + rank, + world, ... belong to ``rank``; ``step``
    is the sample's ordinal on that rank."""
    g = F.col(global_pos) - F.lit(start_idx)
    return (df.filter((g >= rank) & (F.pmod(g - F.lit(rank), F.lit(world)) == 0))
            .withColumn("step", F.floor((g - F.lit(rank)) / F.lit(world)).cast("long")))


def assign_workers(df: DataFrame, idx: str, n_workers: int, name: str = "worker") -> DataFrame:
    """Round-robin worker = index mod n."""
    return df.withColumn(name, F.pmod(F.col(idx), F.lit(n_workers)).cast("int"))


def batch_rows(df: DataFrame, index: str, batch_size: int, drop_last: bool = True, n: int | None = None) -> DataFrame:
    """batch = index div B; with ``drop_last`` the incomplete tail batch is
    dropped (index < (n div B) * B)."""
    out = df.withColumn("batch", F.floor(F.col(index) / batch_size).cast("long")).withColumn(
        "pos_in_batch", F.pmod(F.col(index), F.lit(batch_size)).cast("int"))
    if drop_last:
        total = n if n is not None else df.count()
        out = out.filter(F.col(index) < F.lit((total // batch_size) * batch_size))
    return out


def split_rows(df: DataFrame, index: str, split_size: int = 5000) -> DataFrame:
    """Contiguous splits by row order; the last may be short."""
    return df.withColumn("split", F.floor(F.col(index) / split_size).cast("long"))


def roll(df: DataFrame, batch: str, pos: str, value: str, name: str = "rolled") -> DataFrame:
    """Circular shift inside a batch -- row i gets row i-1's value, row 0
    gets the last row's.  Batches are bounded (batch size), so the window per
    batch stays small."""
    w = Window.partitionBy(batch).orderBy(pos)
    last = F.last(F.col(value)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn(name, F.coalesce(F.lag(F.col(value), 1).over(w), last))


def label_dropout(label, key, p: float, num_classes: int, seed: int = 0, force=None, train: bool = True,
                  fast: bool = False) -> Column:
    """With probability p the label becomes the null class ``num_classes``;
    a ``force`` column (1 = drop) overrides the draw; outside training and
    without ``force`` labels pass unchanged."""
    lab = col(label)
    if force is not None:
        drop = col(force) == 1
    elif train and p > 0:
        drop = hash_uniform(key, seed, 0, fast) < F.lit(p)
    else:
        return lab
    return F.when(drop, F.lit(num_classes)).otherwise(lab)


def caption_dropout(df: DataFrame, key: str, value: str, null_value: Column, p: float = 0.1,
                    seed: int = 0, fast: bool = False) -> DataFrame:
    """With probability p a row's whole caption matrix becomes the shared
    null embedding (J9)."""
    return df.withColumn(value, F.when(hash_uniform(key, seed, 0, fast) < F.lit(p), null_value)
                         .otherwise(F.col(value)))


def balanced_labels(index, num_classes: int, balanced: bool = True, seed: int = 0) -> Column:
    """label = sample index mod classes, else a uniform class draw."""
    if balanced:
        return F.pmod(col(index), F.lit(num_classes)).cast("long")
    return F.floor(hash_uniform(index, seed) * num_classes).cast("long")


_POS = 2 ** 31  # positions are < 2^31, so u32 * 2^31 + pos fits a signed long


# Per-row array work below follows one rule: arrays are only ever passed as
# arguments of transform / zip_with / array_sort, never looked up by index
# from inside a lambda.  Catalyst may inline an upstream array expression
# into the lambda, which would recompute it for every element (O(T^2)).


def draw_keys(n, key, seed: int, fast: bool = False) -> Column:
    """Sort keys u32(key, seed, i) * 2^31 + i for positions 0..n-1, where
    u32 is the (i mod 4)-th 32-bit slice of md5(key|seed|i div 4): one md5
    feeds four draws, and the position rides in the low bits.  ``fast`` uses
    the top 31 bits of xxhash64(key, seed, i) instead (Spark-only, no
    string hashing)."""
    if fast:
        return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (
            F.shiftrightunsigned(F.xxhash64(col(key), F.lit(int(seed)), i), 33) * F.lit(_POS) + i))
    nb = F.greatest(F.floor((n - 1) / 4).cast("int"), F.lit(0))
    digests = F.transform(F.sequence(F.lit(0), nb), lambda b: F.md5(
        F.concat_ws("|", col(key).cast("string"), F.lit(str(seed)), b.cast("string"))))
    per_pos = F.slice(F.flatten(F.transform(digests, lambda d: F.array(d, d, d, d))), 1, n)
    return F.zip_with(per_pos, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda d, i: (
        F.conv(F.substring(d, (i % 4) * 8 + 1, 8), 16, 10).cast("long") * F.lit(_POS) + i))


def drop_tokens(df: DataFrame, tokens: str, key: str, head: int, ratio: float, seed: int = 0,
                kept: str = "kept", ids: str = "ids", fast: bool = False) -> DataFrame:
    """Keep the first ``head`` tokens; of the other T keep
    max(1, int(T * (1 - ratio))) in random (shuffled) order.  No drop (``ids``
    NULL, ``kept`` = tokens) when ratio <= 0, T <= 1 or everything would be
    kept.  ``ids`` are the kept positions (0-based, after the head)."""
    t = F.col(tokens)
    rest = F.size(t) - F.lit(head)
    keep = F.greatest(F.lit(1), F.floor(rest.cast("double") * F.lit(1.0 - ratio)).cast("int"))
    noop = (F.lit(ratio <= 0.0)) | (rest <= 1) | (keep >= rest)
    tagged = F.zip_with(draw_keys(rest, key, seed, fast), F.slice(t, head + 1, F.greatest(rest, F.lit(1))),
                        lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    chosen = F.slice(F.array_sort(tagged), 1, keep)
    out = df.withColumn("_c", F.when(~noop, chosen))
    out = out.withColumn(ids, F.transform("_c", lambda s: (s["k"] % F.lit(_POS)).cast("int")))
    picked = F.concat(F.slice(t, 1, head), F.transform("_c", lambda s: s["v"]))
    return out.withColumn(kept, F.when(F.col("_c").isNull(), t).otherwise(picked)).drop("_c")


def pad_with_mask(kept, ids, head: int, full, mask) -> Column:
    """Scatter the kept tokens back to their positions (``full`` = number
    of droppable positions, int or Column), ``mask`` elsewhere; the head is
    unchanged.  NULL ids (no drop) pass through.  O(T log T): kept tokens and
    masked gaps are tagged with their position and sorted."""
    k, i = col(kept), col(ids)
    body = F.slice(k, head + 1, F.greatest(F.size(k) - F.lit(head), F.lit(1)))
    n = F.lit(full) if isinstance(full, int) else full
    placed = F.zip_with(i, body, lambda p, v: F.struct(p.cast("int").alias("p"), v.alias("v")))
    gaps = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), i.cast("array<int>")),
                       lambda p: F.struct(p.alias("p"), F.lit(mask).alias("v")))
    scattered = F.transform(F.array_sort(F.concat(placed, gaps)), lambda s: s["v"])
    return F.when(i.isNull(), k).otherwise(F.concat(F.slice(k, 1, head), scattered))


def batch_flag(batch, p: float, seed: int = 0, fast: bool = False) -> Column:
    """One random decision per batch, shared by every row of it."""
    return hash_uniform(batch, seed, 0, fast) < F.lit(p)


def flip_flag(key, p: float = 0.5, seed: int = 0, fast: bool = False) -> Column:
    """Random horizontal flip decision per image."""
    return hash_uniform(key, seed, 0, fast) < F.lit(p)


def sample_plan(spark, n: int, per_worker: int, world: int) -> DataFrame:
    """total = ceil(n / global_batch) * global_batch sample slots;
    index = slot * world + rank + iteration * global_batch."""
    gb = per_worker * world
    total = -(-n // gb) * gb
    r = spark.range(total).withColumnRenamed("id", "sample_index")
    rem = F.pmod(F.col("sample_index"), F.lit(gb))
    return r.select("sample_index",
                    F.floor(F.col("sample_index") / gb).cast("long").alias("iteration"),
                    F.pmod(rem, F.lit(world)).cast("int").alias("rank"),
                    F.floor(rem / world).cast("int").alias("slot"))


def ceil_multiple(n, b) -> Column:
    """ceil(n / b) * b for positive integers."""
    nn = col(n).cast("long")
    bb = F.lit(b).cast("long") if isinstance(b, int) else col(b).cast("long")
    top = nn + bb - F.lit(1)
    return top - F.pmod(top, bb)
