"""B1: randomness as a pure function of (key, seed, draw index).

Stateful generator streams depend on partition layout and task retries; a hash
of the row key does not, so retries and re-plans give the same draws.  The md5
form is portable (DuckDB computes the same value); ``fast=True`` uses
xxhash64, which stays inside whole-stage codegen but is Spark-only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlake.functions.util import col

_TWO_32 = 4294967296.0
_TWO_53 = float(2**53)


def _key_text(key, seed, i) -> Column:
    parts = [col(key).cast("string"), F.lit(str(seed)), i.cast("string") if isinstance(i, Column) else F.lit(str(i))]
    return F.concat_ws("|", *parts)


def hash_uniform(key, seed: int = 0, i=0, fast: bool = False) -> Column:
    """Uniform draw in [0, 1) for (key, seed, i)."""
    if fast:
        h = F.xxhash64(col(key), F.lit(int(seed)), i if isinstance(i, Column) else F.lit(int(i)))
        return F.shiftrightunsigned(h, 11).cast("double") / F.lit(_TWO_53)
    hexpart = F.substring(F.md5(_key_text(key, seed, i)), 1, 8)
    return F.conv(hexpart, 16, 10).cast("long") / F.lit(_TWO_32)


def hash_normal(key, seed: int = 0, i=0, fast: bool = False) -> Column:
    """Standard normal draw (Box-Muller over two uniform draws 2i and 2i+1)."""
    ii = i if isinstance(i, Column) else F.lit(int(i))
    u1 = F.lit(1.0) - hash_uniform(key, seed, ii * 2, fast)
    u2 = hash_uniform(key, seed, ii * 2 + 1, fast)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def sql_hash_uniform(key_sql: str, seed: int = 0, i: int | str = 0) -> str:
    """The same draw as DuckDB SQL text (used by the oracle queries)."""
    i_sql = f"CAST({i} AS VARCHAR)" if isinstance(i, str) else f"'{i}'"
    return (f"(('0x' || substr(md5(concat_ws('|', CAST({key_sql} AS VARCHAR), '{seed}', {i_sql})), 1, 8))"
            f"::BIGINT / 4294967296.0)")


# ---------------------------------------------------------------- permutations

ROUNDS = 3


def _sides(n: int) -> tuple[int, int]:
    """a x b >= n with fewer than a cells to spare."""
    a = math.isqrt(max(n - 1, 0)) + 1
    return a, -(-n // a) or 1


def permute(i, n: int, seed: int = 0, epoch=0, fast: bool = False) -> Column:
    """The place of 0 <= i < n under a keyed permutation of 0..n-1, without
    sorting: a Feistel network over the cells of an a x b grid just larger
    than n.  Every half round adds a hash of one coordinate to the other.  A
    result in one of the fewer than a spare cells is sent on (cycle walking),
    which concerns about one row in a; the walk passes each spare cell at most
    once, so it ends."""
    a, b = _sides(n)
    e = epoch if isinstance(epoch, Column) else F.lit(int(epoch))

    def mix(x, j) -> Column:
        if fast:
            return F.shiftrightunsigned(F.xxhash64(x, F.lit(int(seed)), e, j), 32)
        text = F.concat_ws("|", x.cast("string"), F.lit(str(seed)), e.cast("string"), j.cast("string"))
        return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")

    def cell(left, right) -> Column:
        return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(s, j):
        left = F.pmod(s["l"] + mix(s["r"], j * 2), F.lit(a))
        return cell(left, F.pmod(s["r"] + mix(left, j * 2 + 1), F.lit(b)))

    def once(x) -> Column:
        start = cell(F.pmod(x, F.lit(a)), F.floor(x / F.lit(a)))
        return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, step, lambda s: s["r"] * F.lit(a) + s["l"])

    first, spare = once(col(i).cast("long")), a * b - n
    if not spare:
        return first
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(spare)), first, lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(first < n, first).otherwise(walk)


def sql_permute(i_sql: str, n_sql: str, seed: int = 0, epoch_sql: str = "0") -> str:
    """The same place as DuckDB SQL text; ``n_sql`` is a column or expression."""
    a = f"CAST(ceil(sqrt({n_sql})) AS BIGINT)"
    b = f"CAST(ceil({n_sql} / ceil(sqrt({n_sql}))) AS BIGINT)"

    def mix(x, j):
        return f"('0x' || substr(md5(concat_ws('|', CAST({x} AS VARCHAR), '{seed}', CAST({epoch_sql} AS VARCHAR), CAST({j} AS VARCHAR))), 1, 8))::BIGINT"

    left = f"((s[1] + {mix('s[2]', 'j[1] * 2')}) % {a})"
    rounds = ", ".join(f"[{j}, {j}]" for j in range(ROUNDS))

    def once(x):
        return (f"list_reduce([[CAST({x} % {a} AS BIGINT), CAST({x} // {a} AS BIGINT)], {rounds}], "
                f"lambda s, j: [{left}, (s[2] + {mix(left, 'j[1] * 2 + 1')}) % {b}])")
    first = f"(SELECT c[2] * {a} + c[1] FROM (SELECT {once(i_sql)} AS c))"
    again = f"list_transform([{once('x')}], lambda c: c[2] * {a} + c[1])[1]"
    return f"list_reduce(list_prepend({first}, range({a} * {b} - {n_sql})), lambda x, y: CASE WHEN x < {n_sql} THEN x ELSE {again} END)"
