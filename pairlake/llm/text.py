"""Shared helpers of the text operators: Arrow column functions that see a
text column in bounded pieces."""

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

PIECE_BYTES = 2 << 20  # text turned into Python objects at a time (one longer text is taken whole)


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[pa.Array]:
    """Cut an Arrow string / binary array into slices of about ``limit`` bytes,
    at least one row each."""
    n, start = len(column), 0
    if n == 0 or column.nbytes <= limit:
        yield column
        return
    lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    size = 0
    for i, k in enumerate(lengths):
        if i > start and size + k > limit:
            yield column.slice(start, i - start)
            start, size = i, 0
        size += k
    yield column.slice(start, n - start)


def arrow_column(make_kernel: Callable[[], Callable[..., pa.Array]], return_type: DataType | str):
    """A Spark column function from a factory of Arrow kernels.

    ``make_kernel`` runs once per task and returns ``kernel(*arrays) -> array``
    of the same length, called on pieces of bounded size (by the first, text
    column).  The function is marked non-deterministic so that Catalyst never
    evaluates it twice to push a filter down.
    """
    @F.arrow_udf(return_type)
    def column(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        kernel = make_kernel()
        for batch in batches:
            batch = batch if isinstance(batch, tuple) else (batch,)  # one argument comes bare
            parts, at = [], 0
            for piece in pieces(batch[0]):
                parts.append(kernel(piece, *(c.slice(at, len(piece)) for c in batch[1:])))
                at += len(piece)
            yield parts[0] if len(parts) == 1 else pa.concat_arrays(parts)

    return column.asNondeterministic()


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def without(df: DataFrame, names: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """Drop input columns that clash (in any case) with columns an operator adds."""
    added, kept = {n.lower() for n in names}, {n.lower() for n in keep}
    return df.drop(*[c for c in df.columns if c.lower() in added and c.lower() not in kept])


class Numbered:
    """A table whose columns are known by their place, so that no name of an
    input column, whatever its case and even with dots, meets one that an
    operator adds.  ``df`` has the columns as c0, c1, ...; a call gives the
    place of a name: the exact one, or else as Spark finds it, in any case."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.df = df.toDF(*[f"c{i}" for i in range(len(self.names))])

    def __call__(self, name: str) -> str:
        same = [i for i, c in enumerate(self.names) if c == name] or [
            i for i, c in enumerate(self.names) if c.lower() == name.lower()]
        if not same:
            raise ValueError(f"no column {name} among {self.names}")
        return f"c{same[0]}"

    def named(self, out: DataFrame, **added: str) -> DataFrame:
        """``out`` under the input's names, then the ``added`` columns (name =
        column of ``out``), which replace input columns of their names."""
        gone = {a.lower() for a in added}
        kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(self.names) if c.lower() not in gone]
        return out.select(*kept, *[F.col(c).alias(name) for name, c in added.items()])


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns named by the values, under the names of the keyword
    arguments."""
    rows = Numbered(df)
    return rows.df.select(*[F.col(rows(name)).alias(new) for new, name in columns.items()])
