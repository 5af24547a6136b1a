"""Operator 7: quality by compression.

Two zstandard dictionaries are built from segments of good and of bad labelled
texts.  A text is cut into segments of ``SEGMENT`` bytes, each of which is
compressed with either dictionary; what the good one saves over the bad one, as
a share of the text's bytes, is its normalised compressed-size difference.  It
is calibrated to a probability of label 1 by a logistic fit on labelled texts
that built no dictionary, together with the same difference over the lowest
quarter of the segments (a text that is bad in part) and the compressed share
itself (a text that repeats itself looks alike to both dictionaries).

Bounds of the fit, both parameters: ``per_label`` labelled rows of each label
(least hashes of their ids), half for the dictionaries and half for the
calibration, each read whole; ``dictionary`` bytes.  Scoring reads every byte
of every text.

Defined results: a null or empty text is one empty segment and gets a score
like any other; without labelled rows of both labels every score is the
smoothed share of label 1; too little text for zstandard's dictionary builder
gives raw-content dictionaries; labels other than 0 and 1, null ids, and ids
that are labelled both ways are not used; equal texts get equal scores; other columns are passed through, whatever
their names, one named like the added column is replaced; an empty table gives an empty table.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlake.llm.text import Numbered, arrow_column, as_bytes, pick
from pairlake.operators.index import pin

SEGMENT = 512
LEVEL = 3
FEATURES = 4


@dataclass(frozen=True)
class Model:
    bad: bytes
    good: bytes
    raw: bool  # raw-content dictionaries
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]  # constant first; shorter if nothing could be learnt


def _dictionary(data: bytes, raw: bool) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(
        data, dict_type=zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_FULLDICT)


class Measure:
    """``measure(text bytes)`` -> the features of a text; built once per task."""

    def __init__(self, model: Model):
        self._sizes = []
        for data in (model.bad, model.good):
            content = _dictionary(data, model.raw)
            content.precompute_compress(level=LEVEL)
            self._sizes.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=content, write_content_size=False, write_checksum=False,
                write_dict_id=False).compress)

    def __call__(self, raw: bytes | None) -> list[float]:
        raw = raw or b""
        parts = [raw[i:i + SEGMENT] for i in range(0, len(raw), SEGMENT)] or [b""]
        bad, good = (np.array([len(size(p)) for p in parts], dtype=float) for size in self._sizes)
        length = np.array([max(len(p), 1) for p in parts], dtype=float)
        difference, share = (bad - good) / length, np.minimum(bad, good) / length
        quarter = max(1, len(parts) // 4)
        return [(bad.sum() - good.sum()) / length.sum(), np.partition(difference, quarter - 1)[:quarter].mean(),
                share.mean(), np.partition(share, quarter - 1)[:quarter].mean()]


def _build(samples: list[list[bytes]], size: int) -> tuple[list[bytes], bool]:
    try:
        return [zstandard.train_dictionary(size, s).as_bytes() for s in samples], False
    except zstandard.ZstdError:  # too little text
        return [b"\n".join(s)[-size:].rjust(8) for s in samples], True


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """Weighted ridge logistic regression by Newton steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    a = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(a.shape[1])
    ridge = 1e-2 * np.eye(len(w))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p) + 1e-9)[:, None]).T @ a + ridge,
                               a.T @ (weight * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text",
        per_label: int = 3000, dictionary: int = 110_000) -> Model:
    """Learn from the rows of ``labels`` (already without any that are held
    out)."""
    known = pick(labels, _id=doc_id, _y=label).withColumn("_y", F.col("_y").cast("int")).filter(
        "_id is not null and _y in (0, 1)").groupBy("_id").agg(
        F.min("_y").alias("_y"), F.max("_y").alias("_z")).filter("_y = _z").drop("_z")
    shares = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    constant = np.log((shares.get(1, 0) + 1) / (shares.get(0, 0) + 1))
    nothing = Model(b"", b"", True, (), (), (float(constant),))
    if len(shares) < 2:
        return nothing
    draw = F.xxhash64("_id")
    chosen = known.filter("_y = 0").orderBy(draw, "_id").limit(per_label).union(
        known.filter("_y = 1").orderBy(draw, "_id").limit(per_label))  # at most 2 * per_label small rows
    sample = pin(pick(docs, _id=doc_id, _t=text).withColumn("_t", F.encode("_t", "utf-8"))
                 .join(F.broadcast(chosen), "_id").withColumn("_dict", F.pmod(draw, F.lit(2)) == 0))
    found: dict[int, list[bytes]] = {0: [], 1: []}
    for r in sample.filter("_dict and length(_t) > 0").select("_id", "_y", "_t").orderBy("_id", "_t").toLocalIterator():
        found[r["_y"]] += [bytes(r["_t"][i:i + SEGMENT]) for i in range(0, len(r["_t"]), SEGMENT)]
    if not found[0] or not found[1]:
        return nothing
    (bad, good), raw = _build([found[0], found[1]], dictionary)
    bare = Model(bad, good, raw, (), (), ())
    rows = (sample.filter("not _dict").select("_y", measures(F.col("_t"), bare).alias("x")).collect())
    if len({r["_y"] for r in rows}) < 2:
        return nothing
    y = np.array([r["_y"] for r in rows], dtype=float)
    balance = np.array([shares[int(v)] / (y == v).sum() for v in y]) * len(y) / sum(shares.values())
    mean, scale, w = _logistic(np.array([r["x"] for r in rows]), y, balance)
    return Model(bad, good, raw, tuple(mean.tolist()), tuple(scale.tolist()), tuple(w.tolist()))


def measures(text, model: Model):
    """Column of the features of a text (string or binary)."""
    def kernel():
        measure = Measure(model)
        return lambda texts: pa.array([measure(t) for t in as_bytes(texts)], type=pa.list_(pa.float64()))

    return arrow_column(kernel, "array<double>")(text)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Append ``out``: the probability of label 1, from the text alone."""
    rows = Numbered(df)
    if len(model.weights) == 1:
        same = F.lit(float(1 / (1 + np.exp(-model.weights[0]))))
        return rows.named(rows.df.withColumn("score", same), **{out: "score"})

    def kernel():
        measure = Measure(model)
        mean, scale, w = map(np.array, (model.mean, model.scale, model.weights))

        def score_all(texts):
            x = np.array([measure(t) for t in as_bytes(texts)]).reshape(-1, FEATURES)
            z = w[0] + ((x - mean) / scale) @ w[1:]
            return pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return score_all

    return rows.named(rows.df.withColumn("score", arrow_column(kernel, "double")(F.col(rows(text)))), **{out: "score"})


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of the ids that no label is learnt from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0
