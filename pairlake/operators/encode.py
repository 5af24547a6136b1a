"""Batched feature extraction with a caller-supplied model.

``predict_batch_udf`` builds the model once per Python worker (the factory
runs lazily on the executor, the model is never pickled from the driver) and
feeds it Arrow batches of ``batch_size`` rows as numpy arrays.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def encode_features(df: DataFrame, vec: str, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]],
                    dim_in: int, out: str = "features", batch_size: int = 64) -> DataFrame:
    """Append ``out`` = model(vec) computed batch by batch on executors."""
    udf = predict_batch_udf(make_model, return_type=ArrayType(DoubleType()), batch_size=batch_size,
                            input_tensor_shapes=[[dim_in]])
    return df.withColumn(out, udf(F.col(vec).cast("array<double>")))


def linear_map_weights(dim_in: int, dim_out: int) -> np.ndarray:
    """The fixed test encoder: W[i, j] = ((7 i + 13 j) mod 17 - 8) / 8."""
    i = np.arange(dim_in)[:, None]
    j = np.arange(dim_out)[None, :]
    return (((7 * i + 13 * j) % 17) - 8) / 8.0


def linear_model_factory(dim_in: int, dim_out: int):
    """Factory for ``encode_features``: returns the batch predict function."""
    def make():
        w = linear_map_weights(dim_in, dim_out)

        def predict(x: np.ndarray) -> np.ndarray:
            return np.asarray(x, dtype=np.float64).reshape(len(x), dim_in) @ w
        return predict
    return make
