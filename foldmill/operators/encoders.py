"""Encoders of texts and images: an interface for models, and a deterministic default that needs none."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Batch sizes and the longest text of a text model, in tokens.
IMAGE_BATCH, TEXT_BATCH, TEXT_TOKENS = 32, 16, 512


def model_column(make: Callable[[], Callable[[np.ndarray], np.ndarray]], column: Column, batch: int = TEXT_BATCH) -> Column:
    """Vectors of an external model.

    ``make`` loads the model once in each worker and gives a function from a
    batch of inputs to a matrix with a row for each.
    """
    return predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch)(column)


def hashed_text(df: DataFrame, text: str, out: str = "features", width: int = 256) -> DataFrame:
    """Hashed word frequencies weighted by rarity: the default text encoder."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    counted = HashingTF(inputCol="_w", outputCol="_t", numFeatures=width).transform(df.withColumn("_w", words))
    weighted = IDF(inputCol="_t", outputCol="_v").fit(counted).transform(counted)
    return weighted.withColumn(out, vector_to_array("_v").cast("array<float>")).drop("_w", "_t", "_v")


def stub_image_encoder(width: int = 64) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A stand-in for a vision model: a fixed random projection of pixel values."""

    def make() -> Callable[[np.ndarray], np.ndarray]:
        def encode(batch: np.ndarray) -> np.ndarray:
            flat = np.asarray(batch, np.float32).reshape(len(batch), -1)
            weights = np.random.RandomState(0).standard_normal((flat.shape[1], width)).astype(np.float32)
            return flat @ weights / np.sqrt(flat.shape[1], dtype=np.float32)

        return encode

    return make
