"""Text to vectors, and standardisation of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, predict_batch_udf
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from seqloom.functions.columns import model_text
from seqloom.schemas import ITEM

Encoder = Callable[[list[str]], np.ndarray]
# Characters that an encoder gets at once.
BATCH_CHARS = 1 << 20
# Keeps a constant dimension from dividing by zero.
STD_FLOOR = 1e-6


def hashed_ngrams(dim: int = 64, n: int = 3) -> Encoder:
    """Encoder that counts byte n-grams by hash bucket. It stands in where no model weights are at hand."""

    def encode(texts: list[str]) -> np.ndarray:
        pieces = [text.encode().ljust(n, b"\0") for text in texts]
        sizes = np.array([len(piece) for piece in pieces], dtype=np.int64)
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        row = np.repeat(np.arange(len(texts)), sizes)
        grams = np.zeros(max(len(data) - n + 1, 0), dtype=np.uint64)
        for place in reversed(range(n)):
            grams = grams * np.uint64(257) + data[place : place + len(grams)]
        # Fixed value: the multiplier of Fibonacci hashing for 32 bits.
        mixed = (grams ^ (grams >> np.uint64(32))) * np.uint64(2654435769) & np.uint64(0xFFFFFFFF)
        buckets = ((mixed >> np.uint64(16)) if dim <= 1 << 16 else mixed) % np.uint64(dim)
        inside = row[: len(grams)] == row[n - 1 :]
        flat = row[: len(grams)][inside] * dim + buckets[inside].astype(np.int64)
        return np.bincount(flat, minlength=len(texts) * dim).reshape(len(texts), dim).astype(np.float32)

    return lambda: encode


def embed(
    texts: DataFrame,
    encoder_factory: Callable[[], Encoder] = hashed_ngrams(),
    item: str = ITEM,
    text: str = "text",
    batch: int = 256,
    max_chars: int | None = None,
) -> DataFrame:
    """One vector per item, next to its key. The factory runs once per task, so a model is loaded there, not shipped."""
    keyed = texts.select(item, model_text(text, max_chars).alias(text))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder_factory()
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                vectors = np.asarray(encode(part[text].tolist()), dtype=np.float32)
                yield pd.DataFrame({item: part[item].to_numpy(), "embedding": list(vectors)})

    item_type = keyed.schema[item].dataType.simpleString()
    return keyed.mapInPandas(run, f"{item} {item_type}, embedding array<float>")


def embed_by_worker(
    texts: DataFrame, encoder_factory: Callable[[], Encoder], item: str = ITEM, text: str = "text", batch: int = 256,
    batch_chars: int = BATCH_CHARS, max_chars: int | None = None,
) -> DataFrame:
    """`embed` for models that are slow to load: a Python worker loads its own once and keeps it from task to task.

    At most `batch` texts, and `batch_chars` characters unless a single text has more, are encoded at once, so a worker holds
    the model and the activations of one such batch.
    """

    def load():
        encode = encoder_factory()

        def predict(values: np.ndarray) -> np.ndarray:
            words = ["" if value is None else str(value) for value in values.reshape(-1)]
            ends = np.cumsum([max(len(word), 1) for word in words])
            vectors, first = [], 0
            while first < len(words):
                spent = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, spent + batch_chars, side="right")))
                vectors.append(np.asarray(encode(words[first:last]), dtype=np.float32))
                first = last
            return np.concatenate(vectors)

        return predict

    encode_batch = predict_batch_udf(load, return_type=ArrayType(FloatType()), batch_size=batch)
    return texts.select(item, encode_batch(model_text(text, max_chars)).alias("embedding"))


def vector_stats(vectors: DataFrame, vector: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample standard deviation per dimension: one pass, merged in the JVM, two vectors on the driver."""
    summary = vectors.select(array_to_vector(F.col(vector)).alias("v")).select(
        Summarizer.metrics("mean", "std").summary(F.col("v")).alias("s")
    )
    row = summary.select("s.mean", "s.std").first()
    return row["mean"].toArray(), row["std"].toArray()


def standardize(
    vectors: DataFrame, vector: str = "embedding", stats: tuple[np.ndarray, np.ndarray] | None = None
) -> DataFrame:
    """(x - mean) / (std + 1e-6) in every dimension, in double precision; `stats` gives mean and std of an earlier fit."""
    mean, std = vector_stats(vectors, vector) if stats is None else stats
    shift = F.lit([float(value) for value in mean])
    scale = F.lit([float(value) for value in std + STD_FLOOR])
    centred = F.zip_with(F.col(vector).cast("array<double>"), shift, lambda x, m: x - m)
    return vectors.withColumn(vector, F.zip_with(centred, scale, lambda x, s: x / s))
