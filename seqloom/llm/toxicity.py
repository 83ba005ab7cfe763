"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

An n-gram of 4 to 6 characters is a feature, hashed into a table. A feature's ratio r is the logarithm of how much more
often toxic than other texts hold it, with one added to every count. Features that few texts hold, or whose ratio is small,
are left out. A text's value for a feature is r if it holds the feature and 0 if not, and logistic regression on these
values gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import mix, text_or_empty
from seqloom.session import cut_lineage

ORDERS = (4, 5, 6)
BITS = 20
SAMPLE_PER_CLASS = 6_000
# Of one training text at most so many features take part in the fit, those with the largest ratios.
FEATURES_PER_TEXT = 4_096
LEAST_TEXTS = 4
LEAST_RATIO = 1.5
BLOCK_CHARS = 1 << 19


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case texts with a space around each, one after the other, and where each starts."""
    padded = [f" {text.lower()} ".encode("utf-32-le", "surrogatepass") for text in texts]
    lengths = np.array([len(data) // 4 for data in padded], np.int64)
    return np.frombuffer(b"".join(padded), "<u4"), np.concatenate([[0], np.cumsum(lengths)])


def _white(points: np.ndarray) -> np.ndarray:
    """Every white space character becomes a space."""
    return np.where((points <= 0x20) | (points == 0xA0) | (points == 0x2028) | (points == 0x3000), 0x20, points)


def _features(texts: list[str], orders, bits: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, feature) pairs; only features for which `wanted` is true, if it is given."""
    points, starts = _code_points(texts)
    symbols = _white(points).astype(np.uint64)
    text_of = np.repeat(np.arange(len(texts)), np.diff(starts))
    rows, found, h = [], [], symbols
    for order in range(2, max(orders) + 1):
        h = mix(h[:-1], symbols[order - 1 :])
        if order not in orders:
            continue
        feature = (h >> np.uint64(64 - bits)).astype(np.int64)
        inside = text_of[: len(h)] == text_of[order - 1 :]
        if wanted is not None:
            inside &= wanted[feature]
        at = np.flatnonzero(inside)
        rows.append(text_of[at])
        found.append(feature[at])
    key = np.unique(np.concatenate(rows) << bits | np.concatenate(found))
    return key >> bits, key & ((1 << bits) - 1)


def _blocks(texts: list[str], size: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str]]]:
    first, chars = 0, 0
    for n, text in enumerate(texts):
        chars += len(text)
        if chars >= size:
            yield first, texts[first : n + 1]
            first, chars = n + 1, 0
    if first < len(texts):
        yield first, texts[first:]


@dataclass(frozen=True)
class Model:
    """Weight per feature, already multiplied by its ratio, and the constant term."""

    weights: np.ndarray
    bias: float
    orders: tuple[int, ...] = ORDERS
    bits: int = BITS

    def scores(self, texts: list[str]) -> np.ndarray:
        wanted = self.weights != 0
        sums = np.zeros(len(texts))
        for first, block in _blocks(texts):
            rows, features = _features(block, self.orders, self.bits, wanted)
            sums[first : first + len(block)] = np.bincount(rows, self.weights[features], len(block))
        return 1.0 / (1.0 + np.exp(-np.clip(sums + self.bias, -30, 30)))


def log_count_ratios(counts: pd.DataFrame, n_toxic: int, n_other: int, size: int) -> np.ndarray:
    """Ratios by feature from the columns feature, toxic, other (texts that hold it); 0 for features left out."""
    ratios = np.zeros(size)
    toxic, other = counts["toxic"].to_numpy(float), counts["other"].to_numpy(float)
    r = np.log((toxic + 1) / (n_toxic + 2)) - np.log((other + 1) / (n_other + 2))
    r[(toxic + other < LEAST_TEXTS) | (np.abs(r) < LEAST_RATIO)] = 0
    ratios[counts["feature"].to_numpy()] = r
    return ratios


def _strongest(features: np.ndarray, ratios: np.ndarray, most: int = FEATURES_PER_TEXT) -> np.ndarray:
    """The `most` features with the largest ratios, of equal ones the smallest, in ascending order."""
    if len(features) <= most:
        return features
    return np.sort(features[np.argsort(-np.abs(ratios[features]), kind="stable")[:most]])


def fit_logistic(
    rows: np.ndarray, values: np.ndarray, features: np.ndarray, labels: np.ndarray, size: int, penalty: float = 0.01,
    steps: int = 300,
) -> tuple[np.ndarray, float]:
    """Logistic regression with classes of equal total weight and an L2 penalty, by accelerated gradient descent."""
    share = np.where(labels == 1, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1))
    penalty = penalty / max(len(labels), 1)
    along, along_b = np.ones(size), 1.0
    for _ in range(20):  # the largest curvature, which bounds the step
        norm = max(float(np.sqrt(along @ along + along_b**2)), 1e-30)
        along, along_b = along / norm, along_b / norm
        product = share * (np.bincount(rows, values * along[features], len(labels)) + along_b)
        along, along_b = np.bincount(features, product[rows] * values, size), float(product.sum())
    bound = 0.3 * float(np.sqrt(along @ along + along_b**2)) + penalty
    w = ahead = np.zeros(size)
    b = b_ahead = 0.0
    for step in range(1, steps + 1):
        margin = np.bincount(rows, values * ahead[features], len(labels)) + b_ahead
        error = share * (1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30))) - labels)
        slope = np.bincount(features, error[rows] * values, size) + penalty * ahead
        new, b_new = ahead - slope / bound, b_ahead - error.sum() / bound
        momentum = (step - 1) / (step + 2)
        ahead, b_ahead = new + momentum * (new - w), b_new + momentum * (b_new - b)
        w, b = new, b_new
    return w, b


def train(
    docs: DataFrame, labels: DataFrame, usable: Column | None = None, key: str = "doc_id", text: str = "text",
    label: str = "toxic", sample_per_class: int = SAMPLE_PER_CLASS, orders: tuple[int, ...] = ORDERS, bits: int = BITS,
) -> Model:
    """Fit on at most `sample_per_class` labelled documents of each class, chosen by a hash of their key.

    `usable` (a condition on the label rows' key) keeps documents out of training. Labels that are null are ignored; of
    several labels of a document the largest counts, and of several rows with its key the smallest text is the example. With
    no toxic or no other example every score is 0.5 or less, or 0.5 or more: the model is then a constant. The driver fits on
    2 x `sample_per_class` x FEATURES_PER_TEXT numbers at most.
    """
    spark, size = docs.sparkSession, 1 << bits
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
    known = known if usable is None else known.filter(usable)
    known = known.groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("_label"))

    def chosen(value: int) -> DataFrame:
        return known.filter((F.col("_label") == 1) == F.lit(value == 1)).orderBy(F.xxhash64("_key"), "_key").limit(sample_per_class)

    # One row for each sampled key, so the size is bounded by the parameter, whatever the tables hold.
    sample = chosen(1).unionByName(chosen(0))
    examples = cut_lineage(
        docs.select(F.col(key).alias("_key"), text_or_empty(text).alias("text")).join(F.broadcast(sample), "_key")
        .groupBy("_key", "_label").agg(F.min("text").alias("text"))
        .select("text", (F.col("_label") == 1).cast("int").alias("toxic"))
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic, other = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            is_toxic = batch["toxic"].to_numpy() == 1
            for first, block in _blocks(batch["text"].tolist()):
                rows, features = _features(block, orders, bits)
                mark = is_toxic[first + rows]
                toxic += np.bincount(features[mark], minlength=size)
                other += np.bincount(features[~mark], minlength=size)
        held = np.flatnonzero(toxic + other)
        yield pd.DataFrame({"feature": held, "toxic": toxic[held], "other": other[held]})

    totals = {row["toxic"]: row["count"] for row in examples.groupBy("toxic").count().collect()}
    n_toxic, n_other = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_other:
        return Model(np.zeros(size), 0.0 if not n_toxic + n_other else (4.0 if n_toxic else -4.0), orders, bits)
    counts = (
        examples.mapInPandas(count, "feature long, toxic long, other long").groupBy("feature")
        .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        .filter(F.col("toxic") + F.col("other") >= LEAST_TEXTS)
    )
    ratios = log_count_ratios(counts.toPandas(), n_toxic, n_other, size)
    shared = spark.sparkContext.broadcast(ratios.astype(np.float32))

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = shared.value != 0
        for batch in batches:
            texts = batch["text"].tolist()
            parts: list[bytes] = []
            for _, block in _blocks(texts):
                rows, features = _features(block, orders, bits, wanted)
                cuts = np.searchsorted(rows, np.arange(1, len(block)))
                parts += [_strongest(part, shared.value).astype(np.int32).tobytes() for part in np.split(features, cuts)]
            yield pd.DataFrame({"features": parts, "toxic": batch["toxic"].to_numpy()})

    found = examples.mapInPandas(held, "features binary, toxic int").toPandas()
    shared.destroy()
    lists = [np.frombuffer(data, np.int32) for data in found["features"]]
    rows = np.repeat(np.arange(len(lists)), [len(part) for part in lists])
    features = np.concatenate(lists).astype(np.int64)
    distinct, which = np.unique(features, return_inverse=True)
    w, bias = fit_logistic(rows, ratios[features], which, found["toxic"].to_numpy().astype(float), len(distinct))
    weights = np.zeros(size)
    weights[distinct] = w * ratios[distinct]
    return Model(weights, bias, orders, bits)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` plus the score, from 0 to 1, of each whole text; null counts as empty. One map, no shuffle.

    A column of `docs` that is named like the score is replaced. The broadcast model has 2^bits weights."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias, model.orders, model.bits))

    def scored(texts: pd.Series) -> pd.Series:
        weights, bias, orders, bits = shared.value
        return pd.Series(Model(weights, bias, orders, bits).scores(texts.tolist()))

    return docs.withColumn(name, F.pandas_udf(scored, "double")(text_or_empty(text)))
