"""Residual quantisation: codebooks fitted level by level on what the earlier levels left over."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.session import cut_lineage, drop_stored

Codebooks = Sequence[np.ndarray]


def codebook_table(spark: SparkSession, codebooks: Codebooks) -> DataFrame:
    """Codebooks as rows (level, code, centroid); levels x codes rows, whatever the number of items."""
    rows = [
        (level, code, [float(x) for x in centre])
        for level, centres in enumerate(codebooks)
        for code, centre in enumerate(centres)
    ]
    return spark.createDataFrame(rows, "level INT, code INT, centroid ARRAY<DOUBLE>")


def codebooks_from_table(table: DataFrame) -> list[np.ndarray]:
    """Inverse of `codebook_table`."""
    rows = table.orderBy("level", "code").collect()
    levels = sorted({row["level"] for row in rows})
    return [np.array([row["centroid"] for row in rows if row["level"] == level]) for level in levels]


def model_table(spark: SparkSession, codebooks: Codebooks, mean: np.ndarray, std: np.ndarray) -> DataFrame:
    """Codebooks and standardisation in one small table: level -2 is the mean, level -1 the standard deviation."""
    stats = [(-2, 0, [float(x) for x in mean]), (-1, 0, [float(x) for x in std])]
    return codebook_table(spark, codebooks).unionByName(spark.createDataFrame(stats, "level INT, code INT, centroid ARRAY<DOUBLE>"))


def model_from_table(table: DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Inverse of `model_table`."""
    stats = {row["level"]: np.array(row["centroid"]) for row in table.filter("level < 0").collect()}
    return codebooks_from_table(table.filter("level >= 0")), stats[-2], stats[-1]


def quantize(vectors: DataFrame, codebooks: Codebooks, vector: str = "embedding", residual: str | None = None) -> DataFrame:
    """Add `codes` (one per level) and `sq_error` (squared residual norm after each level).

    At every level the nearest centroid is chosen, the lowest code when two are equally near, and subtracted. The
    codebooks go to each executor once; vectors pass through in Arrow batches. `residual` also keeps what is left. A NULL
    vector has NULL codes, error and rest.
    """
    shared = vectors.sparkSession.sparkContext.broadcast([np.asarray(c, dtype=np.float64) for c in codebooks])
    kind = "struct<codes: array<int>, sq_error: array<double>"
    kind += ", left: array<double>>" if residual else ">"

    @F.pandas_udf(kind)
    def assign(batch: pd.Series) -> pd.DataFrame:
        known = batch.notna().to_numpy()
        left = np.stack(batch[known].to_list()).astype(np.float64) if known.any() else np.zeros((0, 0))
        codes, errors = [], []
        for centres in shared.value if known.any() else []:
            # |x - c|^2 without |x|^2, which is the same for every centroid of a row.
            distance = (centres**2).sum(axis=1) - 2.0 * left @ centres.T
            nearest = distance.argmin(axis=1)
            left = left - centres[nearest]
            codes.append(nearest)
            errors.append((left**2).sum(axis=1))
        found = {
            "codes": list(np.stack(codes, axis=1).astype(np.int32)) if codes else [],
            "sq_error": list(np.stack(errors, axis=1)) if errors else [],
        }
        if residual:
            found["left"] = list(left)
        out = {}
        for name, values in found.items():
            given = iter(values)
            out[name] = [next(given) if there else None for there in known]
        return pd.DataFrame(out)

    assigned = vectors.withColumn("_q", assign(F.col(vector)))
    added = [F.col("_q.codes").alias("codes"), F.col("_q.sq_error").alias("sq_error")]
    if residual:
        added.append(F.col("_q.left").alias(residual))
    keep = [name for name in vectors.columns if name not in ("codes", "sq_error", residual)]
    return assigned.select(*keep, *added)


def fit_codebooks(
    vectors: DataFrame,
    levels: int = 3,
    k: int = 256,
    iterations: int = 10,
    seed: int = 42,
    vector: str = "embedding",
    start: str | None = None,
    spare: str | None = None,
) -> list[np.ndarray]:
    """One codebook per level: k-means from k random rows, then unused codes are revived and one more step is taken.

    `start` names a column that numbers the starting rows of every level from 0 to k-1 and is NULL elsewhere; the level is
    then fitted by exactly `iterations` plain steps from them, in which a centre without rows stays. `spare` names a column
    that numbers rows from 0 in the same way: every step counts the rows of each code, and codes without any move, in their
    order, to the next spare rows that the level has not taken yet, as long as there are some. Without `start`, a level
    has fewer than k centres if there are fewer distinct vectors. NULL vectors take no part. The residuals of each level
    are stored, since every k-means iteration reads them.
    """
    codebooks: list[np.ndarray] = []
    numbers = [(F.col(name) if name else F.lit(None)).cast("int").alias(alias) for name, alias in ((start, "_start"), (spare, "_spare"))]
    left = vectors.filter(F.col(vector).isNotNull())
    left = cut_lineage(left.select(F.col(vector).cast("array<double>").alias("_left"), *numbers))
    for level in range(levels):
        codebooks.append(_from_rows(left, iterations, bool(spare)) if start else _fit_level(left, k, iterations, seed))
        if level + 1 < levels:
            deeper = quantize(left, codebooks[-1:], "_left", residual="_next")
            previous, left = left, cut_lineage(deeper.select(F.col("_next").alias("_left"), "_start", "_spare"))
            drop_stored(previous)
    drop_stored(left)
    return codebooks


def _from_rows(left: DataFrame, iterations: int, revive: bool) -> np.ndarray:
    centres = _numbered(left, "_start", None)
    taken = 0
    for _ in range(iterations):
        centres, unused = _moved(left, centres)
        if revive and len(unused):
            fresh = _numbered(left.filter(F.col("_spare") >= taken), "_spare", len(unused))
            centres[unused[: len(fresh)]] = fresh[: len(unused)]
            taken += len(unused)
    return centres


def _numbered(left: DataFrame, number: str, most: int | None) -> np.ndarray:
    """The vectors of numbered rows in their order, the first `most` of them; never more than a codebook has codes."""
    rows = left.filter(F.col(number).isNotNull()).orderBy(number)
    rows = rows if most is None else rows.limit(most)
    return np.array([row["_left"] for row in rows.select("_left", number).collect()])


def _fit_level(left: DataFrame, k: int, iterations: int, seed: int) -> np.ndarray:
    # The block solver fails when equal vectors among the starting rows leave fewer than k centres; the row solver does
    # not, and the missing codes are revived below.
    kmeans = KMeans(k=k, maxIter=iterations, initMode="random", seed=seed, featuresCol="v", solver="row")
    model = kmeans.fit(left.select(array_to_vector("_left").alias("v")))
    centres = np.array(model.clusterCenters())
    coded = quantize(left, [centres], "_left").select(F.get("codes", F.lit(0)).alias("code"))
    used = sorted(row["code"] for row in coded.distinct().collect())
    if len(used) == k:
        return centres
    return _lloyd_step(left, _revived(left, centres[used], k))


def _revived(left: DataFrame, centres: np.ndarray, k: int) -> np.ndarray:
    """Add up to k - len(centres) centres: the distinct points farthest from theirs, ties by hash, so reruns choose the
    same ones. Points that equal a centre are not taken, so no code is added that could never win."""
    far = quantize(left, [centres], "_left").select(
        "_left", F.round(F.get("sq_error", F.lit(0)), 9).alias("_far"), F.xxhash64("_left").alias("_hash")
    ).filter("_far > 0")
    # Copies of a point collapse map-side, as a hash and a distance.
    chosen = far.groupBy("_hash").agg(F.max("_far").alias("_max")).orderBy(F.desc("_max"), "_hash").limit(k - len(centres))
    points = far.join(F.broadcast(chosen), "_hash").groupBy("_hash").agg(F.max("_left").alias("_left")).collect()
    return np.vstack([centres, *[np.array([row["_left"]]) for row in sorted(points, key=lambda row: row["_hash"])]])


def _lloyd_step(left: DataFrame, centres: np.ndarray) -> np.ndarray:
    return _moved(left, centres)[0]


def _moved(left: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each centre moved to the mean of its rows, and the codes without rows, whose centres stay. At most k means reach the
    driver."""
    coded = quantize(left, [centres], "_left").select(
        F.get("codes", F.lit(0)).alias("code"), array_to_vector("_left").alias("v")
    )
    moved, used = centres.copy(), np.zeros(len(centres), bool)
    for row in coded.groupBy("code").agg(Summarizer.mean(F.col("v")).alias("mean")).collect():
        moved[row["code"]], used[row["code"]] = row["mean"].toArray(), True
    return moved, np.flatnonzero(~used)


def reconstruction_error(coded: DataFrame, dim: int) -> DataFrame:
    """Mean squared error per dimension after each level."""
    per_level = coded.select(F.posexplode("sq_error").alias("level", "sq"))
    return per_level.groupBy("level").agg((F.avg("sq") / F.lit(dim)).alias("mse"))
