"""Whitening of embeddings by the principal components of their covariance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import cut

#: Entries count in 64ths, from a million up.
SCALE, SHIFT = 64, 1_000_000
#: Eigenvalues below this share of the largest are rounding, not variance.
LEAST_SHARE = 1e-11
#: Sums and products below this fit 64 bits.
FITS = 1 << 62


def whole_entries(vector: Column) -> Column:
    """Each entry c, as double, as floor(SCALE * c) + SHIFT; null where the vector or an entry is null or not finite."""
    one = lambda c: F.greatest(F.lit(-FITS // 2), F.least(F.lit(FITS // 2), F.floor(c.cast("double") * SCALE))) + SHIFT
    usable = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(F.coalesce(usable, F.lit(False)), F.transform(vector, one))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: in 64 bits where they hold it, else in Python's whole numbers."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if most * n < FITS and max(map(abs, sums), default=0) < FITS:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def squared(d: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    most = max(map(abs, (int(d.max(initial=0)), int(d.min(initial=0)))))
    if d.dtype != object and most * most * max(1, d.shape[1]) < FITS:
        return (d * d).sum(axis=1).tolist()
    return [sum(v * v for v in row) for row in d.astype(object).tolist()]


def centred(n: int, sums: list[int]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                d = deviations(np.stack(f["x"].to_numpy()), n, sums)
                yield pd.DataFrame({"c": list(d.astype(np.float64) / n)})

    return each


def whitener(n: int, sums: list[int], weights: Broadcast) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Each row with the exact squared deviation and its projections; weights has a component over the root of its eigenvalue in each column."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                d = deviations(np.stack(f["x"].to_numpy()), n, sums)
                exact = [Decimal(v) if abs(v) < 10**38 else None for v in squared(d)]
                yield f.drop(columns="x").assign(deviation=exact, whitened=list(d.astype(np.float64) / n @ weights.value))

    return each


def gramian(rows: DataFrame, column: str, n: int, dims: int) -> np.ndarray:
    """The sum over all rows of the column's outer products, by MLlib."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors, n, dims).computeGramianMatrix().toArray()


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, the largest entry of each above 0; at most `most`, and none of rounding only."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = int(np.count_nonzero(values > max(values[0], 0.0) * LEAST_SHARE)) if len(values) else 0
    values, vectors = values[: min(real, most)], vectors[:, : min(real, most)]
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))] if len(values) else values
    return values, vectors * np.where(largest < 0, -1.0, 1.0)


def whiten(vectors: DataFrame, most: int = 16, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each usable row of vectors: key, n, deviation, whitened and explained (arrays by component) and identity_error.

    Entries c become whole numbers x = floor(64 c) + 1000000. The n different x-vectors, once each,
    are fitted: their sums S are exact, so n x - S is, and over n it is the centred row, rounded once.
    MLlib's RowMatrix adds the outer products of these rows up; over n that is the covariance V, whose
    eigenvectors are found locally (dims x dims numbers, whatever the rows) and broadcast. deviation is
    the exact sum of squares of n x - S (null beyond 38 digits), whitened the centred row on each of
    at most `most` components over the root of its eigenvalue, explained that eigenvalue's share of V's
    trace, identity_error the largest entry of the covariance of the fitted rows' whitened ones less
    the identity. A component's sign makes its largest entry positive.

    Rows whose vector or an entry of it is null, NaN or infinite are left out; of vectors of several
    lengths the shorter count as ending in zeros. Components whose eigenvalue is rounding (under
    1e-11 of the largest) are left out: with equal vectors only, one vector, or none, all arrays are
    empty and identity_error is 0. Components of equal eigenvalues are any basis of theirs. Entries beyond
    2**61 / 64 count as that. Rows that repeat get rows that repeat; other columns are ignored.
    """
    rows = vectors.select(F.col(key).alias("_id"), whole_entries(F.col(vector)).alias("x")).where("x is not null")
    dims = rows.agg(F.max(F.size("x"))).first()[0] or 0
    rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(dims) - F.size("x"))))
    fitted = cut(rows.select("x").distinct())
    n = fitted.count()
    by_place = fitted.select(F.posexplode("x").alias("p", "v")).groupBy("p").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"))
    sums = [int(r["s"]) for r in by_place.orderBy("p").collect()]  # one row a dimension

    values, basis, trace, error = np.zeros(0), np.zeros((dims, 0)), 1.0, 0.0
    if n and dims:
        covariance = gramian(fitted.mapInPandas(centred(n, sums), "c array<double>"), "c", n, dims) / n
        values, basis = components(covariance, most)
        trace = float(np.trace(covariance))
    weights = vectors.sparkSession.sparkContext.broadcast(basis / np.sqrt(values))
    found = whitener(n, sums, weights)
    if len(values):
        white = cut(fitted.mapInPandas(found, "deviation decimal(38,0), whitened array<double>").select("whitened"))
        means = [r["m"] for r in white.select(F.posexplode("whitened").alias("p", "w")).groupBy("p").agg(F.avg("w").alias("m")).orderBy("p").collect()]
        level = white.select(F.zip_with("whitened", F.array(*map(F.lit, means)), lambda w, m: w - m).alias("c"))
        error = float(np.abs(gramian(level, "c", n, len(values)) / n - np.eye(len(values))).max())
    kind = vectors.select(F.col(key).alias("_id")).schema["_id"].dataType.simpleString()
    out = rows.mapInPandas(found, f"_id {kind}, deviation decimal(38,0), whitened array<double>")
    share = F.array(*[F.lit(float(v / trace)) for v in values]).cast("array<double>")
    return out.select(F.col("_id").alias(key), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
