"""Whitening of embeddings: singular vectors of the centred rows by MLlib, variances by the number of rows, and what they explain."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, lean, materialise

#: Components that are told, and what makes whole numbers of entries: floor(SCALE * entry) + SHIFT.
COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
#: Entries up to this size have whole numbers that sums of a batch hold exactly.
ENTRY = 2.0**34
#: Singular values under this share of the greatest can't be told from zero, for their squares are held in doubles.
LEAST = 1e-6
#: Up to so many dimensions the driver decomposes the matrix of inner products, which has their square of entries.
AT_HAND = 15_000
LONG = 2**63


def whole(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x): the vectors that aren't null and hold finite entries of up to ENTRY only, in whole numbers."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) <= ENTRY), F.lit(False)))
    x = F.transform(v, lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).alias("vec_id"), x.alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


class Fit:
    """n, sums of each dimension, components (columns, of unit length) and eigenvalues, greatest first."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        #: The mean as a whole part, which is taken off exactly, and the rest.
        self.floor = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([(s % n) / n for s in sums])
        self.axes, self.values = np.zeros((len(sums), 0)), np.zeros(0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.floor) - self.rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sums over dimensions of (n x - S)^2, in whole numbers without a bound."""
        most = max((abs(int(x.min(initial=0))), abs(int(x.max(initial=0))), *map(abs, map(int, self.floor)))) + 1
        if (2 * most * self.n) ** 2 * x.shape[1] < LONG:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        return [sum((self.n * c - s) ** 2 for c, s in zip(row, self.sums)) for row in x.tolist()]


def decompose(fit_list: DataFrame, dim: int) -> Fit:
    """The fit of a written list of vectors (x) of one length: sums are exact, and MLlib decomposes the centred rows.

    Singular values squared over n are the eigenvalues of the covariance with divisor n. Only sums and a matrix of the
    number of dimensions squared reach the driver."""
    n = fit_list.count()
    sums = fit_list.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("s"))
    fit = Fit(n, [int(r["s"]) for r in sums.orderBy("i").collect()])
    listed = lambda values: F.array(*[F.lit(v) for v in values])
    centred = F.zip_with(F.zip_with("x", listed(fit.floor.tolist()), lambda a, b: a - b), listed(fit.rest.tolist()), lambda a, b: a - b)
    rows = MLUtils.convertVectorColumnsFromML(fit_list.select(array_to_vector(centred).alias("v")), "v")
    svd = RowMatrix(rows).computeSVD(dim if dim <= AT_HAND else COMPONENTS, computeU=False, rCond=LEAST)
    values = svd.s.toArray() ** 2 / n
    told = (values > 0) & (values >= LEAST**2 * values[0]) if len(values) else np.zeros(0, bool)
    fit.values, fit.axes = values[told][:COMPONENTS], svd.V.toArray()[:, told][:, :COMPONENTS]
    return fit


def spread(fit_list: DataFrame, fit: Fit) -> tuple[float, float]:
    """(trace of the covariance, greatest entry of the whitened covariance minus the identity), over the fit list.

    The trace is the sum of exact deviations; the covariance of what is whitened is centred anew, before multiplying."""
    dim, k = len(fit.sums), len(fit.values)

    def total(batches):
        size, deviation, mean = 0, 0, np.zeros(k)
        for b in batches:
            x = _matrix(b.column("x"), dim)
            size, deviation, mean = size + len(x), deviation + sum(fit.deviations(x)), mean + fit.whitened(x).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([Decimal(deviation)], pa.decimal128(38, 0)), pa.array([mean.tolist()], pa.list_(pa.float64()))], names=["deviation", "part"])

    def outer(batches):
        held = np.zeros((k, k))
        for b in batches:
            w = fit.whitened(_matrix(b.column("x"), dim)) - mean
            held += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([held.ravel().tolist()], pa.list_(pa.float64()))], names=["part"])

    def summed(parts: DataFrame) -> np.ndarray:
        rows = parts.select(F.posexplode("part").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("c")).orderBy("i").collect()
        return np.array([r["c"] for r in rows])

    first = materialise(fit_list.mapInArrow(lean(total), "deviation decimal(38,0), part array<double>"), "whitening-sums")
    trace = int(first.agg(F.sum("deviation")).first()[0]) / fit.n**3
    mean = summed(first) / fit.n
    forget(first)
    covariance = summed(fit_list.mapInArrow(lean(outer), "part array<double>")).reshape(k, k) / fit.n
    return trace, float(np.abs(covariance - np.eye(k)).max())


RESULT = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each vector and each of up to COMPONENTS
    components, from 1, by falling variance.

    Entries become whole numbers x. The fit list holds each distinct x once, so copies, however many, weigh as one; they
    combine before they are shuffled. MLlib's computeSVD decomposes its centred rows, over all tasks, and every row is
    then projected where it is. A component of less than LEAST squared of the first one's variance can't be told from
    none and is left out, as are all components of vectors that are all equal: these have no rows.
    Vectors that are null, hold null or non-finite entries, or entries beyond ENTRY, take no part, nor do empty ones;
    vectors of each length are whitened among themselves; null ids stay null; repeated rows are kept; a deviation beyond
    a long is null; an empty table gives no rows; other columns are left out."""
    all_x = materialise(whole(vectors, id_col, vec_col), "whole")
    schema = RESULT.format(dict(all_x.dtypes)["vec_id"])
    out = all_x.sparkSession.createDataFrame([], schema)
    for (dim,) in all_x.select(F.size("x")).distinct().orderBy(F.size("x")).collect():
        mine = all_x.where(F.size("x") == dim)
        fit_list = materialise(mine.select("x").distinct(), "fit-list")
        fit = decompose(fit_list, dim) if dim and fit_list.limit(2).count() > 1 else None
        if fit and len(fit.values):
            trace, error = spread(fit_list, fit)
            out = out.unionByName(mine.mapInArrow(lean(_project(fit, trace, error)), schema))
        forget(fit_list)
    return out


def _project(fit: Fit, trace: float, error: float):
    dim, k = len(fit.sums), len(fit.values)

    def run(batches):
        for b in batches:
            x = _matrix(b.column("x"), dim)
            deviation = [d if d < LONG else None for d in fit.deviations(x)]
            each = np.repeat(np.arange(len(x)), k)
            columns = {
                "vec_id": b.column("vec_id").take(pa.array(each)),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                "n": pa.array(np.full(len(each), fit.n, np.int64)),
                "deviation": pa.array(deviation, pa.int64()).take(pa.array(each)),
                "whitened": pa.array(fit.whitened(x).ravel()),
                "explained": pa.array(np.tile(fit.values / trace, len(x))),
                "identity_error": pa.array(np.full(len(each), error)),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def op13_whitening(spark, sf_dir):
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
