"""Embedding whitening: principal components of exactly centred rows, scaled to unit variance.

Entries become whole numbers, ``floor(scale * c)``. The fit list is each distinct
vector once; its number of vectors and its sums are exact whole numbers, so rows are
centred without rounding before they are multiplied. MLlib's ``RowMatrix`` gives the
Gramian matrix of the centred rows, which divided by their number is the covariance;
its eigenvectors are worked out on the driver (a matrix of the vectors' length, which
does not grow with the rows), broadcast, and applied to all rows in ``mapInPandas``.
How far the result is from white is measured on the fit list, by a second Gramian.

Defined results: vectors that are null or hold null or non-finite entries are dropped;
vectors of different lengths are fit lists of their own; an empty vector has no
component, so no row; a component without variance (of one distinct vector all are)
explains 0 and has a null ``whitened``, and is left out of ``identity_error``, which is
null if no component is left; of equal eigenvalues any orthogonal vectors stand for the
components, the same for all rows; entries beyond the range of a long count as its ends;
rows with a null ``vec_id`` and repeated rows are returned like any other; an empty
table gives no rows; other columns, whatever their names, are never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged

ROWS = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whole(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id, x``: vectors of finite entries, as whole numbers."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * scale) + F.lit(0).cast("long")).alias("x"))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exactly: 64-bit integers where they hold it, Python's otherwise."""
    most = max(int(x.max()), -int(x.min()))
    if n * most + max(map(abs, sums)) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squares(d: np.ndarray) -> np.ndarray:
    """The sum of squares of each row, exactly."""
    most = max(int(d.max()), -int(d.min()))
    if d.dtype == object or most * most * d.shape[1] >= 1 << 63:
        d = d.astype(object)
    return (d * d).sum(1)


def matrix(lists: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    return np.asarray(lists.flatten()).reshape(len(lists), -1)


def totals(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By length: how many vectors there are, and the sum of each entry. Every task adds up its own first."""

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            lists = b.column(0)
            sizes = np.diff(np.asarray(lists.offsets))
            for dim in np.unique(sizes).tolist():
                x = matrix(lists.filter(pa.array(sizes == dim)))
                most = max(int(x.max()), -int(x.min()))
                s = x.sum(0).tolist() if most * len(x) < 1 << 63 else x.astype(object).sum(0).tolist()
                at = held.setdefault(dim, [0, [0] * dim])
                at[0] += len(x)
                at[1] = [a + c for a, c in zip(at[1], s)]
        rows = [(dim, k, str(v), n) for dim, (n, s) in held.items() for k, v in enumerate(s)]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["dim", "k", "s", "n"]).astype({"dim": "int32", "k": "int32", "s": "string", "n": "int64"}), preserve_index=False)

    found = fit.select("x").mapInArrow(run, "dim int, k int, s string, n long")
    found = found.groupBy("dim", "k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in found.orderBy("dim", "k").collect():  # as many rows as a vector has entries
        out.setdefault(r["dim"], (r["n"], []))[1].append(int(r["s"]))
    return out


def gramian(rows: DataFrame, n: int, dim: int) -> np.ndarray:
    """``A^T A`` of the rows of one array column."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(rows.columns[0]).alias("v")), "v")
    return RowMatrix(vectors, n, dim).computeGramianMatrix().toArray()


def centred(fit: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """Rows less the mean, rounded once."""

    def run(batches):
        for b in batches:
            d = deviations(matrix(b.column(0)), n, sums)
            flat = pa.array((d / n).astype(np.float64).ravel())
            ends = pa.array(np.arange(len(d) + 1, dtype=np.int32) * len(sums))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, flat)], names=["v"])

    return fit.where(F.size("x") == len(sums)).select("x").mapInArrow(run, "v array<double>")


def principal(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, and their unit eigenvectors as columns; the largest entry of each is positive."""
    e, u = np.linalg.eigh((covariance + covariance.T) / 2)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return e, u * np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])


class Model:
    """What the rows of one length need: bounded by that length."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, k: int):
        self.n, self.sums = n, sums
        e, u = principal(covariance, k)
        trace = float(np.trace(covariance))
        self.varied = e > max(e[0], 0.0) * len(sums) * np.finfo(float).eps
        self.explained = np.where(self.varied, e / trace if trace > 0 else 0.0, 0.0)
        self.weights = np.where(self.varied, u / np.sqrt(np.where(self.varied, e, 1.0)), 0.0)
        self.identity_error: float | None = None

    def whitened(self, d: np.ndarray) -> np.ndarray:
        return (d / self.n).astype(np.float64) @ self.weights

    def measure(self, fit: DataFrame) -> None:
        """The largest entry of the whitened fit list's covariance less the identity."""
        k = int(self.varied.sum())
        if not k:
            return
        weights = self.weights[:, self.varied]

        def run(frames):
            for f in frames:
                yield pd.DataFrame({"v": list(np.stack(f["v"].to_numpy()) @ weights)})

        rows = centred(fit, self.n, self.sums).mapInPandas(run, "v array<double>")
        mean = rows.agg(*[F.avg(F.get("v", F.lit(j))).alias(f"m{j}") for j in range(k)]).first()
        less = F.array(*[F.get("v", F.lit(j)) - F.lit(mean[j]) for j in range(k)])
        self.identity_error = float(np.abs(gramian(rows.select(less.alias("v")), self.n, k) / self.n - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every vector and component.

    ``deviation`` is the sum over entries of ``(n * x - sums)^2``, exactly.
    """
    spark = vectors.sparkSession
    rows = whole(vectors, scale).where(F.size("x") > 0)
    fit = staged(rows.select("x").distinct(), "fit")
    models = {}
    for dim, (n, sums) in totals(fit).items():  # one length, as a rule
        model = Model(n, sums, gramian(centred(fit, n, sums), n, dim) / n, components)
        model.measure(fit)
        models[dim] = model
    held = spark.sparkContext.broadcast(models)

    def run(frames):
        for f in frames:
            size = f["x"].map(len)
            for dim, own in f.groupby(size):
                m = held.value[dim]
                d = deviations(np.stack(own["x"].to_numpy()), m.n, m.sums)
                w = m.whitened(d)
                k = w.shape[1]
                w[:, ~m.varied] = np.nan
                yield pd.DataFrame({
                    "vec_id": own["vec_id"].repeat(k), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(own)), "n": m.n,
                    "deviation": pd.Series([_decimal(v) for v in squares(d)], index=own.index, dtype=object).repeat(k), "whitened": w.ravel(), "explained": np.tile(m.explained, len(own)),
                    "identity_error": np.nan if m.identity_error is None else m.identity_error,
                })

    found = rows.mapInPandas(run, ROWS)
    clean = [F.nanvl(c, F.lit(None)).alias(c) if c in ("whitened", "identity_error") else F.col(c) for c in found.columns]
    return found.select(*clean)


def _decimal(v):
    from decimal import Decimal

    return Decimal(int(v))
