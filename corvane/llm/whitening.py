"""Whitening of embeddings: covariance by one aggregation of generated SQL expressions, eigenvectors by LAPACK.

Entries become integers, x = floor(64 c) + 1000000. The fit list holds each distinct vector once. One aggregation
counts it and sums each dimension; a second holds an expression for every pair i <= j of dimensions, the sum of
products of centred columns (64 dimensions: 2,080 sums), so that the covariance is worked out next to the data and the
driver gets one row. Vectors of more dimensions take several such aggregations over the stored fit list, of ``PAIRS``
expressions each. ``numpy.linalg.eigh`` (LAPACK) gives the components on the driver; tasks project the rows.

Rows whose vector is null, empty, or holds null, NaN or infinite entries take no part, nor do those with an entry beyond
2**55, whose x would leave no room in a long. Vectors of different lengths are whitened apart, each length with its own fit list.
Repeated rows and equal vectors count once in the fit and come back each; a null vec_id comes back as null. A component
along which nothing varies (its eigenvalue is under 1e-12 of the trace; all of them for a single vector) has whitened
0.0 and does not count in ``identity_error``, which is 0.0 if no component is left. ``deviation`` is exact, and null
where it is beyond a long. An empty table gives no rows. Further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import Workspace, small_batches, table

#: Expressions of one aggregation.
PAIRS = 2600
COMPONENTS = 16
LARGEST = float(1 << 55)


def integer_vectors(df: DataFrame) -> DataFrame:
    """(vec_id, x): vectors as integers, without those that take no part."""
    usable = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) <= LARGEST))
    x = F.transform("embedding", lambda c: F.floor(F.lit(64.0) * c.cast("double")) + F.lit(1000000).cast("long"))
    return df.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def column_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many vectors, and the exact sum of each dimension."""
    row = fit.selectExpr("count(*)", *(f"sum(cast(x[{i}] AS decimal(19, 0)))" for i in range(d))).first()
    return row[0], [int(s) for s in row[1:]]


def covariance(rows: DataFrame, entries: list[str], means: list[float]) -> np.ndarray:
    """Covariance with divisor n of the expressions ``entries``: the upper triangle is one expression a pair, centred before multiplying."""
    d = len(entries)
    centred = rows.selectExpr(*(f"cast({e} AS double) - ({m!r}D) AS c{i}" for i, (e, m) in enumerate(zip(entries, means))))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    v = np.zeros((d, d))
    for begin in range(0, len(pairs), PAIRS):
        some = pairs[begin : begin + PAIRS]
        *sums, n = centred.selectExpr(*(f"sum(c{i} * c{j})" for i, j in some), "count(*)").first()
        for (i, j), s in zip(some, sums):
            v[i, j] = v[j, i] = (s or 0.0) / max(n, 1)
    return v


@dataclass
class Whitening:
    """What turns a vector of integers into components."""

    n: int
    sums: list[int]
    vectors: np.ndarray  # a column a component
    values: np.ndarray  # eigenvalues, falling
    trace: float

    @property
    def scale(self) -> np.ndarray:
        """1 / sqrt(e); 0 where nothing varies."""
        alive = self.values > 1e-12 * self.trace
        return np.where(alive, 1 / np.sqrt(np.where(alive, self.values, 1.0)), 0.0)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        # x and its mean are whole millions and more: integers are taken off first, so that nothing is rounded away
        whole = [s // self.n for s in self.sums]
        rest = np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole)])
        return ((x - np.array(whole, np.int64)).astype(float) - rest) @ self.vectors * self.scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S)**2."""
        shift = [s // self.n for s in self.sums]
        rest = [s - w * self.n for s, w in zip(self.sums, shift)]
        near = x - np.array(shift, np.int64)  # n x - S = n near - rest
        bound = (float(np.abs(near).max(initial=0)) + 1) * self.n
        if bound * bound * x.shape[1] < 2.0**62:
            return list((((near * self.n) - np.array(rest, np.int64)) ** 2).sum(1).tolist())
        exact = (sum((self.n * int(a) - r) ** 2 for a, r in zip(row, rest)) for row in near.tolist())
        return [v if v < 1 << 63 else None for v in exact]


def fit(rows: DataFrame, d: int) -> Whitening:
    """Components of the distinct vectors ``rows`` (x), all of d entries."""
    n, sums = column_sums(rows, d)
    whole = [s // n for s in sums]
    v = covariance(rows, [f"(x[{i}] - ({w}L))" for i, w in enumerate(whole)], [(s - w * n) / n for s, w in zip(sums, whole)])
    values, vectors = np.linalg.eigh(v)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(d)])
    keep = min(COMPONENTS, d)
    return Whitening(n, sums, (vectors * np.where(signs == 0, 1.0, signs))[:, :keep], values[:keep], float(np.trace(v)))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, d)


def identity_error(rows: DataFrame, model: Whitening, d: int) -> float:
    """How far the covariance of the whitened fit list is from the identity: its largest entry of that difference."""
    alive = np.flatnonzero(model.scale > 0)
    if not len(alive):
        return 0.0

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = model.whitened(_matrix(b, d))[:, alive]
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(w.reshape(-1)), len(alive)).cast(pa.list_(pa.float64()))], ["w"])

    seen = rows.select("x").mapInArrow(project, "w array<double>")
    entries = [f"w[{k}]" for k in range(len(alive))]
    means = list(seen.selectExpr(*(f"avg({e})" for e in entries)).first())
    return float(np.abs(covariance(seen, entries, means) - np.eye(len(alive))).max())


def whiten(df: DataFrame, ws: Workspace) -> DataFrame:
    """A row for each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = df.sparkSession
    small_batches(spark, 4096)
    rows = integer_vectors(df)
    fits = ws.save(rows.select("x").distinct(), "fit")
    found = None
    for (d,) in sorted(fits.select(F.size("x")).distinct().collect()):  # one row a vector length
        own = fits.filter(F.size("x") == d)
        model = fit(own, d)
        part = rows.filter(F.size("x") == d).mapInArrow(_projector(model, identity_error(own, model, d), d), _SCHEMA)
        found = part if found is None else found.unionAll(part)
    return spark.createDataFrame([], _SCHEMA) if found is None else found


_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _projector(model: Whitening, error: float, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        share = model.values / model.trace if model.trace > 0 else np.zeros(k)
        for b in batches:
            x, m = _matrix(b, d), b.num_rows
            at = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                b.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), pa.array(model.deviations(x), pa.int64()).take(at),
                pa.array(model.whitened(x).reshape(-1)), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to sixteen whitened components of every usable vector."""
    return whiten(table(spark, sf_dir, "embeddings"), Workspace(spark, "whitening"))
