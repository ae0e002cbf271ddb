"""Whitening of embeddings by a covariance taken in two passes.

An entry c becomes x = floor(1024 c) + 100000. The first pass sums x by dimension in integers, as upper and lower halves,
so sums are exact whatever the tasks. The second sums outer products of centred vectors with one matrix product for each
portion of rows; treeAggregate merges the tasks' matrices. LAPACK's symmetric eigensolver runs once on the driver over
a matrix of dimensions by dimensions, and the projection (dimensions by COMPONENTS) is broadcast: neither grows with rows. A third pass
measures the covariance of what was whitened.

Left out are rows whose vector is null or has a null or non-finite entry, an entry beyond LARGEST (its x would be no
64-bit number), or another length than most vectors have (ties: the longer); empty vectors have no component. Components whose eigenvalue is at
most FLAT of the largest are noise of rounding and left out; where all rows are alike there is none, and no row is returned. A
deviation beyond 64 bits is null. Repeated rows and repeated or null ids count as often as they come; an empty table
gives an empty table; columns other than vec_id and embedding are left behind.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
LARGEST, FLAT = 2.0**50, 1e-11
#: Rows of one matrix product.
PORTION = 4096
HALF = 1 << 32
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (array of double) of rows whose vector is whole and finite."""
    v = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.where(F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST)))


def integers(batch: pa.RecordBatch, dimensions: int):
    """Portions of a batch: ids, and x as a matrix of 64-bit integers."""
    v = batch.column("v")
    flat = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    for i in range(0, len(flat), PORTION):
        yield batch.column("vec_id")[i : i + PORTION], np.floor(flat[i : i + PORTION] * SCALE).astype(np.int64) + SHIFT


def exact_sums(rows: DataFrame, dimensions: int) -> tuple[int, list[int]]:
    """Number of rows and the sum of each dimension, as exact integers."""

    @lean
    def run(batches):
        n, upper, lower = 0, np.zeros(dimensions, np.int64), np.zeros(dimensions, np.int64)
        for b in batches:
            for _, x in integers(b, dimensions):
                n += len(x)
                upper += (x >> 32).sum(0)
                lower += (x & (HALF - 1)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimensions + 1)), pa.array(np.append(upper, 0)), pa.array(np.append(lower, n))], ["d", "upper", "lower"])

    total = rows.mapInArrow(run, "d long, upper long, lower long").groupBy("d").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("upper", "lower")])
    got = {r["d"]: int(r["upper"]) * HALF + int(r["lower"]) for r in total.collect()}
    return got.get(dimensions, 0), [got.get(d, 0) for d in range(dimensions)]


class Centre:
    """Takes exact means off integer vectors: the whole part in integers, the rest (below one) as a double."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([(s % n) / n for s in sums])

    def off(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None beyond 64 bits."""
        if ((np.abs(self.off(x)) * self.n) ** 2).sum(1).max(initial=0) < 2.0**62:
            y = self.n * (x - self.whole) - np.array([s % self.n for s in self.sums], np.int64)
            return (y * y).sum(1).tolist()
        left = [s % self.n for s in self.sums]
        whole = [sum((self.n * a - b) ** 2 for a, b in zip(row, left)) for row in (x - self.whole).tolist()]
        return [d if d < 1 << 63 else None for d in whole]


def products(rows: DataFrame, dimensions: int, centred, width: int) -> np.ndarray:
    """The sum of outer products of what centred() makes of each portion (width columns), merged as a tree."""

    @lean
    def run(batches):
        total = np.zeros((width, width))
        for b in batches:
            for _, x in integers(b, dimensions):
                y = centred(x)
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["blob"])

    parts = rows.mapInArrow(run, "blob binary").rdd
    return parts.treeAggregate(np.zeros((width, width)), lambda total, r: total + np.frombuffer(r["blob"]).reshape(width, width), np.add)


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every usable row and component."""
    spark = embeddings.sparkSession
    rows = usable(embeddings)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dimensions = sizes["d"] if sizes else 0
    if not dimensions:
        return spark.createDataFrame([], SCHEMA)
    rows = rows.where(F.size("v") == dimensions)
    centre = Centre(*exact_sums(rows, dimensions))
    n = centre.n
    covariance = products(rows, dimensions, centre.off, dimensions) / n
    value, vector = np.linalg.eigh(covariance)
    order = np.argsort(-value, kind="stable")[:components]
    order = order[value[order] > FLAT * value[-1]]
    if not len(order) or value[-1] <= 0:
        return spark.createDataFrame([], SCHEMA)
    k, explained = len(order), value[order] / np.trace(covariance)
    shared = spark.sparkContext.broadcast((centre, vector[:, order] / np.sqrt(value[order])))

    def projected(x: np.ndarray) -> np.ndarray:
        c, p = shared.value
        return c.off(x) @ p

    measured = products(rows, dimensions, lambda x: np.hstack([projected(x), np.ones((len(x), 1))]), k + 1) / n
    mean = measured[k, :k]
    error = float(np.abs(measured[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())

    @lean
    def out(batches):
        for b in batches:
            for ids, x in integers(b, dimensions):
                m = len(x)
                at = pa.array(np.repeat(np.arange(m), k))
                deviation = pa.array(shared.value[0].deviation(x), pa.int64())
                columns = [ids.take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), deviation.take(at), pa.array(projected(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    return rows.mapInArrow(out, SCHEMA)
