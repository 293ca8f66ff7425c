"""Whitening of embeddings: whole-number features, centred exactly, decomposed by MLlib's computeSVD over distributed rows."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, MOST = 1024, 100_000, 8
#: Rows of a batch that are projected at a time.
ROWS = 2000


def finite(v: Column) -> Column:
    """Not null, not empty, and without null, NaN or infinite entries."""
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & good, F.lit(False))


def features(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, x: floor(1024 c) + 100000 of every entry c of the usable vectors."""
    c = F.transform(F.col(vector), lambda c: (F.floor(c.cast("double") * SCALE) + SHIFT).cast("long"))
    return vectors.where(finite(F.col(vector))).select(F.col(key).alias("vec_id"), c.alias("x"))


def sums(x: DataFrame) -> tuple[int, list[int]]:
    """n and the sum of each dimension, exact: tasks send one row a dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, {}
        for b in batches:
            for size in set(pc.list_value_length(b.column(0)).to_pylist()):
                of = b.column(0).filter(pc.equal(pc.list_value_length(b.column(0)), size))
                n += len(of)
                rows = of.flatten().to_numpy().reshape(-1, size)
                total[size] = total.get(size, 0) + np.array([sum(map(int, c)) for c in rows.T], object) if np.abs(rows).max(initial=0) > 2**40 else total.get(size, 0) + rows.sum(axis=0).astype(object)
        for size, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([str(v) for v in t])], ["size", "pos", "total"])

    got = x.select("x").mapInArrow(run, "size int, pos int, total string").groupBy("size", "pos").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    if len({r["size"] for r in got}) > 1:
        raise ValueError(f"vectors of several lengths: {sorted({r['size'] for r in got})}")
    return x.count() if got else 0, [int(r.total) for r in sorted(got, key=lambda r: r.pos)]


def deviations(x: DataFrame, n: int, total: list[int]) -> Column:
    """The sum over dimensions of (n x - S)^2, as decimal(38,0): exact."""
    d = F.zip_with("x", _longs(total), lambda a, s: (a * F.lit(n) - s).cast("decimal(19,0)"))
    return F.aggregate(d, F.lit(0).cast("decimal(38,0)"), lambda a, v: (a + v * v).cast("decimal(38,0)"))


def _longs(values: list[int]) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values))


def centred(n: int, total: list[int]) -> Column:
    """x - S / n, divided only after the exact difference of whole numbers."""
    return F.zip_with("x", _longs(total), lambda a, s: (a * F.lit(n) - s).cast("double") / F.lit(float(n)))


def decomposed(x: DataFrame, n: int, total: list[int], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the covariance (divisor n), falling, and their unit vectors as columns; only those that are not zero.

    computeSVD sees the centred rows A, distributed; A = U s V', so the covariance A'A / n has the values s^2 / n and the
    vectors V. It is asked for all dimensions, for which it decomposes A'A in full and not by iteration; so the driver
    holds a square of the dimensions, whatever the number of rows.
    """
    rows = x.select(array_to_vector(centred(n, total)).alias("features"))
    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "features"), n, len(total)).computeSVD(len(total), computeU=False)
    s, v = np.array(svd.s.toArray()), np.array(svd.V.toArray())
    return (s * s / n)[:most], v[:, :most]


def projected(x: DataFrame, n: int, total: list[int], value: np.ndarray, v: np.ndarray) -> DataFrame:
    """vec_id, w: the centred features on each component, divided by its standard deviation."""
    sent = x.sparkSession.sparkContext.broadcast((np.array(total, np.int64), v / np.sqrt(value)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, to = sent.value
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                rows = part.column(1).flatten().to_numpy().reshape(-1, len(s))
                w = ((rows * n - s) / n) @ to
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * to.shape[1], pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), flat], ["vec_id", "w"])

    kind = x.schema["vec_id"].dataType.simpleString()
    return x.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, w array<double>")


def identity_error(w: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of w (divisor n, centred by its own means first) minus the identity."""
    def summed(of: DataFrame, size: int, fn) -> tuple[int, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, np.zeros(size)
            for b in batches:
                rows = b.column(0).flatten().to_numpy().reshape(-1, k)
                n, total = n + len(rows), total + fn(rows).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array(total)], ["pos", "n", "total"])

        got = of.select("w").mapInArrow(run, "pos int, n long, total double").groupBy("pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("pos").collect()
        return got[0].n, np.array([r.total for r in got])

    n, total = summed(w, k, lambda rows: rows.sum(axis=0))
    mean = total / n
    _, products = summed(w, k * k, lambda rows: (rows - mean).T @ (rows - mean))
    return float(np.abs(products.reshape(k, k) / n - np.eye(k)).max())


def whiten(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", most: int = MOST) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for every usable vector and each of the
    first `most` components.

    Left out: vectors that are null or empty or hold null, NaN or infinite entries. Components without variance do not
    exist, so equal vectors, or a single one, give no rows, as does an empty table. Equal vectors and null or repeated ids
    keep rows of their own. Vectors of several lengths raise an error, and so does a deviation beyond 64 bits. Total
    variance is the sum of the exact deviations, not of the decomposition's values. Other columns are not read.
    """
    spark, x = vectors.sparkSession, features(vectors, key, vector)
    kind = x.schema["vec_id"].dataType.simpleString()
    n, total = sums(x)
    dev = deviations(x, n, total) if n else None
    spread = int(x.agg(F.sum(dev.cast("decimal(38,0)"))).first()[0]) if n else 0
    if not spread:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    value, v = decomposed(x, n, total, most)
    error = identity_error(projected(x, n, total, value, v), len(value))
    trace = Fraction(spread, n**3)
    share = F.array(*(F.lit(float(Fraction(float(e)) / trace)) for e in value))
    rows = projected(x.select(F.struct("vec_id", dev.cast("long").alias("deviation")).alias("vec_id"), "x"), n, total, value, v)
    each = rows.select("vec_id.*", F.posexplode("w").alias("k", "whitened"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))


def op13(spark, sf_dir: str) -> DataFrame:
    """All usable embeddings on their first eight components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
