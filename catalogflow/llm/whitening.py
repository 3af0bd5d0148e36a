"""Embedding whitening (operator 12): Spark MLlib's computeSVD on centred distributed rows.

1. Entries become integers x = floor(256 * c). The fit list holds each distinct integer vector once.
2. Sums by dimension are exact: tasks add the two halves of 64 bits apart, Spark adds the halves.
3. The centred rows x - S / n are a RowMatrix; its singular values s, rescaled by the divisor n, give the
   eigenvalues s * s / n of the covariance, its right vectors the components. All of them are asked for:
   then MLlib decomposes the matrix of products, d by d, by LAPACK to double precision, where for a few it
   would iterate to a tolerance.
4. The total variance does not come from the singular values, but from the exact deviations:
   trace(V) = sum over the fit list of sum((n * x - S)**2), divided by n**3. It is added up as integers.
5. Every row is projected on the components; the same pass over the fit list gives the covariance of what
   comes out.

The driver holds d sums and a matrix of d by d; vectors stay on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release

SCALE, COMPONENTS = 256, 4
#: Singular values below this share of the largest one are noise of the products: a variance below 1e-12 of the largest.
LEAST_SINGULAR = 1e-6
#: Numbers that a task works on at once.
AT_ONCE = 1 << 20
_HALF, _MASK = 32, (1 << 32) - 1


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and code, floor(scale * c) of each entry c as a double, without vectors that are null or
    hold a null, a NaN or an infinity (or an entry whose code 64 bits do not hold)."""
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * scale) < float(1 << 63)))
    code = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return vectors.filter(F.col("embedding").isNotNull() & sound).select(F.col("vec_id").cast("long").alias("vec_id"), code.alias("code"))


def _slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with the matrix of their last column."""
    rows = max(1, AT_ONCE // max(1, width))
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            batch = whole.slice(at, rows)
            flat = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False)
            yield batch, flat.reshape(batch.num_rows, width)


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """An integer of any size as (place, number below 2**62, the last one signed)."""
    place = 0
    while not -(1 << 62) <= value < 1 << 62:
        yield place, value & ((1 << 62) - 1)
        value >>= 62
        place += 1
    yield place, value


def _exact(rows: DataFrame) -> dict[int, int]:
    """Sums of (slot, place, value) by slot, in Python's integers: a few numbers a slot reach the driver."""
    found: dict[int, int] = {}
    for r in rows.groupBy("slot", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        found[r.slot] = found.get(r.slot, 0) + (int(r.value) << (62 * r.place))
    return found


def _told(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64()))], ["slot", "place", "value"])


def column_sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """The number of rows of ``fit`` (code) and the exact sums of their entries by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _slices(batches, width):
            low, high = (x & _MASK).sum(axis=0), (x >> _HALF).sum(axis=0)
            sums = [(int(h) << _HALF) + int(lo) for h, lo in zip(high.tolist(), low.tolist(), strict=True)]
            yield _told([(0, 0, batch.num_rows)] + [(j + 1, place, v) for j, s in enumerate(sums) for place, v in _limbs(s)])

    found = _exact(fit.select("code").mapInArrow(run, "slot int, place int, value long"))
    return found.get(0, 0), [found.get(j + 1, 0) for j in range(width)]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """sum((n * x - S)**2) of each row, exact."""
    most = n * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) + max(map(abs, sums), default=0)
    if most * most * x.shape[1] < 1 << 62:
        away = n * x - np.array(sums, np.int64)
        return (away * away).sum(axis=1).tolist()
    away = x.astype(object) * n - np.array(sums, object)
    return (away * away).sum(axis=1).tolist()


def whiten(vectors: DataFrame, *, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of each row of
    ``vectors`` (vec_id, embedding; others are ignored) and each of the first ``components`` components.

    Vectors that are null or hold a null, a NaN or an infinity give no rows, nor do those with an entry
    whose integer leaves 64 bits. Shorter vectors count as ending in zeros; an empty one is all zeros.
    Repeated rows give repeated rows, and count once in the fit; a null vec_id is returned as it is.
    Components of no variance (below 1e-12 of the largest) do not exist, so an empty table, a single
    distinct vector and vectors without entries give no rows. A deviation beyond 64 bits is null.
    """
    spark = vectors.sparkSession
    codes = integer_vectors(vectors, scale)
    width = codes.agg(F.max(F.size("code")).alias("w")).first().w or 0
    codes = codes.select("vec_id", F.concat("code", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("code"))).alias("code"))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    none = spark.createDataFrame([], schema)
    if not width:
        return none
    fit = cut(codes.select("code").distinct(), "fit")
    n, sums = column_sums(fit, width)
    mean = np.array([s / n for s in sums])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _slices(batches, width):
            yield _told([(0, place, v) for place, v in _limbs(sum(deviations(x, n, sums)))])

    total = _exact(fit.mapInArrow(spread, "slot int, place int, value long"))[0]
    if not total:
        release(fit)
        return none
    trace = total / n**3
    centred = fit.select(array_to_vector(F.zip_with("code", F.lit(mean), lambda x, m: x.cast("double") - m)).alias("row"))
    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "row"), n, width).computeSVD(width, False, LEAST_SINGULAR)
    singular = svd.s.toArray()[:components]
    kept = len(singular)
    values = singular * singular / n
    onto = svd.V.toArray()[:, :kept] / np.sqrt(values)
    upper = [(i, j) for i in range(kept) for j in range(i, kept)]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _slices(batches, width):
            w = (x - mean) @ onto
            both = np.concatenate([w.sum(axis=0), [w[:, i] @ w[:, j] for i, j in upper]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both), dtype=np.int32)), pa.array(both)], ["slot", "value"])

    # what comes out has a mean of 0 up to rounding, so its products are centred ones
    found = {r.slot: r.value / n for r in fit.mapInArrow(products, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).collect()}
    error = max(abs(found[kept + k] - found[i] * found[j] - (i == j)) for k, (i, j) in enumerate(upper))
    release(fit)
    explained = (values / trace).tolist()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _slices(batches, width):
            m = len(x)
            w = (x - mean) @ onto
            away = [d if d < 1 << 63 else None for d in deviations(x, n, sums)]
            each = lambda column: column.take(pa.array(np.repeat(np.arange(m), kept)))
            columns = [each(batch.column(0)), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)), pa.array(np.full(m * kept, n, np.int64)), each(pa.array(away, pa.int64())), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * kept, error))]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return codes.mapInArrow(project, schema)
