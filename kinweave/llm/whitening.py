"""Embedding whitening by a tall-skinny QR, without forming a covariance.

Entries become whole numbers (`scale` levels to one), so sums and means are
exact. The fit list holds each distinct vector once. Its rows are centred by
the exact sums, each partition reduces its rows to a triangular factor R, and
the factors are merged as a tree, a few to a task, each round written to the
shared folder. The singular values and right vectors of the last R (dims x
dims, whatever the number of rows) are those of all centred rows: the
components, and what scales them to unit variance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.common import cut, place_of, placed, table

SCALE, COMPONENTS = 256, 4
#: Factors that one task merges, and rows that one QR step takes.
FAN, STEP = 8, 4096
#: Levels beyond this are not told apart by a double.
WIDEST = 1 << 52
FACTOR = "place long, rows int, factor binary"


@dataclass
class Whitening:
    """n fit vectors, their exact sums by dimension, unit directions as columns with their variances, the sum of all variances."""

    n: int
    sums: list[int]
    directions: np.ndarray
    variances: np.ndarray
    trace: float
    scale: int = SCALE
    identity_error: float | None = None

    @property
    def dims(self) -> int:
        return len(self.sums)

    def split_mean(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole parts of the means, and what is left of the sums beyond n times these."""
        whole = [s // self.n for s in self.sums]
        return np.array(whole, np.int64), np.array([s - w * self.n for s, w in zip(self.sums, whole, strict=True)], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole, rest = self.split_mean()
        return (x - whole) - rest / self.n

    def whiten(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            z = self.centred(x) @ self.directions / np.sqrt(self.variances)
        z[:, self.variances <= 0] = np.nan
        return z

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sums over dimensions of (n * x - sum) squared, exact; null beyond 38 digits."""
        whole, rest = self.split_mean()
        far = x - whole
        widest = self.n * (int(np.abs(far).max(initial=0)) + 1)
        if self.dims * widest * widest < 1 << 63:
            off = far * self.n - rest
            return pa.array((off * off).sum(axis=1)).cast(pa.decimal128(38, 0))
        off = far.astype(object) * self.n - rest.astype(object)
        return pa.array([Decimal(v) if v < 10**38 else None for v in (off * off).sum(axis=1).tolist()], pa.decimal128(38, 0))


def _levels(vectors: DataFrame, scale: int) -> DataFrame:
    """(id, x): whole-number vectors of the rows that can be used."""
    own = placed(vectors).select(
        F.col(place_of(vectors, "vec_id")).alias("id"), F.col(place_of(vectors, "embedding")).cast("array<double>").alias("e")
    )
    odd: Column = F.exists("e", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) * scale >= WIDEST))
    fine = own.where(F.col("e").isNotNull() & (F.size("e") > 0) & ~F.coalesce(odd, F.lit(True)))
    return fine.select("id", F.transform("e", lambda c: F.floor(c * scale).cast("long")).alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sums(fit_list: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Rows, and exact sums by dimension: one partial row a dimension and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for batch in batches:
            x = _matrix(batch.column("x"), dims)
            if len(x) * int(np.abs(x).max(initial=0)) >= 1 << 62:
                x = x.astype(object)
            n, total = n + len(x), [a + int(b) for a, b in zip(total, x.sum(axis=0), strict=True)]
        if n:
            columns = [pa.array(range(dims), pa.int32()), pa.array(map(Decimal, total), pa.decimal128(38, 0)), pa.array([n] * dims, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["dim", "total", "n"])

    parts = fit_list.mapInArrow(run, "dim int, total decimal(38,0), n long")
    rows = sorted(parts.groupBy("dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect())  # a row a dimension
    return (rows[0]["n"], [int(r["total"]) for r in rows]) if rows else (0, [])


def triangle(blocks: Iterator[np.ndarray]) -> np.ndarray | None:
    """The R factor of blocks of rows one below another, holding one block and one R at a time."""
    r = None
    for block in blocks:
        for at in range(0, len(block), STEP):
            part = block[at : at + STEP]
            r = np.linalg.qr(part if r is None else np.vstack([r, part]), mode="r")
    return r


def _packed(place: int, r: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([place], pa.int64()), pa.array([len(r)], pa.int32()), pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["place", "rows", "factor"])


def tsqr(fit_list: DataFrame, model: Whitening, fan: int = FAN) -> np.ndarray:
    """The R factor of all centred rows of fit_list (x)."""
    dims = model.dims

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = triangle(model.centred(_matrix(b.column("x"), dims)) for b in batches)
        if r is not None:
            yield _packed(TaskContext.get().partitionId(), r)

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        blocks = (np.frombuffer(f.as_py()).reshape(n, dims) for n, f in zip(t.column("rows").to_pylist(), t.column("factor"), strict=True))
        return pa.Table.from_batches([_packed(key[0].as_py(), triangle(blocks))])

    factors = cut(fit_list.mapInArrow(reduce_rows, FACTOR), "factors")
    places = factors.agg(F.max("place")).first()[0] + 1
    while places > 1:
        group = F.floor(F.col("place") / fan).cast("long").alias("group")
        factors = cut(factors.groupBy(group).applyInArrow(merge, FACTOR), "factors")
        places = -(-places // fan)
    row = factors.first()
    return np.frombuffer(row["factor"]).reshape(row["rows"], dims)


def _identity_error(fit_list: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the covariance of the fit list's whitened rows less the identity."""
    own = np.flatnonzero(model.variances > 0)
    if not len(own):
        return None
    dims, n = model.dims, model.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, cross = np.zeros(len(own)), np.zeros((len(own), len(own)))
        for batch in batches:
            z = model.whiten(_matrix(batch.column("x"), dims))[:, own]
            total, cross = total + z.sum(axis=0), cross + z.T @ z
        i, j = np.indices(cross.shape)
        columns = [pa.array(np.r_[np.full(len(own), -1), i.ravel()]), pa.array(np.r_[np.arange(len(own)), j.ravel()]), pa.array(np.r_[total, cross.ravel()])]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "v"])

    got = fit_list.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    value = {(r["i"], r["j"]): r["v"] / n for r in got}  # components squared rows
    # the rows are centred already; what rounding leaves of their means goes too
    return max(abs(value[i, j] - value[-1, i] * value[-1, j] - (i == j)) for i, j in value if i >= 0)


def fit(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> Whitening:
    """The whitening of vectors (vec_id, embedding), from each distinct vector once.

    Only vectors of the length that most distinct vectors have count (of tied
    lengths the longest). Directions end with the dimensions or `components`; of
    each the entry of largest size is positive. A direction without variance (all
    vectors equal, or in a smaller space) has variance 0 and whitens to null. No
    usable vector: n is 0 and there is no direction.
    """
    return _fitted(_levels(vectors, scale), components, scale)


def _fitted(rows: DataFrame, components: int, scale: int) -> Whitening:
    fit_list = cut(rows.select("x").distinct(), "fit_list")
    by_length = fit_list.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if by_length is None:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, scale)
    dims = by_length["dims"]
    fit_list = fit_list.where(F.size("x") == dims)
    n, sums = _sums(fit_list, dims)
    model = Whitening(n, sums, np.zeros((dims, 0)), np.zeros(0), 0.0, scale)
    r = tsqr(fit_list, model)
    _, spread, right = np.linalg.svd(r)
    spread = np.r_[spread, np.zeros(dims - len(spread))]
    spread[spread <= spread.max(initial=0) * np.finfo(float).eps * max(len(r), dims)] = 0
    k = min(components, dims)
    ways = right[:k].T
    ways = ways * np.sign(ways[np.abs(ways).argmax(axis=0), np.arange(k)])
    model.directions, model.variances, model.trace = ways, spread[:k] ** 2 / n, float((spread**2).sum() / n)
    model.identity_error = _identity_error(fit_list, model)
    return model


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vectors (vec_id, embedding) -> a row for each usable row and component, numbered from 1 by falling variance.

    Columns: vec_id, component, n (fit vectors), deviation decimal(38,0) (sum
    over dimensions of (n * x - sum) squared), whitened, explained (share of all
    variance) and identity_error. Left out are rows whose vector is null, empty,
    holds a null, non-finite or too large entry (over 2^52 levels), or is not of
    the fitted length. Ids may repeat or be null: each row gives its own rows.
    `whitened` is null for components without variance, and `explained` 0 where
    no component has any. Other columns are not read. An empty table gives no rows.
    """
    rows = _levels(vectors, scale)
    model = _fitted(rows, components, scale)
    return apply(rows, model)


def apply(rows: DataFrame, model: Whitening) -> DataFrame:
    """Whitened rows of (id, x) by a fitted model."""
    kind = T.StructType([
        T.StructField("vec_id", rows.schema["id"].dataType),
        *T._parse_datatype_string("component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"),
    ])
    k, dims = len(model.variances), model.dims
    share = model.variances / model.trace if model.trace else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not k:
                continue
            x = _matrix(batch.column("x"), dims)
            z, row = model.whiten(x).ravel(), np.repeat(np.arange(len(x)), k)
            columns = [
                batch.column("id").take(pa.array(row)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(row), model.n)),
                model.deviations(x).take(pa.array(row)),
                pa.array(z, from_pandas=True),
                pa.array(np.tile(share, len(x))),
                pa.array([model.identity_error] * len(row), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=kind.names)

    return rows.where(F.size("x") == dims).mapInArrow(run, kind)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))
