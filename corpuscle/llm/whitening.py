"""Embedding whitening by bit-sliced scatter: exact integer cross-products from AND and popcount.

An entry ``c`` becomes the integer ``x = floor(1024 c) + 100000``.  Inside a task, rows are taken ``ROWS`` at a time; every dimension is shifted by its least value there, the bits of what is
left are cut into planes, and each plane is packed across the rows into 64-bit words.  The cross-product of two dimensions is the sum over pairs of planes of
2**(b+c) times the number of bits set in the AND of both; the shifts are put back as integers.  Tasks hand over whole numbers (decimals of 38 digits), which Spark adds up per pair of
dimensions, so the scatter is exact whatever the order of the sums.  The driver sees one number per pair of dimensions: its size is set by the length of a vector, never by the number of rows.
The covariance is centred as integers, n * sum(xy) - sum(x) * sum(y), before it becomes floating point and goes to ``eigh``.

Edge cases: rows whose vector is null, or holds a null, an infinity or a NaN, are dropped; a vector shorter than the longest counts as having zeros at its end; repeated rows and ids count
as often as they occur; a direction without variance (a single row, equal vectors) has whitened value 0 and explained share 0; entries beyond about 9e12 either way are taken as that bound,
so that x stays a long; without rows the result is empty.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..scratch import materialize
from .frames import col, map_texts, named, row_schema

SCALE, SHIFT = 1024, 100_000
ROWS = 4096
_LARGEST = 2.0 ** 53
_EXACT = T.DecimalType(38, 0)
_DIGITS = Context(prec=60)


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """The vectors of a batch as rows of integers, shorter ones filled with the integer of 0."""
    out = np.full((len(vectors), width), SHIFT, np.int64)
    lengths = np.asarray(vectors.value_lengths(), np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(vectors)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, place] = np.floor(np.clip(flat * SCALE, -_LARGEST, _LARGEST)).astype(np.int64) + SHIFT
    return out


def bit_planes(y: np.ndarray) -> tuple[np.ndarray, int]:
    """Bits of non-negative integers: planes of 64-bit words over the rows, dimension by dimension, lowest bit first; and the number of planes each."""
    bits = max(1, int(y.max()).bit_length()) if y.size else 1
    n, d = y.shape
    planes = np.empty((d, bits, -(-n // 64) * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits(((y >> b) & 1).astype(np.uint8), axis=0)
        planes[:, b, :len(packed)] = packed.T
        planes[:, b, len(packed):] = 0
    return planes.reshape(d * bits, -1).view(np.uint64), bits


def cross_products(y: np.ndarray) -> np.ndarray:
    """Sum over rows of y[d] * y[e] for all pairs d <= e, as Python integers."""
    planes, bits = bit_planes(y)
    d = y.shape[1]
    total = np.zeros((d, d), object)
    for one in range(d):
        for b in range(bits):
            both = np.bitwise_count(planes[one * bits:] & planes[one * bits + b]).sum(axis=1, dtype=np.int64).reshape(d - one, bits)
            for c in range(bits):
                if both[:, c].any():
                    total[one, one:] += both[:, c].astype(object) * (1 << (b + c))
    return total


def _fast_cross_products(y: np.ndarray) -> np.ndarray:
    """The same while all weighted counts fit into 64 bits."""
    planes, bits = bit_planes(y)
    d = y.shape[1]
    weight = 1 << np.arange(bits, dtype=np.int64)
    total = np.zeros((d, d), np.int64)
    for one in range(d):
        for b in range(bits):
            both = np.bitwise_count(planes[one * bits:] & planes[one * bits + b]).sum(axis=1, dtype=np.int64).reshape(d - one, bits)
            total[one, one:] += (both @ weight) << b
    return total


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of x[d] and, for d <= e, of x[d] * x[e] over the rows, as Python integers."""
    least = x.min(axis=0)
    y = x - least
    small = int(y.max()).bit_length() * 2 + len(x).bit_length() < 62
    crossed = (_fast_cross_products(y) if small else cross_products(y)).astype(object)
    sums, least, n = y.sum(axis=0, dtype=object) if not small else y.sum(axis=0).astype(object), least.astype(object), len(x)
    crossed = crossed + np.outer(least, sums) + np.outer(sums, least) + n * np.outer(least, least)
    return sums + n * least, np.triu(crossed)


@dataclass
class Moments:
    """Number of vectors, sums of x, sums of products of x."""
    n: int
    sums: np.ndarray
    products: np.ndarray

    @property
    def centred(self) -> np.ndarray:
        """n**2 times the covariance, as integers."""
        return self.n * self.products - np.outer(self.sums, self.sums)


def usable(embeddings: DataFrame, keep: list[str], vector: str) -> DataFrame:
    """Columns ``keep`` as struct ``row``, and the vector ``v`` in doubles, of the rows whose vector is whole."""
    v = col(vector).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return embeddings.filter(v.isNotNull() & fine).select(named(keep).alias("row"), v.alias("v"))


def gather(vectors: DataFrame, width: int) -> Moments:
    """Moments of all vectors, added up per pair of dimensions by Spark."""
    def run(batches):
        n, sums, products, waiting = 0, np.zeros(width, object), np.zeros((width, width), object), []

        def add(x):
            nonlocal n, sums, products
            s, p = scatter(x)
            n, sums, products = n + len(x), sums + s, products + p

        for batch in batches:
            x = integers(batch.column(0), width)
            waiting.append(x)
            if sum(map(len, waiting)) >= ROWS:
                whole = np.concatenate(waiting)
                while len(whole) >= ROWS:
                    add(whole[:ROWS])
                    whole = whole[ROWS:]
                waiting = [whole]
        if sum(map(len, waiting)):
            add(np.concatenate(waiting))
        if n:
            one, other = np.triu_indices(width)
            values = [n, *sums, *products[one, other]]
            yield pa.RecordBatch.from_arrays([pa.array([-1] + [-1] * width + one.tolist(), pa.int32()), pa.array([-1, *range(width)] + other.tolist(), pa.int32()),
                                              pa.array([_DIGITS.create_decimal(int(v)) for v in values], pa.decimal128(38, 0))], ["d", "e", "total"])

    parts = map_texts(vectors.select("v"), run, T.StructType([T.StructField("d", T.IntegerType()), T.StructField("e", T.IntegerType()), T.StructField("total", _EXACT)]))
    rows = parts.groupBy("d", "e").agg(F.sum("total").alias("total")).collect()
    out = Moments(0, np.zeros(width, object), np.zeros((width, width), object))
    for r in rows:
        value = int(r["total"])
        if r["e"] < 0:
            out.n = value
        elif r["d"] < 0:
            out.sums[r["e"]] = value
        else:
            out.products[r["d"], r["e"]] = out.products[r["e"], r["d"]] = value
    return out


@dataclass
class Transform:
    """Eigenvectors (columns, by falling eigenvalue), eigenvalues and their share of the trace."""
    moments: Moments
    axes: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    @classmethod
    def fit(cls, moments: Moments, components: int | None) -> Transform:
        n, whole = moments.n, moments.centred
        covariance = np.array([[v / (n * n) for v in row] for row in whole], float).reshape(whole.shape)
        values, axes = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:components]
        trace = covariance.trace()
        values = np.where(values[order] > 1e-12 * max(trace, 0.0), values[order], 0.0)
        return cls(moments, axes[:, order], values, values / trace if trace > 0 else np.zeros(len(order)))

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Whitened vectors, and the exact sums of (n * x - sums)**2."""
        n, sums = self.moments.n, self.moments.sums
        reach = max((abs(int(s)) for s in sums), default=0) + n * int(np.abs(x).max(initial=0))
        apart = x * np.int64(n) - sums.astype(np.int64) if reach < 2 ** 62 else x.astype(object) * n - sums
        small = float(np.abs(apart).max(initial=0)) ** 2 * x.shape[1] < 2 ** 62
        squares = (apart * apart if small else apart.astype(object) ** 2).sum(axis=1)
        scale = np.where(self.values > 0, 1 / np.sqrt(np.where(self.values > 0, self.values, 1)), 0.0)
        return (apart / n).astype(float) @ self.axes * scale, [int(s) for s in squares]


def whiten(embeddings: DataFrame, keep: list[str] | None = None, vector: str = "embedding", components: int | None = None) -> tuple[DataFrame, Transform | None]:
    """Columns ``keep`` (all by default) as struct ``row``, ``whitened`` array<double>, ``deviation`` decimal(38,0) = sum over dimensions of (n*x - sums)**2, of every usable row;
    and what was fitted (None without rows).  A deviation of more than 38 digits is null."""
    vectors = usable(embeddings, keep if keep is not None else embeddings.columns, vector)
    width = vectors.agg(F.max(F.size("v"))).first()[0]
    fitted = Transform.fit(gather(vectors, width), components) if width is not None else None

    def run(batches):
        for batch in batches:
            w, squares = fitted(integers(batch.column(1), width))
            offsets = np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]
            exact = pa.array([_DIGITS.create_decimal(s) if s < 10 ** 38 else None for s in squares], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(w.ravel())), exact], ["row", "whitened", "deviation"])

    schema = row_schema(vectors, "whitened array<double>, deviation decimal(38,0)")
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], schema), None
    return map_texts(vectors, run, schema), fitted


def identity_error(whitened: DataFrame, components: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` less the identity, measured on all rows."""
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    w = lambda i: F.col("whitened")[i]
    if not pairs:
        return 0.0
    mean = whitened.agg(*[F.avg(w(i)) for i in range(components)]).first()
    found = whitened.agg(*[F.avg((w(i) - F.lit(mean[i])) * (w(j) - F.lit(mean[j]))) for i, j in pairs]).first()
    return max(abs(value - (i == j)) for value, (i, j) in zip(found, pairs))


def components_of(embeddings: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """One row per vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error.  ``deviation`` is null where it exceeds a long."""
    rows, fitted = whiten(embeddings, [id], vector, components)
    kinds = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    schema = T.StructType([T.StructField(id, embeddings.schema[id].dataType), *T.StructType.fromDDL(kinds).fields])
    if fitted is None or not len(fitted.values):
        return embeddings.sparkSession.createDataFrame([], schema)
    done = materialize(rows, "whitened")
    error = identity_error(done, len(fitted.values))
    share = F.array(*[F.lit(float(e)) for e in fitted.explained])
    return (done.select(F.col("row").getField(id).alias(id), F.expr("try_cast(deviation AS bigint)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
            .select(col(id), (F.col("at") + 1).cast("int").alias("component"), F.lit(fitted.moments.n).cast("long").alias("n"), "deviation", "whitened",
                    F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")))
