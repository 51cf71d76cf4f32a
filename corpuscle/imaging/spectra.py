"""Fourier analysis of image series: power spectra, differential dynamic microscopy, displacements."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.dynamics import lag_pairs
from ..sources.images import as_array


def hamming(shape) -> np.ndarray:
    window = np.ones(shape)
    for axis, n in enumerate(shape):
        window = window * np.hamming(n).reshape([-1 if a == axis else 1 for a in range(len(shape))])
    return window


def radial_mean(power: np.ndarray) -> pd.DataFrame:
    """Mean of a spectrum over rings of one wave number each, below the Nyquist frequency."""
    longest = max(power.shape)
    k = np.sqrt(sum((np.fft.fftfreq(n) * longest).reshape([-1 if a == axis else 1 for a in range(power.ndim)]) ** 2
                    for axis, n in enumerate(power.shape)))
    ring, nbins = np.floor(k + 1e-9).astype(int).ravel(), longest // 2
    ok = ring < nbins
    n_k = np.bincount(ring[ok], minlength=nbins)
    total = np.bincount(ring[ok], power.ravel()[ok], minlength=nbins)
    return pd.DataFrame({"q_bin": np.arange(nbins, dtype="int32"), "n_k": n_k, "power": total / np.maximum(n_k, 1)})


def image_spectrum(images: DataFrame, keys: Sequence[str] = ("frame",), window: bool = True) -> DataFrame:
    """Radial mean of the power of every image: keys, q_bin, n_k, power."""
    keys = list(keys)
    schema = T.StructType([images.schema[k] for k in keys]).add("q_bin", T.IntegerType()).add("n_k", T.LongType()).add("power", T.DoubleType())

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                image = as_array(row.shape, row.data).astype(float)
                out = radial_mean(np.abs(np.fft.fftn(image * (hamming(image.shape) if window else 1))) ** 2)
                for i, k in enumerate(keys):
                    out.insert(i, k, getattr(row, k))
                yield out
    return images.select(*keys, "shape", "data").mapInPandas(run, schema)


def image_pairs(images: DataFrame, lags: Sequence[int], group: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """Pairs of images ``lag`` frames apart: group, frame, lag, shape0, data0, data1.

    ``most`` takes evenly spaced starts, about that many per lag (it is the averaging number of the method).
    """
    base = images.withColumn("_g", F.lit(0))
    pairs = lag_pairs(base, lags, ["shape", "data"], keys=[*group, "_g"])
    if most:
        span = images.groupBy(*group).agg((F.max("frame") - F.min("frame") + 1).alias("_n"), F.min("frame").alias("_f0")).withColumn("_g", F.lit(0))
        step = F.greatest(F.floor((F.col("_n") - F.col("lag")) / most), F.lit(1))
        pairs = pairs.join(span, [*group, "_g"]).where((F.col("frame") - F.col("_f0")) % step == 0)
    return pairs.select(*group, "frame", "lag", "shape0", "data0", "data1")


def ddm(images: DataFrame, lags: Sequence[int], *, group: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """Mean radial spectrum of image differences: group, lag, q_bin, n, power."""
    group = list(group)
    pairs = image_pairs(images, lags, group, most)
    schema = T.StructType([images.schema[k] for k in group]).add("lag", T.IntegerType()).add("q_bin", T.IntegerType()).add("power", T.DoubleType())

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                a, b = as_array(row.shape0, row.data0).astype(float), as_array(row.shape0, row.data1)
                out = radial_mean(np.abs(np.fft.fftn(b - a)) ** 2)
                yield out.assign(lag=row.lag, **{k: getattr(row, k) for k in group})[[*group, "lag", "q_bin", "power"]]
    rows = pairs.mapInPandas(run, schema)
    return rows.groupBy(*group, "lag", "q_bin").agg(F.count("*").alias("n"), F.avg("power").alias("power"))


def phase_correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlation of two arrays from the phases of their spectra only."""
    cross = np.fft.fftn(a) * np.conj(np.fft.fftn(b))
    size = np.abs(cross)
    return np.fft.ifftn(np.divide(cross, size, out=np.zeros_like(cross), where=size > 0)).real


def peak_shift(correlation: np.ndarray) -> tuple[np.ndarray, float]:
    """Periodic position of the highest point, and its ratio to the highest one outside the 5-wide box around it."""
    shape = np.array(correlation.shape)
    at = np.array(np.unravel_index(np.argmax(correlation), correlation.shape))
    rest = np.roll(correlation, tuple(shape // 2 - at), axis=tuple(range(correlation.ndim)))
    peak = rest[tuple(shape // 2)]
    rest[tuple(slice(max(c - 2, 0), c + 3) for c in shape // 2)] = -np.inf
    other = rest.max()
    return np.where(at > shape / 2, at - shape, at), float(peak / other) if np.isfinite(other) and other > 0 else float("inf")


def displacements(images: DataFrame, *, group: Sequence[str] = (), window: bool = True, tile: int | None = None,
                  overlap: int = 0) -> DataFrame:
    """Shift from every image to the next: group, frame, row, col (centre of the tile), dy, dx, confidence.

    Without ``tile`` the whole plane is one tile; otherwise square tiles that overlap give a velocity field.
    """
    group = list(group)
    pairs = image_pairs(images, [1], group)
    schema = T.StructType([images.schema[k] for k in group] + [images.schema["frame"]]
                          + [T.StructField(c, T.DoubleType()) for c in ("row", "col", "dy", "dx", "confidence")])

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                a, b = as_array(r.shape0, r.data0).astype(float), as_array(r.shape0, r.data1).astype(float)
                if a.ndim == 3:
                    a, b = a[len(a) // 2], b[len(b) // 2]
                h, w = (tile, tile) if tile else a.shape
                weight = hamming((h, w)) if window else 1.0
                rows = []
                for y in range(0, a.shape[0] - h + 1, h - overlap):
                    for x in range(0, a.shape[1] - w + 1, w - overlap):
                        cut = (slice(y, y + h), slice(x, x + w))
                        shift, trust = peak_shift(phase_correlation(b[cut] * weight, a[cut] * weight))
                        rows.append((*[getattr(r, k) for k in group], r.frame, y + (h - 1) / 2, x + (w - 1) / 2, float(shift[0]), float(shift[1]), trust))
                yield pd.DataFrame(rows, columns=[f.name for f in schema.fields])
    return pairs.mapInPandas(run, schema)


def cumulative_displacement(shifts: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Position of the sample over time from the shifts between frames: group, frame, dx, dy."""
    from ..operators.dynamics import running_total
    moved = shifts.select(*group, (F.col("frame") + 1).alias("frame"), "dx", "dy")
    return running_total(moved, "frame", ["dx", "dy"], group)
