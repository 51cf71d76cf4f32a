"""Structure factors: sums over wave vectors, and Fourier transforms of pixel grids."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.geometry import AXES
from .stats import exact_quantile


ROWS = 1 << 18            # particles whose phases a task sums before it hands the sums on
_SLAB = 1 << 12           # particles whose phases are held at a time


def shell_table(spark: SparkSession, nbins: int, ndim: int = 3) -> DataFrame:
    """Wave vectors of the shells n = 1..nbins-1 as a relation: q_bin, k_id (the integer components as digits to the base ``nbins``).

    Integer vectors with length about n: all but one component on the grid below n, one rounding the length down to the lattice; every
    cyclic order of the components is taken once.
    """
    digit = lambda i: F.floor(F.col("id") / nbins ** i) % nbins
    size = nbins ** ndim
    grid = spark.range(0, size, 1, -(-size // (1 << 20))).select(digit(ndim - 1).alias("n"), *[digit(i).alias(f"g{i}") for i in range(ndim - 1)])
    rest = sum((-F.col(f"g{i}") * F.col(f"g{i}") for i in range(ndim - 1)), F.col("n") * F.col("n"))
    seeds = grid.where((F.greatest(F.lit(-1), *[F.col(f"g{i}") for i in range(ndim - 1)]) < F.col("n")) & (rest > 0)).withColumn("last", F.floor(F.sqrt(rest)))
    parts = [*[F.col(f"g{i}") for i in range(ndim - 1)], F.col("last")]
    code = lambda turn: sum((parts[(i + turn) % ndim] * nbins ** (ndim - 1 - i) for i in range(ndim)), F.lit(0)).cast("long")
    return seeds.select(F.col("n").cast("int").alias("q_bin"), F.explode(F.array(*map(code, range(ndim)))).alias("k_id")).distinct()


def _used(nbins: int, ndim: int) -> np.ndarray:
    """The ``k_id`` of ``shell_table``, each once: vectors whose length is not above that of the last shell and that are a seed of some shell."""
    cube = np.indices((nbins,) * ndim).reshape(ndim, -1)
    squares = (cube * cube).sum(axis=0)
    wanted = np.zeros(cube.shape[1], bool)
    for last in range(ndim):
        grid = np.delete(cube, last, axis=0)
        low = squares                                                  # smallest n * n that gives this last component
        high = squares + 2 * cube[last] + 1
        n = np.ceil(np.sqrt(low)).astype(np.int64)
        n = np.maximum(n, grid.max(axis=0, initial=0) + 1)
        wanted |= (n * n < high) & (n < nbins) & (n * n > (grid * grid).sum(axis=0))
    return np.flatnonzero(wanted)


def amplitude_sums(points: DataFrame, nbins: int, periods: Sequence[float], *, keys: Sequence[str] = ("frame",),
                   coords: Sequence[str] = AXES, field: Column | None = None) -> DataFrame:
    """Density amplitudes: keys, q_bin, k_id, c, s, n (sums of cosines and sines over the particles).

    Phases separate: the powers of exp(2 pi i x / L) along each axis are made by multiplication, and a product over the axes sums all wave vectors of a batch at once.
    A task hands on one row per frame and wave vector of every ``ROWS`` particles; Spark adds these up and joins them with the relation of shells, so neither the plan nor the rows
    per particle grow with the number of bins.
    """
    keys, coords, ndim = list(keys), list(coords), len(coords)
    weight = F.lit(1.0) if field is None else field
    source = points.select(*keys, *[F.col(c).cast("double").alias(f"_k{i}") for i, c in enumerate(coords)], weight.cast("double").alias("_w"))
    schema = source.select(*keys, F.lit(0).cast("long").alias("k_id"), F.lit(0.0).alias("c"), F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n")).schema

    def cube(place: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Sum of w exp(2 pi i k x / L) over the particles for all k below ``nbins`` on every axis."""
        total = np.zeros((nbins,) * ndim, complex)
        for first in range(0, len(w), _SLAB):
            phase = np.empty((ndim, min(_SLAB, len(w) - first), nbins), complex)
            phase[:, :, 0] = 1
            phase[:, :, 1:] = np.exp(2j * np.pi * place[:, first:first + _SLAB] / np.array(periods, float)[:, None])[:, :, None]
            np.multiply.accumulate(phase, axis=2, out=phase)
            lead = phase[0] * w[first:first + _SLAB, None]
            if ndim == 1:
                total += lead.sum(axis=0)
            elif ndim == 2:
                total += lead.T @ phase[1]
            else:
                for k in range(nbins):
                    total[k] += (phase[1] * lead[:, k, None]).T @ phase[2]
        return total

    def run(batches):
        used = _used(nbins, ndim)

        def sums(held: list[pa.RecordBatch]):
            table = pa.Table.from_batches(held)
            values = np.array([table.column(i).to_numpy() for i in range(len(keys), len(keys) + ndim + 1)], float)
            known = ~np.isnan(values).any(axis=0)
            group = table.select(keys).to_pandas().groupby(keys, dropna=False, sort=False).ngroup().to_numpy() if keys else np.zeros(table.num_rows, np.int64)
            order = np.argsort(group, kind="stable")
            edges = np.flatnonzero(np.diff(group[order], prepend=-1))
            for a, b in zip(edges, [*edges[1:], len(order)]):
                rows = order[a:b]
                fine = rows[known[rows]]
                amplitude = cube(values[:ndim, fine], values[ndim, fine]).ravel()[used]
                own = [table.column(k).combine_chunks().take(pa.array(np.full(len(used), rows[0]))) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array(used), pa.array(amplitude.real), pa.array(amplitude.imag), pa.array(np.full(len(used), b - a))], [*keys, "k_id", "c", "s", "n"])

        held, count = [], 0
        for batch in batches:
            held, count = [*held, batch], count + batch.num_rows
            if count >= ROWS:
                yield from sums(held)
                held, count = [], 0
        if count:
            yield from sums(held)

    summed = source.mapInArrow(run, schema).groupBy(*keys, "k_id").agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.sum("n").alias("n"))
    return summed.join(shell_table(points.sparkSession, nbins, ndim), "k_id").select(*keys, "q_bin", "k_id", "c", "s", "n")


def structure_factor(points: DataFrame, nbins: int, periods: Sequence[float], *, keys: Sequence[str] = ("frame",),
                     **options) -> DataFrame:
    """S(q) of every frame: keys, q_bin, n_k, s.  ``periods`` is the box side per axis, ``field`` a weight."""
    sums = amplitude_sums(points, nbins, periods, keys=keys, **options)
    power = F.col("c") * F.col("c") + F.col("s") * F.col("s")
    return sums.groupBy(*keys, "q_bin").agg(F.count("*").alias("n_k"), F.avg(power / F.col("n")).alias("s"))


def windowed_structure_factor(points: DataFrame, nbins: int, periods: Sequence[float], lows: Sequence[float] | None = None, **options) -> DataFrame:
    """The same for a finite sample: Hann window on the particles (box from ``lows``, or 0), divided by its mean square."""
    from .pairs import hann_weight
    keys, coords = options.get("keys", ("frame",)), options.get("coords", AXES)
    w = hann_weight(periods, coords, lows)
    s = structure_factor(points, nbins, periods, field=w, **options)
    norm = points.groupBy(*keys).agg(F.avg(w * w).alias("_w2"))
    return s.join(norm, list(keys)).select(*keys, "q_bin", "n_k", (F.col("s") / F.nullif(F.col("_w2"), F.lit(0.0))).alias("s"))


def radial_transform(rdf: DataFrame, qs: Sequence[float], density: float, width: float, *, by: Sequence[str] = ()) -> DataFrame:
    """S(q) = 1 + 4 pi rho / q * sum over r of r sin(q r) (g - 1) dr, from columns r and g."""
    rows = rdf.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    term = (F.col("g") - 1) * F.col("r") * F.sin(F.col("q") * F.col("r")) * width / F.col("q")
    return rows.groupBy(*by, "q").agg((1 + 4 * math.pi * density * F.sum(term)).alias("s"))


def slice_to_bulk(s2d: DataFrame, width: float, dq: float, by: Sequence[str] = ()) -> DataFrame:
    """Three-dimensional S(q) from that of a slice of finite ``width`` (Totsuji & Totsuji 2012): q, s3.

    The curve has one row per q bin; it is handled as one sorted array.
    """
    curve = s2d.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("q", "s"))).alias("c"))
    curve = curve.withColumn("c", F.expr("""
        transform(c, (e, i) -> named_struct('q', e.q, 's', e.s, 'g',
            CASE WHEN size(c) < 2 THEN 0D
                 WHEN i = 0 THEN c[1].s - c[0].s
                 WHEN i = size(c) - 1 THEN c[i].s - c[i - 1].s
                 ELSE (c[i + 1].s - c[i - 1].s) / 2 END))"""))
    w, step = float(width), float(dq)
    bulk = curve.withColumn("o", F.expr(f"""
        transform(c, (k, i) -> named_struct('q', k.q, 's3', 1D + aggregate(slice(c, i + 2, size(c)), 0D, (t, e) -> t +
            (-2D * e.g / {w}D + {step}D * e.q / 6D * ({w}D - {w ** 3}D * (e.q * e.q - k.q * k.q) / 60D) * (e.s - 1D))
            / sqrt(e.q * e.q - k.q * k.q))))"""))
    return bulk.select(*by, F.explode("o").alias("o")).select(*by, "o.*")


# --- pixel grids -------------------------------------------------------------------------------------

def pixel_counts(points: DataFrame, shape: Sequence[int], lows: Sequence[float], highs: Sequence[float], *,
                 keys: Sequence[str] = ("frame",), coords: Sequence[str] = AXES, weight: Column | None = None) -> DataFrame:
    """Sum of the weights per pixel: keys, pixel (row-major index), v.  Points outside the grid are left out."""
    index, inside = F.lit(0), F.lit(True)
    for c, n, lo, hi in zip(coords, shape, lows, highs):
        i = F.floor((F.col(c) - lo) * (n / (hi - lo)))
        inside = inside & (i >= 0) & (i < n)
        index = index * n + i
    w = F.lit(1.0) if weight is None else weight
    return points.where(inside).groupBy(*keys, index.cast("int").alias("pixel")).agg(F.sum(w).alias("v"))


def _lines(cells: DataFrame, n: int) -> DataFrame:
    """Cells (g, before, after, re, im) gathered to lines along the last axis of ``before``, of ``n`` places: never more than that in one row."""
    line = cells.groupBy("g", F.floor(F.col("before") / n).alias("before"), "after").agg(F.collect_list(F.struct((F.col("before") % n).cast("int").alias("at"), "re", "im")).alias("v"))
    return line.select("g", F.struct("before", "after").alias("line"), "v")


def _along(lines: DataFrame, n: int, kept: np.ndarray, window: np.ndarray) -> DataFrame:
    """Fourier transform of lines (g, line, v: array of (at, re, im)) of ``n`` places: the values ``re``, ``im`` at the wave numbers ``kept``, place by place."""
    schema = T.StructType([lines.schema["g"], lines.schema["line"], *T.StructType.fromDDL("re array<double>, im array<double>").fields])

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                lists = part.column(2)
                flat = lists.flatten()
                row = np.repeat(np.arange(len(part)), np.asarray(lists.value_lengths()))
                full = np.zeros((len(part), n), complex)
                place = flat.field(0).to_numpy()
                full.real[row, place], full.imag[row, place] = flat.field(1).to_numpy(), flat.field(2).to_numpy()
                found = np.fft.fft(full * window, axis=1)[:, kept]
                offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * len(kept))
                re, im = (pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x).ravel())) for x in (found.real, found.imag))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), re, im], ["g", "line", "re", "im"])

    return lines.mapInArrow(run, schema)


def grid_spectrum(pixels: DataFrame, shape: Sequence[int], lengths: Sequence[float], nbins: int, *,
                  keys: Sequence[str] = ("frame",), window: bool = True, subtract_mean: bool = True,
                  flat_last: bool = False) -> DataFrame:
    """Radially binned power spectrum of each frame's grid: keys, q_bin, n_k, power.

    The grid is transformed one axis after the other: a task holds lines of pixels, the values of a line are dealt anew to the lines along the next axis, and no task
    ever holds a frame.  Lines without a lit pixel are never made.  Pixels are real, so half of the wave numbers of the first axis do, and wave numbers beyond the last bin are dropped at
    their own axis.  The mean is taken off by linearity: the transform of the window itself is a product of one-dimensional ones, and its part in a power needs only three sums per bin.
    Wave numbers use the length of each axis; the bin width is 2 pi / the longest one.  ``flat_last`` keeps only the plane k = 0 of the last axis.
    """
    shape, keys, ndim = tuple(shape), list(keys), len(shape)
    width = 2 * math.pi / max(lengths)
    wave = [2 * math.pi * np.fft.fftfreq(n, L / n) for n, L in zip(shape, lengths)]
    hams = [np.hamming(n) if window else np.ones(n) for n in shape]
    flat = [np.fft.fft(h) for h in hams]
    kept = [np.flatnonzero(np.floor(np.abs(q) / width + 1e-9) < nbins) for q in wave]
    half = kept[-1] <= shape[-1] // 2
    kept[-1] = np.array([0]) if flat_last else kept[-1][half]
    times = np.where((kept[-1] > 0) & (2 * kept[-1] != shape[-1]), 2, 1) if not flat_last else np.array([1])

    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))
    cells = pixels.select(group.alias("g"), F.col("pixel").cast("long").alias("before"), F.lit(0).cast("long").alias("after"), F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im"))
    for axis in range(ndim - 1, -1, -1):
        done = _along(_lines(cells, shape[axis]), shape[axis], kept[axis], hams[axis])
        if axis:
            inner = math.prod(len(k) for k in kept[axis + 1:])
            cells = (done.select("g", "line", F.posexplode(F.arrays_zip("re", "im")).alias("k", "z"))
                     .select("g", F.col("line.before").alias("before"), (F.col("k") * inner + F.col("line.after")).alias("after"), "z.re", "z.im"))
    schema = T.StructType([done.schema["g"], *T.StructType.fromDDL("q_bin int, n_k long, own double, cross double, flat double").fields])
    inner_shape = tuple(len(k) for k in kept[1:])

    def powers(batches):
        """Sums per bin of |F|^2, Re(F W*) and |W|^2 of every line along the first axis, W the transform of the window."""
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                z = (part.column(2).flatten().to_numpy() + 1j * part.column(3).flatten().to_numpy()).reshape(len(part), -1)
                after = part.column(1).field(1).to_numpy()
                others = np.unravel_index(after, inner_shape) if ndim > 1 else ()
                w = np.broadcast_to(flat[0][kept[0]][None, :], z.shape).copy()
                q2 = np.broadcast_to((wave[0][kept[0]] ** 2)[None, :], z.shape).copy()
                for axis, place in enumerate(others, 1):
                    w *= flat[axis][kept[axis]][place][:, None]
                    q2 += 0 if flat_last and axis == ndim - 1 else (wave[axis][kept[axis]] ** 2)[place][:, None]
                many = times[others[-1]][:, None] if ndim > 1 else times[None, :]
                bins = np.floor(np.sqrt(q2) / width + 1e-9).astype(int)
                fine = bins < nbins
                row = np.broadcast_to(np.arange(len(part))[:, None], z.shape)
                code = (row * nbins + bins)[fine]
                sums = [np.bincount(code, (v * many)[fine], minlength=len(part) * nbins) for v in (np.ones(z.shape), np.abs(z) ** 2, (z * w.conj()).real, np.abs(w) ** 2)]
                seen = np.flatnonzero((sums[0] > 0) | (np.repeat(after, nbins) == 0))          # bins without any wave vector come once per frame
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(seen // nbins)), pa.array((seen % nbins).astype(np.int32)), pa.array(sums[0][seen].astype(np.int64)),
                                                  *[pa.array(x[seen]) for x in sums[1:]]], ["g", "q_bin", "n_k", "own", "cross", "flat"])

    binned = done.mapInArrow(powers, schema).groupBy("g", "q_bin").agg(*[F.sum(c).alias(c) for c in ("n_k", "own", "cross", "flat")])
    totals = pixels.groupBy(group.alias("g")).agg(F.sum(F.col("v").cast("double")).alias("total"))
    mean = F.col("total") / math.prod(shape) if subtract_mean else F.lit(0.0)
    power = (F.col("own") - 2 * mean * F.col("cross") + mean * mean * F.col("flat")) / F.greatest("total", F.lit(1e-300)) / F.greatest("n_k", F.lit(1))
    return binned.join(totals, "g").select(*[F.col(f"g.{k}").alias(k) for k in keys], "q_bin", "n_k", F.greatest(power, F.lit(0.0)).alias("power"))


def binary_weight(points: DataFrame, field: str, ratio: float, *, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Adds ``w`` = 1 for the particles in the upper ``ratio`` quantile of the field, else 0 (over all frames)."""
    cut = exact_quantile(points, field, 1 - ratio)
    above = F.lit(None) if cut is None else F.col(field) > F.lit(cut)
    return points.withColumn("w", above.cast("double"))


def average_spectra(spectra: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean over frames, weighted by the number of wave vectors; also the streaming aggregate."""
    return spectra.groupBy(*by, "q_bin").agg(F.sum("n_k").alias("n_k"),
                                             (F.sum(F.col("power") * F.col("n_k")) / F.nullif(F.sum("n_k"), F.lit(0))).alias("power"))
