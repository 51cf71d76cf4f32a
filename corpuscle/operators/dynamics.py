"""Dynamics of trajectories: lag pairs, drift, mean square displacement, scattering, correlations.

``tracks``: keys, tr, frame, coordinates; (keys, tr, frame) is unique.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import AXES, minimg
from ..functions.scalars import attach, attach_by
from ..scratch import materialize
from .spatial import neighbourhoods

DENSE_LAGS = 8     # more lags than this, without large gaps, go through blocks of frames


def log_spaced(longest: int, number: int) -> list[int]:
    """Distinct integer lags, about ``number`` of them, spread evenly in log scale up to ``longest``."""
    longest = max(longest, 1)
    lags = {round(math.exp(math.log(longest) * i / max(number - 1, 1))) for i in range(number)}
    return sorted(lag for lag in lags if 1 <= lag <= longest)


def longest_lag(tracks: DataFrame, keys: Sequence[str] = ("tr",)) -> int:
    """Largest distance of two frames of one trajectory (of the whole series without keys): a single number comes back."""
    spans = tracks.groupBy(*keys).agg((F.max("frame") - F.min("frame")).alias("span"))
    return int(spans.agg(F.max("span")).first()[0] or 0)


def all_lags(tracks: DataFrame, keys: Sequence[str] = ("tr",)) -> list[int]:
    return list(range(1, max(longest_lag(tracks, keys), 1) + 1))


def lag_pairs(tracks: DataFrame, lags: Sequence[int], columns: Sequence[str] = AXES, *,
              keys: Sequence[str] = ("tr",)) -> DataFrame:
    """Rows of one trajectory ``lag`` frames apart: keys, frame (the earlier), lag, and ``<c>0``, ``<c>1``.

    Few lags are exploded on the earlier row, which meets the later one on (keys, frame).  Many lags share
    blocks of frames: a row goes to its own block and, as the later partner, to the one before, and blocks
    are joined on (keys, block).  Three rows per row are shuffled however many lags there are, and no
    trajectory, however long, is a join key by itself.
    """
    keys, lags = list(keys), sorted(set(int(v) for v in lags))
    earlier = tracks.select(*keys, "frame", *[F.col(c).alias(f"{c}0") for c in columns])
    later = tracks.select(*keys, F.col("frame").alias("_f1"), *[F.col(c).alias(f"{c}1") for c in columns])
    if len(lags) <= DENSE_LAGS or lags[-1] > 4 * len(lags):
        a = (earlier.withColumn("lag", F.explode(F.array(*[F.lit(v) for v in lags])))
             .withColumn("_f1", F.col("frame") + F.col("lag")))
        joined = a.join(later, [*keys, "_f1"])
    else:
        width = lags[-1] + 1
        a = earlier.withColumn("_blk", F.floor(F.col("frame") / width))
        own = F.floor(F.col("_f1") / width)
        b = later.withColumn("_blk", F.explode(F.array(own, own - 1)))
        step = F.col("_f1") - F.col("frame")
        if lags == list(range(lags[0], lags[-1] + 1)):
            wanted = step.between(lags[0], lags[-1])
        else:
            wanted = step.isin(lags)
        joined = a.join(b, [*keys, "_blk"]).where(wanted).withColumn("lag", step)
    return joined.select(*keys, "frame", F.col("lag").cast("int").alias("lag"),
                         *[f"{c}{i}" for i in (0, 1) for c in columns])


def displacements(tracks: DataFrame, lags: Sequence[int], *, coords: Sequence[str] = AXES, keys=("tr",),
                  periods: Sequence[float] | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """keys, frame, lag, d<axis> per coordinate, d2 [and <c>0, <c>1 of the carried columns]."""
    pairs = lag_pairs(tracks, lags, [*coords, *carry], keys=keys)
    steps = {}
    for i, c in enumerate(coords):
        d = F.col(f"{c}1") - F.col(f"{c}0")
        steps[f"d{c}"] = minimg(d, periods[i]) if periods is not None else d
    moved = pairs.withColumns(steps)
    d2 = sum((F.col(f"d{c}") * F.col(f"d{c}") for c in coords[1:]), F.col(f"d{coords[0]}") * F.col(f"d{coords[0]}"))
    return moved.withColumn("d2", d2)


def time_functions(tracks: DataFrame, lags: Sequence[int], *, q: float, coords: Sequence[str] = AXES, keys=("tr",),
                   by: Sequence[str] = (), overlap: float | None = None, periods=None) -> DataFrame:
    """Per lag (and ``by`` keys): n, msd, ngp, isf of each axis and their mean [, overlap fraction].

    Everything comes from one pass over the lag pairs.  msd is in squared length, summed over the axes;
    ngp = 3 <r^4> / (5 <r^2>^2) - 1.
    """
    moved = displacements(tracks, lags, coords=coords, keys=keys, periods=periods)
    aggs = [F.count("*").alias("n"), F.avg("d2").alias("msd"), F.avg(F.col("d2") * F.col("d2")).alias("_r4")]
    aggs += [F.avg(F.cos(F.col(f"d{c}") * q)).alias(f"isf_{c}") for c in coords]
    if overlap is not None:
        aggs.append(F.avg((F.col("d2") < overlap * overlap).cast("double")).alias("overlap"))
    table = moved.groupBy(*by, "lag").agg(*aggs)
    mean_isf = sum((F.col(f"isf_{c}") for c in coords[1:]), F.col(f"isf_{coords[0]}")) / len(coords)
    square = F.when(F.col("msd") > 0, F.col("msd") * F.col("msd"))
    out = [*by, "lag", "n", "msd", (3 * F.col("_r4") / (5 * square) - 1).alias("ngp"),
           *[f"isf_{c}" for c in coords], mean_isf.alias("isf")]
    return table.select(*out, *(["overlap"] if overlap is not None else []))


def with_lag_zero(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add the row of lag 0: msd 0, every isf 1."""
    values = {"lag": F.lit(0), "n": F.lit(None).cast("bigint"), "msd": F.lit(0.0), "ngp": F.lit(None).cast("double")}
    zero = table.select(*by).distinct() if by else table.sparkSession.range(1)
    zero = zero.select(*by, *[values.get(c, F.lit(1.0)).alias(c) for c in table.columns if c not in by])
    return table.unionByName(zero)


def msd_from_starts(tracks: DataFrame, t0: int, t1: int, averages: int, *, coords: Sequence[str] = AXES,
                    keys=("tr",)) -> DataFrame:
    """MSD of lags 1..t1-t0 from the ``averages`` starts t0, t0+1, ..., t0+averages-1.

    Each start uses the trajectories alive from it to (start + longest lag), weighted by their number.
    """
    longest = t1 - t0 - averages + 1
    from .select import spans
    alive = spans(tracks, keys)
    starts = (tracks.where(F.col("frame").between(t0, t0 + averages - 1))
              .select(*keys, F.col("frame").alias("_s")))
    usable = (starts.join(alive, list(keys)).where(F.col("t_last") >= F.col("_s") + longest)
              .select(*keys, F.col("_s").alias("frame")))
    moved = displacements(tracks, list(range(1, longest + 1)), coords=coords, keys=keys)
    return (moved.join(usable, [*keys, "frame"], "left_semi").groupBy("lag")
            .agg(F.count("*").alias("n"), F.avg("d2").alias("msd")))


def relaxation_time(isf: DataFrame, threshold: float = math.exp(-1), column: str = "isf",
                    by: Sequence[str] = ()) -> DataFrame:
    """First lag at which the function is below the threshold, else the last one."""
    return isf.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col(column) < threshold, F.col("lag"))),
                                           F.max("lag")).alias("tau"))


# --- drift -------------------------------------------------------------------------------------------

def drift(tracks: DataFrame, *, coords: Sequence[str] = AXES, keys=("tr",), group: Sequence[str] = ()) -> DataFrame:
    """Mean displacement from the previous frame: group, frame, n, d<axis>; zero with fewer than two particles."""
    moved = displacements(tracks, [1], coords=coords, keys=[*group, *keys]).withColumn("frame", F.col("frame") + 1)
    means = moved.groupBy(*group, "frame").agg(F.count("*").alias("n"), *[F.avg(f"d{c}").alias(f"d{c}") for c in coords])
    frames = tracks.select(*group, "frame").distinct()
    return (frames.join(means, [*group, "frame"], "left")
            .select(*group, "frame", F.coalesce("n", F.lit(0)).alias("n"),
                    *[F.when(F.col("n") >= 2, F.col(f"d{c}")).otherwise(0.0).alias(f"d{c}") for c in coords]))


def running_total(table: DataFrame, order: str, columns: Sequence[str], group: Sequence[str] = (),
                  block: int = 4096) -> DataFrame:
    """Cumulative sums in the order of an integer column, block by block, then over the block totals."""
    group = list(group)
    blocked = table.withColumn("_blk", F.floor(F.col(order) / block))
    totals = blocked.groupBy(*group, "_blk").agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    before = Window.partitionBy(*group).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, "_blk", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0.0)).alias(f"_b_{c}")
                                            for c in columns])
    w = Window.partitionBy(*group, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (blocked.join(totals, [*group, "_blk"])
            .withColumns({c: F.sum(c).over(w) + F.col(f"_b_{c}") for c in columns})
            .drop("_blk", *[f"_b_{c}" for c in columns]))


def cumulative_drift(tracks: DataFrame, *, coords: Sequence[str] = AXES, keys=("tr",), group=()) -> DataFrame:
    """Drift since the first frame, shifted so that its smallest value on every axis is 0."""
    names = [f"d{c}" for c in coords]
    steps = materialize(drift(tracks, coords=coords, keys=keys, group=group), "drift")      # one row per frame, used again and again
    path = running_total(steps, "frame", names, group)
    lows = path.groupBy(*group).agg(*[F.min(n).alias(f"_m_{n}") for n in names])
    joined = attach_by(path, lows, group)
    return joined.select(*group, "frame", *[(F.col(n) - F.col(f"_m_{n}")).alias(n) for n in names])


def remove_drift(tracks: DataFrame, *, coords: Sequence[str] = AXES, keys=("tr",), group=()) -> DataFrame:
    """Positions in the frame that moves with the mean of the particles."""
    path = cumulative_drift(tracks, coords=coords, keys=keys, group=group)
    return (tracks.join(path, [*group, "frame"])
            .select(*[(F.col(c) - F.col(f"d{c}")).alias(c) if c in coords else F.col(c) for c in tracks.columns]))


def centre_frames(tracks: DataFrame, *, coords: Sequence[str] = AXES, group=()) -> DataFrame:
    """Positions relative to the mean position of their frame (trajectories that span the whole range)."""
    mean = tracks.groupBy(*group, "frame").agg(*[F.avg(c).alias(f"_m_{c}") for c in coords])
    return (tracks.join(mean, [*group, "frame"])
            .select(*[(F.col(c) - F.col(f"_m_{c}")).alias(c) if c in coords else F.col(c) for c in tracks.columns]))


# --- correlations ------------------------------------------------------------------------------------

def collective_isf(points: DataFrame, lags: Sequence[int], q: Sequence[float], *, coords: Sequence[str] = AXES,
                   group=()) -> DataFrame:
    """<rho(t) rho*(t + lag)> / N along the wave vector q: per-frame sums first, then lags of the frame table."""
    phase = sum((F.col(c) * k for c, k in zip(coords[1:], q[1:])), F.col(coords[0]) * q[0])
    frames = points.groupBy(*group, "frame").agg(F.count("*").cast("double").alias("n"),
                                                 F.sum(F.cos(phase)).alias("a"), F.sum(F.sin(phase)).alias("b"))
    spaced = frames if group else frames.withColumn("_one", F.lit(0))
    pairs = lag_pairs(spaced, lags, ["n", "a", "b"], keys=list(group) or ["_one"])
    return pairs.groupBy(*group, "lag").agg(
        F.count("*").alias("n"), F.avg((F.col("a0") * F.col("a1") + F.col("b0") * F.col("b1")) / F.col("n0")).alias("isf"))


def time_correlation(tracks: DataFrame, field: str, lags: Sequence[int], *, keys=("tr",)) -> DataFrame:
    """Autocorrelation of a scalar minus its overall mean, divided by its value at lag 0."""
    mean = tracks.agg(F.avg(field).alias("_m"))
    centred = attach(tracks, mean).withColumn(field, F.col(field) - F.col("_m"))
    pairs = lag_pairs(centred, [v for v in lags if v > 0], [field], keys=keys)
    cross = pairs.groupBy("lag").agg(F.count("*").alias("n"), F.avg(F.col(f"{field}0") * F.col(f"{field}1")).alias("c"))
    zero = centred.agg(F.lit(0).alias("lag"), F.count("*").alias("n"), F.avg(F.col(field) * F.col(field)).alias("c"))
    norm = zero.select(F.nullif(F.col("c"), F.lit(0.0)).alias("_c0"))
    return attach(cross.unionByName(zero), norm).select("lag", "n", (F.col("c") / F.col("_c0")).alias("c"))


def vector_time_correlation(tracks: DataFrame, columns: Sequence[str], lags: Sequence[int], product: Callable | None = None,
                            *, keys=("tr",)) -> DataFrame:
    """Mean product of a coefficient vector with itself ``lag`` later; plain dot product unless ``product(lag row)``."""
    pairs = lag_pairs(tracks, lags, columns, keys=keys)
    value = product() if product else sum((F.col(f"{c}0") * F.col(f"{c}1") for c in columns[1:]),
                                          F.col(f"{columns[0]}0") * F.col(f"{columns[0]}1"))
    return pairs.groupBy("lag").agg(F.count("*").alias("n"), F.avg(value).alias("c"))


def qlm_time_correlation(tracks: DataFrame, l: int, lags: Sequence[int], *, keys=("tr",)) -> DataFrame:
    """Time correlation of q_lm: 4 pi/(2l+1) <sum over m of Re(q_lm(t) conj q_lm(t + lag))>."""
    from ..functions.harmonics import coefficient_columns
    def product() -> Column:
        total = F.col("re_00") * F.col("re_01")
        for m in range(1, l + 1):
            total = total + 2 * (F.col(f"re_{m}0") * F.col(f"re_{m}1") + F.col(f"im_{m}0") * F.col(f"im_{m}1"))
        return total * (4 * math.pi / (2 * l + 1))
    return vector_time_correlation(tracks, coefficient_columns(l), lags, product, keys=keys)


def overlap_by_bin(tracks: DataFrame, lags: Sequence[int], reach: float, *, axis: str = "z", width: float = 1.0,
                   coords: Sequence[str] = AXES, keys=("tr",)) -> DataFrame:
    """Particles that moved less than ``reach``, per lag and slice of the start position."""
    moved = displacements(tracks, lags, coords=coords, keys=keys)
    return moved.groupBy("lag", F.floor(F.col(f"{axis}0") / width).cast("int").alias("bin")).agg(
        F.count("*").alias("n"), F.count_if(F.col("d2") < reach * reach).alias("n_overlap"))


def mobility(tracks: DataFrame, lags: Sequence[int], reach: float, kind: str = "gauss", *, coords: Sequence[str] = AXES,
             keys=("tr",), group: Sequence[str] = (), subtract_mean: bool = True) -> DataFrame:
    """Start position and mobility u of each particle and lag.

    The mean displacement of the (frame, lag) is taken off first.  ``gauss``: exp(-d2/reach^2);
    ``overlap``: 1 if d2 < reach^2.
    """
    moved = displacements(tracks, lags, coords=coords, keys=[*group, *keys])
    names = [f"d{c}" for c in coords]
    if subtract_mean:
        mean = moved.groupBy(*group, "frame", "lag").agg(*[F.avg(n).alias(f"_m_{n}") for n in names])
        moved = moved.join(mean, [*group, "frame", "lag"]).withColumns({n: F.col(n) - F.col(f"_m_{n}") for n in names})
    d2 = sum((F.col(n) * F.col(n) for n in names[1:]), F.col(names[0]) * F.col(names[0]))
    u = F.exp(-d2 / reach ** 2) if kind == "gauss" else (d2 < reach ** 2).cast("double")
    return moved.select(*group, *keys, "frame", "lag", *[F.col(f"{c}0").alias(c) for c in coords], u.alias("u"))


def four_point(mobilities: DataFrame, cutoff: float, nbins: int, *, coords: Sequence[str] = AXES, id_col: str = "tr",
               group: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """Spatial correlation of the mobility, per lag and distance bin: n pairs, sum of u_p u_q.

    ``where`` restricts the pairs, e.g. to a slice or a plane.
    """
    from .pairs import pair_histogram
    hist = pair_histogram(mobilities, cutoff, nbins, keys=[*group, "frame", "lag"], id_col=id_col, coords=coords,
                          fields=["u"], where=where)
    return hist.groupBy(*group, "lag", "bin").agg(F.sum("n").alias("n"), F.sum("sum_u").alias("g4"))


def two_point_displacements(tracks: DataFrame, t0: int, lags: Sequence[int], rmin: float, rmax: float, nbins: int, *,
                            keys=("tr",)) -> DataFrame:
    """Correlated displacements of pairs at frame t0: lag, bin (log of distance), n, sums and sums of squares.

    Components: along the pair (n), in the plane of the pair and z (q), across it in xy (p).
    """
    (id_col,) = keys
    start = tracks.where(F.col("frame") == t0)
    moved = lag_pairs(tracks, lags, AXES, keys=keys).where(F.col("frame") == t0)
    shifts = moved.select(*keys, "lag", *[(F.col(f"{c}1") - F.col(f"{c}0")).alias(f"u{c}") for c in AXES])
    # tracks that start at one place and move alike count as one with a weight: pairs among them are closer than rmin
    moves = [f"u{c}" for c in AXES]
    sites = (start.select(id_col, *AXES).join(shifts, id_col).groupBy("lag", *AXES, *moves)
             .agg(F.min(id_col).alias(id_col), F.count("*").cast("double").alias("w")))
    width, names, cells = math.log(rmax / rmin) / nbins, ("n", "q", "p"), 1 << 19

    def work(ids, places, others, there):
        """Sums over the pairs of some tracks with those of greater ids, one bin in a row."""
        sums = np.zeros((nbins + 3, 8))
        step = max(1, cells // max(1, len(others)))
        for i in range(0, len(ids), step):
            some = places[i:i + step]
            d = [there[None, :, k] - some[:, k, None] for k in range(3)]
            d2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
            a, b = np.nonzero((d2 < rmax * rmax) & (d2 >= rmin * rmin) & (ids[i:i + step, None] < others[None, :]))
            d, d2, u, v = [x[a, b] for x in d], d2[a, b], some[a, 3:6].T, there[b, 3:6].T
            flat = d[0] * d[0] + d[1] * d[1]
            along = (u[0] * d[0] + u[1] * d[1] + u[2] * d[2]) * (v[0] * d[0] + v[1] * d[1] + v[2] * d[2]) / d2
            across = (u[0] * d[1] - u[1] * d[0]) * (v[0] * d[1] - v[1] * d[0])
            placed = flat > 0                                   # a pair along z has no plane with z
            across = np.where(placed, across / np.where(placed, flat, 1.0), 0.0)
            rest = np.where(placed, u[0] * v[0] + u[1] * v[1] + u[2] * v[2] - along - across, 0.0)
            bins, weight = np.floor((np.log(np.sqrt(d2)) - math.log(rmin)) / width).astype(np.int64) + 1, some[a, 6] * there[b, 6]
            columns = [weight, *[weight * x for x in (along, rest, across)], *[weight * x * x for x in (along, rest, across)], weight * placed]
            for k, column in enumerate(columns):
                sums[:, k] += np.bincount(bins, weights=column, minlength=nbins + 3)
        found = np.flatnonzero(sums[:, 0])
        sums = sums[found]
        return {"bin": (found - 1).astype(np.int32), "n": sums[:, 0], **{f"{c}_{k}": sums[:, 1 + 3 * j + i] for j, c in enumerate(("sum", "sq")) for i, k in enumerate(names)},
                "placed": sums[:, -1]}

    columns = [f"{c}_{k}" for c in ("sum", "sq") for k in names]
    parts = neighbourhoods(sites, rmax, work, ", ".join(["bin int", *[f"{c} double" for c in ("n", *columns, "placed")]]), keys=["lag"], id_col=id_col, carry=[*moves, "w"])
    # sums without any pair that has the component stay NULL
    part = lambda c: F.sum(c) if c.endswith("_n") else F.when(F.sum("placed") > 0, F.sum(c))
    return parts.groupBy("lag", "bin").agg(F.sum("n").cast("long").alias("n"), *[part(c).alias(c) for c in columns])


def two_point_msd(table: DataFrame) -> DataFrame:
    """Mean and standard deviation of each component from the sums."""
    cols = []
    for k in ("n", "q", "p"):
        mean = F.col(f"sum_{k}") / F.col("n")
        cols += [mean.alias(f"msd_{k}"), F.sqrt(F.greatest(F.col(f"sq_{k}") / F.col("n") - mean * mean, F.lit(0.0))).alias(f"err_{k}")]
    return table.select("lag", "bin", "n", *cols)
