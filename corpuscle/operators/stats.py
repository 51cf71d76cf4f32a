"""Histograms, mean maps, densities and curve helpers."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import AXES


def _bin(value: Column, low: float, high: float, nbins: int) -> Column:
    """Bin of [low, high); the upper edge belongs to the last bin, NULL outside."""
    i = F.floor((value - low) * (nbins / (high - low)))
    i = F.when(value == high, F.lit(nbins - 1)).otherwise(i)
    return F.when((i >= 0) & (i < nbins), i).cast("int")


def value_range(df: DataFrame, column: str) -> tuple[float, float]:
    """Smallest and largest value, as the edges of a histogram that leaves nothing out."""
    row = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    low, high = (0.0, 1.0) if row[0] is None else (row[0], row[1])
    return (low, high) if high > low else (low, low + 1)


FEW = 10_000          # values that are sorted as they are


def exact_quantile(df: DataFrame, column: str, share: float, few: int = FEW):
    """Smallest value with at least ``share`` of all values at or below it; None if there are none, NULLs do not count.

    A round encloses the wanted rank between two approximate percentiles and counts the values below and at them, so every round leaves less than a thousandth
    of the values; the last few are sorted.
    """
    inside, wide = df.select(F.col(column).alias("v")).where("v is not null"), 3e-4
    many = inside.count()
    rank = max(math.ceil(share * many), 1)
    while many > few:
        at = rank / many
        low, high = inside.agg(F.percentile_approx("v", [max(at - wide, 0.0), min(at + wide, 1.0)], 10_000)).first()[0]
        below, upto, before, last = inside.agg(*[F.count_if(test) for edge in (low, high) for test in (F.col("v") < F.lit(edge), F.col("v") <= F.lit(edge))]).first()
        if below < rank <= upto:
            return low
        if before < rank <= last:
            return high
        if not upto < rank <= before:
            wide *= 4
            continue
        inside, rank, many = inside.where((F.col("v") > F.lit(low)) & (F.col("v") < F.lit(high))), rank - upto, before - upto
    return inside.orderBy("v").offset(rank - 1).first()[0] if many else None


def histogram(df: DataFrame, column: str, low: float, high: float, nbins: int, keys: Sequence[str] = ()) -> DataFrame:
    return (df.select(*keys, _bin(F.col(column), low, high, nbins).alias("bin")).where("bin is not null")
            .groupBy(*keys, "bin").agg(F.count("*").alias("n")))


def histogram2d(df: DataFrame, x: str, y: str, range_x, range_y, nbins: tuple[int, int], keys=()) -> DataFrame:
    """Counts per (bin_x, bin_y)."""
    return (df.select(*keys, _bin(F.col(x), *range_x, nbins[0]).alias("bin_x"), _bin(F.col(y), *range_y, nbins[1]).alias("bin_y"))
            .where("bin_x is not null and bin_y is not null")
            .groupBy(*keys, "bin_x", "bin_y").agg(F.count("*").alias("n")))


def decimate_histogram(hist: DataFrame, threshold: int, nbins: int) -> DataFrame:
    """Merge successive bins until each holds more than ``threshold``: first, last, n.  The last group may hold less.

    The histogram has ``nbins`` rows at most, whatever the data, and is folded as one array.
    """
    rows = hist.agg(F.sort_array(F.collect_list(F.struct("bin", F.col("n").cast("long").alias("n")))).alias("h"))
    folded = rows.selectExpr(f"""
        aggregate(h,
          named_struct('out', cast(array() as array<struct<first:int,last:int,n:bigint>>),
                       'first', cast(null as int), 'n', 0L),
          (s, b) -> if(s.n + b.n > {int(threshold)},
             named_struct('out', concat(s.out, array(named_struct('first', coalesce(s.first, b.bin), 'last', b.bin, 'n', s.n + b.n))),
                          'first', cast(null as int), 'n', 0L),
             named_struct('out', s.out, 'first', coalesce(s.first, b.bin), 'n', s.n + b.n)),
          s -> if(s.n > 0, concat(s.out, array(named_struct('first', s.first, 'last', element_at(h, -1).bin, 'n', s.n))), s.out)) as o""")
    return folded.select(F.explode("o").alias("o")).select("o.*")


def mean_map(df: DataFrame, x: str, value: str, low: float, high: float, nbins: int, keys=()) -> DataFrame:
    """Mean and count of a value per bin of x."""
    return (df.select(*keys, _bin(F.col(x), low, high, nbins).alias("bin"), F.col(value).alias("_v")).where("bin is not null")
            .groupBy(*keys, "bin").agg(F.count("_v").alias("n"), F.avg("_v").alias("mean")))


def mean_map2d(df: DataFrame, x: str, y: str, value: str, range_x, range_y, nbins: tuple[int, int], keys=(),
               empty: float = -1.0) -> DataFrame:
    """Mean per (bin_x, bin_y), ``empty`` where there is nothing; the full grid is returned."""
    grid = (df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(nbins[0] - 1))).alias("bin_x"))
            .withColumn("bin_y", F.explode(F.sequence(F.lit(0), F.lit(nbins[1] - 1)))))
    means = (df.select(_bin(F.col(x), *range_x, nbins[0]).alias("bin_x"), _bin(F.col(y), *range_y, nbins[1]).alias("bin_y"),
                       F.col(value).alias("_v")).groupBy("bin_x", "bin_y").agg(F.avg("_v").alias("mean")))
    return grid.join(means, ["bin_x", "bin_y"], "left").na.fill(empty, ["mean"])


def binned_moments(df: DataFrame, x: str, value: str, low: float, high: float, nbins: int, keys=()) -> DataFrame:
    """Count, mean and population deviation of a value per bin of x, relative to the overall mean of the value.

    The overall mean is rebuilt from the bin sums and those of the rows outside, so the rows are read once.
    """
    bins = (df.select(*keys, _bin(F.col(x), low, high, nbins).alias("bin"), F.col(value).alias("_v"))
            .groupBy(*keys, "bin").agg(F.count("_v").alias("n"), F.sum("_v").alias("_s"), F.avg("_v").alias("_m"),
                                       F.stddev_pop("_v").alias("_d")))
    w = Window.partitionBy(*keys)
    overall = F.nullif(F.sum("_s").over(w) / F.nullif(F.sum("n").over(w), F.lit(0)), F.lit(0.0))
    return (bins.withColumn("_all", overall).where("bin is not null")
            .select(*keys, "bin", "n", (F.col("_m") / F.col("_all")).alias("mean"), (F.col("_d") / F.col("_all")).alias("dev")))


def number_density(points: DataFrame, *, keys=("frame",), coords: Sequence[str] = AXES, periods=None) -> DataFrame:
    """Particles per unit volume of each frame's extent, or of the periodic box."""
    from .select import extent
    box = extent(points, keys, coords)
    if periods is not None:
        return box.select(*keys, "n", (F.col("n") / float(math.prod(periods))).alias("density"))
    volume = F.lit(1.0)
    for c in coords:
        volume = volume * (F.col(f"{c}1") - F.col(f"{c}0"))
    return box.select(*keys, "n", (F.col("n") / F.when(volume > 0, volume)).alias("density"))


def volume_fraction(density: DataFrame, radius: float) -> DataFrame:
    return density.withColumn("phi", 4 / 3 * math.pi * radius ** 3 * F.col("density"))


def z_profile(points: DataFrame, low: float, high: float, nbins: int, area: float, *, axis: str = "z", keys=()) -> DataFrame:
    """Number density per slice along an axis."""
    slice_volume = area * (high - low) / nbins
    return histogram(points, axis, low, high, nbins, keys).withColumn("density", F.col("n") / slice_volume)


def slab_density(points: DataFrame, bottom: float, top: float, area: float, *, axis: str = "z", keys=("frame",)) -> DataFrame:
    """Number density of the part of each frame between two heights."""
    return (points.where(F.col(axis).between(bottom, top)).groupBy(*keys).agg(F.count("*").alias("n"))
            .withColumn("density", F.col("n") / (area * (top - bottom))))


def local_maxima(curve: DataFrame, x: str, y: str, *, by: Sequence[str] = (), smooth: int = 0) -> DataFrame:
    """Points of a (short) curve higher than both neighbours, after a running mean of 2 * smooth + 1 points."""
    w = Window.partitionBy(*by).orderBy(x)
    value = F.avg(y).over(w.rowsBetween(-smooth, smooth)) if smooth else F.col(y)
    s = curve.withColumn("_y", value)
    s = s.withColumns({"_a": F.lag("_y").over(w), "_b": F.lead("_y").over(w)})
    return s.where("_y > _a and _y > _b").select(*by, x, F.col("_y").alias(y))


def peaks_and_valleys(curve: DataFrame, x: str, y: str, *, by: Sequence[str] = ()) -> DataFrame:
    """Local maxima (kind 'peak') and minima ('valley') of a (short) curve."""
    w = Window.partitionBy(*by).orderBy(x)
    s = curve.withColumns({"_a": F.lag(y).over(w), "_b": F.lead(y).over(w)})
    kind = (F.when((F.col(y) > F.col("_a")) & (F.col(y) > F.col("_b")), "peak")
            .when((F.col(y) < F.col("_a")) & (F.col(y) < F.col("_b")), "valley"))
    return s.select(*by, x, y, kind.alias("kind")).where("kind is not null")
