"""Pair histograms: g(r) and every other aggregate over pairs binned by distance."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import AXES
from ..functions.scalars import attach
from ..scratch import materialize
from .select import extent, mark_inside
from .spatial import CROWD_LIMIT, both_ways, crowded_blocks, range_pairs


def distance_bin(d2: Column, cutoff: float, nbins: int) -> Column:
    return F.floor(F.sqrt(d2) * (nbins / cutoff)).cast("int")


def complete_bins(hist: DataFrame, groups: DataFrame, nbins: int, keys: Sequence[str],
                  columns: Sequence[str] | None = None) -> DataFrame:
    """Add the empty bins 0..nbins-1 of every group, with zeros."""
    columns = columns or [c for c in hist.columns if c not in (*keys, "bin")]
    grid = groups.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(nbins - 1))))
    return grid.join(hist, [*keys, "bin"], "left").na.fill(0, columns)


def pair_histogram(points: DataFrame, cutoff: float, nbins: int, *, keys: Sequence[str] = ("frame",),
                   id_col: str = "pid", coords: Sequence[str] = AXES, fields: Sequence[str] = (), added: Sequence[str] = (),
                   where: Column | None = None, periods=None, block_factor: float = 1.0,
                   crowd_limit: int = CROWD_LIMIT) -> DataFrame:
    """Unordered pairs per distance bin: keys, bin, n, ``sum_<f>`` of f_p * f_q for ``fields`` and of f_p + f_q for ``added``.

    ``where`` may use dx, dy, dz, d2.  Where points crowd, coincident ones are merged first and pairs of
    places count with the product of their multiplicities; the result is the same.
    """
    keys, coords, carried = list(keys), list(coords), [*fields, *added]
    _, n_hot, _ = crowded_blocks(points, cutoff * block_factor, keys, coords, crowd_limit)
    options = dict(keys=keys, coords=coords, periods=periods, block_factor=block_factor,
                   crowd_limit=crowd_limit if n_hot else None)
    bin_col = distance_bin(F.col("d2"), cutoff, nbins).alias("bin")
    if not n_hot:
        pairs = range_pairs(points, cutoff, id_col=id_col, carry=carried, **options)
        if where is not None:
            pairs = pairs.where(where)
        return pairs.groupBy(*keys, bin_col).agg(
            F.count("*").alias("n"), *[F.sum(F.col(f"p_{f}") * F.col(f"q_{f}")).alias(f"sum_{f}") for f in fields],
            *[F.sum(F.col(f"p_{f}") + F.col(f"q_{f}")).alias(f"sum_{f}") for f in added])

    sites = points.groupBy(*keys, *coords).agg(
        F.min(id_col).alias("site"), F.count("*").alias("_w"), *[F.sum(f).alias(f) for f in carried],
        *[F.sum(F.col(f) * F.col(f)).alias(f"_sq_{f}") for f in fields])
    pairs = range_pairs(sites, cutoff, id_col="site", carry=["_w", *carried], **options)
    here = sites.where("_w > 1").withColumns({d: F.lit(0.0) for d in ("dx", "dy", "dz", "d2")})
    if where is not None:
        pairs, here = pairs.where(where), here.where(where)
    parts = pairs.select(*keys, bin_col, (F.col("p__w") * F.col("q__w")).alias("n"),
                         *[(F.col(f"p_{f}") * F.col(f"q_{f}")).alias(f"sum_{f}") for f in fields],
                         *[(F.col(f"p_{f}") * F.col("q__w") + F.col(f"q_{f}") * F.col("p__w")).alias(f"sum_{f}") for f in added])
    same = here.select(*keys, F.lit(0).alias("bin"), F.expr("_w * (_w - 1) div 2").alias("n"),
                       *[((F.col(f) * F.col(f) - F.col(f"_sq_{f}")) / 2).alias(f"sum_{f}") for f in fields],
                       *[(F.col(f) * (F.col("_w") - 1)).alias(f"sum_{f}") for f in added])
    return (parts.unionByName(same).groupBy(*keys, "bin")
            .agg(F.sum("n").alias("n"), *[F.sum(f"sum_{f}").alias(f"sum_{f}") for f in carried]))


def pair_aggregate(points: DataFrame, cutoff: float, aggregates: Sequence[Column], *, bin: Column | None = None,
                   nbins: int = 100, keys: Sequence[str] = ("frame",), carry: Sequence[str] = (),
                   where: Column | None = None, block_factor: float = 1.0, **options) -> DataFrame:
    """User-defined aggregates over unordered pairs; expressions may use p, q, dx.., d2, p_<c> and q_<c>."""
    pairs = range_pairs(points, cutoff, keys=keys, carry=carry, block_factor=block_factor, **options)
    if where is not None:
        pairs = pairs.where(where)
    bin = distance_bin(F.col("d2"), cutoff, nbins) if bin is None else bin
    return pairs.groupBy(*keys, bin.alias("bin")).agg(*aggregates)


def rdf(points: DataFrame, cutoff: float, nbins: int, *, keys: Sequence[str] = ("frame",), margin: float | None = None,
        coords: Sequence[str] = AXES, periods=None, **options) -> DataFrame:
    """g(r) of every frame: keys, bin, r (lower edge), n (ordered pairs), g.

    Centres are the particles further than ``margin`` (the cutoff unless given) from the faces; the density
    is that of the extent of the data, or of the periodic box.  g of bin 0 is 0.
    """
    box = materialize(extent(points, keys, coords), "extent")        # one row per frame, used three times
    if periods is not None:
        marked = points.withColumn("inside", F.lit(True))
    else:
        marked = mark_inside(points, cutoff if margin is None else margin, keys=keys, coords=coords, box=box)
    marked = marked.withColumn("inside", F.col("inside").cast("int"))
    hist = pair_histogram(marked, cutoff, nbins, keys=keys, coords=coords, added=["inside"], periods=periods, **options)
    hist = hist.select(*keys, "bin", F.col("sum_inside").alias("n"))
    stats = box.join(marked.groupBy(*keys).agg(F.sum("inside").alias("n_sel")), list(keys))
    if periods is None:
        volume = F.lit(1.0)
        for c in coords:
            volume = volume * (F.col(f"{c}1") - F.col(f"{c}0"))
    else:
        volume = F.lit(float(math.prod(periods)))
    stats = stats.select(*keys, (F.col("n") / F.nullif(volume, F.lit(0.0))).alias("density"), "n_sel")
    width = cutoff / nbins
    full = complete_bins(hist, box, nbins, keys, ["n"]).join(stats, list(keys))
    shell = 4 * math.pi * F.col("density") * F.col("n_sel") * width ** 3 * F.col("bin") * F.col("bin")
    return full.select(*keys, "bin", (F.col("bin") * width).alias("r"), "n",
                       F.coalesce(F.col("n") / F.nullif(shell, F.lit(0.0)), F.lit(0.0)).alias("g"))


def mean_rdf(frame_rdf: DataFrame) -> DataFrame:
    """g(r) averaged over the frames."""
    return frame_rdf.groupBy("bin").agg(F.avg("r").alias("r"), F.avg("g").alias("g"))


def bond_length(total: DataFrame) -> DataFrame:
    """One row: radius of the highest peak of g(r) and of the lowest bin beyond it."""
    peak = total.agg(F.max_by("bin", F.struct("g", -F.col("bin"))).alias("peak_bin"),
                     F.max_by("r", F.struct("g", -F.col("bin"))).alias("peak"))
    beyond = attach(total, peak).where("bin > peak_bin")
    return beyond.agg(F.first("peak").alias("peak"), F.min_by("r", F.struct("g", "bin")).alias("bond_length"))


def scaled_pair_histogram(points: DataFrame, maxdist: float, nbins: int, radius_max: float, *, r: str = "r",
                          keys: Sequence[str] = ("frame",), **options) -> DataFrame:
    """Pairs binned by d / (r_p + r_q), below ``maxdist``."""
    reach = F.col(f"p_{r}") + F.col(f"q_{r}")
    ratio2 = F.col("d2") / (reach * reach)
    return pair_aggregate(points, 2 * radius_max * maxdist, [F.count("*").alias("n")], carry=[r], keys=keys,
                          where=ratio2 < maxdist * maxdist,
                          bin=F.floor(F.sqrt(ratio2) * (nbins / maxdist)).cast("int"), **options)


def planar_condition(sine: float) -> Column:
    """Pairs close to the xy plane: dz^2 <= sin^2 * d2."""
    return F.col("dz") * F.col("dz") <= sine * sine * F.col("d2")


def slice_histogram(points: DataFrame, cutoff: float, nbins: int, width: float, *, keys: Sequence[str] = ("frame",),
                    **options) -> DataFrame:
    """Pairs within |dz| <= width / 2, binned by their distance in the xy plane."""
    flat2 = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    reach = math.sqrt(cutoff * cutoff + width * width / 4) * (1 + 1e-9)
    return pair_aggregate(points, reach, [F.count("*").alias("n")], keys=keys,
                          where=(F.abs("dz") <= width / 2) & (flat2 < cutoff * cutoff),
                          bin=distance_bin(flat2, cutoff, nbins), **options)


def hann_weight(periods: Sequence[float], coords: Sequence[str] = AXES, lows: Sequence[float] | None = None) -> Column:
    """Product over the axes of 0.5 * (1 - cos(2 pi (x - low) / L)): 1 in the middle of the box, 0 at its faces."""
    w = F.lit(1.0)
    for c, L, low in zip(coords, periods, lows or [0.0] * len(coords)):
        w = w * (0.5 * (1 - F.cos((F.col(c) - float(low)) * (2 * math.pi / L))))
    return w


def windowed_histogram(points: DataFrame, cutoff: float, nbins: int, periods: Sequence[float], lows: Sequence[float] | None = None,
                       **options) -> DataFrame:
    """Pairs of a finite sample weighted by a Hann window on both members (box from ``lows``, or 0)."""
    coords = options.get("coords", AXES)
    return pair_histogram(points.withColumn("w", hann_weight(periods, coords, lows)), cutoff, nbins, fields=["w"], **options)


def particle_histogram(points: DataFrame, cutoff: float, nbins: int, *, species: str | None = None,
                       keys: Sequence[str] = ("frame",), id_col: str = "pid", coords: Sequence[str] = AXES, periods=None,
                       block_factor: float = 1.0, crowd_limit: int = CROWD_LIMIT) -> DataFrame:
    """Neighbours of each particle per bin (and per species of the neighbour): keys, p, [species,] bin, n.

    Where points crowd, places are counted instead of particles and the counts handed to all that share one.
    """
    keys, coords = list(keys), list(coords)
    kind = [species] if species else []
    by = [F.col(f"q_{species}").alias("species")] if species else []
    bin_col = distance_bin(F.col("d2"), cutoff, nbins).alias("bin")
    options = dict(keys=keys, coords=coords, periods=periods, block_factor=block_factor)
    _, n_hot, _ = crowded_blocks(points, cutoff * block_factor, keys, coords, crowd_limit)
    if not n_hot:
        pairs = both_ways(range_pairs(points, cutoff, id_col=id_col, carry=kind, crowd_limit=None, **options), keys)
        return pairs.groupBy(*keys, "p", *by, bin_col).agg(F.count("*").alias("n"))
    sites = points.groupBy(*keys, *coords, *kind).agg(F.min(id_col).alias("site"), F.count("*").alias("_w"))
    pairs = both_ways(range_pairs(sites, cutoff, id_col="site", carry=["_w", *kind], crowd_limit=crowd_limit, **options), keys)
    apart = pairs.select(*keys, F.col("p").alias("site"), *by, bin_col, F.col("q__w").alias("n"))
    same = sites.where("_w > 1").select(*keys, "site", *[F.col(species).alias("species") for _ in kind], F.lit(0).alias("bin"),
                                        (F.col("_w") - 1).alias("n"))
    counts = apart.unionByName(same).groupBy(*keys, "site", *["species" for _ in kind], "bin").agg(F.sum("n").alias("n"))
    members = points.select(*keys, *coords, *kind, F.col(id_col).alias("p")).join(
        sites.select(*keys, *coords, *kind, "site"), [*keys, *coords, *kind])
    return (members.select(*keys, "p", "site").join(counts, [*keys, "site"])
            .select(*keys, "p", *["species" for _ in kind], "bin", "n"))


def excess_entropy(points: DataFrame, cutoff: float, nbins: int, density: float, *, averages: int = 1,
                   keys: Sequence[str] = ("frame",), id_col: str = "pid", **options) -> DataFrame:
    """Two-body excess entropy of each particle: -density/2 * sum over its bins of g ln g - g + 1.

    g is the count over ``averages`` * density * shell volume; a bin without neighbour contributes 1.
    """
    lower, upper = F.col("bin") * (cutoff / nbins), (F.col("bin") + 1) * (cutoff / nbins)
    shell = 4 / 3 * math.pi * (upper * upper * upper - lower * lower * lower)
    g = F.col("n") / (averages * density * shell)
    hist = particle_histogram(points, cutoff, nbins, keys=keys, id_col=id_col, **options)
    sums = hist.groupBy(*keys, "p").agg(F.sum(g * F.log(g) - g + 1).alias("_f"), F.count("*").alias("_filled"))
    empty = nbins - F.coalesce("_filled", F.lit(0))
    return (points.select(*keys, F.col(id_col).alias("p")).join(sums, [*keys, "p"], "left")
            .select(*keys, "p", (-density / 2 * (F.coalesce("_f", F.lit(0.0)) + empty)).alias("s2")))


def spatial_correlation(points: DataFrame, fields: Sequence[str], cutoff: float, nbins: int, *,
                        keys: Sequence[str] = ("frame",), centres: str | None = None, **options) -> DataFrame:
    """Sum of f_p * f_q, pair count and their ratio, per bin and field.

    ``centres`` names a flag: then ordered pairs (centre, any other particle) are counted.
    """
    if centres is not None:
        flagged = points.withColumn("_centre", F.col(centres).cast("int"))
        both = F.col("p__centre") + F.col("q__centre")
        hist = pair_aggregate(flagged, cutoff, [F.sum(both).alias("n")] + [
            F.sum(both * F.col(f"p_{f}") * F.col(f"q_{f}")).alias(f"sum_{f}") for f in fields],
            nbins=nbins, keys=keys, carry=["_centre", *fields], **options).where("n > 0")
        return hist.select(*keys, "bin", "n", *[F.col(f"sum_{f}") for f in fields],
                           *[(F.col(f"sum_{f}") / F.col("n")).alias(f"corr_{f}") for f in fields])
    hist = pair_histogram(points, cutoff, nbins, fields=fields, keys=keys, **options)
    return hist.select(*keys, "bin", "n", *[F.col(f"sum_{f}") for f in fields],
                       *[(F.col(f"sum_{f}") / F.col("n")).alias(f"corr_{f}") for f in fields])


def species_correlation(points: DataFrame, field: str, species: str, cutoff: float, nbins: int, *,
                        keys: Sequence[str] = ("frame",), **options) -> DataFrame:
    """Ordered pairs by (species of p, species of q, bin): n and sum of f_p * f_q."""
    pairs = both_ways(range_pairs(points, cutoff, keys=keys, carry=[species, field],
                                  block_factor=options.pop("block_factor", 1.0), **options), keys)
    return pairs.groupBy(*keys, F.col(f"p_{species}").alias("species_p"), F.col(f"q_{species}").alias("species_q"),
                         distance_bin(F.col("d2"), cutoff, nbins).alias("bin")).agg(
        F.count("*").alias("n"), F.sum(F.col(f"p_{field}") * F.col(f"q_{field}")).alias("s"))


def vector_correlation(points: DataFrame, vector: Sequence[str], cutoff: float, nbins: int, **options) -> DataFrame:
    """Mean dot product of a vector field per bin."""
    keys = options.get("keys", ("frame",))
    hist = pair_histogram(points, cutoff, nbins, fields=vector, **options)
    total = sum((F.col(f"sum_{v}") for v in vector[1:]), F.col(f"sum_{vector[0]}"))
    return hist.select(*keys, "bin", "n", (total / F.col("n")).alias("corr"))
