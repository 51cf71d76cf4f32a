"""Projections, filters and selections on positions and trajectories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import AXES, box_encloses, minimg
from ..functions.scalars import attach


def scale(points: DataFrame, factor, coords: Sequence[str] = AXES, r: str | None = None) -> DataFrame:
    """Multiply by one number (radius included) or by one factor per axis (radius untouched)."""
    factors = list(factor) if isinstance(factor, Sequence) else [factor] * len(coords)
    changed = {c: F.col(c) * f for c, f in zip(coords, factors)}
    if r and not isinstance(factor, Sequence):
        changed[r] = F.col(r) * factor
    return points.withColumns(changed)


def translate(points: DataFrame, shift: Sequence[float], coords: Sequence[str] = AXES) -> DataFrame:
    return points.withColumns({c: F.col(c) + s for c, s in zip(coords, shift)})


def extent(points: DataFrame, keys: Sequence[str] = ("frame",), coords: Sequence[str] = AXES) -> DataFrame:
    """Bounding box and size of every group: keys, n, x0, x1, y0, y1, ..."""
    aggs = [F.count("*").alias("n")]
    for c in coords:
        aggs += [F.min(c).alias(f"{c}0"), F.max(c).alias(f"{c}1")]
    return points.groupBy(*keys).agg(*aggs)


def max_box(points: DataFrame, keys: Sequence[str] = ("frame",), coords: Sequence[str] = AXES) -> DataFrame:
    """Box from the origin to the largest upper edge over all frames."""
    return points.agg(*[F.max(c).alias(f"{c}1") for c in coords])


def min_dim(points: DataFrame, keys: Sequence[str] = ("frame",), coords: Sequence[str] = AXES) -> DataFrame:
    sides = [F.col(f"{c}1") - F.col(f"{c}0") for c in coords]
    return extent(points, keys, coords).select(*keys, F.least(*sides).alias("min_dim"))


def mark_inside(points: DataFrame, margin: float, *, keys: Sequence[str] = ("frame",),
                coords: Sequence[str] = AXES, no_z: bool = False, always_shrink: bool = False,
                name: str = "inside", box: DataFrame | None = None) -> DataFrame:
    """Flag of points at least ``margin`` away from the faces of their group's box (inclusive).

    An axis whose extent is not larger than twice the margin is not shrunk, unless ``always_shrink``.
    ``box`` is the result of ``extent`` if it is at hand.
    """
    box = extent(points, keys, coords) if box is None else box
    joined = points.join(box.drop("n"), list(keys))
    cond = F.lit(True)
    for i, c in enumerate(coords):
        lo, hi = F.col(f"{c}0"), F.col(f"{c}1")
        if no_z and i == 2:
            m = F.lit(0.0)
        elif always_shrink:
            m = F.lit(float(margin))
        else:
            m = F.when(hi - lo > 2 * margin, F.lit(float(margin))).otherwise(0.0)
        cond = cond & (F.col(c) >= lo + m) & (F.col(c) <= hi - m)
    return joined.withColumn(name, cond).select(*points.columns, name)


def select_inside(points: DataFrame, margin: float, periods=None, **options) -> DataFrame:
    """Points inside the margins; a fully periodic box has no outside."""
    if periods is not None:
        return points
    return mark_inside(points, margin, name="_in", **options).where("_in").drop("_in")


def select_box(points: DataFrame, lows: Sequence[float], highs: Sequence[float], *,
               coords: Sequence[str] = AXES, periods=None) -> DataFrame:
    """Points in a box, faces included; in a periodic box the images of the query box count too."""
    if periods is None:
        return points.where(box_encloses((lows, highs), coords))
    cond = F.lit(True)
    for c, lo, hi, period in zip(coords, lows, highs, periods):
        half, centre = (hi - lo) / 2, (hi + lo) / 2
        cond = cond & (F.abs(minimg(F.col(c) - centre, period)) <= half)
    return points.where(cond)


def spans(traj: DataFrame, keys: Sequence[str] = ("tr",)) -> DataFrame:
    """Summary of trajectories: tr, t_start, t_last, n."""
    return traj.groupBy(*keys).agg(F.min("frame").alias("t_start"), F.max("frame").alias("t_last"),
                                   F.count("*").alias("n"))


def spanning(traj: DataFrame, t0: int, t1: int, keys: Sequence[str] = ("tr",)) -> DataFrame:
    """Trajectories that exist from t0 to t1."""
    return spans(traj, keys).where((F.col("t_start") <= t0) & (F.col("t_last") >= t1)).select(*keys)


def spanning_tracks(tracks: DataFrame, t0: int, t1: int, keys: Sequence[str] = ("tr",)) -> DataFrame:
    """Rows in [t0, t1] of the trajectories that exist from t0 to t1."""
    return (tracks.where(F.col("frame").between(t0, t1))
            .join(spanning(tracks, t0, t1, keys), list(keys), "left_semi"))


def always_enclosed(tracks: DataFrame, t0: int, t1: int, lows, highs, *, keys: Sequence[str] = ("tr",),
                    coords: Sequence[str] = AXES) -> DataFrame:
    """Trajectories spanning [t0, t1] and inside the box at every frame of it."""
    window = F.col("frame").between(t0, t1)
    return (tracks.groupBy(*keys)
            .agg(F.min("frame").alias("t_start"), F.max("frame").alias("t_last"),
                 F.bool_and(~window | box_encloses((lows, highs), coords)).alias("_in"))
            .where((F.col("t_start") <= t0) & (F.col("t_last") >= t1) & F.col("_in")).select(*keys))


def blank_outside(points: DataFrame, inside: DataFrame, fields: Sequence[str],
                  on: Sequence[str] = ("frame", "pid")) -> DataFrame:
    """NULL the fields of the rows that are not in ``inside``."""
    marked = points.join(inside.select(*on).distinct().withColumn("_in", F.lit(True)), list(on), "left")
    return marked.withColumns({f: F.when(F.col("_in"), F.col(f)) for f in fields}).drop("_in")


def z_slab(tracks: DataFrame, bottom: float, top: float, how: str = "all", *, axis: str = "z",
           keys: Sequence[str] = ("tr",)) -> DataFrame:
    """Trajectories whose ``axis`` lies in [bottom, top] at ``any`` or at ``all`` of their frames."""
    inside = F.col(axis).between(bottom, top)
    test = F.bool_or(inside) if how == "any" else F.bool_and(inside)
    return tracks.groupBy(*keys).agg(test.alias("_in")).where("_in").select(*keys)


def roi_trajectories(tracks: DataFrame, t0: int, t1: int, bottom: float, top: float, *, inside: str = "inside",
                     axis: str = "z", keys: Sequence[str] = ("tr",)) -> DataFrame:
    """Trajectories spanning [t0, t1], always flagged inside, whose z range meets [bottom, top]."""
    window = F.col("frame").between(t0, t1)
    return (tracks.groupBy(*keys)
            .agg(F.min("frame").alias("t_start"), F.max("frame").alias("t_last"),
                 F.bool_and(~window | F.col(inside)).alias("_in"),
                 F.min(F.when(window, F.col(axis))).alias("_lo"), F.max(F.when(window, F.col(axis))).alias("_hi"))
            .where((F.col("t_start") <= t0) & (F.col("t_last") >= t1) & F.col("_in")
                   & (F.col("_lo") <= top) & (F.col("_hi") >= bottom)).select(*keys))


def exclude_zero(tracks: DataFrame, field: str, keys: Sequence[str] = ("tr",)) -> DataFrame:
    """Drop trajectories whose field is missing (0 or NULL) at any frame."""
    return tracks.join(tracks.where(F.coalesce(F.col(field), F.lit(0.0)) == 0).select(*keys), list(keys), "left_anti")


def structure_class(q6: Column, w4: Column) -> Column:
    """Label of a particle from its coarse-grained order parameters (cut-offs 0.25 and 0.35)."""
    return (F.when(q6 < 0.25, "liquid").when(q6 <= 0.35, "mrco")
            .when(w4 < 0, "fcc").otherwise("hcp"))


def intervals(tracks: DataFrame, step: int, average: int = 1) -> DataFrame:
    """Intervals of ``average`` frames, one every ``step``, within the frames of the tracks: t0, t1."""
    reach = tracks.agg(F.min("frame").alias("_a"), F.max("frame").alias("_b"))
    return (reach.select(F.explode(F.sequence("_a", "_b", F.lit(step))).alias("t0"), "_b")
            .withColumn("t1", F.col("t0") + (average - 1)).where("t1 <= _b").select("t0", "t1"))


def spanning_per_interval(tracks: DataFrame, step: int, average: int, keys: Sequence[str] = ("tr",)) -> DataFrame:
    """Trajectories that span each interval: every trajectory lists its own, nothing is compared pairwise."""
    grid = intervals(tracks, step, average)
    first = grid.agg(F.min("t0").alias("_a"))
    inner = (attach(spans(tracks, keys), first)
             .withColumn("_s", F.col("_a") + F.ceil((F.col("t_start") - F.col("_a")) / step) * step)
             .where(F.col("_s") + (average - 1) <= F.col("t_last"))
             .withColumn("t0", F.explode(F.sequence("_s", F.col("t_last").cast("bigint") - (average - 1), F.lit(step).cast("bigint")))))
    counts = inner.groupBy(F.col("t0").cast("int").alias("t0")).agg(F.count("*").alias("n"))
    return grid.join(counts, "t0", "left").na.fill(0, ["n"])


def to_tracks(positions: DataFrame, traj: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Positions with their trajectory id."""
    return positions.join(traj, [*keys, "frame", "pid"])


def by_trajectory(field: DataFrame, traj: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Re-key a per-position field (frame, pid, ...) by trajectory (tr, frame, ...)."""
    return field.join(traj, [*keys, "frame", "pid"]).drop("pid")


def by_position(field: DataFrame, traj: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return field.join(traj, [*keys, "frame", "tr"]).drop("tr")


def validate_frames(points: DataFrame, id_col: str = "pid", keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Rows, distinct ids and whether ids are unique, per frame; distinct ids first so a hot frame is spread."""
    per_id = points.groupBy(*keys, id_col).agg(F.count("*").alias("_k"))
    return per_id.groupBy(*keys).agg(F.sum("_k").alias("n"), F.count("*").alias("n_ids"),
                                     (F.max("_k") == 1).alias("ok"))


def contiguous(rows: DataFrame, keys: Sequence[str], frame: str = "frame", block: int = 4096) -> DataFrame:
    """Split every series at its missing frames: adds ``t_start``, the first frame of the unbroken piece.

    Rows meet their predecessor by an equi-join, then each block of frames is scanned apart and the block
    results are chained, so a long series is never held by one task.
    """
    keys = list(keys)
    prev = rows.select(*keys, (F.col(frame) + 1).alias(frame), F.lit(True).alias("_follows"))
    marked = (rows.join(prev, [*keys, frame], "left")
              .withColumn("_new", F.when(F.col("_follows").isNull(), F.col(frame))).drop("_follows")
              .withColumn("_blk", F.floor(F.col(frame) / block)))
    tail = marked.groupBy(*keys, "_blk").agg(F.max("_new").alias("_last"))
    w_blocks = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    entry = tail.withColumn("_entry", F.max("_last").over(w_blocks)).drop("_last")
    w = Window.partitionBy(*keys, "_blk").orderBy(frame).rowsBetween(Window.unboundedPreceding, 0)
    return (marked.join(entry, [*keys, "_blk"])
            .withColumn("t_start", F.coalesce(F.max("_new").over(w), F.col("_entry")))
            .drop("_new", "_entry", "_blk"))
