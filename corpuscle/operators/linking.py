"""Linking frames into trajectories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.geometry import AXES
from ..scratch import materialize, materialize_with
from .matching import greedy_match, match_nearest
from .spatial import frame_links


def dense_index(df: DataFrame, order: Sequence[str], name: str, per: Sequence[str] = ()) -> DataFrame:
    """Number rows 0, 1, 2... in the given order, without gathering them in one task.

    Rows are range-partitioned and numbered inside their partition; the partition sizes (a few hundred
    rows) give the offsets.  ``per`` restarts the numbers in every group.
    """
    spark = df.sparkSession
    width = 1 << 33          # layout of monotonically_increasing_id: partition number, then position
    ranged = (df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
              .withColumn("_place", F.monotonically_increasing_id()))
    placed = materialize(ranged.withColumn("_piece_no", F.floor(F.col("_place") / width))
                         .withColumn("_place", F.col("_place") % width), "ranged")
    by = list(per)
    first = placed.groupBy(*by, "_piece_no").agg(F.count("*").alias("_rows"), F.min("_place").alias("_first"))
    w = Window.partitionBy(*by).orderBy("_piece_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = first.withColumn("_shift", F.coalesce(F.sum("_rows").over(w), F.lit(0)) - F.col("_first"))
    return (placed.join(offsets.select(*by, "_piece_no", "_shift"), [*by, "_piece_no"])
            .withColumn(name, F.col("_place") + F.col("_shift")).drop("_place", "_piece_no", "_shift"))


def chains(positions: DataFrame, links: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Trajectories of one-to-one links: group, tr, frame, pid.

    ``links``: group, frame, from, to [, step], from ``frame`` to ``frame + step``.  Every position looks up
    its predecessor, then the predecessor of that one, doubling the distance each round.  Trajectories are
    numbered by first frame, then by the position id there.
    """
    group = list(group)
    step = F.col("step") if "step" in links.columns else F.lit(1)
    back = links.select(*group, (F.col("frame") + step).alias("frame"), F.col("to").alias("pid"),
                        F.col("frame").alias("_hf"), F.col("from").alias("_hp"))
    heads = (positions.select(*group, "frame", "pid").join(back, [*group, "frame", "pid"], "left")
             .select(*group, "frame", "pid", F.coalesce("_hf", "frame").alias("_hf"), F.coalesce("_hp", "pid").alias("_hp")))
    heads = materialize(heads, "heads")
    total = None
    while True:
        up = heads.select(*group, F.col("frame").alias("_hf"), F.col("pid").alias("_hp"),
                          F.col("_hf").alias("_uf"), F.col("_hp").alias("_up"))
        heads, seen = materialize_with(heads.join(up, [*group, "_hf", "_hp"]).select(
            *group, "frame", "pid", F.col("_uf").alias("_hf"), F.col("_up").alias("_hp")), "heads", total=F.sum("_hf"))
        if seen["total"] == total:
            break
        total = seen["total"]
    starts = heads.where("frame = _hf and pid = _hp").select(*group, "_hf", "_hp")
    numbered = dense_index(starts, [*group, "_hf", "_hp"], "tr", per=group)
    return heads.join(numbered, [*group, "_hf", "_hp"]).select(*group, "tr", "frame", "pid")


def match_frames(positions: DataFrame, maxdist: float, *, group: Sequence[str] = (), coords: Sequence[str] = AXES, gap: int = 1, r: str | None = None, **options) -> DataFrame:
    """Greedy one-to-one links from every frame to the one ``gap`` later: group, frame, from, to, cost.

    The links are those of ``greedy_match`` on the ``frame_links``; where the distance is all that counts, these are not listed.
    """
    keys = [*group, "frame"]
    if r is not None:
        return greedy_match(frame_links(positions, maxdist, group=group, coords=coords, gap=gap, r=r, **options), keys)
    return match_nearest(positions, maxdist, positions.withColumn("frame", F.col("frame") - gap), keys=keys, coords=coords, **options)


def link_frames(positions: DataFrame, maxdist: float, *, group: Sequence[str] = (), coords: Sequence[str] = AXES,
                **options) -> DataFrame:
    """Trajectories from the positions of successive frames: candidates in range, greedy match, chains."""
    return chains(positions, match_frames(positions, maxdist, group=group, coords=coords, **options), group)


def gap_links(positions: DataFrame, accepted: DataFrame, maxdist: float, *, group: Sequence[str] = (),
              coords: Sequence[str] = AXES, **options) -> DataFrame:
    """Second pass over ends and starts left alone: links from t to t + 2 (``frame``, from, to, cost)."""
    group = list(group)
    on = [*group, "frame", "pid"]
    has_next = accepted.select(*group, "frame", F.col("from").alias("pid"))
    has_prev = accepted.select(*group, (F.col("frame") + 1).alias("frame"), F.col("to").alias("pid"))
    ends = positions.join(has_next, on, "left_anti")
    starts = positions.join(has_prev, on, "left_anti").select(*on, *coords)
    later = starts.withColumn("frame", F.col("frame") - 2)
    return match_nearest(ends, maxdist, later, keys=[*group, "frame"], coords=coords, **options)


def link_with_gaps(positions: DataFrame, maxdist: float, *, group: Sequence[str] = (), coords: Sequence[str] = AXES,
                   **options) -> DataFrame:
    """Trajectories that survive one missing frame; the missing row has ``pid`` NULL."""
    group = list(group)
    accepted = materialize(match_frames(positions, maxdist, group=group, coords=coords, **options), "accepted")
    bridged = materialize(gap_links(positions, accepted, maxdist, group=group, coords=coords, **options), "bridged")
    links = accepted.withColumn("step", F.lit(1)).unionByName(bridged.withColumn("step", F.lit(2)))
    traj = materialize(chains(positions, links, group), "traj")
    ends = bridged.select(*group, "frame", F.col("from").alias("pid"))
    fill = (traj.join(ends, [*group, "frame", "pid"], "left_semi")
            .select(*group, "tr", (F.col("frame") + 1).alias("frame"), F.lit(None).cast("bigint").alias("pid")))
    return traj.unionByName(fill)
