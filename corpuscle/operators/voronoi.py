"""Voronoi cells: volumes, faces, neighbours, and their coarse graining.

A cell is the set of points on the inner side of all planes half way to a neighbour and of the walls of its frame; an edge of
it is what all other planes leave of the line in which two of them meet.  Faces and volumes are sums over edges.  A task holds
a block of particles and what is around them; a cell starts from the walls and the nearest few, and takes in whichever plane cuts
off a corner until none does.  A cell whose farthest corner is at rho is complete once all particles within 2 rho are known, so
unfinished ones go on with a wider range.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..scratch import materialize, materialize_with
from .select import extent
from .spatial import crowded_blocks, neighbourhoods
from ..functions.geometry import AXES

PLENTY = 1_000      # particles in a block of the first range, beyond which the range is halved
PARALLEL = 1e-12    # cosine below which a line is parallel to a plane
NEAR = 1e-9         # relative distance at which a line lies in a plane
TURNS = 50          # after which planes are only added
WALLS = np.array([[sign * (i == axis) for i in range(3)] for axis in range(3) for sign in (-1.0, 1.0)])


@lru_cache(maxsize=256)
def _two_of(n: int):
    return np.triu_indices(n, 1)


def _edges(q: np.ndarray, normals: np.ndarray, h: np.ndarray):
    """Edges of the cell around the origin bounded by planes (rising numbers q, unit normals, distances h >= 0): a, b (planes), two corners, area given to the faces of a and b.

    Where several planes pass through one edge (lattices), the edge counts for each face once: for those planes that bound the face from the same side,
    under the lowest q.
    """
    a, b = _two_of(len(q))
    cosines = normals @ normals.T
    g = cosines[a, b]
    s2 = 1 - g * g
    apart = s2 > PARALLEL
    a, b, g, s2 = a[apart], b[apart], g[apart], s2[apart]
    s, ha, hb = np.sqrt(s2), h[a], h[b]
    at = ((ha - g * hb) / s2)[:, None] * normals[a] + ((hb - g * ha) / s2)[:, None] * normals[b]
    na, nb = normals[a], normals[b]
    line = np.stack([na[:, 1] * nb[:, 2] - na[:, 2] * nb[:, 1], na[:, 2] * nb[:, 0] - na[:, 0] * nb[:, 2], na[:, 0] * nb[:, 1] - na[:, 1] * nb[:, 0]], 1) / s[:, None]
    slope, gap = line @ normals.T, h[None, :] - at @ normals.T
    rows = np.arange(len(a))
    slope[rows, a] = slope[rows, b] = 0.0
    gap[rows, a] = gap[rows, b] = np.inf
    flat, close = np.abs(slope) <= PARALLEL, NEAR * (ha[:, None] + hb[:, None] + h[None, :])
    with np.errstate(divide="ignore", invalid="ignore"):
        where = gap / slope
    low = np.where(slope < -PARALLEL, where, -np.inf).max(1)
    high = np.where(slope > PARALLEL, where, np.inf).min(1)
    kept = ~(flat & (gap < -close)).any(1) & (high >= low) & np.isfinite(low) & np.isfinite(high)
    a, b, g, s, ha, hb, at, line, low, high = (v[kept] for v in (a, b, g, s, ha, hb, at, line, low, high))
    # a third plane through the line bounds face a from the side of b if its normal has a part along that of b within a
    same, c = (flat & (np.abs(gap) <= close))[kept], np.arange(len(q))[None, :]
    again_a = (same & (c < b[:, None]) & (cosines[b] - g[:, None] * cosines[a] > 0)).any(1)
    again_b = (same & (c < a[:, None]) & (cosines[a] - g[:, None] * cosines[b] > 0)).any(1)
    half = 0.5 * (high - low) / s
    return (a, b, at + low[:, None] * line, at + high[:, None] * line,
            np.where(again_a, 0.0, half * (hb - g * ha)), np.where(again_b, 0.0, half * (ha - g * hb)))


def cell(walls: np.ndarray, q: np.ndarray, steps: np.ndarray, first: int):
    """Cell around the origin between walls at six distances and other particles q at ``steps``: volume, reach, numbers and areas of its faces."""
    d = np.sqrt((steps * steps).sum(1))
    number, normals, h = np.concatenate([np.arange(-1, -7, -1), q]), np.concatenate([WALLS, steps / d[:, None]]), np.concatenate([walls, d / 2])
    taken = np.concatenate([np.arange(6), 6 + (np.argpartition(d, first)[:first] if first < len(d) else np.arange(len(d)))])
    for turn in count():
        taken = taken[np.argsort(number[taken])]
        a, b, one, two, area_a, area_b = _edges(number[taken], normals[taken], h[taken])
        if not len(a):
            return 0.0, 0.0, number[:0], d[:0]
        corners = np.concatenate([one, two])
        reach2 = (corners * corners).sum(1)
        reach = np.sqrt(reach2.max())
        near = 6 + np.flatnonzero(d <= 2 * reach * (1 + NEAR))
        gap = h[near][:, None] - normals[near] @ corners.T
        gap[gap >= -NEAR * (h[near][:, None] + reach)] = 0.0
        gap[np.isin(near, taken)] = 0.0
        if not (gap < 0).any():
            break
        worst = gap.argmin(0)
        more = near[np.unique(worst[gap[worst, np.arange(len(worst))] < 0])]
        # planes without an edge are of no use any more, unless rounding brings them back for ever
        taken = np.concatenate([taken[np.unique(np.concatenate([a, b]))] if turn < TURNS else taken, more])
    n = len(taken)
    area = np.bincount(a, area_a, n) + np.bincount(b, area_b, n)
    far = np.zeros(n)
    longest = reach2.reshape(2, -1).max(0)
    np.maximum.at(far, a, longest)
    np.maximum.at(far, b, longest)
    seen = area > NEAR * far
    return (h[taken] * area).sum() / 3, reach, number[taken][seen], area[seen]


def voronoi(points: DataFrame, radius: float, *, keys: Sequence[str] = ("frame",), id_col: str = "pid", margin: float = 0.0,
            nearest: int = 14, rounds: int = 16) -> DataFrame:
    """keys, p, volume, faces ARRAY<STRUCT<q, area>>; negative q are walls of the frame's box plus ``margin``.

    ``radius`` is the range of the first round, about twice the size of a cell, and less where particles crowd; cells start
    with the ``nearest`` particles.  Coincident particles share a cell: its volume is divided among them, and the face
    neighbours name the one of lowest id.
    """
    keys = list(keys)
    sites = materialize(points.groupBy(*keys, *AXES).agg(F.min(id_col).alias("p"), F.count("*").alias("_w")), "sites")
    walls = [f"_{c}{end}" for c in AXES for end in (0, 1)]
    box = extent(points, keys).drop("n")
    distances = [((F.col(c) - F.col(f"{c}0")) if end == 0 else (F.col(f"{c}1") - F.col(c))) + margin for c in AXES for end in (0, 1)]
    placed = materialize(sites.join(box, keys).select(*keys, "p", *AXES, *[v.alias(w) for v, w in zip(distances, walls)]), "placed")

    def work(ids, places, others, there):
        made = []
        for i in range(len(ids)):
            apart = others != ids[i]
            made.append(cell(places[i, 3:], others[apart].astype(np.int64), there[apart, :3] - places[i, :3], nearest))
        offsets = np.concatenate([[0], np.cumsum([len(c[2]) for c in made])]).astype(np.int32)
        faces = pa.StructArray.from_arrays([pa.array(np.concatenate([c[k] for c in made])) for k in (2, 3)], names=["q", "area"])
        return {"p": ids, "volume": np.array([c[0] for c in made]), "reach": np.array([c[1] for c in made]), "faces": pa.ListArray.from_arrays(pa.array(offsets), faces)}

    columns = f"p {sites.schema['p'].dataType.simpleString()}, volume double, reach double, faces array<struct<q: bigint, area: double>>"
    while radius > 0 and rounds > 4 and crowded_blocks(placed, radius, keys, AXES, PLENTY)[1]:
        radius, rounds = radius / 2, rounds - 1
    done, todo = [], placed
    for _ in range(rounds):
        cells = neighbourhoods(todo, radius, work, columns, keys=keys, id_col="p", carry=walls, around=placed)
        finished = F.col("reach") * 2 <= F.lit(float(radius))
        cells, seen = materialize_with(cells, "cells", open=F.count_if(~finished), reach=F.max("reach"))
        done.append(cells if not seen["open"] else cells.where(finished))
        if not seen["open"]:
            break
        todo = materialize(placed.join(cells.where(~finished).select(*keys, "p"), [*keys, "p"], "left_semi"), "open")
        radius = min(4 * radius, 2 * seen["reach"] * (1 + NEAR))
    else:
        raise RuntimeError("cells are still open after the last round; start with a larger radius")
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    members = points.select(*keys, *AXES, F.col(id_col).alias("_id")).join(sites.withColumnRenamed("p", "_site"), [*keys, *AXES])
    return (members.join(result.withColumnRenamed("p", "_site"), [*keys, "_site"])
            .select(*keys, F.col("_id").alias("p"), (F.col("volume") / F.col("_w")).alias("volume"), "faces"))


def voronoi_edges(cells: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Neighbours that share a face: keys, p, q, area."""
    return cells.select(*keys, "p", F.explode("faces").alias("f")).select(*keys, "p", "f.q", "f.area").where("q >= 0")


def wall_cells(cells: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Particles whose cell touches a wall."""
    return cells.where(F.exists("faces", lambda f: f["q"] < 0)).select(*keys, "p")


def coarse_grained_volume(cells: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Mean volume of the cells away from the walls among the particle and its neighbours.

    Particles that see none take the mean of what their neighbours got, ring after ring.
    """
    keys = list(keys)
    edges = materialize(voronoi_edges(cells, keys).select(*keys, "p", "q"), "edges")
    inner = cells.where(~F.exists("faces", lambda f: f["q"] < 0)).select(*keys, "p", "volume")
    seen = (edges.join(inner.withColumnRenamed("p", "q"), [*keys, "q"]).select(*keys, "p", "volume")
            .union(inner)).groupBy(*keys, "p").agg(F.avg("volume").alias("volume"))
    known = materialize(seen, "volumes")
    while True:
        open_ = cells.select(*keys, "p").join(known, [*keys, "p"], "left_anti")
        more = (edges.join(open_, [*keys, "p"], "left_semi").join(known.withColumnRenamed("p", "q"), [*keys, "q"])
                .groupBy(*keys, "p").agg(F.avg("volume").alias("volume")))
        more, count = materialize_with(more.select(*keys, "p", "volume"), "volumes")
        if not count["rows"]:
            return known
        known = known.unionByName(more)
