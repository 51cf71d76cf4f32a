"""What pairs of particles share, block by block: common neighbours, rings, paths.

A task holds some points and all that may matter to them (``spatial.neighbourhoods``); neighbours are rows of bits, and what
two particles share is the AND of two rows.  Neither bonds nor triangles are listed or shuffled, only the points are.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.geometry import AXES
from ..scratch import materialize_with
from . import graph
from .spatial import in_range, neighbour_edges, neighbourhoods

CORE = 1024         # points of one task
CELLS = 1 << 21     # pairs looked at, and words or values held, at a time


class Bonds:
    """Bonds among the points of one task as rows of bits; the points are mixed, so a part of the bits is a sample of all places."""

    def __init__(self, ids, places, others, there, radius: float):
        mixed = np.random.default_rng(0).permutation(len(others))
        self.ids, self.places, self.radius = others[mixed], there[mixed], radius
        sort = np.argsort(self.ids)
        self.core = sort[np.searchsorted(self.ids, ids, sorter=sort)]
        self.bits = np.zeros((len(others), -(-len(others) // 64)), np.uint64)
        self.bytes = self.bits.view(np.uint8)
        for some in self.pieces(np.arange(len(others))):
            near = np.packbits(in_range(self.ids[some], self.places[some], self.ids, self.places, radius), axis=1)
            self.bytes[some, :near.shape[1]] = near

    def pieces(self, rows: np.ndarray):
        step = max(1, CELLS // max(1, len(self.ids)))
        return (rows[i:i + step] for i in range(0, len(rows), step))

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a and b are bonded."""
        return (self.bytes[a, b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1

    def members(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The set bits of rows: row, column."""
        return np.nonzero(np.unpackbits(np.ascontiguousarray(rows).view(np.uint8), axis=1)[:, :len(self.ids)])

    def squares(self, some: np.ndarray) -> np.ndarray:
        """Squared distances from some points to all."""
        steps = [self.places[None, :, i] - self.places[some, i][:, None] for i in range(3)]
        return steps[0] * steps[0] + steps[1] * steps[1] + steps[2] * steps[2]

    def pairs(self, some: np.ndarray, bonded: bool, ordered: bool):
        """Pairs of some points with others that are bonded, or not but near enough to share a neighbour; ``ordered``: by rising id."""
        near = np.unpackbits(self.bytes[some], axis=1)[:, :len(self.ids)].view(bool)
        if not bonded:
            near = (self.squares(some) < 4 * self.radius * self.radius * (1 + 1e-9)) & ~near & (self.ids[some][:, None] != self.ids[None, :])
        if ordered:
            near = near & (self.ids[some][:, None] < self.ids[None, :])
        a, b = np.nonzero(near)
        return some[a], b

    def sharing(self, a: np.ndarray, b: np.ndarray, size: int):
        """Those of the pairs that share exactly ``size`` neighbours.  Most share far more, which the first bits show."""
        n, start, width = np.zeros(len(a), np.int64), 0, 4
        alive = np.arange(len(a))
        while start < self.bits.shape[1] and len(alive):
            words = slice(start, start + width)
            step = max(1, CELLS // width)
            for i in range(0, len(alive), step):
                part = alive[i:i + step]
                n[part] += np.bitwise_count(self.bits[a[part], words] & self.bits[b[part], words]).sum(1, dtype=np.int64)
            alive = alive[n[alive] <= size]
            start, width = start + width, 2 * width
        alive = alive[n[alive] == size]
        return a[alive], b[alive]

    def any_shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the two of each pair share a neighbour.  Most do among the first bits."""
        hit, alive, start, width = np.zeros(len(a), bool), np.arange(len(a)), 0, 4
        while start < self.bits.shape[1] and len(alive):
            words, step = slice(start, start + width), max(1, CELLS // width)
            for i in range(0, len(alive), step):
                part = alive[i:i + step]
                hit[part] = (self.bits[a[part], words] & self.bits[b[part], words]).any(1)
            alive = alive[~hit[alive]]
            start, width = start + width, 2 * width
        return hit

    def rings(self, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        """Whether the ``size`` common neighbours of each pair form a ring (each bonded to two of the others)."""
        ring, step = np.zeros(len(a), bool), max(1, CELLS // max(1, len(self.ids)))
        for i in range(0, len(a), step):
            some = slice(i, i + step)
            c = self.members(self.bits[a[some]] & self.bits[b[some]])[1].reshape(-1, size)
            ring[some] = (self.has(c[:, :, None], c[:, None, :]).sum(2) == 2).all(1)
        return ring


def _kind(points: DataFrame, id_col: str) -> str:
    return points.schema[id_col].dataType.simpleString()


def ring_pairs(points: DataFrame, radius: float, size: int, *, bonded: bool, ring: bool = True, keys: Sequence[str] = ("frame",), id_col: str = "pid") -> DataFrame:
    """Pairs that share exactly ``size`` neighbours within ``radius``, which form a ring: keys, low, high.  ``bonded``: pairs that are neighbours themselves, or that are not."""
    def work(ids, places, others, there):
        near = Bonds(ids, places, others, there, radius)
        for some in near.pieces(near.core):
            a, b = near.sharing(*near.pairs(some, bonded, True), size)
            if ring:
                closed = near.rings(a, b, size)
                a, b = a[closed], b[closed]
            if len(a):
                yield {"low": near.ids[a], "high": near.ids[b]}

    kind = _kind(points, id_col)
    return neighbourhoods(points, radius if bonded else 2 * radius, work, f"low {kind}, high {kind}", keys=keys, id_col=id_col, core=CORE)


def sp5c(points: DataFrame, radius: float, **options) -> DataFrame:
    """Bonded pairs with five common neighbours, no ring test."""
    return ring_pairs(points, radius, 5, bonded=True, ring=False, **options)


def pairs_1551(points: DataFrame, radius: float, **options) -> DataFrame:
    """Bonded pairs whose five common neighbours form a ring."""
    return ring_pairs(points, radius, 5, bonded=True, **options)


def pairs_2331(points: DataFrame, radius: float, **options) -> DataFrame:
    """Non-bonded second-shell pairs whose three common neighbours form a ring."""
    return ring_pairs(points, radius, 3, bonded=False, **options)


def common_of_bonds(points: DataFrame, radius: float, *, keys: Sequence[str] = ("frame",), id_col: str = "pid") -> DataFrame:
    """Common neighbours of bonded pairs: keys, low, high, c.  They leave a task as one list for each bond."""
    def work(ids, places, others, there):
        near = Bonds(ids, places, others, there, radius)
        waiting, held = [], 0

        def table():
            low, high, n, c = (np.concatenate(part) for part in zip(*waiting))
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            return {"low": low, "high": high, "c": pa.ListArray.from_arrays(pa.array(offsets), pa.array(c))}

        for i in near.core:
            around = near.members(near.bits[i:i + 1])[1]
            mates = around[near.ids[around] > near.ids[i]]
            step = max(1, CELLS // max(1, len(around)))
            for start in range(0, len(mates), step):
                some = mates[start:start + step]
                a, b = np.nonzero(near.has(some[:, None], around[None, :]))
                waiting.append((np.full(len(some), near.ids[i]), near.ids[some], np.bincount(a, minlength=len(some)), near.ids[around[b]]))
                held += len(b)
                if held > CELLS:
                    yield table()
                    waiting, held = [], 0
        if waiting:
            yield table()

    kind = _kind(points, id_col)
    lists = neighbourhoods(points, radius, work, f"low {kind}, high {kind}, c array<{kind}>", keys=keys, id_col=id_col, core=CORE)
    return lists.select(*keys, "low", "high", F.explode("c").alias("c"))


def second_shell(points: DataFrame, radius: float, *, keys: Sequence[str] = ("frame",), id_col: str = "pid") -> DataFrame:
    """Pairs two bonds apart, bonded ones included: keys, low, high."""
    def work(ids, places, others, there):
        near = Bonds(ids, places, others, there, radius)
        for some in near.pieces(near.core):
            a, b = np.nonzero((near.squares(some) < 4 * radius * radius * (1 + 1e-9)) & (near.ids[some][:, None] < near.ids[None, :]))
            met = near.any_shared(some[a], b)
            if met.any():
                yield {"low": near.ids[some[a[met]]], "high": near.ids[b[met]]}

    kind = _kind(points, id_col)
    once = points.na.drop(subset=[*keys, id_col]).dropDuplicates([*keys, id_col, *AXES])
    return neighbourhoods(once, 2 * radius, work, f"low {kind}, high {kind}", keys=keys, id_col=id_col, core=CORE)


LEVELS = 1 << 15    # cells of a cosine; a cell without a border of a bin in or next to it needs no angle


def bond_angles(points: DataFrame, radius: float, nbins: int = 180, *, keys: Sequence[str] = ("frame",), id_col: str = "pid") -> DataFrame:
    """Angles between the bonds of each particle, in equal bins of [0, 180] degrees: keys, bin, n.  Bonds without a length have no angle.

    Cosines are products of small matrices, counted by cells; only those in a cell with a border of a bin are worked out as angles.
    """
    keys = list(keys)

    def binned(cosine):
        return np.minimum(np.floor(np.degrees(np.arccos(np.clip(cosine, -1.0, 1.0))) * (nbins / 180)).astype(np.int64), nbins - 1)

    def exact(steps, squares, a, b):
        """Bins of pairs of bonds; ``nbins`` where the product of their lengths is lost in rounding."""
        dot = steps[a, 0] * steps[b, 0] + steps[a, 1] * steps[b, 1] + steps[a, 2] * steps[b, 2]
        scale = np.sqrt(squares[a] * squares[b])
        lost = scale == 0
        return np.where(lost, nbins, binned(dot / np.where(lost, 1.0, scale)))

    def work(ids, places, others, there):
        borders = np.cos(np.arange(nbins + 1) * (np.pi / nbins))
        cell = lambda c: np.clip((c + 1) * (LEVELS / 2), 0, LEVELS - 1).astype(np.int64)
        unsure = np.zeros(LEVELS + 1, bool)
        for off in (-2e-6, 0.0, 2e-6):
            unsure[cell(borders + off)] = True
        of_cell = binned((np.arange(LEVELS) + 0.5) * (2 / LEVELS) - 1)
        cells, n = np.zeros(LEVELS + 1, np.int64), np.zeros(nbins + 1, np.int64)
        step = max(1, CELLS // max(1, len(others)))
        for start in range(0, len(ids), step):
            some = slice(start, start + step)
            for i, near in zip(range(start, start + step), in_range(ids[some], places[some], others, there, radius)):
                steps = there[near] - places[i]
                squares = steps[:, 0] * steps[:, 0] + steps[:, 1] * steps[:, 1] + steps[:, 2] * steps[:, 2]
                steps, squares = steps[squares > 0], squares[squares > 0]
                if len(steps) < 2:
                    continue
                small, part = squares.min() < 1e-140, max(1, min(128, CELLS // len(steps)))
                unit = (steps / np.sqrt(squares)[:, None]).astype(np.float32)
                for at in range(0, len(steps), part):
                    rows = np.arange(at, min(at + part, len(steps)))                        # each with those behind it
                    if small:
                        a, b = np.nonzero(rows[:, None] < np.arange(at, len(steps))[None, :])
                    else:
                        level = ((unit[rows] @ unit[at:].T + np.float32(1)) * np.float32(LEVELS / 2)).astype(np.int32)
                        np.clip(level, 0, LEVELS - 1, out=level)
                        level[:, :len(rows)][np.tril_indices(len(rows))] = LEVELS
                        cells += np.bincount(level.ravel(), minlength=LEVELS + 1)
                        a, b = np.nonzero(unsure[level])
                    n += np.bincount(exact(steps, squares, at + a, at + b), minlength=nbins + 1)
        cells[unsure] = 0
        n[:nbins] += np.bincount(of_cell, cells[:LEVELS], nbins).astype(np.int64)
        seen = np.flatnonzero(n)
        return {"bin": pa.array(seen.astype(np.int32), mask=seen == nbins), "n": n[seen]}

    repeated, seen = materialize_with(points.groupBy(*keys, id_col).agg(F.count("*").alias("_k")).where("_k > 1").select(*keys).distinct(), "repeated")
    single = points.join(repeated, keys, "left_anti") if seen["rows"] else points
    found = neighbourhoods(single, radius, work, "bin int, n long", keys=keys, id_col=id_col, core=CORE).groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    if not seen["rows"]:
        return found
    # where an id stands for several points, the bonds of all of them meet under it
    return found.unionByName(graph.bond_angles(neighbour_edges(points.join(repeated, keys, "left_semi"), radius, keys=keys, id_col=id_col), keys, nbins))


def topology(points: DataFrame, radius: float, *, keys: Sequence[str] = ("frame",), id_col: str = "pid") -> DataFrame:
    """Neighbours, spindles and ring pairs of every particle: keys, p, n, sp5c, n1551, n2331."""
    keys, names = list(keys), ["n", "sp5c", "n1551", "n2331"]

    def work(ids, places, others, there):
        near = Bonds(ids, places, others, there, radius)
        at = np.full(len(near.ids), -1)
        at[near.core] = np.arange(len(near.core))
        count = {name: np.zeros(len(near.core), np.int64) for name in names[1:]}
        for some in near.pieces(near.core):
            five = near.sharing(*near.pairs(some, True, False), 5)
            three = near.sharing(*near.pairs(some, False, False), 3)
            found = {"sp5c": five[0], "n1551": five[0][near.rings(*five, 5)], "n2331": three[0][near.rings(*three, 3)]}
            for name, a in found.items():
                np.add.at(count[name], at[a], 1)
        return {"p": near.ids[near.core], "n": np.bitwise_count(near.bits[near.core]).sum(1, dtype=np.int64), **count}

    found = neighbourhoods(points, 2 * radius, work, f"p {_kind(points, id_col)}, " + ", ".join(f"{name} long" for name in names), keys=keys, id_col=id_col, core=CORE)
    return points.select(*keys, F.col(id_col).alias("p")).join(found, [*keys, "p"], "left").na.fill(0, names)


def path_lengths(points: DataFrame, radius: float, widest: float, max_length: int, *, keys: Sequence[str] = ("frame",), id_col: str = "pid") -> DataFrame:
    """Pairs at a distance of ``radius`` or more but below ``widest``, and the bonds on the shortest path between them: keys, low, high, length (NULL beyond ``max_length``).

    Balls of half the length around both ends are rows of bits, built where no shorter path was found.
    """
    reach = max(widest, *[min(h * radius, widest + (max_length - h) * radius) for h in range(max_length + 1)])

    def work(ids, places, others, there):
        near = Bonds(ids, places, others, there, radius)
        balls, known = [near.bits], [np.ones(len(near.ids), bool)]

        def ball(hops: int, rows: np.ndarray) -> np.ndarray:
            """Rows of bits of what is within so many bonds, all of ``rows`` worked out."""
            while len(balls) < hops:
                balls.append(np.zeros_like(near.bits))
                known.append(np.zeros(len(near.ids), bool))
            todo = np.unique(rows[~known[hops - 1][rows]])
            if len(todo):
                inner = ball(hops - 1, todo)
                for i in todo:
                    balls[hops - 1][i] = np.bitwise_or.reduce(near.bits[near.members(inner[i:i + 1])[1]], axis=0) | inner[i]
                known[hops - 1][todo] = True
            return balls[hops - 1]

        def meet(one, two, a, b):
            """Whether the rows share a bit; most do among the first."""
            hit, alive, start, width = np.zeros(len(a), bool), np.arange(len(a)), 0, 4
            while start < near.bits.shape[1] and len(alive):
                words, step = slice(start, start + width), max(1, CELLS // width)
                for i in range(0, len(alive), step):
                    part = alive[i:i + step]
                    hit[part] = (one[a[part], words] & two[b[part], words]).any(1)
                alive = alive[~hit[alive]]
                start, width = start + width, 2 * width
            return hit

        for some in near.pieces(near.core):
            d2 = near.squares(some)
            a, b = np.nonzero((d2 >= radius * radius) & (d2 < widest * widest) & (near.ids[some][:, None] < near.ids[None, :]))
            a, length = some[a], np.zeros(len(a), np.int32)
            for total in range(2, max_length + 1):
                left = np.flatnonzero(length == 0)
                hit = meet(ball((total + 1) // 2, a[left]), ball(total // 2, b[left]), a[left], b[left])
                length[left[hit]] = total
            if len(a):
                yield {"low": near.ids[a], "high": near.ids[b], "length": pa.array(length, mask=length == 0)}

    kind = _kind(points, id_col)
    return neighbourhoods(points, reach, work, f"low {kind}, high {kind}, length int", keys=keys, id_col=id_col, core=CORE)


def component_arcs(points: DataFrame, radius: float, *, fields: Sequence[str] = (), levels: Sequence[float] = (), keys: Sequence[str] = ("frame",), id_col: str = "pid") -> DataFrame:
    """Arcs with the components of the bonds shorter than ``radius``: keys, p, q (the lowest id of the same part of a block).

    A task joins up what its bonds connect, so it leaves a row for each particle instead of one for each bond.  With ``levels`` of a field, components of the
    particles above each, and the level as column ``threshold``.
    """
    def parts(ids, places, others, there):
        """Bonds from ids to others: node ids and the lowest id of their part."""
        nodes = np.union1d(ids, others)
        label = np.arange(len(nodes))
        rows, columns = np.searchsorted(nodes, ids), np.searchsorted(nodes, others)
        step = max(1, CELLS // max(1, len(others)))
        near = [np.packbits(in_range(ids[i:i + step], places[i:i + step], others, there, radius), axis=1) for i in range(0, len(ids), step)]
        while True:
            before = label.copy()
            for k, some in enumerate(near):
                mine, bonded = rows[k * step:(k + 1) * step], np.unpackbits(some, axis=1)[:, :len(others)].view(bool)
                for row, bonds in zip(mine, bonded):
                    met = columns[bonds]
                    if len(met):
                        least = min(label[row], label[met].min())
                        label[label[row]] = label[row] = least
                        label[label[met]] = least
                        label[met] = least
            while True:                 # labels of labels
                deeper = label[label]
                if (deeper == label).all():
                    break
                label = deeper
            if (label == before).all():
                break
        linked = label != np.arange(len(nodes))
        return nodes[linked], nodes[label[linked]]

    def work(ids, places, others, there):
        if not levels:
            p, q = parts(ids, places, others, there)
            return {"p": p, "q": q}
        return (dict(zip(("threshold", "p", "q"), (np.full(len(p), float(level)), p, q))) for level in levels
                for p, q in [parts(ids[places[:, 3] > level], places[places[:, 3] > level, :3], others[there[:, 3] > level], there[there[:, 3] > level, :3])])

    kind = _kind(points, id_col)
    points = points.withColumns({c: F.when(F.isnan(c), F.lit(float("inf"))).otherwise(F.col(c)) for c in fields})      # above all levels, as for Spark; NULL is above none
    return neighbourhoods(points, radius, work, f"{'threshold double, ' if levels else ''}p {kind}, q {kind}", keys=keys, id_col=id_col, carry=fields, core=CORE)



def dilate(points: DataFrame, radius: float, value: str, *, keys: Sequence[str] = ("frame",), id_col: str = "pid") -> DataFrame:
    """Value of largest magnitude (of equal ones the positive) among the particle and its neighbours: keys, p, ``value``."""
    keys = list(keys)

    def work(ids, places, others, there):
        order = np.lexsort((there[:, 3], np.abs(there[:, 3]), there[:, 4]))[::-1]         # NaN is the largest, as for Spark, NULL the least
        others, there = others[order], there[order]
        best, step = np.zeros(len(ids), np.int64), max(1, CELLS // max(1, len(others)))
        for i in range(0, len(ids), step):
            some = slice(i, i + step)
            best[some] = (in_range(ids[some], places[some, :3], others, there[:, :3], radius) | (ids[some][:, None] == others[None, :])).argmax(1)
        return {"p": ids, "_v": pa.array(there[best, 3], mask=there[best, 4] == 0), "_placed": np.ones(len(ids), bool)}

    marked = points.select(*keys, id_col, *AXES, F.col(value).alias("_f"), F.col(value).isNotNull().cast("double").alias("_known"))
    found = neighbourhoods(marked, radius, work, f"p {_kind(points, id_col)}, _v double, _placed boolean", keys=keys, id_col=id_col, carry=["_f", "_known"], core=CORE)
    return (points.select(*keys, F.col(id_col).alias("p"), value).join(found, [*keys, "p"], "left")
            .select(*keys, "p", F.when(F.col("_placed"), F.col("_v")).otherwise(F.col(value)).alias(value)))
