"""What becomes of the bonds between trajectories, without listing the bonds on the way.

The bonds of a frame grow with the square of the trajectories, so they are never shuffled.  Trajectories are dealt into groups, whose rows travel packed (a few
megabytes each), and a task holds two groups with all their frames: it sees the whole course of every pair with a trajectory in each.  What is shuffled is one
packed group for every group; rows leave a task only as results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.geometry import AXES
from ..scratch import materialize
from .graph import connected_components
from .shared import Bonds, component_arcs
from .spatial import neighbourhoods

ROWS = 131_072      # rows of trajectories in one group
LEAST = 4_096       # rows of a group that is made only to have something to do for every core
CELLS = 1 << 16     # pairs of rows looked at at a time, few enough to stay in a cache
DENSE = 1 << 23     # entries of a table of (trajectory, frame)
EDGE = 1 + 1e-9     # what is this much further than a range is out of it, whatever the rounding
NONE = -(1 << 63)   # a mark that is missing
DTYPES = {"int": np.int32, "bigint": np.int64, "long": np.int64}


class Rows:
    """Rows of some trajectories in the order of (trajectory, frame)."""

    def __init__(self, ids, frames, places, marks):
        order = np.lexsort((frames, ids))
        self.ids, self.frames, self.places, self.marks = ids[order], frames[order], places[order], marks[order]
        self.names, self.starts, self.track = np.unique(self.ids, return_index=True, return_inverse=True)
        self.sound = ~np.isnan(self.places).any(1)
        self.first, self.span = int(self.frames.min()), int(self.frames.max()) - int(self.frames.min()) + 1
        self.codes = self.track * self.span + (self.frames - self.first)
        self.table = None
        if len(self.names) * self.span <= DENSE:
            self.table = np.full(len(self.names) * self.span, -1, np.int32)
            self.table[self.codes] = np.arange(len(self.codes))

    def at(self, tracks: np.ndarray, frames: np.ndarray) -> np.ndarray:
        """The row of each trajectory in a frame, -1 where it has none."""
        there = (tracks >= 0) & (frames >= self.first) & (frames < self.first + self.span)
        wanted = np.where(there, tracks * self.span + (frames - self.first), 0)
        if self.table is not None:
            return np.where(there, self.table[wanted], -1)
        row = np.minimum(np.searchsorted(self.codes, wanted), len(self.codes) - 1)
        return np.where(there & (self.codes[row] == wanted), row, -1)

    def shifted(self, lag: int) -> np.ndarray:
        """For every row, that of the same trajectory ``lag`` frames later."""
        return self.at(self.track, self.frames + lag)

    def known(self, ids: np.ndarray) -> np.ndarray:
        """Numbers of the trajectories among these, -1 for others."""
        at = np.minimum(np.searchsorted(self.names, ids), len(self.names) - 1)
        return np.where(self.names[at] == ids, at, -1)


class Meeting:
    """Two groups of trajectories, or one group with itself."""

    def __init__(self, one: Rows, two: Rows, radius: float, groups: tuple[int, int] = (0, 0)):
        self.one, self.two, self.radius, self.same, self.groups = one, two, radius, one is two, groups

    def squares(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Squared distances between rows of the one and rows of the other; NaN where a row is missing (-1)."""
        with np.errstate(invalid="ignore", over="ignore"):
            d2 = 0.0
            for k in range(self.one.places.shape[1]):
                step = self.two.places[j, k] - self.one.places[i, k]
                d2 = d2 + step * step
        return np.where((i < 0) | (j < 0), np.nan, d2)

    def bonded(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.squares(i, j) < self.radius * self.radius

    def bonds(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of the one and of the other that are bonded, i rising; those of a trajectory of the one come together."""
        one, two, reach = self.one, self.two, self.radius * EDGE
        usable = np.flatnonzero(two.sound)
        if not len(usable):
            return
        axis = int(np.argmax(np.ptp(two.places[usable], axis=0)))            # the more it spreads, the fewer are in reach
        order = usable[np.lexsort((two.places[usable, axis], two.frames[usable]))]
        frames, value = two.frames[order], two.places[order, axis]
        columns = [np.ascontiguousarray(two.places[order, k]) for k in range(two.places.shape[1])]
        mine = [np.ascontiguousarray(one.places[:, k]) for k in range(one.places.shape[1])]
        low, high = np.zeros(len(one.ids), np.int64), np.zeros(len(one.ids), np.int64)
        with np.errstate(invalid="ignore", over="ignore"):
            by_frame = np.argsort(one.frames, kind="stable")
            found, cuts = np.unique(one.frames[by_frame], return_index=True)
            for frame, some in zip(found, np.split(by_frame, cuts[1:])):
                s, e = np.searchsorted(frames, frame, "left"), np.searchsorted(frames, frame, "right")
                low[some] = s + np.searchsorted(value[s:e], mine[axis][some] - reach, "left")
                high[some] = s + np.searchsorted(value[s:e], mine[axis][some] + reach, "right")
            n = np.where(one.sound, np.maximum(high - low, 0), 0)
            total = np.cumsum(np.add.reduceat(n, one.starts))
            ends, start = np.append(one.starts[1:], len(n)), 0
            while start < len(total):                                        # whole trajectories, as many as fit
                done = total[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(total, done + CELLS, "right")))
                rows = slice(one.starts[start], ends[stop - 1])
                count, start = n[rows], stop
                i = np.repeat(np.arange(rows.start, rows.stop), count)
                at = np.arange(len(i)) + np.repeat(low[rows] - (np.cumsum(count) - count), count)
                d2 = 0.0
                for own, others in zip(mine, columns):
                    step = others[at] - own[i]
                    d2 = d2 + step * step
                near = np.flatnonzero(d2 < self.radius * self.radius)
                i, j = i[near], order[at[near]]
                if self.same:
                    once = one.track[i] < two.track[j]
                    i, j = i[once], j[once]
                if len(i):
                    yield i, j

    def courses(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The bonded rows in the order of (pair, frame), and whether a pair begins."""
        for i, j in self.bonds():
            pair = self.one.track[i] * len(self.two.names) + self.two.track[j]
            order = np.argsort(pair, kind="stable")
            pair = pair[order]
            yield i[order], j[order], np.concatenate([[True], pair[1:] != pair[:-1]])

    def ends(self, i: np.ndarray, j: np.ndarray) -> dict[str, np.ndarray]:
        a, b = self.one.ids[i], self.two.ids[j]
        return {"low": np.minimum(a, b), "high": np.maximum(a, b)}


@dataclass
class Packed:
    """Trajectories by groups: ``groups`` holds _g and its rows as bytes."""

    groups: DataFrame
    n: int
    coords: int
    id_kind: str
    frame_kind: str


def _group(column, n: int):
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def pack(tracks: DataFrame, id_col: str = "tr", coords: Sequence[str] = AXES, mark: str | None = None) -> Packed:
    """Deal trajectories (``id_col``, frame, coords) into groups; ``mark`` names a whole number that goes with each row (``NONE`` for NULL).  Rows without a trajectory are left out."""
    types = {f.name: f.dataType.simpleString() for f in tracks.schema.fields}
    cores = tracks.sparkSession.sparkContext.defaultParallelism
    rows = tracks.count()
    n = max(-(-rows // ROWS), min(isqrt(8 * cores), -(-rows // LEAST)), 1)
    flat = tracks.where(F.col(id_col).isNotNull()).select(
        _group(F.col(id_col).cast("long"), n).alias("_g"), F.col(id_col).cast("long").alias("_id"), F.col("frame").cast("long").alias("_frame"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"_x{k}") for k, c in enumerate(coords)],
        (F.coalesce(F.col(mark).cast("long"), F.lit(NONE)) if mark else F.lit(NONE)).alias("_mark"))
    width = len(coords)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        order = np.lexsort((rows["_frame"].to_numpy(), rows["_id"].to_numpy()))
        made = [rows["_id"].to_numpy()[order], rows["_frame"].to_numpy()[order], np.concatenate([rows[f"_x{k}"].to_numpy()[order] for k in range(width)]), rows["_mark"].to_numpy()[order]]
        yield pa.RecordBatch.from_arrays([rows["_g"].combine_chunks()[:1], *[pa.array([m.tobytes()], pa.binary()) for m in made]], names=["_g", "ids", "frames", "places", "marks"])

    packed = flat.repartition(max(n, cores), "_g").groupBy("_g").applyInArrow(run, "_g int, ids binary, frames binary, places binary, marks binary")
    return Packed(materialize(packed, "packed"), n, width, types[id_col], types["frame"])


def _unpack(row: dict, width: int) -> Rows:
    ids, frames, places, marks = (np.frombuffer(row[c], t) for c, t in (("ids", np.int64), ("frames", np.int64), ("places", np.float64), ("marks", np.int64)))
    return Rows(ids, frames, places.reshape(width, -1).T, marks)


def meet(packed: Packed, radius: float, work: Callable, columns: Sequence[str], extra: DataFrame | None = None) -> DataFrame:
    """What ``work`` makes of every two groups (a ``Meeting``): tables of ``columns`` ("name type" each).

    ``extra`` (frame, low, high): what is known of pairs; ``work`` gets, as arrays, those of its pairs as well.
    """
    n, width, telling = packed.n, packed.coords, extra is not None
    other = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_o")
    dealt = packed.groups.select("*", other).select(F.least("_g", "_o").alias("_a"), F.greatest("_g", "_o").alias("_b"), "*").drop("_o")
    if extra is not None:
        at = [_group(F.col(c).cast("long"), n) for c in ("low", "high")]
        known = extra.select(F.least(*at).alias("_a"), F.greatest(*at).alias("_b"), *[F.col(c).cast("long").alias(f"_{c}") for c in ("frame", "low", "high")])
        dealt = dealt.unionByName(known, allowMissingColumns=True)
    kinds = dict(c.split() for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, more, key = {}, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = key or (batch["_a"][0].as_py(), batch["_b"][0].as_py())
            for k in np.flatnonzero(batch["ids"].is_valid().to_numpy(zero_copy_only=False)):
                groups[batch["_g"][int(k)].as_py()] = _unpack({c: batch[c][int(k)].as_py() for c in ("ids", "frames", "places", "marks")}, width)
            if telling:
                told = batch.filter(batch["ids"].is_null())
                more.append([told[f"_{c}"].to_numpy(zero_copy_only=False) for c in ("frame", "low", "high")])
        if key is None or not (key[0] in groups and key[1] in groups):
            return
        meeting = Meeting(groups[key[0]], groups[key[1]], radius, key)
        told = [[np.concatenate(part).astype(np.int64) for part in zip(*more)]] if telling else []
        for table in work(meeting, *told):
            yield pa.RecordBatch.from_arrays([pa.array(table[c] if kind not in DTYPES else np.asarray(table[c], DTYPES[kind]), pa.binary() if kind == "binary" else None)
                                              for c, kind in kinds.items()], names=list(kinds))

    spark = packed.groups.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * (n + 1))
    return dealt.repartition(parts, "_a", "_b").groupBy("_a", "_b").applyInArrow(run, ", ".join(columns))


def _listed(packed: Packed, *more: str) -> list[str]:
    return [f"low {packed.id_kind}", f"high {packed.id_kind}", *more]


def bond_life(packed: Packed, radius: float) -> DataFrame:
    """First and last frame in which each bond is seen, and in how many: low, high, first, last, n."""
    def work(met: Meeting):
        for i, j, new in met.courses():
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(new)) - 1
            yield {**met.ends(i[first], j[first]), "first": met.one.frames[i[first]], "last": met.one.frames[i[last]], "n": last - first + 1}

    return meet(packed, radius, work, _listed(packed, f"first {packed.frame_kind}", f"last {packed.frame_kind}", "n bigint"))


def expired_bonds(packed: Packed, radius: float, persistence: int) -> DataFrame:
    """Episodes of a bond: it expires once unseen for more than ``persistence`` frames. low, high, first, last."""
    def work(met: Meeting):
        for i, j, new in met.courses():
            frame = met.one.frames[i]
            first = np.flatnonzero(new | (np.diff(frame, prepend=frame[0]) > max(persistence, 1)))
            last = np.append(first[1:], len(new)) - 1
            yield {**met.ends(i[first], j[first]), "first": frame[first], "last": frame[last]}

    return meet(packed, radius, work, _listed(packed, f"first {packed.frame_kind}", f"last {packed.frame_kind}"))


def broken_bonds(packed: Packed, radius: float, lag: int = 1) -> DataFrame:
    """Bonds of frame t gone at t + lag although both trajectories still exist: frame (= t), low, high."""
    def work(met: Meeting):
        a, b = met.one.shifted(lag), met.two.shifted(lag)
        for i, j in met.bonds():
            gone = np.flatnonzero((a[i] >= 0) & (b[j] >= 0) & ~met.bonded(a[i], b[j]))
            if len(gone):
                yield {"frame": met.one.frames[i[gone]], **met.ends(i[gone], j[gone])}

    return meet(packed, radius, work, [f"frame {packed.frame_kind}", *_listed(packed)])


def tally(packed: Packed, radius: float, work: Callable, finish: Callable, columns: Sequence[str]) -> DataFrame:
    """Numbers counted for each row over all pairs: ``work`` makes of a ``Meeting`` the counts for the rows of the one and of the other (as many arrays each), which are
    summed and given to ``finish`` with the rows; it returns which rows are wanted and the arrays of ``columns``.  Result: frame, p, columns.
    """
    def counts(met: Meeting):
        sides = work(met)
        if met.same:
            sides = [[a + b for a, b in zip(*sides)]]
        yield {"_g": list(met.groups)[:len(sides)], "_n": [np.concatenate(side).astype(np.int32).tobytes() for side in sides]}

    schema, width = [f"frame {packed.frame_kind}", f"p {packed.id_kind}", *columns], packed.coords
    types = dict(c.split() for c in schema)
    parts = meet(packed, radius, counts, ["_g int", "_n binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["_n"] is None:
                    rows = _unpack(row, width)
                else:
                    total = total + np.frombuffer(row["_n"], np.int32).astype(np.int64)
        wanted, found = finish(rows, np.split(total, len(total) // len(rows.ids)))
        made = {"frame": rows.frames, "p": rows.ids, **found}
        for start in range(0, len(wanted), CELLS):
            some = wanted[start:start + CELLS]
            yield pa.RecordBatch.from_arrays([pa.array(np.ma.getdata(v)[some].astype(DTYPES[types[c]]), mask=np.ma.getmaskarray(v)[some]) for c, v in made.items()], names=list(made))

    both = packed.groups.unionByName(parts, allowMissingColumns=True)
    return both.repartition(max(packed.n, packed.groups.sparkSession.sparkContext.defaultParallelism), "_g").groupBy("_g").applyInArrow(run, ", ".join(schema))


def _add(total: np.ndarray, rows: np.ndarray) -> None:
    np.add.at(total, rows, 1)


def neighbour_changes(packed: Packed, radius: float, lag: int = 1) -> DataFrame:
    """Neighbours lost and gained by each trajectory between t and t + lag: frame, p, lost, gained; NULL where it ends before."""
    def work(met: Meeting):
        later, before = [[side.shifted(k) for side in (met.one, met.two)] for k in (lag, -lag)]
        sides = [[np.zeros(len(side.ids), np.int64) for _ in range(2)] for side in (met.one, met.two)]
        for i, j in met.bonds():
            for kind, (a, b) in enumerate((later, before)):
                a, b = a[i], b[j]
                apart = ~met.bonded(a, b)
                for (total, there, at) in ((sides[0][kind], a, i), (sides[1][kind], b, j)):
                    _add(total, (there if kind else at)[apart & (there >= 0)])
        return sides

    def finish(rows: Rows, totals):
        ends = rows.shifted(lag) < 0
        return np.arange(len(rows.ids)), {name: np.ma.array(n, mask=ends) for name, n in zip(("lost", "gained"), totals)}

    return tally(packed, radius, work, finish, ["lost bigint", "gained bigint"])


def lost_since(tracks: DataFrame, radius: float, reference: int) -> DataFrame:
    """For every later frame: how many of the neighbours at the reference frame are no longer neighbours: frame, p, lost."""
    there = tracks.where(F.col("frame") == reference).select("tr").distinct()
    packed = pack(tracks.where(F.col("frame") >= reference).join(there, "tr", "left_semi"))       # nothing else can be a neighbour then

    def start(rows: Rows):
        return np.where(rows.frames >= reference, rows.at(rows.track, np.full(len(rows.ids), reference)), -1)

    def work(met: Meeting):
        a, b = start(met.one), start(met.two)
        kept = [np.zeros(len(side.ids), np.int64) for side in (met.one, met.two)]
        for i, j in met.bonds():
            still = met.bonded(a[i], b[j])
            _add(kept[0], i[still])
            _add(kept[1], j[still])
        return [[kept[0]], [kept[1]]]

    def finish(rows: Rows, totals):
        at = start(rows)
        return np.flatnonzero(at >= 0), {"lost": totals[0][at] - totals[0]}

    return tally(packed, radius, work, finish, ["lost bigint"])


def degrees(packed: Packed, radius: float) -> DataFrame:
    """Bonds of every row: frame, p, n."""
    def work(met: Meeting):
        n = [np.zeros(len(side.ids), np.int64) for side in (met.one, met.two)]
        for i, j in met.bonds():
            _add(n[0], i)
            _add(n[1], j)
        return [[n[0]], [n[1]]]

    return tally(packed, radius, work, lambda rows, totals: (np.arange(len(rows.ids)), {"n": totals[0]}), ["n bigint"])


def neighbouring_bonds(tracks: DataFrame, radius: float, chosen: str) -> DataFrame:
    """Bonds that share exactly one end with another bond both of whose ends are ``chosen`` (a condition): frame, low, high.

    The chosen bonds are counted by their ends first; a bond is one if an end has a chosen bond besides it.
    """
    held = degrees(pack(tracks.where(chosen)), radius).withColumnRenamed("p", "tr")
    marked = tracks.join(held, ["frame", "tr"], "left").withColumn("_held", F.coalesce("n", F.lit(0)) * 2 + F.coalesce(F.expr(chosen), F.lit(False)).cast("int"))
    packed = pack(marked, mark="_held")

    def work(met: Meeting):
        for i, j in met.bonds():
            a, b = met.one.marks[i], met.two.marks[j]
            near = np.flatnonzero(np.maximum(a >> 1, b >> 1) > (a & b & 1))
            if len(near):
                yield {"frame": met.one.frames[i[near]], **met.ends(i[near], j[near])}

    return meet(packed, radius, work, [f"frame {packed.frame_kind}", *_listed(packed)])


def unshared(points: DataFrame, radius: float, id_col: str = "tr", before: Sequence[str] = ()) -> DataFrame:
    """Pairs that are not bonded but near enough for it and share no neighbour: frame, low, high.  ``before`` names earlier places; only pairs that were bonded there are looked at."""
    kind = points.schema[id_col].dataType.simpleString()

    def work(ids, places, others, there):
        near = Bonds(ids, places[:, :3], others, there[:, :3], radius)
        order = np.argsort(others)
        were = there[order[np.searchsorted(others, near.ids, sorter=order)], 3:]
        for some in near.pieces(near.core):
            d2 = near.squares(some)
            a, b = np.nonzero((d2 >= radius * radius) & (d2 < 4 * radius * radius * EDGE) & (near.ids[some][:, None] < near.ids[None, :]))
            a = some[a]
            if len(before):
                d2 = 0.0
                for k in range(len(before)):
                    step = were[b, k] - were[a, k]
                    d2 = d2 + step * step
                bonded = d2 < radius * radius
                a, b = a[bonded], b[bonded]
            free = ~near.any_shared(a, b)
            if free.any():
                yield {"low": near.ids[a[free]], "high": near.ids[b[free]]}

    return neighbourhoods(points, 2 * radius, work, f"low {kind}, high {kind}", id_col=id_col, carry=before, core=1024)


def _never(tracks: DataFrame, radius: float, closer: bool) -> DataFrame:
    placed = tracks.where("tr IS NOT NULL").select("tr", "frame", *AXES)
    labels = connected_components(component_arcs(placed, radius, id_col="tr")).withColumnRenamed("p", "tr")
    packed = pack(placed.join(labels, ["frame", "tr"], "left"), mark="cluster")
    if closer:
        free = unshared(placed, radius)
    else:
        last = placed.select("tr", (F.col("frame") + 1).alias("frame"), *[F.col(c).alias(f"_{c}") for c in AXES])
        free = unshared(placed.join(last, ["tr", "frame"], "left"), radius, before=[f"_{c}" for c in AXES])

    def work(met: Meeting, told):
        one, two, far = met.one, met.two, 4 * radius * radius * EDGE
        frame, low, high = told
        swapped = one.known(low) < 0
        mine, theirs = one.known(np.where(swapped, high, low)), two.known(np.where(swapped, low, high))
        row = one.at(mine, frame)
        known = np.sort(row * len(two.names) + theirs)          # a row of the one is a trajectory and a frame

        def close(i, j):
            """Bonded or with a neighbour in common."""
            near = met.squares(i, j) < far
            if len(known):
                code = i[near] * len(two.names) + two.track[j[near]]
                at = np.minimum(np.searchsorted(known, code), len(known) - 1)
                near[near] = known[at] != code
            return near

        after, then = one.shifted(1), two.shifted(1)
        for i, j, new in met.courses():
            last = np.append(np.flatnonzero(new)[1:], len(new)) - 1
            i, j = after[i[last]], then[j[last]]
            kept = (i >= 0) & (j >= 0)
            i, j = i[kept], j[kept]
            kept = (one.marks[i] == two.marks[j]) & (one.marks[i] != NONE)
            i, j = i[kept], j[kept]
            apart = ~close(i, j)
            i, j = i[apart], j[apart]
            if closer:
                stay, watch, at = np.ones(len(i), bool), np.arange(len(i)), i
                while len(watch):
                    at = at + 1
                    on = (at < len(one.ids)) & (one.track[np.minimum(at, len(one.ids) - 1)] == one.track[i[watch]])
                    watch, at = watch[on], at[on]
                    there = two.at(two.track[j[watch]], one.frames[at])
                    met_again = close(at, there)
                    stay[watch[met_again]] = False
                    watch, at = watch[~met_again], at[~met_again]
                i, j = i[stay], j[stay]
            if len(i):
                yield {**met.ends(i, j), "frame": one.frames[i]}

    return meet(packed, radius, work, _listed(packed, f"frame {packed.frame_kind}"), extra=free)


def never_reform(tracks: DataFrame, radius: float) -> DataFrame:
    """Bonds that do not come back after a break that left their ends linked, but by more than two bonds: low, high, frame of the break.

    A bond is not seen after its last frame, so only the frame behind that is looked at.  Ends further apart than twice the range share no neighbour; of nearer ones
    those that share none are found block by block and told to the pair of groups.
    """
    return _never(tracks, radius, False)


def never_closer(tracks: DataFrame, radius: float) -> DataFrame:
    """Like ``never_reform``, and the ends never come within two bonds of each other again."""
    return _never(tracks, radius, True)
