"""Greedy one-to-one matching and greedy thinning: group by group or block by block in tasks of bounded size, in rounds where a group is larger."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.geometry import AXES
from ..scratch import materialize, materialize_with
from .spatial import crowded_blocks, range_pairs


GROUP_LIMIT = 100_000       # links or conflicts of one group that a task settles by itself
BLOCK_LIMIT = 100_000       # points of one block that a task thins by itself
STEP_LIMIT = 1_000_000      # links of one group and one range that a task settles by itself
PLENTY = 16                 # points of one block beyond which a matching of the nearest starts with a smaller range


def _split(rows: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows of groups of at most ``limit`` rows, and those of larger ones; None where there are none."""
    sizes = rows.groupBy(*keys).count()
    seen = sizes.agg(F.count_if(F.col("count") <= limit).alias("small"), F.count_if(F.col("count") > limit).alias("large")).first()
    if not seen["large"]:
        return rows, None
    if not seen["small"]:
        return None, rows
    large = sizes.where(F.col("count") > limit).select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(large, same, "left_anti"), rows.join(large, same, "left_semi")


def _settle(nodes: DataFrame, keys: list[str], trace: list | None) -> DataFrame:
    """Which of the nodes are taken: keys, node, taken.  ``nodes``: keys, node, up; without ``up`` a node is taken, else it is taken if ``up`` is not.

    Pointers double: after k rounds a node knows the one 2**k above.  Nodes below one that is not in the table stay undecided and are left out.
    """
    table = materialize(nodes.select(*keys, "node", "up", F.when(F.col("up").isNull(), True).alias("taken"), F.lit(True).alias("flip")), "pointers")
    while True:
        above = table.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("node").alias("_node"), F.col("up").alias("_up"), F.col("taken").alias("_taken"), F.col("flip").alias("_flip"))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("up") == F.col("_node")]
        open_ = F.col("taken").isNull()
        step = table.join(above, same, "left").where(~open_ | F.col("_node").isNotNull()).select(
            *keys, "node", F.when(open_ & F.col("_taken").isNull(), F.col("_up")).alias("up"),
            F.when(open_, F.col("_taken") != F.col("flip")).otherwise(F.col("taken")).alias("taken"), F.when(open_, F.col("flip") != F.col("_flip")).otherwise(F.col("flip")).alias("flip"))
        table, seen = materialize_with(step, "pointers", open=F.count_if(F.col("taken").isNull()))
        if trace is not None:
            trace.append("pointers")
        if not seen["open"]:
            return table.select(*keys, "node", "taken")


def _match_in_task(links: DataFrame, keys: list[str]) -> DataFrame:
    """Greedy matching of groups that fit into a task."""
    def run(table: pa.Table) -> pa.Table:
        cost, ends = table.column("cost").to_numpy(), [np.unique(table.column(c).to_numpy(), return_inverse=True)[1] for c in ("from", "to")]
        used = [bytearray(int(e.max()) + 1) for e in ends]
        taken = []
        order = np.lexsort((ends[1], ends[0], cost))
        for i, a, b in zip(order.tolist(), ends[0][order].tolist(), ends[1][order].tolist()):
            if not used[0][a] and not used[1][b]:
                used[0][a] = used[1][b] = 1
                taken.append(i)
        return table.take(pa.array(taken, pa.int64()))

    return links.groupBy(*keys).applyInArrow(run, links.schema)


def greedy_match(links: DataFrame, keys: Sequence[str] = ("frame",), *, limit: int = GROUP_LIMIT, trace: list | None = None) -> DataFrame:
    """Accept links by growing (cost, from, to) unless an end is already taken.

    ``links``: keys, from, to, cost.  Groups of at most ``limit`` links are settled in one task each.  Larger ones go by rounds over all groups together: a link that is the best of both its ends is
    accepted; one that has a single better rival is accepted if that rival is not, and chains of these are settled by doubling pointers, in as many joins as the logarithm of
    their length; links of used ends go, and the rest is repeated.  ``trace`` gathers the names of the rounds.
    """
    keys = list(keys)
    small, rest = _split(materialize(links.select(*keys, "from", "to", "cost"), "links"), keys, limit)
    accepted = None if small is None else _match_in_task(small, keys)
    link = F.struct("from", "to")
    while rest is not None:
        by = [Window.partitionBy(*keys, end).orderBy("cost", "from", "to") for end in ("from", "to")]
        ranked = rest.select("*", link.alias("node"), *[F.row_number().over(w).alias(f"_r{i}") for i, w in enumerate(by)], *[F.lag(link).over(w).alias(f"_p{i}") for i, w in enumerate(by)])
        nodes, seen = materialize_with(ranked.where("_r0 + _r1 <= 3").select(*keys, "node", F.coalesce("_p0", "_p1").alias("up"), "cost"), "ranked", chained=F.count("up"))
        if trace is not None:
            trace.append("round")
        taken = nodes.where("up IS NULL").select(*keys, "node.*", "cost")
        if seen["chained"]:
            won = _settle(nodes, keys, trace).where("taken").select(*keys, "node")
            taken = materialize(nodes.join(won, [*keys, "node"], "left_semi").select(*keys, "node.*", "cost"), "taken")
        accepted = taken if accepted is None else accepted.unionByName(taken)
        left = (rest.join(taken.select(*keys, "from"), [*keys, "from"], "left_anti").join(taken.select(*keys, "to"), [*keys, "to"], "left_anti"))
        rest, seen = materialize_with(left, "links")
        if not seen["rows"]:
            return accepted
    return accepted


def match_nearest(left: DataFrame, maxdist: float, right: DataFrame, *, keys: Sequence[str] = ("frame",), id_col: str = "pid", coords: Sequence[str] = AXES,
                  limit: int = STEP_LIMIT, levels: int = 10, trace: list | None = None, **options) -> DataFrame:
    """``greedy_match`` of all pairs of ``left`` and ``right`` closer than ``maxdist``, at the cost of their squared distance: keys, from, to, cost.

    Longer links never decide about shorter ones, so where points are dense the matching starts with a small range; what is left is matched within
    that times the root of two, and so on.  The result is the same; a step lists a few links for each point that is left, so links grow with the points, not with their square.
    """
    keys, coords = list(keys), list(coords)
    shrink, dense = 0, crowded_blocks(right, 2 * maxdist, keys, coords, PLENTY)[1]
    while dense and shrink < levels:
        shrink += 1
        dense = crowded_blocks(right, 2 * maxdist / 2 ** shrink, keys, coords, PLENTY)[1]
    left, right = [df.select(*keys, id_col, *coords) for df in (left, right)]
    accepted = []
    for level in range(2 * shrink, -1, -1):
        pairs = range_pairs(left, maxdist / 2 ** (level / 2), right, keys=keys, id_col=id_col, coords=coords, **options)
        found = greedy_match(pairs.select(*keys, F.col("p").alias("from"), F.col("q").alias("to"), F.col("d2").alias("cost")), keys, limit=limit, trace=trace)
        if trace is not None:
            trace.append("range")
        if shrink:
            found = materialize(found, "found")
        accepted.append(found)
        if level:
            done = [found.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(end).alias("_id")) for end in ("from", "to")]
            left, right = [materialize(df.join(gone, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col(id_col) == F.col("_id")], "left_anti"), "unmatched")
                           for df, gone in zip((left, right), done)]
    return reduce(DataFrame.unionByName, accepted)


def _thin_crowds(todo: DataFrame, separation: float, keys, id_col, coords) -> tuple[DataFrame, DataFrame]:
    """One round of thinning in which a cell, however crowded, enters the distance join with one row: points kept, points left undecided.

    Cells are so small that all points of one exclude each other (diagonal < separation) and offer their best undecided point.
    It is kept if nothing undecided and better is in range; then everything in range of the kept ones goes.
    """
    # a hair below the exact bound keeps the diagonal strictly shorter than the separation
    side = separation / len(coords) ** 0.5 * (1 - 1e-9)
    cells = [f"_t{c}" for c in coords]
    celled = todo.withColumns({t: F.floor(F.col(c) / side) for t, c in zip(cells, coords)})
    best = celled.groupBy(*keys, *cells).agg(F.min_by(F.struct(*todo.columns), "_rank").alias("_s")).select("_s.*")
    rivals = range_pairs(best, separation, todo, keys=keys, id_col=id_col, coords=coords, carry=["_rank"]).where(F.col("q__rank") < F.col("p__rank"))
    winners = materialize(best.join(rivals.select(*keys, F.col("p").alias(id_col)), [*keys, id_col], "left_anti"), "kept")
    close = range_pairs(winners, separation, todo, keys=keys, id_col=id_col, coords=coords)
    gone = close.select(*keys, F.col("q").alias(id_col)).unionByName(winners.select(*keys, id_col))
    return winners, materialize(todo.join(gone, [*keys, id_col], "left_anti"), "thin")


def _block_side(points: DataFrame, separation: float, keys, coords, limit: int) -> tuple[float, int]:
    """Side of blocks with at most ``limit`` points each, or the smallest that pays, and the largest number of points in one."""
    extent = F.greatest(*[F.max(c) - F.min(c) for c in coords], F.lit(0.0))
    seen = points.groupBy(*keys).agg(extent.alias("e"), F.count("*").alias("n")).agg(F.max("e").alias("e"), F.max("n").alias("n")).first()
    if seen["n"] is None or seen["n"] <= limit:
        return float("inf"), seen["n"] or 0
    side = seen["e"] or separation
    while True:
        side = max(side / 2, 4 * separation)
        blocks = [F.floor(F.col(c) / side).alias(f"_b{i}") for i, c in enumerate(coords)]
        largest = points.groupBy(*keys, *blocks).count().agg(F.max("count")).first()[0]
        if largest <= limit or side <= 4 * separation:
            return side, largest


def _thin_blocks(points: DataFrame, separation: float, side: float, keys, id_col, coords) -> DataFrame:
    """One pass over all blocks, best point first: columns of ``points`` with ``_kept``: true, or null where a better point of another block is undecided; points that go are left out.

    ``points`` has ``_kept`` too: true for those that the neighbours must respect, null for undecided ones.
    """
    copies = points
    own = [F.lit(0).alias(f"_b{i}") for i in range(len(coords))]
    if side != float("inf"):
        for i, c in enumerate(coords):
            copies = copies.withColumn(f"_b{i}", F.explode(F.sequence(F.floor((F.col(c) - separation) / side), F.floor((F.col(c) + separation) / side))))
        own = [F.floor(F.col(c) / side) for c in coords]
        copies = copies.withColumn("_own", F.struct(*[f"_b{i}" for i in range(len(coords))]) == F.struct(*own))
    else:
        copies = copies.select("*", *own, F.lit(True).alias("_own"))
    blocks = [f"_b{i}" for i in range(len(coords))]
    ordered = copies.where("_kept IS NULL OR NOT _own").repartition(*keys, *blocks).sortWithinPartitions(*keys, *blocks, "_rank")
    # a block is told from the one before it by its columns; rows travel as they are
    new = ordered.select(*points.columns, "_own", F.struct(*keys, *blocks).alias("_block"))
    columns = points.columns
    places = [columns.index(c) for c in coords]
    near, limit = list(np.ndindex(*(3,) * len(coords))), separation * separation

    def run(batches):
        block, grid = None, {}
        for batch in batches:
            xs = [batch.column(i).to_pylist() for i in places]
            kept, mine = batch.column("_kept").to_pylist(), batch.column("_own").to_pylist()
            blocks, rows, marks = batch.column("_block").to_pylist(), [], []
            for i, x in enumerate(zip(*xs)):
                if blocks[i] != block:
                    block, grid = blocks[i], {}
                cell = tuple(int(v // separation) for v in x)
                state = True
                if kept[i] is None:
                    if mine[i]:
                        for shift in near:
                            for other, fixed in grid.get(tuple(c + d - 1 for c, d in zip(cell, shift)), ()):
                                if sum((u - v) * (u - v) for u, v in zip(x, other)) < limit:
                                    state = False if fixed else None
                                    if fixed:
                                        break
                            if state is False:
                                break
                    else:
                        state = None
                if state is False:
                    continue
                grid.setdefault(cell, []).append((x, state))
                if mine[i] and kept[i] is None:
                    rows.append(i)
                    marks.append(state)
            if rows:
                out = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(marks, pa.bool_()) if c == "_kept" else out.column(c) for c in columns], columns)

    return new.mapInArrow(run, points.schema)


def thin(points: DataFrame, separation: float, priority: Sequence[Column | str], *,
         keys: Sequence[str] = ("frame",), id_col: str = "pid", coords: Sequence[str] = AXES, limit: int = BLOCK_LIMIT, trace: list | None = None) -> DataFrame:
    """Keep points in the order of ``priority`` (then id) unless one already kept is closer than ``separation``.

    Space is cut into blocks of at most ``limit`` points, and a pass decides every point of a block whose better neighbours are decided, best first; those that wait for another block
    are left to the next pass.  A dependency takes a pass per border it crosses, not per point.  Where even small blocks are crowded, rounds over the
    best points of tiny cells come first.  ``trace`` gathers the names of the passes.
    """
    keys, coords = list(keys), list(coords)
    order = [F.col(c) if isinstance(c, str) else c for c in priority]
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(id_col).alias("id"))
    todo, kept = materialize(points.withColumn("_rank", rank), "thin"), []
    while True:
        side, largest = _block_side(todo, separation, keys, coords, limit)
        if largest <= limit:
            break
        winners, todo = _thin_crowds(todo, separation, keys, id_col, coords)
        kept.append(winners)
        if trace is not None:
            trace.append("crowds")
    todo = todo.withColumn("_kept", F.lit(None).cast("boolean"))
    while largest:
        done, seen = materialize_with(_thin_blocks(todo, separation, side, keys, id_col, coords), "thin", open=F.count_if(F.col("_kept").isNull()))
        if trace is not None:
            trace.append("blocks")
        kept.append(done.where("_kept"))
        todo = done
        if not seen["open"]:
            break
    found = [k.select(*points.columns) for k in kept]
    return reduce(DataFrame.unionByName, found) if found else points


def _removed_in_task(worse: DataFrame, keys: list[str]) -> DataFrame:
    """Losers among the conflicts (keys, better, worse) of groups that fit into a task: a point goes if a better one that stays is in conflict with it."""
    def run(table: pa.Table) -> pa.Table:
        better, worse_ = table.column("better").to_numpy(), table.column("worse").to_numpy()
        names, code = np.unique(np.concatenate([better, worse_]), return_inverse=True)
        a, b = code[:len(better)], code[len(better):]
        waiting = np.bincount(b, minlength=len(names)).tolist()
        order = np.argsort(a, kind="stable")
        first = np.searchsorted(a[order], np.arange(len(names) + 1)).tolist()
        below, gone = b[order].tolist(), bytearray(len(names))
        row = np.full(len(names), -1)
        row[b] = np.arange(len(b))
        ready = [i for i, n in enumerate(waiting) if not n]
        while ready:
            i = ready.pop()
            for j in below[first[i]:first[i + 1]]:
                if not gone[i]:
                    gone[j] = 1
                waiting[j] -= 1
                if not waiting[j]:
                    ready.append(j)
        lost = row[np.flatnonzero(np.frombuffer(gone, np.uint8))]
        return table.take(pa.array(lost)).drop_columns(["better"])

    return worse.groupBy(*keys).applyInArrow(run, worse.drop("better").schema)


def thin_by_conflicts(points: DataFrame, conflicts: DataFrame, priority: Sequence[Column | str], *,
                      keys: Sequence[str] = ("frame",), id_col: str = "pid", limit: int = GROUP_LIMIT, trace: list | None = None) -> DataFrame:
    """The same for an arbitrary symmetric conflict table (keys, p, q): groups of at most ``limit`` conflicts in one task each, larger ones by rounds,
    in which points with a single better rival are settled by doubling pointers."""
    keys = list(keys)
    order = [F.col(c) if isinstance(c, str) else c for c in priority]
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(id_col).alias("id"))
    ranked = points.select(*keys, F.col(id_col).alias("p"), rank.alias("_rp"))
    worse = (conflicts.join(ranked, [*keys, "p"])
             .join(ranked.select(*keys, F.col("p").alias("q"), F.col("_rp").alias("_rq")), [*keys, "q"])
             .where("_rp < _rq").select(*keys, F.col("p").alias("better"), F.col("q").alias("worse")).distinct())
    small, rest = _split(materialize(worse, "conflicts"), keys, limit)
    removed = [] if small is None else [_removed_in_task(small, keys).withColumnRenamed("worse", id_col)]
    while rest is not None:
        rivals = rest.groupBy(*keys, F.col("worse").alias("node")).agg(F.count("*").alias("n"), F.min("better").alias("up")).where("n = 1").drop("n")
        free = rest.select(*keys, F.col("better").alias("node")).distinct().join(rest.select(*keys, F.col("worse").alias("node")), [*keys, "node"], "left_anti")
        settled = _settle(rivals.unionByName(free.withColumn("up", F.lit(None).cast(rest.schema["better"].dataType))), keys, trace)
        stays = settled.where("taken").select(*keys, F.col("node").alias("better"))
        out = materialize(rest.join(stays, [*keys, "better"], "left_semi").select(*keys, F.col("worse").alias(id_col)).distinct(), "removed")
        removed.append(out)
        if trace is not None:
            trace.append("round")
        gone = out.unionByName(settled.where("taken").select(*keys, F.col("node").alias(id_col)))
        for end in ("better", "worse"):
            rest = rest.join(gone.withColumnRenamed(id_col, end), [*keys, end], "left_anti")
        rest, seen = materialize_with(rest, "conflicts")
        if not seen["rows"]:
            break
    return points.join(reduce(DataFrame.unionByName, removed), [*keys, id_col], "left_anti") if removed else points


def remove_overlapping(points: DataFrame, radius_max: float, *, tolerance: float = 1.0, half: bool = False,
                       r: str = "r", intensity: str = "intensity", keys: Sequence[str] = ("frame",),
                       id_col: str = "pid", **options) -> DataFrame:
    """Of overlapping spheres keep the most intense (lowest value): d * tolerance < r_p + r_q, or with ``half``
    d < max(r_p, r_q).  Points with the same place and radius are reduced to their best one first."""
    keys, coords = list(keys), list(options.get("coords", AXES))
    best = (points.groupBy(*keys, *coords, r)
            .agg(F.min_by(F.struct("*"), F.struct(intensity, id_col)).alias("_s")).select("_s.*"))
    reach = radius_max if half else 2 * radius_max / tolerance
    pairs = range_pairs(best, reach, keys=keys, id_col=id_col, carry=[r], **options)
    limit = F.greatest(f"p_{r}", f"q_{r}") if half else (F.col(f"p_{r}") + F.col(f"q_{r}")) / tolerance
    close = pairs.where(F.col("d2") < limit * limit).select(*keys, "p", "q")
    both = close.union(close.select(*keys, "q", "p"))
    return thin_by_conflicts(best, both, [intensity], keys=keys, id_col=id_col).select(*points.columns)
