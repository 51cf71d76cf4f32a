"""Neighbour graphs: conversions, shells, rings, components, paths, and how bonds change with time.

``bonds`` hold each pair once (low < high); ``edges`` hold both directions (p, q).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import attach_by
from ..scratch import materialize, materialize_with, release


def edges_to_bonds(edges: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    return edges.select(*keys, F.least("p", "q").alias("low"), F.greatest("p", "q").alias("high")).distinct()


def bonds_to_edges(bonds: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    there = F.struct(F.col("low").alias("p"), F.col("high").alias("q"))
    back = F.struct(F.col("high").alias("p"), F.col("low").alias("q"))
    return bonds.select(*keys, F.explode(F.array(there, back)).alias("e")).select(*keys, "e.*")


def neighbour_lists(edges: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Sorted neighbour ids of each particle: keys, p, n, ngbs."""
    return edges.groupBy(*keys, "p").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("q")).alias("ngbs"))


HUB = 1_000          # bonds of one particle that meet each other in one task


def wedges(edges: DataFrame, keys: Sequence[str] = ("frame",), carry: Sequence[str] = (), hub: int = HUB) -> DataFrame:
    """Pairs of bonds with a common end, each once: keys, c (that end), q1, q2 (the others, in no order) and a_/b_ copies of ``carry``.

    The bonds of a particle with more than ``hub`` of them are cut into parts of about that many, and every two parts (and each with itself) meet under a
    join key of their own, so a hub is spread over tasks however many bonds it has.
    """
    keys = list(keys)
    hubs = (edges.groupBy(*keys, "p").agg(F.count("*").alias("_n")).where(F.col("_n") > hub)
            .select(*keys, "p", F.ceil(F.col("_n") / hub).cast("int").alias("_parts")))
    dealt = edges.join(hubs, [*keys, "p"], "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))).withColumn("_part", F.pmod(F.xxhash64("q"), F.col("_parts")).cast("int"))
    one = dealt.select(*keys, F.col("p").alias("c"), F.col("q").alias("q1"), F.col("_part").alias("_i"), F.explode(F.sequence(F.col("_part"), F.col("_parts") - 1)).alias("_j"),
                       *[F.col(c).alias(f"a_{c}") for c in carry])
    two = dealt.select(*keys, F.col("p").alias("c"), F.col("q").alias("q2"), F.explode(F.sequence(F.lit(0), F.col("_part"))).alias("_i"), F.col("_part").alias("_j"),
                       *[F.col(c).alias(f"b_{c}") for c in carry])
    met = one.join(two, [*keys, "c", "_i", "_j"]).where("_i < _j OR q1 < q2")
    return met.select(*keys, "c", "q1", "q2", *[f"{side}_{c}" for c in carry for side in "ab"])


def _ends(pairs: DataFrame, keys: Sequence[str], *rest: str) -> DataFrame:
    return pairs.select(*keys, F.least("q1", "q2").alias("low"), F.greatest("q1", "q2").alias("high"), *rest)


def second_shell(edges: DataFrame, keys: Sequence[str] = ("frame",), hub: int = HUB) -> DataFrame:
    """Pairs joined by a path of two bonds (first-shell pairs included if they share a neighbour)."""
    return _ends(wedges(edges.select(*keys, "p", "q"), keys, hub=hub), keys).distinct()


def triangles(edges: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Triangles a, b, c (each once).

    Every bond is directed from its end of fewer neighbours to the other, so a hub opens no more paths
    than its neighbours do: at most sqrt(2 * bonds) leave any particle.
    """
    keys = list(keys)
    degree = edges.groupBy(*keys, "p").agg(F.count("*").alias("deg"))
    ranked = (edges.where("p < q").select(*keys, "p", "q")
              .join(degree, [*keys, "p"]).withColumnRenamed("deg", "_dp")
              .join(degree.select(*keys, F.col("p").alias("q"), F.col("deg").alias("_dq")), [*keys, "q"]))
    up = F.col("_dp") <= F.col("_dq")
    arcs = ranked.select(*keys, F.when(up, F.col("p")).otherwise(F.col("q")).alias("a"),
                         F.when(up, F.col("q")).otherwise(F.col("p")).alias("b"),
                         F.when(up, F.col("_dq")).otherwise(F.col("_dp")).alias("_d"))
    one = arcs.select(*keys, "a", "b", F.struct("_d", "b").alias("_ob"))
    two = arcs.select(*keys, "a", F.col("b").alias("c"), F.struct("_d", F.col("b").alias("b")).alias("_oc"))
    closing = edges.select(*keys, F.col("p").alias("b"), F.col("q").alias("c"))
    return (one.join(two, [*keys, "a"]).where("_ob < _oc").select(*keys, "a", "b", "c")
            .join(closing, [*keys, "b", "c"], "left_semi"))


def common_of_bonds(edges: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Common neighbours of bonded pairs: keys, low, high, c."""
    corners = triangles(edges, keys).withColumn("t", F.sort_array(F.array("a", "b", "c")))
    def row(low, high, c):
        return F.struct(F.col("t")[low].alias("low"), F.col("t")[high].alias("high"), F.col("t")[c].alias("c"))
    return (corners.select(*keys, F.explode(F.array(row(0, 1, 2), row(0, 2, 1), row(1, 2, 0))).alias("r"))
            .select(*keys, "r.*"))


def common_of_second_shell(edges: DataFrame, keys: Sequence[str] = ("frame",), hub: int = HUB) -> DataFrame:
    """Common neighbours of pairs that are two bonds apart but not bonded: keys, low, high, c."""
    keys = list(keys)
    bonded = edges.select(*keys, F.col("p").alias("low"), F.col("q").alias("high"))
    return _ends(wedges(edges, keys, hub=hub), keys, "c").join(bonded, [*keys, "low", "high"], "left_anti")


def ring_pairs(common: DataFrame, edges: DataFrame, size: int, *, ring: bool = True,
               keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Pairs with exactly ``size`` common neighbours, which form a ring (each bonded to two of the others)."""
    keys = list(keys)
    n = common.groupBy(*keys, "low", "high").agg(F.count("*").alias("_n")).where(F.col("_n") == size)
    chosen = common.join(n.drop("_n"), [*keys, "low", "high"], "left_semi")
    if not ring:
        return chosen.select(*keys, "low", "high").distinct()
    # the members of one pair meet each other (``size`` is small), then their bonds are looked up
    links = edges.select(*keys, F.col("p").alias("c"), F.col("q").alias("c2"))
    others = chosen.select(*keys, "low", "high", F.col("c").alias("c2"))
    inner = (chosen.join(others, [*keys, "low", "high"]).where("c <> c2").join(links, [*keys, "c", "c2"], "left_semi")
             .groupBy(*keys, "low", "high", "c").agg(F.count("*").alias("_deg")))
    return (inner.groupBy(*keys, "low", "high")
            .agg(F.count("*").alias("_members"), F.bool_and(F.col("_deg") == 2).alias("_ring"))
            .where((F.col("_members") == size) & F.col("_ring")).select(*keys, "low", "high"))


def sp5c(edges: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Bonded pairs with five common neighbours, no ring test."""
    return ring_pairs(common_of_bonds(edges, keys), edges, 5, ring=False, keys=keys)


def pairs_1551(edges: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Bonded pairs whose five common neighbours form a ring."""
    return ring_pairs(common_of_bonds(edges, keys), edges, 5, keys=keys)


def pairs_2331(edges: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Non-bonded second-shell pairs whose three common neighbours form a ring."""
    return ring_pairs(common_of_second_shell(edges, keys), edges, 3, keys=keys)


def spindles(pairs: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Number of selected pairs each particle is an end of."""
    return (pairs.select(*keys, F.explode(F.array("low", "high")).alias("p"))
            .groupBy(*keys, "p").agg(F.count("*").alias("n")))


def count_by(edges: DataFrame, points: DataFrame, keys: Sequence[str] = ("frame",), id_col: str = "pid") -> DataFrame:
    """Neighbour count of every particle, zero included."""
    n = edges.groupBy(*keys, "p").agg(F.count("*").alias("n"))
    return (points.select(*keys, F.col(id_col).alias("p")).join(n, [*keys, "p"], "left").na.fill(0, ["n"]))


def second_outside(outside: DataFrame, edges: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Outside particles (keys, p) and the neighbours of them."""
    near = (edges.join(outside.select(*keys, "p"), [*keys, "p"], "left_semi")
            .select(*keys, F.col("q").alias("p")))
    return outside.select(*keys, "p").union(near).distinct()


def dilate(field: DataFrame, edges: DataFrame, value: str, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Value of largest magnitude among the particle and its neighbours."""
    keys = list(keys)
    shared = field.select(*keys, F.col("p").alias("q"), value)
    reached = edges.select(*keys, "p", "q").join(shared, [*keys, "q"]).select(*keys, "p", value)
    return (reached.union(field.select(*keys, "p", value)).groupBy(*keys, "p")
            .agg(F.max_by(value, F.struct(F.abs(value), F.col(value))).alias(value)))


def average_field(field: DataFrame, edges: DataFrame, value: str, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """(own + mean of the neighbours) / 2; the own value where there is no neighbour."""
    keys = list(keys)
    shared = field.select(*keys, F.col("p").alias("q"), value)
    means = (edges.select(*keys, "p", "q").join(shared, [*keys, "q"]).groupBy(*keys, "p")
             .agg(F.avg(value).alias("_m")))
    return (field.join(means, [*keys, "p"], "left")
            .select(*keys, "p", ((F.col(value) + F.coalesce("_m", value)) / 2).alias(value)))


def coarse_grain_field(field: DataFrame, edges: DataFrame, value: str, keys: Sequence[str] = ("frame",)) -> DataFrame:
    """(own + sum over the neighbours) / (1 + n)."""
    keys = list(keys)
    shared = field.select(*keys, F.col("p").alias("q"), value)
    reached = edges.select(*keys, "p", "q").join(shared, [*keys, "q"]).select(*keys, "p", value)
    return (reached.union(field.select(*keys, "p", value)).groupBy(*keys, "p").agg(F.avg(value).alias(value)))


def crossed_bonds(bonds: DataFrame, field: DataFrame, value: str, threshold: float,
                  keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Bonds whose two ends both exceed the threshold."""
    keys = list(keys)
    high = field.where(F.col(value) > threshold)
    for end in ("low", "high"):
        bonds = bonds.join(high.select(*keys, F.col("p").alias(end)), [*keys, end], "left_semi")
    return bonds


# --- components and paths ----------------------------------------------------------------------------

def connected_components(edges: DataFrame, keys: Sequence[str] = ("frame",), nodes: DataFrame | None = None) -> DataFrame:
    """keys, p, cluster (= smallest member id); ``nodes`` (keys, p) adds single particles.

    Alternates two steps until nothing changes: every particle hands its smallest neighbour to its larger
    neighbours, then to its smaller ones.  The number of rounds grows with the logarithm of the size, and a
    hub costs one row per bond and round.
    """
    keys = list(keys)
    arcs = edges.where("p <> q").select(*keys, F.greatest("p", "q").alias("u"), F.least("p", "q").alias("v")).distinct()
    arcs, before = materialize(arcs, "arcs"), None
    while True:
        both = arcs.union(arcs.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        large = (both.join(least, [*keys, "u"]).where("v > u")
                 .select(*keys, F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct())
        least = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        linked = large.join(least, [*keys, "u"])
        small = linked.where("v <> m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        old, (arcs, now) = arcs, materialize_with(small.union(least.select(*keys, "u", F.col("m").alias("v"))).distinct(), "arcs",
                                                  mark=F.bit_xor(F.xxhash64(*keys, "u", "v")))
        release(old)
        if now == before:
            break
        before = now
    roots = arcs.select(*keys, F.col("v").alias("p")).distinct()
    labels = arcs.select(*keys, F.col("u").alias("p"), F.col("v").alias("cluster")).union(
        roots.withColumn("cluster", F.col("p")))
    if nodes is None:
        return labels
    return (nodes.select(*keys, "p").join(labels, [*keys, "p"], "left")
            .withColumn("cluster", F.coalesce("cluster", "p")))


def distances_from(sources: DataFrame, edges: DataFrame, max_length: int,
                   keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Breadth-first search: keys, s, p, hops for every p within ``max_length`` bonds of a source (keys, s)."""
    keys = list(keys)
    reached = materialize(sources.select(*keys, "s").distinct().select(*keys, "s", F.col("s").alias("p"),
                                                                     F.lit(0).alias("hops")), "bfs")
    frontier = reached
    for hop in range(1, max_length + 1):
        step = (frontier.select(*keys, "s", "p").join(edges.select(*keys, "p", "q"), [*keys, "p"])
                .select(*keys, "s", F.col("q").alias("p")).distinct()
                .join(reached, [*keys, "s", "p"], "left_anti").withColumn("hops", F.lit(hop)))
        frontier = materialize(step, "bfs")
        reached = reached.unionByName(frontier)
    return reached


def pair_path_length(pairs: DataFrame, edges: DataFrame, max_length: int,
                     keys: Sequence[str] = ("frame",)) -> DataFrame:
    """Bonds on the shortest path between low and high, NULL if longer than ``max_length``.

    Both ends are searched half way, so no ball larger than half the length is built.
    """
    keys = list(keys)
    half = (max_length + 1) // 2
    ends = pairs.select(*keys, F.explode(F.array("low", "high")).alias("s"))
    balls = materialize(distances_from(ends, edges, half, keys), "balls")
    a = balls.select(*keys, F.col("s").alias("low"), F.col("p").alias("m"), F.col("hops").alias("_a"))
    b = balls.select(*keys, F.col("s").alias("high"), F.col("p").alias("m"), F.col("hops").alias("_b"))
    pairs = pairs.select(*keys, "low", "high").distinct()
    met = (pairs.join(a, [*keys, "low"]).join(b, [*keys, "high", "m"])
           .groupBy(*keys, "low", "high").agg(F.min(F.col("_a") + F.col("_b")).alias("length"))
           .where(F.col("length") <= max_length))
    return pairs.join(met, [*keys, "low", "high"], "left")


# --- bonds between trajectories in the course of time ------------------------------------------------
# ``tbonds``: frame, low, high with trajectory ids; ``alive``: frame, tr.

def broken_bonds(tbonds: DataFrame, alive: DataFrame, lag: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """Bonds of frame t gone at t + lag although both trajectories still exist: keys, frame (= t), low, high."""
    keys = list(keys)
    later = tbonds.select(*keys, (F.col("frame") - lag).alias("frame"), "low", "high")
    there = alive.select(*keys, (F.col("frame") - lag).alias("frame"), "tr")
    gone = tbonds.select(*keys, "frame", "low", "high")
    for end in ("low", "high"):
        gone = gone.join(there.withColumnRenamed("tr", end), [*keys, "frame", end], "left_semi")
    return gone.join(later, [*keys, "frame", "low", "high"], "left_anti")


def _number(weight: str | None):
    return F.sum(weight) if weight else F.count("*")


def neighbour_changes(tedges: DataFrame, alive: DataFrame, lag: int = 1, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Neighbours lost and gained by each trajectory between t and t + lag; NULL where it ends before.  ``weight``: how many trajectories q stands for."""
    keys, rest = list(keys), [weight] if weight else []
    now = tedges.select(*keys, "frame", "p", "q", *rest)
    then = tedges.select(*keys, (F.col("frame") - lag).alias("frame"), "p", "q", *rest)
    def count(a, b, name):
        return a.join(b, [*keys, "frame", "p", "q"], "left_anti").groupBy(*keys, "frame", "p").agg(_number(weight).alias(name))
    base = alive.select(*keys, "frame", F.col("tr").alias("p"))
    later = base.select(*keys, (F.col("frame") - lag).alias("frame"), "p", F.lit(True).alias("_later"))
    table = base.join(later, [*keys, "frame", "p"], "left")
    for a, b, name in ((now, then, "lost"), (then, now, "gained")):
        table = table.join(count(a, b, name), [*keys, "frame", "p"], "left")
    return table.select(*keys, "frame", "p", *[F.when(F.col("_later"), F.coalesce(n, F.lit(0))).alias(n)
                                              for n in ("lost", "gained")])


def lost_since(tedges: DataFrame, alive: DataFrame, reference: int, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """For every later frame: how many of the neighbours at the reference frame are no longer neighbours.

    NULL after the end of the trajectory.  ``weight``: how many trajectories q stands for.
    """
    keys = list(keys)
    start = tedges.where(F.col("frame") == reference).select(*keys, "p", "q", *([weight] if weight else []))
    base = alive.where(F.col("frame") == reference).select(*keys, F.col("tr").alias("p"))
    now = alive.where(F.col("frame") >= reference).select(*keys, "frame", F.col("tr").alias("p"))
    n0 = start.groupBy(*keys, "p").agg(_number(weight).alias("_n0"))
    kept = (tedges.where(F.col("frame") >= reference).select(*keys, "frame", "p", "q")
            .join(start, [*keys, "p", "q"])
            .groupBy(*keys, "frame", "p").agg(_number(weight).alias("_kept")))
    return (now.join(base, [*keys, "p"], "left_semi").join(n0, [*keys, "p"], "left")
            .join(kept, [*keys, "frame", "p"], "left")
            .select(*keys, "frame", "p", (F.coalesce("_n0", F.lit(0)) - F.coalesce("_kept", F.lit(0))).alias("lost")))


def neighbouring_bonds(tbonds: DataFrame, chosen: DataFrame, keys: Sequence[str] = ("frame",), sizes: DataFrame | None = None) -> DataFrame:
    """Bonds that share exactly one end with a chosen bond of the same frame (chosen bonds left out per bond).

    A bond is one if an end has a chosen bond besides it, so the chosen bonds are counted by their ends, and no two bonds meet.
    ``sizes`` (p, w): particles stand for w of their kind, bonds with low = high for those among them.
    """
    keys = list(keys)
    chosen = chosen.select(*keys, "low", "high").distinct()
    ends = bonds_to_edges(chosen.where("low <> high"), keys)
    if sizes is None:
        ends = ends.withColumn("w", F.lit(1).cast("long"))
    else:
        own = chosen.where("low = high").join(sizes.withColumnRenamed("p", "low"), "low").select(*keys, F.col("low").alias("p"), F.col("low").alias("q"), (F.col("w") - 1).alias("w"))
        ends = ends.join(sizes.withColumnRenamed("p", "q"), "q").select(*keys, "p", "q", "w").unionByName(own)
    held = ends.groupBy(*keys, "p").agg(F.sum("w").alias("_c"))
    found = tbonds.select(*keys, "low", "high").distinct().join(chosen.withColumn("_is", F.lit(1)), [*keys, "low", "high"], "left")
    for end in ("low", "high"):
        found = found.join(held.select(*keys, F.col("p").alias(end), F.col("_c").alias(f"_{end}")), [*keys, end], "left")
    others = F.greatest(F.coalesce("_low", F.lit(0)), F.coalesce("_high", F.lit(0))) - F.coalesce("_is", F.lit(0))
    return found.where(others > 0).select(*keys, "low", "high")


def bond_life(tbonds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """First and last frame in which each bond is seen."""
    return (tbonds.groupBy(*keys, "low", "high")
            .agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("n")))


def expired_bonds(tbonds: DataFrame, persistence: int, keys: Sequence[str] = ()) -> DataFrame:
    """Episodes of a bond: it expires once unseen for more than ``persistence`` frames. low, high, first, last."""
    from .select import contiguous
    keys = list(keys)
    if persistence > 1:
        seen = tbonds.select(*keys, "low", "high", F.explode(F.sequence(
            F.col("frame"), F.col("frame") + persistence - 1)).alias("frame")).distinct()
    else:
        seen = tbonds.select(*keys, "low", "high", "frame").distinct()
    runs = contiguous(seen, [*keys, "low", "high"])
    return (runs.groupBy(*keys, "low", "high", "t_start").agg((F.max("frame") - max(persistence, 1) + 1).alias("last"))
            .withColumnRenamed("t_start", "first").select(*keys, "low", "high", "first", "last"))


def never_reform(tbonds: DataFrame, alive: DataFrame, length: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """Bonds whose last break left their ends more than ``length`` particles apart on the graph and that never
    come back: keys, low, high, frame of the break.

    A path is counted in particles, ends included; a pair without any path is not reported.
    """
    keys = list(keys)
    broken = materialize(broken_bonds(tbonds, alive, 1, keys)
                         .withColumn("frame", F.col("frame") + 1), "broken")
    edges = bonds_to_edges(tbonds, [*keys, "frame"])
    labels = connected_components(edges, [*keys, "frame"])
    linked = broken
    for end, name in (("low", "_cl"), ("high", "_ch")):
        linked = linked.join(labels.select(*keys, "frame", F.col("p").alias(end), F.col("cluster").alias(name)),
                             [*keys, "frame", end])
    linked = linked.where("_cl = _ch").select(*keys, "frame", "low", "high")
    close = pair_path_length(broken, edges, length - 1, [*keys, "frame"]).where("length is not null")
    far = linked.join(close, [*keys, "frame", "low", "high"], "left_anti")
    last_break = far.groupBy(*keys, "low", "high").agg(F.max("frame").alias("frame"))
    last_seen = tbonds.groupBy(*keys, "low", "high").agg(F.max("frame").alias("_seen"))
    return (last_break.join(last_seen, [*keys, "low", "high"]).where("_seen < frame")
            .select(*keys, "low", "high", "frame"))


def never_closer(tbonds: DataFrame, alive: DataFrame, length: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """Like ``never_reform``, and the ends never come within ``length`` particles of each other again."""
    keys = list(keys)
    candidates = materialize(never_reform(tbonds, alive, length, keys), "never")
    last = tbonds.groupBy(*keys).agg(F.max("frame").alias("_last"))
    watch = (attach_by(candidates, last, keys)
             .select(*keys, "low", "high", F.explode(F.sequence("frame", "_last")).alias("frame")))
    edges = bonds_to_edges(tbonds, [*keys, "frame"])
    met = pair_path_length(watch, edges, length - 1, [*keys, "frame"]).where("length is not null")
    return candidates.join(met.select(*keys, "low", "high"), [*keys, "low", "high"], "left_anti")


# --- clusters ----------------------------------------------------------------------------------------

def cluster_sizes(labels: DataFrame, keys: Sequence[str] = ("frame",)) -> DataFrame:
    return labels.groupBy(*keys, "cluster").agg(F.count("*").alias("size"))


def cluster_extent(labels: DataFrame, points: DataFrame, keys: Sequence[str] = ("frame",), id_col: str = "pid",
                   coords: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Size, bounding box and summed variance (squared radius of gyration) of every cluster."""
    keys = list(keys)
    members = labels.join(points.select(*keys, F.col(id_col).alias("p"), *coords), [*keys, "p"])
    variance = sum((F.var_pop(c) for c in coords[1:]), F.var_pop(coords[0]))
    boxes = [agg for c in coords for agg in (F.min(c).alias(f"{c}0"), F.max(c).alias(f"{c}1"))]
    return members.groupBy(*keys, "cluster").agg(F.count("*").alias("size"), *boxes, variance.alias("rg2"))


def largest_delta(extents: DataFrame, keys: Sequence[str] = ("frame",), coords: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Largest side of any cluster of each frame."""
    sides = [F.col(f"{c}1") - F.col(f"{c}0") for c in coords]
    return extents.groupBy(*keys).agg(F.max(F.greatest(*sides)).alias("delta"))


def percolation(points: DataFrame, edges: DataFrame, field: str, thresholds: Sequence[float], *,
                keys: Sequence[str] = ("frame",), id_col: str = "pid") -> DataFrame:
    """Clusters of the particles above each threshold: threshold, keys, cluster, size, rg2.

    All thresholds are components of one graph whose nodes carry the threshold as one more key.
    """
    keys = list(keys)
    levels = F.explode(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col("_v") > t))
    if "threshold" in edges.columns:          # ``shared.component_arcs`` of the levels
        level_edges = edges.select("threshold", *keys, "p", "q")
    else:
        weakest = (edges.select(*keys, "p", "q")
                   .join(points.select(*keys, F.col(id_col).alias("p"), F.col(field).alias("_vp")), [*keys, "p"])
                   .join(points.select(*keys, F.col(id_col).alias("q"), F.col(field).alias("_vq")), [*keys, "q"])
                   .withColumn("_v", F.least("_vp", "_vq")))
        level_edges = weakest.select("*", levels.alias("threshold")).select("threshold", *keys, "p", "q")
    nodes = (points.select(*keys, F.col(id_col).alias("p"), F.col(field).alias("_v"))
             .select(*keys, "p", levels.alias("threshold")))
    labels = connected_components(level_edges, ["threshold", *keys], nodes)
    members = labels.join(points.select(*keys, F.col(id_col).alias("p"), "x", "y", "z"), [*keys, "p"])
    return members.groupBy("threshold", *keys, "cluster").agg(
        F.count("*").alias("size"), (F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("rg2"))


def cluster_links(members: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Candidate links of clusters in successive frames: frame, from, to, cost = union / intersection - 1 (< 2).

    ``members``: keys, frame, cluster, tr.
    """
    keys = list(keys)
    size = members.groupBy(*keys, "frame", "cluster").agg(F.count("*").alias("n"))
    now = members.select(*keys, "frame", F.col("cluster").alias("from"), "tr")
    later = members.select(*keys, (F.col("frame") - 1).alias("frame"), F.col("cluster").alias("to"), "tr")
    shared = now.join(later, [*keys, "frame", "tr"]).groupBy(*keys, "frame", "from", "to").agg(F.count("*").alias("_i"))
    a = size.select(*keys, "frame", F.col("cluster").alias("from"), F.col("n").alias("_na"))
    b = size.select(*keys, (F.col("frame") - 1).alias("frame"), F.col("cluster").alias("to"), F.col("n").alias("_nb"))
    union = F.col("_na") + F.col("_nb") - F.col("_i")
    return (shared.join(a, [*keys, "frame", "from"]).join(b, [*keys, "frame", "to"])
            .select(*keys, "frame", "from", "to", (union / F.col("_i") - 1).alias("cost")).where("cost < 2"))


def time_clusters(members: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Clusters of clusters: those of successive frames that share a trajectory. keys, frame, cluster, time_cluster.

    A node of the space-time graph is the pair (frame, cluster).
    """
    keys = list(keys)
    node = F.struct("frame", "cluster")
    now = members.select(*keys, "frame", "tr", node.alias("p"))
    later = members.select(*keys, (F.col("frame") - 1).alias("frame"), "tr", node.alias("q"))
    arcs = now.join(later, [*keys, "frame", "tr"]).select(*keys, "p", "q").distinct()
    nodes = members.select(*keys, node.alias("p")).distinct()
    labels = struct_components(arcs, nodes, keys)
    return labels.select(*keys, "p.frame", "p.cluster",
                         F.col("root.frame").alias("first_frame"), F.col("root.cluster").alias("first_cluster"))


def struct_components(arcs: DataFrame, nodes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Components of a graph whose node is a struct: nodes get dense numbers, roots are translated back."""
    from .linking import dense_index
    keys = list(keys)
    numbered = dense_index(nodes, [*keys, "p"], "_id")
    ids = materialize(numbered, "nodes")
    left = ids.select(*keys, "p", F.col("_id").alias("_a"))
    right = ids.select(*keys, F.col("p").alias("q"), F.col("_id").alias("_b"))
    plain = arcs.join(left, [*keys, "p"]).join(right, [*keys, "q"]).select(
        *keys, F.col("_a").alias("p"), F.col("_b").alias("q"))
    labels = connected_components(plain, keys, ids.select(*keys, F.col("_id").alias("p")))
    member = ids.select(*keys, F.col("_id").alias("p"), F.col("p").alias("_node"))
    root = ids.select(*keys, F.col("_id").alias("cluster"), F.col("p").alias("root"))
    return (labels.join(member, [*keys, "p"]).join(root, [*keys, "cluster"])
            .select(*keys, F.col("_node").alias("p"), "root"))


def bond_angles(edges: DataFrame, keys: Sequence[str] = ("frame",), nbins: int = 180, hub: int = HUB) -> DataFrame:
    """Angles between the bonds of each particle, in equal bins of [0, 180] degrees: keys, bin, n."""
    keys = list(keys)
    pairs = wedges(edges.where("d2 > 0"), keys, ["dx", "dy", "dz", "d2"], hub)
    dot = F.col("a_dx") * F.col("b_dx") + F.col("a_dy") * F.col("b_dy") + F.col("a_dz") * F.col("b_dz")
    cosine = dot / F.nullif(F.sqrt(F.col("a_d2") * F.col("b_d2")), F.lit(0.0))
    degrees = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    bin = F.least(F.floor(degrees * (nbins / 180)).cast("int"), F.lit(nbins - 1)).alias("bin")
    return pairs.groupBy(*keys, bin).agg(F.count("*").alias("n"))
