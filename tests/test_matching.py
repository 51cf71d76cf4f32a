import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuscle.operators import graph, linking, matching, spatial

from .helpers import brute_pairs, greedy, random_points


def test_matching_of_the_nearest_lists_few_links(spark, monkeypatch):
    df, _ = random_points(spark, 300, 3, seed=13)
    ids = spark.createDataFrame([(0, 1000, 0.5, 0.5, 0.5, 0.0), (1, 1000, 0.5, 0.5, 0.5, 0.0), (1, 1001, 0.5, 0.5, 0.5, 0.0), (2, 1002, None, 0.5, 0.5, 0.0)], df.schema)
    df = df.unionByName(ids)
    want = matching.greedy_match(spatial.frame_links(df, 0.6))
    listed, write = [], matching.materialize

    def counted(frame, name="stage"):
        out = write(frame, name)
        if name == "links":
            listed.append(out.count())
        return out
    monkeypatch.setattr(matching, "materialize", counted)
    columns = ["frame", "from", "to", "cost"]
    trace = []
    got = linking.match_frames(df, 0.6, trace=trace)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert trace.count("range") > 2 and 0 < sum(listed) < spatial.frame_links(df, 0.6).count() / 10
    sized = df.withColumn("r", F.lit(0.5))
    assert linking.match_frames(sized, 0.6, r="r", radius_max=0.5).count() == want.count()


def test_accepted_links_of_the_worked_example(spark):
    links = [(0, 0, 1.1), (0, 1, 1.2), (0, 2, 0.9), (1, 0, 0.1), (1, 1, 1.1), (1, 2, 1.0)]
    df = spark.createDataFrame([(0, *l) for l in links], "frame int, `from` bigint, `to` bigint, cost double")
    assert {(r["from"], r["to"]) for r in matching.greedy_match(df).collect()} == {(1, 0), (0, 2)}
    positions = spark.createDataFrame([(0, i) for i in range(2)] + [(1, i) for i in range(4)], "frame int, pid bigint")
    traj = {(r.tr, r.frame): r.pid for r in linking.chains(positions, matching.greedy_match(df)).collect()}
    assert traj == {(0, 0): 0, (0, 1): 2, (1, 0): 1, (1, 1): 0, (2, 1): 1, (3, 1): 3}


@pytest.mark.parametrize("seed", range(3))
def test_greedy_match_with_ties(spark, seed):
    rng = np.random.default_rng(seed)
    rows = {(f, int(a), int(b)): float(rng.integers(0, 6)) for f in range(3) for a, b in rng.integers(0, 12, (40, 2))}
    df = spark.createDataFrame([(*k, c) for k, c in rows.items()], "frame int, `from` bigint, `to` bigint, cost double")
    got = {(r.frame, r["from"], r["to"]) for r in matching.greedy_match(df).collect()}
    assert got == {(r.frame, r["from"], r["to"]) for r in matching.greedy_match(df, limit=0).collect()}
    want = {(f, *m) for f in range(3) for m in greedy([(c, a, b) for (g, a, b), c in rows.items() if g == f])}
    assert got == want


def test_matching_of_mixed_group_sizes(spark):
    rng = np.random.default_rng(5)
    rows = {(f, int(a), int(b)): float(rng.random()) for f, n in ((0, 10), (1, 60), (None, 60)) for a, b in rng.integers(0, 12, (n, 2))}
    df = spark.createDataFrame([(*k, c) for k, c in rows.items()], "frame int, `from` bigint, `to` bigint, cost double")
    got = {(r.frame, r["from"], r["to"]) for r in matching.greedy_match(df.where("frame is not null"), limit=20).collect()}
    assert got == {(f, *m) for f in (0, 1) for m in greedy([(c, a, b) for (g, a, b), c in rows.items() if g == f])}


def test_a_falling_chain_takes_logarithmic_rounds(spark):
    n = 2000
    links = spark.range(n).selectExpr("0 AS frame", "(id + 1) div 2 AS `from`", "id div 2 AS `to`", "cast(id as double) AS cost")
    trace = []
    got = sorted((r["from"], r["to"]) for r in matching.greedy_match(links, limit=0, trace=trace).collect())
    assert got == [(i, i) for i in range(n // 2)] and trace.count("round") == 1 and len(trace) <= 14


def test_a_line_of_conflicts_takes_logarithmic_rounds(spark):
    n = 2000
    points = spark.range(n).selectExpr("0 AS frame", "id AS pid")
    pairs = spark.range(n - 1).selectExpr("0 AS frame", "id AS p", "id + 1 AS q")
    trace = []
    got = sorted(r.pid for r in matching.thin_by_conflicts(points, pairs.unionAll(pairs.selectExpr("frame", "q", "p")), [], limit=0, trace=trace).collect())
    assert got == list(range(0, n, 2)) and trace.count("round") == 1 and len(trace) <= 14


def test_a_line_of_points_takes_a_pass_per_border(spark):
    points = spark.range(2000).selectExpr("0 AS frame", "id AS pid", "id * 0.9D AS x", "0D AS y", "0D AS z")
    for limit, most in ((10_000, 1), (600, 5)):
        trace = []
        assert sorted(r.pid for r in matching.thin(points, 1.0, [], limit=limit, trace=trace).collect()) == list(range(0, 2000, 2)) and len(trace) <= most


@pytest.mark.parametrize("limit", [10, 60])
def test_thinning_in_blocks(spark, limit):
    df, pdf = random_points(spark, 400, 2, seed=21)
    pdf.loc[pdf.pid % 4 == 0, ["x", "y"]] = 0.25
    trace = []
    got = {(r.frame, r.pid) for r in matching.thin(spark.createDataFrame(pdf), 0.06, [], limit=limit, trace=trace).collect()}
    assert got == {(f, p) for f in (0, 1) for p in brute_thin(pdf[pdf.frame == f], 0.06)} and "blocks" in trace


@pytest.mark.parametrize("seed", range(2))
def test_conflicts_at_random(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = {(f, *sorted(map(int, p))) for f in range(3) for p in rng.integers(0, 40, (50, 2)) if p[0] != p[1]}
    points = spark.createDataFrame([(f, i, float(rng.integers(0, 9))) for f in range(3) for i in range(40)], "frame int, pid bigint, v double")
    conflicts = spark.createDataFrame([(f, *o) for f, p, q in pairs for o in ((p, q), (q, p))], "frame int, p bigint, q bigint")
    want = set()
    for r in sorted(points.collect(), key=lambda r: (r.v, r.pid)):
        if not any((r.frame, *sorted((r.pid, k))) in pairs for f, k in want if f == r.frame):
            want.add((r.frame, r.pid))
    for limit in (100_000, 0):
        assert {(r.frame, r.pid) for r in matching.thin_by_conflicts(points, conflicts, ["v"], limit=limit).collect()} == want


def brute_thin(pdf, separation):
    kept = []
    for r in pdf.sort_values("pid").itertuples():
        if all((r.x - k.x) ** 2 + (r.y - k.y) ** 2 + (r.z - k.z) ** 2 >= separation ** 2 for k in kept):
            kept.append(r)
    return {k.pid for k in kept}


def test_thinning(spark):
    df, pdf = random_points(spark, 150, 1, seed=8)
    assert {r.pid for r in matching.thin(df, 0.25, []).collect()} == brute_thin(pdf, 0.25)


def test_thinning_with_copies(spark):
    df, pdf = random_points(spark, 90, 1, seed=9)
    pdf.loc[pdf.pid % 3 == 0, ["x", "y", "z"]] = 0.5
    assert {r.pid for r in matching.thin(spark.createDataFrame(pdf), 0.2, []).collect()} == brute_thin(pdf, 0.2)


def test_best_intensity_wins(spark):
    rows = [(0, 0, 0.0, 0.0, 0.0, 1.0, -1.0), (0, 1, 1.5, 0.0, 0.0, 1.0, -2.0), (0, 2, 3.0, 0.0, 0.0, 1.0, -1.5), (0, 3, 3.0, 0.0, 0.0, 1.0, -1.4)]
    df = spark.createDataFrame(rows, "frame int, pid bigint, x double, y double, z double, r double, intensity double")
    assert {r.pid for r in matching.remove_overlapping(df, 1.0).collect()} == {1}
    assert {r.pid for r in matching.remove_overlapping(df, 1.0, half=True).collect()} == {0, 1, 2}


def test_gap_is_bridged(spark):
    rows = [(0, 0, 0.0), (2, 0, 0.05), (4, 0, 0.1), (4, 1, 0.9)]
    df = spark.createDataFrame([(f, p, x, 0.0, 0.0) for f, p, x in rows], "frame int, pid bigint, x double, y double, z double")
    got = sorted((r.tr, r.frame, r.pid) for r in linking.link_with_gaps(df, 0.2).collect() if r.pid is not None)
    assert got == [(0, 0, 0), (0, 2, 0), (0, 4, 0), (1, 4, 1)]


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(f, int(a), int(b)) for f in range(2) for a, b in rng.integers(0, 60, (40, 2))] + [(2, 0, i) for i in range(1, 50)]
    parent = {}
    def find(u):
        while parent.setdefault(u, u) != u:
            u = parent[u]
        return u
    for f, a, b in edges:
        ra, rb = sorted((find((f, a)), find((f, b))))
        parent[rb] = ra
    df = spark.createDataFrame([e for e in edges], "frame int, p bigint, q bigint")
    got = {(r.frame, r.p): r.cluster for r in graph.connected_components(df).collect()}
    assert got == {u: find(u)[1] for u in parent if any(u in ((f, a), (f, b)) and a != b for f, a, b in edges)}


def test_triangles_of_a_hub(spark):
    rows = [(0, 0, i) for i in range(1, 30)] + [(0, i, i + 1) for i in range(1, 29)]
    edges = graph.bonds_to_edges(spark.createDataFrame(rows, "frame int, low bigint, high bigint"))
    assert graph.triangles(edges).count() == 28


@pytest.mark.parametrize("hub", [2, 5, 1000])
def test_wedges_at_hubs(spark, hub):
    rng = np.random.default_rng(6)
    bonds = {(f, *sorted(map(int, p))) for f in range(2) for p in rng.integers(0, 15, (30, 2)) if p[0] != p[1]} | {(0, 0, i) for i in range(1, 40)}
    edges = graph.bonds_to_edges(spark.createDataFrame(list(bonds), "frame int, low bigint, high bigint"))
    near = {}
    for f, a, b in bonds:
        near.setdefault((f, a), set()).add(b)
        near.setdefault((f, b), set()).add(a)
    want = sorted((f, c, a, b) for (f, c), n in near.items() for a in n for b in n if a < b)
    assert sorted((r.frame, r.c, min(r.q1, r.q2), max(r.q1, r.q2)) for r in graph.wedges(edges, hub=hub).collect()) == want
    assert {tuple(r) for r in graph.second_shell(edges, hub=hub).collect()} == {(f, a, b) for f, _, a, b in want}


def test_a_hub_is_spread(spark):
    edges = spark.range(1, 5001).selectExpr("0 AS frame", "0L AS p", "id AS q")
    parts = graph.wedges(edges, hub=500).groupBy(F.pmod(F.xxhash64("q1"), F.lit(10)).alias("i"), F.pmod(F.xxhash64("q2"), F.lit(10)).alias("j")).count().collect()
    assert sum(r["count"] for r in parts) == 5000 * 4999 // 2 and len(parts) == 55 and max(r["count"] for r in parts) < 400_000


def test_components_of_random_points_match_bonds(spark):
    df, pdf = random_points(spark, 80, 1, seed=11)
    labels = {r.p: r.cluster for r in graph.connected_components(spatial.neighbour_edges(df, 0.15)).collect()}
    for _, a, b in brute_pairs(pdf, 0.15):
        assert labels[a] == labels[b]


def test_dense_index_is_gapless(spark):
    df = spark.range(1000).selectExpr("id % 3 as g", "id * 7 % 1000 as k")
    rows = linking.dense_index(df, ["g", "k"], "n", per=["g"]).toPandas().sort_values(["g", "k"])
    for _, part in rows.groupby("g"):
        assert part["n"].tolist() == list(range(len(part)))
    assert pd.Series(rows["n"]).max() == 333
