import pytest
from pyspark.sql import functions as F

from corpuscle.operators import graph, shared, spatial

from .helpers import random_points


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("core", [1024, 7])
def test_rings_block_by_block_against_listed_triangles(spark, monkeypatch, core):
    monkeypatch.setattr(shared, "CORE", core)
    df, _ = random_points(spark, 90, 2, seed=5)
    edges = spatial.neighbour_edges(df, 0.35).select("frame", "p", "q").localCheckpoint()
    for name in ("sp5c", "pairs_1551", "pairs_2331"):
        assert rows(getattr(shared, name)(df, 0.35)) == rows(getattr(graph, name)(edges)), name
    assert rows(shared.ring_pairs(df, 0.35, 4, bonded=True)) == rows(graph.ring_pairs(graph.common_of_bonds(edges), edges, 4))


def test_rings_do_not_list_triangles(spark):
    """300 points in one spot have 13 million triangles; apart from them, a pair with a ring of five."""
    crowd = spark.range(300).select(F.lit(0).alias("frame"), F.col("id").alias("pid"), *[F.lit(5.0).alias(c) for c in "xyz"])
    ring = [(0, 1000 + i, x, y, z) for i, (x, y, z) in enumerate([(0.0, 0.0, -0.5), (0.0, 0.0, 0.4), (0.8, 0.0, 0.0), (0.25, 0.76, 0.0), (-0.65, 0.47, 0.0), (-0.65, -0.47, 0.0), (0.25, -0.76, 0.0)])]
    df = crowd.union(spark.createDataFrame(ring, crowd.schema))
    assert rows(shared.pairs_1551(df, 1.0)) == [(0, 1000, 1001)]


def test_topology_counts_ends_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(shared, "CORE", 20)
    df, _ = random_points(spark, 80, 2, seed=6)
    df = df.withColumn("x", F.when(F.col("pid") == 3, F.lit(None)).otherwise(F.col("x")))
    edges = spatial.neighbour_edges(df, 0.35).select("frame", "p", "q").localCheckpoint()
    want = graph.count_by(edges, df)
    for name in ("sp5c", "pairs_1551", "pairs_2331"):
        want = want.join(graph.spindles(getattr(graph, name)(edges)).withColumnRenamed("n", name), ["frame", "p"], "left").na.fill(0, [name])
    assert rows(shared.topology(df, 0.35)) == rows(want)


def test_common_neighbours_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(shared, "CORE", 20)
    monkeypatch.setattr(shared, "CELLS", 50)
    df, _ = random_points(spark, 70, 2, seed=7)
    edges = spatial.neighbour_edges(df, 0.35).select("frame", "p", "q")
    assert rows(shared.common_of_bonds(df, 0.35)) == rows(graph.common_of_bonds(edges))


@pytest.mark.parametrize("core", [1024, 20])
def test_second_shell_block_by_block(spark, monkeypatch, core):
    monkeypatch.setattr(shared, "CORE", core)
    df, _ = random_points(spark, 90, 2, seed=9)
    twice = df.unionByName(df.where("pid < 10")).unionByName(df.where("pid < 20").withColumn("frame", F.lit(None).cast("bigint")))
    assert rows(shared.second_shell(twice, 0.35)) == rows(graph.second_shell(spatial.neighbour_edges(df, 0.35).select("frame", "p", "q")))


@pytest.mark.parametrize("core", [1024, 20])
def test_bond_angles_block_by_block(spark, monkeypatch, core):
    """Right and straight angles lie on the borders of bins; bonds without a length have none."""
    monkeypatch.setattr(shared, "CORE", core)
    df, _ = random_points(spark, 90, 2, seed=10)
    grid = [(7, 100 + i, float(i % 3), float(i // 3), 0.0, 0.0) for i in range(9)] + [(7, 200, 0.0, 0.0, 0.0, 0.0)]
    points = df.unionByName(spark.createDataFrame(grid, df.schema)).unionByName(df.where("frame = 1 AND pid < 9").withColumn("x", F.col("x") + F.when(F.col("pid") > 4, 0.1).otherwise(0.0)))
    want = graph.bond_angles(spatial.neighbour_edges(points, 1.1), nbins=36)
    assert rows(shared.bond_angles(points, 1.1, 36)) == rows(want)


@pytest.mark.parametrize("longest", [2, 3, 4, 5])
def test_path_lengths_block_by_block(spark, monkeypatch, longest):
    monkeypatch.setattr(shared, "CORE", 20)
    df, _ = random_points(spark, 70, 2, seed=8)
    edges = spatial.neighbour_edges(df, 0.2).select("frame", "p", "q").localCheckpoint()
    far = spatial.bonds(df, 0.45).where("d2 >= 0.2D * 0.2D").select("frame", "low", "high")
    got = rows(shared.path_lengths(df, 0.2, 0.45, longest).na.fill(-1))
    assert got == rows(graph.pair_path_length(far, edges, longest).select("frame", "low", "high", F.col("length").cast("int")).na.fill(-1))
    assert {r[3] for r in got} >= {-1, 2}


@pytest.mark.parametrize("radius", [0.12, 0.3])
def test_components_block_by_block(spark, monkeypatch, radius):
    monkeypatch.setattr(shared, "CORE", 20)
    df, _ = random_points(spark, 90, 2, seed=9)
    edges = spatial.neighbour_edges(df, radius).select("frame", "p", "q").localCheckpoint()
    arcs = shared.component_arcs(df, radius).localCheckpoint()
    nodes = df.select("frame", F.col("pid").alias("p"))
    assert rows(graph.connected_components(arcs, nodes=nodes)) == rows(graph.connected_components(edges, nodes=nodes))
    if radius == 0.3:
        assert arcs.count() < edges.count() / 2       # rows for particles, not for bonds
        by_level = [rows(graph.percolation(df, e, "v", [-0.5, 0.3]).select("threshold", "frame", "cluster", "size"))
                    for e in (edges, shared.component_arcs(df, radius, fields=["v"], levels=[-0.5, 0.3]))]
        assert by_level[0] == by_level[1]


def test_dilation_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(shared, "CORE", 20)
    df, _ = random_points(spark, 70, 2, seed=10)
    df = df.withColumns({"v": F.when(F.col("pid") < 5, F.lit(None)).otherwise(F.round("v", 1)), "x": F.when(F.col("pid") == 9, F.lit(None)).otherwise(F.col("x"))})
    edges = spatial.neighbour_edges(df, 0.2).select("frame", "p", "q")
    assert [tuple(map(str, r)) for r in rows_of(shared.dilate(df, 0.2, "v"))] == [tuple(map(str, r)) for r in rows_of(graph.dilate(df.withColumnRenamed("pid", "p"), edges, "v"))]


def rows_of(df):
    return df.orderBy("frame", "p").collect()
