"""Bonds between trajectories followed by pairs of groups, against the listed bonds."""

import pandas as pd
import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from corpuscle.operators import graph, histories as H, spatial
from corpuscle.plans import graphs

RADIUS = 0.35


def wandering(spark, n=40, frames=6, seed=1):
    """Trajectories that start, end and pause at random; one has a frame without a place, two are copies."""
    rng = np.random.default_rng(seed)
    rows = [(tr * 7 - 50, f, *rng.random(3)) for tr in range(n) for f in range(frames) if rng.random() < 0.8]
    rows += [(1000, tr[1], *tr[2:]) for tr in rows if tr[0] == -50]
    rows = [(*r[:2], None, *r[3:]) if i == 11 else r for i, r in enumerate(rows)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["tr", "frame", "x", "y", "z"]).astype({"frame": "int32"}))


@pytest.fixture(params=[10_000, 40], ids=["one group", "many groups"])
def tracks(spark, monkeypatch, request):
    monkeypatch.setattr(H, "ROWS", request.param)
    return wandering(spark)


def bonds(tracks):
    return spatial.bonds(tracks.na.drop(), RADIUS, id_col="tr").select("frame", "low", "high")


def same(got, want):
    assert set(got.columns) == set(want.columns)
    rows = sorted(map(tuple, want.select(got.columns).collect()), key=str)
    assert rows and sorted(map(tuple, got.collect()), key=str) == rows


def test_pieces_and_long_spans(spark, monkeypatch):
    table = wandering(spark).toPandas()
    columns = table["tr"].to_numpy(), table["frame"].to_numpy().astype(np.int64), table[["x", "y", "z"]].to_numpy(), np.full(len(table), -1)
    found = []
    for cells, dense in ((H.CELLS, H.DENSE), (30, 0)):
        monkeypatch.setattr(H, "CELLS", cells)
        monkeypatch.setattr(H, "DENSE", dense)
        rows = H.Rows(*columns)
        met = H.Meeting(rows, rows, RADIUS)
        found.append((sorted((*map(int, b),) for part in met.bonds() for b in zip(*part)), rows.shifted(2).tolist(), len(list(met.bonds()))))
    assert found[0][:2] == found[1][:2] and found[0][2] == 1 and found[1][2] > 10


def test_life(tracks):
    same(H.bond_life(H.pack(tracks), RADIUS), graph.bond_life(bonds(tracks)))


@pytest.mark.parametrize("persistence", [0, 1, 2])
def test_episodes(tracks, persistence):
    same(H.expired_bonds(H.pack(tracks), RADIUS, persistence), graph.expired_bonds(bonds(tracks), persistence))


@pytest.mark.parametrize("lag", [1, 2])
def test_broken(tracks, lag):
    same(H.broken_bonds(H.pack(tracks), RADIUS, lag), graph.broken_bonds(bonds(tracks), tracks, lag))


@pytest.mark.parametrize("lag", [1, 2])
def test_changes(tracks, lag):
    same(H.neighbour_changes(H.pack(tracks), RADIUS, lag), graph.neighbour_changes(graph.bonds_to_edges(bonds(tracks)), tracks, lag))


def test_lost_since(tracks):
    same(H.lost_since(tracks, RADIUS, 2), graph.lost_since(graph.bonds_to_edges(bonds(tracks)), tracks, 2))


def test_neighbouring(tracks):
    chosen = bonds(tracks)
    for end in ("low", "high"):
        chosen = chosen.join(tracks.where("x < 0.3").select("frame", F.col("tr").alias(end)), ["frame", end], "left_semi")
    same(H.neighbouring_bonds(tracks, RADIUS, "x < 0.3"), graph.neighbouring_bonds(bonds(tracks), chosen))


@pytest.mark.parametrize("name", ["never_reform", "never_closer"])
def test_never_again(tracks, name):
    placed = tracks.na.drop()
    same(getattr(H, name)(tracks, 0.3), getattr(graph, name)(spatial.bonds(placed, 0.3, id_col="tr").select("frame", "low", "high").localCheckpoint(), tracks))


@pytest.mark.parametrize("name", ["bond_life", "expired_bonds", "broken_bonds", "neighbour_changes", "lost_neighbours_since_reference", "neighbouring_bonds", "cluster_tracking", "space_time_clusters", "never_reforming_bonds", "never_closer_bonds"])
def test_queries_do_not_list_bonds(spark, monkeypatch, name):
    def listed(*args, **kwargs):
        raise AssertionError("bonds are listed")

    monkeypatch.setattr(graphs, "track_bonds", listed)
    assert queries()[name](spark, "/root/testdata/sf0.01").count()
