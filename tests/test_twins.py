"""Copies of trajectories are followed once, and the results name all of them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from corpuscle.operators import twins as T
from corpuscle.plans import graphs

SOURCE = "/root/testdata/sf0.001"
NAMES = ["broken_bonds", "neighbour_changes", "lost_neighbours_since_reference", "neighbouring_bonds", "bond_life", "expired_bonds", "streaming_expired_bonds",
         "cluster_tracking", "space_time_clusters"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return copied(spark, spark.read.parquet(f"{SOURCE}/events.parquet"), str(tmp_path_factory.mktemp("copies")))


def copied(spark, events, out):
    """Every user four times, and half of them once more."""
    whole = events.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("i < 4 OR user_id % 2 = 0")
    whole.withColumn("user_id", F.col("user_id") + 1000 * F.col("i")).drop("i").coalesce(1).write.parquet(f"{out}/events.parquet")
    return out


@pytest.mark.parametrize("name", NAMES)
def test_copies(spark, folder, name):
    check(spark, folder, name)


@pytest.mark.parametrize("name", ["never_reforming_bonds", "never_closer_bonds"])
def test_copies_that_part(spark, tmp_path, name):
    check(spark, copied(spark, spark.read.parquet("/root/testdata/sf0.01/events.parquet").where("user_id < 60"), str(tmp_path)), name)


def check(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    got, want = queries()[name](spark, folder).toPandas(), con.execute(oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(want) > 0

    def text(df):
        return sorted(map(str, (tuple(round(v, 5) + 0.0 if isinstance(v, float) else v for v in row) for row in df[columns].itertuples(index=False))))
    assert text(got) == text(want)


def test_bonds_of_copies_are_found_once(spark, folder):
    same, bonds = graphs.classes(spark, folder)
    _, once = graphs.classes(spark, SOURCE)
    assert not same.single and bonds.count() == once.count()


def test_long_lists_and_unlike_tracks(spark, monkeypatch):
    monkeypatch.setattr(T, "LIST", 3)
    rows = [(tr, f, float(f) if tr != 11 else -float(f), 0.0, None if tr == 12 else 0.0) for tr in range(13) for f in range(3)]
    same = T.twins(spark.createDataFrame(rows, "tr long, frame int, x double, y double, z double"))
    assert sorted((r.tr, r.w) for r in same.first.where("frame = 0").collect()) == [(0, 11), (11, 1), (12, 1)]
    pairs = same.pairs(spark.createDataFrame([(0, 0), (0, 12)], "low long, high long"))
    assert sorted(map(tuple, pairs.collect())) == sorted([(i, j) for i in range(11) for j in range(i + 1, 11)] + [(i, 12) for i in range(11)])


def test_hash_collisions_are_no_copies(spark, monkeypatch):
    monkeypatch.setattr(T.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    rows = [(tr, f, float(f + tr % 2), 0.0, 0.0) for tr in range(6) for f in range(3)]
    same = T.twins(spark.createDataFrame(rows, "tr long, frame int, x double, y double, z double"))
    assert sorted((r.tr, r.w) for r in same.first.where("frame = 0").collect()) == [(0, 3), (1, 1), (3, 1), (5, 1)]
