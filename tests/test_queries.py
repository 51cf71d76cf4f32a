"""Every registered query runs on the small tables; a few are checked against their SQL."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["pair_histogram", "range_join_bonds", "nearest_twelve", "bond_order_q6", "coarse_grained_q6", "greedy_matching", "dynamics_all_lags",
          "clusters_per_frame", "structure_factor", "drift_removed", "broken_bonds", "price_histogram"]


def test_names_match():
    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) > 150


def test_entry(spark):
    assert entry(spark).columns == ["frame", "bin", "n_pairs"]


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "events", "lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got, want = queries()[name](spark, FOLDER).toPandas(), con.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    def text(df):
        return sorted(map(str, (tuple(round(v, 5) + 0.0 if isinstance(v, float) else v for v in row) for row in df[columns].itertuples(index=False))))
    assert text(got) == text(want)
