"""Series longer and wider than the given tables: nothing may depend on their last frame, id or value."""

import datetime
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries

SOURCE = "/root/testdata/sf0.001"
NAMES = ["time_lag_pairs", "dynamics_all_lags", "relaxation_time", "time_correlation", "collective_scattering", "msd_log_spaced", "diffusion_fit", "trajectory_spans",
         "rekey_by_trajectory", "spanning_per_interval", "streaming_running_mean", "streaming_expired_bonds", "streaming_linker", "price_histogram", "decimated_histogram",
         "quantity_price_histogram", "structure_factor"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events of 90 days and more, some before the first day; labels to 29; one price far above the others."""
    out = str(tmp_path_factory.mktemp("long"))
    events = spark.read.parquet(f"{SOURCE}/events.parquet")
    later = [events.withColumn("ts", (F.col("ts") + datetime.timedelta(days=d)).cast(events.schema["ts"].dataType)).withColumn("value", F.col("value") + i)
             for i, d in enumerate((-40, -10, 20, 50))]
    whole = later[0]
    for part in later[1:]:
        whole = whole.unionByName(part)
    daily = events.orderBy("ts", "user_id").limit(1).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(99))))
    daily = daily.withColumn("ts", (F.col("ts") + F.make_dt_interval(days="d")).cast(events.schema["ts"].dataType)).withColumn("value", F.col("value") + F.col("d") % 7).drop("d")
    whole = whole.unionByName(daily)
    points = spark.read.parquet(f"{SOURCE}/embeddings.parquet")
    more = points.withColumn("label", F.col("label") + 10 * (F.col("vec_id") % 3).cast(points.schema["label"].dataType))
    lines = spark.read.parquet(f"{SOURCE}/lineitem.parquet")
    lines = lines.withColumn("l_extendedprice", F.when(F.col("l_orderkey") < 40, F.col("l_extendedprice") * 9).otherwise(F.col("l_extendedprice")).cast(lines.schema["l_extendedprice"].dataType))
    for name, df in (("events", whole), ("embeddings", more), ("lineitem", lines)):
        df.coalesce(1).write.parquet(f"{out}/{name}.parquet")
    return out


@pytest.mark.parametrize("name", NAMES)
def test_long_series(spark, folder, name):
    con = duckdb.connect()
    for t in ("embeddings", "events", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(folder, t)}.parquet/*.parquet'")
    got, want = queries()[name](spark, folder).toPandas(), con.execute(oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns

    def text(df):
        return sorted(map(str, (tuple(round(v, 4) + 0.0 if isinstance(v, float) else v for v in row) for row in df[columns].itertuples(index=False))))
    assert text(got) == text(want)
    if name == "time_lag_pairs":
        assert got["lag"].max() > 30
