"""Life of intermediate tables."""

import os

from pyspark.sql import functions as F

from corpuscle import scratch
from corpuscle.operators import graph


def test_loops_leave_one_table(spark):
    edges = spark.range(400).select(F.lit(0).alias("frame"), F.col("id").alias("p"), (F.col("id") + 1).alias("q"))
    folder = scratch.application_dir(spark)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    labels = graph.connected_components(edges)
    assert labels.agg(F.max("cluster")).first()[0] == 0 and labels.count() == 401
    assert len(set(os.listdir(folder)) - before) == 1


def test_clear(spark):
    scratch.materialize(spark.range(3), "probe")
    assert os.path.isdir(scratch.application_dir(spark))
    scratch.clear(spark)
    assert not os.path.exists(scratch.application_dir(spark))
