"""Intermediate tables that cut lineage in iterative operators.

They are parquet files in the folder the session names in ``spark.checkpoint.dir``, so a lost executor
costs one re-read, never a re-run of the whole loop.  All tables of an application lie in one folder: loops release
the table of a round once the next is written, ``clear`` removes the rest when the results have been used.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

_local_dirs: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Shared scratch folder of the session; a temporary one only for a local master without setting."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="corpuscle-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return _local_dirs[app]


def application_dir(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/corpuscle-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Remove every intermediate table of this application; results that have not been written or fetched yet are lost with them."""
    _delete(spark, application_dir(spark))


def release(df: DataFrame | None) -> None:
    """Remove the table behind a DataFrame of ``materialize``, which nothing may read any more."""
    folder = getattr(df, "_scratch_folder", None)
    if folder:
        _delete(df.sparkSession, folder)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads it back, with no lineage behind it."""
    return materialize_with(df, name)[0]


def materialize_with(df: DataFrame, name: str = "stage", **metrics: Column) -> tuple[DataFrame, dict]:
    """The same, with aggregates gathered while writing (``rows`` always among them)."""
    path = new_path(df.sparkSession, name)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *[m.alias(k) for k, m in metrics.items()]).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_folder = path
    return out, seen.get
