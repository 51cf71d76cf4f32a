"""How the driver tables become positions, tracks and graphs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

BOND = 0.12          # bond length used on the embedding positions
T_BOND = 5.0         # and on the event tracks
TRACK = 1_000_000    # ids of one user's tracks


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def positions(spark: SparkSession, d: str) -> DataFrame:
    """frame = label, pid = vec_id, coordinates and fields = first components of the vector."""
    v = F.col("embedding")
    return table(spark, d, "embeddings").select(
        F.col("label").alias("frame"), F.col("vec_id").alias("pid"),
        v[0].cast("double").alias("x"), v[1].cast("double").alias("y"), v[2].cast("double").alias("z"),
        v[3].cast("double").alias("f"), v[4].cast("double").alias("g"),
        (F.lit(0.02) + F.lit(0.1) * F.abs(v[5].cast("double"))).alias("r"),
        (F.col("vec_id") % 2).cast("int").alias("species"))


P = """p AS (SELECT label AS frame, vec_id AS pid, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
  CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS f, CAST(embedding[5] AS DOUBLE) AS g,
  0.02::DOUBLE + 0.1::DOUBLE * abs(CAST(embedding[6] AS DOUBLE)) AS r, CAST(vec_id % 2 AS INTEGER) AS species FROM embeddings)"""

D2 = "((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+(b.z-a.z)*(b.z-a.z))"

# undirected pairs closer than BOND, and both directions of them
PAIRS = f"""pairs AS (SELECT a.frame, a.pid AS p, b.pid AS q, b.x-a.x AS dx, b.y-a.y AS dy, b.z-a.z AS dz, {D2} AS d2
  FROM p a JOIN p b ON a.frame = b.frame AND a.pid < b.pid WHERE {D2} < {BOND}*{BOND})"""
EDGES = """e AS (SELECT frame, p, q, dx, dy, dz, d2 FROM pairs UNION ALL
  SELECT frame, q, p, -dx, -dy, -dz, d2 FROM pairs)"""
WITH_EDGES = f"WITH {P}, {PAIRS}, {EDGES}"


def days(spark: SparkSession, d: str) -> DataFrame:
    """One row per user and day: uid, frame, x = smallest value, y = events, z = largest value."""
    return (table(spark, d, "events")
            .select(F.col("user_id").alias("uid"),
                    F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("frame"), "value")
            .groupBy("uid", "frame").agg(F.min("value").alias("x"), F.count("*").cast("double").alias("y"),
                                         F.max("value").alias("z")))


DAYS = """d AS (SELECT user_id AS uid, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS frame,
  MIN(value) AS x, CAST(COUNT(*) AS DOUBLE) AS y, MAX(value) AS z FROM events GROUP BY 1, 2)"""


def tracks(spark: SparkSession, d: str) -> DataFrame:
    """Unbroken runs of days: tr = uid * TRACK + first day + TRACK / 2, apart for 2,700 years around the first day.

    Written once: the queries join the table with itself, and it is far smaller than the events.
    """
    from ..operators.select import contiguous
    from ..scratch import materialize
    runs = contiguous(materialize(days(spark, d), "days"), ["uid"])
    return materialize(runs.select((F.col("uid").cast("long") * TRACK + F.col("t_start") + TRACK // 2).alias("tr"), "frame", "x", "y", "z"), "tracks")


T = DAYS + """, di AS (SELECT *, frame - row_number() OVER (PARTITION BY uid ORDER BY frame) AS isl FROM d),
t AS (SELECT uid * 1000000 + min(frame) OVER (PARTITION BY uid, isl) + 500000 AS tr, frame, x, y, z FROM di)"""

T_PAIRS = f"""tp AS (SELECT a.frame, a.tr AS low, b.tr AS high FROM t a JOIN t b ON a.frame = b.frame AND a.tr < b.tr
  WHERE {D2} < {T_BOND}*{T_BOND})"""


def track_bonds(spark: SparkSession, d: str, of: DataFrame | None = None) -> DataFrame:
    """Pairs of tracks closer than T_BOND in the same frame: frame, low, high.  ``of``: tracks the caller has already."""
    from ..operators.spatial import bonds
    from ..scratch import materialize
    return materialize(bonds(tracks(spark, d) if of is None else of, T_BOND, id_col="tr").select("frame", "low", "high"), "bonds")
