"""Trajectories: selections, lag statistics, drift, windows, correlations."""

import math

from pyspark.sql import functions as F

from ..operators import dynamics as D, fields, select, spatial, order
from .catalog import query, rounded, s3, s6
from .tables import D2, DAYS, T, T_BOND, T_PAIRS, TRACK, days, tracks

Q = math.pi / 25.0
SHIFT = "CAST(b.frame - a.frame AS INTEGER) AS lag, b.x-a.x AS dx, b.y-a.y AS dy, b.z-a.z AS dz"
LAGGED = f"""lg AS (SELECT a.tr, a.frame, {SHIFT}, {D2} AS d2, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1 FROM t a JOIN t b ON a.tr = b.tr AND b.frame > a.frame)"""


@query(f"WITH {DAYS} SELECT uid, frame, {s6('x')} AS x, y, {s6('z')} AS z FROM d")
def daily_positions(spark, d):
    return rounded(days(spark, d), "x", "z")


@query(f"WITH {T} SELECT tr, min(frame) AS t_start, max(frame) AS t_last, count(*) AS n FROM t GROUP BY 1")
def trajectory_spans(spark, d):
    return select.spans(tracks(spark, d))


@query(f"WITH {T} SELECT tr, frame FROM t WHERE frame BETWEEN 5 AND 15 AND tr IN (SELECT tr FROM t GROUP BY 1 HAVING min(frame) <= 5 AND max(frame) >= 15)")
def spanning_trajectories(spark, d):
    return select.spanning_tracks(tracks(spark, d), 5, 15).select("tr", "frame")


@query(f"""WITH {T} SELECT tr FROM t GROUP BY 1 HAVING min(frame) <= 5 AND max(frame) >= 10 AND
 bool_and(frame NOT BETWEEN 5 AND 10 OR (x BETWEEN 0 AND 90 AND y BETWEEN 1 AND 5 AND z BETWEEN 0 AND 250))""")
def spanning_inside_box(spark, d):
    return select.always_enclosed(tracks(spark, d), 5, 10, [0.0, 1.0, 0.0], [90.0, 5.0, 250.0])


@query(f"""WITH {T} SELECT 'all' AS how, tr FROM t GROUP BY tr HAVING bool_and(z BETWEEN 20 AND 200) UNION ALL
 SELECT 'any', tr FROM t GROUP BY tr HAVING bool_or(z BETWEEN 20 AND 200)""")
def z_slab_trajectories(spark, d):
    t = tracks(spark, d)
    return (select.z_slab(t, 20, 200, "all").select(F.lit("all").alias("how"), "tr")
            .union(select.z_slab(t, 20, 200, "any").select(F.lit("any").alias("how"), "tr")))


@query(f"""WITH {T} SELECT tr FROM t GROUP BY 1 HAVING min(frame) <= 5 AND max(frame) >= 10 AND bool_and(frame NOT BETWEEN 5 AND 10 OR x < 120)
 AND min(z) FILTER (WHERE frame BETWEEN 5 AND 10) <= 60 AND max(z) FILTER (WHERE frame BETWEEN 5 AND 10) >= 30""")
def region_of_interest_trajectories(spark, d):
    t = tracks(spark, d).withColumn("inside", F.col("x") < 120)
    return select.roi_trajectories(t, 5, 10, 30, 60)


@query(f"WITH {T} SELECT tr, frame FROM t WHERE tr NOT IN (SELECT tr FROM t WHERE floor(x/10) = 0)")
def trajectories_without_null_field(spark, d):
    t = tracks(spark, d).withColumn("v", F.floor(F.col("x") / 10).cast("double"))
    return select.exclude_zero(t, "v").select("tr", "frame")


@query(f"""WITH {T}, iv AS (SELECT CAST(i AS INTEGER) AS t0, CAST(i+4 AS INTEGER) AS t1 FROM (SELECT unnest(range(min(frame), max(frame) + 1, 3)) AS i, max(frame) AS last FROM t) WHERE i+4 <= last),
 s AS (SELECT tr, min(frame) AS a, max(frame) AS b FROM t GROUP BY 1)
 SELECT t0, t1, count(tr) AS n FROM iv LEFT JOIN s ON a <= t0 AND b >= t1 GROUP BY 1, 2""")
def spanning_per_interval(spark, d):
    return select.spanning_per_interval(tracks(spark, d), 3, 5)


@query(f"WITH {T}, o AS (SELECT uid, frame, z FROM d) SELECT t.tr, t.frame, o.uid AS pid, {s6('o.z')} AS z FROM t JOIN o ON o.uid = t.tr // 1000000 AND o.frame = t.frame")
def rekey_by_trajectory(spark, d):
    field = days(spark, d).select("frame", F.col("uid").alias("pid"), "z")
    traj = tracks(spark, d).select("tr", "frame", F.floor(F.col("tr") / TRACK).alias("pid"))
    back = select.by_position(select.by_trajectory(field, traj), traj)
    return rounded(back.join(traj, ["frame", "pid"]).select("tr", "frame", "pid", "z"), "z")


@query(f"WITH {T}, l AS (SELECT tr, count(*) AS length FROM t GROUP BY 1) SELECT t.frame, l.length, count(*) AS n FROM t JOIN l USING (tr) GROUP BY 1, 2")
def trajectory_length_per_frame(spark, d):
    return fields.lengths(tracks(spark, d)).groupBy("frame", "length").agg(F.count("*").alias("n"))


@query(f"""WITH {T}, s AS (SELECT tr, min(frame) AS a, max(frame) AS b FROM t GROUP BY 1), f AS (SELECT a AS frame FROM s UNION SELECT b FROM s)
 SELECT frame, (SELECT count(*) FROM s WHERE a = frame) AS created, (SELECT count(*) FROM s WHERE b = frame) AS ended FROM f""")
def births_and_deaths(spark, d):
    return fields.births_and_deaths(tracks(spark, d))


# --- lags --------------------------------------------------------------------------------------------

@query(f"WITH {T}, {LAGGED} SELECT lag, count(*) AS n FROM lg GROUP BY 1")
def time_lag_pairs(spark, d):
    t = tracks(spark, d)
    return D.lag_pairs(t, D.all_lags(t), ["x"]).groupBy("lag").agg(F.count("*").alias("n"))


DYN = f"""SELECT lag, count(*) AS n, {s3('avg(d2)')} AS msd, {s6('3*avg(d2*d2)/(5*avg(d2)*avg(d2)) - 1')} AS ngp,
 {', '.join(f"{s6(f'avg(cos(d{c}*{Q!r}))')} AS isf_{c}" for c in 'xyz')},
 {s6('(' + '+'.join(f'avg(cos(d{c}*{Q!r}))' for c in 'xyz') + ')/3')} AS isf"""


@query(f"WITH {T}, {LAGGED} {DYN}, {s6('avg(CASE WHEN d2 < 400 THEN 1.0 ELSE 0.0 END)')} AS overlap FROM lg GROUP BY 1")
def dynamics_all_lags(spark, d):
    t = tracks(spark, d)
    table = D.time_functions(t, D.all_lags(t), q=Q, overlap=20.0)
    return rounded(rounded(table, "ngp", "isf_x", "isf_y", "isf_z", "isf", "overlap"), "msd", digits=3)


@query(f"""WITH {T}, {LAGGED}, sp AS (SELECT tr FROM t GROUP BY 1 HAVING min(frame) <= 5 AND max(frame) >= 20)
 {DYN} FROM lg WHERE frame >= 5 AND frame + lag <= 20 AND tr IN (SELECT tr FROM sp) GROUP BY 1""")
def dynamics_spanning(spark, d):
    t = select.spanning_tracks(tracks(spark, d), 5, 20)
    return rounded(rounded(D.time_functions(t, list(range(1, 16)), q=Q), "ngp", "isf_x", "isf_y", "isf_z", "isf"), "msd", digits=3)


@query(f"""WITH {T}, s AS (SELECT *, CASE WHEN frame < 15 THEN 0 ELSE 1 END AS set_id FROM t), lg AS (SELECT a.tr, a.set_id, {SHIFT}, {D2} AS d2
 FROM s a JOIN s b ON a.tr = b.tr AND a.set_id = b.set_id AND b.frame - a.frame BETWEEN 1 AND 10)
 {DYN.replace('SELECT lag', 'SELECT set_id, lag')} FROM lg GROUP BY 1, 2""")
def dynamics_by_age(spark, d):
    t = tracks(spark, d).withColumn("set_id", F.when(F.col("frame") < 15, 0).otherwise(1))
    aged = D.time_functions(t, list(range(1, 11)), q=Q, keys=("set_id", "tr"), by=("set_id",))
    return rounded(rounded(aged, "ngp", "isf_x", "isf_y", "isf_z", "isf"), "msd", digits=3)


@query(f"""WITH {T}, {LAGGED}, sp AS (SELECT tr, max(frame) AS last FROM t GROUP BY 1)
 SELECT lag, count(*) AS n, {s3('avg(d2)')} AS msd FROM lg JOIN sp USING (tr) WHERE frame BETWEEN 2 AND 6 AND last >= frame+14 AND lag <= 14 GROUP BY 1""")
def msd_from_starts(spark, d):
    return rounded(D.msd_from_starts(tracks(spark, d), 2, 20, 5), "msd", digits=3)


@query(f"""WITH {T}, {LAGGED}, i AS (SELECT lag, avg(cos(dx*{Q!r})) AS isf FROM lg GROUP BY 1)
 SELECT coalesce(min(lag) FILTER (WHERE isf < 0.3), max(lag)) AS tau FROM i""")
def relaxation_time(spark, d):
    t = tracks(spark, d)
    isf = D.time_functions(t, D.all_lags(t), q=Q)
    return D.relaxation_time(isf, 0.3, "isf_x")


@query(f"WITH {T}, {LAGGED} SELECT lag, count(*) AS n, {s3('avg(d2)')} AS msd FROM lg WHERE lag IN (SELECT CAST(round(exp(ln(m) * i / 9.0::DOUBLE)) AS INTEGER) FROM (SELECT max(lag) AS m FROM lg), range(10) r(i)) GROUP BY 1")
def msd_log_spaced(spark, d):
    t = tracks(spark, d)
    table = D.time_functions(t, D.log_spaced(D.longest_lag(t), 10), q=Q)
    return rounded(table.select("lag", "n", "msd"), "msd", digits=3)


# --- drift -------------------------------------------------------------------------------------------

DRIFT = f"""dr AS (SELECT f.frame, count(b.tr) AS n, {', '.join(f"CASE WHEN count(b.tr) >= 2 THEN avg(b.{c}-a.{c}) ELSE 0 END AS d{c}" for c in 'xyz')}
  FROM (SELECT DISTINCT frame FROM t) f LEFT JOIN (t b JOIN t a ON a.tr = b.tr AND a.frame = b.frame-1) ON b.frame = f.frame GROUP BY 1),
 cu AS (SELECT frame, {', '.join(f"sum(d{c}) OVER (ORDER BY frame) AS d{c}" for c in 'xyz')} FROM dr),
 cm AS (SELECT frame, {', '.join(f"d{c} - min(d{c}) OVER () AS d{c}" for c in 'xyz')} FROM cu)"""


@query(f"WITH {T}, {DRIFT} SELECT frame, n, {', '.join(f'{s6(f'd{c}')} AS d{c}' for c in 'xyz')} FROM dr")
def drift_per_frame(spark, d):
    return rounded(D.drift(tracks(spark, d)), "dx", "dy", "dz")


@query(f"WITH {T}, {DRIFT} SELECT t.tr, t.frame, {', '.join(f'{s6(f't.{c} - cm.d{c}')} AS {c}' for c in 'xyz')} FROM t JOIN cm USING (frame)")
def drift_removed(spark, d):
    return rounded(D.remove_drift(tracks(spark, d)).select("tr", "frame", "x", "y", "z"), "x", "y", "z")


@query(f"""WITH {T} SELECT tr, frame, {', '.join(f'{s6(f'{c} - avg({c}) OVER (PARTITION BY frame)')} AS {c}' for c in 'xyz')} FROM t""")
def centred_frames(spark, d):
    return rounded(D.centre_frames(tracks(spark, d)).select("tr", "frame", "x", "y", "z"), "x", "y", "z")


# --- windows along trajectories ----------------------------------------------------------------------

WIN = "PARTITION BY tr ORDER BY frame RANGE BETWEEN"


@query(f"WITH {T}, v AS (SELECT *, floor(x/10) AS v FROM t) SELECT tr, frame, {s6(f'avg(nullif(v, 0)) OVER ({WIN} 3 PRECEDING AND 3 FOLLOWING)')} AS v_mean FROM v")
def centred_running_mean(spark, d):
    t = tracks(spark, d).withColumn("v", F.floor(F.col("x") / 10).cast("double"))
    return rounded(fields.running_mean(t, "v", 7).select("tr", "frame", "v_mean"), "v_mean")


@query(f"""WITH {T}, w AS (SELECT tr, frame, avg(x) OVER ({WIN} CURRENT ROW AND 3 FOLLOWING) AS m, count(*) OVER ({WIN} CURRENT ROW AND 3 FOLLOWING) AS n FROM t)
 SELECT tr, frame, {s6('m')} AS x_mean FROM w WHERE n = 4""")
def sliding_forward_mean(spark, d):
    return rounded(fields.forward_mean(tracks(spark, d), "x", 4).select("tr", "frame", "x_mean"), "x_mean")


@query(f"WITH {T} SELECT tr, CAST(frame // 5 AS INTEGER) AS block, {s6('avg(x)')} AS x_mean FROM t GROUP BY 1, 2 HAVING count(*) = 5")
def tumbling_block_mean(spark, d):
    return rounded(fields.block_mean(tracks(spark, d), "x", 5), "x_mean")


@query(f"""WITH {T}, w AS (SELECT tr, frame, {', '.join(f"last({c}) OVER w - first({c}) OVER w AS d{c}" for c in 'xyz')},
 nullif(last(frame) OVER w - first(frame) OVER w, 0) AS dt FROM t WINDOW w AS ({WIN} 2 PRECEDING AND 2 FOLLOWING))
 SELECT tr, frame, {', '.join(f'{s6(f'd{c}/dt')} AS v{c}' for c in 'xyz')} FROM w WHERE dt IS NOT NULL""")
def velocities(spark, d):
    v = fields.velocity(tracks(spark, d), 2).where("vx is not null")
    return rounded(v.select("tr", "frame", "vx", "vy", "vz"), "vx", "vy", "vz")


@query()
def cages_and_jumps(spark, d):
    caged = fields.cages(tracks(spark, d), 40.0, 4)
    return rounded(fields.jump_frequency(caged, 6), "jump_frequency")


# --- correlations ------------------------------------------------------------------------------------

@query(f"""WITH {T}, c AS (SELECT tr, frame, x - avg(x) OVER () AS v FROM t), z AS (SELECT avg(v*v) AS c0, count(*) AS n FROM c)
 SELECT CAST(b.frame-a.frame AS INTEGER) AS lag, count(*) AS n, {s6('avg(a.v*b.v)/(SELECT c0 FROM z)')} AS c FROM c a JOIN c b ON a.tr = b.tr AND b.frame >= a.frame GROUP BY 1""")
def time_correlation(spark, d):
    t = tracks(spark, d)
    return rounded(D.time_correlation(t, "x", D.all_lags(t)), "c")


@query(f"""WITH {T}, f AS (SELECT frame, count(*) AS n, sum(cos(x*{Q!r}+z*{Q!r})) AS a, sum(sin(x*{Q!r}+z*{Q!r})) AS b FROM t GROUP BY 1)
 SELECT CAST(v.frame-u.frame AS INTEGER) AS lag, count(*) AS n, {s6('avg((u.a*v.a+u.b*v.b)/u.n)')} AS isf FROM f u JOIN f v ON v.frame > u.frame GROUP BY 1""")
def collective_scattering(spark, d):
    t = tracks(spark, d)
    return rounded(D.collective_isf(t, D.all_lags(t, keys=()), [Q, 0.0, Q]), "isf")


@query(f"WITH {T}, {LAGGED} SELECT lag, CAST(floor(z0/50) AS INTEGER) AS bin, count(*) AS n, count(*) FILTER (WHERE d2 < 900) AS n_overlap FROM lg WHERE lag <= 5 GROUP BY 1, 2")
def overlap_by_height(spark, d):
    return D.overlap_by_bin(tracks(spark, d), [1, 2, 3, 4, 5], 30.0, width=50.0)


MOB = f"""lm AS (SELECT *, dx - avg(dx) OVER w AS ex, dy - avg(dy) OVER w AS ey, dz - avg(dz) OVER w AS ez FROM lg WHERE lag IN (1, 4) WINDOW w AS (PARTITION BY frame, lag)),
 u AS (SELECT tr, frame, lag, x0 AS x, y0 AS y, z0 AS z, ex*ex+ey*ey+ez*ez AS e2 FROM lm)"""
G4 = f"""SELECT a.lag, CAST(floor(sqrt({D2})) AS INTEGER) AS bin, count(*) AS n, {s6('sum(a.u*b.u)')} AS g4 FROM v a JOIN v b
 ON a.frame = b.frame AND a.lag = b.lag AND a.tr < b.tr WHERE {D2} < 100"""


@query(f"WITH {T}, {LAGGED}, {MOB}, v AS (SELECT *, exp(-e2/900) AS u FROM u) {G4} GROUP BY 1, 2")
def four_point_mobility(spark, d):
    return rounded(D.four_point(D.mobility(tracks(spark, d), [1, 4], 30.0), 10.0, 10), "g4")


@query(f"WITH {T}, {LAGGED}, {MOB}, v AS (SELECT *, CASE WHEN e2 < 900 THEN 1.0 ELSE 0.0 END AS u FROM u) {G4} AND abs(b.z-a.z) <= 2 GROUP BY 1, 2")
def four_point_overlap_slice(spark, d):
    return rounded(D.four_point(D.mobility(tracks(spark, d), [1, 4], 30.0, "overlap"), 10.0, 10, where=F.abs("dz") <= 2), "g4")


@query(f"""WITH {T}, s AS (SELECT a.tr, CAST(b.frame-a.frame AS INTEGER) AS lag, a.x, a.y, a.z, b.x-a.x AS ux, b.y-a.y AS uy, b.z-a.z AS uz
  FROM t a JOIN t b ON a.tr = b.tr AND b.frame - a.frame IN (1, 3) WHERE a.frame = 3),
 pr AS (SELECT a.lag, sqrt({D2}) AS r, b.x-a.x AS dx, b.y-a.y AS dy, b.z-a.z AS dz, a.ux, a.uy, a.uz, b.ux AS wx, b.uy AS wy, b.uz AS wz
  FROM s a JOIN s b ON a.lag = b.lag AND a.tr < b.tr WHERE {D2} < 400 AND {D2} >= 4),
 ax AS (SELECT *, dx/r AS nx, dy/r AS ny, dz/r AS nz, nullif(sqrt(dx*dx+dy*dy), 0) AS rho FROM pr),
 cc AS (SELECT lag, CAST(floor((ln(r)-ln(2.0::DOUBLE))/({math.log(10.0)!r}/8)) AS INTEGER) AS bin, (ux*nx+uy*ny+uz*nz)*(wx*nx+wy*ny+wz*nz) AS n1,
  (ux*dy/rho-uy*dx/rho)*(wx*dy/rho-wy*dx/rho) AS p1 FROM ax)
 SELECT lag, bin, count(*) AS n, {s3('sum(n1)')} AS sum_n, {s3('sum(p1)')} AS sum_p, {s3('sum(n1*n1)/1e6')} AS sq_n FROM cc GROUP BY 1, 2""")
def two_point_displacements(spark, d):
    table = D.two_point_displacements(tracks(spark, d), 3, [1, 3], 2.0, 20.0, 8)
    return rounded(table.select("lag", "bin", "n", "sum_n", "sum_p", (F.col("sq_n") / 1e6).alias("sq_n")), "sum_n", "sum_p", "sq_n", digits=3)


@query(f"""WITH {T}, {T_PAIRS}, e AS (SELECT tp.frame, low AS p, high AS q, b.x-a.x AS dx, b.y-a.y AS dy, b.z-a.z AS dz FROM tp
   JOIN t a ON a.tr = low AND a.frame = tp.frame JOIN t b ON b.tr = high AND b.frame = tp.frame),
 e2 AS (SELECT * FROM e UNION ALL SELECT frame, q, p, -dx, -dy, -dz FROM e), e3 AS (SELECT *, dx*dx+dy*dy+dz*dz AS d2 FROM e2),
 n AS (SELECT frame, p, count(*) AS n FROM e3 GROUP BY 1, 2),
 pr AS (SELECT u.p, u.frame, CAST(v.frame-u.frame AS INTEGER) AS lag, avg((3*power((u.dx*v.dx+u.dy*v.dy+u.dz*v.dz), 2)/(u.d2*v.d2) - 1)/2) AS c
  FROM e3 u JOIN e3 v ON u.p = v.p AND v.frame - u.frame BETWEEN 1 AND 5 GROUP BY 1, 2, 3)
 SELECT lag, count(*) AS n, {s6('avg(c)')} AS c FROM pr GROUP BY 1""")
def bond_order_time_correlation(spark, d):
    edges = spatial.neighbour_edges(tracks(spark, d), T_BOND, id_col="tr")
    q = order.qlm(edges, 2).withColumnRenamed("p", "tr")
    return rounded(D.qlm_time_correlation(q, 2, [1, 2, 3, 4, 5]), "c")
