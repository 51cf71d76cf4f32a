"""Thermodynamics, optics of blurred spheres, rheology, fits, Voronoi cells."""

import math

from pyspark.sql import functions as F

from ..functions import curves, optics, thermo
from ..operators import dynamics as D, pairs, spatial, voronoi
from . import pipelines
from .catalog import query, r6, rounded, s6
from .dynamics import LAGGED, Q
from .spatial import BINS, CUT, RDF
from .tables import D2, P, T, positions, table, tracks

MIX = "m AS (SELECT p_partkey, p_size/60.0::DOUBLE AS f, p_retailprice/4000.0::DOUBLE AS q, 1 + p_size/10.0::DOUBLE AS piv FROM part)"


def _mix(spark, d):
    return table(spark, d, "part").select("p_partkey", (F.col("p_size") / 60.0).alias("f"), (F.col("p_retailprice") / 4000.0).alias("q"),
                                          (1 + F.col("p_size") / 10.0).alias("piv"))


@query(f"""WITH {MIX}, b AS (SELECT *, (1+q)*(1+q)*(1+q)-1 AS a, 3*q*q*(q+1.5) AS bb, q*q*q AS c FROM m),
 e AS (SELECT *, exp(-(a*f+bb*f*f+c*f*f*f)) AS beta, a+2*bb*f+3*c*f*f AS d1 FROM b),
 v AS (SELECT p_partkey, f, f/(1+f)*(1+4*f+6*f*f+2*f*f*f) + piv*(beta + f*d1*beta) AS pv,
  ln(f) - ln(1+f) + 8*f + 7*f*f + 2*f*f*f + piv*(beta + (1+f)*d1*beta) AS mu FROM e)
 SELECT p_partkey, {s6('pv')} AS pv, {s6('mu')} AS mu, {s6('f/(1+f)*mu - pv')} AS omega FROM v""")
def mixture_pressure(spark, d):
    rows = thermo.evaluate(_mix(spark, d), thermo.CARNAHAN_STARLING)
    return rounded(rows.select("p_partkey", "pv", "mu", "omega"), "pv", "mu", "omega")


def _poly(coefs, v):
    return " + ".join(f"({c!r})*power({v}, {i})" for i, c in enumerate(coefs))


@query(f"""WITH {MIX} SELECT p_partkey, {s6('(5*f*f*f*f+25*f*f*f+30*f*f+15*f+3)/(3*f+3)')} AS kolafa,
 {s6('ln(f) + (-8*ln(1+f) + 5 - 4/(f+1) + 25*f + 45*f*f/2 + 5*f*f*f)/3')} AS kolafa_mu, {s6(f'3/(1/f - 1/{thermo.F_CP!r})')} AS hall_pv,
 {s6(f'({_poly(thermo.LEFEVRE_P, "(f/2)")})/({_poly(thermo.LEFEVRE_Q, "(f/2)")})')} AS le_fevre_pv,
 {s6(f'1 + h*{thermo.LIU_QZ_SCALE!r}/({_poly(thermo.LIU_QZ, "h")}) + {thermo.LIU_CS[0]!r}*h/(1-{thermo.LIU_A!r}*h) + ({thermo.LIU_CS[1]!r}+{thermo.LIU_CS[2]!r}*h*h+{thermo.LIU_CS[3]!r}*power(h,4))*power(h,40)')} AS liu
 FROM (SELECT *, (f/2)/(1+f/2) AS h FROM m)""")
def equations_of_state(spark, d):
    f = F.col("f")
    return _mix(spark, d).select(
        "p_partkey", r6(thermo.KOLAFA.compressibility(f)).alias("kolafa"), r6(thermo.KOLAFA.bare_potential(f, F)).alias("kolafa_mu"),
        r6(thermo.HALL.bare_pressure(f, F)).alias("hall_pv"), r6(thermo.LE_FEVRE.bare_pressure(f / 2, F)).alias("le_fevre_pv"), r6(thermo.LIU.compressibility(f / 2)).alias("liu"))


@query()
def phase_boundaries(spark, d):
    rows = table(spark, d, "part").groupBy("p_brand").agg((0.4 + F.avg("p_size") / 100).alias("q"), (F.max("p_size") * 1.0).alias("piv"))
    out = thermo.phase_boundaries(rows.select("q", "piv"), thermo.CARNAHAN_STARLING, thermo.HALL)
    return out.select(*[F.round(c, 5).alias(c) for c in out.columns])


def _fac(ndim, n=3.0):
    return math.sqrt(2 * ndim * math.log(2) / n / (2 ** (2 / n) - 1))


@query(f"""WITH s AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS r FROM part) SELECT p_partkey,
 {s6(f'ln(r/(1.6*{_fac(3)!r}))*3/ln(2) - 1')} AS scale, {s6(f'power(2, (r/10+1)/3)*1.6*{_fac(2)!r}')} AS radius,
 {s6(f'r*{math.sqrt(6 * math.log(2) / 3 / (1 - 2 ** (-2 / 3)))!r}')} AS from_sigma, {s6('-r*r*r/16*sqrt(2/pi())*exp(-r*r/8)')} AS ds FROM s""")
def scale_conversions(spark, d):
    r = F.col("p_size").cast("double")
    return table(spark, d, "part").select(
        "p_partkey", r6(optics.radius_to_scale(r)).alias("scale"), r6(optics.scale_to_radius(r / 10, ndim=2)).alias("radius"),
        r6(optics.sigma_to_radius(r)).alias("from_sigma"), r6(optics.Blur(r, 2.0).by_sigma()).alias("ds"))


def _spots(spark, d):
    pos = positions(spark, d).select("frame", "pid", *[(F.col(c) * 200).alias(c) for c in "xyz"], (F.col("r") * 100 + 1).alias("r"), (-1 - F.abs("f")).alias("intensity"))
    pos = pos.withColumn("sigma", optics.radius_to_sigma("r"))
    bonds = spatial.bonds(pos, 24.0).where("d2 > 64").withColumn("d", F.sqrt("d2")).select("frame", "low", "high", "d")
    return pos, bonds


@query()
def corrected_intensities(spark, d):
    return rounded(optics.solve_intensities(*_spots(spark, d)), "v")


@query()
def corrected_radii(spark, d):
    return rounded(optics.global_rescale(*_spots(spark, d)), "r")


@query(f"""WITH {T}, {LAGGED}, c AS (SELECT lag, avg(d2) AS msd FROM lg GROUP BY 1) SELECT {s6('exp(avg(ln(msd) - ln(6*lag)))')} AS d FROM c""")
def diffusion_fit(spark, d):
    t = tracks(spark, d)
    msd = D.time_functions(t, D.all_lags(t), q=Q).select("lag", "msd")
    return rounded(curves.fit(msd, "diffusion", "lag", "msd"), "d")


@query(f"""WITH {T}, {LAGGED}, c AS (SELECT tr, lag, ln(avg(d2)) - ln(6*lag) AS v FROM lg GROUP BY 1, 2 HAVING avg(d2) > 0)
 SELECT tr, {s6('exp(avg(v))')} AS d, {s6('sum(v*v) - avg(v)*sum(v)')} AS squares, count(*) AS n, true AS converged FROM c GROUP BY 1""")
def diffusion_by_trajectory(spark, d):
    """One curve per trajectory, all fitted at once."""
    t = tracks(spark, d)
    msd = D.lag_pairs(t, D.all_lags(t), ["x", "y", "z"]).groupBy("tr", "lag").agg(F.avg(sum((F.col(f"{c}1") - F.col(f"{c}0")) ** 2 for c in "xyz")).alias("msd"))
    return rounded(curves.fit_curves(msd, "diffusion", "lag", "msd", by=["tr"]), "d", "squares")


@query()
def relaxation_fit(spark, d):
    t = tracks(spark, d)
    isf = D.time_functions(t, D.all_lags(t), q=Q / 4).select("lag", "isf")
    fitted = curves.fit_curves(isf, "decay", "lag", "isf", start=[0.95, 10.0, 1.0])
    return fitted.select(*[F.round(c, 3).alias(c) for c in ("plateau", "tau", "beta")], "converged")


def _parabola(source: str, width: float) -> str:
    """Level, slope and bend at every (x, y) of a table: weighted parabolas in ln x, ln y by Cramer's rule."""
    return f"""(SELECT x, y, exp((t0*(s2*s4-s3*s3) - s1*(t1*s4-s3*t2) + s2*(t1*s3-s2*t2))/det) AS level, (s0*(t1*s4-t2*s3) - t0*(s1*s4-s2*s3) + s2*(s1*t2-s2*t1))/det AS slope,
  2*(s0*(s2*t2-s3*t1) - s1*(s1*t2-s2*t1) + t0*(s1*s3-s2*s2))/det AS bend FROM (SELECT *, s0*(s2*s4-s3*s3) - s1*(s1*s4-s2*s3) + s2*(s1*s3-s2*s2) AS det FROM (
  SELECT x, y, sum(w) AS s0, sum(w*t) AS s1, sum(w*t*t) AS s2, sum(w*t*t*t) AS s3, sum(w*t*t*t*t) AS s4, sum(w*v) AS t0, sum(w*t*v) AS t1, sum(w*t*t*v) AS t2
  FROM (SELECT x, y, t, v, exp(-t*t/{width * width!r}) AS w FROM (SELECT a.x, a.y, ln(b.x) - ln(a.x) AS t, ln(b.y) AS v FROM {source} a, {source} b)
   WHERE abs(t) < {width * math.sqrt(-2 * math.log(curves.WEIGHT_FLOOR))!r}) GROUP BY 1, 2)))"""


@query(f"""WITH {T}, {LAGGED}, c AS (SELECT lag*0.1::DOUBLE AS x, avg(d2)*1e-12 AS y FROM lg
  WHERE lag IN (SELECT CAST(round(exp(ln(m) * i / 15.0::DOUBLE)) AS INTEGER) FROM (SELECT max(lag) AS m FROM lg), range(16) r(i)) GROUP BY lag HAVING avg(d2) > 0),
g AS (SELECT 1/x AS x, {3 * curves.BOLTZMANN * 300.0 / (3 * math.pi * 0.5e-6)!r}/(level*gamma(1+slope)*(1+bend/2)) AS y FROM {_parabola('c', 0.7)} WHERE slope > -1 AND bend > -2),
m AS (SELECT x, y, level/(1+bend)*(cos(slope*pi()/2) - bend*(pi()/2-1)*slope) AS s, level/(1+bend)*(sin(slope*pi()/2) - bend*(pi()/2-1)*(1-slope)) AS l FROM {_parabola('g', 0.7)})
SELECT {s6('x')} AS omega, {s6('CASE WHEN s < 0.03*y THEN 0 ELSE s END*1e6')} AS storage, {s6('CASE WHEN l < 0.03*y THEN 0 ELSE l END*1e6')} AS loss FROM m""")
def moduli_from_msd(spark, d):
    t = tracks(spark, d)
    msd = D.time_functions(t, D.log_spaced(D.longest_lag(t), 16), q=Q).select("lag", "msd")
    out = curves.microrheology(msd, 0.1, 0.5, 300.0)
    return out.select(r6("omega").alias("omega"), r6(F.col("storage") * 1e6).alias("storage"), r6(F.col("loss") * 1e6).alias("loss"))


TOT = f"WITH {P}, {RDF}, tot AS (SELECT bin, avg(r) AS r, avg(g) AS g FROM rdf GROUP BY 1)"


@query(TOT + f""", t AS (SELECT *, r >= (SELECT (min(r)+max(r))/2 FROM tot) AS up FROM tot), l AS (SELECT regr_slope(g, r) FILTER (WHERE up) AS b, regr_intercept(g, r) FILTER (WHERE up) AS a FROM t)
 SELECT bin, {s6('g/(a+b*r)')} AS g FROM t, l""")
def normalised_rdf(spark, d):
    total = pairs.mean_rdf(pairs.rdf(positions(spark, d), CUT, BINS, margin=0.1))
    return rounded(curves.normalise_by_tail(total, "r", "g").select("bin", "g"), "g")


@query(f"WITH {P} SELECT frame, pid, {s6(f'pi()*2.00139e-3*power(r*1e-5, 3)/({curves.BOLTZMANN!r}*301.15)')} AS tau FROM p")
def brownian_times(spark, d):
    return positions(spark, d).select("frame", "pid", r6(curves.brownian_time(F.col("r") * 1e-5)).alias("tau"))


@query(f"WITH {P} SELECT frame, count(*) AS n, {s6('(max(x)-min(x)+0.02)*(max(y)-min(y)+0.02)*(max(z)-min(z)+0.02)')} AS volume FROM p GROUP BY 1")
def voronoi_volume_sum(spark, d):
    cells = voronoi.voronoi(positions(spark, d), 0.2, margin=0.01)
    return cells.groupBy("frame").agg(F.count("*").alias("n"), r6(F.sum("volume")).alias("volume"))


# cells by what all planes leave of the line in which two of them meet; every particle of the frame gives a plane
VORONOI = f"""WITH RECURSIVE {P}, bx AS (SELECT frame, min(x)-0.01::DOUBLE AS x0, max(x)+0.01::DOUBLE AS x1, min(y)-0.01::DOUBLE AS y0, max(y)+0.01::DOUBLE AS y1, min(z)-0.01::DOUBLE AS z0, max(z)+0.01::DOUBLE AS z1 FROM p GROUP BY 1),
pl AS (SELECT frame, p, q, dx/d AS nx, dy/d AS ny, dz/d AS nz, d/2 AS h FROM (SELECT a.frame, a.pid AS p, b.pid AS q, b.x-a.x AS dx, b.y-a.y AS dy, b.z-a.z AS dz, sqrt({D2}) AS d
  FROM p a JOIN p b ON a.frame = b.frame AND a.pid <> b.pid)
 UNION ALL SELECT p.frame, p.pid, w.q, w.nx, w.ny, w.nz, [x-x0, x1-x, y-y0, y1-y, z-z0, z1-z][-w.q] FROM p JOIN bx USING (frame),
  (VALUES (-1, -1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), (-2, 1.0, 0.0, 0.0), (-3, 0.0, -1.0, 0.0), (-4, 0.0, 1.0, 0.0), (-5, 0.0, 0.0, -1.0), (-6, 0.0, 0.0, 1.0)) w(q, nx, ny, nz)),
ln AS (SELECT *, ka*nxa+kb*nxb AS ax, ka*nya+kb*nyb AS ay, ka*nza+kb*nzb AS az, (nya*nzb-nza*nyb)/sqrt(s2) AS ux, (nza*nxb-nxa*nzb)/sqrt(s2) AS uy, (nxa*nyb-nya*nxb)/sqrt(s2) AS uz
 FROM (SELECT *, (ha-g*hb)/s2 AS ka, (hb-g*ha)/s2 AS kb FROM (SELECT *, 1-g*g AS s2 FROM (SELECT a.frame, a.p, a.q AS qa, b.q AS qb, a.h AS ha, b.h AS hb, a.nx AS nxa, a.ny AS nya, a.nz AS nza, b.nx AS nxb, b.ny AS nyb, b.nz AS nzb,
  a.nx*b.nx+a.ny*b.ny+a.nz*b.nz AS g FROM pl a JOIN pl b ON a.frame = b.frame AND a.p = b.p AND a.q < b.q)) WHERE s2 > 1e-12)),
ed AS (SELECT frame, p, qa, qb, max(gap/slope) FILTER (slope < -1e-12) AS low, min(gap/slope) FILTER (slope > 1e-12) AS high, any_value(ha) AS ha, any_value(hb) AS hb, any_value(g) AS g, any_value(s2) AS s2
 FROM (SELECT ln.*, h, nx*ux+ny*uy+nz*uz AS slope, h-(nx*ax+ny*ay+nz*az) AS gap FROM ln JOIN pl ON ln.frame = pl.frame AND ln.p = pl.p AND pl.q <> qa AND pl.q <> qb)
 GROUP BY 1, 2, 3, 4 HAVING high > low AND NOT bool_or(abs(slope) <= 1e-12 AND gap < -1e-9*(ha+hb+h))),
fc AS (SELECT frame, p, q, any_value(h) AS h, sum(a) AS area FROM (SELECT frame, p, qa AS q, ha AS h, 0.5*(high-low)*(hb-g*ha)/sqrt(s2) AS a FROM ed
  UNION ALL SELECT frame, p, qb, hb, 0.5*(high-low)*(ha-g*hb)/sqrt(s2) FROM ed) GROUP BY 1, 2, 3),
cell AS (SELECT frame, p, sum(h*area)/3 AS volume, bool_or(q < 0 AND area > 1e-12) AS walled FROM fc GROUP BY 1, 2),
nb AS (SELECT frame, p, q, area FROM fc WHERE q >= 0 AND area > 1e-12)"""


@query(VORONOI + f""", lv AS (SELECT frame, p, 0 AS ring FROM cell WHERE NOT walled UNION SELECT nb.frame, nb.p, greatest(ring, 0) + 1 FROM lv JOIN nb ON lv.frame = nb.frame AND lv.p = nb.q WHERE ring < 12),
r AS (SELECT frame, p, greatest(min(ring), 1) AS ring FROM lv GROUP BY 1, 2),
v AS (SELECT frame, p, 1 AS ring, avg(volume) AS volume FROM (SELECT nb.frame, nb.p, volume FROM nb JOIN cell c ON c.frame = nb.frame AND c.p = nb.q WHERE NOT walled UNION ALL SELECT frame, p, volume FROM cell WHERE NOT walled) GROUP BY 1, 2
 UNION ALL SELECT nb.frame, nb.p, any_value(v.ring) + 1, avg(v.volume) FROM v JOIN nb ON v.frame = nb.frame AND v.p = nb.q JOIN r ON r.frame = nb.frame AND r.p = nb.p AND r.ring = v.ring + 1 GROUP BY 1, 2)
SELECT v.frame, v.p, {s6('v.volume')} AS volume, {s6('4.0/3*pi()*p.r*p.r*p.r/cell.volume')} AS phi FROM v JOIN cell ON v.frame = cell.frame AND v.p = cell.p JOIN p ON p.frame = v.frame AND p.pid = v.p""")
def voronoi_coarse_grained(spark, d):
    cells = voronoi.voronoi(positions(spark, d), 0.2, margin=0.01)
    phi = pipelines.volume_fraction(cells, positions(spark, d))
    return rounded(voronoi.coarse_grained_volume(cells).join(phi, ["frame", "p"]), "volume", "phi")


@query(VORONOI + f" SELECT frame, p, q, {s6('area')} AS area FROM nb")
def voronoi_neighbours(spark, d):
    cells = voronoi.voronoi(positions(spark, d), 0.2, margin=0.01)
    return rounded(voronoi.voronoi_edges(cells), "area")


@query(VORONOI + f" SELECT frame, p, {s6('volume')} AS volume, (SELECT count(*) FROM fc WHERE fc.frame = cell.frame AND fc.p = cell.p AND area > 1e-12) AS faces, walled FROM cell")
def voronoi_volumes(spark, d):
    """Volume of every cell, its faces, and whether it touches a wall."""
    cells = voronoi.voronoi(positions(spark, d), 0.2, margin=0.01)
    return cells.select("frame", "p", r6("volume").alias("volume"), F.size("faces").cast("long").alias("faces"), F.exists("faces", lambda f: f["q"] < 0).alias("walled"))
