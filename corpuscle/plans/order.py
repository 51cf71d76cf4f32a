"""Bond-orientational order.

The SQL never forms spherical harmonics: by the addition theorem, products of q_lm summed over m are double
sums of the Legendre polynomial P_l over bonds.  Only w_l needs the coefficients, written out for l = 4.
"""

from pyspark.sql import functions as F

from ..functions import harmonics as H
from ..operators import order, spatial, stats
from .catalog import query, rounded, s6
from .tables import BOND, D2, WITH_EDGES, positions

COS = "((u.dx*v.dx+u.dy*v.dy+u.dz*v.dz)/sqrt(u.d2*v.d2))"


def legendre(l: int, c: str = COS) -> str:
    """P_l as SQL, in powers of the squared cosine."""
    terms = {2: (3, -1, 2), 4: (35, -30, 3, 8), 6: (231, -315, 105, -5, 16), 8: (6435, -12012, 6930, -1260, 35, 128)}[l]
    *coefs, divisor = terms
    sq, out = f"({c})*({c})", str(float(coefs[0]))
    for k in coefs[1:]:
        out = f"({out})*{sq} + ({float(k)})"
    return f"(({out})/{float(divisor)})"


# q_l of a particle from pairs of its bonds
def q_sql(l):
    return f"""q{l} AS (SELECT u.frame, u.p, sqrt(greatest(0, avg({legendre(l)}))) AS q{l} FROM e u JOIN e v ON u.p = v.p GROUP BY 1, 2)"""


def edges(spark, d):
    return spatial.neighbour_edges(positions(spark, d), BOND)


@query(f"{WITH_EDGES}, {q_sql(6)}, n AS (SELECT p, count(*) AS n FROM e GROUP BY 1) SELECT frame, p, n, {s6('q6')} AS q6 FROM q6 JOIN n USING (p)")
def bond_order_q6(spark, d):
    return rounded(order.invariants(order.qlm_of_points(positions(spark, d), BOND, 6), 6, with_w=False), "q6")


@query(f"""{WITH_EDGES}, {q_sql(4)}, {q_sql(6)}, {q_sql(8)} SELECT frame, p, {s6('q4')} AS q4, {s6('q6')} AS q6, {s6('q8')} AS q8
 FROM q4 JOIN q6 USING (frame, p) JOIN q8 USING (frame, p)""")
def bond_order_cloud(spark, d):
    table = order.cloud(edges(spark, d), (4, 6, 8))
    return rounded(table.select("frame", "p", "q4", "q6", "q8"), "q4", "q6", "q8")


W4 = f"""{WITH_EDGES}, b AS (SELECT frame, p, dx/sqrt(d2) AS u, dy/sqrt(d2) AS v, dz/sqrt(d2) AS c FROM e),
 y AS (SELECT frame, p, 0 AS m, 3.0/16*sqrt(1/pi())*(35*c*c*c*c - 30*c*c + 3) AS re, 0.0::DOUBLE AS im FROM b
  UNION ALL SELECT frame, p, 1, -3.0/8*sqrt(5/pi())*u*(7*c*c*c - 3*c), -3.0/8*sqrt(5/pi())*v*(7*c*c*c - 3*c) FROM b
  UNION ALL SELECT frame, p, 2, 3.0/8*sqrt(5/(2*pi()))*(u*u-v*v)*(7*c*c-1), 3.0/8*sqrt(5/(2*pi()))*2*u*v*(7*c*c-1) FROM b
  UNION ALL SELECT frame, p, 3, -3.0/8*sqrt(35/pi())*(u*u*u-3*u*v*v)*c, -3.0/8*sqrt(35/pi())*(3*u*u*v-v*v*v)*c FROM b
  UNION ALL SELECT frame, p, 4, 3.0/16*sqrt(35/(2*pi()))*(u*u*u*u-6*u*u*v*v+v*v*v*v), 3.0/16*sqrt(35/(2*pi()))*4*u*v*(u*u-v*v) FROM b),
 half AS (SELECT frame, p, m, avg(re) AS re, avg(im) AS im FROM y GROUP BY 1, 2, 3),
 q AS (SELECT frame, p, m, re, im FROM half UNION ALL
  SELECT frame, p, -m, CASE WHEN m % 2 = 0 THEN re ELSE -re END, CASE WHEN m % 2 = 0 THEN -im ELSE im END FROM half WHERE m > 0),
 ms AS (SELECT a.m AS m1, b.m AS m2, -a.m-b.m AS m3 FROM (SELECT unnest(range(-4, 5)) AS m) a, (SELECT unnest(range(-4, 5)) AS m) b
  WHERE abs(a.m+b.m) <= 4),
 tj AS (SELECT m1, m2, m3, sum(CASE WHEN k % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END /
   (factorial(k::INT)::DOUBLE*factorial((4-k)::INT)::DOUBLE*factorial((4-m1-k)::INT)::DOUBLE*factorial((4+m2-k)::INT)::DOUBLE
    *factorial((m1+k)::INT)::DOUBLE*factorial((k-m2)::INT)::DOUBLE))
   * CASE WHEN m3 % 2 = 0 THEN 1 ELSE -1 END
   * sqrt(power(24.0, 3)/factorial(13)::DOUBLE*factorial((4+m1)::INT)::DOUBLE*factorial((4-m1)::INT)::DOUBLE*factorial((4+m2)::INT)::DOUBLE
     *factorial((4-m2)::INT)::DOUBLE*factorial((4+m3)::INT)::DOUBLE*factorial((4-m3)::INT)::DOUBLE) AS w
  FROM ms, range(0, 5) r(k) WHERE 4-m1-k >= 0 AND 4+m2-k >= 0 AND m1+k >= 0 AND k-m2 >= 0 GROUP BY 1, 2, 3),
 nn AS (SELECT frame, p, sum(re*re+im*im) AS n2 FROM q GROUP BY 1, 2),
 ws AS (SELECT a.frame, a.p, sum(w*((a.re*b.re-a.im*b.im)*c.re - (a.re*b.im+a.im*b.re)*c.im)) AS w
  FROM q a JOIN q b ON a.p = b.p JOIN q c ON a.p = c.p JOIN tj ON a.m = m1 AND b.m = m2 AND c.m = m3 GROUP BY 1, 2)
 SELECT ws.frame, ws.p, {s6('w/(n2*sqrt(n2))')} AS w4 FROM ws JOIN nn ON nn.p = ws.p"""


@query(W4)
def bond_order_w4(spark, d):
    return rounded(order.invariants(order.qlm(edges(spark, d), 4), 4).select("frame", "p", "w4"), "w4")


MEMBERS = """n AS (SELECT p, count(*) AS n FROM e GROUP BY 1),
 mem AS (SELECT frame, p, q AS k FROM e UNION ALL SELECT DISTINCT frame, p, p FROM e),
 mb AS (SELECT mem.frame, mem.p, e.dx, e.dy, e.dz, e.d2, 1.0/nk.n/(1+np.n) AS w FROM mem JOIN e ON e.p = mem.k
   JOIN n nk ON nk.p = mem.k JOIN n np ON np.p = mem.p)"""


@query(f"""{WITH_EDGES}, {MEMBERS} SELECT u.frame, u.p, {s6(f'sqrt(greatest(0, sum(u.w*v.w*{legendre(6)})))')} AS q6
 FROM mb u JOIN mb v ON u.p = v.p GROUP BY 1, 2""")
def coarse_grained_q6(spark, d):
    e = edges(spark, d)
    return rounded(order.invariants(order.coarse_grain(order.qlm(e, 6), e, 6), 6, with_w=False).select("frame", "p", "q6"), "q6")


@query(f"""{WITH_EDGES}, s AS (SELECT frame, p, dx, dy, dz, d2 FROM e UNION ALL
 SELECT b.frame, l.q, b.dx, b.dy, b.dz, b.d2 FROM pairs b JOIN e l ON l.p = b.p JOIN e h ON h.p = b.q AND h.q = l.q)
 SELECT u.frame, u.p, {s6(f'sqrt(greatest(0, avg({legendre(6)})))')} AS q6 FROM s u JOIN s v ON u.p = v.p GROUP BY 1, 2""")
def surface_bond_order(spark, d):
    q = order.surface_qlm(positions(spark, d), BOND, 6)
    return rounded(order.invariants(q, 6, with_w=False).select("frame", "p", "q6"), "q6")


@query(f"""{WITH_EDGES}, {q_sql(6)}, n AS (SELECT p, count(*) AS n FROM e GROUP BY 1),
 pr AS (SELECT e.frame, e.p, e.q, (SELECT avg({legendre(6)}) FROM e u, e v WHERE u.p = e.p AND v.p = e.q) AS s FROM e)
 SELECT pr.frame, pr.p, count(*) AS n, count(*) FILTER (WHERE round(s/(a.q6*b.q6), 9) > 0.5) AS n_x
 FROM pr JOIN q6 a ON a.p = pr.p JOIN q6 b ON b.p = pr.q GROUP BY 1, 2""")
def crystal_like_bonds(spark, d):
    return order.crystal_bonds_of_points(positions(spark, d), BOND, order.qlm(edges(spark, d), 6), 6, 0.5 + 5e-10)


@query(f"""{WITH_EDGES}, c AS (SELECT a.frame, a.pid AS p, b.pid AS q, {D2} AS d2 FROM p a JOIN p b ON a.frame = b.frame AND a.pid < b.pid
   WHERE {D2} < 0.25*0.25 AND a.pid IN (SELECT p FROM e) AND b.pid IN (SELECT p FROM e)),
 pr AS (SELECT c.frame, c.p, c.q, c.d2, avg({legendre(6)}) AS s FROM c JOIN e u ON u.p = c.p JOIN e v ON v.p = c.q GROUP BY 1, 2, 3, 4)
 SELECT frame, CAST(floor(sqrt(d2)*(10/0.25::DOUBLE)) AS INTEGER) AS bin, count(*) AS n, {s6('sum(s)')} AS gl FROM pr GROUP BY 1, 2""")
def bond_order_correlation(spark, d):
    q = order.qlm(edges(spark, d), 6)
    return rounded(order.bond_order_correlation(positions(spark, d), q, 6, 0.25, 10), "gl")


@query(f"""{WITH_EDGES}, m AS (SELECT pairs.*, a.x+dx/2 AS x, a.y+dy/2 AS y, a.z+dz/2 AS z FROM pairs JOIN p a ON a.pid = pairs.p),
 c AS (SELECT u.frame, (u.x-v.x)*(u.x-v.x)+(u.y-v.y)*(u.y-v.y)+(u.z-v.z)*(u.z-v.z) AS r2, {legendre(4)} AS s
  FROM m u JOIN m v ON u.frame = v.frame AND (u.p, u.q) < (v.p, v.q))
 SELECT frame, CAST(floor(sqrt(r2)*(10/0.15::DOUBLE)) AS INTEGER) AS bin, count(*) AS n, {s6('sum(s)')} AS gl FROM c
 WHERE r2 < 0.15::DOUBLE*0.15::DOUBLE GROUP BY 1, 2""")
def bond_centred_correlation(spark, d):
    return rounded(order.bond_bond_correlation_of_points(positions(spark, d), BOND, 4, 0.15, 10), "gl")


@query(f"""{WITH_EDGES}, {q_sql(4)}, {q_sql(6)}, h AS (SELECT frame, least(9, CAST(floor(round(q6, 9)*10) AS INTEGER)) AS bin_x,
 least(9, CAST(floor(round(q4, 9)*10) AS INTEGER)) AS bin_y FROM q4 JOIN q6 USING (frame, p)) SELECT *, count(*) AS n FROM h GROUP BY 1, 2, 3""")
def order_parameter_histogram(spark, d):
    e = edges(spark, d)
    both = (order.invariants(order.qlm(e, 6), 6, with_w=False).drop("n")
            .join(order.invariants(order.qlm(e, 4), 4, with_w=False).drop("n"), ["frame", "p"])
            .withColumns({"q6": F.least(F.round("q6", 9), F.lit(0.95)), "q4": F.least(F.round("q4", 9), F.lit(0.95))}))
    return stats.histogram2d(both, "q6", "q4", (0.0, 1.0), (0.0, 1.0), (10, 10), ["frame"])


@query(f"""{WITH_EDGES}, {q_sql(6)}, f AS (SELECT q6.frame, q6.p, q6, f.f AS v FROM q6 JOIN p f ON f.pid = q6.p),
 h AS (SELECT CASE WHEN q6 >= 1 THEN 4 ELSE CAST(floor(round(q6, 9)*5) AS INTEGER) END AS bin, count(*) AS n, avg(v) AS m, stddev_pop(v) AS s FROM f GROUP BY 1)
 SELECT bin, n, {s6('m/(SELECT avg(v) FROM f)')} AS mean, {s6('s/(SELECT avg(v) FROM f)')} AS dev FROM h""")
def field_by_order_parameter(spark, d):
    q = order.invariants(order.qlm(edges(spark, d), 6), 6, with_w=False).withColumn("q6", F.least(F.round("q6", 9), F.lit(1.0)))
    both = q.join(positions(spark, d).select("frame", F.col("pid").alias("p"), "f"), ["frame", "p"])
    return rounded(stats.binned_moments(both, "q6", "f", 0.0, 1.0, 5), "mean", "dev")


@query()
def flip_coarse_grained_q6(spark, d):
    pos = positions(spark, d)
    return rounded(order.invariants(order.flip_of_points(pos, BOND, order.qlm_by_blocks(pos, BOND, 6), 6), 6), "q6", "w6")


# a vector w turned by pi about n is 2 (w.n) n - w
FLIP = f"""{WITH_EDGES}, {q_sql(6)}, n AS (SELECT p, count(*) AS n FROM e GROUP BY 1), un AS (SELECT frame, p, q, dx/sqrt(d2) AS x, dy/sqrt(d2) AS y, dz/sqrt(d2) AS z FROM e),
bb AS (SELECT b.frame, b.p, b.q, u.x*w.x+u.y*w.y+u.z*w.z AS uw, (w.x*b.x+w.y*b.y+w.z*b.z)*(u.x*b.x+u.y*b.y+u.z*b.z) AS wu FROM un b JOIN un u ON u.p = b.p JOIN un w ON w.p = b.q),
sm AS (SELECT frame, p, q, avg({legendre(6, 'uw')}) AS alike, avg({legendre(6, '(2*wu-uw)')}) AS flipped FROM bb GROUP BY 1, 2, 3),
sc AS (SELECT sm.frame, sm.p, count(*) AS n, count(*) FILTER (alike/(a.q6*b.q6) > 0.5) AS n_alike, count(*) FILTER (flipped/(a.q6*b.q6) > 0.5) AS n_flipped
 FROM sm JOIN q6 a ON a.p = sm.p JOIN q6 b ON b.p = sm.q WHERE a.q6 > 0 AND b.q6 > 0 GROUP BY 1, 2),
vs AS (SELECT un.p, x, y, z, 1.0::DOUBLE/n AS w FROM un JOIN n USING (p) UNION ALL
 SELECT p, 2*c*nx-x, 2*c*ny-y, 2*c*nz-z, 1.0::DOUBLE/n FROM (SELECT b.p, w.x, w.y, w.z, b.x AS nx, b.y AS ny, b.z AS nz, w.x*b.x+w.y*b.y+w.z*b.z AS c, n.n FROM un b JOIN un w ON w.p = b.q JOIN n ON n.p = b.q)),
fl AS (SELECT p, sqrt(greatest(0, sum(u.w*v.w*{legendre(6, '(u.x*v.x+u.y*v.y+u.z*v.z)')}))) AS q6 FROM vs u JOIN vs v USING (p) GROUP BY 1)"""


@query(f"{FLIP} SELECT sc.frame, sc.p, sc.n, n_alike, n_flipped, {s6('fl.q6/(1+n.n)')} AS q6 FROM sc JOIN fl USING (p) JOIN n USING (p)")
def flip_similarity(spark, d):
    """Bonds between like ends, as they are and turned about the bond, and q6 of the turned mean."""
    pos = positions(spark, d)
    both = order.flip_of_points(pos, BOND, order.qlm_by_blocks(pos, BOND, 6), 6, 0.5).where("bonds > 0")
    return rounded(both.select("frame", "p", F.col("bonds").alias("n"), "n_alike", "n_flipped", H.ql(6).alias("q6")), "q6")


@query(f"""{W4.split(' ms AS')[0].rstrip().rstrip(',')} SELECT frame, p, 4 AS l, m, {s6('re')} AS re, {s6('im')} AS im FROM half""")
def bond_order_coefficients(spark, d):
    return rounded(order.long_form(order.qlm(edges(spark, d), 4), 4), "re", "im")
