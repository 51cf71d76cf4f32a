"""Distance joins, selections, pair histograms."""

import math

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import graph, pairs, select, spatial, stats
from .catalog import query, r6, rounded, s6
from .tables import BOND, D2, EDGES, P, PAIRS, WITH_EDGES, positions, table

CUT, BINS = 0.3, 30
BIN = f"CAST(floor(sqrt(d2) * ({BINS}/{CUT}::DOUBLE)) AS INTEGER)"
CUTPAIRS = f"""c AS (SELECT a.frame, a.pid AS p, b.pid AS q, b.x-a.x AS dx, b.y-a.y AS dy, b.z-a.z AS dz, {D2} AS d2,
  a.f AS p_f, b.f AS q_f, a.g AS p_g, b.g AS q_g, a.r AS p_r, b.r AS q_r, a.species AS p_s, b.species AS q_s
  FROM p a JOIN p b ON a.frame = b.frame AND a.pid < b.pid WHERE {D2} < {CUT}::DOUBLE*{CUT}::DOUBLE)"""
L = 0.5
def _mi(axis): return f"(b.{axis}-a.{axis} - {L}*floor((b.{axis}-a.{axis})/{L}+0.5))"
MD2 = "+".join(f"{_mi(a)}*{_mi(a)}" for a in "xyz")


@query(f"""WITH {P}, {CUTPAIRS}, h AS (SELECT frame, {BIN} AS bin, count(*) AS n FROM c GROUP BY 1, 2),
 grid AS (SELECT DISTINCT frame, CAST(b AS INTEGER) AS bin FROM p, range({BINS}) r(b))
 SELECT g.frame, g.bin, coalesce(h.n, 0) AS n_pairs FROM grid g LEFT JOIN h ON h.frame = g.frame AND h.bin = g.bin""")
def pair_histogram(spark, d):
    pos = positions(spark, d)
    hist = pairs.pair_histogram(pos, CUT, BINS)
    return pairs.complete_bins(hist, pos, BINS, ["frame"]).withColumnRenamed("n", "n_pairs")


@query(f"WITH {P}, {PAIRS} SELECT frame, p AS low, q AS high, {s6('d2')} AS d2 FROM pairs")
def range_join_bonds(spark, d):
    return rounded(spatial.bonds(positions(spark, d), BOND), "d2")


@query(f"""WITH {P} SELECT a.frame, count(*) AS n, sum(a.pid + 3*b.pid)::BIGINT AS checksum FROM p a JOIN p b
 ON a.frame = b.frame AND a.pid < b.pid WHERE {MD2} < {BOND}*{BOND} GROUP BY 1""")
def range_join_periodic(spark, d):
    near = spatial.range_pairs(positions(spark, d), BOND, periods=[L, L, L])
    return near.groupBy("frame").agg(F.count("*").alias("n"), F.sum(F.col("p") + 3 * F.col("q")).alias("checksum"))


@query(WITH_EDGES + """ SELECT frame, p, count(*) AS n, string_agg(CAST(q AS VARCHAR), ',' ORDER BY q) AS ngbs
 FROM e GROUP BY 1, 2""")
def neighbour_lists(spark, d):
    lists = graph.neighbour_lists(spatial.neighbour_edges(positions(spark, d), BOND))
    return lists.withColumn("ngbs", F.array_join(F.col("ngbs").cast("array<string>"), ","))


@query(WITH_EDGES + f""" SELECT frame, p, q, row_number() OVER (PARTITION BY frame, p ORDER BY d2, q) AS rank,
 {s6('d2')} AS d2 FROM e""")
def neighbours_by_distance(spark, d):
    ranked = spatial.neighbours_ranked(spatial.neighbour_edges(positions(spark, d), BOND))
    return ranked.select("frame", "p", "q", F.col("rank").cast("bigint").alias("rank"), r6("d2").alias("d2"))


@query(f"""WITH {P}, k AS (SELECT a.frame, a.pid AS p, b.pid AS q, {D2} AS d2,
 row_number() OVER (PARTITION BY a.pid ORDER BY {D2}, b.pid) AS rk FROM p a JOIN p b ON a.frame = b.frame AND a.pid <> b.pid
 WHERE {D2} < 0.25) SELECT frame, p, q, {s6('d2')} AS d2 FROM k WHERE rk = 1""")
def nearest_neighbour(spark, d):
    return rounded(spatial.nearest_neighbour(positions(spark, d), 0.5), "d2")


@query(f"""WITH {P} SELECT a.frame, a.pid AS low, b.pid AS high, {s6(D2)} AS d2 FROM p a JOIN p b
 ON a.frame = b.frame AND a.pid < b.pid WHERE {D2} < (2.5*(a.r+b.r))*(2.5*(a.r+b.r))""")
def polydisperse_bonds(spark, d):
    pos = positions(spark, d)
    widest = pos.agg(F.max("r")).first()[0]
    return rounded(spatial.polydisperse_bonds(pos, widest, 2.5), "d2")


@query(f"""WITH {P}, bx AS (SELECT frame, min(x) x0, max(x) x1, min(y) y0, max(y) y1, min(z) z0, max(z) z1 FROM p GROUP BY 1),
 k AS (SELECT a.frame, a.pid AS p, b.pid AS q, {D2} AS d2, row_number() OVER (PARTITION BY a.pid ORDER BY {D2}, b.pid) AS rank
 FROM p a JOIN p b ON a.frame = b.frame AND a.pid <> b.pid WHERE {D2} < 0.3*0.3)
 SELECT k.frame, p, rank, q, {s6('d2')} AS d2,
 (least(a.x-x0, x1-a.x, a.y-y0, y1-a.y, a.z-z0, z1-a.z) >= 0.05) AS inside
 FROM k JOIN p a ON a.pid = k.p JOIN bx ON bx.frame = k.frame WHERE rank <= 12""")
def nearest_twelve(spark, d):
    pos = positions(spark, d)
    inside = select.mark_inside(pos, 0.05, always_shrink=True).select("frame", F.col("pid").alias("p"), "inside")
    near = spatial.knn(pos, 12, 0.3)
    return near.join(inside, ["frame", "p"]).select(
        "frame", "p", F.col("rank").cast("bigint").alias("rank"), "q", r6("d2").alias("d2"), "inside")


@query(f"""WITH {P}, k AS (SELECT a.frame, a.pid AS p, b.pid AS q, {MD2} AS d2,
 row_number() OVER (PARTITION BY a.pid ORDER BY {s6(MD2)}, b.pid) AS rank FROM p a JOIN p b ON a.frame = b.frame AND a.pid <> b.pid
 WHERE {MD2} < 0.2*0.2) SELECT frame, p, count(*) AS n, {s6('sum(d2)')} AS sum_d2 FROM k WHERE rank <= 12 GROUP BY 1, 2""")
def nearest_twelve_periodic(spark, d):
    near = spatial.knn(positions(spark, d), 12, 0.2, periods=[L, L, L])
    return near.groupBy("frame", "p").agg(F.count("*").alias("n"), r6(F.sum("d2")).alias("sum_d2"))


@query(f"""WITH {P}, bad AS (SELECT a.frame, a.pid FROM p a JOIN p b ON a.frame = b.frame AND a.pid <> b.pid WHERE {D2} < 0.01)
 SELECT p.frame, p.pid FROM p LEFT JOIN bad ON bad.pid = p.pid WHERE bad.pid IS NULL""")
def isolated_particles(spark, d):
    return spatial.isolated(positions(spark, d), 0.1).select("frame", "pid")


@query(f"""WITH {P} SELECT a.frame, a.pid AS "from", b.pid AS "to", {s6(D2)} AS cost FROM p a JOIN p b
 ON b.frame = a.frame + 1 WHERE {D2} < {BOND}*{BOND}""")
def frame_to_frame_links(spark, d):
    return rounded(spatial.frame_links(positions(spark, d), BOND), "cost")


@query(f"""WITH {P} SELECT a.frame, a.pid AS "from", b.pid AS "to", {s6(f'{D2} + (a.r-b.r)*(a.r-b.r)')} AS cost FROM p a JOIN p b
 ON b.frame = a.frame + 1 WHERE {D2} < (1.5*(a.r+b.r))*(1.5*(a.r+b.r))""")
def frame_to_frame_links_sized(spark, d):
    pos = positions(spark, d)
    widest = pos.agg(F.max("r")).first()[0]
    return rounded(spatial.frame_links(pos, 1.5, r="r", radius_max=widest, size_cost=True), "cost")


# --- projections and selections ----------------------------------------------------------------------

@query(f"""WITH {P} SELECT frame, pid, {s6('x*2.5 + 0.1')} AS x, {s6('y*2.5 - 0.2')} AS y, {s6('z*2.5')} AS z, {s6('r*2.5')} AS r FROM p""")
def scale_and_translate(spark, d):
    moved = select.translate(select.scale(positions(spark, d), 2.5, r="r"), [0.1, -0.2, 0.0])
    return rounded(moved.select("frame", "pid", "x", "y", "z", "r"), "x", "y", "z", "r")


@query(f"""WITH {P} SELECT frame, count(*) AS n, {', '.join(f'{s6(f"min({c})")} AS {c}0, {s6(f"max({c})")} AS {c}1' for c in 'xyz')}
 FROM p GROUP BY 1""")
def frame_extent(spark, d):
    return rounded(select.extent(positions(spark, d)), "x0", "x1", "y0", "y1", "z0", "z1")


@query(f"WITH {P} SELECT frame, {s6('least(max(x)-min(x), max(y)-min(y), max(z)-min(z))')} AS min_dim FROM p GROUP BY 1")
def smallest_dimension(spark, d):
    return rounded(select.min_dim(positions(spark, d)), "min_dim")


@query(f"""WITH {P}, bx AS (SELECT frame, min(x) x0, max(x) x1, min(y) y0, max(y) y1, min(z) z0, max(z) z1 FROM p GROUP BY 1)
 SELECT p.frame, pid FROM p JOIN bx USING (frame) WHERE {' AND '.join(
 f"{c} >= {c}0 + CASE WHEN {c}1-{c}0 > 0.2 THEN 0.1 ELSE 0 END AND {c} <= {c}1 - CASE WHEN {c}1-{c}0 > 0.2 THEN 0.1 ELSE 0 END"
 for c in 'xyz')}""")
def inside_margin(spark, d):
    return select.select_inside(positions(spark, d), 0.1).select("frame", "pid")


@query(f"""WITH {P} SELECT frame, pid FROM p WHERE x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.15 AND 0.05 AND z BETWEEN 0 AND 0.2""")
def box_query(spark, d):
    return select.select_box(positions(spark, d), [-0.1, -0.15, 0.0], [0.1, 0.05, 0.2]).select("frame", "pid")


@query(f"""WITH {P} SELECT frame, pid FROM p WHERE {' AND '.join(
 f"abs({c}-({m}) - {L}*floor(({c}-({m}))/{L}+0.5)) <= 0.1" for c, m in zip('xyz', (0.2, 0.0, -0.2)))}""")
def box_query_periodic(spark, d):
    return select.select_box(positions(spark, d), [0.1, -0.1, -0.3], [0.3, 0.1, -0.1], periods=[L, L, L]).select("frame", "pid")


@query(f"""WITH {P} SELECT frame, pid, CASE WHEN x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.1 AND 0.1 AND z BETWEEN -0.1 AND 0.1
 THEN {s6('f')} END AS f FROM p""")
def blank_outside_box(spark, d):
    pos = positions(spark, d)
    return rounded(select.blank_outside(pos, select.select_box(pos, [-0.1] * 3, [0.1] * 3), ["f"]).select("frame", "pid", "f"), "f")


@query("""WITH q AS (SELECT round(l_discount + l_tax*2 + 0.15, 4) AS q6, l_quantity - 25 AS w4 FROM lineitem)
 SELECT CASE WHEN q6 < 0.25 THEN 'liquid' WHEN q6 <= 0.35 THEN 'mrco' WHEN w4 < 0 THEN 'fcc' ELSE 'hcp' END AS class,
 count(*) AS n FROM q GROUP BY 1""")
def threshold_classes(spark, d):
    q6 = F.round(F.col("l_discount") + F.col("l_tax") * 2 + 0.15, 4)
    cls = select.structure_class(q6, F.col("l_quantity") - 25)
    return table(spark, d, "lineitem").groupBy(cls.alias("class")).agg(F.count("*").alias("n"))


@query(f"""WITH {P} SELECT frame, pid, {s6('x*f + y*g')} AS dot, {s6('sqrt(x*x+y*y+z*z)')} AS norm,
 {s6('acos(greatest(-1, least(1, (x*f+y*g+z*r)/sqrt((x*x+y*y+z*z)*(f*f+g*g+r*r)))))')} AS angle,
 {s6('x/sqrt(x*x+y*y+z*z)')} AS ux, {s6('acos(greatest(-1, least(1, z/sqrt(x*x+y*y+z*z))))')} AS colatitude,
 {s6(f'CASE WHEN atan2(y,x) < 0 THEN atan2(y,x) + {2*math.pi!r} ELSE atan2(y,x) END')} AS azimuth,
 {s6(f'x - {L}*floor(x/{L}+0.5)')} AS mx FROM p""")
def vector_functions(spark, d):
    xyz, other = ["x", "y", "z"], ["f", "g", "r"]
    _, colat, az = G.spherical(*xyz)
    return positions(spark, d).select(
        "frame", "pid", r6(G.dot(["x", "y"], ["f", "g"])).alias("dot"), r6(F.sqrt(G.norm2(xyz))).alias("norm"),
        r6(G.angle(xyz, other)).alias("angle"), r6(G.normalize(xyz)[0]).alias("ux"), r6(colat).alias("colatitude"),
        r6(az).alias("azimuth"), r6(G.minimg("x", L)).alias("mx"))


@query(f"""WITH {P}, q AS (SELECT frame, pid, x-r a0, x+r a1, y-r b0, y+r b1, z-r c0, z+r c1, x*x+y*y+z*z AS cd FROM p)
 SELECT frame, pid, (a0<0.1 AND a1>-0.1 AND b0<0.1 AND b1>-0.1 AND c0<0.1 AND c1>-0.1) AS overlaps,
 {s6('greatest(0,least(a1,0.1)-greatest(a0,-0.1))*greatest(0,least(b1,0.1)-greatest(b0,-0.1))*greatest(0,least(c1,0.1)-greatest(c0,-0.1))')} AS shared,
 {s6('(greatest(a1,0.1)-least(a0,-0.1))*(greatest(b1,0.1)-least(b0,-0.1))*(greatest(c1,0.1)-least(c0,-0.1))')} AS joined,
 {s6('cd')} AS centre_d2 FROM q""")
def box_algebra(spark, d):
    mine, query_box = G.box_of_point(["x", "y", "z"], "r"), ([-0.1] * 3, [0.1] * 3)
    return positions(spark, d).select(
        "frame", "pid", G.box_overlaps(mine, query_box).alias("overlaps"),
        r6(G.box_overlap_volume(mine, query_box)).alias("shared"), r6(G.box_volume(G.box_stretch(mine, query_box))).alias("joined"),
        r6(G.box_centre_distance2(mine, query_box)).alias("centre_d2"))


@query(f"""WITH {P} SELECT frame, count(*) AS n, count(DISTINCT pid) AS n_ids, count(*) = count(DISTINCT pid) AS ok FROM p GROUP BY 1""")
def frame_validation(spark, d):
    return select.validate_frames(positions(spark, d))


# --- pair statistics ---------------------------------------------------------------------------------

RDF = f"""bx AS (SELECT frame, count(*) AS n, min(x) x0, max(x) x1, min(y) y0, max(y) y1, min(z) z0, max(z) z1 FROM p GROUP BY 1),
 m AS (SELECT p.*, ({' AND '.join(f"{c} >= {c}0 + CASE WHEN {c}1-{c}0 > 0.2 THEN 0.1 ELSE 0 END AND {c} <= {c}1 - CASE WHEN {c}1-{c}0 > 0.2 THEN 0.1 ELSE 0 END" for c in 'xyz')}) AS inside
   FROM p JOIN bx USING (frame)),
 h AS (SELECT frame, {BIN} AS bin, count(*) AS n FROM (SELECT a.frame, {D2} AS d2 FROM m a JOIN p b ON a.frame = b.frame AND a.pid <> b.pid
   WHERE a.inside AND {D2} < {CUT}::DOUBLE*{CUT}::DOUBLE) GROUP BY 1, 2),
 st AS (SELECT bx.frame, bx.n/((x1-x0)*(y1-y0)*(z1-z0)) AS rho, s.n_sel FROM bx JOIN (SELECT frame, count(*) FILTER (WHERE inside) AS n_sel FROM m GROUP BY 1) s USING (frame)),
 grid AS (SELECT DISTINCT frame, CAST(b AS INTEGER) AS bin FROM p, range({BINS}) r(b)),
 rdf AS (SELECT g.frame, g.bin, g.bin*({CUT}/{BINS}::DOUBLE) AS r, coalesce(h.n, 0) AS n,
   CASE WHEN g.bin > 0 THEN coalesce(h.n, 0)/(4*pi()*rho*n_sel*power({CUT}/{BINS}::DOUBLE, 3)*g.bin*g.bin) ELSE 0 END AS g
   FROM grid g JOIN st USING (frame) LEFT JOIN h ON h.frame = g.frame AND h.bin = g.bin)"""


def _rdf(spark, d):
    return pairs.rdf(positions(spark, d), CUT, BINS, margin=0.1)


@query(f"WITH {P}, {RDF} SELECT frame, bin, {s6('r')} AS r, n::BIGINT AS n, {s6('g')} AS g FROM rdf")
def radial_distribution(spark, d):
    return rounded(_rdf(spark, d), "r", "g")


@query(f"""WITH {P}, {RDF}, tot AS (SELECT bin, avg(r) AS r, avg(g) AS g FROM rdf GROUP BY 1) SELECT bin, {s6('r')} AS r, {s6('g')} AS g FROM tot""")
def total_radial_distribution(spark, d):
    return rounded(pairs.mean_rdf(_rdf(spark, d)), "r", "g")


@query(f"""WITH {P}, {RDF}, tot AS (SELECT bin, avg(r) AS r, avg(g) AS g FROM rdf GROUP BY 1),
 pk AS (SELECT bin AS pb, r AS peak FROM tot ORDER BY g DESC, bin LIMIT 1)
 SELECT {s6('peak')} AS peak, {s6('r')} AS bond_length FROM tot, pk WHERE bin > pb ORDER BY g, bin LIMIT 1""")
def bond_length_from_rdf(spark, d):
    return rounded(pairs.bond_length(pairs.mean_rdf(_rdf(spark, d))), "peak", "bond_length")


@query(f"""WITH {P}, {CUTPAIRS} SELECT frame, {BIN} AS bin, count(*) AS n FROM c WHERE dz*dz <= 0.25*d2 GROUP BY 1, 2""")
def planar_pair_histogram(spark, d):
    return pairs.pair_histogram(positions(spark, d), CUT, BINS, where=pairs.planar_condition(0.5))


@query(f"""WITH {P}, c AS (SELECT a.frame, (b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y) AS d2 FROM p a JOIN p b
 ON a.frame = b.frame AND a.pid < b.pid WHERE abs(b.z-a.z) <= 0.05) SELECT frame, {BIN} AS bin, count(*) AS n FROM c
 WHERE d2 < {CUT}::DOUBLE*{CUT}::DOUBLE GROUP BY 1, 2""")
def slice_pair_histogram(spark, d):
    return pairs.slice_histogram(positions(spark, d), CUT, BINS, 0.1)


@query(f"""WITH {P} SELECT frame, CAST(floor(sqrt(u)*10) AS INTEGER) AS bin, count(*) AS n FROM (SELECT a.frame,
 {D2}/((a.r+b.r)*(a.r+b.r)) AS u FROM p a JOIN p b ON a.frame = b.frame AND a.pid < b.pid) WHERE u < 9 GROUP BY 1, 2""")
def scaled_pair_histogram(spark, d):
    pos = positions(spark, d)
    widest = pos.agg(F.max("r")).first()[0]
    return pairs.scaled_pair_histogram(pos, 3.0, 30, widest)


@query(f"""WITH {P}, w AS (SELECT *, {'*'.join(f"(0.5*(1-cos(({c}+0.5)*{2*math.pi!r})))" for c in 'xyz')} AS w FROM p),
 c AS (SELECT a.frame, {D2} AS d2, a.w*b.w AS ww FROM w a JOIN w b ON a.frame = b.frame AND a.pid < b.pid WHERE {D2} < {CUT}::DOUBLE*{CUT}::DOUBLE)
 SELECT frame, {BIN} AS bin, count(*) AS n, {s6('sum(ww)')} AS sum_w FROM c GROUP BY 1, 2""")
def windowed_pair_histogram(spark, d):
    return rounded(pairs.windowed_histogram(positions(spark, d), CUT, BINS, [1.0, 1.0, 1.0], [-0.5] * 3), "sum_w")


@query(f"""WITH {P}, c AS (SELECT a.frame, {MD2} AS d2 FROM p a JOIN p b ON a.frame = b.frame AND a.pid < b.pid)
 SELECT frame, {BIN} AS bin, count(*) AS n FROM c WHERE d2 < 0.04 GROUP BY 1, 2""".replace(f"{BINS}/{CUT}", "20/0.2"))
def periodic_pair_histogram(spark, d):
    return pairs.pair_histogram(positions(spark, d), 0.2, 20, periods=[L, L, L])


@query(f"""WITH {P}, {CUTPAIRS}, e AS (SELECT frame, p, d2 FROM c UNION ALL SELECT frame, q, d2 FROM c)
 SELECT frame, p, {BIN} AS bin, count(*) AS n FROM e GROUP BY 1, 2, 3""")
def particle_pair_histogram(spark, d):
    return pairs.particle_histogram(positions(spark, d), CUT, BINS)


@query(f"""WITH {P}, {CUTPAIRS}, e AS (SELECT frame, p, q_s AS species, d2 FROM c UNION ALL SELECT frame, q, p_s, d2 FROM c)
 SELECT frame, p, species, {BIN} AS bin, count(*) AS n FROM e GROUP BY 1, 2, 3, 4""")
def species_pair_histogram(spark, d):
    return pairs.particle_histogram(positions(spark, d), CUT, BINS, species="species")


@query(f"""WITH {P}, {CUTPAIRS}, e AS (SELECT frame, p, d2 FROM c UNION ALL SELECT frame, q, d2 FROM c),
 h AS (SELECT frame, p, floor(sqrt(d2)*(10/{CUT}::DOUBLE)) AS bin, count(*) AS n FROM e GROUP BY 1, 2, 3),
 g AS (SELECT frame, p, n/(50*4.0/3*pi()*(power((bin+1)*{CUT}/10, 3) - power(bin*{CUT}/10, 3))) AS g FROM h),
 s AS (SELECT frame, p, sum(g*ln(g)-g+1) AS sf, count(*) AS k FROM g GROUP BY 1, 2)
 SELECT p.frame, p.pid AS p, {s6('-25.0*(coalesce(sf, 0) + 10 - coalesce(k, 0))')} AS s2 FROM p LEFT JOIN s ON s.p = p.pid""")
def excess_entropy(spark, d):
    return rounded(pairs.excess_entropy(positions(spark, d), CUT, 10, 50.0), "s2")


@query(f"""WITH {P}, {CUTPAIRS} SELECT frame, {BIN} AS bin, count(*) AS n, {s6('sum(p_f*q_f)')} AS sum_f, {s6('sum(p_g*q_g)')} AS sum_g,
 {s6('avg(p_f*q_f)')} AS corr_f, {s6('avg(p_g*q_g)')} AS corr_g FROM c GROUP BY 1, 2""")
def spatial_correlation(spark, d):
    return rounded(pairs.spatial_correlation(positions(spark, d), ["f", "g"], CUT, BINS), "sum_f", "sum_g", "corr_f", "corr_g")


@query(f"""WITH {P}, {CUTPAIRS}, o AS (SELECT frame, d2, p_f*q_f AS v, p_g > 0 AS c FROM c UNION ALL SELECT frame, d2, p_f*q_f, q_g > 0 FROM c)
 SELECT frame, {BIN} AS bin, count(*)::BIGINT AS n, {s6('sum(v)')} AS sum_f, {s6('avg(v)')} AS corr_f FROM o WHERE c GROUP BY 1, 2""")
def spatial_correlation_of_centres(spark, d):
    pos = positions(spark, d).withColumn("centre", F.col("g") > 0)
    return rounded(pairs.spatial_correlation(pos, ["f"], CUT, BINS, centres="centre"), "sum_f", "corr_f")


@query(f"""WITH {P}, {CUTPAIRS}, e AS (SELECT frame, p_s, q_s, p_f*q_f AS v, d2 FROM c UNION ALL SELECT frame, q_s, p_s, p_f*q_f, d2 FROM c)
 SELECT frame, p_s AS species_p, q_s AS species_q, {BIN} AS bin, count(*) AS n, {s6('sum(v)')} AS s FROM e GROUP BY 1, 2, 3, 4""")
def species_correlation(spark, d):
    return rounded(pairs.species_correlation(positions(spark, d), "f", "species", CUT, BINS), "s")


@query(f"""WITH {P}, {CUTPAIRS} SELECT frame, {BIN} AS bin, count(*) AS n, {s6('avg(p_f*q_f + p_g*q_g)')} AS corr FROM c GROUP BY 1, 2""")
def vector_correlation(spark, d):
    return rounded(pairs.vector_correlation(positions(spark, d), ["f", "g"], CUT, BINS), "corr")


@query(f"""WITH {P}, {CUTPAIRS} SELECT frame, CAST(floor(ln(d2 + 1e-9)) AS INTEGER) AS bin, max(abs(p_f-q_f)) AS widest, {s6('sum(p_r*q_r)')} AS weight
 FROM c WHERE p_r + q_r > 0.05 GROUP BY 1, 2""")
def custom_pair_aggregate(spark, d):
    return pairs.pair_aggregate(
        positions(spark, d), CUT, [F.max(F.abs(F.col("p_f") - F.col("q_f"))).alias("widest"),
                                   r6(F.sum(F.col("p_r") * F.col("q_r"))).alias("weight")],
        bin=F.floor(F.log(F.col("d2") + 1e-9)).cast("int"), carry=["f", "r"], where=F.col("p_r") + F.col("q_r") > 0.05)


@query(f"""WITH {P}, {PAIRS}, {EDGES},
 n AS (SELECT frame, p, count(*) AS n FROM e GROUP BY 1, 2)
 SELECT p.frame, coalesce(n.n, 0) AS n_ngbs, count(*) AS particles FROM p LEFT JOIN n ON n.p = p.pid GROUP BY 1, 2""")
def neighbour_counts(spark, d):
    pos = positions(spark, d)
    counts = graph.count_by(spatial.neighbour_edges(pos, BOND), pos)
    return counts.groupBy("frame", F.col("n").alias("n_ngbs")).agg(F.count("*").alias("particles"))


@query(f"""WITH {P}, b AS (SELECT frame, count(*) AS n, (max(x)-min(x))*(max(y)-min(y))*(max(z)-min(z)) AS v FROM p GROUP BY 1)
 SELECT frame, n, {s6('n/v')} AS density, {s6('4.0/3*pi()*power(0.05,3)*n/v')} AS phi FROM b""")
def number_density(spark, d):
    return rounded(stats.volume_fraction(stats.number_density(positions(spark, d)), 0.05), "density", "phi")
