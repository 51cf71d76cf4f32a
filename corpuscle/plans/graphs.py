"""Neighbour graphs, clusters, matching and linking."""

from pyspark.sql import functions as F

from ..operators import graph, histories, linking, matching, select, shared, spatial
from ..operators.twins import twins
from .catalog import query, rounded, s6
from .tables import BOND, D2, EDGES, P, PAIRS, T, T_BOND, T_PAIRS, WITH_EDGES, positions, table, track_bonds, tracks

WIDE = 0.16       # denser graph, so that rings occur
WIDE_EDGES = WITH_EDGES.replace(f"{BOND}*{BOND}", f"{WIDE}*{WIDE}")


def edges(spark, d, reach=BOND):
    return spatial.neighbour_edges(positions(spark, d), reach).select("frame", "p", "q")


@query(WITH_EDGES + " SELECT DISTINCT a.frame, a.p AS low, b.q AS high FROM e a JOIN e b ON a.q = b.p WHERE a.p < b.q")
def second_shell(spark, d):
    return shared.second_shell(positions(spark, d), BOND)


@query(WIDE_EDGES + " SELECT a.frame, a.p AS low, b.p AS high, a.q AS c FROM e a JOIN e b ON a.q = b.q AND a.p < b.p JOIN pairs w ON w.p = a.p AND w.q = b.p")
def common_neighbours(spark, d):
    return shared.common_of_bonds(positions(spark, d), WIDE)


COMMON = """, cm AS (SELECT a.frame, a.p AS low, b.p AS high, a.q AS c, EXISTS (SELECT 1 FROM pairs w WHERE w.p = a.p AND w.q = b.p) AS bonded
  FROM e a JOIN e b ON a.q = b.q AND a.p < b.p),
 k AS (SELECT frame, low, high, bonded, count(*) AS n FROM cm GROUP BY 1, 2, 3, 4),
 dg AS (SELECT c1.frame, c1.low, c1.high, c1.c, (SELECT count(*) FROM cm c2 JOIN e ON e.p = c1.c AND e.q = c2.c
   WHERE c2.low = c1.low AND c2.high = c1.high) AS deg FROM cm c1 JOIN k USING (frame, low, high) WHERE k.n IN (3, 5)),
 rg AS (SELECT frame, low, high, bool_and(deg = 2) AS ring FROM dg GROUP BY 1, 2, 3)"""


@query(WIDE_EDGES + COMMON + " SELECT frame, low, high FROM k WHERE bonded AND n = 5")
def pairs_sp5c(spark, d):
    return shared.sp5c(positions(spark, d), WIDE)


RING = 0.22       # full five-rings are rare among random points


@query(WITH_EDGES.replace(f"{BOND}*{BOND}", f"{RING}*{RING}") + COMMON
       + " SELECT frame, low, high FROM k JOIN rg USING (frame, low, high) WHERE bonded AND n = 5 AND ring")
def pairs_1551(spark, d):
    return shared.pairs_1551(positions(spark, d), RING)


@query(WIDE_EDGES + COMMON + " SELECT frame, low, high FROM k JOIN rg USING (frame, low, high) WHERE NOT bonded AND n = 3 AND ring")
def pairs_2331(spark, d):
    return shared.pairs_2331(positions(spark, d), WIDE)


@query(WIDE_EDGES + COMMON + """, s AS (SELECT frame, low, high FROM k WHERE bonded AND n = 5)
 SELECT frame, p, count(*) AS n FROM (SELECT frame, low AS p FROM s UNION ALL SELECT frame, high FROM s) GROUP BY 1, 2""")
def spindle_counts(spark, d):
    return graph.spindles(shared.sp5c(positions(spark, d), WIDE))


@query(WITH_EDGES + """ SELECT a.frame, least(179, CAST(floor(degrees(acos(greatest(-1, least(1, (a.dx*b.dx+a.dy*b.dy+a.dz*b.dz)/sqrt(a.d2*b.d2)))))) AS INTEGER)) AS bin,
 count(*) AS n FROM e a JOIN e b ON a.p = b.p AND a.q < b.q GROUP BY 1, 2""")
def bond_angle_histogram(spark, d):
    return shared.bond_angles(positions(spark, d), BOND)


@query(WITH_EDGES + """, o AS (SELECT frame, pid AS p FROM p WHERE x > 0.15)
 SELECT frame, p FROM o UNION SELECT e.frame, e.q FROM e JOIN o ON o.p = e.p""")
def outside_and_neighbours(spark, d):
    outside = positions(spark, d).where("x > 0.15").select("frame", F.col("pid").alias("p"))
    return graph.second_outside(outside, edges(spark, d))


FIELD = ", m AS (SELECT frame, p, q FROM e UNION ALL SELECT frame, pid, pid FROM p)"


def _field(spark, d):
    return positions(spark, d).select("frame", F.col("pid").alias("p"), "f")


@query(WITH_EDGES + FIELD + f""" SELECT m.frame, m.p, {s6('arg_max(b.f, abs(b.f))')} AS f FROM m JOIN p b ON b.pid = m.q GROUP BY 1, 2""")
def field_dilation(spark, d):
    return rounded(shared.dilate(positions(spark, d), BOND, "f"), "f")


@query(WITH_EDGES + f""", a AS (SELECT e.p, avg(b.f) AS v FROM e JOIN p b ON b.pid = e.q GROUP BY 1)
 SELECT p.frame, p.pid AS p, {s6('(f + coalesce(v, f))/2')} AS f FROM p LEFT JOIN a ON a.p = p.pid""")
def field_average(spark, d):
    return rounded(graph.average_field(_field(spark, d), edges(spark, d), "f"), "f")


@query(WITH_EDGES + FIELD + f""" SELECT m.frame, m.p, {s6('avg(b.f)')} AS f FROM m JOIN p b ON b.pid = m.q GROUP BY 1, 2""")
def field_coarse_graining(spark, d):
    return rounded(graph.coarse_grain_field(_field(spark, d), edges(spark, d), "f"), "f")


@query(WITH_EDGES + " SELECT pairs.frame, pairs.p AS low, pairs.q AS high FROM pairs JOIN p a ON a.pid = pairs.p JOIN p b ON b.pid = pairs.q WHERE a.f > 0 AND b.f > 0")
def crossed_bonds(spark, d):
    bonds = graph.edges_to_bonds(edges(spark, d))
    return graph.crossed_bonds(bonds, _field(spark, d), "f", 0.0)


REACH = f"""WITH RECURSIVE {P}, {PAIRS}, {EDGES}, r AS (SELECT frame, pid AS p, pid AS q FROM p UNION SELECT r.frame, r.p, e.q FROM r JOIN e ON e.p = r.q),
 cl AS (SELECT frame, p, min(q) AS cluster FROM r GROUP BY 1, 2)"""


def _clusters(spark, d):
    nodes = positions(spark, d).select("frame", F.col("pid").alias("p"))
    return graph.connected_components(shared.component_arcs(positions(spark, d), BOND), nodes=nodes)


@query(REACH + " SELECT frame, p, cluster FROM cl")
def clusters_per_frame(spark, d):
    return _clusters(spark, d)


@query(REACH + f""" SELECT cl.frame, cluster, count(*) AS size, {s6('min(x)')} AS x0, {s6('max(x)')} AS x1,
 {s6('var_pop(x)+var_pop(y)+var_pop(z)')} AS rg2 FROM cl JOIN p a ON a.pid = cl.p GROUP BY 1, 2""")
def cluster_extents(spark, d):
    boxes = graph.cluster_extent(_clusters(spark, d), positions(spark, d))
    return rounded(boxes.select("frame", "cluster", "size", "x0", "x1", "rg2"), "x0", "x1", "rg2")


@query(REACH + f""", b AS (SELECT cl.frame, cluster, greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z)) AS w FROM cl JOIN p a ON a.pid = cl.p GROUP BY 1, 2)
 SELECT frame, {s6('max(w)')} AS delta FROM b GROUP BY 1""")
def largest_cluster_delta(spark, d):
    return rounded(graph.largest_delta(graph.cluster_extent(_clusters(spark, d), positions(spark, d))), "delta")


@query("""WITH RECURSIVE ed AS (SELECT DISTINCT l_partkey * 2 AS a, l_suppkey * 2 + 1 AS b FROM lineitem),
 e AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed), nodes AS (SELECT DISTINCT a AS id FROM e),
 cc(id, comp) USING KEY (id) AS (SELECT id, id FROM nodes UNION
  (SELECT e.b, min(cc.comp) FROM cc JOIN e ON e.a = cc.id JOIN recurring.cc r ON r.id = e.b WHERE cc.comp < r.comp GROUP BY e.b))
 SELECT comp AS cluster, count(*) AS size FROM cc GROUP BY 1""")
def part_supplier_components(spark, d):
    arcs = table(spark, d, "lineitem").select((F.col("l_partkey") * 2).alias("p"), (F.col("l_suppkey") * 2 + 1).alias("q"))
    return graph.cluster_sizes(graph.connected_components(arcs, keys=[]), keys=[])


LEVELS = [-0.1, 0.0, 0.1]


@query(f"""WITH RECURSIVE {P}, {PAIRS}, {EDGES}, th AS (SELECT unnest([-0.1, 0.0, 0.1]) AS threshold),
 n AS (SELECT threshold, frame, pid AS p FROM p, th WHERE f > threshold),
 r AS (SELECT threshold, frame, p, p AS q FROM n UNION SELECT r.threshold, r.frame, r.p, e.q FROM r JOIN e ON e.p = r.q JOIN n ON n.p = e.q AND n.threshold = r.threshold),
 cl AS (SELECT threshold, frame, p, min(q) AS cluster FROM r GROUP BY 1, 2, 3)
 SELECT threshold::DOUBLE AS threshold, cl.frame, cluster, count(*) AS size, {s6('var_pop(x)+var_pop(y)+var_pop(z)')} AS rg2
 FROM cl JOIN p a ON a.pid = cl.p GROUP BY 1, 2, 3""")
def percolation_scan(spark, d):
    return rounded(graph.percolation(positions(spark, d), shared.component_arcs(positions(spark, d), BOND, fields=["f"], levels=LEVELS), "f", LEVELS), "rg2")


@query(f"""WITH RECURSIVE {P}, {PAIRS}, {EDGES}, far AS (SELECT a.frame, a.pid AS low, b.pid AS high FROM p a JOIN p b ON a.frame = b.frame AND a.pid < b.pid
   WHERE {D2} >= {BOND}*{BOND} AND {D2} < {WIDE}*{WIDE}),
 w AS (SELECT frame, pid AS s, pid AS p, 0 AS hops FROM p UNION SELECT w.frame, w.s, e.q, hops+1 FROM w JOIN e ON e.p = w.p WHERE hops < 4),
 sp AS (SELECT frame, s, p, min(hops) AS length FROM w GROUP BY 1, 2, 3)
 SELECT far.frame, low, high, coalesce(length, -1) AS length FROM far LEFT JOIN sp ON sp.s = low AND sp.p = high""")
def graph_path_length(spark, d):
    return shared.path_lengths(positions(spark, d), BOND, WIDE, 4).na.fill(-1, ["length"])


# --- bonds between tracks ----------------------------------------------------------------------------

ALIVE = f"WITH {T}, {T_PAIRS}, te AS (SELECT frame, low AS p, high AS q FROM tp UNION ALL SELECT frame, high, low FROM tp)"


def classes(spark, d):
    """Tracks that stand for all their copies, which are found once, and the bonds between them."""
    same = twins(tracks(spark, d))
    return same, track_bonds(spark, d, same.first)


@query(ALIVE + """ SELECT tp.frame, tp.low, tp.high FROM tp JOIN t a ON a.tr = tp.low AND a.frame = tp.frame+1 JOIN t b ON b.tr = tp.high AND b.frame = tp.frame+1
 LEFT JOIN tp n ON n.frame = tp.frame+1 AND n.low = tp.low AND n.high = tp.high WHERE n.low IS NULL""")
def broken_bonds(spark, d):
    return histories.broken_bonds(histories.pack(tracks(spark, d)), T_BOND)


def _change(x, y):
    return f"""(SELECT count(*) FROM te WHERE te.frame = t.frame{x} AND te.p = t.tr AND NOT EXISTS
 (SELECT 1 FROM te n WHERE n.frame = t.frame{y} AND n.p = te.p AND n.q = te.q))"""


@query(ALIVE + f""" SELECT t.frame, t.tr AS p, CASE WHEN l.tr IS NOT NULL THEN {_change('', '+1')} ELSE -1 END AS lost,
 CASE WHEN l.tr IS NOT NULL THEN {_change('+1', '')} ELSE -1 END AS gained FROM t LEFT JOIN t l ON l.tr = t.tr AND l.frame = t.frame+1""")
def neighbour_changes(spark, d):
    return histories.neighbour_changes(histories.pack(tracks(spark, d)), T_BOND).na.fill(-1, ["lost", "gained"])


@query(ALIVE + """ SELECT t.frame, t.tr AS p, (SELECT count(*) FROM te WHERE te.frame = 5 AND te.p = t.tr AND NOT EXISTS
 (SELECT 1 FROM te n WHERE n.frame = t.frame AND n.p = te.p AND n.q = te.q)) AS lost
 FROM t WHERE frame >= 5 AND tr IN (SELECT tr FROM t WHERE frame = 5)""")
def lost_neighbours_since_reference(spark, d):
    return histories.lost_since(tracks(spark, d), T_BOND, 5)


@query(ALIVE + """, b AS (SELECT tp.* FROM tp JOIN t a ON a.tr = tp.low AND a.frame = tp.frame JOIN t c ON c.tr = tp.high AND c.frame = tp.frame WHERE a.x < 5 AND c.x < 5)
 SELECT DISTINCT frame, least(p, q) AS low, greatest(p, q) AS high FROM (
  SELECT te.frame, te.p, te.q FROM b JOIN te ON te.frame = b.frame AND te.p = b.low AND te.q <> b.high UNION ALL
  SELECT te.frame, te.p, te.q FROM b JOIN te ON te.frame = b.frame AND te.p = b.high AND te.q <> b.low)""")
def neighbouring_bonds(spark, d):
    return histories.neighbouring_bonds(tracks(spark, d), T_BOND, "x < 5")


@query(ALIVE + " SELECT low, high, min(frame) AS first, max(frame) AS last, count(*) AS n FROM tp GROUP BY 1, 2")
def bond_life(spark, d):
    return histories.bond_life(histories.pack(tracks(spark, d)), T_BOND)


@query(ALIVE + """, s AS (SELECT *, frame - lag(frame) OVER (PARTITION BY low, high ORDER BY frame) AS gap FROM tp),
 g AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY low, high ORDER BY frame) AS ep FROM s)
 SELECT low, high, min(frame) AS first, max(frame) AS last FROM g GROUP BY low, high, ep""")
def expired_bonds(spark, d):
    return histories.expired_bonds(histories.pack(tracks(spark, d)), T_BOND, 2)


BROKEN = f"""WITH RECURSIVE {T}, {T_PAIRS}, te AS (SELECT frame, low AS p, high AS q FROM tp UNION ALL SELECT frame, high, low FROM tp),
 br AS (SELECT tp.frame+1 AS frame, tp.low, tp.high FROM tp JOIN t a ON a.tr = tp.low AND a.frame = tp.frame+1 JOIN t b ON b.tr = tp.high AND b.frame = tp.frame+1
  LEFT JOIN tp n ON n.frame = tp.frame+1 AND n.low = tp.low AND n.high = tp.high WHERE n.low IS NULL),
 w AS (SELECT DISTINCT frame, low AS s, low AS p FROM br UNION SELECT w.frame, w.s, te.q FROM w JOIN te ON te.frame = w.frame AND te.p = w.p),
 h2 AS (SELECT a.frame, a.p, b.q FROM te a JOIN te b ON a.frame = b.frame AND a.q = b.p UNION SELECT frame, p, q FROM te),
 far AS (SELECT br.* FROM br JOIN w ON w.frame = br.frame AND w.s = br.low AND w.p = br.high
  WHERE NOT EXISTS (SELECT 1 FROM h2 WHERE h2.frame = br.frame AND h2.p = br.low AND h2.q = br.high)),
 nr AS (SELECT low, high, max(frame) AS frame FROM far GROUP BY 1, 2),
 nv AS (SELECT nr.* FROM nr WHERE NOT EXISTS (SELECT 1 FROM tp WHERE tp.low = nr.low AND tp.high = nr.high AND tp.frame >= nr.frame))"""


@query(BROKEN + " SELECT low, high, frame FROM nv")
def never_reforming_bonds(spark, d):
    return histories.never_reform(tracks(spark, d), T_BOND)


@query(BROKEN + " SELECT low, high, frame FROM nv WHERE NOT EXISTS (SELECT 1 FROM h2 WHERE h2.p = nv.low AND h2.q = nv.high AND h2.frame >= nv.frame)")
def never_closer_bonds(spark, d):
    return histories.never_closer(tracks(spark, d), T_BOND)


T_REACH = f"""WITH RECURSIVE {T}, {T_PAIRS}, te AS (SELECT frame, low AS p, high AS q FROM tp UNION ALL SELECT frame, high, low FROM tp),
 rr AS (SELECT DISTINCT frame, p, p AS q FROM te UNION SELECT rr.frame, rr.p, te.q FROM rr JOIN te ON te.frame = rr.frame AND te.p = rr.q),
 mb AS (SELECT frame, p AS tr, min(q) AS cluster FROM rr GROUP BY 1, 2),
 sz AS (SELECT frame, cluster, count(*) AS n FROM mb GROUP BY 1, 2),
 sh AS (SELECT a.frame, a.cluster AS f, b.cluster AS t, count(*) AS i FROM mb a JOIN mb b ON b.frame = a.frame+1 AND b.tr = a.tr GROUP BY 1, 2, 3),
 cand AS (SELECT sh.frame, f, t, (x.n + y.n - i)/i::DOUBLE - 1 AS cost FROM sh JOIN sz x ON x.frame = sh.frame AND x.cluster = f
  JOIN sz y ON y.frame = sh.frame+1 AND y.cluster = t WHERE (x.n + y.n - i)/i::DOUBLE - 1 < 2)"""


def greedy_sql(source, cost="cost", f="f", t="t"):
    """Accepted links of ``source`` in the order (cost, from, to), folded over a list per frame."""
    return f"""gr AS (SELECT frame, list_reduce(list({{'u': [{f}], 'w': [{t}], 'c': [{cost}]}} ORDER BY {cost}, {f}, {t}),
  lambda a, b : CASE WHEN list_contains(a.u, b.u[1]) OR list_contains(a.w, b.w[1]) THEN a
   ELSE {{'u': list_concat(a.u, b.u), 'w': list_concat(a.w, b.w), 'c': list_concat(a.c, b.c)}} END) AS s FROM {source} GROUP BY 1),
 acc AS (SELECT frame, unnest(s.u) AS f, unnest(s.w) AS t, unnest(s.c) AS cost FROM gr)"""


def _members(spark, d):
    """Clusters of the tracks that have a bond."""
    arcs = shared.component_arcs(tracks(spark, d).where("tr IS NOT NULL"), T_BOND, id_col="tr")
    return graph.connected_components(arcs).select("frame", "cluster", F.col("p").alias("tr"))


@query(T_REACH + ", " + greedy_sql("cand") + f""" SELECT frame, f AS "from", t AS "to", {s6('cost')} AS cost FROM acc""")
def cluster_tracking(spark, d):
    from ..scratch import materialize
    return rounded(matching.greedy_match(graph.cluster_links(materialize(_members(spark, d), "members"))), "cost")


@query(T_REACH + """, nd AS (SELECT DISTINCT frame, cluster FROM mb), ln AS (SELECT DISTINCT a.frame AS fa, a.cluster AS ca, b.frame AS fb, b.cluster AS cb
  FROM mb a JOIN mb b ON b.frame = a.frame+1 AND b.tr = a.tr), l2 AS (SELECT * FROM ln UNION ALL SELECT fb, cb, fa, ca FROM ln),
 w AS (SELECT frame, cluster, frame AS f2, cluster AS c2 FROM nd UNION SELECT w.frame, w.cluster, l2.fb, l2.cb FROM w JOIN l2 ON l2.fa = w.f2 AND l2.ca = w.c2)
 SELECT frame, cluster, min((f2, c2))[1] AS first_frame, min((f2, c2))[2] AS first_cluster FROM w GROUP BY 1, 2""")
def space_time_clusters(spark, d):
    from ..scratch import materialize
    return graph.time_clusters(materialize(_members(spark, d), "members"))


# --- matching, thinning, linking ---------------------------------------------------------------------

CAND = f"""cand AS (SELECT a.frame, a.pid AS f, b.pid AS t, {D2} AS cost FROM p a JOIN p b ON b.frame = a.frame+1 WHERE {D2} < {BOND}*{BOND})"""


@query(f"WITH {P}, {CAND}, {greedy_sql('cand')}" + f""" SELECT frame, f AS "from", t AS "to", {s6('cost')} AS cost FROM acc""")
def greedy_matching(spark, d):
    return rounded(linking.match_frames(positions(spark, d), BOND), "cost")


CHAIN = """hd AS (SELECT frame, pid, frame AS hf, pid AS hp FROM p WHERE NOT EXISTS (SELECT 1 FROM ln WHERE ln.t = p.pid)
  UNION ALL SELECT hd.frame + ln.step, ln.t, hd.hf, hd.hp FROM hd JOIN ln ON ln.f = hd.pid AND ln.frame = hd.frame)"""


@query(f"WITH RECURSIVE {P}, {CAND}, {greedy_sql('cand')}, ln AS (SELECT *, 1 AS step FROM acc), {CHAIN}" +
       " SELECT dense_rank() OVER (ORDER BY hf, hp) - 1 AS tr, frame, pid FROM hd")
def linked_trajectories(spark, d):
    return linking.link_frames(positions(spark, d), BOND).select("tr", "frame", "pid")


@query(f"""WITH RECURSIVE {P}, {CAND}, {greedy_sql('cand')},
 c2 AS (SELECT a.frame, a.pid AS f, b.pid AS t, {D2} AS cost FROM p a JOIN p b ON b.frame = a.frame+2 WHERE {D2} < {BOND}*{BOND}
  AND a.pid NOT IN (SELECT f FROM acc) AND b.pid NOT IN (SELECT t FROM acc)), {greedy_sql('c2').replace('gr AS', 'gr2 AS').replace('FROM gr)', 'FROM gr2)').replace(' acc AS', ' acc2 AS')},
 ln AS (SELECT *, 1 AS step FROM acc UNION ALL SELECT *, 2 FROM acc2), {CHAIN},
 nm AS (SELECT dense_rank() OVER (ORDER BY hf, hp) - 1 AS tr, frame, pid FROM hd)
 SELECT tr, frame, pid FROM nm UNION ALL SELECT tr, nm.frame+1, -1 FROM nm JOIN acc2 ON acc2.f = nm.pid""")
def linked_with_gaps(spark, d):
    return linking.link_with_gaps(positions(spark, d), BOND).select("tr", "frame", "pid").na.fill(-1, ["pid"])


SLICE = "CAST(floor(z*20) AS INTEGER)"


@query(f"WITH RECURSIVE p0 AS (SELECT * FROM ({'WITH ' + P + ' SELECT * FROM p'})), p AS (SELECT frame AS sample, {SLICE} AS frame, pid, x, y FROM p0), "
       f"""cand AS (SELECT a.sample, a.frame, a.pid AS f, b.pid AS t, (b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y) AS cost FROM p a JOIN p b
  ON a.sample = b.sample AND b.frame = a.frame+1 WHERE (b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y) < 0.01), """
       + greedy_sql("(SELECT (sample, frame) AS frame, f, t, cost FROM cand)") + """,
 ln AS (SELECT acc.frame[2] AS frame, f, t, 1 AS step FROM acc), """ + CHAIN +
       """, sm AS (SELECT hd.*, p.sample FROM hd JOIN p ON p.pid = hd.pid)
 SELECT sample, dense_rank() OVER (PARTITION BY sample ORDER BY hf, hp) - 1 AS pile, frame AS slice, pid FROM sm""")
def slice_stacking(spark, d):
    slices = positions(spark, d).select(F.col("frame").alias("sample"), F.floor(F.col("z") * 20).cast("int").alias("frame"), "pid", "x", "y")
    piles = linking.link_frames(slices, 0.1, group=["sample"], coords=["x", "y"])
    return piles.select("sample", F.col("tr").alias("pile"), F.col("frame").alias("slice"), "pid")


def thin_sql(order, conflict):
    return f"""tk AS (SELECT frame, list_reduce(list({{'k': [{{'id': pid, 'x': x, 'y': y, 'z': z, 'r': r}}]}} ORDER BY {order}),
  lambda a, b : CASE WHEN len(list_filter(a.k, lambda u : {conflict})) > 0 THEN a ELSE {{'k': list_concat(a.k, b.k)}} END) AS s FROM p GROUP BY 1)
 SELECT frame, unnest(s.k).id AS pid FROM tk"""


U2 = "((u.x-b.k[1].x)*(u.x-b.k[1].x)+(u.y-b.k[1].y)*(u.y-b.k[1].y)+(u.z-b.k[1].z)*(u.z-b.k[1].z))"


@query(f"WITH {P}, " + thin_sql("pid", f"{U2} < {BOND}*{BOND}"))
def thinning_by_order(spark, d):
    return matching.thin(positions(spark, d), BOND, []).select("frame", "pid")


@query(f"WITH {P}, " + thin_sql("f, pid", f"{U2} < ((u.r + b.k[1].r)*(u.r + b.k[1].r))"))
def overlap_removal(spark, d):
    pos = positions(spark, d)
    widest = pos.agg(F.max("r")).first()[0]
    return matching.remove_overlapping(pos, widest, intensity="f").select("frame", "pid")


@query(f"WITH {P}, " + thin_sql("f, pid", f"{U2} < greatest(u.r, b.k[1].r)*greatest(u.r, b.k[1].r)"))
def half_overlap_removal(spark, d):
    pos = positions(spark, d)
    widest = pos.agg(F.max("r")).first()[0]
    return matching.remove_overlapping(pos, widest, half=True, intensity="f").select("frame", "pid")
