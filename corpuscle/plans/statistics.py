"""Histograms, mean maps, profiles, scattering."""

import math

from pyspark.sql import functions as F

from ..operators import pairs, scattering, stats
from .catalog import query, rounded, s3, s6
from .spatial import CUT, BINS, RDF
from .tables import P, positions, table

PRICE = tuple(f"(SELECT {f}(l_extendedprice) FROM lineitem)" for f in ("min", "max"))


def hist_bin(v, lo, hi, n):
    return f"CASE WHEN {v} = {hi} THEN {n - 1} ELSE CAST(floor(({v} - ({lo})::DOUBLE)*({n}/(({hi})::DOUBLE - ({lo})::DOUBLE))) AS INTEGER) END"


@query(f"""WITH h AS (SELECT l_returnflag, {hist_bin('l_extendedprice', *PRICE, 50)} AS bin FROM lineitem)
 SELECT l_returnflag, bin, count(*) AS n FROM h WHERE bin BETWEEN 0 AND 49 GROUP BY 1, 2""")
def price_histogram(spark, d):
    lines = table(spark, d, "lineitem")
    return stats.histogram(lines, "l_extendedprice", *stats.value_range(lines, "l_extendedprice"), 50, ["l_returnflag"])


@query(f"""WITH h AS (SELECT {hist_bin('l_quantity', 1.0, 51.0, 10)} AS bin_x, {hist_bin('l_extendedprice', *PRICE, 20)} AS bin_y FROM lineitem)
 SELECT bin_x, bin_y, count(*) AS n FROM h WHERE bin_x BETWEEN 0 AND 9 AND bin_y BETWEEN 0 AND 19 GROUP BY 1, 2""")
def quantity_price_histogram(spark, d):
    lines = table(spark, d, "lineitem")
    return stats.histogram2d(lines, "l_quantity", "l_extendedprice", (1.0, 51.0), stats.value_range(lines, "l_extendedprice"), (10, 20))


@query(f"""WITH h AS (SELECT {hist_bin('l_extendedprice', *PRICE, 200)} AS bin FROM lineitem), c AS (SELECT bin, count(*) AS n FROM h WHERE bin BETWEEN 0 AND 199 GROUP BY 1),
 f AS (SELECT list_reduce(list({{'d': [{{'first': bin, 'last': bin, 'n': n, 'open': n <= 1000}}]}} ORDER BY bin),
  lambda a, b : CASE WHEN a.d[-1].open THEN {{'d': list_concat(a.d[:-2], [{{'first': a.d[-1].first, 'last': b.d[1].last, 'n': a.d[-1].n + b.d[1].n, 'open': a.d[-1].n + b.d[1].n <= 1000}}])}}
   ELSE {{'d': list_concat(a.d, b.d)}} END) AS s FROM c), u AS (SELECT unnest(s.d) AS r FROM f)
 SELECT r.first AS first, r.last AS last, r.n AS n FROM u""")
def decimated_histogram(spark, d):
    lines = table(spark, d, "lineitem")
    hist = stats.histogram(lines, "l_extendedprice", *stats.value_range(lines, "l_extendedprice"), 200)
    return stats.decimate_histogram(hist, 1000, 200)


@query(f"""WITH h AS (SELECT {hist_bin('l_quantity', 1.0, 51.0, 25)} AS bin, l_extendedprice AS v FROM lineitem)
 SELECT bin, count(v) AS n, {s3('avg(v)')} AS mean FROM h WHERE bin BETWEEN 0 AND 24 GROUP BY 1""")
def mean_price_by_quantity(spark, d):
    return rounded(stats.mean_map(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 1.0, 51.0, 25), "mean", digits=3)


@query(f"""WITH h AS (SELECT {hist_bin('l_quantity', 1.0, 61.0, 12)} AS bin_x, {hist_bin('l_discount', 0.0, 0.2, 4)} AS bin_y, l_extendedprice AS v FROM lineitem),
 m AS (SELECT bin_x, bin_y, avg(v) AS mean FROM h GROUP BY 1, 2)
 SELECT CAST(a.i AS INTEGER) AS bin_x, CAST(b.i AS INTEGER) AS bin_y, {s3('coalesce(mean, -1)')} AS mean FROM range(12) a(i), range(4) b(i)
 LEFT JOIN m ON m.bin_x = a.i AND m.bin_y = b.i""")
def mean_price_map(spark, d):
    return rounded(stats.mean_map2d(table(spark, d, "lineitem"), "l_quantity", "l_discount", "l_extendedprice", (1.0, 61.0), (0.0, 0.2), (12, 4)), "mean", digits=3)


@query(f"""WITH h AS (SELECT l_returnflag, {hist_bin('l_quantity', 1.0, 51.0, 10)} AS bin, l_extendedprice AS v FROM lineitem),
 o AS (SELECT l_returnflag, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1)
 SELECT h.l_returnflag, bin, count(v) AS n, {s6('avg(v)/any_value(o.m)')} AS mean, {s6('stddev_pop(v)/any_value(o.m)')} AS dev
 FROM h JOIN o USING (l_returnflag) WHERE bin BETWEEN 0 AND 9 GROUP BY 1, 2""")
def relative_moments_by_quantity(spark, d):
    return rounded(stats.binned_moments(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 1.0, 51.0, 10, ["l_returnflag"]), "mean", "dev")


@query(f"""WITH {P}, h AS (SELECT frame, {hist_bin('z', -0.5, 0.5, 20)} AS bin FROM p) SELECT frame, bin, count(*) AS n, round(count(*)/(0.04/20)::DOUBLE, 6) AS density FROM h WHERE bin BETWEEN 0 AND 19 GROUP BY 1, 2""")
def height_profile(spark, d):
    return rounded(stats.z_profile(positions(spark, d), -0.5, 0.5, 20, 0.04, keys=["frame"]), "density")


@query(f"WITH {P} SELECT frame, count(*) AS n, {s6('count(*)/(0.04*0.2)')} AS density FROM p WHERE z BETWEEN -0.1 AND 0.1 GROUP BY 1")
def slab_density(spark, d):
    return rounded(stats.slab_density(positions(spark, d), -0.1, 0.1, 0.04), "density")


SMOOTH = "s AS (SELECT bin, avg(g) OVER (ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS g FROM tot)"
TOT = f"WITH {P}, {RDF}, tot AS (SELECT bin, avg(r) AS r, avg(g) AS g FROM rdf GROUP BY 1)"


def _total(spark, d):
    return pairs.mean_rdf(pairs.rdf(positions(spark, d), CUT, BINS, margin=0.1))


@query(TOT + f""", {SMOOTH}, k AS (SELECT bin, g, lag(g) OVER (ORDER BY bin) AS a, lead(g) OVER (ORDER BY bin) AS b FROM s) SELECT bin, {s6('g')} AS g FROM k WHERE g > a AND g > b""")
def correlation_envelope(spark, d):
    return rounded(stats.local_maxima(_total(spark, d), "bin", "g", smooth=1), "g")


@query(TOT + f""", k AS (SELECT bin, g, lag(g) OVER (ORDER BY bin) AS a, lead(g) OVER (ORDER BY bin) AS b FROM tot)
 SELECT bin, {s6('g')} AS g, CASE WHEN g > a AND g > b THEN 'peak' ELSE 'valley' END AS kind FROM k WHERE (g > a AND g > b) OR (g < a AND g < b)""")
def peaks_and_valleys(spark, d):
    return rounded(stats.peaks_and_valleys(_total(spark, d), "bin", "g"), "g")


@query(TOT + f""", q AS (SELECT CAST(i AS DOUBLE)*2 AS q FROM range(1, 11) r(i)) SELECT q, {s6(f'1 + 4*pi()*50*sum((g-1)*r*sin(q*r)*{CUT / BINS!r}/q)')} AS s FROM tot, q GROUP BY 1""")
def radial_structure_factor(spark, d):
    return rounded(scattering.radial_transform(_total(spark, d), [2.0 * i for i in range(1, 11)], 50.0, CUT / BINS), "s")


# --- wave vectors ------------------------------------------------------------------------------------

def kvec_sql(nbins):
    """The same shells by SQL: (i, j, floor(sqrt(n2 - i2 - j2))) and its rotations, each vector once."""
    return f"""seeds AS (SELECT n, i, j, CAST(floor(sqrt(n*n-i*i-j*j)) AS BIGINT) AS k
   FROM range(1, {nbins}) a(n), range(0, {nbins}) b(i), range(0, {nbins}) c(j) WHERE i < n AND i*i+j*j < n*n),
 kv AS (SELECT *, row_number() OVER (ORDER BY n, a, b, c) AS id FROM (SELECT n, i AS a, j AS b, k AS c FROM seeds UNION SELECT n, j, k, i FROM seeds UNION SELECT n, k, i, j FROM seeds))"""


def sq_sql(weight, box=(1.0, 1.0, 1.0), after=""):
    k = [2 * math.pi / L for L in box]
    ph = f"({k[0]!r}*a*x + {k[1]!r}*b*y + {k[2]!r}*c*z)"
    return f"""WITH {P}, {kvec_sql(10)}, w AS (SELECT *, {weight} AS w FROM p),
 s AS (SELECT frame, n, id, sum(w*cos({ph})) AS cc, sum(w*sin({ph})) AS ss, count(*) AS np FROM w, kv GROUP BY 1, 2, 3),
 sq AS (SELECT frame, n, count(*) AS n_k, avg((cc*cc+ss*ss)/np) AS s FROM s GROUP BY 1, 2)
 SELECT frame, CAST(n AS INTEGER) AS q_bin, n_k, {s6('s' + after)} AS s FROM sq"""


@query(sq_sql("1.0"))
def structure_factor(spark, d):
    return rounded(scattering.structure_factor(positions(spark, d), 10, [1.0] * 3), "s")


@query(sq_sql("f", (1.0, 0.8, 0.9)))
def structure_factor_of_field(spark, d):
    return rounded(scattering.structure_factor(positions(spark, d), 10, [1.0, 0.8, 0.9], field=F.col("f")), "s")


HANN = "*".join(f"(0.5*(1-cos(({c}+0.5)*{2 * math.pi!r})))" for c in "xyz")


@query(sq_sql(HANN).replace("SELECT frame, CAST(n AS INTEGER)", f"SELECT sq.frame, CAST(n AS INTEGER)").replace(
    s6("s"), s6("s/w2")) + f" JOIN (SELECT frame, avg(w*w) AS w2 FROM w GROUP BY 1) z ON z.frame = sq.frame")
def structure_factor_windowed(spark, d):
    return rounded(scattering.windowed_structure_factor(positions(spark, d), 10, [1.0] * 3, [-0.5] * 3), "s")


@query(f"""WITH {P}, q AS (SELECT DISTINCT CAST(floor(sqrt(x*x+y*y)*20) AS INTEGER) AS b FROM p), c AS (SELECT (b+1)*2.0::DOUBLE AS q, 1 + avg(f)::DOUBLE AS s
  FROM p JOIN q ON floor(sqrt(x*x+y*y)*20) = b GROUP BY b), g AS (SELECT q, s, coalesce(
   CASE WHEN lag(s) OVER (ORDER BY q) IS NULL THEN lead(s) OVER (ORDER BY q) - s WHEN lead(s) OVER (ORDER BY q) IS NULL THEN s - lag(s) OVER (ORDER BY q)
    ELSE (lead(s) OVER (ORDER BY q) - lag(s) OVER (ORDER BY q))/2 END, 0) AS g FROM c)
 SELECT a.q, {s6('1 + coalesce(sum((-2*b.g/0.1 + 2.0*b.q/6*(0.1 - 0.001*(b.q*b.q-a.q*a.q)/60)*(b.s-1))/sqrt(b.q*b.q-a.q*a.q)), 0)')} AS s3
 FROM g a LEFT JOIN g b ON b.q > a.q GROUP BY 1""")
def slice_to_bulk_structure(spark, d):
    ring = F.floor(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) * 20)
    curve = positions(spark, d).groupBy(((ring + 1) * 2.0).alias("q")).agg((1 + F.avg("f")).alias("s"))
    return rounded(scattering.slice_to_bulk(curve, 0.1, 2.0), "s3")


GRID = (16, 16, 16)


@query(f"""WITH {P} SELECT frame, CAST((floor((x+0.5)*16)*16 + floor((y+0.5)*16))*16 + floor((z+0.5)*16) AS INTEGER) AS pixel, {s6('sum(1.0)')} AS v FROM p
 WHERE {' AND '.join(f'floor(({c}+0.5)*16) BETWEEN 0 AND 15' for c in 'xyz')} GROUP BY 1, 2""")
def pixel_density(spark, d):
    return rounded(scattering.pixel_counts(positions(spark, d), GRID, [-0.5] * 3, [0.5] * 3), "v")


def spectrum_sql(axes, weight="1.0", flat=None):
    """Spectrum of the Hamming-windowed grid minus its mean.  By linearity only lit pixels are transformed; what the
    mean adds is a product of one-dimensional sums over the window.  ``flat``: an axis of which only k = 0 is kept."""
    n = 16
    hams = "ham AS (SELECT i, 0.54 - 0.46*cos(2*pi()*i/15) AS w FROM range(16) r(i))"
    w1 = "w1 AS (SELECT k, sum(w*cos(2*pi()*k*i/16)) AS c, sum(w*sin(2*pi()*k*i/16)) AS s FROM ham, range(16) r(k) GROUP BY 1)"
    ix = {a: f"floor(({a}+0.5)*16)" for a in axes}
    px = "px AS (SELECT frame, " + ", ".join(f"{e}::BIGINT AS i{a}" for a, e in ix.items()) + f", sum({weight})::DOUBLE AS v FROM p WHERE " \
        + " AND ".join(f"{e} BETWEEN 0 AND 15" for e in ix.values()) + f" GROUP BY ALL), tot AS (SELECT frame, sum(v) AS total, sum(v)/{n ** len(axes)} AS mean FROM px GROUP BY 1)"
    wp = "wp AS (SELECT px.*, v*" + "*".join(f"h{a}.w" for a in axes) + " AS u FROM px " + " ".join(f"JOIN ham h{a} ON h{a}.i = i{a}" for a in axes) + ")"
    kv = "kv AS (SELECT " + ", ".join(f"k{a}.k AS k{a}" for a in axes) + ", " + ", ".join(f"k{a}.c AS c{a}, k{a}.s AS s{a}" for a in axes) \
        + ", sqrt(" + "+".join(f"least(k{a}.k, 16-k{a}.k)*least(k{a}.k, 16-k{a}.k)" for a in axes) + ") AS q FROM " + ", ".join(f"w1 k{a}" for a in axes) + (f" WHERE k{flat}.k = 0)" if flat else ")")
    ph = "2*pi()/16*(" + "+".join(f"k{a}*i{a}" for a in axes) + ")"
    am = f"am AS (SELECT frame, {', '.join(f'k{a}' for a in axes)}, any_value(q) AS q, sum(u*cos({ph})) AS re, sum(u*sin({ph})) AS im, " \
        + ", ".join(f"any_value(c{a}) AS c{a}, any_value(s{a}) AS s{a}" for a in axes) + f" FROM wp, kv WHERE q < 8 GROUP BY frame, {', '.join(f'k{a}' for a in axes)})"
    re, im = f"c{axes[0]}", f"s{axes[0]}"
    for a in axes[1:]:
        re, im = f"({re}*c{a}-{im}*s{a})", f"({re}*s{a}+{im}*c{a})"
    sp = f"sp AS (SELECT am.frame, CAST(floor(q + 1e-9) AS INTEGER) AS q_bin, (power(re-mean*{re}, 2)+power(im-mean*{im}, 2))/total AS power FROM am JOIN tot USING (frame))"
    return f"WITH {P}, {hams}, {w1}, {px}, {wp}, {kv}, {am}, {sp}, g AS (SELECT frame, q_bin, count(*) AS n_k, avg(power) AS power FROM sp GROUP BY 1, 2)"


@query(spectrum_sql("xyz") + f" SELECT frame, q_bin, n_k, {s6('power')} AS power FROM g")
def grid_spectrum_3d(spark, d):
    pixels = scattering.pixel_counts(positions(spark, d), GRID, [-0.5] * 3, [0.5] * 3)
    return rounded(scattering.grid_spectrum(pixels, GRID, [1.0] * 3, 8), "power")


@query(spectrum_sql("xy") + f" SELECT q_bin, sum(n_k)::BIGINT AS n_k, {s6('sum(power*n_k)/sum(n_k)')} AS power FROM g GROUP BY 1")
def grid_spectrum_2d(spark, d):
    pixels = scattering.pixel_counts(positions(spark, d), GRID[:2], [-0.5] * 2, [0.5] * 2, coords=["x", "y"])
    return rounded(scattering.average_spectra(scattering.grid_spectrum(pixels, GRID[:2], [1.0] * 2, 8)), "power")


BINARY = "CASE WHEN f > (SELECT quantile_disc(f, 0.75) FROM p) THEN 1.0 ELSE 0.0 END"


@query(spectrum_sql("xyz", BINARY, "z") + f" SELECT frame, q_bin, n_k, {s6('power')} AS power FROM g")
def grid_spectrum_binary_field(spark, d):
    marked = scattering.binary_weight(positions(spark, d), "f", 0.25)
    pixels = scattering.pixel_counts(marked, GRID, [-0.5] * 3, [0.5] * 3, weight=F.col("w"))
    return rounded(scattering.grid_spectrum(pixels, GRID, [1.0] * 3, 8, flat_last=True), "power")
