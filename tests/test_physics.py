import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuscle.functions import curves, geometry, optics, thermo
from corpuscle.operators import scattering, voronoi

from .helpers import random_points


def test_equations_of_state_agree_at_low_density():
    f = thermo.from_fraction(0.1)
    for fluid in (thermo.CARNAHAN_STARLING, thermo.KOLAFA, thermo.LE_FEVRE, thermo.LIU):
        assert fluid.compressibility(f) == pytest.approx(1.5214, abs=0.01)
        assert fluid.bare_potential(f) - fluid.offset == pytest.approx(math.log(0.1) + 8 * f + 7 * f * f + 2 * f ** 3, abs=0.02)


def test_pressure_and_potential_belong_together():
    """f dmu = (1 + f) dp for every equation, with and without polymer."""
    for fluid in (thermo.CARNAHAN_STARLING, thermo.KOLAFA, thermo.LE_FEVRE, thermo.LIU, thermo.HALL):
        for piv in (0.0, 2.0):
            f, h = 0.6, 1e-5
            dp = fluid.pressure(f + h, piv, 0.5) - fluid.pressure(f - h, piv, 0.5)
            dmu = fluid.potential(f + h, piv, 0.5) - fluid.potential(f - h, piv, 0.5)
            assert dmu * f == pytest.approx((1 + f) * dp, rel=1e-6)
    for order in range(3):
        low, high = (thermo.free_volume(0.4 + e, 0.7, order=order) for e in (-1e-6, 1e-6))
        assert thermo.free_volume(0.4, 0.7, order=order + 1) == pytest.approx((high - low) / 2e-6, rel=1e-5)


def test_hard_sphere_freezing():
    fluid, solid = thermo.coexistence(thermo.CARNAHAN_STARLING, thermo.HALL, 0.0, 0.5)
    assert thermo.to_fraction(fluid) == pytest.approx(0.494, abs=0.01)
    assert thermo.to_fraction(solid) == pytest.approx(0.545, abs=0.01)


def test_gas_liquid_binodal():
    eos, q = thermo.CARNAHAN_STARLING, 0.8
    fc, pc = thermo.critical_point(eos, q)
    assert thermo.spinodal(eos, pc * 0.9, q) == pytest.approx((math.nan, math.nan), nan_ok=True)
    gas, liquid = thermo.binodal(eos, pc * 1.3, q)
    s_gas, s_liquid = thermo.spinodal(eos, pc * 1.3, q)
    assert gas < s_gas < fc < s_liquid < liquid
    assert eos.pressure(gas, pc * 1.3, q) == pytest.approx(eos.pressure(liquid, pc * 1.3, q), rel=1e-6)
    assert eos.potential(gas, pc * 1.3, q) == pytest.approx(eos.potential(liquid, pc * 1.3, q), rel=1e-6)


def test_triple_point():
    eos, solid = thermo.CARNAHAN_STARLING, thermo.HALL
    piv, gas, liquid, crystal = thermo.triple_point(eos, solid, 0.6)
    assert gas < liquid < crystal
    assert eos.pressure(liquid, piv, 0.6) == pytest.approx(solid.pressure(crystal, piv, 0.6), rel=1e-3)


def test_size_ratio():
    assert 0.1 < thermo.size_ratio(0.1) < 0.11
    assert thermo.size_ratio(0.5, "ideal") == pytest.approx(0.9 * 0.5 ** 0.9)


def test_blurred_sphere_limits(spark):
    row = spark.range(1).select(optics.blurred_sphere(5.0, 0.1).alias("inside"), optics.blurred_sphere(5.0, 0.1, F.lit(30.0)).alias("far"),
                                optics.radius_to_sigma(optics.sigma_to_radius(3.0)).alias("s"),
                                optics.radius_to_scale(optics.scale_to_radius(2.5)).alias("k")).first()
    assert row["inside"] == pytest.approx(1) and abs(row["far"]) < 1e-9
    assert row["s"] == pytest.approx(3) and row["k"] == pytest.approx(2.5)


def test_intensities_solve_the_dense_system(spark):
    rng = np.random.default_rng(0)
    xyz = rng.permutation([(a, b, c) for a in range(3) for b in range(3) for c in range(2)])[:14] * 14.0
    sigma, r, value = rng.uniform(2, 2.5, 14), rng.uniform(4, 5, 14), -rng.uniform(1, 2, 14)
    points = spark.createDataFrame([(0, i, float(s), float(q), float(v)) for i, (s, q, v) in enumerate(zip(sigma, r, value))],
                                   "frame int, pid bigint, sigma double, r double, intensity double")
    d = np.sqrt(((xyz[None] - xyz[:, None]) ** 2).sum(-1))
    pairs = [(0, i, j, float(d[i, j])) for i in range(14) for j in range(i + 1, 14) if d[i, j] < 20]
    bonds = spark.createDataFrame(pairs, "frame int, low bigint, high bigint, d double")
    got = optics.solve_intensities(points, bonds).toPandas().sort_values("p")["v"].to_numpy()
    alpha = 2 ** (1 / 3)

    def g(radius, s, dist=None):
        if dist is None:
            x = radius / s / math.sqrt(2)
            return math.erf(x) - x * math.exp(-x * x) * 2 / math.sqrt(math.pi)
        half = lambda e: math.exp(-(radius + e) ** 2 / (2 * s * s)) * math.sqrt(2 / math.pi) * s / e + math.erf((radius + e) / s / math.sqrt(2))
        return half(dist) + half(-dist)
    m = np.diag([g(a, alpha * s) - g(a, s) for a, s in zip(r, sigma)])
    for _, i, j, dist in pairs:
        m[i, j] = g(r[j], alpha * sigma[i], dist) - g(r[j], sigma[i], dist)
        m[j, i] = g(r[i], alpha * sigma[j], dist) - g(r[i], sigma[j], dist)
    assert np.allclose(got, np.linalg.solve(m, value), rtol=1e-6)
    assert optics.global_rescale(points, bonds).count() == 14


def test_fits(spark):
    t = np.arange(1, 60)
    curve = spark.createDataFrame(pd.DataFrame({"lag": t, "isf": 0.9 * np.exp(-(t / 12.0) ** 0.7), "msd": 6 * 0.25 * t}))
    p = curves.fit(curve, "decay", "lag", "isf").first()
    assert (p["plateau"], p["tau"], p["beta"]) == pytest.approx((0.9, 12.0, 0.7), rel=1e-3)
    assert curves.fit(curve, "diffusion", "lag", "msd").first()["d"] == pytest.approx(0.25, rel=1e-6)
    phi = np.linspace(0.3, 0.55, 20)
    vft = spark.createDataFrame(pd.DataFrame({"phi": phi, "tau": 20 * np.exp(0.4 * phi / (0.6 - phi))}))
    assert tuple(curves.fit(vft, "vft", "phi", "tau").first()) == pytest.approx((20, 0.4, 0.6), rel=1e-2)
    both = pd.concat([pd.DataFrame({"id": i, "t": t, "y": 0.8 * np.exp(-(t / tau) ** 0.9)}) for i, tau in enumerate((5.0, 20.0))])
    shared = curves.fit_shared_plateau(spark.createDataFrame(both), "t", "y", "id").toPandas().sort_values("id")
    assert np.allclose(shared[["plateau", "tau", "beta"]], [[0.8, 5, 0.9], [0.8, 20, 0.9]], rtol=1e-2)


def test_fits_of_many_curves(spark):
    """Noisy curves side by side, one of them without a name, against the solver for a single one; a curve that has no best fit says so."""
    rng, t, rows, want = np.random.default_rng(8), np.arange(1.0, 50.0), [], {}
    for name, p in (("a", (0.9, 12.0, 0.7)), ("b", (0.7, 5.0, 1.1)), (None, (0.95, 30.0, 0.9))):
        y = curves.stretched(p, t) + rng.normal(0, 0.01, len(t))
        rows += [(name, float(u), float(v)) for u, v in zip(t, y)] + [(name, None, 1.0), (name, 3.0, None)]
        want[name] = curves.levenberg_marquardt(lambda p: curves.stretched(p, t) - y, [0.95, 10.0, 1.0])
    rows += [("flat", float(u), 1.0 + 0.2 * (-1) ** i) for i, u in enumerate(t[:12])] + [("none", 1.0, None)]
    df = spark.createDataFrame(rows, "name string, t double, y double")
    got = {r["name"]: r for r in curves.fit_curves(df, "decay", "t", "y", by=["name"], start=[0.95, 10.0, 1.0]).collect()}
    assert set(got) == {"a", "b", None, "flat"} and got["a"]["n"] == 49
    for name, p in want.items():
        assert got[name]["converged"] and tuple(got[name])[1:4] == pytest.approx(tuple(p), rel=1e-4)
    line = curves.fit_curves(df.where("name = 'a'"), "line", "t", "y").first()
    slope, intercept = np.polyfit(t, [r[2] for r in rows[:49]], 1)
    assert (line["intercept"], line["slope"], line["converged"]) == (pytest.approx(intercept), pytest.approx(slope), True)
    bad = curves.fit_curves(df.where("name = 'a'"), "decay", "t", "y", start=[0.95, 10.0, 1.0], most=1).first()
    assert not bad["converged"]
    assert curves.fit_curves(df.where("name = 'x'"), "line", "t", "y").count() == 0


def test_newtonian_fluid_has_no_storage_modulus(spark):
    t = np.logspace(-2, 2, 40)
    got = curves.microrheology(spark.createDataFrame(pd.DataFrame({"lag": t, "msd": 6 * 0.1 * t})), 1.0, 0.5, 300.0).toPandas().sort_values("omega")
    viscosity = curves.BOLTZMANN * 300 / (6 * math.pi * 0.5e-6 * 0.1e-12)
    assert len(got) == 40
    assert np.allclose(got.loss, viscosity * got.omega, rtol=0.02) and np.allclose(got.storage, 0, atol=0.02 * got.loss.max())


def test_local_parabolas(spark):
    rng = np.random.default_rng(3)
    x = np.sort(np.exp(rng.uniform(-3, 3, 60)))
    y = x ** 0.7 * np.exp(0.1 * rng.normal(size=60))
    curve = pd.concat([pd.DataFrame({"c": c, "x": x, "y": y * (c + 1)}) for c in range(2)])
    got = curves.local_parabolas(spark.createDataFrame(curve), "x", "y", 0.7, ["c"]).toPandas().sort_values(["c", "x"])
    for c in range(2):
        for u, row in zip(np.log(x), got[got.c == c].itertuples()):
            w = np.exp(-((np.log(x) - u) ** 2) / (2 * 0.7 ** 2))
            near = w > 0.03
            a, b, v = np.polyfit(np.log(x)[near] - u, np.log(y * (c + 1))[near], 2, w=w[near])
            assert (row.level, row.slope, row.bend) == pytest.approx((math.exp(v), b, 2 * a), rel=1e-6, abs=1e-9)


def test_log_gamma(spark):
    zs = [0.01, 0.5, 1.0, 1.7, 4.2, 30.0]
    for r in spark.createDataFrame([(z,) for z in zs], "z double").select("z", curves.log_gamma(F.col("z")).alias("g")).collect():
        assert r.g == pytest.approx(math.lgamma(r.z), abs=1e-10)


def test_alternating_extrema(spark):
    y = [0.0, 3.0, 1.0, 2.0, 1.5, 1.7, 1.6]
    curve = spark.createDataFrame([(float(i), v) for i, v in enumerate(y)], "x double, y double")
    assert [(r.kind, r.x) for r in curves.alternating_extrema(curve, "x", "y").orderBy("rank").collect()] == [
        ("peak", 1.0), ("valley", 2.0), ("peak", 3.0), ("valley", 4.0), ("peak", 5.0), ("valley", 6.0)]


def test_voronoi_cells_of_a_lattice(spark):
    sites = [(x + 0.5, y + 0.5, z + 0.5) for x in range(4) for y in range(4) for z in range(4)]
    df = spark.createDataFrame([(0, i, *s) for i, s in enumerate(sites)], "frame int, pid bigint, x double, y double, z double")
    cells = voronoi.voronoi(df, 1.2, margin=0.5).toPandas()
    assert np.allclose(cells["volume"], 1.0)
    inner = cells[[all(1 < c < 3 for c in sites[p]) for p in cells["p"]]]
    assert all(sum(1 for f in faces if f["area"] > 1e-9 and f["q"] >= 0) == 6 for faces in inner["faces"])


def test_voronoi_volumes_fill_the_box(spark):
    df, pdf = random_points(spark, 60, 1, seed=12)
    cells = voronoi.voronoi(df, 0.3, margin=0.05)
    box = np.prod(pdf[["x", "y", "z"]].max() - pdf[["x", "y", "z"]].min() + 0.1)
    assert cells.agg(F.sum("volume")).first()[0] == pytest.approx(box)
    edges = voronoi.voronoi_edges(cells).where("area > 1e-9").toPandas()
    assert {(r.p, r.q) for r in edges.itertuples()} == {(r.q, r.p) for r in edges.itertuples()}
    assert voronoi.coarse_grained_volume(cells).count() == 60


def test_structure_factor_of_a_lattice(spark):
    sites = [(x / 4, y / 4, z / 4) for x in range(4) for y in range(4) for z in range(4)]
    df = spark.createDataFrame([(0, i, *map(float, s)) for i, s in enumerate(sites)], "frame int, pid bigint, x double, y double, z double")
    s = {r.q_bin: r.s for r in scattering.structure_factor(df, 5, [1.0] * 3).collect()}
    assert all(abs(s[n]) < 1e-9 for n in (1, 2, 3)) and s[4] > 1


def test_grid_spectrum_is_parseval(spark):
    df, pdf = random_points(spark, 200, 1, seed=13)
    pixels = scattering.pixel_counts(df, (8, 8), [0, 0], [1, 1], coords=["x", "y"])
    got = scattering.grid_spectrum(pixels, (8, 8), [1.0, 1.0], 6, window=False, subtract_mean=False).toPandas()
    assert got.loc[got.q_bin == 0, "power"].iloc[0] == pytest.approx(200)


@pytest.mark.parametrize("nbins,ndim", [(2, 3), (7, 3), (19, 3), (2, 2), (40, 2)])
def test_shells_are_the_same_relation_on_both_sides(spark, nbins, ndim):
    def shell(n):
        grid = [g for g in np.ndindex(*(n,) * (ndim - 1)) if sum(x * x for x in g) < n * n]
        seeds = [(*g, math.isqrt(n * n - sum(x * x for x in g))) for g in grid]
        return {v[t:] + v[:t] for v in seeds for t in range(ndim)}
    want = {(n, int(sum(x * nbins ** (ndim - 1 - i) for i, x in enumerate(v)))) for n in range(1, nbins) for v in shell(n)}
    assert {tuple(r) for r in scattering.shell_table(spark, nbins, ndim).collect()} == want
    assert set(scattering._used(nbins, ndim).tolist()) == {code for _, code in want}


def test_amplitudes_of_many_shells(spark):
    rng = np.random.default_rng(3)
    rows = [(int(f), float(x), float(y), float(w)) for f, x, y, w in zip(rng.integers(0, 3, 400), *rng.random((3, 400)))]
    df = spark.createDataFrame([*rows, (0, None, 0.5, 1.0)], "frame int, x double, y double, w double").repartition(5)
    got = scattering.amplitude_sums(df, 25, [1.0, 0.7], coords=["x", "y"], field=F.col("w")).toPandas()
    for r in got.sample(60, random_state=1).itertuples():
        k = divmod(r.k_id, 25)
        phase = [(w, 2 * np.pi * (k[0] * x + k[1] * y / 0.7)) for f, x, y, w in rows if f == r.frame]
        assert (r.c, r.s) == (pytest.approx(sum(w * math.cos(a) for w, a in phase), abs=1e-9), pytest.approx(sum(w * math.sin(a) for w, a in phase), abs=1e-9))
    assert got.groupby("frame").n.max().sum() == 401


def test_plan_does_not_grow_with_the_bins(spark):
    df, _ = random_points(spark, 20, 1, seed=1)
    size = lambda bins: len(scattering.structure_factor(df, bins, [1.0] * 3)._jdf.queryExecution().toString())
    assert size(60) < size(6) + 200


@pytest.mark.parametrize("flat", [False, True])
def test_pencils_against_a_whole_transform(spark, flat):
    shape, lengths, nbins = (7, 6, 9), [1.4, 1.0, 1.8], 5
    rng = np.random.default_rng(4)
    grid = rng.poisson(0.1, (2, *shape)).astype(float)
    rows = [(f, int(i), float(v)) for f in range(2) for i, v in enumerate(grid[f].ravel()) if v]
    pixels = spark.createDataFrame(rows, "frame int, pixel int, v double")
    got = {(r.frame, r.q_bin): (r.n_k, r.power) for r in scattering.grid_spectrum(pixels, shape, lengths, nbins, flat_last=flat).collect()}
    width = 2 * math.pi / max(lengths)
    q = np.sqrt(sum((2 * math.pi * np.fft.fftfreq(n, L / n)).reshape([-1 if i == a else 1 for i in range(3)]) ** 2 for a, (n, L) in enumerate(zip(shape, lengths))))
    for f in range(2):
        image = grid[f] - grid[f].mean()
        for a, n in enumerate(shape):
            image = image * np.hamming(n).reshape([-1 if i == a else 1 for i in range(3)])
        power, where = np.abs(np.fft.fftn(image)) ** 2 / grid[f].sum(), np.floor(q / width + 1e-9).astype(int)
        power, where = (power[..., 0], where[..., 0]) if flat else (power, where)
        for b in range(nbins):
            assert got[f, b] == (int((where == b).sum()), pytest.approx(power[where == b].mean() if (where == b).any() else 0.0, rel=1e-9))


def test_a_frame_is_transformed_by_many_tasks(spark):
    cells = spark.range(4096).selectExpr("struct(0 AS frame) AS g", "id AS before", "0L AS after", "1D AS re", "0D AS im")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")       # it would join lines as small as these
    try:
        spread = scattering._lines(cells, 16).groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) == 4 and max(r["count"] for r in spread) < 128


def test_minimum_image(spark):
    row = spark.range(1).select(geometry.minimg(F.lit(101.5), 203.0).alias("a"), geometry.minimg(F.lit(-3.0), 4.0).alias("b")).first()
    assert (row["a"], row["b"]) == (-101.5, 1.0)


def test_voronoi_cells_with_copies_and_few_neighbours(spark):
    df, pdf = random_points(spark, 60, 1, seed=18)
    pdf.loc[pdf.pid < 20, ["x", "y", "z"]] = 0.5
    box = np.prod(pdf[["x", "y", "z"]].max() - pdf[["x", "y", "z"]].min() + 0.1)
    many = voronoi.voronoi(spark.createDataFrame(pdf), 0.3, margin=0.05).toPandas().sort_values("p")
    few = voronoi.voronoi(spark.createDataFrame(pdf), 0.2, margin=0.05, nearest=4).toPandas().sort_values("p")
    assert many["volume"].sum() == pytest.approx(box) and np.allclose(many["volume"], few["volume"])
    assert many["volume"][:20].nunique() == 1


def test_voronoi_cell_takes_in_what_cuts_it():
    """However few planes a cell starts with, it ends as the cell between all of them; cells fill the box."""
    xyz, total = np.random.default_rng(3).random((150, 3)), 0.0
    for i in range(len(xyz)):
        others = np.flatnonzero(np.arange(len(xyz)) != i)
        walls = np.stack([xyz[i], 1 - xyz[i]], 1).ravel()
        few, many = (voronoi.cell(walls, others, xyz[others] - xyz[i], first) for first in (1, 30))
        assert few[0] == pytest.approx(many[0]) and few[1] == pytest.approx(many[1]) and list(few[2]) == list(many[2]) and np.allclose(few[3], many[3])
        total += few[0]
    assert total == pytest.approx(1.0)


def test_blur_derivatives_and_erf(spark):
    xs = [0.0, 1e-3, 0.4, 1.0, 2.2, 2.5, 2.6, 4.0, 9.0, -1.3, -3.0, 60.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", optics.erf("x").alias("e")).collect()
    assert all(r.e == pytest.approx(math.erf(r.x), abs=1e-13) for r in got)
    h = 1e-4
    for d in (None, F.lit(2.0), F.lit(7.0)):
        at = lambda r, s: optics.Blur(r, s, d)  # noqa: E731, B023
        row = spark.range(1).select(at(4.0, 1.5).by_sigma().alias("s"), ((at(4.0, 1.5 + h).value() - at(4.0, 1.5 - h).value()) / (2 * h)).alias("s2"),
                                    at(4.0, 1.5).shell().alias("r"), ((at(4.0 + h, 1.5).value() - at(4.0 - h, 1.5).value()) / (2 * h)).alias("r2"),
                                    at(4.0, 1.5).by_sigma_and_radius().alias("x"), ((at(4.0 + h, 1.5).by_sigma() - at(4.0 - h, 1.5).by_sigma()) / (2 * h)).alias("x2")).first()
        assert (row.s, row.r, row.x) == pytest.approx((row.s2, row.r2, row.x2), rel=1e-6)


@pytest.mark.parametrize("seed", range(2))
def test_systems_that_sweeps_cannot_solve(spark, seed):
    rng = np.random.default_rng(seed)
    systems = {f: rng.normal(0, 1, (n, n)) + 0.5 * np.eye(n) for f, n in ((0, 7), (1, 2), (2, 1))}
    systems[1] = np.array([[0.0, 2.0], [3.0, 1.0]])
    right = {f: rng.normal(0, 5, len(a)) for f, a in systems.items()}
    diagonal = spark.createDataFrame([(f, i, float(a[i, i]), float(right[f][i])) for f, a in systems.items() for i in range(len(a))], "frame int, p bigint, a double, b double")
    couplings = spark.createDataFrame([(f, i, j, float(a[i, j])) for f, a in systems.items() for i in range(len(a)) for j in range(len(a)) if i != j], "frame int, p bigint, q bigint, a double")
    found = optics.linear_solve(diagonal, couplings) if seed else optics.conjugate_gradients(diagonal, couplings)
    got = {(r.frame, r.p): r.v for r in found.collect()}
    for f, a in systems.items():
        assert [got[f, i] for i in range(len(a))] == pytest.approx(np.linalg.solve(a, right[f]).tolist(), rel=1e-6)
    assert optics.residual(found, diagonal, couplings).where("abs(left) > 1e-7 * size").count() == 0
    with pytest.raises(ValueError):
        optics.conjugate_gradients(spark.createDataFrame([(0, 0, 0.0, 1.0)], diagonal.schema), couplings.where("frame > 99"))


def test_small_systems_are_eliminated(spark, monkeypatch):
    """Systems that sweeps do not solve take no rounds where they fit into a task; larger ones beside them go on in rounds."""
    rng = np.random.default_rng(3)
    matrices = {g: rng.normal(size=(n, n)) + (3 * n if g == 2 else 0.1) * np.eye(n) for g, n in ((0, 30), (1, 1), (2, 50))}
    right = {g: rng.normal(size=len(m)) for g, m in matrices.items()}
    diagonal = spark.createDataFrame([(g, i + 100, float(m[i, i]), float(right[g][i])) for g, m in matrices.items() for i in range(len(m))], "frame int, p long, a double, b double")
    couplings = spark.createDataFrame([(g, i + 100, j + 100, float(m[i, j]) / 2) for g, m in matrices.items() for i in range(len(m)) for j in range(len(m)) if i != j for _ in range(2)],
                                      "frame int, p long, q long, a double")
    monkeypatch.setattr(optics, "conjugate_gradients", None)
    for limit in (100, 40):
        got = optics.linear_solve(diagonal, couplings, limit=limit).toPandas().sort_values(["frame", "p"])
        for g, m in matrices.items():
            assert np.allclose(got[got["frame"] == g]["v"], np.linalg.solve(m, right[g]), atol=1e-8)
    one = optics.linear_solve(diagonal.where("frame = 0").drop("frame"), couplings.where("frame = 0").drop("frame"), keys=[]).toPandas().sort_values("p")
    assert np.allclose(one["v"], np.linalg.solve(matrices[0], right[0]))


def test_exact_quantile_of_many_values(spark):
    from corpuscle.operators import scattering
    from corpuscle.operators.stats import exact_quantile
    values = np.random.default_rng(3).normal(size=60_000)
    values[:9_000] = 0.5
    df = spark.createDataFrame(pd.DataFrame({"frame": 0, "f": values}))
    ordered = np.sort(values)
    for share in (0.0, 0.1, 0.3337, 0.6, 0.7, 0.75, 0.99991, 1.0):
        assert exact_quantile(df, "f", share) == ordered[max(int(np.ceil(share * len(values))), 1) - 1]
        assert exact_quantile(df, "f", share, few=3) == ordered[max(int(np.ceil(share * len(values))), 1) - 1]
    assert exact_quantile(df.where("f is null"), "f", 0.5) is None
    assert scattering.binary_weight(df, "f", 0.25).agg({"w": "sum"}).first()[0] == (values > ordered[44_999]).sum()
