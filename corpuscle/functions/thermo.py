"""Hard spheres with polymer in the free-volume theory (Fleer & Tuinier 2008).

f = phi / (1 - phi); q is the effective size ratio; piv the insertion work of the polymer.  An equation of state is a table of coefficients: its
compressibility less one is a sum of fractions of polynomials.  Pressure follows from that sum, the chemical potential from one
quadrature of it, and the polymer terms from one recursion over the derivatives of the free volume.  All are expressions, on Spark columns as well
as on arrays: ``m`` is the module that supplies log, exp and log1p (pyspark.sql.functions or numpy).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the theory; polynomials from the constant term upwards.
F_FLUID, F_SOLID = 0.970, 1.185                    # hard-sphere coexistence
ETA_CP = math.pi / 6 * math.sqrt(2)                # close packing
F_CP = ETA_CP / (1 - ETA_CP)
HALL_MU = 2.1306
# Carnahan-Starling and Kolafa, Z - 1 in f
CS_Z = (0.0, 4.0, 6.0, 2.0)
KOLAFA_Z, KOLAFA_D = (3.0, 15.0, 30.0, 25.0, 5.0), (3.0, 3.0)
# Liu, Z in phi: divergence, strength, junction (powers 40, 42, 44), virial part
LIU_A = 1 / 0.635584
LIU_CS = (0.31416, 4.1637e10, -2.3452e11, 3.6684e11)
LIU_QZ = (1.0, -2.5848, 1.9499, -0.172284, -0.16012)
LIU_QZ_SCALE = 3.68584
# Le Fevre, pressure in f
LEFEVRE_P = (0.0, -0.826856, -3.40466, -5.35009, -3.89085, -1.21581, -0.0972383)
LEFEVRE_Q = (-0.826856, -0.924177, -0.0972383, -1.35199, 2.38135, -2.50397, 1.0)
# thickness of a depletion layer of self-avoiding chains: 1 + 3 A x + 3 B x^2 - 3 C x^3 is the cube of 1 + q (Aarts, Tuinier, Lekkerkerker 2002)
DEPLETION = (1.0, 3 * 2 / math.sqrt(math.pi) * (1 - 0.25 * (1 - 1.5 * math.log(2) - 0.5 * math.pi + math.pi / math.sqrt(3))),
             3 * (1 - 5 / 8 * math.pi + 17 / 36 + math.pi * math.sqrt(3) / 4),
             -(1673 * math.pi / 48 - 551 / 15 - 40 * math.pi / math.sqrt(3)) / math.sqrt(math.pi))

_NODES = tuple(zip(*(v.tolist() for v in np.polynomial.legendre.leggauss(32))))


def to_fraction(f):
    return f / (1 + f)


def from_fraction(phi):
    return phi / (1 - phi)


def polynomial(coefs, x):
    """Value of the polynomial with these coefficients, constant term first."""
    total = 0.0
    for c in reversed(coefs):
        total = total * x + c
    return total


def size_ratio(gyration: float, chains: str = "self-avoiding") -> float:
    """Effective size ratio of chains with this radius of gyration, in units of the particle radius."""
    if chains == "ideal":
        return 0.9 * gyration ** 0.9
    return polynomial(DEPLETION, gyration) ** (1 / 3) - 1


def free_volume(f, q, m=np, order: int = 0):
    """Derivative number ``order`` of exp(-W) in f, W being the work to insert a chain; the free volume is order 0 times (1 - phi).

    With y = exp(-W): y^(n+1) = - sum over k of binomial(n, k) W^(k+1) y^(n-k).
    """
    work = [0.0, q * (q * (q + 3) + 3), q * q * (3 * q + 4.5), q * q * q]
    slopes = []
    for k in range(1, order + 1):
        terms = [(math.perm(i, k), work[i], i - k) for i in range(k, 4)]
        slopes.append(polynomial([c * w for c, w, _ in terms], f) if terms else 0.0)
    y = [m.exp(-polynomial(work, f))]
    for n in range(order):
        y.append(-sum(math.comb(n, k) * slopes[k] * y[n - k] for k in range(n + 1)))
    return y[order]


def work_from_concentration(concentration, phi, gyration: float, overlap: float = 1.0, m=F) -> Column:
    """Insertion work of chains at a concentration given per sample volume: the free volume concentrates them."""
    share = free_volume(from_fraction(phi), size_ratio(gyration), m) * (1 - phi)
    return concentration / (share * overlap * gyration ** 3)


@dataclass(frozen=True)
class Fraction:
    """scale * v^power * top(v) / bottom(v), v being f or phi."""
    top: tuple
    bottom: tuple = (1.0,)
    power: int = 0
    scale: float = 1.0
    packed: bool = False        # v is phi

    def __call__(self, f):
        v = to_fraction(f) if self.packed else f
        value = polynomial(self.top, v) * self.scale / polynomial(self.bottom, v)
        n, base = self.power, v
        while n:                # repeated squaring
            if n % 2:
                value = value * base
            base, n = base * base, n // 2
        return value


@dataclass(frozen=True)
class Fluid:
    """Z - 1 as a sum of fractions."""
    excess_terms: tuple
    f_max: float = from_fraction(1 - 1e-6)
    offset: float = 0.0         # constant of the chemical potential

    def excess(self, f):
        return sum((t(f) for t in self.excess_terms[1:]), self.excess_terms[0](f))

    def compressibility(self, f):
        return self.excess(f) + 1

    def bare_pressure(self, f, m=np):
        """Pressure in units of kT per particle volume."""
        return to_fraction(f) * self.compressibility(f)

    def bare_potential(self, f, m=np):
        """log phi + Z - 1 + integral of (Z - 1) / phi from 0 to phi."""
        phi, area = to_fraction(f), 0.0
        for x, w in _NODES:
            at = phi * (0.5 + 0.5 * x)
            area = area + self.excess(from_fraction(at)) * (w / (1 + x))
        return m.log(f) - m.log1p(f) + self.excess(f) + area + self.offset

    def pressure(self, f, piv, q, m=np):
        return self.bare_pressure(f, m) + piv * (free_volume(f, q, m) - f * free_volume(f, q, m, 1))

    def potential(self, f, piv, q, m=np):
        return self.bare_potential(f, m) + piv * (free_volume(f, q, m) - (1 + f) * free_volume(f, q, m, 1))

    def slope(self, f, piv, q):
        """Derivative of the pressure in f, by central differences."""
        h = 1e-6 * f
        return (self.pressure(f + h, piv, q) - self.pressure(f - h, piv, q)) / (2 * h)


@dataclass(frozen=True)
class Crystal(Fluid):
    """Cell theory: pressure 3 / u with u = 1/f - 1/f_cp; the potential is its integral over pressure, and a constant."""
    excess_terms: tuple = ()
    f_max: float = F_CP

    def bare_pressure(self, f, m=np):
        return 3 / (1 / f - 1 / F_CP)

    def excess(self, f):
        return self.bare_pressure(f) * (1 + 1 / f) - 1

    def bare_potential(self, f, m=np):
        u = 1 / f - 1 / F_CP
        return 3 * (1 + 1 / F_CP) / u - 3 * m.log(u) + (HALL_MU + 3)


CARNAHAN_STARLING = Fluid((Fraction(CS_Z),))
KOLAFA = Fluid((Fraction(tuple(a - b for a, b in zip(KOLAFA_Z, (*KOLAFA_D, 0, 0, 0))), KOLAFA_D),), offset=1 / 3)
# pressure (1 + f) / f = Z: the numerator has no constant term, so f divides out
LE_FEVRE = Fluid((Fraction(tuple(float(x) for x in np.polynomial.polynomial.polysub(np.polynomial.polynomial.polymul(LEFEVRE_P[1:], (1.0, 1.0)), LEFEVRE_Q)), LEFEVRE_Q),),
                 from_fraction(0.636566))
LIU = Fluid((Fraction((1.0,), LIU_QZ, 1, LIU_QZ_SCALE, True), Fraction((LIU_CS[0],), (1.0, -LIU_A), 1, 1.0, True),
             Fraction((LIU_CS[1], 0.0, LIU_CS[2], 0.0, LIU_CS[3]), (1.0,), 40, 1.0, True)), from_fraction(0.635584))
HALL = Crystal()


def evaluate(df: DataFrame, fluid: Fluid, f: str = "f", piv: str = "piv", q: str = "q") -> DataFrame:
    """Add pv, mu and omega (semi-grand potential) of every row."""
    at = F.col(f), F.col(piv), F.col(q)
    df = df.withColumns({"pv": fluid.pressure(*at, F), "mu": fluid.potential(*at, F)})
    return df.withColumn("omega", to_fraction(F.col(f)) * F.col("mu") - F.col("pv"))


# --- phase boundaries: one small root search per row, rows in parallel ---------------------------------

def bisect(fn, low: float, high: float, steps: int = 80) -> float:
    sign = fn(low) > 0
    for _ in range(steps):
        middle = (low + high) / 2
        if (fn(middle) > 0) == sign:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def critical_point(eos: Fluid, q: float) -> tuple[float, float]:
    """(f, piv) where pressure has an inflection with zero slope: the smallest piv with a flat point."""
    grid = np.linspace(0.01, min(eos.f_max, 2.0) - 0.01, 4000)
    bend = -free_volume(grid, q, np, 2) * grid                     # d/df of the polymer term, per piv
    with np.errstate(all="ignore"):
        needed = np.where(bend < 0, -eos.slope(grid, 0.0, q) / bend, np.inf)
    i = int(np.argmin(needed))
    fine = np.linspace(grid[max(i - 1, 0)], grid[min(i + 1, len(grid) - 1)], 2001)
    needed = eos.slope(fine, 0.0, q) / (free_volume(fine, q, np, 2) * fine)
    i = int(np.argmin(needed))
    return float(fine[i]), float(needed[i])


def spinodal(eos: Fluid, piv: float, q: float) -> tuple[float, float]:
    """(f gas, f liquid) where the slope of the pressure vanishes; NaN below the critical point."""
    fc, pc = critical_point(eos, q)
    if piv < pc:
        return math.nan, math.nan
    flat = lambda f: eos.slope(f, piv, q)
    return bisect(flat, 1e-6, fc), bisect(flat, fc, eos.f_max * (1 - 1e-6))


def binodal(eos: Fluid, piv: float, q: float) -> tuple[float, float]:
    """(f gas, f liquid) of equal pressure and chemical potential."""
    gas, liquid = spinodal(eos, piv, q)
    if math.isnan(gas):
        return math.nan, math.nan
    p_low, p_high = max(eos.pressure(liquid, piv, q), eos.pressure(1e-12, piv, q)), eos.pressure(gas, piv, q)
    at_gas = lambda p: bisect(lambda f: eos.pressure(f, piv, q) - p, 1e-12, gas)
    at_liquid = lambda p: bisect(lambda f: eos.pressure(f, piv, q) - p, liquid, eos.f_max * (1 - 1e-9))
    p = bisect(lambda p: eos.potential(at_gas(p), piv, q) - eos.potential(at_liquid(p), piv, q), p_low * (1 + 1e-12), p_high, 60)
    return at_gas(p), at_liquid(p)


def solid_offset(fluid: Fluid, solid: Fluid) -> float:
    """Shift of the solid's chemical potential that puts hard-sphere coexistence at its known place."""
    return float(solid.bare_potential(F_SOLID) - fluid.bare_potential(F_FLUID))


def coexistence(fluid: Fluid, solid: Fluid, piv: float, q: float) -> tuple[float, float]:
    """(f fluid, f solid) of equal pressure and chemical potential; the stable fluid is the one of lower potential."""
    shift = solid_offset(fluid, solid)
    gas, liquid = spinodal(fluid, piv, q)
    pieces = [(1e-12, fluid.f_max * (1 - 1e-9))] if math.isnan(gas) else [(1e-12, gas), (liquid, fluid.f_max * (1 - 1e-9))]

    def branch(eos, p, low, high):
        f = bisect(lambda f: eos.pressure(f, piv, q) - p, low, high)
        return f if abs(eos.pressure(f, piv, q) - p) < 1e-6 * max(abs(p), 1e-6) else None

    def stable_fluid(p):
        found = [f for f in (branch(fluid, p, *piece) for piece in pieces) if f is not None]
        return min(found, key=lambda f: fluid.potential(f, piv, q)) if found else None

    grid = np.linspace(0.3 * F_SOLID, F_CP * (1 - 1e-7), 4000)
    slopes = np.diff(solid.pressure(grid, piv, q))
    start = float(grid[int(np.nonzero(slopes <= 0)[0][-1]) + 1]) if (slopes <= 0).any() else float(grid[0])

    def excess(log_u):
        f = 1 / (math.exp(log_u) + 1 / F_CP)
        p = solid.pressure(f, piv, q)
        other = stable_fluid(p)
        return -1.0 if other is None or p <= 0 else fluid.potential(other, piv, q) - solid.potential(f, piv, q) + shift
    # the first crossing from the dilute side: a fluid without close packing wins again at absurd pressure
    scan = np.linspace(math.log(1 / start - 1 / F_CP), math.log(1e-4), 120)
    crossed = next((i for i, v in enumerate(scan) if excess(v) > 0), 0)
    if not crossed:
        return math.nan, math.nan
    u = bisect(excess, scan[crossed - 1], scan[crossed], 60)
    f = 1 / (math.exp(u) + 1 / F_CP)
    return stable_fluid(solid.pressure(f, piv, q)), f


def triple_point(fluid: Fluid, solid: Fluid, q: float, highest: float = 20.0):
    """(piv, f gas, f liquid, f solid) where gas, liquid and solid coexist; None if the liquid is never stable."""
    _, low = critical_point(fluid, q)

    def gap(piv):
        return coexistence(fluid, solid, piv, q)[0] - binodal(fluid, piv, q)[1]
    low, high = low * 1.001, low * highest
    if not gap(low) > -1e-9:
        return None
    piv = bisect(lambda v: gap(v) + 1e-7, low, high, 40)
    gas, liquid = binodal(fluid, piv, q)
    return piv, gas, liquid, coexistence(fluid, solid, piv, q)[1]


def phase_boundaries(rows: DataFrame, fluid: Fluid, solid: Fluid) -> DataFrame:
    """For rows (q, piv): critical f and piv, binodal, spinodal and fluid-solid coexistence."""
    names = ["f_critical", "piv_critical", "f_gas", "f_liquid", "s_gas", "s_liquid", "f_fluid", "f_solid"]

    def solve(batches):
        for pdf in batches:
            out = [(r.q, r.piv, *critical_point(fluid, r.q), *binodal(fluid, r.piv, r.q), *spinodal(fluid, r.piv, r.q),
                    *coexistence(fluid, solid, r.piv, r.q)) for r in pdf.itertuples(index=False)]
            yield pd.DataFrame(out, columns=["q", "piv", *names])
    return rows.select("q", "piv").mapInPandas(solve, "q double, piv double, " + ", ".join(f"{n} double" for n in names))
