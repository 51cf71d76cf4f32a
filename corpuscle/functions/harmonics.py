"""Spherical harmonics, Wigner 3j coefficients and rotations, for even degree.

Coefficients of m >= 0 are stored; those of m < 0 follow from conj(q_lm) = (-1)^m q_l-m.
Nothing is tabulated: 3j coefficients come from the Racah sum in exact integers, harmonics from the
polynomials of the Legendre functions.
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, functions as F


@lru_cache(None)
def wigner_3j(l: int, m1: int, m2: int, m3: int) -> float:
    """(l l l; m1 m2 m3)."""
    if m1 + m2 + m3 != 0 or max(abs(m1), abs(m2), abs(m3)) > l:
        return 0.0
    f = math.factorial
    total = Fraction(0)
    for k in range(max(0, -m1, m2), min(l, l - m1, l + m2) + 1):
        total += Fraction((-1) ** k, f(k) * f(l - k) * f(l - m1 - k) * f(l + m2 - k) * f(m1 + k) * f(k - m2))
    under_root = Fraction(f(l) ** 3, f(3 * l + 1))
    for m in (m1, m2, m3):
        under_root *= f(l + m) * f(l - m)
    return float((-1) ** abs(m3) * total) * math.sqrt(under_root)


@lru_cache(None)
def legendre_derivative(l: int, m: int) -> tuple[Fraction, ...]:
    """Coefficients, by power of c, of the m-th derivative of P_l(c)."""
    coefs = [Fraction(0)] * (l + 1)
    for k in range(l // 2 + 1):
        coefs[l - 2 * k] = Fraction((-1) ** k * math.comb(l, k) * math.comb(2 * l - 2 * k, l), 2 ** l)
    for _ in range(m):
        coefs = [i * c for i, c in enumerate(coefs)][1:] or [Fraction(0)]
    return tuple(coefs)


def ylm_norm(l: int, m: int) -> float:
    ratio = Fraction(math.factorial(l - m), math.factorial(l + m))
    return (-1) ** m * math.sqrt((2 * l + 1) / (4 * math.pi) * ratio)


def _polynomial(coefs, c):
    """Horner evaluation; works on Columns and on arrays."""
    value = None
    for coef in reversed(coefs):
        value = float(coef) + (0 * c if value is None else value * c)
    return value


def _polynomial_sql(coefs, c: str) -> str:
    text = None
    for coef in reversed(coefs):
        text = f"{float(coef)!r}D" if text is None else f"({text} * {c} + {float(coef)!r}D)" if coef else f"({text} * {c})"
    return text


def ylm_sql(l: int, x: str = "dx", y: str = "dy", z: str = "dz", r2: str = "d2"):
    """(layers, re, im): SQL text of Re and Im of Y_lm, m = 0..l, over layers of helper columns.

    The layers are for successive selects, so that powers are computed once.  The null vector counts as +z.
    """
    layers = [[f"IF({r2} > 0, {x} / sqrt({r2}), 0D) AS _u", f"IF({r2} > 0, {y} / sqrt({r2}), 0D) AS _v",
               f"IF({r2} > 0, {z} / sqrt({r2}), 1D) AS _c"]]
    power = {1: ("_u", "_v")}
    for m in range(2, l + 1):
        re, im = power[m - 1]
        layers.append([f"{re} * _u - {im} * _v AS _pr{m}", f"{re} * _v + {im} * _u AS _pi{m}"])
        power[m] = (f"_pr{m}", f"_pi{m}")
    re, im = [], []
    for m in range(l + 1):
        factor = f"{ylm_norm(l, m)!r}D * {_polynomial_sql(legendre_derivative(l, m), '_c')}"
        re.append(factor if m == 0 else f"{factor} * {power[m][0]}")
        im.append("0D" if m == 0 else f"{factor} * {power[m][1]}")
    return layers, re, im


def names(l: int, prefix: str = "") -> tuple[list[str], list[str]]:
    return [f"{prefix}re_{m}" for m in range(l + 1)], [f"{prefix}im_{m}" for m in range(l + 1)]


def coefficient_columns(l: int, prefix: str = "") -> list[str]:
    """All stored columns of degree l (im_0 is always 0 and not stored)."""
    re, im = names(l, prefix)
    return re + im[1:]


# Long sums are built as SQL text: one expression instead of hundreds of Column calls.

def _product_sql(l: int, a: str, b: str) -> str:
    pairs = [f"{a}re_{m} * {b}re_{m} + {a}im_{m} * {b}im_{m}" for m in range(1, l + 1)]
    return f"{4 * math.pi / (2 * l + 1)!r}D * ({a}re_0 * {b}re_0 + 2D * ({' + '.join(pairs)}))"


def product(l: int, a: str = "p_", b: str = "q_") -> Column:
    """4 pi/(2l+1) * sum over all m of Re(a_m conj(b_m))."""
    return F.expr(_product_sql(l, a, b))


def ql(l: int, prefix: str = "") -> Column:
    return F.expr(f"sqrt({_product_sql(l, prefix, prefix)})")


def normed_product(l: int, a: str = "p_", b: str = "q_") -> Column:
    """Cosine-like similarity of two coefficient sets, NULL if one is null."""
    norm = f"sqrt(({_product_sql(l, a, a)}) * ({_product_sql(l, b, b)}))"
    return F.expr(f"({_product_sql(l, a, b)}) / nullif({norm}, 0D)")


def _wl_sql(l: int, prefix: str) -> str:
    """Sum over m1 + m2 + m3 = 0 of 3j * q_m1 q_m2 q_m3, grouped by unordered triples."""
    def q(m):
        sign = "-" if m < 0 and m % 2 else ""
        re = f"({sign}{prefix}re_{abs(m)})"
        im = "0D" if m == 0 else f"({'' if m > 0 or m % 2 else '-'}{prefix}im_{abs(m)})"
        return re, im
    terms = []
    for m1 in range(-l, l + 1):
        for m2 in range(m1, l + 1):
            m3 = -m1 - m2
            triple, opposite = (m1, m2, m3), tuple(sorted((-m1, -m2, m1 + m2)))
            if m3 < m2 or m3 > l or triple > opposite:      # the opposite triple gives the conjugate
                continue
            ways = {1: 1, 2: 3, 3: 6}[len(set(triple))] * (1 if triple == opposite else 2)
            (ar, ai), (br, bi), (cr, ci) = q(m1), q(m2), q(m3)
            real = f"({ar} * {br} - {ai} * {bi}) * {cr} - ({ar} * {bi} + {ai} * {br}) * {ci}"
            terms.append(f"{ways * wigner_3j(l, m1, m2, m3)!r}D * ({real})")
    return " + ".join(terms)


def wl(l: int, prefix: str = "", normalised: bool = True) -> Column:
    """Third-order invariant; NULL for a null vector."""
    if not normalised:
        return F.expr(_wl_sql(l, prefix))
    norm2 = f"({(2 * l + 1) / (4 * math.pi)!r}D * {_product_sql(l, prefix, prefix)})"
    return F.expr(f"IF({norm2} > 1e-18D, ({_wl_sql(l, prefix)}) / ({norm2} * sqrt({norm2})), NULL)")


# --- numpy versions, used inside Arrow UDFs ----------------------------------------------------------

def ylm_array(vectors: np.ndarray, l: int) -> np.ndarray:
    """Y_lm, m = 0..l, of an (n, 3) array of vectors.  The null vector counts as +z."""
    length = np.sqrt((vectors * vectors).sum(1))
    null = length == 0
    unit = vectors / np.where(null, 1.0, length)[:, None]
    unit[null, 2] = 1.0
    phase, power, parts = unit[:, 0] + 1j * unit[:, 1], 1.0, []
    for m in range(l + 1):
        parts.append(ylm_norm(l, m) * _polynomial(legendre_derivative(l, m), unit[:, 2]) * power)
        power = power * phase
    return np.stack(parts, axis=1)


def _full(q: np.ndarray, l: int) -> np.ndarray:
    """Coefficients m = -l..l from those of m = 0..l."""
    m = np.arange(1, l + 1)
    return np.concatenate([((-1.0) ** m * q[:, 1:].conj())[:, ::-1], q], axis=1)


def small_d(l: int, beta: np.ndarray) -> np.ndarray:
    """Wigner d^l_{m'm}(beta), shape (n, 2l+1, 2l+1)."""
    f = math.factorial
    c, s = np.cos(beta / 2), np.sin(beta / 2)
    d = np.zeros((len(beta), 2 * l + 1, 2 * l + 1))
    for a in range(-l, l + 1):
        for b in range(-l, l + 1):
            root = math.sqrt(f(l + a) * f(l - a) * f(l + b) * f(l - b))
            for k in range(max(0, b - a), min(l + b, l - a) + 1):
                weight = (-1) ** (k + a - b) * root / (f(l + b - k) * f(k) * f(a - b + k) * f(l - a - k))
                d[:, a + l, b + l] += weight * c ** (2 * l + b - a - 2 * k) * s ** (2 * k + a - b)
    return d


def rotate_by_pi(q: np.ndarray, axis: np.ndarray, l: int) -> np.ndarray:
    """Coefficients (n, l+1) of the pattern turned by pi about ``axis`` (n, 3).

    Turn the axis onto z, multiply m by (-1)^m, turn back.
    """
    unit = axis / np.linalg.norm(axis, axis=1, keepdims=True)
    theta, phi = np.arccos(np.clip(unit[:, 2], -1, 1)), np.arctan2(unit[:, 1], unit[:, 0])
    m = np.arange(-l, l + 1)
    d = small_d(l, theta)
    turned = _full(q, l) * np.exp(-1j * m * phi[:, None])
    turned = np.einsum("nba,nb->na", d, turned) * (-1.0) ** m
    turned = np.einsum("nab,nb->na", d, turned) * np.exp(1j * m * phi[:, None])
    return turned[:, l:]


def reflect(q: np.ndarray, normal: np.ndarray, l: int) -> np.ndarray:
    """Mirror image through the plane with that normal; for even l the same as turning by pi about it."""
    return (-1) ** l * rotate_by_pi(q, normal, l)


def even_functions(unit: np.ndarray, l: int) -> np.ndarray:
    """Functions of directions (n, 3) that span the even polynomials up to degree 2l, one in a row: powers of x + iy times Legendre polynomials of z."""
    x, y, z = unit.T
    height, out, row = [np.ones_like(z), z], np.empty(((2 * l + 1) * (l + 1), len(z))), 0
    for j in range(2, 2 * l + 1):
        height.append(((2 * j - 1) * z * height[-1] - (j - 1) * height[-2]) / j)
    re, im = np.ones_like(x), np.zeros_like(x)
    for m in range(2 * l + 1):
        for j in range(m % 2, 2 * l + 1 - m, 2):
            np.multiply(height[j], re, out=out[row])
            row += 1
            if m:
                np.multiply(height[j], im, out=out[row])
                row += 1
        re, im = re * x - im * y, re * y + im * x
    return out


@lru_cache(None)
def turn_by_pi(l: int) -> np.ndarray:
    """(functions, columns, columns): coefficients re_0.., im_1.. turned by pi about n are sum_fi even_functions(n)[f] * old[i] * turn[f, i, :].

    A turn is a polynomial of degree 2l in its axis, so that it follows exactly from the turns about enough axes.
    """
    size = 2 * l + 1
    axes = np.random.default_rng(0).normal(size=(6 * size * (l + 1), 3))
    values = even_functions(axes / np.linalg.norm(axes, axis=1, keepdims=True), l).T
    turned = []
    for i in range(size):
        q = np.zeros((len(axes), l + 1), complex)
        q[:, i if i <= l else i - l] = 1 if i <= l else 1j
        out = rotate_by_pi(q, axes, l)
        turned.append(np.concatenate([out.real, out.imag[:, 1:]], axis=1))
    return np.linalg.lstsq(values, np.stack(turned, axis=1).reshape(len(axes), -1), rcond=None)[0].reshape(values.shape[1], size, size)
