"""Vector and box arithmetic as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

AXES = ("x", "y", "z")


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(float(v))


def dot(a: Sequence, b: Sequence) -> Column:
    total = _c(a[0]) * _c(b[0])
    for u, v in zip(a[1:], b[1:]):
        total = total + _c(u) * _c(v)
    return total


def norm2(a: Sequence) -> Column:
    return dot(a, a)


def normalize(a: Sequence) -> list[Column]:
    """Unit vector; NULL components for the null vector."""
    length = F.sqrt(norm2(a))
    return [_c(u) / F.when(length > 0, length) for u in a]


def difference(a: Sequence, b: Sequence) -> list[Column]:
    return [_c(v) - _c(u) for u, v in zip(a, b)]


def angle(a: Sequence, b: Sequence) -> Column:
    """Angle between two vectors in [0, pi], NULL with a null vector; rounding noise outside [-1, 1] is clipped."""
    cosine = dot(a, b) / F.nullif(F.sqrt(norm2(a) * norm2(b)), F.lit(0.0))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def minimg(d, period) -> Column:
    """Minimum image of a difference, in [-L/2, L/2)."""
    return _c(d) - _c(period) * F.floor(_c(d) / _c(period) + 0.5)


def wrap(v, period) -> Column:
    """Coordinate folded into [0, L)."""
    return _c(v) - _c(period) * F.floor(_c(v) / _c(period))


def spherical(x, y, z) -> tuple[Column, Column, Column]:
    """(r, colatitude in [0, pi], azimuth in [0, 2 pi)); both angles are 0 for the null vector."""
    r = F.sqrt(norm2((x, y, z)))
    colat = F.when(r > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _c(z) / r)))).otherwise(0.0)
    az = F.atan2(_c(y), _c(x))
    return r, colat, F.when(az < 0, az + 2 * math.pi).otherwise(az)


# --- boxes: (lows, highs), each a sequence of three columns or numbers -------------------------------

def box_of_point(coords: Sequence, r) -> tuple[list[Column], list[Column]]:
    return [_c(c) - _c(r) for c in coords], [_c(c) + _c(r) for c in coords]


def box_encloses(box, coords: Sequence) -> Column:
    """Inclusive on both faces."""
    cond = F.lit(True)
    for c, lo, hi in zip(coords, *box):
        cond = cond & _c(c).between(_c(lo), _c(hi))
    return cond


def box_overlaps(a, b) -> Column:
    """Strict: boxes that only share a face do not overlap."""
    cond = F.lit(True)
    for alo, ahi, blo, bhi in zip(*a, *b):
        cond = cond & (_c(alo) < _c(bhi)) & (_c(blo) < _c(ahi))
    return cond


def box_overlap_volume(a, b) -> Column:
    volume = F.lit(1.0)
    for alo, ahi, blo, bhi in zip(*a, *b):
        side = F.least(_c(ahi), _c(bhi)) - F.greatest(_c(alo), _c(blo))
        volume = volume * F.greatest(side, F.lit(0.0))
    return volume


def box_stretch(a, b) -> tuple[list[Column], list[Column]]:
    """Smallest box holding both."""
    return ([F.least(_c(u), _c(v)) for u, v in zip(a[0], b[0])],
            [F.greatest(_c(u), _c(v)) for u, v in zip(a[1], b[1])])


def box_volume(a) -> Column:
    volume = F.lit(1.0)
    for lo, hi in zip(*a):
        volume = volume * (_c(hi) - _c(lo))
    return volume


def box_centre_distance2(a, b) -> Column:
    return norm2([(_c(alo) + _c(ahi)) / 2 - (_c(blo) + _c(bhi)) / 2 for alo, ahi, blo, bhi in zip(*a, *b)])
