"""Bit filters of fixed size: a broadcast that tells which hashes may be in a table of any size.

A filter never misses a member; what it lets through is decided exactly afterwards.  Its size is set beforehand, so the broadcast stays
bounded however large the table is; a table far larger than the filter only makes it let more through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

BITS = 26               # 2**26 bits: 8 MB


def bit_filter(table: DataFrame, hashed: Column, bits: int = BITS) -> np.ndarray:
    """Bytes of a filter with a bit set for the top ``bits`` bits of every hash."""
    place = F.shiftrightunsigned(hashed, 64 - bits) + 1        # bitmap buckets count from 1
    rows = (table.filter(hashed.isNotNull()).select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect())
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:
        at = (r["bucket"] - 1) * 4096
        out[at:at + 4096] = np.frombuffer(r["bits"], np.uint8)[:len(out) - at]
    return out


def maybe(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the unsigned hashes may be members."""
    place = hashes >> np.uint64(64 - (len(bits).bit_length() + 2))
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
