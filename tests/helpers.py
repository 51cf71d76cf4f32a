"""Brute-force counterparts used by the tests."""

import numpy as np
import pandas as pd


def random_points(spark, n=120, frames=2, seed=0, box=1.0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame([(f, i, *rng.random(3) * box, rng.normal()) for f in range(frames) for i in range(n)],
                       columns=["frame", "pid", "x", "y", "z", "v"])
    return spark.createDataFrame(pdf), pdf


def brute_pairs(pdf, radius, period=None):
    out = set()
    for frame, g in pdf.groupby("frame"):
        xyz, ids = g[["x", "y", "z"]].to_numpy(), g["pid"].to_numpy()
        d = xyz[None] - xyz[:, None]
        if period:
            d = d - period * np.floor(d / period + 0.5)
        d2 = (d ** 2).sum(-1)
        for i, j in zip(*np.nonzero(d2 < radius * radius)):
            if ids[i] < ids[j]:
                out.add((frame, ids[i], ids[j]))
    return out


def greedy(links):
    used_from, used_to, kept = set(), set(), set()
    for cost, a, b in sorted(links):
        if a not in used_from and b not in used_to:
            used_from.add(a)
            used_to.add(b)
            kept.add((a, b))
    return kept


# first shells of common lattices and their invariants, normalised w_l
SHELLS = {
    "sc": ([(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)], 0.763763, 0.159317, 0.353553, 0.013161),
    "bcc": ([(a, b, c) for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)], 0.509175, -0.159317, 0.628539, 0.013161),
    "fcc": ([(a, b, 0) for a in (-1, 1) for b in (-1, 1)] + [(a, 0, b) for a in (-1, 1) for b in (-1, 1)]
            + [(0, a, b) for a in (-1, 1) for b in (-1, 1)], 0.190941, -0.159317, 0.574524, -0.013161),
}
GOLD = (1 + 5 ** 0.5) / 2
ICOSAHEDRON = [(0, a, b * GOLD) for a in (-1, 1) for b in (-1, 1)] + [(a, b * GOLD, 0) for a in (-1, 1) for b in (-1, 1)] \
    + [(b * GOLD, 0, a) for a in (-1, 1) for b in (-1, 1)]
