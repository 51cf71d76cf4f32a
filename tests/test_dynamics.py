import math

import numpy as np
import pandas as pd
import pytest

from corpuscle.operators import dynamics, fields, select


def tracks_of(spark, rows):
    return spark.createDataFrame(pd.DataFrame(rows, columns=["tr", "frame", "x", "y", "z"]))


def test_ballistic_motion(spark):
    v, q = 0.3, 1.1
    rows = [(tr, t, v * t + tr, 0.0, 0.0) for tr in range(4) for t in range(tr, 12)]
    table = dynamics.time_functions(tracks_of(spark, rows), range(1, 12), q=q).toPandas()
    assert np.allclose(table["msd"], (v * table["lag"]) ** 2)
    assert np.allclose(table["ngp"], 3 / 5 - 1)
    assert np.allclose(table["isf_x"], np.cos(q * v * table["lag"]))


@pytest.mark.parametrize("lags", [[1, 2, 3], list(range(1, 20)), [1, 5, 25, 100], [3, 4, 5, 7, 8, 9, 10, 11, 12, 13]])
def test_lag_pairs_of_one_long_trajectory(spark, lags):
    rng = np.random.default_rng(0)
    frames = sorted(rng.choice(200, 150, replace=False).tolist())
    rows = [(0, int(t), float(t), 0.0, 0.0) for t in frames] + [(1, t, 0.0, 0.0, 0.0) for t in range(5)]
    got = {(r.tr, r.frame, r.lag) for r in dynamics.lag_pairs(tracks_of(spark, rows), lags).collect()}
    have = {(r[0], r[1]) for r in rows}
    assert got == {(tr, t, k) for tr, t in have for k in lags if (tr, t + k) in have}


def test_drift_is_removed(spark):
    rng = np.random.default_rng(1)
    path = np.cumsum(rng.normal(size=(20, 3)), axis=0)
    rows = [(tr, t, *(path[t] + tr)) for tr in range(5) for t in range(20)]
    still = dynamics.remove_drift(tracks_of(spark, rows)).toPandas()
    assert still.groupby("tr")[["x", "y", "z"]].std().to_numpy().max() < 1e-9


def test_running_total_in_blocks(spark):
    df = spark.createDataFrame([(g, i, float(i % 7)) for g in range(2) for i in range(100)], "g int, i int, v double")
    got = dynamics.running_total(df, "i", ["v"], ["g"], block=9).toPandas().sort_values(["g", "i"])
    assert got["v"].tolist() == np.cumsum([i % 7 for i in range(100)]).tolist() * 2


def test_windows_do_not_depend_on_the_block(spark):
    rng = np.random.default_rng(2)
    rows = [(tr, t, float(v), 0.0, 0.0) for tr in range(2) for t, v in enumerate(rng.integers(0, 4, 60)) if rng.random() > 0.2]
    df = tracks_of(spark, rows)
    from pyspark.sql import functions as F
    wide = fields.over_frames(df, 3, 2, {"m": F.avg("x")}, block=1000).toPandas().sort_values(["tr", "frame"])
    narrow = fields.over_frames(df, 3, 2, {"m": F.avg("x")}, block=4).toPandas().sort_values(["tr", "frame"])
    assert np.allclose(wide["m"], narrow["m"]) and len(narrow) == len(rows)


def test_contiguous_pieces_across_blocks(spark):
    frames = [t for t in range(60) if t not in (7, 8, 30)]
    df = spark.createDataFrame([(0, t) for t in frames], "tr int, frame int")
    got = {r.frame: r.t_start for r in select.contiguous(df, ["tr"], block=4).collect()}
    assert got == {t: 0 if t < 7 else 9 if t < 30 else 31 for t in frames}


def brute_cages(pos, threshold, resolution):
    """Recursive split, straight from the definition."""
    starts = []

    def split(a, b):
        best, where = -1, None
        for t in range(a, b):
            left, right = pos[a:t + 1], pos[t + 1:b + 1]
            d1 = ((left - right.mean(0)) ** 2).sum(1).mean()
            d2 = ((right - left.mean(0)) ** 2).sum(1).mean()
            f = len(left) / (b - a + 1)
            s = math.sqrt(f * (1 - f) * d1 * d2)
            if s > best + 1e-12:
                best, where = s, t
        if where is None or best < threshold ** 2:
            starts.append(a)
            return
        for u, w in ((a, where), (where + 1, b)):
            if w - u > max(resolution, 1):
                split(u, w)
            else:
                starts.append(u)
    split(0, len(pos) - 1)
    return set(starts)


def test_cages(spark):
    rng = np.random.default_rng(4)
    jumps = np.repeat([[0, 0, 0], [3, 0, 0], [3, 4, 0]], [15, 20, 11], axis=0)
    paths = [jumps + rng.normal(scale=0.1, size=jumps.shape) for _ in range(2)]
    df = tracks_of(spark, [(tr, t, *p) for tr, path in enumerate(paths) for t, p in enumerate(path)])
    got = fields.cages(df, 1.0, 3).toPandas()
    assert len(got) == 2 * len(jumps)
    for tr, path in enumerate(paths):
        assert set(got[got.tr == tr]["cage"]) == brute_cages(path, 1.0, 3) == {0, 15, 35}
    freq = fields.jump_frequency(fields.cages(df, 1.0, 3), 4).where("tr = 0").toPandas().set_index("frame")["jump_frequency"]
    assert freq[14] == pytest.approx(1 / 5) and freq[5] == 0


def test_velocity_is_clipped_to_the_trajectory(spark):
    df = tracks_of(spark, [(0, t, 2.0 * t, 0.0, 0.0) for t in range(6)] + [(1, 3, 1.0, 0.0, 0.0)])
    v = {(r.tr, r.frame): r.vx for r in fields.velocity(df, 2).collect()}
    assert all(v[(0, t)] == pytest.approx(2.0) for t in range(6)) and v[(1, 3)] is None


def test_two_point_displacements_of_copies(spark):
    """2,000 copies of each of two tracks are four million pairs, but one pair of places."""
    tracks = spark.range(4000).selectExpr("id AS tr", "explode(array(0, 1)) AS frame").selectExpr("tr", "frame", "IF(tr % 2 = 0, 0D, 3D) + frame AS x", "0D AS y", "2D * frame AS z")
    (row,) = dynamics.two_point_displacements(tracks, 0, [1], 2.0, 20.0, 8).collect()
    assert (row.lag, row.n, row.sum_n, row.sum_p, row.sum_q) == (1, 4_000_000, 4e6, 0.0, 16e6)
