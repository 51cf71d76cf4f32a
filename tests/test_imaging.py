import numpy as np
import pandas as pd
import pytest

from corpuscle.imaging import spectra, tracking
from corpuscle.sources.images import as_array


def ball(shape, centre, radius):
    grid = np.ogrid[tuple(slice(n) for n in shape)]
    distance = np.sqrt(sum((g - c) ** 2 for g, c in zip(grid, centre)))
    return 100 * (1 - np.tanh(distance - radius)) / 2


@pytest.mark.parametrize("shift", [0.0, 0.3, 0.5])
def test_sphere_by_band_pass(shift):
    found = tracking.find_peaks(ball((64, 64, 64), (32 + shift, 32, 32 - shift), 4), radius_min=3, radius_max=10)
    assert np.allclose(found[0, :3], (32 + shift, 32, 32 - shift), atol=0.1)


def test_disc_by_blur():
    found = tracking.find_peaks(ball((64, 64), (30.25, 33.5), 4), radius_min=3, radius_max=10, method="blur")
    assert np.allclose(found[0, :2], (30.25, 33.5), atol=0.15)


@pytest.mark.parametrize("ndim,radius", [(1, 4.0), (2, 3.0), (2, 4.0), (2, 8.0), (3, 4.0)])
def test_blob_position_and_size(ndim, radius):
    size = {1: 96, 2: 96, 3: 40}[ndim]
    centre = [size / 2 + 0.25] * ndim
    found = tracking.find_blobs(ball((size,) * ndim, centre, radius))
    assert np.allclose(found[0, :ndim], centre, atol=0.3)
    assert found[0, ndim] == pytest.approx(radius, rel=0.25) and found[0, -1] < 0


def test_tracked_discs_in_spark(spark):
    truth = [(0, 0, 20.0, 30.0, 0.0, 4.0), (0, 1, 60.0, 40.0, 0.0, 5.0), (1, 0, 48.0, 48.0, 0.0, 4.0)]
    df = spark.createDataFrame(pd.DataFrame(truth, columns=["frame", "pid", "x", "y", "z", "r"]))
    images = tracking.paint_spheres(df, (96, 96))
    blobs = tracking.track_blobs(images).toPandas()
    strong = blobs[blobs.intensity < 0.3 * blobs.intensity.min()]
    for frame, _, x, y, _, _ in truth:
        near = strong[(strong.frame == frame) & ((strong.x - x) ** 2 + (strong.y - y) ** 2 < 1)]
        assert len(near) == 1
    assert len(strong) == len(truth)
    sized = tracking.radii(images, df, 1.0, 12.0).toPandas()
    assert len(sized) == 3 and (sized["r"] - 4.5).abs().max() < 2.5


def test_shift_by_phase_correlation(spark):
    rng = np.random.default_rng(0)
    a = rng.random((32, 48)).astype(np.float32)
    rows = [(t, [32, 48], np.roll(a, (3 * t, -5 * t), (0, 1)).tobytes()) for t in range(3)]
    images = spark.createDataFrame(rows, "frame int, shape array<int>, data binary")
    got = {r.frame: (r.dy, r.dx) for r in spectra.displacements(images, window=False).collect()}
    assert got == {0: (3.0, -5.0), 1: (3.0, -5.0)}
    path = {r.frame: (r.dy, r.dx) for r in spectra.cumulative_displacement(spectra.displacements(images, window=False)).collect()}
    assert path == {1: (3.0, -5.0), 2: (6.0, -10.0)}


def test_ddm_matches_direct_transform(spark):
    rng = np.random.default_rng(1)
    stack = rng.integers(0, 255, (5, 16, 16), dtype=np.uint8)
    images = spark.createDataFrame([(t, [16, 16], p.tobytes()) for t, p in enumerate(stack)], "frame int, shape array<int>, data binary")
    got = spectra.ddm(images, [2]).where("q_bin = 3").first()
    want = np.mean([spectra.radial_mean(np.abs(np.fft.fft2(stack[t + 2].astype(float) - stack[t])) ** 2)["power"][3] for t in range(3)])
    assert got["n"] == 3 and got["power"] == pytest.approx(want)


def test_piles_split_at_a_sideways_jump(spark):
    rows = [(0, z, 10.0 + 0.05 * z + (4.0 if z >= 8 else 0.0), 5.0, 3.0 - abs(z % 8 - 3.5) * 0.4, -5.0) for z in range(16)]
    piles = spark.createDataFrame(rows, "pile bigint, frame int, x double, y double, r double, intensity double")
    parts = tracking.split_piles(piles).toPandas()
    # two equal steps around the jump cut on both of its sides
    assert parts.set_index("frame")["part"].to_dict() == {z: 0 if z < 7 else z if z == 7 else 8 for z in range(16)}


def test_layout_keeps_every_pixel(spark):
    pixels = spark.createDataFrame([(0, 3, 7.0), (0, 11, 9.0)], "frame int, pixel int, v double")
    row = tracking.layout(pixels, (3, 4)).first()
    image = as_array(row["shape"], row["data"])
    assert image[0, 3] == 7 and image[2, 3] == 9 and image.sum() == 16


def test_painted_rods(spark):
    df = spark.createDataFrame([(0, 0, 4.0, 4.0, 4.0, 2.0)], "frame int, pid bigint, x double, y double, z double, r double")
    row = tracking.paint_spheres(df, (9, 9, 9), rods=True).first()
    image = as_array(row["shape"], row["data"]) > 0
    assert image.any(axis=(1, 2)).sum() == 5 and (image[2] == image[4]).all()


def test_discs_outside_the_image_light_nothing_in_it(spark):
    truth = [(0, 0, 103.0, 20.0, 0.0, 4.0), (0, 1, -7.0, 30.0, 0.0, 3.0), (0, 2, 40.0, 104.0, 0.0, 3.0), (0, 3, 94.0, 50.0, 0.0, 4.0)]
    df = spark.createDataFrame(pd.DataFrame(truth, columns=["frame", "pid", "x", "y", "z", "r"]))
    row = tracking.paint_spheres(df, (96, 96)).first()
    y, x = np.nonzero(as_array(row["shape"], row["data"]))
    grid = np.ogrid[:96, :96]
    assert set(zip(y, x)) == set(zip(*np.nonzero((grid[0] - 50.0) ** 2 + (grid[1] - 94.0) ** 2 <= 16)))
