"""Bit-sliced scatter against integer products, whitening against numpy."""

import numpy as np
import pytest

from corpuscle.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("reach", [1, 900, 10**7, 2**50])
def test_scatter_is_exact(reach):
    x = np.random.default_rng(1).integers(-reach, reach, (131, 5))
    sums, products = whitening.scatter(x)
    whole = x.astype(object)
    assert (sums == whole.sum(axis=0)).all() and (products == np.triu(whole.T @ whole)).all()


def reference(vectors):
    x = np.floor(1024 * np.asarray(vectors, float)) + 100000
    n, centred = len(x), x - x.mean(axis=0)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    whole = x.astype(int).astype(object)
    return centred @ axes / np.sqrt(values), values / values.sum(), ((n * whole - whole.sum(axis=0)) ** 2).sum(axis=1)


@pytest.mark.parametrize("parts", [1, 6])
def test_against_numpy(spark, parts):
    r = np.random.default_rng(5)
    vectors = (r.normal(0, 0.2, (5000, 12)) @ r.normal(0, 1, (12, 12))).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    bad = [(10**6, None, 1), (10**6 + 1, [0.0] * 11 + [None], 1), (10**6 + 2, [float("nan")] + [0.0] * 11, 1), (10**6 + 3, [float("-inf")] + [0.0] * 11, 1)]
    got = whitening.components_of(spark.createDataFrame(rows + bad, SCHEMA).repartition(parts)).toPandas().sort_values(["vec_id", "component"])
    white, share, deviation = reference(vectors)
    assert len(got) == 8 * 5000 and (got.n == 5000).all() and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    values = got.whitened.to_numpy().reshape(-1, 8)
    signs = np.sign((values * white[:, :8]).sum(axis=0))
    assert np.abs(values * signs - white[:, :8]).max() < 1e-8
    assert np.allclose(got.explained.to_numpy().reshape(-1, 8)[0], share[:8], rtol=1e-9)
    assert got.deviation.to_numpy().reshape(-1, 8)[:, 0].tolist() == deviation.tolist()


def test_awkward(spark):
    rows = [(None, [0.5, 1.0], 1), (1, [0.25], 1), (1, [0.25], 1), (2, [], 0), (3, [1e30, -1e30], 0)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA + ", row string, v string")
    rows, fitted = whitening.whiten(frame)
    assert fitted.moments.n == 5 and set(rows.select("row.*").columns) == set(frame.columns)
    assert rows.count() == 5
    out = whitening.components_of(frame).toPandas()
    assert len(out) == 10 and np.isfinite(out.whitened).all()


def test_single_row_and_empty(spark):
    one = whitening.components_of(spark.createDataFrame([(7, [0.5, 1.0, 2.0], 1)], SCHEMA)).toPandas()
    assert len(one) == 3 and (one.whitened == 0).all() and (one.explained == 0).all() and (one.deviation == 0).all()
    assert whitening.components_of(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.components_of(spark.createDataFrame([(1, None, 1)], SCHEMA)).count() == 0
