import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.operators import pairs, spatial

from .helpers import brute_pairs, random_points


def as_set(df):
    return {tuple(r) for r in df.select("frame", "p", "q").collect()}


@pytest.mark.parametrize("options", [{}, {"block_factor": 1.0}, {"crowd_limit": 5}, {"crowd_limit": None}])
def test_range_pairs(spark, options):
    df, pdf = random_points(spark)
    assert as_set(spatial.range_pairs(df, 0.2, **options)) == brute_pairs(pdf, 0.2)


@pytest.mark.parametrize("period,radius", [(1.0, 0.2), (1.0, 0.45), (0.5, 0.3)])
def test_range_pairs_periodic(spark, period, radius):
    df, pdf = random_points(spark, 60)
    assert as_set(spatial.range_pairs(df, radius, periods=[period] * 3)) == brute_pairs(pdf, radius, period)


def test_range_pairs_between_tables_with_crowds(spark):
    a, pa = random_points(spark, 60, seed=1)
    b, pb = random_points(spark, 80, seed=2)
    want = {(f, i, j) for f in (0, 1) for i, u in pa[pa.frame == f].set_index("pid")[["x", "y", "z"]].iterrows()
            for j, v in pb[pb.frame == f].set_index("pid")[["x", "y", "z"]].iterrows() if ((u - v) ** 2).sum() < 0.04}
    for limit in (None, 7):
        assert as_set(spatial.range_pairs(a, 0.2, b, crowd_limit=limit)) == want


def test_difference_points_from_p_to_q(spark):
    df, pdf = random_points(spark, 50, 1)
    at = pdf.set_index("pid")[["x", "y", "z"]]
    for r in spatial.range_pairs(df, 0.3).collect():
        assert np.allclose([r.dx, r.dy, r.dz], at.loc[r.q] - at.loc[r.p])


@pytest.mark.parametrize("limit", [20_000, 10])
def test_knn_same_result_when_crowded(spark, limit):
    df, pdf = random_points(spark, 100, 1, seed=3, box=0.4)
    got = {(r.p, r.rank, r.q) for r in spatial.knn(df, 4, 0.5, crowd_limit=limit).collect()}
    want = set()
    xyz = pdf[["x", "y", "z"]].to_numpy()
    for i in range(len(xyz)):
        d2 = ((xyz - xyz[i]) ** 2).sum(1)
        order = [j for j in np.lexsort((np.arange(len(xyz)), d2)) if j != i and d2[j] < 0.25][:4]
        want |= {(i, k + 1, j) for k, j in enumerate(order)}
    assert got == want


def test_knn_with_a_third_of_the_points_in_one_place(spark):
    df, pdf = random_points(spark, 90, 1, seed=4)
    copies = df.withColumns({c: F.when(F.col("pid") < 40, F.lit(0.5)).otherwise(F.col(c)) for c in "xyz"})
    plain = spatial.knn(copies, 3, 0.4)
    crowded = spatial.knn(copies, 3, 0.4, crowd_limit=8)
    assert {tuple(r) for r in plain.select("p", "rank", "q").collect()} == {tuple(r) for r in crowded.select("p", "rank", "q").collect()}


def test_pair_histogram_merges_copies_without_changing_the_counts(spark):
    df, _ = random_points(spark, 90, 1, seed=5)
    copies = df.withColumns({c: F.when(F.col("pid") < 40, F.lit(0.5)).otherwise(F.col(c)) for c in "xyz"})
    plain = {r.bin: (r.n, round(r.sum_v, 6)) for r in pairs.pair_histogram(copies, 0.4, 10, fields=["v"]).collect()}
    merged = {r.bin: (r.n, round(r.sum_v, 6)) for r in pairs.pair_histogram(copies, 0.4, 10, fields=["v"], crowd_limit=8).collect()}
    assert plain == merged
    assert plain[0][0] >= 40 * 39 // 2


def test_two_dimensions(spark):
    df, pdf = random_points(spark, 80, 1)
    flat = pdf.assign(z=0.0)
    assert as_set(spatial.range_pairs(df, 0.15, coords=["x", "y"])) == brute_pairs(flat, 0.15)


def test_ideal_gas_rdf_is_flat(spark):
    df, _ = random_points(spark, 3000, 1, seed=6)
    g = pairs.rdf(df, 0.1, 5, periods=[1.0] * 3).where("bin >= 1").toPandas().sort_values("bin")
    # bin r stands for its lower edge, so the expected value is the shell volume over that of the edge
    want = [((b + 1) ** 3 - b ** 3) / (3 * b * b) for b in g["bin"]]
    assert np.allclose(g["g"], want, rtol=0.1)


def test_plan_has_no_cartesian_product_and_prunes_columns(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    pos = df.select(F.col("label").alias("frame"), F.col("vec_id").alias("pid"),
                    *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = pairs.pair_histogram(pos, 0.3, 30)._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan


def third_in_one_place(df):
    return df.withColumns({c: F.when(F.col("pid") < 40, F.lit(0.5)).otherwise(F.col(c)) for c in "xyz"})


def test_particle_histogram_merges_copies_without_changing_the_counts(spark):
    df = third_in_one_place(random_points(spark, 90, 1, seed=14)[0]).withColumn("kind", F.col("pid") % 2)
    for species in (None, "kind"):
        plain = {tuple(r) for r in pairs.particle_histogram(df, 0.3, 6, species=species).collect()}
        merged = {tuple(r) for r in pairs.particle_histogram(df, 0.3, 6, species=species, crowd_limit=8).collect()}
        assert plain == merged


def test_rdf_of_crowded_points(spark):
    df = third_in_one_place(random_points(spark, 90, 1, seed=15)[0])
    plain = {(r.bin, r.n, round(r.g, 9)) for r in pairs.rdf(df, 0.3, 6, margin=0.1).collect()}
    merged = {(r.bin, r.n, round(r.g, 9)) for r in pairs.rdf(df, 0.3, 6, margin=0.1, crowd_limit=8).collect()}
    assert plain == merged


def test_coincident_neighbours_do_not_break_bond_order(spark):
    from corpuscle.operators import order
    df = third_in_one_place(random_points(spark, 60, 1, seed=16)[0])
    q = order.invariants(order.qlm(spatial.neighbour_edges(df, 0.2), 6), 6)
    assert q.where("isnan(q6) or q6 is null").count() == 0


def test_bond_order_of_crowded_points(spark):
    from corpuscle.operators import order
    df = third_in_one_place(random_points(spark, 90, 1, seed=17)[0])
    def rows(limit):
        return {(r.p, r.n, round(r.q6, 8)) for r in order.invariants(order.qlm_of_points(df, 0.2, 6, crowd_limit=limit), 6).collect()}
    assert rows(20_000) == rows(8)


def test_nearest_neighbours_in_a_dense_middle_look_at_few_pairs(spark, monkeypatch):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(21)
    pdf = pd.DataFrame(rng.normal(size=(1500, 3)) * 0.12, columns=list("xyz")).assign(frame=0, pid=range(1500))
    df, looked = spark.createDataFrame(pdf), []
    ranked = spatial.neighbours_ranked
    monkeypatch.setattr(spatial, "neighbours_ranked", lambda edges, *rest: looked.append(edges.count()) or ranked(edges, *rest))
    got = {(r.p, r["rank"]): r.q for r in spatial.knn(df, 1, 0.5).collect()}
    xyz = pdf[["x", "y", "z"]].to_numpy()
    d2 = ((xyz[None] - xyz[:, None]) ** 2).sum(-1)
    np.fill_diagonal(d2, 9)
    want = {(p, k + 1): q for p in range(1500) for k, q in enumerate(np.argsort(d2[p])[:1]) if d2[p, q] < 0.25}
    assert got == want
    assert sum(looked) < 1500 * 1400 / 4, looked          # all pairs in range are about 1,500 * 1,400
