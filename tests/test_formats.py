import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.sources import images, lif, sinks, text


def test_lines_are_numbered_across_splits(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"a_t{k:02d}.vol").write_text("".join(f"{k}.{i:05d}\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        rows = text.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 6000
    assert all(int(r.value.split(".")[1]) == r.line for r in rows)


def test_series_names():
    assert text.series_path("dir/run_t000.dat", "_t", 12, 7) == "dir/run_t007.dat"
    assert text.change_extension("run_t007.dat", ".bonds") == "run_t007.bonds"
    assert text.add_postfix("run_t007.dat", "_space", ".cloud") == "run_t007_space.cloud"


def test_traj_round_trip(spark, tmp_path):
    traj = spark.createDataFrame([(0, 0, 4), (0, 1, 2), (1, 1, 0), (1, 2, 9), (1, 3, 1)], "tr bigint, frame int, pid bigint")
    path = str(tmp_path / "run.traj")
    sinks.write_traj(traj, path, 4.5, 0.25, "run_t000.dat", "_t", 0, 4)
    assert open(path).read() == "4.5\t0.25\nrun_t000.dat\n_t\n0\t4\n0\n4\t2\n1\n0\t9\t1\n"
    assert {tuple(r) for r in text.read_traj(spark, path).collect()} == {tuple(r) for r in traj.collect()}
    meta = text.read_traj_meta(spark, path).first()
    assert (meta["radius"], meta["dt"], meta["pattern"], meta["token"], meta["offset"], meta["size"]) == (4.5, 0.25, "run_t000.dat", "_t", 0, 4)


def test_dat_file(spark, tmp_path):
    (tmp_path / "run_t03.dat").write_text("1 2 1\n10 20 30\n1 2 3\n4 5 6\n")
    rows = {tuple(r) for r in text.read_dat(spark, str(tmp_path / "*.dat")).collect()}
    assert rows == {(3, 0, 1.0, 2.0, 3.0), (3, 1, 4.0, 5.0, 6.0)}
    assert tuple(text.read_dat_boxes(spark, str(tmp_path / "*.dat")).first()) == (3, 2, 10.0, 20.0, 30.0)


def test_voronoi_listing(spark, tmp_path):
    (tmp_path / "c_t0.vol").write_text("0 1.5 3 1 2 -1\n1 1.0 2 0 2\n2 1.0 2 0 1\n3 1.0 1 wall\nid volume n neighbours\n4 1.0 0\n")
    bonds, outside = text.read_voronoi_neighbours(spark, str(tmp_path / "*.vol"))
    assert {(r.low, r.high) for r in bonds.collect()} == {(0, 1), (0, 2), (1, 2)}
    assert [r.p for r in outside.collect()] == [0]


def test_polydata_with_bonds(spark, tmp_path):
    points = spark.createDataFrame([(0, i, float(i), 0.5, 1.0, i * 2.0) for i in range(3)], "frame int, pid bigint, x double, y double, z double, v double")
    bonds = spark.createDataFrame([(0, 0, 1), (0, 1, 2)], "frame int, low bigint, high bigint")
    sinks.write_polydata(points, str(tmp_path / "p_t%d.vtk"), bonds=bonds, scalars=["v"])
    lines = (tmp_path / "p_t0.vtk").read_text().splitlines()
    assert lines[:5] == ["# vtk DataFile Version 3.0", "particles", "ASCII", "DATASET POLYDATA", "POINTS 3 double"]
    assert lines[8] == "LINES 2 6" and lines[9] == "2 0 1" and "SCALARS v double" in lines
    rows = text.read_polydata(spark, str(tmp_path / "*.vtk")).collect()
    assert {(r.section, r.row): list(r.numbers) for r in rows if r.section in ("LINES", "SCALARS")} == {
        ("LINES", 0): [2, 0, 1], ("LINES", 1): [2, 1, 2], ("SCALARS", 0): [0], ("SCALARS", 1): [2], ("SCALARS", 2): [4]}


def test_simulation_xml(spark, tmp_path):
    (tmp_path / "c.xml").write_text('<S><Pt ID="0"><P x="1" y="2" z="3"/></Pt><Pt ID="1"><P x="4" y="5" z="6"/></Pt>'
                                    '<CaptureMap><Pair ID1="1" ID2="0"/></CaptureMap></S>')
    points, pairs = text.read_simulation_xml(spark, str(tmp_path / "c.xml"))
    assert {tuple(r) for r in points.collect()} == {(0, 1.0, 2.0, 3.0), (1, 4.0, 5.0, 6.0)}
    assert tuple(pairs.first()) == (0, 1)


def lif_bytes(stacks):
    """A container with one X Y Z T series of 8-bit pixels per entry."""
    elements = ""
    for name, a in stacks.items():
        t, z, y, x = a.shape
        dims = "".join(f'<DimensionDescription DimID="{i}" NumberOfElements="{n}" BytesInc="{b}" Length="{(n - 1) * 1e-7}"/>'
                       for i, n, b in ((1, x, 1), (2, y, x), (3, z, x * y), (4, t, x * y * z)))
        elements += (f'<Element Name="{name}"><Data><Image><ImageDescription><Channels><ChannelDescription/></Channels><Dimensions>{dims}'
                     f'</Dimensions></ImageDescription></Image></Data><Memory Size="{a.size}"/></Element>')
    xml = f'<LMSDataContainerHeader Version="2"><Element Name="run">{elements}</Element></LMSDataContainerHeader>'
    out = struct.pack("<iic", 112, 0, b"*") + struct.pack("<I", len(xml)) + xml.encode("utf-16-le")
    for name, a in stacks.items():
        label = f"Mem_{name}"
        out += struct.pack("<iic", 112, 0, b"*") + struct.pack("<Q", a.size) + b"*" + struct.pack("<I", len(label)) + label.encode("utf-16-le") + a.tobytes()
    return out


def test_lif_source(spark, tmp_path):
    rng = np.random.default_rng(0)
    stacks = {"one": rng.integers(0, 255, (5, 3, 4, 6), dtype=np.uint8), "two": rng.integers(0, 255, (2, 2, 5, 7), dtype=np.uint8)}
    (tmp_path / "a.lif").write_bytes(lif_bytes(stacks))
    lif.register(spark)
    df = spark.read.format("lif").option("stepsPerPartition", 2).load(str(tmp_path / "a.lif"))
    assert df.rdd.getNumPartitions() == 4
    rows = df.collect()
    assert len(rows) == 7
    for r in rows:
        want = stacks[r["name"]][r["t"]]
        assert list(r["shape"]) == list(want.shape)
        assert (images.as_array(r["shape"], r["data"]) == want).all()
    table = {r["name"]: (r["axes"], r["sizes"]) for r in lif.series_table(spark, str(tmp_path / "a.lif")).collect()}
    assert table["two"] == ("XYZT", [7, 5, 2, 2])


@pytest.mark.parametrize("dtype,big", [(np.uint8, True), (np.uint16, True), (np.uint16, False)])
def test_tiff(dtype, big):
    plane = np.arange(35, dtype=dtype).reshape(5, 7) * 7
    assert (images.decode_tiff(images.encode_tiff(plane, big)) == plane).all()


def test_tiff_series(spark, tmp_path):
    for t in range(2):
        for z in range(3):
            (tmp_path / f"s_t{t:02d}_z{z:02d}.tif").write_bytes(images.encode_tiff(np.full((4, 5), 10 * t + z, np.uint8)))
    stack = images.stack_planes(images.read_tiffs(spark, str(tmp_path / "*.tif"))).collect()
    assert {r["frame"]: (list(r["shape"]), list(r["data"][::20])) for r in stack} == {0: ([3, 4, 5], [0, 1, 2]), 1: ([3, 4, 5], [10, 11, 12])}


def test_structured_points(spark, tmp_path):
    a = np.arange(24, dtype=np.uint8).reshape(2, 3, 4)
    df = spark.createDataFrame([(5, [2, 3, 4], a.tobytes())], "frame int, shape array<int>, data binary")
    assert sinks.write_structured_points(df, str(tmp_path / "g_t%02d.vtk"), (1, 1, 2.5)) == 1
    content = (tmp_path / "g_t05.vtk").read_bytes()
    assert b"DIMENSIONS 4 3 2\n" in content and b"SPACING 1 1 2.5\n" in content and content.endswith(a.tobytes())


def test_lif_xml(spark, tmp_path):
    (tmp_path / "a.lif").write_bytes(lif_bytes({"one": np.zeros((1, 2, 3, 4), np.uint8)}))
    assert 'Name="one"' in lif.xml_headers(spark, str(tmp_path / "*.lif")).first()["xml"]


def test_names_without_token_and_short_lines(spark, tmp_path):
    (tmp_path / "run.blob").write_text("83.2 152.8 77 2.8 -7.4\n83.3 153.2 78\n\n83.4 x 79 3.3 -12.7\n")
    rows = text.read_blobs(spark, str(tmp_path / "run.blob")).orderBy("pid").collect()
    assert [(r.frame, r.pid, r.x, r.y, r.r) for r in rows] == [(0, 0, 83.2, 152.8, 2.8), (0, 1, 83.3, 153.2, None), (0, 3, 83.4, None, 3.3)]
    (tmp_path / "run.bonds").write_text("3 1\n7\n")
    assert [tuple(r) for r in text.read_bonds(spark, str(tmp_path / "run.bonds")).collect()] == [(0, 1, 3)]
    (tmp_path / "plain.grv").write_text("1 2 3\n")
    assert text.read_grv(spark, str(tmp_path / "plain.grv")).first().frame == 0


def test_files_without_step_are_frames_of_their_own(spark, tmp_path):
    for name, x in (("one.grv", 1.0), ("two.grv", 2.0), ("run_t4.grv", 4.0), ("odd name.grv", 3.0)):
        (tmp_path / name).write_text(f"{x}\t0\t0\n{x}\t1\t0\n")
    got = text.read_grv(spark, str(tmp_path / "*.grv")).orderBy("frame", "pid").collect()
    assert [(r.frame, r.pid, r.x) for r in got] == [(f, i, x) for f, x in ((4, 4.0), (5, 3.0), (6, 1.0), (7, 2.0)) for i in range(2)]
    alone = text.read_grv(spark, str(tmp_path / "one.grv"))
    assert {r.frame for r in alone.collect()} == {0}
    for name in ("a.dat", "b.dat"):
        (tmp_path / name).write_text("1\t2\t1\n5\t6\t7\n0\t0\t0\n1\t1\t1\n")
    assert [(r.frame, r.n) for r in text.read_dat_boxes(spark, str(tmp_path / "*.dat")).orderBy("frame").collect()] == [(0, 2), (1, 2)]
    assert text.read_dat(spark, str(tmp_path / "*.dat")).groupBy("frame").count().count() == 2


def test_particles_beyond_32_bits_are_numbered_anew(spark):
    tr = [7, 3_000_000_000, 3_000_000_000, -5]
    rows = spark.createDataFrame([(f, t, float(f), 0.0, 0.0) for f, t in enumerate(tr)], "frame int, pid long, x double, y double, z double")
    table = sinks.trackpy_table(rows, rows.select("frame", "pid", F.col("pid").alias("tr")))
    assert table.schema["particle"].dataType.simpleString() == "int"
    assert sorted((r.frame, r.particle) for r in table.collect()) == [(0, 1), (1, 2), (2, 2), (3, 0)]
    assert sorted(r.particle for r in sinks.trackpy_table(rows.where("pid < 10"), rows.where("pid < 10").select("frame", "pid", F.col("pid").alias("tr"))).collect()) == [-5, 7]
