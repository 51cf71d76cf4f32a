"""Images painted from the embedding positions, then analysed."""

from pyspark.sql import functions as F

from ..imaging import spectra, tracking
from ..operators import linking
from ..sources import images as img
from .catalog import query, rounded
from .tables import P, positions

SIDE = 96


def painted(spark, d, ndim=2):
    """One image per frame: x, y (, z) of [-0.5, 0.5] onto the pixels, radius from the r field."""
    side = SIDE if ndim == 2 else 48
    pos = positions(spark, d).select("frame", "pid", *[((F.col(c) + 0.5) * side).alias(c) for c in "xyz"], (F.col("r") * 60 + 1).alias("r"))
    return tracking.paint_spheres(pos, [side] * ndim)


LIT = f"""g AS (SELECT frame, (x+0.5)*{SIDE} AS x, (y+0.5)*{SIDE} AS y, r*60+1 AS r FROM p),
 lit AS (SELECT DISTINCT frame, i, j FROM g, range({SIDE}) a(i), range({SIDE}) b(j) WHERE (i-x)*(i-x)+(j-y)*(j-y) <= r*r)"""


@query(f"WITH {P}, {LIT} SELECT frame, count(*) AS lit, sum(i)::BIGINT AS sum_x, sum(j)::BIGINT AS sum_y FROM lit GROUP BY 1")
def painted_discs(spark, d):
    images = painted(spark, d)
    def measure(batches):
        import numpy as np
        import pandas as pd
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                y, x = np.nonzero(img.as_array(row.shape, row.data))
                yield pd.DataFrame({"frame": [row.frame], "lit": [len(x)], "sum_x": [int(x.sum())], "sum_y": [int(y.sum())]})
    return images.mapInPandas(measure, "frame int, lit long, sum_x long, sum_y long")


@query(f"WITH {P}, {LIT} SELECT frame, count(*)*200 AS brightness FROM lit GROUP BY 1")
def tiff_round_trip(spark, d):
    def through(batches):
        import pandas as pd
        for pdf in batches:
            planes = [img.decode_tiff(img.encode_tiff(img.as_array(s, b).astype("uint16"))) for s, b in zip(pdf["shape"], pdf["data"])]
            yield pd.DataFrame({"frame": pdf["frame"], "brightness": [int(p.sum()) for p in planes]})
    return painted(spark, d).mapInPandas(through, "frame int, brightness long")


@query()
def tracked_peaks(spark, d):
    return rounded(tracking.track_peaks(painted(spark, d), 2.0, 8.0, margin=6), "x", "y", "z", "r", "intensity")


@query()
def tracked_blobs_2d(spark, d):
    return rounded(tracking.track_blobs(painted(spark, d), max_ratio=1.2), "x", "y", "z", "r", "intensity")


@query()
def tracked_blobs_3d(spark, d):
    return rounded(tracking.track_blobs(painted(spark, d, 3), octaves=2, first_octave=False), "x", "y", "z", "r", "intensity")


@query()
def tracking_parameter_scan(spark, d):
    return tracking.parameter_scan(painted(spark, d), [1.5, 2.5], [6.0, 9.0], 0.0, 200.0, 20)


@query()
def radii_from_profiles(spark, d):
    images = painted(spark, d)
    centres = positions(spark, d).select("frame", "pid", ((F.col("x") + 0.5) * SIDE).alias("x"), ((F.col("y") + 0.5) * SIDE).alias("y"), F.lit(0.0).alias("z"))
    return rounded(tracking.radii(images, centres, 1.0, 12.0), "r")


@query()
def volumes_from_slices(spark, d):
    side = SIDE
    slices = positions(spark, d).select(
        F.col("frame").alias("sample"), F.floor((F.col("z") + 0.5) * 40).cast("int").alias("frame"), "pid",
        (F.col("x") * side).alias("x"), (F.col("y") * side).alias("y"), (F.col("r") * 60).alias("r"), F.col("f").alias("intensity"))
    piles = linking.link_frames(slices, 8.0, group=["sample"], coords=["x", "y"])
    rows = slices.join(piles, ["sample", "frame", "pid"]).withColumnRenamed("tr", "pile")
    parts = tracking.split_piles(rows, ["sample", "pile"])
    return rounded(tracking.pile_centres(parts, ["sample", "pile", "part"]), "x", "y", "z", "r", "intensity")


@query()
def image_power_spectrum(spark, d):
    return rounded(spectra.image_spectrum(painted(spark, d)), "power")


@query()
def differential_dynamic_microscopy(spark, d):
    return rounded(spectra.ddm(painted(spark, d), [1, 2, 4]), "power")


@query()
def image_displacements(spark, d):
    return rounded(spectra.displacements(painted(spark, d), tile=48, overlap=16), "confidence")
