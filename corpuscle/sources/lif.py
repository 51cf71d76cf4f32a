"""Leica image files as a Python data source: ``spark.read.format("lif").load(path)``.

One row per series and time step: file, serie, name, t, shape (slowest axis first), voxel (metres per
step along the same axes), data (8-bit pixels).  A partition is a range of time steps of one series and
reads only the bytes it needs.
"""

from __future__ import annotations

import glob
import re
import struct
import xml.etree.ElementTree as ET
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK_MAGIC, ITEM_MAGIC = 112, b"*"
AXIS = {1: "X", 2: "Y", 3: "Z", 4: "T"}
NOT_SERIES = {"BleachPointROISet", "DCROISet"}


@dataclass
class Serie:
    name: str
    offset: int
    dims: list            # (axis, number of elements, bytes between elements, length in metres)
    stamps: list          # acquisition times, 100 ns ticks
    channels: int

    def count(self, axis: str) -> int:
        return next((n for a, n, _, _ in self.dims if a == axis), 1)

    def stride(self, axis: str) -> int:
        return next((b for a, _, b, _ in self.dims if a == axis), 0)

    @property
    def space(self):
        """Spatial dimensions, slowest first."""
        return [d for d in reversed(self.dims) if d[0] in "XYZ"]


def _block_size(f, version: int) -> int:
    magic, _, mark = struct.unpack("<iic", f.read(9))
    if magic != BLOCK_MAGIC or mark != ITEM_MAGIC:
        raise ValueError("not a LIF block")
    return struct.unpack("<I", f.read(4))[0] if version < 2 else struct.unpack("<Q", f.read(8))[0]


def read_xml(f) -> str:
    """The XML header, which is UTF-16 text at the start of the file."""
    length = _block_size(f, 0)
    return f.read(2 * length).decode("utf-16-le", errors="replace")


def _parse(text: str):
    root = ET.fromstring(re.sub(r"[^\x09\x0a\x0d\x20-\x7e]", "", text))
    elements = list(root.iter("Element"))[1:]
    return int(float(root.get("Version", 1))), [e for e in elements if e.get("Name") not in NOT_SERIES]


def read_series(path: str) -> list[Serie]:
    with open(path, "rb") as f:
        size = f.seek(0, 2)
        f.seek(0)
        version, elements = _parse(read_xml(f))
        offsets = []
        while f.tell() < size:
            length = _block_size(f, version)
            while f.read(1) != ITEM_MAGIC:
                pass
            f.seek(2 * struct.unpack("<I", f.read(4))[0], 1)
            if length:
                offsets.append(f.tell())
                f.seek(length, 1)
    series = []
    for element, offset in zip(elements, offsets):
        dims = [(AXIS.get(int(d.get("DimID")), "?"), int(d.get("NumberOfElements")), int(d.get("BytesInc")), float(d.get("Length") or 0))
                for d in element.iter("DimensionDescription")]
        stamps = [(int(s.get("HighInteger")) << 32) + int(s.get("LowInteger")) for s in element.iter("TimeStamp")]
        series.append(Serie(element.get("Name"), offset, dims, stamps, len(list(element.iter("ChannelDescription")))))
    return series


@dataclass
class StepRange(InputPartition):
    path: str
    serie: int
    first: int
    stop: int


class LifReader(DataSourceReader):
    def __init__(self, options):
        self.paths = sorted(glob.glob(options["path"])) or [options["path"]]
        self.only = options.get("serie")
        self.steps = int(options.get("stepsPerPartition", 16))

    def partitions(self):
        parts = []
        for path in self.paths:
            for i, serie in enumerate(read_series(path)):
                if self.only is None or int(self.only) == i:
                    n = serie.count("T")
                    parts += [StepRange(path, i, t, min(t + self.steps, n)) for t in range(0, n, self.steps)]
        return parts

    def read(self, partition):
        serie = read_series(partition.path)[partition.serie]
        shape = [n for _, n, _, _ in serie.space]
        voxel = [length / max(n - 1, 1) for _, n, _, length in serie.space]
        pixels = 1
        for n in shape:
            pixels *= n
        with open(partition.path, "rb") as f:
            for t in range(partition.first, partition.stop):
                f.seek(serie.offset + t * serie.stride("T"))
                stamp = serie.stamps[t * len(serie.stamps) // max(serie.count("T"), 1)] if serie.stamps else None
                yield (partition.path, partition.serie, serie.name, t, shape, voxel, stamp, f.read(pixels))


class LifSource(DataSource):
    @classmethod
    def name(cls):
        return "lif"

    def schema(self):
        return ("file string, serie int, name string, t int, shape array<int>, voxel array<double>, stamp bigint, data binary")

    def reader(self, schema):
        return LifReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(LifSource)


def series_table(spark, path: str):
    """What a file holds: file, serie, name, axes, sizes, channels (headers only)."""
    rows = [(p, i, s.name, "".join(a for a, *_ in s.dims), [n for _, n, _, _ in s.dims], s.channels)
            for p in sorted(glob.glob(path)) for i, s in enumerate(read_series(p))]
    return spark.createDataFrame(rows, "file string, serie int, name string, axes string, sizes array<int>, channels int")


def xml_headers(spark, path: str):
    """The XML header of each file: file, xml.  Only the header bytes are read, one file per task."""
    files = sorted(glob.glob(path))
    names = spark.createDataFrame([(p,) for p in files], "file string").repartition(max(len(files), 1), "file")

    def extract(batches):
        for pdf in batches:
            texts = []
            for name in pdf["file"]:
                with open(name, "rb") as f:
                    texts.append(read_xml(f))
            yield pdf.assign(xml=texts)
    return names.mapInPandas(extract, "file string, xml string")
