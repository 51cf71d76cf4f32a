"""Image files: TIFF planes, stacks from numbered slices.  An image relation has shape and data columns."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .text import frame_of

SIZES = {1: 1, 2: 1, 3: 2, 4: 4}          # bytes of TIFF field types BYTE, ASCII, SHORT, LONG
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, STRIP_BYTES = 256, 257, 258, 259, 273, 279   # TIFF tags


def decode_tiff(content: bytes) -> np.ndarray:
    """First plane of an uncompressed 8 or 16 bit grey TIFF, either byte order."""
    order = {b"II": "<", b"MM": ">"}[content[:2]]
    start = struct.unpack_from(order + "I", content, 4)[0]
    tags = {}
    for i in range(struct.unpack_from(order + "H", content, start)[0]):
        at = start + 2 + 12 * i
        tag, kind, count = struct.unpack_from(order + "HHI", content, at)
        if kind not in SIZES:
            continue
        where = at + 8 if SIZES[kind] * count <= 4 else struct.unpack_from(order + "I", content, at + 8)[0]
        tags[tag] = struct.unpack_from(order + str(count) + {1: "B", 2: "B", 3: "H", 4: "I"}[kind], content, where)
    if tags.get(COMPRESSION, (1,))[0] != 1:
        raise ValueError("compressed TIFF")
    pixels = b"".join(content[a:a + n] for a, n in zip(tags[STRIPS], tags[STRIP_BYTES]))
    dtype = np.dtype(np.uint8) if tags.get(BITS, (8,))[0] == 8 else np.dtype(order + "u2")
    return np.frombuffer(pixels, dtype).reshape(tags[HEIGHT][0], tags[WIDTH][0])


def encode_tiff(plane: np.ndarray, big_endian: bool = True) -> bytes:
    """Uncompressed single-strip TIFF of a uint8 or uint16 plane."""
    order = ">" if big_endian else "<"
    bits = plane.dtype.itemsize * 8
    pixels = plane.astype(plane.dtype.newbyteorder(order)).tobytes()
    entries = [(WIDTH, 4, plane.shape[1]), (HEIGHT, 4, plane.shape[0]), (BITS, 3, bits), (COMPRESSION, 3, 1),
               (STRIPS, 4, 8), (STRIP_BYTES, 4, len(pixels))]
    head = (b"MM" if big_endian else b"II") + struct.pack(order + "HI", 42, 8 + len(pixels))
    table = struct.pack(order + "H", len(entries))
    for tag, kind, value in entries:
        table += struct.pack(order + "HHI", tag, kind, 1)
        table += struct.pack(order + ("HH" if kind == 3 else "I"), *((value, 0) if kind == 3 else (value,)))
    return head + pixels + table + struct.pack(order + "I", 0)


def as_array(shape, data: bytes) -> np.ndarray:
    """Pixels of an image row; 16 bit if there are twice as many bytes as pixels, 32 bit float if four times."""
    shape = tuple(int(n) for n in shape)
    kind = {1: np.uint8, 2: np.uint16, 4: np.float32, 8: np.float64}[len(data) // max(int(np.prod(shape)), 1)]
    return np.frombuffer(data, kind).reshape(shape)


def read_tiffs(spark, path, t_token: str = "_t", z_token: str = "_z") -> DataFrame:
    """Planes of a file series: frame, z, shape, data (uint8 or little-endian uint16)."""
    files = spark.read.format("binaryFile").load(path)

    def decode(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            planes = [decode_tiff(c) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "shape": [list(p.shape) for p in planes],
                                "data": [p.astype(p.dtype.newbyteorder("<")).tobytes() for p in planes]})
    decoded = files.select("path", "content").mapInPandas(decode, "path string, shape array<int>, data binary")
    return decoded.select(frame_of("path", t_token).alias("frame"), frame_of("path", z_token).alias("z"), "shape", "data")


def stack_planes(planes: DataFrame, keys=("frame",)) -> DataFrame:
    """Planes of the same frame piled up by z into one image (size bounded by the stack, not by the series)."""
    piles = planes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("z", "shape", "data"))).alias("p"))
    shape = F.concat(F.array(F.size("p")), F.col("p")[0]["shape"])
    joined = F.aggregate("p", F.lit(b""), lambda acc, e: F.concat(acc, e["data"]))
    return piles.select(*keys, shape.alias("shape"), joined.alias("data"))
