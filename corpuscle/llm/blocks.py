"""Adding up large tables of integers that every task has counted for itself."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SALTS = 16
SCHEMA = "block int, salt int, sums binary"


def _sums(parts: DataFrame) -> DataFrame:
    """Blocks of one partition added up as they arrive."""
    def run(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for block, salt, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                part = np.frombuffer(data.as_buffer(), np.int64)
                if (block, salt) in total:
                    total[block, salt] += part
                else:
                    total[block, salt] = part.copy()
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int32()),
                                          pa.array([v.tobytes() for v in total.values()], pa.binary())], ["block", "salt", "sums"])

    return parts.mapInArrow(run, SCHEMA)


def added(parts: DataFrame) -> DataFrame:
    """Rows (block, salt, sums as 64-bit integers) added up per block: first per block and salt, so that no block meets all its parts in one task, then per block."""
    salted = _sums(parts.withColumn("salt", F.col("salt") % SALTS).repartition("block", "salt"))
    return _sums(salted.withColumn("salt", F.lit(0)).repartition("block"))
