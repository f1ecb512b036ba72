"""Sums of arrays that tasks made: fits that add up numbers over all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def added(parts: DataFrame) -> dict[int, np.ndarray]:
    """{key: sum of its arrays} of (key int, x array<double>) rows.  The arrays
    of a key, all of one length, meet as they are in one task that adds them
    as they come, so a task holds one array per key; the driver gets the sums."""

    def run(batches):
        total: dict = {}
        for batch in batches:
            xs = batch.column(1)
            for i, k in enumerate(batch.column(0).to_pylist()):
                x = xs[i].values.to_numpy(zero_copy_only=False)
                if k in total:
                    total[k] += x
                else:
                    total[k] = x.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))],
                                         names=["key", "x"])

    key, x = parts.columns
    got = parts.repartition(key).mapInArrow(run, "key int, x array<double>").toArrow()
    return {k: v.values.to_numpy(zero_copy_only=False) for k, v in zip(got.column("key").to_pylist(), got.column("x"), strict=True)}
