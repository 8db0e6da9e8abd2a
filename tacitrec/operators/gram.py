"""Weighted Gram matrix of one side's factors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tacitrec.functions.vectors import to_matrix


def gram(factors: DataFrame, k: int) -> DataFrame:
    """`(f, g, value)` of the sum of c v v' over all rows of `(c, vec)`, vec packed; f <= g.

    Each task reduces its rows to one matrix, the matrices are added up by a grouped sum.
    """
    upper = np.triu_indices(k)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            v = to_matrix(batch.column("vec"), k)
            c = batch.column("c").to_numpy(zero_copy_only=False)
            total += (v * c[:, None]).T @ v
        yield pa.RecordBatch.from_arrays(
            [pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array(total[upper])],
            names=["f", "g", "value"],
        )

    parts = factors.select("c", "vec").mapInArrow(partial, "f int, g int, value double")
    return parts.groupBy("f", "g").agg(F.sum("value").alias("value"))


def gram_array(factors: DataFrame, k: int) -> np.ndarray:
    """The Gram matrix on the driver: k x k numbers, whatever the number of rows."""
    full = np.zeros((k, k))
    for row in gram(factors, k).collect():
        full[row["f"], row["g"]] = full[row["g"], row["f"]] = row["value"]
    return full
