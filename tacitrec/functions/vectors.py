"""Column expressions and Arrow conversions for factor vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tacitrec.params import INIT_STDDEV

# 13 hex digits fill the 52 bits that a double between 0 and 1 resolves.
UNIFORM_DIGITS = 13


def dot(left: str | Column, right: str | Column) -> Column:
    """Inner product, summed from the first component to the last."""
    products = F.zip_with(left, right, lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, term: total + term)


def starting_vector(side: str, idx: str | Column, factors: int, seed: int) -> Column:
    """Normal(0, 0.01) components drawn from digests of seed, side, index and place.

    The draw depends on nothing else, so it is the same on every layout and on a retry.
    One digest gives two uniform numbers, and these give two components.
    """
    idx = F.col(idx) if isinstance(idx, str) else idx

    def uniform(digest: Column, start: int) -> Column:
        digits = F.conv(F.substring(digest, start, UNIFORM_DIGITS), 16, 10).cast("bigint")
        return (digits + F.lit(1)) / F.lit(float(16**UNIFORM_DIGITS))

    # One step per array, as a value used twice inside a lambda is computed twice.
    places = F.sequence(F.lit(0), F.lit((factors - 1) // 2))
    prefix = F.concat_ws("|", F.lit(str(seed)), F.lit(side), idx.cast("string"), F.lit(""))
    digests = F.transform(places, lambda place: F.md5(F.concat(prefix, place.cast("string"))))
    polar = F.transform(
        digests,
        lambda digest: F.struct(
            (F.lit(INIT_STDDEV) * F.sqrt(F.lit(-2.0) * F.ln(uniform(digest, 1)))).alias("radius"),
            (F.lit(2.0 * math.pi) * uniform(digest, 1 + UNIFORM_DIGITS)).alias("angle"),
        ),
    )
    both = F.transform(
        polar, lambda at: F.array(at["radius"] * F.cos(at["angle"]), at["radius"] * F.sin(at["angle"]))
    )
    return F.slice(F.flatten(both), 1, factors)


def packed(factors: DataFrame) -> DataFrame:
    """`(idx, vec)` with the components as the bytes of float64 numbers.

    Between the JVM and Python, arrays are copied number by number but bytes as a whole,
    so vectors travel as bytes wherever only Python looks into them.
    """
    if isinstance(factors.schema["vec"].dataType, BinaryType):
        return factors.select("idx", "vec")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vec")
            values = vectors.flatten().to_numpy(zero_copy_only=False)
            width = len(values) // max(1, len(vectors))
            if len(vectors) and not (vectors.value_lengths().to_numpy() == width).all():
                raise ValueError("factor vectors must have the same length")
            yield pa.RecordBatch.from_arrays(
                [batch.column("idx"), from_matrix(values.reshape(len(vectors), width))], names=["idx", "vec"]
            )

    return factors.select("idx", "vec").mapInArrow(pack, "idx bigint, vec binary")


def unpacked(factors: DataFrame) -> DataFrame:
    """`(idx, vec)` with the components as an array."""
    if not isinstance(factors.schema["vec"].dataType, BinaryType):
        return factors.select("idx", "vec")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = to_matrix(batch.column("vec"))
            offsets = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(matrix.shape[1])
            vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("idx"), vectors], names=["idx", "vec"])

    return factors.select("idx", "vec").mapInArrow(unpack, "idx bigint, vec array<double>")


def to_matrix(column: pa.ChunkedArray | pa.Array, width: int = 0) -> np.ndarray:
    """Rows of a packed column without nulls as a read-only matrix; its values are checked.

    `width` is only needed to shape a column without rows.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, width))
    offsets = _offsets(column)
    values = _values(column, offsets, np.float64)
    if (np.diff(offsets) != 8 * (len(values) // len(column))).any():
        raise ValueError("factor vectors must have the same length")
    if not np.isfinite(values).all():
        raise ValueError("factor vectors must be finite; training has diverged")
    return values.reshape(len(column), -1)


def from_matrix(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as a packed column."""
    rows, width = matrix.shape
    offsets = np.arange(rows + 1, dtype=np.int32) * np.int32(8 * width)
    values = np.ascontiguousarray(matrix, dtype=np.float64)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def one_packed(values: np.ndarray, kind: type) -> pa.Array:
    """A packed column with a single row."""
    return pa.array([np.ascontiguousarray(values, dtype=kind).tobytes()], pa.binary())


def unpack_row(column: pa.ChunkedArray, row: int, kind: type) -> np.ndarray:
    """The numbers in one row of a packed column."""
    return np.frombuffer(column[row].as_buffer(), dtype=kind)


def _offsets(column: pa.Array) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1]


def _values(column: pa.Array, offsets: np.ndarray, kind: type) -> np.ndarray:
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]].view(kind)
