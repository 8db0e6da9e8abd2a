"""Packing along a space-filling curve.

Every document is tokenised and ends with an end id. Its token counts, hashed into a vector, are
projected to a few dimensions by a fixed random matrix, and the place of the projection on a
Hilbert curve is its key. Documents are range-sorted by that key and laid end to end; sequences
are cut from this line, so a sequence holds neighbours on the curve and only the last sequence
of all can be short.

Token ids move once. What is sorted is a narrow table of keys and lengths; the sums of its
partitions, one number each, go through the driver, and then every document knows where it
starts and cuts itself. Copies have one key, but the row number after it spreads them over
partitions. Row numbers stand in a written table, so a lost executor does not change them.

Null text counts as empty: such a document is its end id alone. Null and repeated ids are
carried along. A document of any length is cut into as many pieces as it needs. An empty table
gives no pieces.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass
from math import erf, sqrt

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tacitrec.llm.common import running_starts
from tacitrec.tables import write_table

@dataclass(frozen=True)
class PackParams:
    tokenizer: str
    ranks: str | None = None
    pattern: str | None = None
    end_id: int = 1
    length: int = 2048
    dims: int = 3
    bits: int = 20
    buckets: int = 1 << 14
    seed: int = 42


class Encoder:
    """Token ids of texts.

    With `ranks` and `pattern`, the same vocabulary as merge ranks, tiktoken encodes: it gives
    the same ids four times faster. Texts that hold the string of a special token always go to
    the tokenizer itself.
    """

    def __init__(self, params: PackParams):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(params.tokenizer)
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if params.ranks:
            import tiktoken

            with open(params.ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=params.pattern, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(special in text for special in self.special):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def projection(p: PackParams) -> np.ndarray:
    return np.random.default_rng(p.seed).standard_normal((p.buckets, p.dims))


def coordinates(ids: np.ndarray, p: PackParams, directions: np.ndarray) -> np.ndarray:
    """The place of a document in the unit cube, as `bits`-bit integers."""
    ordered = np.sort(ids)
    at = np.flatnonzero(np.diff(ordered, prepend=ordered[0] ^ 1))
    weights = np.sqrt(np.diff(np.append(at, len(ordered))))
    hashed = (ordered[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (p.buckets - 1).bit_length())
    point = weights @ directions[hashed.astype(np.int64)] / sqrt(len(ordered))
    cube = [0.5 * (1 + erf(x / sqrt(2))) for x in point]  # even, as each component is near normal
    return np.array([min(int(x * (1 << p.bits)), (1 << p.bits) - 1) for x in cube], np.uint64)


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points `(n, dims)`, by the transposed Gray code."""
    x = [points[:, d].astype(np.int64).copy() for d in range(points.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for d in range(len(x)):
            flip = (x[d] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[d] = x[d] ^ swap if d else x[0]
        q >>= 1
    for d in range(1, len(x)):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for d in range(len(x)):
            key = (key << 1) | (((x[d] ^ turn) >> bit) & 1)
    return key


def tokenised(df: DataFrame, id: str, text: str, params: PackParams) -> DataFrame:
    """`(id, doc_tokens, curve, ids)` with the ids as compressed little-endian 32-bit numbers."""
    kind = df.schema[id].dataType
    schema = T.StructType([
        T.StructField("id", kind), T.StructField("doc_tokens", T.LongType()),
        T.StructField("curve", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, directions = Encoder(params), zstandard.ZstdCompressor(level=3), projection(params)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                lengths, points, blobs = [], [], []
                for text in part.column(1).to_pylist():
                    ids = np.array([*encoder.ids(text or ""), params.end_id], "<u4")
                    lengths.append(len(ids))
                    points.append(coordinates(ids, params, directions))
                    blobs.append(packer.compress(ids.tobytes()))
                keys = hilbert_keys(np.array(points), params.bits)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(lengths, pa.int64()), pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())],
                    ["id", "doc_tokens", "curve", "ids"],
                )

    return df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(encode, schema)


def pack(df: DataFrame, params: PackParams, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: `(id, start, length, doc_tokens, sequence_id, offset, ids)`.

    `ids` are the piece's token ids as little-endian 32-bit numbers.
    """
    documents = write_table(
        tokenised(df, id, text, params).withColumn("row", F.monotonically_increasing_id()), "tokens"
    )
    line, _ = running_starts(
        documents.select("curve", "id", "row", "doc_tokens"), ["curve", "id", "row"], "doc_tokens", "at", "curve-order"
    )
    placed = documents.drop("curve").join(line.select("row", "at"), "row").select("id", "doc_tokens", "at", "ids")
    kind = documents.schema["id"].dataType
    long = T.LongType()
    schema = T.StructType([
        T.StructField("id", kind), *[T.StructField(n, long) for n in ("start", "length", "doc_tokens", "sequence_id", "offset")],
        T.StructField("ids", T.BinaryType()),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker, width = zstandard.ZstdDecompressor(), params.length
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows, owners = [], []
                blobs = part.column(3)
                for i, (n, begin) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    data = unpacker.decompress(blobs[i].as_py())
                    start = 0
                    while start < n:
                        sequence, offset = divmod(begin + start, width)
                        length = min(width - offset, n - start)
                        rows.append((start, length, n, sequence, offset, data[4 * start : 4 * (start + length)]))
                        owners.append(i)
                        start += length
                columns = list(zip(*rows)) or [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owners, pa.int64())), *[pa.array(c, pa.int64()) for c in columns[:5]], pa.array(columns[5], pa.binary())],
                    schema.names,
                )

    return placed.mapInArrow(cut, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """`(sequence_id, length, ids)`: the pieces of each sequence in order, at most its width."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "length")))
    return pieces.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(0).cast("bigint"), lambda total, part: total + part["length"]).alias("length"),
        F.aggregate("parts", F.lit(b""), lambda ids, part: F.concat(ids, part["ids"])).alias("ids"),
    )


