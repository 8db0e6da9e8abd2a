"""SimHash near-dedup by multi-index hashing.

A fingerprint has 64 bits, one vote per shingle hash and bit. Two fingerprints within `distance`
bits differ in at most half of these in one of their two 32-bit segments. Every distinct
fingerprint is entered in the table of a segment under all keys of a small Hamming ball around
its segment; two fingerprints whose segments are near enough meet under a common key, and those
that meet are compared over all 64 bits. So no link is missed and none is guessed.

Copies have one fingerprint and count once from there on. Within a key only a spanning forest of
the links is emitted, never all pairs. A key with more fingerprints than `block` is handed on in
blocks, and pairs of blocks are compared as separate groups, so no task holds more than two
blocks of a key. Components come from repeated star contractions over written tables; labels,
links and fingerprints stay on the executors.

Texts without a word, null ones included, have fingerprint zero and are linked like any other.
Null ids take part; a component's id is the smallest non-null one, null if there is none. Columns
`fingerprint` and `component_id` of the input are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tacitrec.tables import drop_table, write_table

SEGMENTS, SEGMENT_BITS = 2, 32
EDGES = "a bigint, b bigint, key bigint, chunk bigint"


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of the word shingles, as an unsigned number."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(words))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in spans), "<u8", len(words) - width + 1)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", shingle: int = 4, seed: int = 42, name: str = "fingerprint") -> DataFrame:
    """`df` with the fingerprint as a signed 64-bit number."""

    def of(texts: pd.Series) -> pd.Series:
        values = np.array([fingerprint(t if isinstance(t, str) else None, shingle, seed) for t in texts], np.uint64)
        return pd.Series(values.view(np.int64))

    return df.withColumn(name, F.pandas_udf(of, "bigint")(F.col(f"`{text}`")))


def ball(radius: int) -> list[int]:
    """Masks of at most `radius` bits of a segment."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(SEGMENT_BITS), r)]


def keys_of(distinct: DataFrame, distance: int) -> DataFrame:
    """`(key, fp)`: the table entries of every fingerprint.

    With two segments, either the first differs in at most half the distance or the second in
    less than that. Balls of half the radius on both sides meet in the middle.
    """
    first = distance // SEGMENTS
    radii = (first, max(first - 1, 0) if distance % SEGMENTS == 0 else first)

    def entries(segment: int, radius: int):
        value = F.shiftrightunsigned("fp", SEGMENT_BITS * segment).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
        masks = F.array(*[F.lit(m).cast("bigint") for m in ball((radius + 1) // 2)])
        return F.transform(masks, lambda mask: value.bitwiseXOR(mask) + F.lit(segment << SEGMENT_BITS))

    keys = F.concat(*[entries(segment, radius) for segment, radius in enumerate(radii)])
    return distinct.select(F.explode(keys).alias("key"), "fp")


def forest(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every value to the first of its component among `values`."""
    n = len(values)
    near = np.empty((n, n), bool)
    for i in range(0, n, 256):
        near[i : i + 256] = np.bitwise_count(values[i : i + 256, None] ^ values[None, :]) <= distance
    label = np.arange(n)
    while True:
        new = np.array([label[row].min() for row in near])
        new = new[new]
        if (new == label).all():
            break
        label = new
    child = np.flatnonzero(label != np.arange(n))
    return values[child], values[label[child]]


def _rows(a, b=(), key=(), chunk=()) -> pa.RecordBatch:
    n = len(a)
    null = pa.nulls(n, pa.int64())
    column = lambda x: pa.array(np.asarray(x, np.int64)) if len(x) else null
    return pa.RecordBatch.from_arrays([column(a), column(b), column(key), column(chunk)], ["a", "b", "key", "chunk"])


def _link_runs(distance: int, block: int):
    """Over rows sorted by key: links within a key, and the members of keys beyond one block."""

    def flush(key: int, values: np.ndarray, chunk: int, last: bool) -> Iterator[pa.RecordBatch]:
        a, b = forest(values.view(np.uint64), distance)
        if len(a):
            yield _rows(a.view(np.int64), b.view(np.int64))
        if chunk or not last:
            yield _rows(values, key=np.full(len(values), key), chunk=np.full(len(values), chunk))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, chunk = None, np.zeros(0, np.int64), 0
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            values = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(keys):
                continue
            cuts = np.flatnonzero(np.diff(keys)) + 1
            bounds = np.concatenate([[0], cuts, [len(keys)]])
            lengths = np.diff(bounds)
            last = len(lengths) - 1
            pairs = []
            for i in np.flatnonzero((lengths > 1) | (np.arange(len(lengths)) == 0) | (np.arange(len(lengths)) == last)):
                part = values[bounds[i] : bounds[i + 1]]
                if i == 0 and keys[0] == key:
                    part = np.concatenate([held, part])
                else:
                    if i == 0 and len(held):
                        yield from flush(key, held, chunk, True)
                    key, chunk = int(keys[bounds[i]]), 0
                while len(part) > block:
                    yield from flush(key, part[:block], chunk, False)
                    part, chunk = part[block:], chunk + 1
                if i == last:
                    held = part
                elif len(part) == 2 and not chunk:
                    pairs.append(part)
                else:
                    yield from flush(key, part, chunk, True)
            if pairs:
                two = np.array(pairs).view(np.uint64)
                two = two[np.bitwise_count(two[:, 0] ^ two[:, 1]) <= distance]
                if len(two):
                    yield _rows(two[:, 0].view(np.int64), two[:, 1].view(np.int64))
        if len(held):
            yield from flush(key, held, chunk, True)

    return run


def links(distinct: DataFrame, distance: int = 4, block: int = 2048) -> DataFrame:
    """Links `(a, b)` that connect the fingerprints `fp` of `distinct` as all links would.

    An edge joins two fingerprints of one component, not necessarily within the distance.
    """
    sort = lambda df, *by: df.repartition(*by).sortWithinPartitions(*by)
    first = write_table(
        sort(keys_of(distinct, distance), "key").mapInArrow(_link_runs(distance, block), EDGES), "simhash-links"
    )
    members = first.filter(F.col("key").isNotNull())
    found = first.filter(F.col("key").isNull()).select("a", "b")
    # Blocks of a large key, each paired with every other block of that key.
    width = members.groupBy("key").agg((F.max("chunk") + 1).alias("chunks"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))
    paired = members.join(width, "key").select("key", "chunk", "a", other.alias("other")).filter("chunk <> other").select(
        F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("pair"), "a"
    )
    across = sort(paired, "pair").mapInArrow(_link_runs(distance, 1 << 30), EDGES).select("a", "b")
    return found.unionByName(across).distinct()


def components(edges: DataFrame) -> DataFrame:
    """`(node, component)` of all nodes of `edges`, the component being its smallest node.

    Large-star and small-star steps take turns until the edges stay the same.
    """
    known = write_table(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "stars"
    )

    def signature(table: DataFrame):
        return table.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = signature(known)
    while before[0]:
        both = known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        grown = write_table(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "stars")
        drop_table(known)
        known, after = grown, signature(grown)
        if after == before:
            break
        before = after
    heads = known.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return known.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(heads)


def near_duplicates(
    df: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 4, seed: int = 42, distance: int = 4, block: int = 2048
) -> DataFrame:
    """`(id, fingerprint, component, component_id)` for every row of `df`.

    `component` is null for a fingerprint without links; `component_id` is the smallest id of
    the component.
    """
    rows = write_table(
        fingerprints(df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")), "text", shingle, seed, "fp")
        .select("id", "fp"),
        "fingerprints",
    )
    return joined_components(rows, distance, block)


def joined_components(rows: DataFrame, distance: int, block: int) -> DataFrame:
    """Components for written rows `(id, fp)`, other columns being kept."""
    distinct = write_table(rows.groupBy("fp").agg(F.min("id").alias("smallest")), "distinct-fingerprints")
    found = components(links(distinct.select("fp"), distance, block))
    by_fp = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "smallest", F.coalesce("component", "fp").alias("component")
    )
    smallest = by_fp.groupBy("component").agg(F.min("smallest").alias("component_id"))
    named = write_table(by_fp.select("fp", "component").join(smallest, "component"), "fingerprint-components")
    drop_table(distinct)
    return rows.join(named, "fp").withColumnRenamed("fp", "fingerprint")


def one_per_component(df: DataFrame, id: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """The row of `df` with the smallest id of every component; one of rows equal in id and text."""
    key = F.col(f"`{id}`")
    digest = F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    marked = df.select(key.alias("id"), F.col(f"`{text}`").alias("text"), digest.alias("digest"))
    rows = write_table(
        fingerprints(marked, "text", parameters.pop("shingle", 4), parameters.pop("seed", 42), "fp").select("id", "fp", "digest"),
        "fingerprints",
    )
    grouped = joined_components(rows, parameters.pop("distance", 4), parameters.pop("block", 2048))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("first")
    stays = grouped.groupBy("component").agg(first).select(
        F.col("first.id").alias("__id"), F.col("first.digest").alias("__digest")
    )
    met = df.withColumn("__key", digest).join(
        stays, F.col("__key").eqNullSafe(F.col("__digest")) & key.eqNullSafe(F.col("__id")), "left_semi"
    )
    # Rows equal in id and text are rare, and one of them is enough.
    return met.dropDuplicates([id, "__key"]).drop("__key")
