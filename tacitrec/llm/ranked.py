"""Ranked lexical search: every query item's best documents by a sum of term impacts, exactly.

`build_index` cuts the documents into segments and writes, per segment and term, the posting list
of documents and occurrences, and the documents' ids and lengths. `search` then serves items in
blocks:

1. The lists of the block's terms are joined out of the index, and document frequencies are added
   up over all segments, so every posting's impact is known.
2. Per segment, for pairs of terms that follow each other by weight within an item, the lists are
   intersected; the pair's list is stored with its joint maximum impact. Documents of an item's
   strongest pair lists are scored on the spot: the `top`-th best score over all segments is a limit
   that no result can be below.
3. Per segment and item, MaxScore: terms are ordered by their maximum impact, and the bound of the
   weakest ones combines pairs: of two terms a document gains at most the larger of their maxima
   and their joint maximum, so disjoint pairs tighten the sum of the maxima. Terms whose bound
   stays under the limit cannot lift a document alone; documents come from the other lists only,
   and are dropped as soon as what is left cannot lift them to the limit. The limit rises with the
   scores seen. A segment whose bound for all terms is under the limit is not read for that item.
4. Of each segment's best documents, the best of all stay.

Nothing is cut off that could be a result: bounds are compared strictly, so ties stay in. Segments
hold up to `segment_docs` documents and `segment_bytes` of text (one text may be longer), which
bounds a task; how often a term occurs overall does not. Through the driver go, per block, the
items' terms (at most `block_terms`, or one item's), their frequencies and the items' limits.

Null and empty texts have no terms: such documents rank nowhere and such items get no rows. Ids
are whole numbers; equal scores go by ascending id, null ids last. Repeated documents are ranked
each, repeated items are served each. Empty tables give no rows. Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from tacitrec.llm.common import lower_ascii, running_starts
from tacitrec.tables import write_table

TERM = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
_BYTES = np.arange(256, dtype=np.uint8)
_UPPER = (_BYTES >= ord("A")) & (_BYTES <= ord("Z"))
_LOWERED = np.where(_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)
_IN_TERM = (_BYTES >= 128) | ((_BYTES >= ord("0")) & (_BYTES <= ord("9"))) | ((_LOWERED >= ord("a")) & (_LOWERED <= ord("z")))

INDEX_SCHEMA = "segment bigint, term string, docs binary, tfs binary, ids binary, lengths binary"
LISTS_SCHEMA = "segment bigint, a int, b int, docs binary, impacts binary, best bigint, item int, score bigint"
FOUND_SCHEMA = "item int, score bigint, doc_id bigint, has_id boolean, postings bigint, postings_read bigint"


@dataclass(frozen=True)
class SearchParams:
    top: int = 50
    segment_docs: int = 16_384  # documents are numbered in 16 bits within a segment
    segment_bytes: int = 16 << 20
    reach: int = 2  # a term is paired with so many that follow it by weight
    seed_lists: int = 3
    block_items: int = 500
    block_terms: int = 100_000


@dataclass(frozen=True)
class Index:
    """`lists` has a row per segment and term, and one without term per segment for its documents."""

    lists: DataFrame  # INDEX_SCHEMA
    n_docs: int  # documents with a term
    n_terms: int  # terms of all documents, repeats included


# --- index --------------------------------------------------------------------------

def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts in order, and the text that each is of."""
    texts = texts.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    inside = _IN_TERM[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    starts = ends[:-1][ends[:-1] < len(data)]  # a term ends with its text
    first[starts] = inside[starts]
    before = starts[starts > 0] - 1
    last[before] = inside[before]
    begin, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    offsets = np.concatenate(([0], np.cumsum(stop - begin)))
    owner = np.searchsorted(ends, begin, side="right") - 1
    kept = _LOWERED[data[inside]]
    terms = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    return terms, owner


def _blobs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary per run of `values`."""
    offsets = np.concatenate(([0], ends)) * values.itemsize
    return pa.Array.from_buffers(
        pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]
    ).cast(pa.binary())


def _segment(number: int, chunks: list[pa.Array], owners: list[np.ndarray], ids: pa.Array) -> Iterator[pa.RecordBatch]:
    """The rows of one segment; its documents are numbered by ascending id, null ids last."""
    missing = ids.is_null().to_numpy(zero_copy_only=False)
    numbers = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((numbers, missing))
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    owner = place[np.concatenate(owners)]
    coded = pa.chunked_array(chunks, pa.large_binary()).combine_chunks().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.bincount(owner, minlength=len(order)).astype("<i8")
    cells, tfs = np.unique(codes * len(order) + owner, return_counts=True)
    code, doc = np.divmod(cells, len(order))
    ends = np.append(np.flatnonzero(np.diff(code)) + 1, len(code)) if len(code) else np.zeros(0, np.int64)
    names = [f.split()[0] for f in INDEX_SCHEMA.split(", ")]
    known = numbers[order][: len(order) - int(missing.sum())].astype("<i8")
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([number], pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
            pa.array([known.tobytes()], pa.binary()), pa.array([lengths.tobytes()], pa.binary()),
        ],
        names,
    )
    terms = coded.dictionary.cast(pa.large_string()).cast(pa.string())
    docs, counts = _blobs(doc.astype("<u2"), ends), _blobs(tfs.astype("<u4"), ends)
    for at in range(0, len(terms), 20_000):
        n = min(20_000, len(terms) - at)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, number)), terms.slice(at, n), docs.slice(at, n), counts.slice(at, n),
                pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()),
            ],
            names,
        )


def build_index(df: DataFrame, id: str = "doc_id", text: str = "text", params: SearchParams = SearchParams()) -> Index:
    """Posting lists of all terms of all documents, in a written table."""
    if params.segment_docs > 1 << 16:
        raise ValueError("a segment numbers its documents in 16 bits")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        chunks, owners, ids, size, n = [], [], [], 0, 0
        for batch in batches:
            widths = batch.column(1).cast(pa.large_string()).fill_null("").cast(pa.large_binary())
            ends = np.frombuffer(widths.buffers()[1], np.int64)[widths.offset + 1:widths.offset + 1 + len(widths)]
            begin, base = 0, int(np.frombuffer(widths.buffers()[1], np.int64)[widths.offset])
            while begin < batch.num_rows:
                # as many rows as the segment still takes, at least one
                stop = int(np.searchsorted(ends, base + params.segment_bytes - size, side="right"))
                stop = min(max(stop, begin + 1), begin + params.segment_docs - n, batch.num_rows)
                part = batch.slice(begin, stop - begin)
                terms, owner = terms_of(part.column(1))
                chunks.append(terms)
                owners.append(owner + n)
                ids.append(part.column(0))
                size, n, base, begin = size + int(ends[stop - 1]) - base, n + part.num_rows, int(ends[stop - 1]), stop
                if size >= params.segment_bytes or n >= params.segment_docs:
                    yield from _segment(number, chunks, owners, pa.chunked_array(ids).combine_chunks())
                    number, chunks, owners, ids, size, n = number + 1, [], [], [], 0, 0
        if n:
            yield from _segment(number, chunks, owners, pa.chunked_array(ids).combine_chunks())

    rows = df.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))
    lists = write_table(rows.mapInArrow(cut, INDEX_SCHEMA), "postings")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                lengths = np.frombuffer(blob, "<i8")
                yield pa.RecordBatch.from_pydict({"n": [int((lengths > 0).sum())], "terms": [int(lengths.sum())]})

    sizes = lists.filter("term is null").select("lengths").mapInArrow(measure, "n bigint, terms bigint")
    total = sizes.agg(F.sum("n"), F.sum("terms")).first()
    return Index(lists, total[0] or 0, total[1] or 0)


# --- impacts and bounds -------------------------------------------------------------

def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def norms(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A document's m."""
    if len(lengths) and 50 * int(lengths.max()) * n_docs >= 1 << 63:
        return np.array([50 + 50 * n * n_docs // n_terms for n in lengths.tolist()], np.int64)
    return 50 + (50 * lengths * n_docs) // n_terms


def impacts(w: int, tfs: np.ndarray, m: np.ndarray) -> np.ndarray:
    return w * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m))


def paired(terms: Sequence[int], weights: Sequence[int], reach: int) -> list[tuple[int, int]]:
    """Pairs of an item's terms that follow each other by weight, within `reach`."""
    order = sorted(terms, key=lambda t: (-weights[t], t))
    return [(min(t, u), max(t, u)) for i, t in enumerate(order) for u in order[i + 1:i + 1 + reach]]


def prefix_bounds(
    order: Sequence[int], best: dict[int, int], partners: dict[int, list[int]], joint: dict[tuple[int, int], int]
) -> list[int]:
    """The most that the first 0, 1, 2, ... terms of `order` can add up to in one document.

    Each term joins the free earlier partner that saves most. A pair without joint maximum has no
    document in common. Without partners these are sums of maxima.
    """
    bounds, free = [0], set()
    for t in order:
        saved, mate = 0, None
        for u in partners.get(t, ()):
            if u in free:
                save = best[t] + best[u] - max(best[t], best[u], joint.get((min(t, u), max(t, u)), 0))
                if save > saved:
                    saved, mate = save, u
        bounds.append(bounds[-1] + best[t] - saved)
        if mate is None:
            free.add(t)
        else:
            free.discard(mate)
    return bounds


Lists = dict[int, tuple[np.ndarray, np.ndarray]]


def probe(docs: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted document, 0 where the list lacks it."""
    at = np.minimum(np.searchsorted(docs, wanted), len(docs) - 1)
    return np.where(docs[at] == wanted, values[at], 0)


def best_of(
    order: Sequence[int], bounds: Sequence[int], lists: Lists, n_docs: int, limit: int, top: int
) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents and scores of a segment's `top` best that reach `limit`, and the postings read."""
    limit = max(limit, 1)
    if bounds[-1] < limit:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    weak = bisect_left(bounds, limit) - 1  # so many weakest terms stay under the limit together
    sums, read = np.zeros(n_docs, np.int64), 0
    for t in order[weak:]:
        docs, values = lists[t]
        sums[docs] += values
        read += len(docs)
    alive = np.flatnonzero((sums > 0) & (sums + bounds[weak] >= limit))
    scores = sums[alive]
    for i in range(weak, -1, -1):
        if len(scores) > top:
            limit = max(limit, int(np.partition(scores, -top)[-top]))
        stay = scores + bounds[i] >= limit
        alive, scores = alive[stay], scores[stay]
        if i and len(alive):
            docs, values = lists[order[i - 1]]
            scores = scores + probe(docs, values, alive)
            read += min(len(alive), len(docs))
    chosen = np.lexsort((alive, -scores))[:top]
    return alive[chosen], scores[chosen], read


@dataclass(frozen=True)
class Block:
    """The items of one block, as a task gets them: numbers only."""

    items: list[list[int]]  # terms of each item that weigh more than 0
    weights: list[int]
    pairs: dict[int, list[int]]  # all pairs (a, b), a < b, by a
    own_pairs: list[list[tuple[int, int]]]
    n_docs: int
    n_terms: int

    def partners(self, item: int) -> dict[int, list[int]]:
        found: dict[int, list[int]] = {}
        for a, b in self.own_pairs[item]:
            found.setdefault(a, []).append(b)
            found.setdefault(b, []).append(a)
        return found


def _make_lists(block: Block, params: SearchParams):
    """Impacts, pair lists and seeds of one segment."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        segment, lengths, ids, lists = table["segment"][0].as_py(), None, b"", {}
        for no, docs, tfs, own, n in zip(*(table[c].to_pylist() for c in ("no", "docs", "tfs", "ids", "lengths"))):
            if no is None:
                ids, lengths = own, np.frombuffer(n, "<i8")
            elif block.weights[no] > 0:
                lists[no] = np.frombuffer(docs, "<u2").astype(np.int64), np.frombuffer(tfs, "<u4").astype(np.int64)
        m = norms(lengths, block.n_docs, block.n_terms)
        for no, (docs, tfs) in lists.items():
            lists[no] = docs, impacts(block.weights[no], tfs, m[docs])
        best = {no: int(values.max()) for no, (_, values) in lists.items()}
        rows = [(segment, -1, None, ids, None, len(lengths), None, None)]
        rows += [(segment, no, None, docs.astype("<u2").tobytes(), values.astype("<i8").tobytes(), best[no], None, None) for no, (docs, values) in lists.items()]
        joint: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
        dense = np.zeros(len(lengths), np.int64)
        for a, others in block.pairs.items():
            if a not in lists:
                continue
            docs, values = lists[a]
            dense[docs] = values
            for b in others:
                if b in lists:
                    both = dense[lists[b][0]]
                    hit = both > 0
                    if hit.any():
                        joint[a, b] = int((both + lists[b][1])[hit].max()), lists[b][0][hit]
            dense[docs] = 0
        rows += [(segment, a, b, docs.astype("<u2").tobytes(), None, most, None, None) for (a, b), (most, docs) in joint.items()]
        for item, terms in enumerate(block.items):
            strong = sorted((p for p in block.own_pairs[item] if p in joint), key=lambda p: -joint[p][0])[:params.seed_lists]
            seeds = []
            for a, b in strong:
                docs = joint[a, b][1]
                both = probe(*lists[a], docs) + probe(*lists[b], docs)
                seeds.append(docs[np.argsort(-both, kind="stable")[:2 * params.top]])
            if seeds:
                seeds = np.unique(np.concatenate(seeds))
                scores = sum(probe(*lists[t], seeds) for t in terms if t in lists)
                rows += [(segment, -2, None, None, None, None, item, s) for s in np.sort(scores)[::-1][:params.top].tolist()]
        schema = pa.schema([
            ("segment", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("docs", pa.binary()), ("impacts", pa.binary()),
            ("best", pa.int64()), ("item", pa.int32()), ("score", pa.int64()),
        ])
        for at in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows[at:at + 10_000]), schema)], schema=schema
            )

    return make


def _search_segment(block: Block, limits: list[int], params: SearchParams):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        ids, n_docs, lists, best, joint = np.zeros(0, np.int64), 0, {}, {}, {}
        for a, b, docs, values, most in zip(*(table[c].to_pylist() for c in ("a", "b", "docs", "impacts", "best"))):
            if a == -1:
                ids, n_docs = np.frombuffer(docs, "<i8"), most
            elif b is None:
                lists[a], best[a] = (np.frombuffer(docs, "<u2").astype(np.int64), np.frombuffer(values, "<i8")), most
            else:
                joint[a, b] = most
        for item, terms in enumerate(block.items):
            order = sorted((t for t in terms if t in lists), key=lambda t: (best[t], t))
            bounds = prefix_bounds(order, best, block.partners(item), joint)
            docs, scores, read = best_of(order, bounds, lists, n_docs, limits[item], params.top)
            named = docs < len(ids)
            owner = np.zeros(len(docs), np.int64)
            owner[named] = ids[docs[named]]
            whole = sum(len(lists[t][0]) for t in order)
            n = len(docs)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, item, np.int32)), pa.array(scores), pa.array(owner), pa.array(named),
                    pa.array(np.full(n, whole)), pa.array(np.full(n, read)),
                ],
                [f.split()[0] for f in FOUND_SCHEMA.split(", ")],
            )

    return search


# --- search -------------------------------------------------------------------------

def _limits(seeds: DataFrame, n_items: int, top: int) -> list[int]:
    """Per item the `top`-th best score of a seed, 1 where there are fewer."""
    best = Window.partitionBy("item").orderBy(F.col("score").desc())
    kth = seeds.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).filter(F.col("rank") == top)
    limits = [1] * n_items
    for row in kth.select("item", "score").collect():  # one number an item
        limits[row["item"]] = row["score"]
    return limits


def _search_block(index: Index, items: list[list[str]], params: SearchParams) -> DataFrame:
    """`(item, rank, doc_id, score)` for one block, items by their place in it."""
    spark = index.lists.sparkSession
    vocabulary = {term: no for no, term in enumerate(sorted({t for terms in items for t in terms}))}
    wanted = spark.createDataFrame(list(vocabulary.items()), "term string, no int")
    if len(vocabulary) <= 2 * params.block_terms:  # a block's terms, so a known size
        wanted = F.broadcast(wanted)
    matched = write_table(
        index.lists.filter("term is not null").join(wanted, "term").select(
            "segment", "no", "docs", "tfs", F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("lengths")
        ).unionByName(index.lists.filter("term is null").select("segment", F.lit(None).cast("int").alias("no"), "docs", "tfs", "ids", "lengths")),
        "matched-postings",
    )
    weights = [0] * len(vocabulary)
    frequency = matched.filter("no is not null").groupBy("no").agg(F.sum(F.octet_length("docs") / 2).cast("bigint").alias("df"))
    for row in frequency.collect():  # a number per term of the block
        weights[row["no"]] = weight(index.n_docs, row["df"])
    numbers = [[vocabulary[t] for t in terms if weights[vocabulary[t]] > 0] for terms in items]
    own_pairs = [paired(terms, weights, params.reach) for terms in numbers]
    pairs: dict[int, list[int]] = {}
    for a, b in sorted({p for own in own_pairs for p in own}):
        pairs.setdefault(a, []).append(b)
    block = Block(numbers, weights, pairs, own_pairs, index.n_docs, index.n_terms)
    lists = write_table(matched.groupBy("segment").applyInArrow(_make_lists(block, params), LISTS_SCHEMA), "pair-lists")
    limits = _limits(lists.filter("a = -2").select("item", "score"), len(items), params.top)
    # Of a pair only its joint maximum is needed now.
    read = lists.filter("a > -2").select(
        "segment", "a", "b", F.when(F.col("b").isNull(), F.col("docs")).alias("docs"), "impacts", "best"
    )
    found = read.groupBy("segment").applyInArrow(_search_segment(block, limits, params), FOUND_SCHEMA)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.select("item", "score", F.when(F.col("has_id"), F.col("doc_id")).alias("doc_id")).withColumn(
        "rank", F.row_number().over(order)
    ).filter(F.col("rank") <= params.top)


def search(index: Index, items: DataFrame, id: str = "item_id", text: str = "text", params: SearchParams = SearchParams()) -> DataFrame:
    """`(item_id, rank, doc_id, score)` of every item's best documents with a score above 0."""
    spark: SparkSession = items.sparkSession
    kind = items.schema[id].dataType
    terms = F.array_distinct(F.regexp_extract_all(lower_ascii(F.col(f"`{text}`")), F.lit(TERM), 1))
    rows = write_table(
        items.select(F.col(f"`{id}`").alias("id"), F.coalesce(terms, F.array().cast("array<string>")).alias("terms"))
        .withColumn("no", F.monotonically_increasing_id()),
        "items",
    )
    fixed = max(1, params.block_terms // params.block_items)
    placed, total = running_starts(
        rows.select("no", (F.size("terms") + fixed).cast("bigint").alias("cost")), ["no"], "cost", "start", "item-blocks"
    )
    placed = rows.join(placed.select("no", F.expr(f"start div {params.block_terms}").alias("block")), "no")
    schema = T.StructType([
        T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()),
        T.StructField("score", T.LongType()),
    ])
    result = spark.createDataFrame([], schema)
    if not index.n_docs:
        return result
    for number in range(total // params.block_terms + 1):
        own = placed.filter(F.col("block") == number).select("id", "terms").collect()  # one block of items
        if not any(row["terms"] for row in own):
            continue
        found = _search_block(index, [row["terms"] for row in own], params)
        names = spark.createDataFrame(
            [(row["id"], item) for item, row in enumerate(own)],
            T.StructType([T.StructField("item_id", kind), T.StructField("item", T.IntegerType())]),
        )
        result = result.unionByName(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return result
