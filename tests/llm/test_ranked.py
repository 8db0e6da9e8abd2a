"""Ranked search: results against plain scoring, bounds against what they bound."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import ODD_TEXTS
from pyspark.sql import functions as F

from tacitrec.llm.ranked import (
    SearchParams,
    best_of,
    build_index,
    paired,
    prefix_bounds,
    search,
    terms_of,
)


def plain_terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain_search(docs, items, top):
    counts = [Counter(plain_terms(text)) for _, text in docs]
    lengths = [sum(c.values()) for c in counts]
    n_docs, words = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(term for c in counts for term in c)
    result = []
    for item, text in items:
        scores = []
        for (doc, _), own, n in zip(docs, counts, lengths):
            score = 0
            for term in set(plain_terms(text)) & set(own):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                m = 50 + 50 * n * n_docs // words
                score += w * (1_000_000_000 * own[term] // (1000 * own[term] + 20 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        for rank, (score, missing, doc) in enumerate(sorted(scores)[:top], 1):
            result.append((str(item), rank, None if missing else doc, -score))
    return sorted(result, key=str)


def tables(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)] + ["Été", "日本", "x1", "THE"]
    share = 1 / np.arange(1, len(words) + 1)
    texts = [*ODD_TEXTS, *[" ".join(rng.choice(words, rng.integers(1, 60), p=share / share.sum())) for _ in range(150)]]
    texts += [texts[40]] * 30 + ["the"] * 9 + ["The-the_THE,日本é"] * 4
    docs = [(None if i % 37 == 5 else 1000 - i, t) for i, t in enumerate(texts)]
    items = [(1, "the w3 w7 w20 w39 Été"), (1, texts[45]), (2, None), (3, ""), (None, "日本 unknown"), (5, "only unknown"), (6, texts[60] + " " + texts[61])]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("term", F.lit("x")).withColumn("segment", F.lit(1))
    asked = spark.createDataFrame(items, "item_id bigint, text string").withColumn("item", F.lit("x")).withColumn("no", F.lit("x"))
    return docs, items, frame.repartition(3), asked


@pytest.mark.parametrize("params", [
    SearchParams(top=5, segment_docs=16), SearchParams(top=3, segment_bytes=300, reach=4, seed_lists=1),
    SearchParams(top=50, segment_docs=40, block_items=2, block_terms=12), SearchParams(),
], ids=["small segments", "few bytes", "many blocks", "as in production"])
def test_results_are_those_of_plain_scoring(spark, params):
    docs, items, frame, asked = tables(spark)
    found = search(build_index(frame, params=params), asked, params=params).collect()
    assert sorted(((str(r["item_id"]), r["rank"], r["doc_id"], r["score"]) for r in found), key=str) == plain_search(docs, items, params.top)


def test_empty_tables(spark):
    _, _, frame, asked = tables(spark)
    none = build_index(frame.limit(0))
    assert none.n_docs == 0 and search(none, asked).count() == 0
    assert search(build_index(frame.filter("text is null")), asked).count() == 0
    assert search(build_index(frame), asked.limit(0)).count() == 0


def test_terms_end_with_their_texts():
    texts = pa.array(["ab", "Cd", None, "", "x-y", "é", "tail "])
    for array in (texts, texts.slice(1), texts.slice(3, 2), texts.slice(0, 0)):
        terms, owner = terms_of(array)
        expected = [(i, t) for i, text in enumerate(array.to_pylist()) for t in plain_terms(text)]
        assert [(int(o), t.as_py().decode()) for o, t in zip(owner, terms)] == expected


def test_a_very_long_text(spark):
    docs = [(1, "word " * 400_000 + "needle " + "q" * 300_000), (2, "needle"), (3, "hay")]
    items = [(0, "needle word")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = search(build_index(frame, params=SearchParams(segment_bytes=1000)), spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted((str(r["item_id"]), r["rank"], r["doc_id"], r["score"]) for r in rows.collect()) == plain_search(docs, items, 50)


cells = st.lists(st.lists(st.integers(0, 9), min_size=12, max_size=12), min_size=1, max_size=8)


def as_lists(rows):
    lists = {}
    for t, row in enumerate(rows):
        values = np.array(row)
        if values.any():
            lists[t] = np.flatnonzero(values), values[values > 0]
    return lists


@settings(max_examples=200, deadline=None)
@given(cells, st.integers(1, 4), st.integers(0, 40), st.integers(1, 6))
def test_bounds_hold_and_results_are_exact(rows, reach, limit, top):
    lists = as_lists(rows)
    best = {t: int(v.max()) for t, (_, v) in lists.items()}
    pairs = paired(list(lists), [len(rows) - t for t in range(len(rows))], reach)
    matrix, joint, partners = np.array(rows), {}, {}
    for a, b in pairs:
        both = (matrix[a] > 0) & (matrix[b] > 0)
        if both.any():
            joint[a, b] = int((matrix[a] + matrix[b])[both].max())
        partners.setdefault(a, []).append(b)
        partners.setdefault(b, []).append(a)
    order = sorted(lists, key=lambda t: (best[t], t))
    bounds, sums = prefix_bounds(order, best, partners, joint), prefix_bounds(order, best, {}, {})
    for i in range(len(order) + 1):
        assert (matrix[order[:i]].sum(axis=0).max() if i else 0) <= bounds[i] <= sums[i]
    total = matrix.sum(axis=0)
    kth = sorted(total, reverse=True)[top - 1]
    limit = min(limit, int(kth))  # as given by seeds, the limit is never above the top-th score
    docs, scores, _ = best_of(order, bounds, lists, 12, limit, top)
    expected = sorted(((-s, d) for d, s in enumerate(total.tolist()) if s > 0))[:top]
    assert [(-s, d) for d, s in zip(docs.tolist(), scores.tolist())] == expected


def test_pairs_skip_more_than_single_maxima():
    """Two strong terms that never meet: only their pair shows that neither list needs opening."""
    n = 1000
    lists = {0: (np.arange(0, n, 2), np.full(n // 2, 10)), 1: (np.arange(1, n, 2), np.full(n // 2, 10)), 2: (np.array([3]), np.array([15]))}
    best = {0: 10, 1: 10, 2: 15}
    order = [0, 1, 2]
    single, tight = prefix_bounds(order, best, {}, {}), prefix_bounds(order, best, {0: [1], 1: [0]}, {})
    assert single == [0, 10, 20, 35] and tight == [0, 10, 10, 25]
    slow, fast = (best_of(order, b, lists, n, 16, 1) for b in (single, tight))
    assert slow[0].tolist() == fast[0].tolist() == [3] and slow[1].tolist() == fast[1].tolist() == [25]
    assert fast[2] < 10 < 500 < slow[2]
