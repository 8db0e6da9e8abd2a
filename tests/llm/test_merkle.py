"""Merkle manifest: trees and proofs against plain code."""

import hashlib

import pytest
from llm.conftest import ODD_TEXTS
from pyspark.sql import functions as F

from tacitrec.llm.merkle import build, fold, missing_nodes, prove

FIELDS = ("doc_id", "source", "text")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves, fanout):
    """All levels, and per leaf its siblings upwards."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([digest("".join(low[i:i + fanout])) for i in range(0, len(low), fanout)])
    ways = []
    for at in range(len(leaves)):
        way = []
        for level in levels[:-1]:
            start = at // fanout * fanout
            way += [d for i, d in enumerate(level[start:start + fanout], start) if i != at]
            at //= fanout
        ways.append(way)
    return levels[-1][0], ways


def plain_proofs(rows, fanout):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0], plain_leaf(row)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops, ways = [], []
    for group in order:
        own = sorted(groups[group], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        top, way = plain_tree([leaf for _, leaf in own], fanout)
        tops.append(top)
        ways.append([(doc, leaf, siblings) for (doc, leaf), siblings in zip(own, way)])
    root, above = plain_tree(tops, fanout)
    return sorted(
        (str(doc), str(group), leaf, top, root, "".join(siblings + above[no]))
        for no, (group, top) in enumerate(zip(order, tops)) for doc, leaf, siblings in ways[no]
    )


def found_proofs(rows):
    return sorted((str(r["id"]), str(r["group"]), r["leaf"], r["subroot"], r["root"], bytes(r["proof"]).hex()) for r in rows)


def sample_rows():
    texts = [*ODD_TEXTS, *[f"text {i}" for i in range(120)]]
    sources = [["hot", "hot", None, "é", "Z", f"s{i}"][i % 6] if i < 60 else "hot" for i in range(len(texts))]
    return [(None if i % 40 == 7 else i // 2, sources[i], text) for i, text in enumerate(texts)] + [(5, "hot", "copy")] * 9


@pytest.mark.parametrize("fanout, leaves_a_task", [(2, 10), (3, 40), (16, 7), (16, 50_000)])
def test_proofs_are_those_of_plain_code(spark, fanout, leaves_a_task):
    rows = sample_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    docs = docs.withColumn("part", F.lit("x")).withColumn("tree", F.lit(1)).withColumn("leaf", F.lit("y")).repartition(3)
    found = prove(build(docs, FIELDS, fanout=fanout, leaves_a_task=leaves_a_task), fanout).collect()
    assert found_proofs(found) == plain_proofs(rows, fanout)
    for r in found:
        assert r["folded_root"] == r["root"] == fold(r["leaf"], bytes(r["proof"]), r["widths"], r["places"])


def test_partitions_fetch_few_nodes(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one").alias("source"), F.lit("t").alias("text"))
    manifest = build(docs, FIELDS, fanout=4, leaves_a_task=100)
    per_part = missing_nodes(manifest, 4).groupBy("part", "level").count().collect()
    assert manifest.leaves.select("part").distinct().count() > 20
    assert max(r["count"] for r in per_part) <= 2 * 3  # a level lacks less than a run on either side


def test_tampering_shows(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", f"Text {i}") for i in range(50)], "doc_id bigint, source string, text string")
    shown = F.when(F.col("doc_id") % 7 == 0, F.lower("text")).otherwise(F.col("text"))
    rows = prove(build(docs, FIELDS, shown={"text": shown})).collect()
    assert {r["id"] for r in rows if r["folded_root"] != r["root"]} == set(range(0, 50, 7))
    assert len({r["folded_root"] for r in rows}) == 1 + len(range(0, 50, 7))


def test_one_leaf_and_none(spark):
    docs = spark.createDataFrame([(1, None, None)], "doc_id bigint, source string, text string")
    row = prove(build(docs, FIELDS)).first()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] == digest("1:1--")
    assert bytes(row["proof"]) == b"" and row["widths"] == []
    empty = build(docs.limit(0), FIELDS)
    assert empty.root is None and prove(empty).count() == 0
