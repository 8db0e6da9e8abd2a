"""Merkle manifest of a table, with proofs made per partition of leaves (octopus multiproof).

A row is a leaf: the digest of its fields in order, each `-` if null, else its byte count, `:`
and its value. Leaves of a group (`source`) stand in the order of their ids; every `fanout`
consecutive nodes become one digest until one is left, the subroot; the subroots in the order of
their groups (null first, then bytewise) become the root the same way. Digests enter the next
one as lowercase hex.

Leaves are range-partitioned by group and id, so a partition holds a run of leaves per group. The
node coordinates `(tree, level, idx)` that its leaves cannot supply are few: at most `fanout - 1`
on either side of its run, per level, and none for groups that lie in it whole. They are worked
out from where the runs start and end, their digests are fetched by one join, and the partition
then derives each inner node once for all its leaves and cuts every leaf's own proof from them.
Nothing of the size of the table, nor one row per group, goes through the driver.

Null text is a null field; null groups form one group, null ids come first in theirs. Rows with
equal ids are ordered by their digest; exact copies are leaves of their own with equal results but
for their place. Very long texts are hashed where they are read and not moved. An empty table has
no leaves and no root. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from tacitrec.llm.common import running_starts
from tacitrec.tables import write_table

FANOUT = 16
TOP = -1  # the tree over the subroots
LEAVES_A_TASK = 50_000


def field(value: Column) -> Column:
    """One field of a leaf: `-` for null, else the byte count, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(value) for value in values]), 256)


@dataclass(frozen=True)
class Manifest:
    """Leaves, where their runs lie, and the inner nodes; all are written tables.

    `leaves` is `(part, tree, pos, id, <group>, leaf, shown)`; `shown` is the leaf that a proof is
    to be checked for. `spans` is one row per partition and tree, `nodes` is
    `(tree, level, idx, digest)` of all levels that a proof can need.
    """

    leaves: DataFrame
    spans: DataFrame
    nodes: DataFrame
    subroots: DataFrame  # (tree, digest)
    n_trees: int
    root: str | None


def _parents(level: DataFrame, fanout: int) -> DataFrame:
    """The level above `(tree, idx, size, digest)`, of trees that have more than one node left."""
    runs = level.groupBy("tree", F.expr(f"idx div {fanout}").alias("idx")).agg(
        F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("run")
    )
    return runs.select(
        "tree", "idx", F.expr(f"(size + {fanout - 1}) div {fanout}").alias("size"),
        F.sha2(F.concat_ws("", F.col("run.digest")), 256).alias("digest"),
    )


def _climb(bottom: DataFrame, largest: int, fanout: int, name: str) -> tuple[DataFrame, DataFrame]:
    """All levels above `bottom` `(tree, idx, size, digest)`, and the last node of each tree."""
    columns = ["tree", "idx", "size", "digest"]
    level, inner, tops, height = bottom, [], [], 0
    while True:
        tops.append(level.filter("size = 1").select("tree", "digest"))
        if largest <= 1:
            break
        height += 1
        level = write_table(_parents(level.filter("size > 1"), fanout).select(*columns), f"{name}-{height}")
        inner.append(level.select("tree", F.lit(height).alias("level"), "idx", "digest"))
        largest = -(-largest // fanout)
    nodes = bottom.select("tree", F.lit(0).alias("level"), "idx", "digest")
    for more in inner:
        nodes = nodes.unionByName(more)
    found = tops[0]
    for more in tops[1:]:
        found = found.unionByName(more)
    return nodes, found


def build(
    df: DataFrame, fields: Sequence[str], group: str = "source", id: str = "doc_id", shown: dict[str, Column] | None = None,
    fanout: int = FANOUT, leaves_a_task: int = LEAVES_A_TASK,
) -> Manifest:
    """The manifest of `df`. `shown` maps fields to what a checker is shown in their place."""
    given = [F.col(f"`{name}`") for name in fields]
    other = [(shown or {}).get(name, F.col(f"`{name}`")) for name in fields]
    rows = write_table(
        df.select(
            F.col(f"`{group}`").alias("group"), F.col(f"`{id}`").alias("id"),
            leaf_digest(*given).alias("leaf"), leaf_digest(*other).alias("shown"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "leaf-digests",
    )
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // leaves_a_task))
    low = F.lit((1 << 33) - 1)  # monotonically_increasing_id has the row of the partition there
    order = ["group", "id", "leaf", "row"]
    placed = write_table(
        rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select(
            "group", "id", "leaf", "shown", F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().bitwiseAND(low).alias("row"),
        ),
        "leaf-order",
    )
    before = Window.partitionBy("group").orderBy("part")  # a row per partition and group, not per leaf
    spans = write_table(
        placed.groupBy("group", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
        .withColumn("lo", F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("size", F.sum("n").over(Window.partitionBy("group"))),
        "leaf-spans",
    )
    groups, n_trees = running_starts(
        spans.filter("lo = 0").select("group", F.lit(1).cast("bigint").alias("one")), ["group"], "one", "tree", "trees"
    )
    spans = write_table(
        spans.join(groups.select(F.col("group").alias("named"), "tree"), F.col("group").eqNullSafe(F.col("named")))
        .select("tree", "group", "part", "first", "n", "lo", "size"),
        "leaf-runs",
    )
    at = spans.select("tree", F.col("group").alias("named"), F.col("part").alias("in_part"), "first", "lo", "size", "n")
    leaves = write_table(
        placed.join(at, (F.col("part") == F.col("in_part")) & F.col("group").eqNullSafe(F.col("named")))
        .withColumn("local", F.col("row") - F.col("first"))
        .select(
            "part", "tree", (F.col("lo") + F.col("local")).alias("pos"), "id", "group", "leaf", "shown", "size",
            (F.least("local", F.col("n") - 1 - F.col("local")) < fanout - 1).alias("edge"),
        ),
        "leaves",
    )
    largest = spans.agg(F.max("size")).first()[0] or 0
    bottom = leaves.select("tree", F.col("pos").alias("idx"), "size", F.col("leaf").alias("digest"))
    nodes, subroots = _climb(bottom, largest, fanout, "tree-level")
    subroots = write_table(subroots, "subroots")
    crown = subroots.select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("idx"), F.lit(n_trees).alias("size"), "digest")
    top_nodes, root = _climb(crown, n_trees, fanout, "top-level")
    root = root.first()
    # Other partitions lack only leaves that lie near the end of a run.
    edges = leaves.filter("edge").select("tree", F.lit(0).alias("level"), F.col("pos").alias("idx"), F.col("leaf").alias("digest"))
    nodes = edges.unionByName(nodes.filter("level > 0")).unionByName(top_nodes)
    return Manifest(leaves, spans, nodes, subroots, n_trees, root["digest"] if root else None)


def missing_nodes(m: Manifest, fanout: int = FANOUT) -> DataFrame:
    """`(part, tree, level, idx)`: the fewest nodes from which a partition can prove its leaves."""
    runs = m.spans.select("part", "tree", "lo", (F.col("lo") + F.col("n") - 1).alias("hi"), "size")
    crown = m.spans.groupBy("part").agg(F.min("tree").alias("lo"), F.max("tree").alias("hi")).select(
        "part", F.lit(TOP).cast("bigint").alias("tree"), "lo", "hi", F.lit(m.n_trees).cast("bigint").alias("size")
    )
    highest = 0
    while fanout ** (highest + 1) < 1 << 62:
        highest += 1
    levels = F.sequence(F.lit(0), F.lit(highest))
    width = F.element_at(F.array(*[F.lit(fanout**level) for level in range(highest + 1)]), F.col("level") + 1)
    # Of the level: first and last node over the leaves, and how many nodes there are.
    runs = runs.unionByName(crown).select("*", F.explode(levels).alias("level")).withColumn("width", width).select(
        "part", "tree", "level", *[F.expr(f"{name} div width").alias(name) for name in ("lo", "hi")],
        F.expr("(size + width - 1) div width").alias("nodes"),
    ).filter("nodes > 1")
    ends = F.least(F.expr(f"(hi div {fanout} + 1) * {fanout}"), F.col("nodes"))
    left = F.expr(f"case when lo % {fanout} > 0 then sequence(lo - lo % {fanout}, lo - 1) else array() end")
    right = F.when(ends > F.col("hi") + 1, F.sequence(F.col("hi") + 1, ends - 1)).otherwise(F.array().cast("array<bigint>"))
    return runs.select("part", "tree", "level", F.explode(F.concat(left, right)).alias("idx"))


class _Tree:
    """Runs of one tree over a partition's leaves, level by level, complete with fetched nodes."""

    def __init__(self, first: int, digests: list[str], size: int, fetched: dict[tuple[int, int], str], fanout: int):
        self.fanout, self.runs = fanout, []  # per level: number of the first run, and the runs
        level, lo, now = 0, first, digests
        while size > 1:
            start, stop = lo // fanout * fanout, min((lo + len(now) - 1) // fanout * fanout + fanout, size)
            whole = [
                *[fetched[level, i] for i in range(start, lo)], *now, *[fetched[level, i] for i in range(lo + len(now), stop)]
            ]
            runs = [whole[i:i + fanout] for i in range(0, len(whole), fanout)]
            self.runs.append((start // fanout, runs))
            now = [_digest("".join(run)) for run in runs]
            level, lo, size = level + 1, start // fanout, -(-size // fanout)
        self.top = now[0]
        self._above: dict[tuple[int, int], tuple[bytes, list[int], list[int]]] = {}

    def path(self, place: int, level: int = 0) -> tuple[bytes, list[int], list[int]]:
        """Siblings from `level` up, how many there are a level, and the node's own place among them."""
        if level == len(self.runs):
            return b"", [], []
        run_no, at = divmod(place, self.fanout)
        first, runs = self.runs[level]
        run = runs[run_no - first]
        key = (level + 1, run_no)
        if key not in self._above:
            self._above[key] = self.path(run_no, level + 1)
        siblings, widths, places = self._above[key]
        own = bytes.fromhex("".join(run[:at] + run[at + 1:]))
        return own + siblings, [len(run) - 1, *widths], [at, *places]


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fold(leaf: str, proof: bytes, widths: Sequence[int], places: Sequence[int]) -> str:
    """The root that `leaf` gives with the siblings of its proof."""
    digits, start = proof.hex(), 0
    for width, place in zip(widths, places):
        cut, stop = start + 64 * place, start + 64 * width
        leaf = _digest(digits[start:cut] + leaf + digits[cut:stop])
        start = stop
    return leaf


def prove(m: Manifest, fanout: int = FANOUT) -> DataFrame:
    """One row per leaf: `(id, group, leaf, subroot, root, proof, widths, places, folded_root)`.

    `proof` holds the siblings' digests, 32 bytes each, from the leaf's level to the root, `widths`
    their number per level and `places` the node's own place among them: what `fold` takes.
    `folded_root` is what the leaf shown to the checker gives with them. It is read off the derived
    nodes where that leaf is the manifest's own.
    """
    kind, group = m.leaves.schema["id"].dataType, m.leaves.schema["group"].dataType
    columns = [
        T.StructField("id", kind), T.StructField("group", group), *[T.StructField(n, T.StringType()) for n in ("leaf", "subroot", "root")],
        T.StructField("proof", T.BinaryType()), T.StructField("widths", T.ArrayType(T.IntegerType())),
        T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("folded_root", T.StringType()),
    ]
    schema = T.StructType(columns)
    fetched = missing_nodes(m, fanout).join(m.nodes, ["tree", "level", "idx"])
    nothing = F.lit(None)
    rows = m.leaves.select("part", F.lit(-1).alias("level"), "tree", F.col("pos").alias("idx"), "id", "group", F.col("leaf").alias("digest"), "shown", "size")
    helpers = fetched.select(
        "part", "level", "tree", "idx", nothing.cast(kind).alias("id"), nothing.cast(group).alias("group"), "digest",
        nothing.cast("string").alias("shown"), nothing.cast("bigint").alias("size"),
    )
    n_trees, manifest_root = m.n_trees, m.root

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by([("tree", "ascending"), ("idx", "ascending")])
        level, tree, idx, digest, shown, size = (
            table[name].to_pylist() for name in ("level", "tree", "idx", "digest", "shown", "size")
        )
        help_of: dict[int, dict[tuple[int, int], str]] = defaultdict(dict)
        leaves_of: dict[int, list[int]] = defaultdict(list)  # rows by tree, in order
        for row, at in enumerate(level):
            if at < 0:
                leaves_of[tree[row]].append(row)
            else:
                help_of[tree[row]][at, idx[row]] = digest[row]
        trees = {
            no: _Tree(idx[own[0]], [digest[row] for row in own], size[own[0]], help_of[no], fanout)
            for no, own in leaves_of.items()
        }
        numbers = sorted(trees)
        crown = _Tree(numbers[0], [trees[no].top for no in numbers], n_trees, help_of[TOP], fanout)
        for no in numbers:
            upper, upper_widths, upper_places = crown.path(no)
            for begin in range(0, len(leaves_of[no]), 500):
                own = leaves_of[no][begin:begin + 500]
                proofs, widths, places, folded = [], [], [], []
                for row in own:
                    siblings, wide, spots = trees[no].path(idx[row])
                    proofs.append(siblings + upper)
                    widths.append(wide + upper_widths)
                    places.append(spots + upper_places)
                    same = shown[row] == digest[row]
                    folded.append(crown.top if same else fold(shown[row], proofs[-1], widths[-1], places[-1]))
                taken = table.take(pa.array(own))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[taken[name].combine_chunks() for name in ("id", "group", "digest")],
                        pa.array([trees[no].top] * len(own)), pa.array([manifest_root] * len(own)), pa.array(proofs, pa.binary()),
                        pa.array(widths, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.int32())), pa.array(folded, pa.string()),
                    ],
                    schema.names,
                )

    return rows.unionByName(helpers).groupBy("part").applyInArrow(partition, schema)
