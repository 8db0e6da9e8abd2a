"""Training: alternating half-steps over cached blocks of observed pairs.

The state of a side is a written table `(idx, c, vec, home, blocks)`: `c` is the weight of the
entity in the Gram matrix (1 for users), `home` the block that updates it, `blocks` those of the
other side that need its vector, packed. A half-step is one job: it sends each vector once to each block
that needs it and each old vector to its home, many in a row, and sorts these rows between the cached tiles of the
block, range by range. The task streams through that order. It holds the vectors of one range and, where
there is more than one, carries the sums [A | b] of its entities from range to range; neither grows
with the number of pairs. At the end it sweeps, and leaves beside the new vectors what the next
half-step and the loss need: the block's part of the Gram matrix, of the squared norms and of the
loss. Only these, k x k numbers a block, pass through the driver.

Models with the same number of factors can share the half-steps (`JointTrainer`): the vectors of an
entity stand side by side, are sent together and meet the same tiles.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tacitrec.functions.squeeze import squeezed, unsqueezed
from tacitrec.functions.sweep import chunks, normal_sums, pair_loss, sweep_normal
from tacitrec.functions.vectors import from_matrix, packed, starting_vector, to_matrix, unpacked
from tacitrec.operators.blocks import (
    BEFORE_RANGES,
    BLOCK_NAMES,
    BLOCK_SCHEMA,
    HOT_HOME,
    ROUTE,
    ROUTE_TYPE,
    SHARE,
    SOURCE,
    TARGET,
    TILE,
    Blocks,
    Placed,
    Tile,
    lay_out,
    observed_pairs,
    packed_lists,
    place_pairs,
    unpack_routes,
    unpacked_lists,
)
from tacitrec.params import Params
from tacitrec.sources.history import HISTORY_SCHEMA
from tacitrec.tables import drop_table, shuffles_dropped, together, write_table

STATE_SCHEMA = "idx bigint, c binary, vec binary, home int, blocks binary"
STATE_NAMES = ["idx", "c", "vec", "home", "blocks"]
# A block's output: finished entities (equation null), rows of [A | b] of hot ones, and one row
# with the home SIDE whose vec is what `_side` packs.
STEP_SCHEMA = STATE_SCHEMA + ", equation int, sums array<double>"
STEP_NAMES = [*STATE_NAMES, "equation", "sums"]
SIDE = -2
# Bytes of copies of vectors that a task gathers before it sends them.
SENT_BYTES = 1 << 25

# Scores a pair of factor tables `(idx, vec)`, packed: a one-row frame with columns hr and ndcg.
MetricsOf = Callable[[DataFrame, DataFrame], DataFrame]
Factors = tuple[DataFrame, DataFrame]


@dataclass(frozen=True)
class FitResult:
    """Factors `(idx, vec)` of both sides, the history of the epochs and the loss after each."""

    users: DataFrame
    items: DataFrame
    history: DataFrame
    records: list[tuple] = field(repr=False, default_factory=list)
    tables: tuple[DataFrame, ...] = field(repr=False, default=())
    losses: list[float] = field(repr=False, default_factory=list)
    readers: list[int] = field(repr=False, default_factory=lambda: [1])  # open results of these tables

    def close(self) -> None:
        """Give the factor tables back; with the last result that shares them they are deleted."""
        self.readers[0] -= 1
        if not self.readers[0]:
            for table in self.tables:
                drop_table(table)


def initial_factors(spark: SparkSession, side: str, n: int, params: Params) -> DataFrame:
    """Starting vectors `(idx, vec)` of one side, `side` being 'user' or 'item'."""
    return spark.range(n).select(
        F.col("id").alias("idx"), starting_vector(side, "id", params.factors, params.seed).alias("vec")
    )


class Layout:
    """The pairs of a training relation, laid out for the half-steps of both sides.

    It does not depend on the item weights, and on the number of factors and models only in how much a
    task holds, so one layout serves the trainers of all variants. Close it after them.
    """

    def __init__(self, relation: DataFrame, params: Params = Params(), models: int = 1) -> None:
        self._lay_out(write_table(observed_pairs(relation), "training-pairs"), params, models)

    @classmethod
    def of_pairs(cls, pairs: DataFrame, params: Params) -> Layout:
        """The layout of a table that `observed_pairs` gave."""
        layout = cls.__new__(cls)
        layout._lay_out(pairs, params)
        return layout

    def _lay_out(self, pairs: DataFrame, params: Params, models: int = 1) -> None:
        self.spark, self.pairs = pairs.sparkSession, pairs
        sizes = pairs.agg(
            F.count("*").alias("n"), F.max("user_idx").alias("users"), F.max("item_idx").alias("items"),
            F.sum("swrr").alias("squares"),
        ).first()
        self.square_sum = sizes["squares"] or 0.0
        n_users, n_items = (sizes[name] + 1 if sizes["n"] else 0 for name in ("users", "items"))

        def place(dst: str, src: str, n_targets: int, n_sources: int) -> Placed:
            n_blocks = -(-n_targets // params.entities_of_block(models))
            if params.blocks is None:  # as many for every core
                cores = self._cores(sizes["n"])
                n_blocks = max(1, -(-n_blocks // cores)) * cores
            n_blocks = max(params.blocks or 1, n_blocks)
            return place_pairs(
                pairs, dst, src, n_blocks, params.hot_degree, params.entities_of_range(models), n_sources, sizes["n"]
            )

        users, items = together(
            self.spark,
            lambda: place("user_idx", "item_idx", n_users, n_items),
            lambda: place("item_idx", "user_idx", n_items, n_users),
        )
        self.user_blocks, self.item_blocks = together(
            self.spark, lambda: lay_out(users, items.routes()), lambda: lay_out(items, users.routes())
        )

    def _cores(self, n_pairs: int) -> int:
        """As many as there are pairs for."""
        return max(1, min(self.spark.sparkContext.defaultParallelism, -(-n_pairs // 4096)))

    def close(self) -> None:
        """Release the cached blocks and the tables."""
        self.user_blocks.close()
        self.item_blocks.close()
        drop_table(self.pairs)


@dataclass(frozen=True)
class _Side:
    """What a half-step leaves beside the vectors, one entry per model."""

    grams: np.ndarray  # (models, k, k): sum of c v v'
    norms: np.ndarray  # sum of v'v
    observed: np.ndarray | None  # the pairs' part of the loss, from the half-step that made the vectors


class JointTrainer:
    """The layout of one training relation and the current factors of some models.

    The models differ in item weights and starting vectors. Calling `fit` again continues from
    the current factors; n calls with one epoch give the same factors as one call with n epochs.
    Close the trainer when done.
    """

    def __init__(
        self,
        relation: DataFrame | None,
        confidences: Sequence[DataFrame],
        n_users: int,
        n_items: int,
        params: Params = Params(),
        inits: Sequence[Factors | None] | None = None,
        layout: Layout | None = None,
    ) -> None:
        if n_users == 0 or n_items == 0:
            raise ValueError(
                "no users or items left: lower min_interactions or raise sample_fraction"
            )
        self._take(params, len(confidences), n_users, n_items, layout or Layout(relation, params, len(confidences)), 0)
        self._own_layout = layout is None
        starts = [
            init or (
                initial_factors(self.spark, "user", n_users, params),
                initial_factors(self.spark, "item", n_items, params),
            )
            for init in inits or [None] * self.models
        ]
        users = _side_by_side([packed(users) for users, _ in starts]).withColumn(
            "c", F.lit(np.ones(self.models).tobytes())
        )
        items = _side_by_side([packed(items) for _, items in starts])
        weights = _side_by_side([
            packed(c.select(F.col("item_idx").alias("idx"), F.array("c").alias("vec"))) for c in confidences
        ])
        self._start(users, items.join(weights.select("idx", F.col("vec").alias("c")), "idx"))

    def _take(self, params: Params, models: int, n_users: int, n_items: int, layout: Layout, epochs_done: int) -> None:
        self.params, self.models, self.epochs_done = params, models, epochs_done
        self.n_users, self.n_items = n_users, n_items
        self.layout, self.spark, self._own_layout = layout, layout.spark, False
        self.user_blocks, self.item_blocks = layout.user_blocks, layout.item_blocks
        self._handed_out: list[DataFrame] = []  # states whose factors a caller may still read
        self._last: DataFrame | None = None  # the state that the last half-step made

    def _start(self, users: DataFrame, items: DataFrame) -> None:
        """Take up factors `(idx, c, vec)`."""
        self.users, self.items = together(
            self.spark,
            lambda: self._state(users, self.user_blocks, "users"),
            lambda: self._state(items, self.item_blocks, "items"),
        )
        self._user_side, self._item_side = together(
            self.spark, lambda: self._measure_side(self.users), lambda: self._measure_side(self.items)
        )

    @staticmethod
    def _state(vectors: DataFrame, own: Blocks, name: str) -> DataFrame:
        """The written state; the routes come from their table."""
        homed = own.with_home(vectors).join(own.routes, "idx", "left")
        routed = homed.withColumn("blocks", F.coalesce("blocks", F.lit(b"")))
        return write_table(routed.select(*STATE_NAMES), f"{name}-0")

    def user_step(self) -> None:
        """Update all users from the items."""
        new, self._user_side = self._half_step(self.user_blocks, self.items, self._item_side, self.users, "users")
        self.users = self._replace(self.users, new)

    def item_step(self) -> None:
        """Update all items from the users."""
        new, self._item_side = self._half_step(self.item_blocks, self.users, self._user_side, self.items, "items")
        self.items = self._replace(self.items, new)

    def _replace(self, old: DataFrame, new: DataFrame) -> DataFrame:
        if not any(old is table for table in self._handed_out):
            drop_table(old)
        self._last = new
        return new

    def _stream(self, blocks: Blocks, sources: DataFrame, targets: DataFrame) -> DataFrame:
        """All rows of a half-step, each block's in the order in which its task reads them."""
        home = F.col("home")
        vectors = sources.select(F.lit(SOURCE).alias("role"), "idx", "c", "vec", F.lit(HOT_HOME).alias("home"), "blocks").unionByName(
            targets.filter(home != HOT_HOME).select(F.lit(TARGET).alias("role"), "idx", "c", "vec", "home", F.lit(b"").alias("blocks"))
        ).mapInArrow(_send(self.models, self.params.factors, blocks.range_size), BLOCK_SCHEMA)
        if blocks.hot_shares is not None:
            weights = _hot(targets).select("idx", F.col("c").alias("payload"))
            before = F.lit(BEFORE_RANGES).alias("rng")
            vectors = vectors.unionByName(
                blocks.hot_shares.hint("shuffle_merge").join(weights, "idx").select("block", before, F.lit(SHARE).alias("role"), "idx", "payload")
            )
        # Both parts are partitioned by block alike, so the union stays so and tiles are not moved.
        return (
            blocks.tiles.unionByName(vectors.repartition(blocks.n_blocks, "block"))
            .sortWithinPartitions("block", "rng", "role")
            .groupBy("block")
        )

    def _half_step(
        self, blocks: Blocks, sources: DataFrame, source_side: _Side, targets: DataFrame, name: str
    ) -> tuple[DataFrame, _Side]:
        k, reg, models = self.params.factors, self.params.reg, self.models
        grams = source_side.grams
        update = _block_update(k, models, reg, grams, blocks.single_range)
        step = self._stream(blocks, sources, targets).applyInArrow(update, STEP_SCHEMA)
        name = f"{name}-{self.epochs_done + 1}"
        if blocks.hot_shares is None:
            return self._write(step.select(*STATE_NAMES), name)
        stepped = write_table(step, f"{name}-shares")
        done = stepped.filter("equation is null").select(*STATE_NAMES)
        hot = _solve_hot(stepped.filter("equation is not null"), _hot(targets), k, models, reg, grams)
        written = self._write(done.unionByName(hot), name)
        drop_table(stepped)
        return written

    def _write(self, rows: DataFrame, name: str) -> tuple[DataFrame, _Side]:
        """Write the vectors and add up the side rows, in one job."""
        seen = Observation()
        side = F.when(F.col("home") == SIDE, F.col("vec"))
        state = write_table(rows.observe(seen, F.collect_list(side).alias("sides")).filter(F.col("home") != SIDE), name)
        return state, self._sum_sides(seen.get["sides"])

    def _sum_sides(self, parts: Sequence[bytes], observed: bool = True) -> _Side:
        k, models = self.params.factors, self.models
        total = sum((np.frombuffer(part) for part in parts), np.zeros(models * (k * k + 2)))
        grams, norms, seen = np.split(total, [models * k * k, models * (k * k + 1)])
        return _Side(grams.reshape(models, k, k), norms, seen if observed else None)

    def _measure_side(self, state: DataFrame) -> _Side:
        """Gram matrices and norms of factors that no half-step made."""
        k, models = self.params.factors, self.models

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(models * (k * k + 2))
            for batch in batches:
                total += _side(_weights(batch.column("c"), models), to_matrix(batch.column("vec"), k * models), k, np.zeros(models))
            yield pa.RecordBatch.from_pydict({"side": pa.array([total.tobytes()], pa.binary())})

        parts = state.select("c", "vec").mapInArrow(measure, "side binary").collect()  # one row a partition
        return self._sum_sides([row["side"] for row in parts], observed=False)

    def objective(self) -> list[float]:
        """The loss of every model at the current factors.

        Squared errors of the pairs by their weights, squared scores of all other cells by the items'
        weights, and the norms. The cells need no pass over users and items: their sum is the inner
        product of the two Gram matrices. The pairs' part comes from the last half-step; only before
        the first one the blocks are read for it.
        """
        last = self._item_side if self._last is self.items else self._user_side
        observed = last.observed
        if observed is None:
            look = _block_update(self.params.factors, self.models, None, self._item_side.grams, True)
            rows = self._stream(self.user_blocks, self.items, self.users).applyInArrow(look, STEP_SCHEMA)
            parts = rows.filter(F.col("home") == SIDE).select("vec").collect()  # one row a block
            observed = self._sum_sides([row["vec"] for row in parts]).observed
            if self.user_blocks.hot_shares is not None:
                observed = observed + self._hot_loss(rows)
        missing = np.einsum("mfg,mfg->m", self._user_side.grams, self._item_side.grams)
        norms = self._user_side.norms + self._item_side.norms
        return (self.layout.square_sum + observed + missing + self.params.reg * norms).tolist()

    def _hot_loss(self, rows: DataFrame) -> np.ndarray:
        k, models = self.params.factors, self.models
        zero = np.zeros((models, k, k))
        looked = _solve_hot(rows.filter("equation is not null"), _hot(self.users), k, models, None, zero)
        parts = looked.filter(F.col("home") == SIDE).select("vec").collect()
        return self._sum_sides([row["vec"] for row in parts]).observed

    def fit_all(
        self, epochs: int | None = None, evaluators: Sequence[MetricsOf | None] | None = None,
        variants: Sequence[str] | None = None, after_epoch: Callable[[], None] | None = None,
    ) -> list[FitResult]:
        """Run `epochs` epochs: all users, then all items from the new users, then metrics.

        The time of an epoch excludes the evaluation; models that train together share it evenly.
        """
        evaluators = evaluators or [None] * self.models
        variants = variants or [f"model-{m}" for m in range(self.models)]
        records: list[list[tuple]] = [[] for _ in range(self.models)]
        losses: list[list[float]] = [[] for _ in range(self.models)]
        for _ in range(self.params.epochs if epochs is None else epochs):
            start = time.perf_counter()
            self.user_step()
            self.item_step()
            self.epochs_done += 1
            seconds = round((time.perf_counter() - start) / self.models, 2)
            for m, loss in enumerate(self.objective()):
                losses[m].append(loss)
                hr = ndcg = None
                if evaluators[m] is not None:
                    with shuffles_dropped(self.spark):
                        metrics = evaluators[m](*self._packed(m)).first()
                    hr = None if metrics["hr"] is None else round(metrics["hr"], 4)
                    ndcg = None if metrics["ndcg"] is None else round(metrics["ndcg"], 4)
                records[m].append((variants[m], self.epochs_done, seconds, hr, ndcg))
            if after_epoch is not None:
                after_epoch()
        readers = [self.models]
        return [
            FitResult(
                *self.factors(m), self.spark.createDataFrame(records[m], HISTORY_SCHEMA), records[m],
                (self.users, self.items), losses[m], readers,
            )
            for m in range(self.models)
        ]

    def _packed(self, model: int) -> Factors:
        return tuple(state.select("idx", self._own_part(model).alias("vec")) for state in (self.users, self.items))

    def _own_part(self, model: int) -> Column:
        if self.models == 1:
            return F.col("vec")
        width = 8 * self.params.factors
        return F.substring("vec", 1 + model * width, width)

    def factors(self, model: int = 0) -> Factors:
        """`(idx, vec)` of the users and of the items of one model, `vec` an array."""
        self._handed_out += [self.users, self.items]
        users, items = self._packed(model)
        return unpacked(users), unpacked(items)

    def close(self) -> None:
        """Release the trainer's own layout and states; factors that were handed out stay readable."""
        if self._own_layout:
            self.layout.close()
        for state in (self.users, self.items):
            if not any(state is table for table in self._handed_out):
                drop_table(state)

    def __enter__(self):
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


class Trainer(JointTrainer):
    """One model."""

    def __init__(
        self,
        relation: DataFrame | None,
        confidence: DataFrame,
        n_users: int,
        n_items: int,
        params: Params = Params(),
        init: Factors | None = None,
        layout: Layout | None = None,
    ) -> None:
        super().__init__(relation, [confidence], n_users, n_items, params, [init], layout)

    def fit(
        self, epochs: int | None = None, evaluator: MetricsOf | None = None, variant: str = "model",
        after_epoch: Callable[[], None] | None = None,
    ) -> FitResult:
        """Run `epochs` epochs, each followed by the evaluation."""
        return self.fit_all(epochs, [evaluator], [variant], after_epoch)[0]

    @classmethod
    def from_state(
        cls, params: Params, n_users: int, n_items: int, users: DataFrame, items: DataFrame, layout: Layout, epochs_done: int
    ) -> Trainer:
        """A trainer that goes on from written sides `(idx, c, vec)`, packed."""
        trainer = cls.__new__(cls)
        trainer._take(params, 1, n_users, n_items, layout, epochs_done)
        trainer._start(users, items)
        return trainer

    @property
    def user_factors(self) -> DataFrame:
        """`(idx, vec)` of the users, `vec` an array."""
        return self.factors()[0]

    @property
    def item_factors(self) -> DataFrame:
        """`(idx, vec)` of the items, `vec` an array."""
        return self.factors()[1]


def fit(
    relation: DataFrame, confidence: DataFrame, n_users: int, n_items: int, params: Params = Params(),
    init: Factors | None = None, evaluator: MetricsOf | None = None,
    variant: str = "model", layout: Layout | None = None,
) -> FitResult:
    """Train for `params.epochs` epochs on a given layout, or on one of its own."""
    with Trainer(relation, confidence, n_users, n_items, params, init, layout) as trainer:
        return trainer.fit(evaluator=evaluator, variant=variant)


def _side_by_side(tables: Sequence[DataFrame]) -> DataFrame:
    """Packed factors of several models as one table, the vectors behind one another."""
    joined = tables[0]
    for m, table in enumerate(tables[1:], 1):
        other = table.select("idx", F.col("vec").alias(f"vec{m}"))
        joined = joined.join(other, "idx").select("idx", F.concat("vec", f"vec{m}").alias("vec"))
    return joined


def _hot(state: DataFrame) -> DataFrame:
    return state.filter(F.col("home") == HOT_HOME)


def _weights(column: pa.Array | pa.ChunkedArray, models: int) -> np.ndarray:
    """The entities' weights, a row each and a column per model."""
    return to_matrix(column, models)


def _lists(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * np.int32(width)), pa.array(values.ravel()))


def _side(c: np.ndarray, vec: np.ndarray, k: int, observed: np.ndarray) -> np.ndarray:
    """Gram matrices, squared norms and pairs' losses of some vectors, in one row of numbers."""
    models = len(observed)
    cubes = vec.reshape(len(vec), models, k)
    grams = [(cubes[:, m] * c[:, m, None]).T @ cubes[:, m] for m in range(models)]
    return np.concatenate([np.ravel(grams), (cubes**2).sum(axis=(0, 2)), observed])


def _side_rows(side: np.ndarray, extra: int) -> list[pa.Array]:
    """The columns of one row with home SIDE, `extra` null columns behind it."""
    return [
        pa.array([-1], pa.int64()), pa.nulls(1, pa.binary()), pa.array([side.tobytes()], pa.binary()),
        pa.array([SIDE], pa.int32()), pa.nulls(1, pa.binary()),
        *[pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.float64()))][:extra],
    ]


def _send(models: int, k: int, range_size: int):
    """Rows of vectors for the blocks that need them: those for one range of one block lie in one row.

    A source goes to all its blocks, a target to its home, before the ranges.
    """

    def packs(role: int, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        idx, c, vec, counts, block = (np.concatenate(part) for part in zip(*held))
        at = np.repeat(np.arange(len(idx)), counts)
        rng = idx[at] // range_size if role == SOURCE else np.full(len(at), BEFORE_RANGES)
        names = np.flatnonzero(np.bincount(block))
        place = np.zeros(names[-1] + 1, np.int64)
        place[names] = np.arange(len(names))
        place = place[block]
        low = rng.min()
        n_ranges = int(rng.max() - low) + 1
        place = place * n_ranges + (rng - low)
        order = np.argsort(place.astype(np.min_scalar_type(len(names) * n_ranges)), kind="stable")
        at, place = at[order], place[order]
        starts = np.append(0, np.flatnonzero(np.diff(place)) + 1)
        ends = np.append(starts[1:], len(at))
        payload = [pack_vectors(idx[some], c[some], vec[some]) for some in map(at.__getitem__, map(slice, starts, ends))]
        n = len(payload)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(names[place[starts] // n_ranges].astype(np.int32)), pa.array((place[starts] % n_ranges + low).astype(np.int32)),
                pa.array(np.full(n, role, np.int32)), pa.nulls(n, pa.int64()), pa.array(payload, pa.binary()),
            ],
            names=BLOCK_NAMES,
        )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {TARGET: [], SOURCE: []}
        size = dict.fromkeys(held, 0)
        for batch in batches:
            for role in held:
                part = batch.filter(pc.equal(batch.column("role"), role))
                if role == SOURCE:
                    block, counts = unpacked_lists(part.column("blocks"))
                else:
                    block, counts = part.column("home").to_numpy(), np.ones(len(part), np.int64)
                if len(block):
                    c, vec = _weights(part.column("c"), models), to_matrix(part.column("vec"))
                    held[role].append((part.column("idx").to_numpy(), c, vec, counts, block))
                    size[role] += len(block) * 8 * (k + 1) * models
                if size[role] >= SENT_BYTES:
                    yield packs(role, held[role])
                    held[role], size[role] = [], 0
        for role, rows in held.items():
            if rows:
                yield packs(role, rows)

    return send


def pack_vectors(idx: np.ndarray, c: np.ndarray, vec: np.ndarray) -> bytes:
    """Indices, weights and vectors of some entities in one row; only the vectors are not compressed."""
    return squeezed(idx, c.ravel()) + np.ascontiguousarray(vec).tobytes()


def unpack_vectors(payload: pa.Buffer | bytes, models: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    (idx, c), rest = unsqueezed(payload)
    return idx, c.reshape(len(idx), models), np.frombuffer(rest, np.float64).reshape(len(idx), -1)


class _BlockWork:
    """One block's half-step, fed row by row in the order of `_stream`.

    Without `reg` nothing is updated: only the pairs' loss at the given vectors is added up.
    """

    def __init__(self, k: int, models: int, reg: float | None, grams: np.ndarray, single_range: bool):
        self.k, self.models, self.reg, self.grams, self.single = k, models, reg, grams, single_range
        self.at = (BEFORE_RANGES, TARGET)
        self.block = None
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {TARGET: [], SHARE: [], SOURCE: []}
        self.routes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.targets: tuple | None = None
        self.sources: tuple | None = None
        self.observed = np.zeros(models)
        self.sums: list[np.ndarray] = []  # carried [A | b] of the targets, where there are several ranges

    def take(self, batch: pa.RecordBatch) -> None:
        rng, role = (batch.column(name).to_numpy() for name in ("rng", "role"))
        ends = [*(np.flatnonzero((np.diff(rng) != 0) | (np.diff(role) != 0)) + 1).tolist(), batch.num_rows]
        start = 0
        for stop in ends:
            here = (int(rng[start]), int(role[start]))
            if here < self.at:
                raise ValueError("a block's rows came out of order: spark.sql.unionOutputPartitioning must be on")
            part = batch.slice(start, stop - start)
            if self.block is None:
                self.block = part.column("block")[0].as_py()
            if here[0] != self.at[0]:  # a new range: the vectors of the one before can go
                self.parts[SOURCE], self.sources = [], None
            if here[1] == TILE:
                for tile in part.column("payload"):
                    self._tile(Tile.unpacked(tile.as_buffer()))
            elif here[1] == ROUTE:
                self.routes += [unpack_routes(row.as_buffer()) for row in part.column("payload")]
            else:
                self._hold(here[1], part.column("idx"), part.column("payload"))
            self.at, start = here, stop

    def _hold(self, role: int, idx: pa.Array, payload: pa.Array) -> None:
        """Keep rows of vectors; a row without an index holds many of them."""
        if idx.null_count:
            self.parts[role] += [unpack_vectors(row.as_buffer(), self.models) for row in payload]
        else:
            numbers = to_matrix(payload)
            self.parts[role].append((idx.to_numpy(), numbers[:, :self.models], numbers[:, self.models:]))

    def _sorted(self, role: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Indices, weights and vectors of the rows with a role, by index."""
        if not self.parts[role]:
            return np.zeros(0, np.int64), np.zeros((0, self.models)), np.zeros((0, 0 if role == SHARE else self.models * self.k))
        idx, c, vec = (np.concatenate(part) for part in zip(*self.parts[role]))
        self.parts[role] = []
        order = np.argsort(idx, kind="stable")
        return idx[order], c[order], vec[order]

    def _begin(self) -> None:
        self.targets = self._sorted(TARGET)
        self.shares = self._sorted(SHARE)[:2]
        self.share_sums = np.zeros((len(self.shares[0]), self.models, self.k, self.k + 1))
        if not self.single:
            self.sums = [np.zeros((len(self.targets[0]), self.k, self.k + 1)) for _ in range(self.models)]
            self.touched = np.zeros(len(self.targets[0]), bool)

    def _tile(self, tile: Tile) -> None:
        if self.targets is None:
            self._begin()
        if self.sources is None:
            self.sources = self._sorted(SOURCE)
        source_idx, source_c, source_vec = self.sources
        idx, c = self.shares if tile.hot else self.targets[:2]
        rows, at = np.searchsorted(idx, tile.dst), np.searchsorted(source_idx, tile.src)
        for some, pairs in chunks(tile.sizes, self.k):
            partners, own, counts = source_vec[at[pairs]], rows[some], tile.sizes[some]
            for m in range(self.models):
                weight = tile.sw[pairs] - tile.n[pairs] * (source_c[at[pairs], m] * np.repeat(c[own, m], counts))
                sums = normal_sums(counts, partners[:, m * self.k:(m + 1) * self.k], weight, tile.swr[pairs])
                if tile.hot:
                    self.share_sums[own, m] += sums
                elif self.single:
                    self._settle(m, own, sums)
                else:
                    self.sums[m][own] += sums
            if not (tile.hot or self.single):
                self.touched[own] = True

    def _routes(self) -> pa.Array:
        """The routes of the targets; those without pairs have none."""
        idx = self.targets[0]
        counts = np.zeros(len(idx), np.int64)
        for own, sizes, _ in self.routes:
            counts[np.searchsorted(idx, own)] = sizes
        # Each row of routes is a run of the block's entities by index; the targets are sorted likewise.
        runs = sorted(self.routes, key=lambda run: run[0][0])
        return packed_lists(np.concatenate([np.zeros(0, ROUTE_TYPE), *[blocks for _, _, blocks in runs]]), counts)

    def _settle(self, m: int, rows: np.ndarray, sums: np.ndarray) -> None:
        """Sweep entities whose sums are complete."""
        vec, part = self.targets[2], slice(m * self.k, (m + 1) * self.k)
        if self.reg is not None:
            vec[rows, part] = sweep_normal(vec[rows, part], self.targets[1][rows, m], sums, self.grams[m], self.reg)
        self.observed[m] += pair_loss(sums, vec[rows, part])

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.targets is None:
            self._begin()
        if not self.single:
            for m in range(self.models):
                rows = np.flatnonzero(self.touched)
                for first in range(0, len(rows), 1024):
                    self._settle(m, rows[first:first + 1024], self.sums[m][rows[first:first + 1024]])
        idx, c, vec = self.targets
        n = len(idx)
        if n:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(idx), from_matrix(c), from_matrix(vec), pa.array(np.full(n, self.block, np.int32)), self._routes(),
                    pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.float64())),
                ],
                names=STEP_NAMES,
            )
        yield pa.RecordBatch.from_arrays(_side_rows(_side(c, vec, self.k, self.observed), 2), names=STEP_NAMES)
        share_idx, share_c = self.shares
        wide = self.models * self.k  # rows of [A | b] of an entity, model after model
        for first in range(0, len(share_idx), 64):
            some = slice(first, first + 64)
            owners, n = share_idx[some], len(share_idx[some]) * wide
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(owners, wide)), from_matrix(np.repeat(share_c[some], wide, axis=0)), pa.nulls(n, pa.binary()),
                    pa.array(np.full(n, HOT_HOME, np.int32)), pa.nulls(n, pa.binary()),
                    pa.array(np.tile(np.arange(wide, dtype=np.int32), len(owners))),
                    _lists(self.share_sums[some].reshape(n, self.k + 1)),
                ],
                names=STEP_NAMES,
            )


def _block_update(k: int, models: int, reg: float | None, grams: np.ndarray, single_range: bool):
    """The half-step of one block, as a function of its stream of rows."""

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _BlockWork(k, models, reg, grams, single_range)
        for batch in batches:
            work.take(batch)
        yield from work.finish()

    return update


def _solve_hot(
    equations: DataFrame, hot: DataFrame, k: int, models: int, reg: float | None, grams: np.ndarray
) -> DataFrame:
    """Add up the blocks' shares of each hot entity's equations and sweep once."""
    summed = (
        equations.select("idx", "equation", F.posexplode("sums").alias("column", "value"))
        .groupBy("idx", "equation", "column").agg(F.sum("value").alias("value"))
        .groupBy("idx")
        .agg(F.sort_array(F.collect_list(F.struct("equation", "column", "value"))).alias("cells"))
        .select("idx", F.col("cells.value").alias("sums"))  # models * k * (k + 1) numbers
    )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(models * (k * k + 2))
        for batch in batches:
            new = to_matrix(batch.column("vec"), k * models).copy()
            sums = batch.column("sums").flatten().to_numpy(zero_copy_only=False).reshape(-1, models, k, k + 1)
            c = _weights(batch.column("c"), models)
            observed = np.zeros(models)
            for m in range(models):
                part = slice(m * k, (m + 1) * k)
                if reg is not None:
                    new[:, part] = sweep_normal(new[:, part], c[:, m], sums[:, m], grams[m], reg)
                observed[m] = pair_loss(sums[:, m], new[:, part])
            total += _side(c, new, k, observed)
            yield pa.RecordBatch.from_arrays(
                [batch.column("idx"), batch.column("c"), from_matrix(new), batch.column("home"), batch.column("blocks")],
                names=STATE_NAMES,
            )
        yield pa.RecordBatch.from_arrays(_side_rows(total, 0), names=STATE_NAMES)

    return hot.join(summed, "idx").select(*STATE_NAMES, "sums").mapInArrow(solve, STATE_SCHEMA)
