"""Rank of the held-out item among all items, hit ratio and NDCG."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tacitrec.functions.ranking import count_above_in
from tacitrec.functions.vectors import packed
from tacitrec.operators.grid import USERS_AT_ONCE, CellBatch, how_much_larger, plan_grid, score_grid
from tacitrec.operators.sample import smallest_digests
from tacitrec.operators.heavy import heavy_keys
from tacitrec.operators.score import score_pairs
from tacitrec.tables import write_table

# Test rows that are counted at once where few of them are counted to the end: a look at a leaf costs
# the more the fewer rows share it.
COUNTED_AT_ONCE = 16_384


def seen_items(train: DataFrame) -> DataFrame:
    """Distinct training pairs."""
    return train.select("user_idx", "item_idx").distinct()


def eval_subsample(
    test: DataFrame, max_users: int | None = None, seed: int = 42, round_no: int = 0
) -> DataFrame:
    """All test rows, or exactly `max_users` of them where there are more.

    `round_no` draws another subset; with the same number all variants are scored on the
    same users.
    """
    if max_users is None or test.count() <= max_users:
        return test
    return smallest_digests(test, max_users, ["user_idx", "item_idx"], seed, round_no)


def test_item_rank(users: DataFrame, items: DataFrame, test: DataFrame, train: DataFrame | None) -> DataFrame:
    """`(user_idx, item_idx, copies, rank)` per distinct test row.

    The rank is 1 plus the number of items with a strictly greater score, over the whole
    catalogue without the user's training items. A test item that was also trained on
    counts as masked itself: every unseen item lies above it.
    """
    # Written, as both are read several times.
    seen = write_table(_seen_by(test, train), "seen-pairs")
    tests = write_table(_test_pairs(test, seen), "test-pairs")
    n_users = tests.agg(F.countDistinct("user_idx")).first()[0]
    return _ranks(users, items, tests, seen, n_users, items.count(), _heavy(tests))


def _seen_by(test: DataFrame, train: DataFrame | None) -> DataFrame:
    """Distinct training pairs of the test users."""
    if train is None:
        raise ValueError("the training rows are needed to leave out what a user has seen")
    tested = test.select("user_idx").distinct()
    return seen_items(train.join(tested, "user_idx", "left_semi"))


def _test_pairs(test: DataFrame, seen: DataFrame) -> DataFrame:
    """Distinct test rows `(user_idx, item_idx, copies, known)`; known if trained on, too."""
    pairs = test.groupBy("user_idx", "item_idx").agg(F.count("*").alias("copies"))
    known = seen.select("user_idx", "item_idx", F.lit(True).alias("known"))
    return pairs.join(known, ["user_idx", "item_idx"], "left").select(
        "user_idx", "item_idx", "copies", F.coalesce("known", F.lit(False)).alias("known")
    )


def _heavy(tests: DataFrame) -> tuple[list, list]:
    """Users and items of very many test rows."""
    return tuple(heavy_keys(tests, "user_idx", "item_idx"))


def _ranks(
    users: DataFrame, items: DataFrame, tests: DataFrame, seen: DataFrame, n_users: int, n_items: int,
    heavy: tuple[list, list], enough: int | None = None,
) -> DataFrame:
    """Ranks, exact up to `enough`; beyond it only known to lie beyond it."""
    tested = tests.select(F.col("user_idx").alias("idx")).distinct()
    own, items = packed(users).join(tested, "idx", "left_semi"), packed(items)
    limits = score_pairs(tests.filter(~F.col("known")), own, items, heavy).withColumnRenamed("score", "value")
    masked = tests.filter("known").select("user_idx", "item_idx", F.lit(float("-inf")).alias("value"))

    at_once = USERS_AT_ONCE if enough is None else COUNTED_AT_ONCE

    def count(batch: CellBatch) -> pa.RecordBatch:
        higher = np.zeros(len(batch.test_row), np.int64)
        for begin in range(0, len(higher), at_once):
            some = slice(begin, min(begin + at_once, len(higher)))
            higher[some] = count_above_in(
                batch.cell.leaves, batch.user_vec[batch.test_row[some]], batch.test_value[some],
                *batch.seen_by_test(some.start, some.stop), batch.item_vec, enough,
            )
        return pa.RecordBatch.from_arrays(
            [pa.array(batch.users[batch.test_row]), pa.array(batch.test_item), pa.array(higher)],
            names=["user_idx", "item_idx", "higher"],
        )

    tasks = tests.sparkSession.sparkContext.defaultParallelism
    grid = plan_grid(n_users, n_items, 2 * tasks, how_much_larger(items))
    counted = score_grid(
        grid, items, own, seen, limits.unionByName(masked), count,
        "user_idx bigint, item_idx bigint, higher bigint", at_once,
    )
    ranks = counted.groupBy("user_idx", "item_idx").agg((F.sum("higher") + 1).alias("rank"))
    return tests.join(ranks, ["user_idx", "item_idx"]).select("user_idx", "item_idx", "copies", "rank")


def hr_ndcg(ranks: DataFrame, top_k: int = 100) -> DataFrame:
    """One row: number of test rows, hit ratio and NDCG at `top_k`; null without rows."""
    hit = F.col("rank") <= top_k
    gain = F.when(hit, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    return ranks.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("n"),
        (F.sum(F.when(hit, F.col("copies")).otherwise(0)) / F.sum("copies")).alias("hr"),
        (F.sum(gain * F.col("copies")) / F.sum("copies")).alias("ndcg"),
    )


class Evaluator:
    """Scores factor tables on a fixed set of test rows; pass it to `Trainer.fit`.

    The test rows and the seen pairs of their users are found once and kept. Every test row is ranked among
    all items, but once `top_k` of them lie above it, it is a miss wherever it ends, and is counted no further.
    """

    def __init__(
        self, test: DataFrame, train: DataFrame, n_items: int, top_k: int = 100,
        max_eval_users: int | None = None, seed: int = 42, round_no: int = 0,
    ) -> None:
        self.top_k = top_k
        self.n_items = n_items
        chosen = eval_subsample(test, max_eval_users, seed, round_no).select("user_idx", "item_idx")
        self.seen = _seen_by(chosen, train).persist(StorageLevel.MEMORY_AND_DISK)
        self.tests = _test_pairs(chosen, self.seen).persist(StorageLevel.MEMORY_AND_DISK)
        self.n_users = self.tests.agg(F.countDistinct("user_idx")).first()[0]
        self.heavy = _heavy(self.tests)

    def __call__(self, users: DataFrame, items: DataFrame) -> DataFrame:
        ranks = _ranks(users, items, self.tests, self.seen, self.n_users, self.n_items, self.heavy, self.top_k)
        return hr_ndcg(ranks, self.top_k)

    def close(self) -> None:
        self.tests.unpersist()
        self.seen.unpersist()
