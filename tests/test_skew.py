"""One user and one item that each hold a third of all rows, and lost caches."""

import numpy as np
import pytest
from conftest import matrix_of
from pyspark.sql import functions as F
from test_ranking import naive_rank
from test_training import RELATION, confidence_of, naive_epoch

import tacitrec as tr
from tacitrec.operators.blocks import Tile, lay_out, observed_pairs, place_pairs
from tacitrec.operators.encode import encode_ids
from tacitrec.operators.heavy import heavy_keys

N_USERS, N_ITEMS, K = 90, 110, 4


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(21)
    pairs = [(0, int(i)) for i in rng.integers(0, N_ITEMS, 400)]
    pairs += [(int(u), 0) for u in rng.integers(0, N_USERS, 400)]
    pairs += [(int(u), int(i)) for u, i in zip(rng.integers(1, N_USERS, 400), rng.integers(1, N_ITEMS, 400))]
    return pairs


def test_blocks_stay_even(spark, skewed):
    relation = spark.createDataFrame([(u, i, 1.0, 1.0) for u, i in skewed], RELATION)
    pairs = observed_pairs(relation)
    for dst, src in (("user_idx", "item_idx"), ("item_idx", "user_idx")):
        placed = place_pairs(pairs, dst, src, 6, 12)
        blocks = lay_out(placed, place_pairs(pairs, src, dst, 4, 12).routes())
        sizes = {row["block"]: row["count"] for row in placed.rows.groupBy("block").count().collect()}
        assert set(sizes) == set(blocks.keys) and sum(sizes.values()) == len(set(skewed))
        assert max(sizes.values()) < 1.6 * sum(sizes.values()) / 6
        tiles = blocks.tiles.filter("role = 4").withColumn("part", F.spark_partition_id()).collect()
        assert len({row["part"] for row in tiles}) == 6  # a partition each
        assert sum(len(Tile.unpacked(bytes(row["payload"])).src) for row in tiles) == len(set(skewed))
        blocks.close()


def test_skewed_training_follows_the_rule(spark, factors_of, skewed):
    rng = np.random.default_rng(22)
    p, q = rng.normal(0, 0.3, (N_USERS, K)), rng.normal(0, 0.3, (N_ITEMS, K))
    c = rng.uniform(0.05, 0.4, N_ITEMS)
    rows = [(u, i, 1.0, 1.0) for u, i in skewed]
    trainer = tr.Trainer(
        spark.createDataFrame(rows, RELATION), confidence_of(spark, c.tolist()), N_USERS, N_ITEMS,
        tr.Params(factors=K, hot_degree=12, blocks=6), (factors_of(p), factors_of(q)),
    )
    trainer.fit(1)
    trainer.user_blocks.tiles.unpersist(True)  # as if the executors that held it were lost
    trainer.item_blocks.tiles.unpersist(True)
    result = trainer.fit(1)
    for _ in range(2):
        p, q = naive_epoch(p, q, rows, c, 0.01)
    np.testing.assert_allclose(matrix_of(result.users), p, atol=1e-9)
    np.testing.assert_allclose(matrix_of(result.items), q, atol=1e-9)


def test_skewed_split_and_ranks(spark, factors_of, skewed):
    rows = [(u, i, t) for t, (u, i) in enumerate(skewed)]
    train, test = tr.leave_one_out(
        spark.createDataFrame(rows, "user_idx bigint, item_idx bigint, timestamp bigint")
    )
    last = {u: (i, t) for u, i, t in rows}
    assert {(r["user_idx"], r["item_idx"], r["timestamp"]) for r in test.collect()} == {
        (u, i, t) for u, (i, t) in last.items()
    }
    kept = sorted(row for row in rows if last[row[0]][1] != row[2])
    assert sorted(map(tuple, train.select("user_idx", "item_idx", "timestamp").collect())) == kept

    rng = np.random.default_rng(23)
    p, q = rng.integers(-4, 5, (N_USERS, K)) / 8.0, rng.integers(-4, 5, (N_ITEMS, K)) / 8.0
    seen = {u: {i for user, i, _ in kept if user == u} for u in last}
    ranks = tr.test_item_rank(factors_of(p), factors_of(q), test, train)
    assert {r["user_idx"]: r["rank"] for r in ranks.collect()} == {
        u: naive_rank(p[u] @ q.T, seen[u], i) for u, (i, _) in last.items()
    }
    lists = tr.recommend_all(factors_of(p), factors_of(q), train, 5)
    assert lists.join(train, ["user_idx", "item_idx"], "left_semi").count() == 0


def test_skewed_core(spark, skewed):
    rows = spark.createDataFrame(
        [(f"u{u}", f"i{i}", t) for t, (u, i) in enumerate(skewed)], "user_id string, item_id string, timestamp bigint"
    )
    core = tr.kcore(rows, 9)
    once = rows
    while True:
        smaller = tr.kcore_pass(once, 9)
        if smaller.count() == once.count():
            break
        once = spark.createDataFrame(smaller.collect(), rows.schema)
    assert sorted(map(tuple, core.rows.collect())) == sorted(map(tuple, once.collect()))
    assert 0 < core.n_rows < len(skewed)


def test_skew_without_broadcasts(spark, factors_of, skewed):
    """The same results when no join may send a side to all tasks."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        rng = np.random.default_rng(23)
        p, q = rng.normal(0, 0.3, (N_USERS, K)), rng.normal(0, 0.3, (N_ITEMS, K))
        c = rng.uniform(0.05, 0.4, N_ITEMS)
        rows = [(u, i, 1.0, 1.0) for u, i in skewed]
        result = tr.Trainer(
            spark.createDataFrame(rows, RELATION), confidence_of(spark, c.tolist()), N_USERS, N_ITEMS,
            tr.Params(factors=K, hot_degree=12, blocks=6), (factors_of(p), factors_of(q)),
        ).fit(1)
        expected = naive_epoch(p, q, rows, c, 0.01)
        np.testing.assert_allclose(matrix_of(result.items), expected[1], atol=1e-9)
        pairs = spark.createDataFrame(sorted(set(skewed)), "user_idx bigint, item_idx bigint")
        scores = {(r["user_idx"], r["item_idx"]): r["score"] for r in tr.score_pairs(pairs, factors_of(p), factors_of(q)).collect()}
        assert set(scores) == set(skewed)
        assert all(abs(s - p[u] @ q[i]) < 1e-12 for (u, i), s in scores.items())
        heavy = tr.score_pairs(pairs, factors_of(p), factors_of(q), ([0], [0]))  # as if both held very many
        assert {(r["user_idx"], r["item_idx"]): r["score"] for r in heavy.collect()} == scores
        plan = heavy._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and plan.count("_salt") > 2
    finally:
        spark.conf.set(key, before)


def test_a_sketch_finds_the_keys_of_very_many_rows(spark, interactions_of):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id"))).alias("user_id"),
        (F.col("id") % 7000).cast("string").alias("item_id"), F.col("id").alias("timestamp"),
    )
    assert heavy_keys(rows, "user_id", "item_id") == [["hot"], []]
    assert heavy_keys(rows.limit(0), "user_id") == [[]]
    encoded = encode_ids(rows)
    found = encoded.rows.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("user_idx").alias("ids")).orderBy(F.desc("n"))
    assert encoded.rows.count() == 30_000 and tuple(found.first()) == ("hot", 10_000, 1)
    assert "_salt" in encoded.rows._jdf.queryExecution().executedPlan().toString()


def test_many_hot_entities_are_not_sent_to_the_driver(spark):
    """A packed table of hot entities looks small, so nothing but a hint keeps it from being broadcast."""
    pairs = spark.range(2000).selectExpr(
        "id % 200 as user_idx", "id as item_idx", "1D as n", "1D as sw", "1D as swr"
    )
    placed = place_pairs(pairs, "user_idx", "item_idx", 3, 4)
    plan = placed.rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "Generate" not in plan
    assert placed.rows.filter("hot").count() == 2000
    homes = lay_out(placed, place_pairs(pairs, "item_idx", "user_idx", 3, 4).routes()).with_home(
        spark.range(200).withColumnRenamed("id", "idx")
    )
    assert "BroadcastHashJoin" not in homes._jdf.queryExecution().executedPlan().toString()
    assert {row["home"] for row in homes.collect()} == {-1}


def test_a_written_table_leaves_no_shuffle_files(spark):
    """Else those of every half-step stay until the driver collects its garbage."""
    import glob
    import os
    import time

    from tacitrec.tables import CLEAN_UP, drop_table, together, write_table

    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {path for folder in manager.localDirs() for path in glob.glob(os.path.join(folder.getPath(), "*", "shuffle_*.data"))}

    before, setting = files(), spark.conf.get(CLEAN_UP)
    rows = spark.range(5000).selectExpr("id % 100 as key", "id").repartition(4, "key")
    tables = together(spark, *[lambda: write_table(rows.sortWithinPartitions("id"), "probe")] * 3)
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get(CLEAN_UP) == setting
    assert [table.count() for table in tables] == [5000] * 3
    for table in tables:
        drop_table(table)


def test_an_evaluation_leaves_no_shuffle_files(spark, factors_of):
    """What it keeps is the test rows and seen pairs, found before the training."""
    import glob
    import os
    import time

    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {path for folder in manager.localDirs() for path in glob.glob(os.path.join(folder.getPath(), "*", "shuffle_*.data"))}

    rng = np.random.default_rng(5)
    train = spark.createDataFrame([(u, int(i)) for u in range(30) for i in rng.integers(0, 40, 5)], "user_idx bigint, item_idx bigint")
    test = spark.createDataFrame([(u, int(i)) for u, i in enumerate(rng.integers(0, 40, 30))], "user_idx bigint, item_idx bigint")
    evaluator = tr.Evaluator(test, train, 40, 5)
    args = (tr.training_relation(train), confidence_of(spark, [0.1] * 40), 30, 40, tr.Params(factors=K))
    with tr.Trainer(*args) as trainer:
        first = trainer.fit(1, evaluator)
        kept = files()
        again = trainer.fit(1, evaluator)
        until = time.time() + 20
        while files() - kept and time.time() < until:
            time.sleep(0.2)
        assert not files() - kept
    evaluator.close()
    assert all(0 <= row["hr"] <= 1 for result in (first, again) for row in result.history.collect())
