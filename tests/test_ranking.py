"""Ranks, metrics and top lists against full score tables."""

import math

import numpy as np
import pytest

import tacitrec as tr
import tacitrec.operators.grid as grid
from tacitrec.functions.ranking import best_items, count_above

PAIRS = "user_idx bigint, item_idx bigint"


def naive_rank(scores, seen, item):
    scores = scores.copy()
    scores[list(seen)] = -np.inf
    return 1 + int((scores > scores[item]).sum())


@pytest.mark.parametrize("seen, rank", [([], 2), ([0], 1), ([0, 2], 3)])
def test_rank_rules(spark, factors_of, seen, rank):
    users, items = factors_of([[1.0]]), factors_of([[0.9], [0.8], [0.8], [0.1]])
    test = spark.createDataFrame([(0, 2)], PAIRS)
    train = spark.createDataFrame([(0, i) for i in seen] + [(1, 1)], PAIRS)
    row = tr.test_item_rank(users, items, test, train).first()
    assert row["rank"] == rank
    for top_k, hit in ((rank - 1, False), (rank, True)):
        metrics = tr.hr_ndcg(tr.test_item_rank(users, items, test, train), top_k).first()
        assert metrics["hr"] == float(hit)
        assert metrics["ndcg"] == pytest.approx(1 / math.log2(rank + 1) if hit else 0.0)


def random_case(n_users, n_items, k, seed, dyadic):
    rng = np.random.default_rng(seed)
    if dyadic:  # many equal scores
        p, q = rng.integers(-3, 4, (n_users, k)) / 8.0, rng.integers(-3, 4, (n_items, k)) / 8.0
    else:
        p, q = rng.normal(size=(n_users, k)), rng.normal(size=(n_items, k))
    train = sorted({(int(u), int(i)) for u, i in zip(rng.integers(0, n_users, n_users * 6), rng.integers(0, n_items, n_users * 6))})
    train += train[:20]  # copies
    test = [(u, int(rng.integers(0, n_items))) for u in range(n_users)]
    return p, q, train, test


@pytest.mark.parametrize("cells", [(1, 1, 90), (3, 1, 90), (1, 4, 23), (4, 5, 18)])
@pytest.mark.parametrize("dyadic", [True, False])
def test_ranks_and_lists_on_every_grid(spark, factors_of, monkeypatch, cells, dyadic):
    p, q, train, test = random_case(40, 90, 6, 11, dyadic)
    monkeypatch.setattr(grid, "SCORES_AT_ONCE", 500)
    for module in (tr.plans.evaluate, tr.plans.recommend):
        monkeypatch.setattr(module, "plan_grid", lambda *_: grid.Grid(*cells))
    users, items = factors_of(p), factors_of(q)
    train_rows, test_rows = spark.createDataFrame(train, PAIRS), spark.createDataFrame(test, PAIRS)

    scores = np.zeros((40, 90))
    for f in range(6):
        scores += np.outer(p[:, f], q[:, f])
    seen = {u: {i for user, i in train if user == u} for u in range(40)}
    ranks = {row["user_idx"]: row["rank"] for row in tr.test_item_rank(users, items, test_rows, train_rows).collect()}
    assert ranks == {u: naive_rank(scores[u], seen[u], i) for u, i in test}

    expected = []
    for u in range(40):
        order = sorted((i for i in range(90) if i not in seen[u]), key=lambda i: (-scores[u, i], i))[:7]
        expected += [(u, i, scores[u, i] + 0.0, place + 1) for place, i in enumerate(order)]
    lists = tr.recommend_all(users, items, train_rows, 7).collect()
    assert sorted((r["user_idx"], r["item_idx"], r["score"] + 0.0, r["rn"]) for r in lists) == sorted(expected)
    one = tr.recommend_user(users, items, train_rows, 3, 7).collect()
    assert [(r["item_idx"], r["score"] + 0.0) for r in one] == [e[1:3] for e in expected if e[0] == 3]


def test_repeated_test_rows_count_each(spark, factors_of):
    users, items = factors_of([[1.0], [1.0]]), factors_of([[3.0], [2.0], [1.0]])
    test = spark.createDataFrame([(0, 0), (0, 2), (0, 2), (1, 1)], PAIRS)
    train = spark.createDataFrame([(1, 0)], PAIRS)
    metrics = tr.hr_ndcg(tr.test_item_rank(users, items, test, train), 1).first()
    assert metrics["n"] == 4 and metrics["hr"] == 0.5


def test_users_who_have_seen_everything_get_nothing(spark, factors_of):
    users, items = factors_of([[1.0], [2.0]]), factors_of([[1.0], [2.0]])
    train = spark.createDataFrame([(0, 0), (0, 1), (1, 0)], PAIRS)
    lists = tr.recommend_all(users, items, train, 5).collect()
    assert [tuple(row) for row in lists] == [(1, 1, 4.0, 1)]


def test_lists_for_some_users_only(spark, factors_of):
    p, q, train, _ = random_case(25, 30, 4, 13, True)
    users, items = factors_of(p), factors_of(q)
    train_rows = spark.createDataFrame(train, PAIRS)
    unknown = spark.createDataFrame([(2, 99), (77, 1)], PAIRS)  # without vectors
    whole = tr.recommend_all(users, items, train_rows, 6)
    some = tr.recommend_all(users.filter("idx % 4 = 2"), items, train_rows.union(unknown), 6)
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, whole.filter("user_idx % 4 = 2").collect()))


def test_no_test_rows_give_null_metrics(spark, factors_of):
    empty = spark.createDataFrame([], PAIRS)
    ranks = tr.test_item_rank(factors_of([[1.0]]), factors_of([[1.0]]), empty, empty)
    assert tuple(tr.hr_ndcg(ranks, 10).first()) == (0, None, None)


def test_training_rows_are_required(spark, factors_of):
    test = spark.createDataFrame([(0, 0)], PAIRS)
    with pytest.raises(ValueError, match="training rows"):
        tr.test_item_rank(factors_of([[1.0]]), factors_of([[1.0]]), test, None)
    with pytest.raises(ValueError, match="training rows"):
        tr.Evaluator(test, None, 1)


def test_rounding_cannot_change_a_count():
    rng = np.random.default_rng(8)
    users, items = rng.normal(size=(50, 40)), np.repeat(rng.normal(size=(30, 40)), 3, axis=0)
    exact = np.zeros((50, 90))
    for f in range(40):
        exact += np.outer(users[:, f], items[:, f])
    held = rng.integers(0, 90, 50)
    limits = exact[np.arange(50), held]
    noisy = exact * (1 + rng.choice([-1, 0, 1], exact.shape) * 2.0**-53)
    np.testing.assert_array_equal(
        count_above(noisy, users, items, limits), (exact > limits[:, None]).sum(axis=1)
    )
    row, item, score, place = best_items(noisy, users, items, np.arange(90), 4)
    for u in range(50):
        order = sorted(range(90), key=lambda i: (-exact[u, i], i))[:4]
        assert item[row == u].tolist() == order
        np.testing.assert_array_equal(score[row == u], exact[u, order])


def test_evaluator_keeps_its_users(spark, factors_of):
    p, q, train, test = random_case(30, 20, 3, 12, True)
    train_rows, test_rows = spark.createDataFrame(train, PAIRS), spark.createDataFrame(test, PAIRS)
    first = tr.Evaluator(test_rows, train_rows, 20, 5, 12, 42)
    again = tr.Evaluator(test_rows, train_rows, 20, 5, 12, 42)
    other = tr.Evaluator(test_rows, train_rows, 20, 5, 12, 42, round_no=1)
    users = [sorted(row["user_idx"] for row in e.tests.collect()) for e in (first, again, other)]
    assert len(users[0]) == 12 and users[0] == users[1] != users[2]
    seen = {u: {i for user, i in train if user == u} for u in users[0]}
    hits = [naive_rank(p[u] @ q.T, seen[u], dict(test)[u]) <= 5 for u in users[0]]
    assert first(factors_of(p), factors_of(q)).first()["hr"] == pytest.approx(np.mean(hits))


@pytest.mark.parametrize("n_users, n_items, tasks", [
    (1, 1, 8), (2000, 10_000_000, 4000), (100_000_000, 1_000_000, 4000), (15_000, 20_000, 8), (0, 5, 8),
])
def test_grid_sizes(n_users, n_items, tasks):
    plan = grid.plan_grid(n_users, n_items, tasks)
    assert plan.range_length <= grid.ITEMS_PER_RANGE
    assert plan.range_length * plan.ranges >= n_items
    assert -(-n_users // plan.groups) <= grid.USERS_PER_GROUP


@pytest.mark.parametrize("scale", [1.0, 1e20])
@pytest.mark.parametrize("dyadic", [True, False])
def test_leaves_decide_most_items_without_their_scores(monkeypatch, dyadic, scale):
    import tacitrec.functions.ranking as ranking

    p, q, train, test = random_case(60, 4000, 3, 17, dyadic)
    p, q = p * scale, q[np.argsort(np.arange(4000) % 7)]
    scores = np.zeros((60, 4000))
    for f in range(3):
        scores += np.outer(p[:, f], q[:, f])
    limits = scores[np.arange(60), [i for _, i in test]]
    limits[5] = -np.inf
    row, place = (np.array(column) for column in zip(*sorted(set(train))))
    masked = scores.copy()
    masked[row, place] = -np.inf
    leaves = ranking.make_leaves(q, 32)
    assert sorted(leaves.place) == list(range(4000)) and leaves.sizes.max() <= 32
    counts = ranking.count_above_in(leaves, p, limits, row, place, q)
    np.testing.assert_array_equal(counts, (masked > limits[:, None]).sum(axis=1))

    looked = []
    plain = ranking.best_items
    monkeypatch.setattr(ranking, "best_items", lambda found, *rest: looked.append(found.size) or plain(found, *rest))
    user, item, score, _ = ranking.best_items_in(leaves, p, row, place, np.arange(4000), 9)
    for u in range(60):
        order = sorted(range(4000), key=lambda i: (-masked[u, i], i))[:9]
        assert item[user == u].tolist() == order
        np.testing.assert_array_equal(score[user == u], scores[u, order])
    assert sum(looked) < scores.size / 2


@pytest.mark.parametrize("kind", ["spread", "few", "one"])
@pytest.mark.parametrize("n", [5, 700])
def test_best_items_hold_few_bounds_at_once(kind, n):
    import tracemalloc

    import tacitrec.functions.ranking as ranking

    rng = np.random.default_rng(3)
    p, q = rng.normal(size=(300, 3)), rng.normal(size=(12_000, 3))
    if kind != "spread":  # many equal scores, also over many leaves
        q = np.round(q) if kind == "few" else np.ones_like(q)
    row, place = np.repeat(np.arange(300), 9), rng.integers(0, 12_000, 2700)
    place[:200] = np.arange(200)
    leaves = ranking.make_leaves(q, 4)
    tracemalloc.start()
    user, item, score, rank = ranking.best_items_in(leaves, p, row, place, np.arange(12_000), n)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    if n == 5 and kind != "one":
        assert peak < 8 * len(p) * len(leaves.sizes)  # one bound per user and leaf took more
    for u in range(0, 300, 23):
        exact = ranking.exact_scores(np.repeat(p[u:u + 1], len(q), 0), q)
        exact[place[row == u]] = -np.inf
        order = np.lexsort((np.arange(12_000), -exact))[:n]
        assert item[user == u].tolist() == order.tolist()
        np.testing.assert_array_equal(score[user == u], exact[order])
        assert rank[user == u].tolist() == list(range(1, n + 1))


def test_equal_vectors_are_looked_at_once():
    import tacitrec.functions.ranking as ranking

    rng = np.random.default_rng(8)
    kinds = np.array([[0.0, 1.0], [0.0, 2.0], [0.5, 1.0], [0.5, 5e-324], [3.0, 1.0]])
    q = kinds[rng.choice(5, 9_000, p=[0.6, 0.2, 0.1, 0.06, 0.04])]
    p = np.array([[1.0, 1.0], [-1.0, 0.25], [0.0, 0.0], [-2.0, -1.0]])
    leaves = ranking.make_leaves(q, 50)
    assert leaves.sizes.max() <= 50 and len(leaves.joined.sizes) == 5 and not leaves.half.any()
    exact = np.stack([ranking.exact_scores(np.repeat(u[None], len(q), 0), q) for u in p])
    best = np.lexsort((np.arange(9_000), -exact[1]))
    seen = [(0, i) for i in range(0, 9_000, 2)] + [(1, i) for i in sorted(best[:5_300])] + [(3, 8_999)]
    row, place = (np.array(column) for column in zip(*seen))
    exact[row, place] = -np.inf
    user, item, score, rank = ranking.best_items_in(leaves, p, row, place, np.arange(9_000), 7)
    for u in range(4):
        order = np.lexsort((np.arange(9_000), -exact[u]))[:7]
        assert item[user == u].tolist() == order.tolist()
        np.testing.assert_array_equal(score[user == u], exact[u, order])
    limits = np.array([1.0, 0.25, -1.0, -np.inf])
    counts = ranking.count_above_in(leaves, p, limits, row, place, q)
    np.testing.assert_array_equal(counts, (exact > limits[:, None]).sum(axis=1))


def test_counts_look_at_few_boxes_and_stop_when_there_are_enough(monkeypatch):
    import tacitrec.functions.ranking as ranking

    rng = np.random.default_rng(9)
    p, q = rng.normal(size=(80, 2)), rng.normal(size=(30_000, 2))
    exact = np.stack([ranking.exact_scores(np.repeat(u[None], len(q), 0), q) for u in p])
    limits = np.partition(exact, -40, axis=1)[:, -40]
    limits[20:] = exact[20:, 0]
    row, place = np.repeat(np.arange(80), 15), np.tile(np.arange(0, 30_000, 2_000), 80)
    exact[row, place] = -np.inf
    above = (exact > limits[:, None]).sum(axis=1)
    leaves = ranking.make_leaves(q, 8)
    plain, looked = ranking.Leaves.bounds, []

    def bounds(self, users, some):
        found = plain(self, users, some)
        looked.append(found[0].size)
        return found

    monkeypatch.setattr(ranking.Leaves, "bounds", bounds)
    np.testing.assert_array_equal(ranking.count_above_in(leaves, p, limits, row, place, q), above)
    assert sum(looked) < len(p) * len(leaves.sizes) / 2
    whole = sum(looked)
    looked.clear()
    counts = ranking.count_above_in(leaves, p, limits, row, place, q, 50)
    np.testing.assert_array_equal(np.minimum(counts, 50), np.minimum(above, 50))
    assert sum(looked) < whole / 2


def test_evaluator_stops_counting_misses(spark, factors_of, monkeypatch):
    from tacitrec.plans import evaluate

    p, q, train, test = random_case(40, 900, 3, 21, True)
    train_rows, test_rows = spark.createDataFrame(train, PAIRS), spark.createDataFrame(test, PAIRS)
    ranks = [naive_rank(p[u] @ q.T, {i for user, i in train if user == u}, item) for u, item in test]
    whole = {row["user_idx"]: row["rank"] for row in tr.test_item_rank(factors_of(p), factors_of(q), test_rows, train_rows).collect()}
    assert [whole[u] for u, _ in test] == ranks
    limit = sorted(ranks)[15]
    seen, plain = [], evaluate.hr_ndcg
    monkeypatch.setattr(evaluate, "hr_ndcg", lambda found, top_k: seen.append(found) or plain(found, top_k))
    metrics = tr.Evaluator(test_rows, train_rows, 900, limit)(factors_of(p), factors_of(q)).first()
    hits = [rank for rank in ranks if rank <= limit]
    assert metrics["n"] == 40 and metrics["hr"] == pytest.approx(len(hits) / 40)
    assert metrics["ndcg"] == pytest.approx(sum(1 / np.log2(rank + 1) for rank in hits) / 40)
    found = {row["user_idx"]: row["rank"] for row in seen[0].collect()}
    assert all(found[u] == rank if rank <= limit else limit < found[u] <= rank for (u, _), rank in zip(test, ranks))
    assert sum(found.values()) < sum(ranks)


def test_few_open_leaves_are_held_and_many_rows_are_counted_at_once(monkeypatch):
    """Counts stay exact when the open leaves are scored in several goes, and up to `enough` when told so."""
    from tacitrec.functions import ranking
    from tacitrec.plans.evaluate import COUNTED_AT_ONCE

    assert COUNTED_AT_ONCE > 2048  # a look at a leaf costs the more the fewer rows share it
    rng = np.random.default_rng(12)
    items, users = rng.normal(size=(6000, 4)), rng.normal(size=(300, 4))
    limits = np.quantile(users @ items.T, 0.9, axis=1)
    whole = (users @ items.T > limits[:, None]).sum(1)
    none = np.zeros(0, np.int64)
    for most in (50, 4_000_000):
        monkeypatch.setattr(ranking, "OPEN_AT_ONCE", most)
        leaves = ranking.make_leaves(items, 16)
        np.testing.assert_array_equal(ranking.count_above_in(leaves, users, limits, none, none, items), whole)
        some = ranking.count_above_in(leaves, users, limits, none, none, items, 100)
        np.testing.assert_array_equal(np.minimum(some, 100), np.minimum(whole, 100))
