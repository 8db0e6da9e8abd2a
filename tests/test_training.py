"""Factor updates: published values, the naive rule, layout independence, skew."""

import numpy as np
import pyarrow as pa
import pytest
from conftest import matrix_of

import tacitrec as tr

RELATION = "user_idx bigint, item_idx bigint, r double, w double"


def relation_of(spark, pairs, w=1.0, r=1.0):
    return spark.createDataFrame([(u, i, r, w) for u, i in pairs], RELATION)


def confidence_of(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "item_idx bigint, c double")


def naive_epoch(p, q, rows, c, reg):
    """The update rule entity by entity; `rows` are (user, item, r, w), copies repeated."""
    p, q = p.copy(), q.copy()
    k = p.shape[1]

    def update(x, others, mine, weights, gram, scale):
        for f in range(k):
            top, bottom = 0.0, 0.0
            for (other, r, w), missing in zip(mine, weights):
                v = others[other]
                without = x @ v - x[f] * v[f]
                top += (w * r - (w - missing) * without) * v[f]
                bottom += (w - missing) * v[f] ** 2
            top -= scale * (x @ gram[:, f] - x[f] * gram[f, f])
            x[f] = top / max(bottom + scale * gram[f, f] + reg, 1e-10)

    gram = (q * c[:, None]).T @ q
    for u in sorted({row[0] for row in rows}):
        mine = [(i, r, w) for user, i, r, w in rows if user == u]
        update(p[u], q, mine, [c[i] for i, _, _ in mine], gram, 1.0)
    gram = p.T @ p
    for i in sorted({row[1] for row in rows}):
        mine = [(u, r, w) for u, item, r, w in rows if item == i]
        update(q[i], p, mine, [c[i]] * len(mine), gram, c[i])
    return p, q


def loss(p, q, rows, c, reg):
    total = reg * ((p**2).sum() + (q**2).sum()) + np.einsum("uf,fg,ug->", p, (q * c[:, None]).T @ q, p)
    for u, i, r, w in rows:
        score = p[u] @ q[i]
        total += w * (r - score) ** 2 - c[i] * score**2
    return total


P0 = [[0.5, -0.25], [0.25, 0.5]]
Q0 = [[0.5, 0.25], [-0.25, 0.5], [0.75, -0.5]]
P1 = [[1.4291101055806938, 0.36011914450340166], [-0.4935622317596567, 1.137030289931145]]
Q1 = [
    [0.6322984591791773, 0.26534708827567766], [-0.5213557499368504, 0.6621638797494956],
    [0.7538477649105642, 0.18779375957964933],
]


@pytest.mark.parametrize("hot_degree", [100, 1])
@pytest.mark.parametrize("blocks", [None, 1, 5])
def test_golden_epoch(spark, factors_of, blocks, hot_degree):
    trainer = tr.Trainer(
        relation_of(spark, [(0, 0), (0, 2), (1, 1)]), confidence_of(spark, [0.2, 0.1, 0.3]), 2, 3,
        tr.Params(factors=2, blocks=blocks, hot_degree=hot_degree), (factors_of(P0), factors_of(Q0)),
    )
    result = trainer.fit(1)
    np.testing.assert_allclose(matrix_of(result.users), P1, rtol=1e-12)
    np.testing.assert_allclose(matrix_of(result.items), Q1, rtol=1e-12)

    def best(batch):
        return pa.RecordBatch.from_arrays([pa.array(batch.users), pa.array(batch.scores.max(1))], names=["user_idx", "most"])

    most = tr.predict_all(result.users, result.items, best, "user_idx bigint, most double").groupBy("user_idx").max("most")
    scores = (np.array(P1) @ np.array(Q1).T).max(1)
    np.testing.assert_allclose([row[1] for row in most.orderBy("user_idx").collect()], scores, rtol=1e-12)


def random_case(seed, n_users=23, n_items=17, k=5, n_rows=260):
    rng = np.random.default_rng(seed)
    rows = [
        (int(u), int(i), float(r), float(w))
        for u, i, r, w in zip(
            rng.integers(0, n_users - 2, n_rows), rng.integers(0, n_items - 1, n_rows) ** 2 // n_items,
            rng.uniform(0.2, 2, n_rows), rng.uniform(0.5, 2, n_rows),
        )
    ]
    p, q = rng.normal(0, 0.3, (n_users, k)), rng.normal(0, 0.3, (n_items, k))
    return rows, p, q, rng.uniform(0.05, 0.4, n_items)


@pytest.mark.parametrize("limits", [
    {}, {"blocks": 1}, {"blocks": 13}, {"hot_degree": 7, "blocks": 6}, {"hot_degree": 1, "blocks": 3},
    {"range_entities": 1, "blocks": 2}, {"range_entities": 3, "hot_degree": 7, "blocks": 4}, {"block_entities": 2},
])
def test_epochs_follow_the_rule_on_every_layout(spark, factors_of, limits):
    rows, p, q, c = random_case(1)
    trainer = tr.Trainer(
        spark.createDataFrame(rows, RELATION).repartition(5), confidence_of(spark, c.tolist()),
        len(p), len(q), tr.Params(factors=5, **limits), (factors_of(p), factors_of(q)),
    )
    result = trainer.fit(2)
    for _ in range(2):
        p, q = naive_epoch(p, q, rows, c, 0.01)
    np.testing.assert_allclose(matrix_of(result.users), p, atol=1e-9)
    np.testing.assert_allclose(matrix_of(result.items), q, atol=1e-9)


def test_cold_entities_keep_their_first_vector(spark, factors_of):
    rows, p, q, c = random_case(2)
    result = tr.fit(
        spark.createDataFrame(rows, RELATION), confidence_of(spark, c.tolist()), len(p), len(q),
        tr.Params(factors=5, epochs=2), (factors_of(p), factors_of(q)),
    )
    cold_users = sorted(set(range(len(p))) - {row[0] for row in rows})
    cold_items = sorted(set(range(len(q))) - {row[1] for row in rows})
    assert cold_users and cold_items
    np.testing.assert_array_equal(matrix_of(result.users)[cold_users], p[cold_users])
    np.testing.assert_array_equal(matrix_of(result.items)[cold_items], q[cold_items])


def test_denominator_is_clamped(spark, factors_of):
    trainer = tr.Trainer(
        relation_of(spark, [(0, 0), (0, 0)]), confidence_of(spark, [5.0]), 1, 1,
        tr.Params(factors=1), (factors_of([[0.5]]), factors_of([[1.0]])),
    )
    trainer.user_step()
    np.testing.assert_allclose(matrix_of(trainer.user_factors), [[2e10]])


def test_loss_never_rises(spark, factors_of):
    rows, p, q, c = random_case(3)
    rows = [(u, i, 1.0, 1.0) for u, i, _, _ in rows]
    trainer = tr.Trainer(
        spark.createDataFrame(rows, RELATION), confidence_of(spark, c.tolist()), len(p), len(q),
        tr.Params(factors=5), (factors_of(p), factors_of(q)),
    )
    values = [loss(p, q, rows, c, 0.01)]
    for _ in range(3):
        for step in (trainer.user_step, trainer.item_step):
            step()
            values.append(
                loss(matrix_of(trainer.user_factors), matrix_of(trainer.item_factors), rows, c, 0.01)
            )
    assert all(after <= before + 1e-9 for before, after in zip(values, values[1:]))
    assert values[-1] < values[0]


def test_warm_start(spark, factors_of):
    rows, p, q, c = random_case(4)
    args = (spark.createDataFrame(rows, RELATION), confidence_of(spark, c.tolist()), len(p), len(q))
    params = tr.Params(factors=5)
    at_once = tr.Trainer(*args, params, (factors_of(p), factors_of(q))).fit(3)
    stepwise = tr.Trainer(*args, params, (factors_of(p), factors_of(q)))
    first = stepwise.fit(1)
    before = matrix_of(first.users)
    last = [stepwise.fit(1), stepwise.fit(1)][-1]
    np.testing.assert_array_equal(matrix_of(first.users), before)  # earlier results stay readable
    np.testing.assert_allclose(matrix_of(last.users), matrix_of(at_once.users), atol=1e-12)
    np.testing.assert_allclose(matrix_of(last.items), matrix_of(at_once.items), atol=1e-12)
    assert [row["epoch"] for row in last.history.collect()] == [3]


def test_observed_weight_is_honoured(spark, factors_of):
    train = spark.createDataFrame([(0, 0), (1, 1)], "user_idx bigint, item_idx bigint")
    p, q = np.array(P0), np.array(Q0[:2])
    trainer = tr.Trainer(
        tr.training_relation(train, 3.0), confidence_of(spark, [0.2, 0.1]), 2, 2, tr.Params(factors=2),
        (factors_of(p), factors_of(q)),
    )
    expected = naive_epoch(p, q, [(0, 0, 1.0, 3.0), (1, 1, 1.0, 3.0)], np.array([0.2, 0.1]), 0.01)
    result = trainer.fit(1)
    np.testing.assert_allclose(matrix_of(result.users), expected[0], rtol=1e-12)
    np.testing.assert_allclose(matrix_of(result.items), expected[1], rtol=1e-12)


def test_many_factors(spark, factors_of):
    rng = np.random.default_rng(6)
    k = 100
    rows = [(int(u), int(i), 1.0, 1.0) for u, i in rng.integers(0, 6, (20, 2))]
    p, q, c = rng.normal(0, 0.1, (6, k)), rng.normal(0, 0.1, (6, k)), np.full(6, 0.2)
    result = tr.Trainer(
        spark.createDataFrame(rows, RELATION), confidence_of(spark, c.tolist()), 6, 6,
        tr.Params(factors=k), (factors_of(p), factors_of(q)),
    ).fit(1)
    expected = naive_epoch(p, q, rows, c, 0.01)
    np.testing.assert_allclose(matrix_of(result.items), expected[1], atol=1e-9)


def test_starting_vectors(spark):
    params = tr.Params(factors=8)
    start = matrix_of(tr.initial_factors(spark, "user", 4000, params))
    assert abs(start.mean()) < 3e-4 and start.std() == pytest.approx(0.01, rel=0.02)
    again = matrix_of(tr.initial_factors(spark, "user", 4000, params).repartition(3))
    np.testing.assert_array_equal(start, again)
    other = matrix_of(tr.initial_factors(spark, "item", 4000, params))
    assert abs(np.corrcoef(start.ravel(), other.ravel())[0, 1]) < 0.03


def test_empty_data_fails_with_an_explanation(spark):
    with pytest.raises(ValueError, match="min_interactions"):
        tr.Trainer(relation_of(spark, [(0, 0)]), confidence_of(spark, [1.0]), 0, 0)


def test_infinite_factors_fail(spark, factors_of):
    from pyspark.errors import PythonException

    with pytest.raises(PythonException, match="finite"):
        tr.Trainer(
            relation_of(spark, [(0, 0)]), confidence_of(spark, [0.1]), 1, 1, tr.Params(factors=1),
            (factors_of([[float("nan")]]), factors_of([[1.0]])),
        ).fit(1)


def test_objective_is_the_loss_cell_by_cell(spark, factors_of):
    rows, p, q, c = random_case(5)
    for limits in ({}, {"hot_degree": 6, "blocks": 4, "range_entities": 4}):
        trainer = tr.Trainer(
            spark.createDataFrame(rows, RELATION), confidence_of(spark, c.tolist()), len(p), len(q),
            tr.Params(factors=5, **limits), (factors_of(p), factors_of(q)),
        )
        assert trainer.objective() == pytest.approx([loss(p, q, rows, c, 0.01)])
        for step in (trainer.user_step, trainer.item_step):
            step()
            now = loss(matrix_of(trainer.user_factors), matrix_of(trainer.item_factors), rows, c, 0.01)
            assert trainer.objective() == pytest.approx([now])
        result = trainer.fit(2)
        assert len(result.losses) == 2 and result.losses[1] == pytest.approx(trainer.objective()[0])


@pytest.mark.parametrize("limits", [{}, {"hot_degree": 6, "blocks": 4}, {"range_entities": 5}])
def test_models_that_train_together_are_those_trained_alone(spark, factors_of, limits):
    rows, p, q, c = random_case(6)
    rng = np.random.default_rng(7)
    starts = [(p, q), (rng.normal(0, 0.3, p.shape), rng.normal(0, 0.3, q.shape))]
    weights = [c, c[::-1]]
    relation, params = spark.createDataFrame(rows, RELATION), tr.Params(factors=5, **limits)
    joint = tr.JointTrainer(
        relation, [confidence_of(spark, w.tolist()) for w in weights], len(p), len(q), params,
        [(factors_of(a), factors_of(b)) for a, b in starts],
    ).fit_all(2)
    for result, (a, b), w in zip(joint, starts, weights):
        for _ in range(2):
            a, b = naive_epoch(a, b, rows, w, 0.01)
        np.testing.assert_allclose(matrix_of(result.users), a, atol=1e-9)
        np.testing.assert_allclose(matrix_of(result.items), b, atol=1e-9)
        assert result.losses[-1] == pytest.approx(loss(a, b, rows, w, 0.01))
    joint[0].close()
    assert joint[1].users.count() == len(p)  # the tables go with the last result


def test_training_goes_on_from_its_folder(spark, factors_of, tmp_path):
    rows, p, q, c = random_case(8)
    path = str(tmp_path / "model")
    store = tr.FactorStore(spark, path)
    args = (spark.createDataFrame(rows, RELATION), confidence_of(spark, c.tolist()), len(p), len(q))
    with tr.Trainer(*args, tr.Params(factors=5, reg=0.02), (factors_of(p), factors_of(q))) as trainer:
        store.fit(trainer, 3)
    assert store.epochs() == [2, 3]
    (tmp_path / "model" / "users-000000004-half").mkdir()  # a driver was lost while it wrote the next version
    again = tr.FactorStore(spark, path)
    with again.resume() as trainer:
        assert trainer.epochs_done == 3 and trainer.params.reg == 0.02
        result = again.fit(trainer, 1)
    assert [row["epoch"] for row in result.history.collect()] == [4]
    for _ in range(4):
        p, q = naive_epoch(p, q, rows, c, 0.02)
    users, items = again.factors()
    np.testing.assert_allclose(matrix_of(users), p, atol=1e-9)
    np.testing.assert_allclose(matrix_of(items), q, atol=1e-9)
    with tr.Trainer(*args, tr.Params(factors=5)) as trainer, pytest.raises(ValueError, match="resume"):
        again.fit(trainer, 1)
    with pytest.raises(FileNotFoundError):
        tr.FactorStore(spark, str(tmp_path / "none")).resume()


def test_a_half_step_moves_no_tiles(spark, factors_of):
    """One shuffle, of vectors; the cached tiles are read in place."""
    rows, p, q, c = random_case(9)
    trainer = tr.Trainer(
        spark.createDataFrame(rows, RELATION), confidence_of(spark, c.tolist()), len(p), len(q),
        tr.Params(factors=5, blocks=3), (factors_of(p), factors_of(q)),
    )
    stream = trainer._stream(trainer.user_blocks, trainer.items, trainer.users).applyInArrow(lambda table: table, "block int")
    plan = stream._jdf.queryExecution().executedPlan().toString()
    own = plan[:plan.index("InMemoryRelation")]
    assert "Exchange" not in own and "Sort" in own


def test_memory_does_not_grow_with_pairs():
    """A block's task holds one range of vectors and its sums, however many pairs stream through."""
    import tracemalloc

    from tacitrec.operators.blocks import SOURCE, TARGET, TILE, Tile
    from tacitrec.plans.train import _BlockWork

    k, n_targets, per_range = 8, 50, 400
    rng = np.random.default_rng(1)

    def row(place, role, idx, payload):
        return pa.RecordBatch.from_arrays(
            [pa.array([0], pa.int32()), pa.array([place], pa.int32()), pa.array([role], pa.int32()), pa.array([idx], pa.int64()), pa.array([payload], pa.binary())],
            names=["block", "rng", "role", "idx", "payload"],
        )

    def peak(n_ranges):
        work = _BlockWork(k, 1, 0.01, np.zeros((1, k, k)), False)
        tracemalloc.start()
        for i in range(n_targets):
            work.take(row(-1, TARGET, i, rng.normal(size=k + 1).tobytes()))
        for place in range(n_ranges):
            sources = np.arange(place * per_range, (place + 1) * per_range)
            for i in sources:
                work.take(row(place, SOURCE, i, rng.normal(size=k + 1).tobytes()))
            tile = Tile(False, np.arange(n_targets), np.full(n_targets, per_range), np.tile(sources, n_targets), *rng.uniform(size=(3, n_targets * per_range)))
            work.take(row(place, TILE, None, tile.packed()))
        rows = list(work.finish())
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sum(len(r) for r in rows) == n_targets + 1
        return top

    assert peak(12) < 1.2 * peak(3)


def test_rows_out_of_order_stop_the_job():
    from tacitrec.plans.train import _BlockWork

    work = _BlockWork(1, 1, 0.01, np.zeros((1, 1, 1)), True)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([0, 0], pa.int32()), pa.array([0, -1], pa.int32()), pa.array([3, 0], pa.int32()), pa.array([0, 0]), pa.array([bytes(16)] * 2)],
        names=["block", "rng", "role", "idx", "payload"],
    )
    with pytest.raises(ValueError, match="order"):
        work.take(batch)


def test_a_given_number_of_blocks_does_not_let_a_block_grow(spark):
    relation = spark.range(400).selectExpr("id % 50 as user_idx", "id % 7 as item_idx", "1D as r", "1D as w")
    layout = tr.plans.train.Layout(relation, tr.Params(blocks=3, block_entities=10))
    assert (layout.user_blocks.n_blocks, layout.item_blocks.n_blocks) == (5, 3)
    layout.close()


def test_many_vectors_travel_in_one_row(spark, factors_of):
    """A row for each range of each block, and every entity to each block that needs it, once."""
    from tacitrec.operators.blocks import SOURCE, TARGET
    from tacitrec.plans.train import unpack_vectors

    rows, p, q, c = random_case(10, n_users=60, n_items=50, n_rows=2000)
    trainer = tr.Trainer(
        spark.createDataFrame(rows, RELATION), confidence_of(spark, c.tolist()), len(p), len(q),
        tr.Params(factors=5, blocks=3, range_entities=20), (factors_of(p), factors_of(q)),
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        stream = trainer._stream(trainer.user_blocks, trainer.items, trainer.users).applyInArrow(lambda table: table, "block int, rng int, role int, idx bigint, payload binary")
        sent = stream.filter(f"role in ({SOURCE}, {TARGET})").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    found = {SOURCE: [], TARGET: []}
    for row in sent:
        idx, weights, vec = unpack_vectors(bytes(row["payload"]), 1)
        for i, weight, v in zip(idx.tolist(), weights, vec):
            assert row["rng"] == (i // 20 if row["role"] == SOURCE else -1)
            np.testing.assert_array_equal(v, (q if row["role"] == SOURCE else p)[i])
            assert weight[0] == (c[i] if row["role"] == SOURCE else 1)
            found[row["role"]].append((row["block"], i))
    assert sorted(i for _, i in found[TARGET]) == list(range(len(p)))
    home = {i: block for block, i in found[TARGET]}
    assert sorted(found[SOURCE]) == sorted({(home[u], i) for u, i, _, _ in rows})
    assert len(sent) < len(found[SOURCE]) / 2


def test_tiles_take_few_bytes_and_come_back_whole():
    from tacitrec.operators.blocks import Tile

    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 9, 2000)
    n = int(sizes.sum())
    ones, some = np.ones(n), rng.uniform(size=n)
    tile = Tile(True, np.arange(2000) * 7 + 2**41, sizes, rng.integers(2**34, 2**34 + 9000, n), ones, ones, ones)
    assert len(tile.packed()) < 4 * n
    for first in (tile, Tile(False, tile.dst, sizes, tile.src, ones, some, some * 2)):
        again = Tile.unpacked(first.packed())
        assert again.hot == first.hot
        for name in ("dst", "sizes", "src", "n", "sw", "swr"):
            np.testing.assert_array_equal(getattr(again, name), getattr(first, name))


def test_blocks_hold_as_many_entities_as_a_task_has_room_for():
    """Fewer blocks mean fewer copies of each vector; what a task holds stays bounded."""
    for k in (1, 2, 8, 64, 200):
        for models in (1, 3):
            params = tr.Params(factors=k)
            block, partners = params.entities_of_block(models), params.entities_of_range(models)
            assert block == 4096 or 8 * k * (k + 1) * models * block <= 1 << 26
            assert partners == 65_536 or 8 * (k + 1) * models * partners <= 1 << 26
    assert tr.Params(factors=8).entities_of_block() > 100_000
    assert tr.Params(factors=8, block_entities=7).entities_of_block(2) == 7


def test_pairs_travel_in_packed_rows_and_entities_stay_whole(spark):
    """One row for each cell of a block, whatever the number of pairs; only hot entities are cut."""
    from tacitrec.operators import blocks as b

    rng = np.random.default_rng(11)
    dst, src = (x.astype(np.int64) for x in np.unravel_index(rng.permutation(40 * 900)[:30_000], (40, 900)))
    numbers = rng.uniform(size=(3, len(dst)))
    keys = (5, 0, 9)
    placed = b.Placed(None, None, keys, 300, False, None, 900, len(dst), spark.range(1))
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in (dst, src, *numbers)], names=["dst", "src", "n", "sw", "swr"])
    for n_parts in (1, 2):
        sent = list(b._send_pairs(3, n_parts, placed.places())(batch.slice(i, 1000) for i in range(0, len(batch), 1000)))
        assert sum(map(len, sent)) == 3 * 3 * n_parts
        found, owners = [], {}
        for key in keys:
            mine = [row for row in sent[0].to_pylist() if row["block"] == key]
            mine = pa.RecordBatch.from_pylist(sorted(mine, key=lambda row: row["cell"]), sent[0].schema)
            ranges = []
            for number, tile_row in enumerate(b._pack(n_parts)([mine.slice(0, 1), mine.slice(1)])):
                row = tile_row.to_pylist()[0]
                tile = b.Tile.unpacked(row["payload"])
                ranges.append(row["rng"])
                owner = np.repeat(tile.dst, tile.sizes)
                assert row["block"] == key and (tile.src // 300 == row["rng"]).all() and not tile.hot
                for entity in tile.dst.tolist():
                    assert owners.setdefault((entity, row["rng"]), (key, number)) == (key, number)
                found += zip(owner.tolist(), tile.src.tolist(), tile.n.tolist(), tile.sw.tolist(), tile.swr.tolist())
            assert ranges == sorted(ranges)
        assert sorted(found) == sorted(zip(dst.tolist(), src.tolist(), *numbers.tolist()))
    hot = list(b._tiles(1, 0, True, np.zeros(20_000, np.int64), np.arange(20_000), [np.ones(20_000)] * 3))
    parts = [b.Tile.unpacked(row.to_pylist()[0]["payload"]) for row in hot]
    assert max(len(part.src) for part in parts) <= b.TILE_PAIRS and all(len(part.dst) == 1 for part in parts)
    assert np.concatenate([part.src for part in parts]).tolist() == list(range(20_000))
