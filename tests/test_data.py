"""Ratings, sampling, k-core, encoding, split and confidence."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import tacitrec as tr
from tacitrec.operators.sample import row_digest, smallest_digests
from tacitrec.sources.ratings import read_ratings, write_ratings
from tacitrec.tables import drop_table, write_table


def rows_of(df, *columns):
    return sorted(tuple(row) for row in df.select(*columns).collect())


# --- ratings files ------------------------------------------------------------------

def write_lines(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_ratings_scan_has_the_declared_schema(spark, tmp_path):
    path = write_lines(tmp_path / "r.csv", "kim,tent,2.5,7001", "ada,kite,,6900")
    ratings = read_ratings(spark, path)
    assert ratings.dtypes == [
        ("user_id", "string"), ("item_id", "string"), ("rating", "double"), ("timestamp", "bigint"),
    ]
    kept = tr.interactions(ratings)
    assert kept.columns == ["user_id", "item_id", "timestamp"]
    assert kept.count() == 2  # a null rating does not drop the row


@pytest.mark.parametrize("token", ["NA", "null", "", "NaN", "None"])
def test_spellings_of_missing_ids_are_dropped(spark, tmp_path, token):
    path = write_lines(tmp_path / "r.csv", f"ada,{token},1.0,40", "kim,tent,2.5,30", f"{token},kite,4.0,20")
    assert rows_of(tr.interactions(read_ratings(spark, path)), "user_id") == [("kim",)]


@pytest.mark.parametrize("token", ["NA", "null", "", "NaN"])
def test_spellings_of_missing_ratings_are_null(spark, tmp_path, token):
    path = write_lines(tmp_path / "r.csv", f"zoe,kite,{token},77", "kim,tent,2.5,78")
    assert [row["rating"] for row in read_ratings(spark, path).orderBy("user_id").collect()] == [2.5, None]


@pytest.mark.parametrize("line", [
    "u1,i1,5.0,abc", "u1,i1,5.0,1.5", "u1,i1,5.0", "u1,i1,5.0,", "u1,i1,abc,5", "u1,i1,5.0,5,6", "u1,i1,5d,5", "u1,i1,5.0,NA",
])
@pytest.mark.parametrize("use", [
    lambda ratings: tr.interactions(ratings).collect(),
    lambda ratings: ratings.count(),
    lambda ratings: ratings.select("item_id").collect(),
    lambda ratings: ratings.collect(),
])
def test_malformed_lines_fail_whatever_is_selected(spark, tmp_path, line, use):
    path = write_lines(tmp_path / "r.csv", "u0,i0,1.0,1", line)
    with pytest.raises((PySparkException, Py4JError)):
        use(read_ratings(spark, path))


def test_quoted_ids(spark, tmp_path):
    path = write_lines(tmp_path / "r.csv", '"x""y","a,b",5.0,100', "plain,back\\slash,1,2")
    assert rows_of(read_ratings(spark, path), "user_id", "item_id") == [("plain", "back\\slash"), ('x"y', "a,b")]


def test_ratings_round_trip(spark, tmp_path):
    rows = [("u1", "i1", 5.0, 100), ("u,2", 'i"2', 0.5, 101)]
    ratings = spark.createDataFrame(rows, "user_id string, item_id string, rating double, timestamp bigint")
    write_ratings(ratings, str(tmp_path / "out"))
    assert rows_of(read_ratings(spark, str(tmp_path / "out")), "*") == sorted(rows)


# --- k-core -------------------------------------------------------------------------

def test_core_counts_rows_not_partners(interactions_of):
    rows = [("ann", "p", t) for t in (3, 1, 2)] + [("ann", "q", t) for t in (9, 8, 7)]
    core = tr.kcore(interactions_of([*rows, ("bob", "p", 4), ("bob", "q", 5)]), 3)
    assert core.n_rows == 6
    assert rows_of(core.rows, "*") == sorted(rows)


def test_core_cascades(interactions_of):
    """A ring of three readers and three books stays; a tail that hangs on it comes off link by link."""
    ring = [("a", "p", 1), ("a", "q", 2), ("b", "q", 3), ("b", "r", 4), ("c", "r", 5), ("c", "p", 6)]
    tail = [("d", "p", 7), ("d", "x", 8), ("e", "x", 9), ("e", "y", 10)]
    core = tr.kcore(interactions_of(tail + ring), 2)
    assert rows_of(core.rows, "*") == sorted(ring)
    assert (core.passes, core.n_rows, core.n_users, core.n_items) == (5, 6, 3, 3)


def test_core_may_be_empty(interactions_of):
    core = tr.kcore(interactions_of([("a", "p", 1), ("b", "q", 2), ("b", "r", 3)]), 4)
    assert core.is_empty and core.rows.count() == 0
    assert (core.passes, core.n_users, core.n_items) == (2, 0, 0)
    assert core.rows.columns == ["user_id", "item_id", "timestamp"]


def test_core_over_many_passes(interactions_of):
    """More passes than lie between two rewrites of the pairs."""
    chain = [(f"u{n}", f"i{n + d}", n) for n in range(23) for d in (0, 1)]
    ring = [("a", "p", 1), ("a", "q", 2), ("b", "q", 3), ("b", "p", 4)]
    expected, passes = naive_core(chain + ring, 2)
    core = tr.kcore(interactions_of(chain + ring), 2)
    assert rows_of(core.rows, "*") == sorted(expected) == sorted(ring)
    assert core.passes == passes > 20


def test_a_pass_reads_the_buckets_of_its_frontier(spark):
    from tacitrec.operators.kcore import MOST_BUCKETS, _bucket, _Falling, _write_pairs

    rows = spark.range(400).select(
        (F.col("id") % 40).cast("string").alias("user_id"), (F.col("id") % 50).cast("string").alias("item_id"), F.lit(1).cast("bigint").alias("n")
    )
    pairs, found = _write_pairs(rows, bucketed=True)
    assert (found["pairs"], found["n"], found["nulls"]) == (400, 400, 0)
    number = spark.range(1).select(F.lit("7").alias("k")).select(_bucket("k", MOST_BUCKETS)).first()[0]
    keys = spark.createDataFrame([("7",)], "user_id string")
    for ids in ({}, {"user": ["7"]}):
        read = pairs.of("user", "user_id", _Falling(1, 10, {"user": [number]}, ids, {}), keys)
        assert read.count() == 10
        plan = read._jdf.queryExecution().executedPlan().toString()
        assert "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert pairs.sides["user"].filter(F.col("bucket") == number % pairs.buckets).count() < 400 // 2
    pairs.close(spark)


def naive_core(rows, k):
    passes = 0
    while True:
        passes += 1
        users, items = {}, {}
        for user, item, _ in rows:
            users[user] = users.get(user, 0) + 1
            items[item] = items.get(item, 0) + 1
        kept = [
            row for row in rows
            if row[0] is not None and row[1] is not None and users[row[0]] >= k and items[row[1]] >= k
        ]
        if len(kept) == len(rows):
            return kept, passes
        rows = kept


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.tuples(st.integers(0, 12), st.integers(0, 9)), min_size=1, max_size=120),
    st.integers(1, 5),
)
def test_core_equals_the_naive_loop(interactions_of, pairs, k):
    rows = [(f"u{user}" if user else None, f"i{item}", t) for t, (user, item) in enumerate(pairs)]
    core = tr.kcore(interactions_of(rows), k)
    expected, passes = naive_core(rows, k)
    assert sorted(tuple(row) for row in core.rows.collect()) == sorted(expected)
    assert core.passes == passes and core.n_rows == len(expected)


# --- sampling -----------------------------------------------------------------------

def test_sample_is_repeatable_and_exact(interactions_of):
    rows = interactions_of([(f"r{i % 11}", f"m{i // 4}", 1000 - i) for i in range(44)])
    first = tr.sample_exact(rows, 0.25, rows.columns, 6)
    assert first.count() == 11
    assert rows_of(first, "*") == rows_of(tr.sample_exact(rows.repartition(7), 0.25, rows.columns, 6), "*")
    assert rows_of(first, "*") != rows_of(tr.sample_exact(rows, 0.25, rows.columns, 7), "*")
    assert tr.sample_exact(rows, 1.0, rows.columns).count() == 44


@pytest.mark.parametrize("n, expected", [(1, 0), (3, 2), (5, 2), (7, 4), (9, 4)])
def test_sample_size_rounds_halves_to_even(interactions_of, n, expected):
    rows = interactions_of([(f"u{i}", "i", i) for i in range(n)])
    assert tr.sample_exact(rows, 0.5, rows.columns).count() == expected


@pytest.mark.parametrize("n", [1, 37, 500, 999, 1000, 1200])
def test_sample_equals_a_sort(spark, monkeypatch, n):
    import tacitrec.operators.sample as sample

    rows = spark.range(1000).select(F.col("id").cast("string").alias("user_id"))
    by_sort = rows.orderBy(row_digest(["user_id"], 7)).limit(n).collect()
    for step in (1, 3):
        monkeypatch.setattr(sample, "PREFIX_STEP", step)
        assert rows_of(smallest_digests(rows, n, ["user_id"], 7), "user_id") == sorted(tuple(r) for r in by_sort)


def test_sample_with_very_many_copies_of_a_row(spark):
    rows = spark.range(300).select(F.when(F.col("id") < 200, 0).otherwise(F.col("id")).alias("user_id"))
    taken = smallest_digests(rows, 150, ["user_id"], 7).collect()
    counts = {}
    for row in taken:
        counts[row["user_id"]] = counts.get(row["user_id"], 0) + 1
    assert len(taken) == 150
    assert all(count == 1 for user, count in counts.items() if user)


@pytest.mark.parametrize("fraction, size", [(0.5, 3), (0.34, 2), (0.2, 1), (0.84, 5)])
def test_sample_size_with_ids_that_read_alike(spark, fraction, size):
    rows = [("a|b", "c", n) for n in range(2)] + [("a", "b|c", n) for n in range(2)] + [(None, "x", 1), ("", "x", 1)]
    table = spark.createDataFrame(rows, "user_id string, item_id string, n int")
    for key in (["user_id", "item_id"], ["n"], table.columns):
        taken = tr.sample_exact(table, fraction, key)
        assert taken.count() == size and set(rows_of(taken.fillna("-"), "n")) <= {(0,), (1,)}
    assert taken.distinct().count() == size


# --- encoding -----------------------------------------------------------------------

def test_dictionary_numbers_strings_in_code_point_order(interactions_of):
    ids = ["10", "2", "é", "Z", "a", "1", "\U0001F600", "�", "10"]
    encoded = tr.encode_ids(interactions_of([(u, "i", 0) for u in ids]))
    users = {row["id"]: row["idx"] for row in encoded.users.collect()}
    assert users == {u: n for n, u in enumerate(sorted(set(ids)))}
    assert (encoded.n_users, encoded.n_items) == (8, 1)


def test_empty_inputs(interactions_of):
    some = interactions_of([("u", "i", 1)])
    for none in (some.limit(0), some.filter("timestamp > 5"), some.filter("timestamp > 5").repartition(3), some.join(some.filter("timestamp > 5"), "user_id", "left_semi")):
        assert tr.sample_exact(none, 0.5, none.columns).count() == 0
        assert smallest_digests(none, 3, none.columns).count() == 0
        core = tr.kcore(none, 2)
        assert (core.rows.count(), core.n_rows, core.n_users, core.n_items, core.passes) == (0, 0, 0, 0, 1)
        encoded = tr.encode_ids(none)
        assert (encoded.rows.count(), encoded.n_users, encoded.n_items) == (0, 0, 0)


def test_encode_is_dense_and_consistent(interactions_of):
    encoded = tr.encode_ids(interactions_of([("mia", "lamp", 8), ("leo", "sofa", 6), ("leo", "desk", 7), ("mia", "desk", 9)]))
    assert rows_of(encoded.rows, "user_id", "item_id", "user_idx", "item_idx") == [
        ("leo", "desk", 0, 0), ("leo", "sofa", 0, 2), ("mia", "desk", 1, 0), ("mia", "lamp", 1, 1),
    ]
    back = tr.decode(encoded.rows.select("user_idx", "item_idx"), encoded.users, encoded.items)
    assert rows_of(back, "user_id", "item_id") == [("leo", "desk"), ("leo", "sofa"), ("mia", "desk"), ("mia", "lamp")]


def test_dictionary_over_many_partitions(spark):
    rows = spark.range(5000).select(F.format_string("u%d", F.col("id") % 1777).alias("user_id"))
    numbered, n = tr.id_dictionary(rows.repartition(13), "user_id")
    expected = {u: i for i, u in enumerate(sorted(f"u{i}" for i in range(1777)))}
    assert n == 1777
    assert {row["id"]: row["idx"] for row in numbered.collect()} == expected


# --- split --------------------------------------------------------------------------

SPLIT = "user_idx bigint, item_idx bigint, timestamp bigint"


def test_last_row_is_held_out(spark):
    rows = [(4, 7, 50), (4, 9, 90), (4, 5, 70), (4, 1, 10)]
    train, test = tr.leave_one_out(spark.createDataFrame(rows, SPLIT))
    assert rows_of(test, "item_idx") == [(9,)]
    assert rows_of(train, "item_idx") == [(1,), (5,), (7,)]


def test_split_is_disjoint_and_complete(spark):
    rows = [(6, 8, 9), (2, 8, 5), (7, 3, 1), (6, 1, 7), (2, 3, 4), (6, 2, 8)]
    train, test = tr.leave_one_out(spark.createDataFrame(rows, SPLIT))
    assert rows_of(train, "*") == [(2, 3, 4), (6, 1, 7), (6, 2, 8)]
    assert rows_of(test, "*") == [(2, 8, 5), (6, 8, 9), (7, 3, 1)]


def test_one_of_several_copies_is_held_out(spark):
    rows = [(0, 7, 5)] * 4 + [(0, 6, 5), (1, 1, 1), (2, 3, 9), (2, 3, 8)]
    train, test = tr.leave_one_out(spark.createDataFrame(rows, SPLIT))
    assert rows_of(test, "*") == [(0, 7, 5), (1, 1, 1), (2, 3, 9)]
    assert rows_of(train, "*") == [(0, 6, 5)] + [(0, 7, 5)] * 3 + [(2, 3, 8)]


def test_a_user_over_many_partitions(spark):
    """A third of the rows are one user's; the split equals the greatest row per user."""
    from pyspark.sql import Window

    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that small partitions stay apart
    try:
        rows = spark.range(900).select(
            F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 11).alias("user_idx"),
            (F.xxhash64("id") % 50).alias("item_idx"), (F.xxhash64("id", F.lit(1)) % 400).alias("timestamp"),
        ).withColumn("copy", F.lit(None).cast("string"))
        train, test = tr.leave_one_out(rows.repartition(6))
        place = Window.partitionBy("user_idx").orderBy(F.desc("timestamp"), F.desc("item_idx"))
        expected = rows.withColumn("place", F.row_number().over(place))
        assert sorted(map(tuple, test.drop("copy").collect())) == sorted(map(tuple, expected.filter("place = 1").drop("place", "copy").collect()))
        assert sorted(map(tuple, train.drop("copy").collect())) == sorted(map(tuple, expected.filter("place > 1").drop("place", "copy").collect()))
        plan = train._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan
        assert train.filter("user_idx = 5").select(F.input_file_name()).distinct().count() > 1  # spread
        empty_train, empty_test = tr.leave_one_out(rows.limit(0))
        assert empty_train.count() == empty_test.count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


# --- confidence ---------------------------------------------------------------------

def confidences(spark, items, n_items, c0, alpha):
    train = spark.createDataFrame([(i,) for i in items], "item_idx bigint")
    return [row["c"] for row in tr.item_confidence(train, n_items, c0, alpha).orderBy("item_idx").collect()]


def test_uniform_confidence(spark):
    assert confidences(spark, [1, 3, 1, 0, 1], 4, 20.0, 0) == [5.0, 5.0, 5.0, 5.0]


@pytest.mark.parametrize("items, n_items, c0, alpha", [
    ([4, 4, 4, 1, 0, 1], 5, 12.0, 0.5), ([2, 2, 0], 3, 7.0, 1.0), ([0, 3, 3, 3, 3, 1, 1, 2], 4, 100.0, 0.3),
])
def test_popularity_confidence(spark, items, n_items, c0, alpha):
    share = [max(items.count(i) / len(items), 1e-12) ** alpha for i in range(n_items)]
    weights = confidences(spark, items, n_items, c0, alpha)
    assert weights == pytest.approx([c0 * s / sum(share) for s in share], rel=1e-9)
    assert sum(weights) == pytest.approx(c0)


def test_confidence_tends_to_uniform(spark):
    assert confidences(spark, [0, 1, 1], 2, 8.0, 1e-12) == pytest.approx(confidences(spark, [0, 1, 1], 2, 8.0, 0))


# --- preparation --------------------------------------------------------------------

def test_preparing_nothing_fails_with_an_explanation(interactions_of):
    rows = interactions_of([("a", "p", 1), ("b", "q", 2), ("b", "r", 3)])
    with pytest.raises(ValueError, match="min_interactions"):
        tr.prepare(rows, tr.Params(min_interactions=4))


def test_summaries(spark):
    train = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 3)], SPLIT)
    test = spark.createDataFrame([(0, 2, 9), (1, 1, 9), (2, 0, 9)], SPLIT)
    own = tr.dataset_summary(train, test).first()
    assert tuple(own) == (2, 2, 3, 3, 0.25)
    encoded = tr.dataset_summary_encoded(train, test, 3, 3).first()
    assert tuple(encoded)[:4] == (3, 3, 3, 3)
    assert encoded["sparsity"] == pytest.approx(1 - 3 / 9)


def test_encoding_computes_its_input_once(spark, interactions_of):
    rows = interactions_of([("a", "x", 1), ("b", "y", 2), ("a", "y", 3)])
    encoded = tr.encode_ids(rows.join(rows.select("timestamp"), "timestamp"))
    assert encoded.rows.count() == 3
    plan = encoded.rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 4  # two for each dictionary; the join of the input was written before
    drop_table(encoded.staged)


def _split_tables(spark, rows, monkeypatch):
    """The split of a data set, decoded, and the names of the tables that were written for it."""
    from tacitrec.operators import encode, split
    from tacitrec.plans import experiment

    names = []
    for module in (encode, split, experiment):
        monkeypatch.setattr(module, "write_table", lambda df, name, *a: names.append(name) or write_table(df, name, *a))
    data = experiment.split_dataset(rows, ["timestamp", "place"])
    assert data.train.columns == data.test.columns == ["timestamp", "place", "note", "user_idx", "item_idx"]
    found = [
        sorted(map(repr, tr.decode(part, data.users, data.items).collect())) for part in (data.train, data.test)
    ]
    data.close()
    return found, names


def test_split_writes_the_encoded_rows_once(spark, monkeypatch):
    from tacitrec.operators import encode

    rows = spark.createDataFrame(
        [
            ("a", "x", 5, None, "n"), ("a", "y", 5, 1, None), ("a", "y", 5, 1, "k"), ("a", "y", 5, 1, "k"),
            ("b", "x", 1, None, "n"), ("b", "x", 1, None, "n"), ("c", "z", 2, 7, "m"), (None, "z", 3, 7, "m"),
            *[("d", f"i{n % 7}", n // 3, n % 2, "p") for n in range(40)],
        ],
        "user_id string, item_id string, timestamp bigint, place int, note string",
    )
    found, names = _split_tables(spark, rows, monkeypatch)
    assert "encoded" not in names  # the rows go from the last dictionary straight into the split
    assert [len(part) for part in found] == [43, 4]
    monkeypatch.setattr(encode, "found_heavy", lambda *_: ["d"])
    spread, names = _split_tables(spark, rows, monkeypatch)
    assert "encoded" in names and spread == found  # very frequent users are spread, with the same result


def test_order_lines_meet_their_orders_with_little_baggage(spark, tmp_path):
    from tacitrec.sources.star import order_line_ratings

    spark.sql(
        "select * from values (1L, 7L, timestamp'2001-02-03 04:05:06.75'), (2L, null, null), (3L, 8L, timestamp'1969-12-31 23:59:59.5')"
        " as t(o_orderkey, o_custkey, o_orderdate)"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql(
        "select * from values (1L, 5L, 1, 2.0D, 10.125D), (1L, null, 2, null, null), (2L, 6L, 1, 1.0D, 3.0D), (3L, 5L, 1, 1.0D, -0.01D),"
        " (4L, 5L, 1, 1.0D, 1.0D), (null, 5L, 1, 1.0D, 1.0D) as t(l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice)"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = order_line_ratings(spark, str(tmp_path))
    second = spark.sql("select unix_micros(timestamp'2001-02-03 04:05:06') div 1000000").first()[0]
    before = spark.sql("select floor(unix_micros(timestamp'1969-12-31 23:59:59.5') / 1000000)").first()[0]
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([
        ("7", "5", 2.0, second, 1, 1, 1013), ("7", None, None, second, 1, 2, None),
        (None, "6", 1.0, None, 2, 1, 300), ("8", "5", 1.0, before, 3, 1, -1),
    ], key=str)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("AS cents") and plan.index("Join Inner") < plan.index("AS timestamp")
