"""One Spark query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tacitrec as tr
from checks.inputs import (
    EVENTS_K,
    LINE_KEY,
    LINE_ORDER,
    LINES_EMPTY_K,
    LINES_K,
    event_data,
    events,
    grid_factors,
    history,
    history_with_gaps,
    line_data,
    lines,
    rounded,
    spread,
)
from tacitrec.functions.vectors import packed
from tacitrec.operators.gram import gram
from tacitrec.operators.relation import group_sizes, with_confidence
from tacitrec.operators.sample import smallest_digests
from tacitrec.plans.evaluate import eval_subsample, seen_items
from tacitrec.plans.experiment import train_variant
from tacitrec.sources.history import read_history, write_history
from tacitrec.sources.ratings import read_ratings, write_ratings
from tacitrec.sources.star import order_line_ratings
from tacitrec.tables import new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TOP_K = 100
TOP_N = 10
ONE_USER = 0
EVAL_USERS = 500


def query(function: Query) -> Query:
    """Register a query under its name; a final underscore avoids the name of an import."""
    QUERIES[function.__name__.rstrip("_")] = function
    return function


# --- sources, interactions, sampling ------------------------------------------------

@query
def interactions(spark, sf_dir):
    return lines(spark, sf_dir)


@query
def interactions_events(spark, sf_dir):
    return events(spark, sf_dir)


@query
def ratings_csv(spark, sf_dir):
    path = new_path(spark, "ratings-csv")
    rows = order_line_ratings(spark, sf_dir)
    quoted = F.when(F.col("order_key") % 5 == 0, F.concat(F.lit('a"b""c,'), "user_id")).otherwise(F.col("user_id"))
    write_ratings(
        rows.withColumn("user_id", quoted)
        .withColumn("item_id", F.when(F.col("order_key") % 7 != 0, F.col("item_id")))
        .withColumn("rating", F.when(F.col("line_number") % 3 != 0, F.col("rating"))),
        path,
    )
    return read_ratings(spark, path)


@query
def training_relation(spark, sf_dir):
    return tr.training_relation(line_data(spark, sf_dir).train)


@query
def train_preview(spark, sf_dir):
    data = line_data(spark, sf_dir)
    rows = tr.preview(data.train, 20, "order_key", "line_number", "item_idx", "cents")
    return rows.select("user_idx", "item_idx", "timestamp", "order_key", "line_number", "cents")


@query
def sample_exact(spark, sf_dir):
    return tr.sample_exact(lines(spark, sf_dir), 0.2, LINE_KEY)


@query
def sample_exact_half(spark, sf_dir):
    return tr.sample_exact(lines(spark, sf_dir), 0.5, LINE_KEY)


@query
def sample_exact_collisions(spark, sf_dir):
    """Ids that read alike once they are joined, among them null and the empty string."""
    ids = F.inline(F.array(*[
        F.struct(user.alias("user_id"), item.alias("item_id"))
        for user, item in (
            (F.concat_ws("|", "user_id", "item_id"), F.lit("c")),
            (F.col("user_id"), F.concat("item_id", F.lit("|c"))),
            (F.lit(None).cast("string"), F.col("item_id")),
            (F.lit(""), F.col("item_id")),
        )
    ]))
    rows = lines(spark, sf_dir).select(ids, "order_key", "line_number", "cents")
    return tr.sample_exact(rows, 0.34, ["user_id", "item_id"])


@query
def sample_exact_repeats(spark, sf_dir):
    """A key that names many rows."""
    return tr.sample_exact(lines(spark, sf_dir), 0.3, ["user_id"])


# --- k-core -------------------------------------------------------------------------

@query
def user_item_counts(spark, sf_dir):
    return tr.interaction_counts(lines(spark, sf_dir))


@query
def kcore_single_pass(spark, sf_dir):
    return tr.kcore_pass(lines(spark, sf_dir), LINES_K)


@query
def kcore(spark, sf_dir):
    return tr.kcore(lines(spark, sf_dir), LINES_K).rows


@query
def kcore_events(spark, sf_dir):
    return tr.kcore(events(spark, sf_dir), EVENTS_K).rows


def _kcore_stats(rows: DataFrame, k: int) -> DataFrame:
    core = tr.kcore(rows, k)
    return core.rows.agg(
        F.lit(core.passes).cast("bigint").alias("passes"),
        F.count("*").alias("n_rows"),
        F.countDistinct("user_id").alias("n_users"),
        F.countDistinct("item_id").alias("n_items"),
        F.lit(core.n_rows).cast("bigint").alias("loop_rows"),
        F.lit(core.n_users).cast("bigint").alias("loop_users"),
        F.lit(core.n_items).cast("bigint").alias("loop_items"),
    )


@query
def kcore_stats(spark, sf_dir):
    return _kcore_stats(lines(spark, sf_dir), LINES_K)


@query
def kcore_empty(spark, sf_dir):
    return _kcore_stats(lines(spark, sf_dir), LINES_EMPTY_K)


@query
def kcore_many_passes(spark, sf_dir):
    """A chain that falls apart one link per pass, beside a dense core."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("n"))
    chain = nations.select("n", F.explode(F.array(F.lit(0), F.lit(1))).alias("d")).select(
        F.concat(F.lit("u"), F.col("n").cast("string")).alias("user_id"),
        F.concat(F.lit("i"), (F.col("n") + F.col("d")).cast("string")).alias("item_id"),
    )
    dense = orders.select("o_custkey").distinct().select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("user_id"),
        F.explode(F.transform(
            F.array(F.lit(0), F.lit(1), F.lit(2)),
            lambda d: F.concat(F.lit("d"), (F.col("o_custkey") % 10 + d).cast("string")),
        )).alias("item_id"),
    )
    core = tr.kcore(chain.unionByName(dense), 2)
    return core.rows.withColumn("passes", F.lit(core.passes).cast("bigint"))


# --- encoding, split ----------------------------------------------------------------

@query
def id_dictionary_user(spark, sf_dir):
    return tr.id_dictionary(lines(spark, sf_dir), "user_id")[0]


@query
def id_dictionary_item(spark, sf_dir):
    return tr.id_dictionary(lines(spark, sf_dir), "item_id")[0]


@query
def encode_ids(spark, sf_dir):
    return tr.encode_ids(lines(spark, sf_dir)).rows


@query
def cardinalities(spark, sf_dir):
    encoded = tr.encode_ids(lines(spark, sf_dir))
    return encoded.users.agg(
        F.count("*").alias("n_users"), encoded.items.agg(F.count("*")).scalar().alias("n_items")
    )


@query
def loo_test(spark, sf_dir):
    return line_data(spark, sf_dir).test


@query
def loo_train(spark, sf_dir):
    return line_data(spark, sf_dir).train


@query
def loo_test_events(spark, sf_dir):
    return event_data(spark, sf_dir).test


# --- confidence, summaries ----------------------------------------------------------

@query
def item_popularity(spark, sf_dir):
    data = line_data(spark, sf_dir)
    return tr.item_popularity(data.train, data.n_items).select("item_idx", rounded("f", 12).alias("f"))


def _confidence(data, alpha: float) -> DataFrame:
    return tr.item_confidence(data.train, data.n_items, 64.0, alpha)


@query
def item_confidence_uniform(spark, sf_dir):
    return _confidence(line_data(spark, sf_dir), 0.0).select("item_idx", rounded("c", 9).alias("c"))


@query
def item_confidence_pop(spark, sf_dir):
    return _confidence(line_data(spark, sf_dir), 0.5).select("item_idx", rounded("c", 9).alias("c"))


@query
def item_confidence_stats(spark, sf_dir):
    stats = tr.confidence_stats(_confidence(line_data(spark, sf_dir), 0.5))
    return stats.select(*[rounded(name, 9).alias(name) for name in stats.columns])


@query
def dataset_summary(spark, sf_dir):
    data = line_data(spark, sf_dir)
    return tr.dataset_summary(data.train, data.test).withColumn("sparsity", rounded("sparsity", 8))


@query
def dataset_summary_encoded(spark, sf_dir):
    data = line_data(spark, sf_dir)
    summary = tr.dataset_summary_encoded(data.train, data.test, data.n_users, data.n_items)
    return summary.withColumn("sparsity", rounded("sparsity", 8))


# --- training -----------------------------------------------------------------------

@query
def factor_init(spark, sf_dir):
    data = line_data(spark, sf_dir)
    params = tr.Params(factors=8)
    users = spread(tr.initial_factors(spark, "user", data.n_users, params), "idx", 8, 9)
    items = spread(tr.initial_factors(spark, "item", data.n_items, params), "idx", 8, 9)
    return users.select(F.lit("user").alias("side"), "*").unionByName(
        items.select(F.lit("item").alias("side"), "*")
    )


@query
def train_with_conf(spark, sf_dir):
    data = line_data(spark, sf_dir)
    rows = with_confidence(tr.training_relation(data.train), _confidence(data, 0.5))
    return rows.select("user_idx", "item_idx", "r", "w", rounded("c", 9).alias("c"))


@query
def user_group_sizes(spark, sf_dir):
    return group_sizes(line_data(spark, sf_dir).train, "user_idx")


@query
def item_group_sizes(spark, sf_dir):
    return group_sizes(line_data(spark, sf_dir).train, "item_idx")


def _gram(factors: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    weighted = packed(factors).join(weights, "idx")
    return gram(weighted, k).select("f", "g", rounded("value", 6).alias("value"))


@query
def gram_items(spark, sf_dir):
    data = line_data(spark, sf_dir)
    weights = _confidence(data, 0.5).withColumnRenamed("item_idx", "idx")
    return _gram(grid_factors(data, 4)[1], weights, 4)


@query
def gram_users(spark, sf_dir):
    data = line_data(spark, sf_dir)
    return _gram(grid_factors(data, 4)[0], data.users.select("idx", F.lit(1.0).alias("c")), 4)


def _trainer(spark, data, k: int, alpha: float = 0.5, train: DataFrame | None = None, **limits) -> tr.Trainer:
    relation = tr.training_relation(data.train if train is None else train)
    confidence = tr.item_confidence(data.train if train is None else train, data.n_items, 64.0, alpha)
    params = tr.Params(factors=k, alpha=alpha, **limits)
    return tr.Trainer(relation, confidence, data.n_users, data.n_items, params, init=grid_factors(data, k))


@query
def user_half_step_k2(spark, sf_dir):
    with _trainer(spark, line_data(spark, sf_dir), 2) as trainer:
        trainer.user_step()
        return spread(trainer.user_factors, "user_idx", 2)


@query
def item_half_step_k2(spark, sf_dir):
    with _trainer(spark, line_data(spark, sf_dir), 2) as trainer:
        trainer.user_step()
        trainer.item_step()
        return spread(trainer.item_factors, "item_idx", 2)


def _both_sides(users: DataFrame, items: DataFrame, k: int, digits: int = 6) -> DataFrame:
    return spread(users, "idx", k, digits).select(F.lit("user").alias("side"), "*").unionByName(
        spread(items, "idx", k, digits).select(F.lit("item").alias("side"), "*")
    )


@query
def one_epoch_k2(spark, sf_dir):
    with _trainer(spark, line_data(spark, sf_dir), 2) as trainer:
        result = trainer.fit(1)
    return _both_sides(result.users, result.items, 2)


@query
def one_epoch_events(spark, sf_dir):
    """Many repeated pairs and weights near 1."""
    with _trainer(spark, event_data(spark, sf_dir), 4) as trainer:
        result = trainer.fit(1)
    return _both_sides(result.users, result.items, 4)


@query
def one_epoch_hot(spark, sf_dir):
    """Nearly all users and items are split over several blocks."""
    with _trainer(spark, line_data(spark, sf_dir), 4, hot_degree=20, blocks=11) as trainer:
        result = trainer.fit(1)
    return _both_sides(result.users, result.items, 4)


@query
def one_epoch_ranges(spark, sf_dir):
    """Fifty ranges of items and as many of users per block, sums carried from one to the next."""
    data = line_data(spark, sf_dir)
    per_range = max(1, min(data.n_users, data.n_items) // 50)
    with _trainer(spark, data, 4, range_entities=per_range, blocks=3) as trainer:
        result = trainer.fit(1)
    return _both_sides(result.users, result.items, 4)


@query
def objective_k4(spark, sf_dir):
    """The loss at the start and after each half-step of two epochs."""
    values = []
    with _trainer(spark, line_data(spark, sf_dir), 4) as trainer:
        values.append((0, "start", trainer.objective()[0]))
        for epoch in (1, 2):
            trainer.user_step()
            values.append((epoch, "users", trainer.objective()[0]))
            trainer.item_step()
            values.append((epoch, "items", trainer.objective()[0]))
    rows = spark.createDataFrame(values, "epoch int, step string, objective double")
    return rows.withColumn("objective", rounded("objective", 4))


@query
def cold_entities_keep_init(spark, sf_dir):
    """Train on small orders only; users and items without any keep their first vector."""
    data = line_data(spark, sf_dir)
    with _trainer(spark, data, 2, train=data.train.filter("cents < 500000")) as trainer:
        result = trainer.fit(1)
    return _both_sides(result.users, result.items, 2)


@query
def train_k8(spark, sf_dir):
    """Two epochs from the default start."""
    data = line_data(spark, sf_dir)
    params = tr.Params(factors=8, epochs=2)
    result = tr.fit(
        tr.training_relation(data.train), _confidence(data, 0.5), data.n_users, data.n_items, params
    )
    return _both_sides(result.users, result.items, 8)


@query
def warm_start_equals_full(spark, sf_dir):
    """Factors that differ between two epochs at once and two runs of one epoch."""
    data = line_data(spark, sf_dir)
    with _trainer(spark, data, 4) as trainer:
        at_once = trainer.fit(2)
    with _trainer(spark, data, 4) as trainer:
        first = trainer.fit(1)
    resumed = tr.fit(
        tr.training_relation(data.train), _confidence(data, 0.5), data.n_users, data.n_items,
        tr.Params(factors=4, epochs=1), init=(first.users, first.items),
    )

    return _differing(at_once.users, at_once.items, resumed.users, resumed.items)


def _differing(users: DataFrame, items: DataFrame, other_users: DataFrame, other_items: DataFrame) -> DataFrame:
    """How many vectors differ between two models."""
    def differing(side: str, left: DataFrame, right: DataFrame) -> DataFrame:
        other = right.select("idx", F.col("vec").alias("other"))
        gap = F.aggregate(
            F.zip_with("vec", "other", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda most, x: F.greatest(most, x)
        )
        return left.join(other, "idx").agg(
            F.lit(side).alias("side"), F.count("*").alias("n"),
            F.count(F.when(gap > 1e-9, 1)).alias("n_different"),
        )

    return differing("user", users, other_users).unionByName(differing("item", items, other_items))


@query
def resume_equals_full(spark, sf_dir):
    """Two epochs at once against one epoch, a lost trainer, and one more from the path alone."""
    data = line_data(spark, sf_dir)
    path = new_path(spark, "factors")
    with _trainer(spark, data, 4) as trainer:
        at_once = trainer.fit(2)
    with _trainer(spark, data, 4) as trainer:
        tr.FactorStore(spark, path).fit(trainer, 1)
    store = tr.FactorStore(spark, path)
    with store.resume() as trainer:
        store.fit(trainer, 1)
    return _differing(at_once.users, at_once.items, *store.factors())


def _variant_records(data, variant: str, alpha: float) -> DataFrame:
    evaluator = tr.Evaluator(data.test, data.train, data.n_items, TOP_K, None)
    with _trainer(data.train.sparkSession, data, 4, alpha) as trainer:
        history = trainer.fit(2, evaluator, variant).history
    evaluator.close()
    return history


def _history_columns(records: DataFrame) -> DataFrame:
    return records.select(
        "variant", "epoch", rounded("hr", 4).alias("hr"), rounded("ndcg", 4).alias("ndcg"),
        (F.col("time_s") > 0).alias("timed"),
    )


@query
def epoch_history(spark, sf_dir):
    return _history_columns(_variant_records(line_data(spark, sf_dir), "popularity", 0.5))


@query
def compare_variants(spark, sf_dir):
    data = line_data(spark, sf_dir)
    variants = {
        name: tr.Params(factors=4, alpha=alpha, epochs=2, top_k=TOP_K) for name, alpha in (("uniform", 0.0), ("popularity", 0.5))
    }
    return _history_columns(tr.compare_variants(data, variants, init=grid_factors(data, 4))[0])


@query
def experiment_run(spark, sf_dir):
    """Sample, k-core, encode, split, train both variants, compare."""
    base = dict(
        min_interactions=8, sample_fraction=0.5, factors=8, epochs=2, top_k=TOP_K, max_eval_users=None
    )
    data = tr.prepare(
        lines(spark, sf_dir), tr.Params(**base), LINE_KEY,
        ["timestamp", "order_key", "line_number", "item_idx", "cents"],
    )
    variants = {"uniform": tr.Params(alpha=0.0, **base), "popularity": tr.Params(alpha=0.5, **base)}
    joint, _ = tr.compare_variants(data, variants)
    summary = tr.variant_summary(joint)
    return summary.select("variant", "best_epoch", "hr", "ndcg", (F.col("avg_time_s") > 0).alias("timed"))


# --- scores and recommendations -----------------------------------------------------

def _plain_zero(scored: DataFrame) -> DataFrame:
    """Engines may differ in the sign of a score of zero."""
    return scored.withColumn("score", F.col("score") + F.lit(0.0))


@query
def score_pairs_(spark, sf_dir):
    data = line_data(spark, sf_dir)
    users, items = grid_factors(data)
    return _plain_zero(tr.score_pairs(seen_items(data.train), users, items))


@query
def predict_user(spark, sf_dir):
    users, items = grid_factors(line_data(spark, sf_dir))
    return _plain_zero(tr.predict_user(users, items, ONE_USER))


@query
def predict_all(spark, sf_dir):
    users, items = grid_factors(line_data(spark, sf_dir), 4)

    def statistics(batch):
        s = batch.scores
        columns = [batch.users, np.full(len(s), s.shape[1]), s.max(axis=1), s.min(axis=1), s.sum(axis=1)]
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in columns], names=["user_idx", "n", "highest", "lowest", "total"]
        )

    schema = "user_idx bigint, n bigint, highest double, lowest double, total double"
    return tr.predict_all(users, items, statistics, schema).groupBy("user_idx").agg(
        F.sum("n").alias("n_scores"), F.max("highest").alias("max_score"),
        F.min("lowest").alias("min_score"), F.sum("total").alias("sum_scores"),
    )


@query
def recommend_user(spark, sf_dir):
    data = line_data(spark, sf_dir)
    users, items = grid_factors(data)
    return _plain_zero(tr.recommend_user(users, items, data.train, ONE_USER, TOP_N))


@query
def recommend_all(spark, sf_dir):
    data = line_data(spark, sf_dir)
    users, items = grid_factors(data)
    return _plain_zero(tr.recommend_all(users, items, data.train, TOP_N))


@query
def recommend_all_events(spark, sf_dir):
    """A small catalogue of which some users have seen nearly everything."""
    data = event_data(spark, sf_dir)
    users, items = grid_factors(data, 4)
    return _plain_zero(tr.recommend_all(users, items, data.train, 50))


@query
def recommend_decoded(spark, sf_dir):
    data = line_data(spark, sf_dir)
    users, items = grid_factors(data, 4)
    best = _plain_zero(tr.recommend_all(users, items, data.train, TOP_N))
    return tr.decode(best, data.users, data.items).select("user_id", "item_id", "score", "rn")


# --- evaluation ---------------------------------------------------------------------

@query
def seen_items_(spark, sf_dir):
    return seen_items(line_data(spark, sf_dir).train)


@query
def eval_subsample_(spark, sf_dir):
    return eval_subsample(line_data(spark, sf_dir).test, EVAL_USERS).select("user_idx", "item_idx")


@query
def test_item_rank(spark, sf_dir):
    data = line_data(spark, sf_dir)
    users, items = grid_factors(data)
    ranks = tr.test_item_rank(users, items, data.test, data.train)
    return ranks.select("user_idx", "item_idx", "rank")


def _metrics(ranks: DataFrame, top_k: int) -> DataFrame:
    return tr.hr_ndcg(ranks, top_k).select(
        "n", rounded("hr", 6).alias("hr"), rounded("ndcg", 6).alias("ndcg")
    )


@query
def hr_ndcg(spark, sf_dir):
    data = line_data(spark, sf_dir)
    users, items = grid_factors(data)
    return _metrics(tr.test_item_rank(users, items, data.test, data.train), TOP_K)


@query
def hr_ndcg_events(spark, sf_dir):
    """Half of the held-out items were also trained on."""
    data = event_data(spark, sf_dir)
    users, items = grid_factors(data, 4)
    return _metrics(tr.test_item_rank(users, items, data.test, data.train), 20)


@query
def hr_ndcg_subsample(spark, sf_dir):
    data = line_data(spark, sf_dir)
    users, items = grid_factors(data)
    chosen = smallest_digests(data.test, EVAL_USERS, ["user_idx", "item_idx"], 42, 1)
    return _metrics(tr.test_item_rank(users, items, chosen, data.train), TOP_K)


@query
def evaluator_subsample(spark, sf_dir):
    data = line_data(spark, sf_dir)
    users, items = grid_factors(data)
    evaluator = tr.Evaluator(data.test, data.train, data.n_items, TOP_K, EVAL_USERS, round_no=1)
    return evaluator(users, items).select("n", rounded("hr", 6).alias("hr"), rounded("ndcg", 6).alias("ndcg"))


def _message_of(work) -> str | None:
    try:
        work()
    except ValueError as refused:
        return str(refused)
    return None


@query
def guard_empty_data(spark, sf_dir):
    """What a run says whose k-core leaves nothing."""
    rows = lines(spark, sf_dir)
    said = _message_of(lambda: tr.prepare(rows, tr.Params(min_interactions=LINES_EMPTY_K), LINE_KEY, LINE_ORDER))
    return rows.agg(F.count("*").alias("n_ratings"), F.lit(said).cast("string").alias("message"))


@query
def guard_no_training_rows(spark, sf_dir):
    """What a ranking says that cannot look up what the users have seen."""
    data = line_data(spark, sf_dir)
    users, items = grid_factors(data)
    said = _message_of(lambda: tr.test_item_rank(users, items, data.test, None))
    return data.test.agg(F.count("*").alias("n_test"), F.lit(said).cast("string").alias("message"))


# --- comparison of histories --------------------------------------------------------

@query
def format_history(spark, sf_dir):
    return tr.presentation_names(history(spark, sf_dir), TOP_K)


@query
def history_csv(spark, sf_dir):
    path = new_path(spark, "history-csv")
    write_history(history(spark, sf_dir), path, TOP_K)
    return read_history(spark, path)


@query
def best_epoch(spark, sf_dir):
    return tr.best_epoch(history_with_gaps(spark, sf_dir))


@query
def best_epoch_coalesced(spark, sf_dir):
    return tr.best_epoch(history_with_gaps(spark, sf_dir), missing_as_zero=True)


@query
def variant_summary(spark, sf_dir):
    return tr.variant_summary(history(spark, sf_dir))


@query
def relative_gain(spark, sf_dir):
    gain = tr.relative_gain(history(spark, sf_dir), "popularity", "uniform")
    return gain.select(*[rounded(name, 6).alias(name) for name in gain.columns])


@query
def epoch_times_aligned(spark, sf_dir):
    times = tr.epoch_times(history(spark, sf_dir), "uniform", "popularity")
    return times.withColumn("left_mean_s", rounded("left_mean_s", 6)).withColumn(
        "right_mean_s", rounded("right_mean_s", 6)
    )


@query
def hr_pivot(spark, sf_dir):
    return tr.hit_ratio_by_variant(history(spark, sf_dir), ["uniform", "popularity"])


# --- flagship -----------------------------------------------------------------------

@query
def train_and_recommend(spark, sf_dir):
    """Train a small model on all order lines and recommend to every user."""
    data = line_data(spark, sf_dir)
    result = train_variant(data, tr.Params(factors=8, epochs=2), "popularity")
    best = tr.recommend_all(result.users, result.items, data.train, TOP_N)
    named = tr.decode(best, data.users, data.items)
    return named.select("user_id", "item_id", rounded("score", 6).alias("score"), "rn")
