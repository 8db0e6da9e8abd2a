"""The whole run: prepare interactions, train weighting variants, compare them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from tacitrec.operators.compare import epoch_times, relative_gain, variant_summary
from tacitrec.operators.encode import encode_ids
from tacitrec.operators.kcore import kcore
from tacitrec.operators.relation import interactions, training_relation
from tacitrec.operators.sample import sample_exact
from tacitrec.operators.split import leave_one_out
from tacitrec.operators.summary import dataset_summary
from tacitrec.operators.weights import item_confidence
from tacitrec.params import Params
from tacitrec.plans.evaluate import Evaluator
from tacitrec.plans.train import FitResult, JointTrainer, Layout, fit
from tacitrec.sources.history import HISTORY_SCHEMA, write_history
from tacitrec.tables import drop_table, write_table


@dataclass(frozen=True)
class Dataset:
    """Train and test rows of one written table, dictionaries `(id, idx)` and their sizes."""

    train: DataFrame
    test: DataFrame
    users: DataFrame
    items: DataFrame
    n_users: int
    n_items: int

    def close(self) -> None:
        """Delete the written tables; the frames cannot be read any more."""
        for table in (self.train, self.test, self.users, self.items):
            drop_table(table)


def split_dataset(
    rows: DataFrame, order: Sequence[str] = ("timestamp",),
    users: DataFrame | None = None, items: DataFrame | None = None,
) -> Dataset:
    """Encode ids and hold out each user's last interaction.

    `users` and `items` may hold the ids that occur, where they are known already. Train and
    test carry indices only; `decode` brings the ids back.
    """
    encoded = encode_ids(rows, users, items)
    if encoded.n_users == 0 or encoded.n_items == 0:
        raise ValueError("no users or items left: lower min_interactions or raise sample_fraction")
    if encoded.heavy_users:
        written = write_table(encoded.rows.drop("user_id", "item_id"), "encoded")
        train, test = leave_one_out(written, order)
        drop_table(written)
    else:
        train, test = leave_one_out(encoded.rows.drop("item_id"), order, "user_id")
    if encoded.staged is not None:
        drop_table(encoded.staged)
    return Dataset(train, test, encoded.users, encoded.items, encoded.n_users, encoded.n_items)


def prepare(
    rows: DataFrame, params: Params = Params(), key: Sequence[str] | None = None,
    order: Sequence[str] = ("timestamp",),
) -> Dataset:
    """Sample, k-core filter, encode and split interactions.

    `key` names columns that identify a row up to exact copies; by default all columns.
    """
    sampled = sample_exact(rows, params.sample_fraction, key or rows.columns, params.seed)
    if params.sample_fraction < 1.0:
        sampled = write_table(sampled, "sample")
    core = kcore(sampled, params.min_interactions)
    if core.is_empty:
        raise ValueError("no users or items left: lower min_interactions or raise sample_fraction")
    data = split_dataset(core.rows, order, core.users, core.items)
    drop_table(sampled)
    return data


def train_variant(
    data: Dataset, params: Params, variant: str, evaluator: Evaluator | None = None,
    layout: Layout | None = None, init: tuple[DataFrame, DataFrame] | None = None,
) -> FitResult:
    """Train one model on a data set; with an evaluator, it is scored after each epoch."""
    confidence = item_confidence(data.train, data.n_items, params.c0, params.alpha)
    relation = training_relation(data.train, params.w_obs)
    return fit(
        relation, confidence, data.n_users, data.n_items, params, init, evaluator, variant, layout
    )


def compare_variants(
    data: Dataset, variants: Mapping[str, Params], init: tuple[DataFrame, DataFrame] | None = None, joint: bool = True
) -> tuple[DataFrame, dict[str, FitResult]]:
    """Train each variant from the same start; return the joint history and the models.

    Variants that differ in item weights and evaluation only train in the same half-steps; the time
    of an epoch is then shared evenly. `joint=False` trains them one after the other, which times
    each for itself. Variants that lay out their pairs alike share one layout, and those that are
    scored on the same users one evaluator.
    """
    layouts: dict[tuple, Layout] = {}
    evaluators: dict[tuple, Evaluator] = {}
    groups: dict[tuple, list[str]] = {}
    results: dict[str, FitResult] = {}
    for name, p in variants.items():
        alike = (p.factors, p.reg, p.epochs, p.seed, *_layout_of(p))
        groups.setdefault(alike if joint else (name,), []).append(name)
    widest, most = max(p.factors for p in variants.values()), max(map(len, groups.values()))
    try:
        for names in groups.values():
            first = variants[names[0]]
            if _layout_of(first) not in layouts:
                layouts[_layout_of(first)] = Layout(
                    training_relation(data.train, first.w_obs), replace(first, factors=widest), most
                )
            scorers = []
            for p in (variants[name] for name in names):
                scored = (p.top_k, p.max_eval_users, p.seed)
                if scored not in evaluators:
                    evaluators[scored] = Evaluator(data.test, data.train, data.n_items, *scored)
                scorers.append(evaluators[scored])
            weights = [item_confidence(data.train, data.n_items, variants[name].c0, variants[name].alpha) for name in names]
            with JointTrainer(
                None, weights, data.n_users, data.n_items, first, [init] * len(names), layouts[_layout_of(first)]
            ) as trainer:
                results.update(zip(names, trainer.fit_all(evaluators=scorers, variants=names)))
    finally:
        for used in (*layouts.values(), *evaluators.values()):
            used.close()
    records = [record for name in variants for record in results[name].records]
    return data.train.sparkSession.createDataFrame(records, HISTORY_SCHEMA), {name: results[name] for name in variants}


def _layout_of(p: Params) -> tuple:
    return p.w_obs, p.hot_degree, p.blocks, p.block_entities, p.range_entities


@dataclass(frozen=True)
class Report:
    """What a whole run yields: the data set, its summary, the models and their comparison."""

    data: Dataset
    summary: DataFrame
    history: DataFrame
    models: dict[str, FitResult]
    best: DataFrame
    gain: DataFrame
    times: DataFrame


def run_experiment(
    ratings: DataFrame, params: Params = Params(), history_path: str | None = None,
    key: Sequence[str] | None = None,
) -> Report:
    """Prepare ratings, train with uniform and with popularity weights, compare the two.

    `history_path`, if given, receives the epoch histories as CSV files.
    """
    data = prepare(interactions(ratings), params, key)
    variants = {"uniform": replace(params, alpha=0.0), "popularity": params}
    history, models = compare_variants(data, variants)
    if history_path is not None:
        write_history(history, history_path, params.top_k)
    return Report(
        data, dataset_summary(data.train, data.test), history, models, variant_summary(history),
        relative_gain(history, "popularity", "uniform"), epoch_times(history, "uniform", "popularity"),
    )
