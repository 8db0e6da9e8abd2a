"""Recommendation from implicit feedback as Spark DataFrame jobs."""

from tacitrec.operators.compare import (
    best_epoch,
    epoch_times,
    hit_ratio_by_variant,
    presentation_names,
    relative_gain,
    variant_summary,
)
from tacitrec.operators.encode import Encoded, decode, encode_ids, id_dictionary
from tacitrec.operators.kcore import KCore, interaction_counts, kcore, kcore_pass
from tacitrec.operators.relation import interactions, preview, training_relation
from tacitrec.operators.sample import sample_exact
from tacitrec.operators.score import predict_user, score_pairs
from tacitrec.operators.split import leave_one_out
from tacitrec.operators.summary import dataset_summary, dataset_summary_encoded
from tacitrec.operators.weights import confidence_stats, item_confidence, item_popularity
from tacitrec.params import Params
from tacitrec.plans.evaluate import Evaluator, hr_ndcg, test_item_rank
from tacitrec.plans.experiment import Dataset, Report, compare_variants, prepare, run_experiment
from tacitrec.plans.recommend import predict_all, recommend_all, recommend_user
from tacitrec.plans.store import FactorStore
from tacitrec.plans.train import FitResult, JointTrainer, Layout, Trainer, fit, initial_factors
from tacitrec.sources.history import read_history, write_history
from tacitrec.sources.ratings import read_ratings, write_ratings

__all__ = [
    "Dataset", "Encoded", "Evaluator", "FactorStore", "FitResult", "JointTrainer", "KCore", "Layout", "Params", "Report", "Trainer",
    "best_epoch", "compare_variants", "confidence_stats", "dataset_summary",
    "dataset_summary_encoded", "decode", "encode_ids", "epoch_times", "fit",
    "hit_ratio_by_variant", "hr_ndcg", "id_dictionary", "initial_factors",
    "interaction_counts", "interactions", "item_confidence", "item_popularity", "kcore",
    "kcore_pass", "leave_one_out", "predict_all", "predict_user", "prepare",
    "presentation_names", "preview", "read_history", "read_ratings", "recommend_all",
    "recommend_user", "relative_gain", "run_experiment", "sample_exact", "score_pairs",
    "test_item_rank", "training_relation", "variant_summary", "write_history", "write_ratings",
]
