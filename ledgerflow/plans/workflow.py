"""Batch training with evaluation, and scoring of one file with a saved model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import flows
from ..operators.evaluate import evaluate
from ..operators.learning import Artifacts, load_artifacts, score_accounts, train_models
from ..operators.tables import written
from ..sources.transactions import load_transactions, time_split
from .contract import Config
from .features import account_features


@dataclass(frozen=True)
class Result:
    transactions: DataFrame
    features: DataFrame
    labels: DataFrame
    scored: DataFrame
    metrics: DataFrame
    artifacts: Artifacts
    splits: dict[str, DataFrame]


def run_on(tx: DataFrame, config: Config = Config()) -> Result:
    """Split by time, train on the first part, score and evaluate on the last; each part's graph is its own."""
    train, validation, test = time_split(tx)
    train_features = written(account_features(train, config), "features")
    train_labels = written(flows.account_labels(train), "labels")
    features, labels = written(account_features(test, config), "features"), written(flows.account_labels(test), "labels")
    artifacts = train_models(train_features, None if train_labels.isEmpty() else train_labels, config)
    scored = written(score_accounts(features, artifacts, config), "scored")
    metrics = evaluate(scored, labels, config.decision_threshold)
    return Result(tx, features, labels, scored.orderBy(F.desc("risk_score"), "account"), metrics, artifacts, {"train": train, "val": validation, "test": test})


def run_pipeline(spark: SparkSession, path, config: Config = Config()) -> Result:
    return run_on(written(load_transactions(spark, path), "transactions"), config)


def score_file(spark: SparkSession, path, model_path: str, config: Config = Config()) -> Result:
    """Score every account of a file with a saved model, and evaluate where the file has labels; nothing is split or trained."""
    tx = written(load_transactions(spark, path), "transactions")
    features, labels = written(account_features(tx, config), "features"), flows.account_labels(tx)
    artifacts = load_artifacts(spark, model_path)
    scored = written(score_accounts(features, artifacts, config), "scored")
    return Result(tx, features, labels, scored.orderBy(F.desc("risk_score"), "account"), evaluate(scored, labels, config.decision_threshold), artifacts, {})
