"""Training and scoring of account risk, and class-balanced sampling of transactions."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.risk import blend, min_max, tier
from ..plans.contract import Config
from .booster import Booster, fit_booster
from .forest import Forest, fit_forest, score_forest
from .quantiles import quantiles
from .tables import written


@dataclass
class Artifacts:
    """A trained model: prepare imputes and scales, supervised may be missing."""

    prepare: PipelineModel
    supervised: Booster | None
    forest: Forest
    feature_columns: list[str]
    threshold_high: float
    threshold_medium: float
    anomaly_low: float
    anomaly_high: float
    metadata: dict = field(default_factory=dict)


def class_balance(labelled: DataFrame, label: str = "label") -> DataFrame:
    """One row: positives, negatives, classes, scale_pos_weight = max(negatives / max(positives, 1), 1)."""
    out = labelled.agg(
        F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).alias("positives"),
        F.coalesce(F.sum(F.lit(1) - F.col(label).cast("long")), F.lit(0)).alias("negatives"),
        F.count_distinct(label).alias("classes"),
    )
    return out.withColumn("scale_pos_weight", F.greatest(F.col("negatives") / F.greatest("positives", F.lit(1)), F.lit(1.0)))


def downsample(tx: DataFrame, ratio: int = 25, seed: int = 42, key: str = "tx_id") -> DataFrame:
    """All laundering rows and exactly ratio times as many others, or all of them if there are fewer; chosen by the least MD5 of key:seed and shuffled by hash of the key, so the result does not depend on partitioning."""
    positive, negative = tx.where("is_laundering = 1"), tx.where("is_laundering = 0")
    have, others = tx.agg(F.count(F.when(F.col("is_laundering") == 1, 1)), F.count(F.when(F.col("is_laundering") == 0, 1))).first()
    if have * ratio < others:
        negative = least_hashed(negative.withColumn("_h", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))), have * ratio, key).drop("_h")
    return positive.unionByName(negative).withColumn("_o", F.xxhash64(key, F.lit(seed + 1))).orderBy("_o", key).drop("_o")


def least_hashed(rows: DataFrame, wanted: int, key: str, few: int = 10_000) -> DataFrame:
    """The wanted rows of least (_h, key), _h being hexadecimal text. Rows are counted by the next four digits until the group that holds the cut has few rows; groups below it are whole, and only that group is sorted."""
    cut = ""
    while True:
        at = rows.where(F.col("_h").startswith(cut)) if cut else rows
        groups = sorted(tuple(r) for r in at.groupBy(F.substring("_h", len(cut) + 1, 4)).count().collect())  # 65,536 at most
        for digits, n in groups:
            if wanted <= n:
                break
            wanted -= n
        else:
            return rows  # fewer than wanted
        cut += digits
        if n <= few or len(cut) >= 32:
            within = rows.where(F.col("_h").startswith(cut)).orderBy("_h", key).limit(wanted)
            return rows.where(F.col("_h") < cut).unionByName(within)


def _preparation(columns: list[str]) -> Pipeline:
    filled = [f"{c}__filled" for c in columns]
    return Pipeline(
        stages=[
            Imputer(strategy="median", relativeError=0.0, inputCols=columns, outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="_raw"),
            StandardScaler(withMean=True, inputCol="_raw", outputCol="x"),
        ]
    )


def _doubles(features: DataFrame, columns: list[str]) -> DataFrame:
    return features.select("account", *[F.col(c).cast("double").alias(c) for c in columns], *[c for c in ("label",) if c in features.columns])


def prepared(features: DataFrame, artifacts: Artifacts) -> DataFrame:
    """account, x: the vector that the models see."""
    return artifacts.prepare.transform(_doubles(features, artifacts.feature_columns)).select("account", "x")


def probabilities(x: DataFrame, model: Booster | None) -> DataFrame:
    """Add supervised_probability; 0 without a model."""
    if model is None:
        return x.withColumn("supervised_probability", F.lit(0.0))
    shared = x.sparkSession.sparkContext.broadcast(model)  # 2 ** (depth + 1) small nodes a tree

    @F.pandas_udf("double")
    def probability(v: pd.Series) -> pd.Series:
        return pd.Series(1.0 / (1.0 + np.exp(-2.0 * shared.value.margins(np.array(v.tolist()).reshape(len(v), -1)))) if len(v) else np.zeros(0))

    return x.withColumn("supervised_probability", probability(vector_to_array("x")))


def train_models(features: DataFrame, labels: DataFrame | None, config: Config = Config()) -> Artifacts:
    """Fit preparation, the boosted classifier (only with two classes and enough labelled rows), the isolation forest, and the tier thresholds over all training accounts."""
    columns = [c for c in features.columns if c != "account"]
    prepare = _preparation(columns).fit(_doubles(features, columns))
    x = prepare.transform(_doubles(features, columns)).select("account", "x").persist()
    supervised, balance = None, None
    if labels is not None:
        labelled = written(x.join(labels, "account"), "labelled")
        balance = class_balance(labelled).first()
        rows = balance["positives"] + balance["negatives"]
        if balance["classes"] >= 2 and rows >= config.least_training_rows:
            supervised = fit_booster(labelled, len(columns), rows, balance["scale_pos_weight"], config.boosting_rounds, config.boosting_depth, config.boosting_step, config.random_state, config.task_rows)
    forest = fit_forest(x, config.isolation_trees, config.isolation_rows, config.random_state)
    raw = score_forest(probabilities(x, supervised), forest).persist()
    low, high = raw.agg(F.min("anomaly_raw"), F.max("anomaly_raw")).first()
    scaled = min_max(raw, "anomaly_raw", "anomaly_score", low, high)
    risk = scaled.select(blend(F.col("supervised_probability"), F.col("anomaly_score"), config.supervised_weight).alias("risk"))
    cut = quantiles(risk.select(F.lit("risk").alias("key"), F.col("risk").alias("value")), [config.quantile_medium, config.quantile_high]).first()["quantiles"]
    n = x.count()
    raw.unpersist()
    x.unpersist()
    return Artifacts(
        prepare,
        supervised,
        forest,
        columns,
        threshold_high=float(cut[1]),
        threshold_medium=float(cut[0]),
        anomaly_low=float(low),
        anomaly_high=float(high),
        metadata={
            "model_type": "BoostedTrees" if supervised else None,
            "training_samples": n,
            "feature_count": len(columns),
            "positive_labels": int(balance["positives"]) if balance else 0,
            "negative_labels": int(balance["negatives"]) if balance else 0,
            "scale_pos_weight": float(balance["scale_pos_weight"]) if supervised else 1.0,
        },
    )


def score_accounts(features: DataFrame, artifacts: Artifacts, config: Config = Config(), scaling: str = "batch") -> DataFrame:
    """account, supervised_probability, anomaly_score, risk_score, risk_tier. Anomaly is scaled over the scored batch, or by the training bounds with scaling="train"."""
    raw = score_forest(probabilities(prepared(features, artifacts), artifacts.supervised), artifacts.forest)
    bounds = (artifacts.anomaly_low, artifacts.anomaly_high) if scaling == "train" else (None, None)
    out = min_max(raw, "anomaly_raw", "anomaly_score", *bounds)
    out = out.withColumn("risk_score", blend(F.col("supervised_probability"), F.col("anomaly_score"), config.supervised_weight))
    return out.select("account", "supervised_probability", "anomaly_score", "risk_score", tier(F.col("risk_score"), artifacts.threshold_medium, artifacts.threshold_high).alias("risk_tier"))


# ---- persistence: model folders, Parquet and JSON, no pickles


def save_artifacts(spark: SparkSession, artifacts: Artifacts, path: str) -> None:
    artifacts.prepare.write().overwrite().save(f"{path}/prepare")
    if artifacts.supervised is not None:
        spark.createDataFrame(artifacts.supervised.rows(), Booster.SCHEMA).write.mode("overwrite").parquet(f"{path}/supervised")
    spark.createDataFrame(artifacts.forest.rows(), Forest.SCHEMA).write.mode("overwrite").parquet(f"{path}/forest")
    rest = _plain(artifacts) | {"isolation_rows": artifacts.forest.rows_per_tree, "has_supervised": artifacts.supervised is not None}
    spark.createDataFrame([(json.dumps(rest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def _plain(artifacts: Artifacts) -> dict:
    return {k: getattr(artifacts, k) for k in ("feature_columns", "threshold_high", "threshold_medium", "anomaly_low", "anomaly_high", "metadata")}


def load_artifacts(spark: SparkSession, path: str) -> Artifacts:
    rest = json.loads(spark.read.text(f"{path}/meta").first()[0])
    forest = Forest.from_rows(spark.read.parquet(f"{path}/forest").orderBy("tree", "node").collect(), rest.pop("isolation_rows"))
    supervised = Booster.from_rows(spark.read.parquet(f"{path}/supervised").collect()) if rest.pop("has_supervised") else None
    return Artifacts(prepare=PipelineModel.load(f"{path}/prepare"), supervised=supervised, forest=forest, **rest)
