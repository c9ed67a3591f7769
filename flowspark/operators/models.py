"""Supervised flow classifiers: one train function per algorithm, one score function for all."""

from __future__ import annotations

import time

from pyspark import SparkContext
from pyspark.ml import Model, Pipeline, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier,
    NaiveBayes, RandomForestClassifier,
)
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.operators.detect import EntropyClassifier, MeanVarianceClassifier

# The seed of every split and fold, the batch split, and the settings of the online jobs.
SEED = 534661
TRAIN_SHARE = 0.7
MLP_LAYERS = [40, 21, 2]
ONLINE_SETTINGS = {
    "decision_tree": {"impurity": "gini", "maxDepth": 20},
    "random_forest": {"numTrees": 50, "impurity": "gini", "maxDepth": 20},
    "logistic_regression": {"regParam": 0.03, "elasticNetParam": 0.8, "maxIter": 20},
    "neural_network": {"layers": MLP_LAYERS, "maxIter": 100},
    "svm": {"regParam": 0.01, "maxIter": 20},
    "mean_variance": {"threshold": 2.0},
}
TITLES = {
    "decision_tree": "Decision Tree",
    "random_forest": "Random Forest",
    "gradient_boosted_tree": "Gradient-Boosted Tree",
    "logistic_regression": "Logistic Regression",
    "naive_bayes": "Naive Bayes",
    "neural_network": "Neural Network",
    "svm": "Support Vector Machine",
    "mean_variance": "Mean-Variance",
    "entropy": "Entropy",
}

class _NoSummary:
    """Models without a training summary. A summary holds on to the session of its training rows, and every task of the
    model's predictions would carry both; a session that has met an ``Observation`` cannot be sent at all."""

    def _create_model(self, java_model):
        java_model.setSummary(SparkContext._active_spark_context._jvm.scala.Option.empty())
        return super()._create_model(java_model)


class PlainLogisticRegression(_NoSummary, LogisticRegression):
    pass


class PlainLinearSVC(_NoSummary, LinearSVC):
    pass


class PlainRandomForestClassifier(_NoSummary, RandomForestClassifier):
    pass


_ESTIMATORS = {
    "decision_tree": DecisionTreeClassifier,
    "random_forest": PlainRandomForestClassifier,
    "gradient_boosted_tree": GBTClassifier,
    "logistic_regression": PlainLogisticRegression,
    "naive_bayes": NaiveBayes,
    "neural_network": MultilayerPerceptronClassifier,
    "svm": PlainLinearSVC,
    "mean_variance": MeanVarianceClassifier,
    "entropy": EntropyClassifier,
}
SUPERVISED = list(_ESTIMATORS)[:7]


class ClipNegative(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Negative feature values become 0."""

    def __init__(self, inputCol="features", outputCol="non_negative_features"):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        clipped = F.transform(vector_to_array(self.getInputCol()), lambda x: F.greatest(x, F.lit(0.0)))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(clipped))


def estimator(algorithm: str, features: str = "features", label: str = "label", **params):
    """The estimator of an algorithm.

    Naive Bayes takes no negative values, and a mean length is -1 for flows without an answer: such
    values are clipped to 0 first. The perceptron needs its layers; the default fits the 40
    statistics features.
    """
    make = _ESTIMATORS[algorithm]
    if algorithm == "naive_bayes":
        clip = ClipNegative(inputCol=features)
        return Pipeline(stages=[clip, make(featuresCol=clip.getOutputCol(), labelCol=label, **params)])
    if algorithm == "neural_network":
        params.setdefault("layers", MLP_LAYERS)
        params.setdefault("seed", SEED)
    return make(featuresCol=features, labelCol=label, **params)


def train(algorithm: str, df: DataFrame, **params) -> Model:
    return estimator(algorithm, **params).fit(df)


def train_decision_tree(df, **params):
    return train("decision_tree", df, **params)


def train_random_forest(df, **params):
    return train("random_forest", df, **params)


def train_gradient_boosted_tree(df, **params):
    return train("gradient_boosted_tree", df, **params)


def train_logistic_regression(df, **params):
    return train("logistic_regression", df, **params)


def train_naive_bayes(df, **params):
    return train("naive_bayes", df, **params)


def train_neural_network(df, **params):
    return train("neural_network", df, **params)


def train_svm(df, **params):
    return train("svm", df, **params)


def score(model: Model, df: DataFrame) -> DataFrame:
    """Predictions for a table or a stream."""
    return model.transform(df)


def reduce_features(train_df: DataFrame, k: int, *others: DataFrame, features: str = "features", output: str = "pcaFeatures"):
    """PCA fitted on the training rows and applied to all frames."""
    model = PCA(k=k, inputCol=features, outputCol=output).fit(train_df)
    return tuple(model.transform(df) for df in (train_df, *others))


def random_split(df: DataFrame, share: float = TRAIN_SHARE, seed: int | None = SEED):
    """Random training and test rows; depends on how the frame is partitioned."""
    return df.randomSplit([share, 1.0 - share], seed)


PARTS = 10_000


def portable_part(key: list[str], parts: int = PARTS, seed: int = SEED) -> Column:
    """A number below ``parts`` from the MD5 of the key's text, which any SQL engine can repeat."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % parts).cast("int")


def hash_split(df: DataFrame, key: list[str], share: float = TRAIN_SHARE, seed: int = SEED, part: Column | None = None):
    """The same split by a hash of the key: independent of partitioning and repeatable. ``part`` is another
    number below 10,000, such as ``portable_part``."""
    part = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(PARTS)) if part is None else part
    cut = int(share * PARTS)
    return df.where(part < cut), df.where(part >= cut)


def legit_attack_split(legit: DataFrame, mixed: DataFrame, share: float = TRAIN_SHARE, seed: int | None = None,
                       key: list[str] | None = None):
    """Training share of one frame and the remaining share of the other; with a ``key`` by its ``portable_part``, so that the
    split is repeatable."""
    if key:
        part = portable_part(key, seed=SEED if seed is None else seed)
        return hash_split(legit, key, share, part=part)[0], hash_split(mixed, key, share, part=part)[1]
    return random_split(legit, share, seed)[0], random_split(mixed, share, seed)[1]


def timed(action):
    """(result, seconds) of a function without arguments."""
    start = time.perf_counter()
    result = action()
    return result, time.perf_counter() - start


def describe_params(model: Model) -> str:
    return ", ".join(sorted(f"{p.name}={v}" for p, v in model.extractParamMap().items()))
