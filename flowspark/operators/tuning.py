"""Model selection: ordinary cross-validation, and one over a pair of datasets."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from threading import BoundedSemaphore, Event

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidatorModel, ParamGridBuilder
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.operators.detect import outside
from flowspark.operators.models import SEED

# Folds, and the parameter grids that may be searched per algorithm.
FOLDS = 10
# Models fitted at the same time: their small jobs leave most of a cluster idle.
SIDE_BY_SIDE = 5
_FITS = BoundedSemaphore(SIDE_BY_SIDE)


def grid(est: Estimator, values: dict[str, list]) -> list[dict]:
    """All combinations of the given parameter values; one default point when there are none."""
    builder = ParamGridBuilder()
    for name, options in values.items():
        builder = builder.addGrid(est.getParam(name), options)
    return builder.build()


def cross_validate(est, df: DataFrame, param_maps=None, folds: int = FOLDS, seed: int = SEED, metric: str = "f1",
                   label: str = "label", parallelism: int = SIDE_BY_SIDE) -> CrossValidatorModel:
    """k-fold cross-validation by the multiclass metric; refits the best point on all rows.

    The folds, metrics and choice of Spark's ``CrossValidator``, which fits one fold after the other: here folds and points are
    fitted side by side, from one stored copy of the rows. All calls of a driver together fit ``SIDE_BY_SIDE`` at a time.
    """
    evaluator = MulticlassClassificationEvaluator(labelCol=label, metricName=metric)
    points = param_maps or [{}]
    width, draw = 1.0 / folds, F.col("_draw")
    drawn = df.select("*", F.rand(seed).alias("_draw")).cache()

    def judge(pair: tuple[int, int]) -> float:
        fold, i = pair
        own = (draw >= fold * width) & (draw < (fold + 1) * width)
        with _FITS:
            model = est.copy().fit(drawn.where(~own), points[i])
            return evaluator.copy().evaluate(model.transform(drawn.where(own), points[i]))

    try:
        drawn.count()  # stored before all folds read it
        pairs = [(fold, i) for fold in range(folds) for i in range(len(points))]
        metrics = np.reshape(side_by_side(df.sparkSession, judge, pairs, parallelism), (folds, len(points)))
    finally:
        drawn.unpersist()
    averages = metrics.mean(axis=0)
    best = int(averages.argmax() if evaluator.isLargerBetter() else averages.argmin())
    found = CrossValidatorModel(est.fit(df, points[best]), averages.tolist(), [], metrics.std(axis=0).tolist())
    for name, value in {"estimator": est, "estimatorParamMaps": points, "evaluator": evaluator, "numFolds": folds, "seed": seed}.items():
        found.set(found.getParam(name), value)
    return found


def side_by_side(spark: SparkSession | None, action, items, workers: int | None = None) -> list:
    """The results of an action on each item, several at a time, begun and returned in order."""
    def begin(item, begun: Event):
        begun.set()
        return action(item)

    target, runs = inheritable_thread_target(spark)(begin) if spark else begin, []
    with ThreadPoolExecutor(max_workers=max(1, min(workers or SIDE_BY_SIDE, len(items)))) as pool:
        for item in items:
            begun = Event()
            runs.append(pool.submit(target, item, begun))
            while not begun.wait(0.1) and not runs[-1].done():
                pass
        return [run.result() for run in runs]


def hash_folds(df: DataFrame, folds: int, seed: int = SEED) -> Column:
    """A fold for each row from a hash of all its columns: the same in every pass, without a stored copy. Equal rows
    share a fold."""
    parts = [F.to_json(F.struct(c)) if isinstance(df.schema[c].dataType, T.MapType) else F.col(c) for c in df.columns]
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(folds)).cast("int")


def metric_of(counts: dict[tuple[float, float], int], name: str) -> float:
    """A metric of Spark's multiclass evaluator from counts of (label, prediction)."""
    total = sum(counts.values())
    if not total:
        return float("nan")
    labels = {x for x, _ in counts}
    real = {x: sum(n for (y, _), n in counts.items() if y == x) for x in labels}
    said = {x: sum(n for (_, p), n in counts.items() if p == x) for x in labels}
    hits = {x: counts.get((x, x), 0) for x in labels}
    precision = {x: hits[x] / said[x] if said[x] else 0.0 for x in labels}
    recall = {x: hits[x] / real[x] for x in labels}
    if name == "accuracy":
        return sum(hits.values()) / total
    each = {
        "weightedPrecision": precision, "weightedRecall": recall,
        "f1": {x: 2 * precision[x] * recall[x] / (precision[x] + recall[x]) if precision[x] + recall[x] else 0.0 for x in labels},
    }[name]
    return sum(each[x] * real[x] / total for x in labels)


COUNTED_METRICS = ("f1", "accuracy", "weightedPrecision", "weightedRecall")


class _BestModel:
    """Saving and loading of a model within another."""

    @staticmethod
    def save(model: "PairCrossValidatorModel", path: str) -> None:
        extra = {"avgMetrics": model.avgMetrics, "bestIndex": model.bestIndex}
        DefaultParamsWriter.saveMetadata(model, path, SparkSession.active(), extraMetadata=extra)
        model.bestModel.save(f"{path}/bestModel")

    @staticmethod
    def load(path: str) -> "PairCrossValidatorModel":
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        best = DefaultParamsReader.loadParamsInstance(f"{path}/bestModel", spark)
        model = PairCrossValidatorModel(best, metadata["avgMetrics"], metadata["bestIndex"])
        model._resetUid(metadata["uid"])
        return model


class _Writer(MLWriter):
    def __init__(self, model):
        super().__init__()
        self._model = model

    def saveImpl(self, path: str) -> None:
        _BestModel.save(self._model, path)


class _Reader(MLReader):
    def load(self, path: str):
        return _BestModel.load(path)


class PairCrossValidatorModel(Model, MLWritable, MLReadable):
    """The best model and the average metric of every parameter point; scores with the best. Copies and saves like any
    other model, the best model within it."""

    def __init__(self, bestModel: Model | None = None, avgMetrics: list[float] = (), bestIndex: int = 0):
        super().__init__()
        self.bestModel, self.avgMetrics, self.bestIndex = bestModel, list(avgMetrics), bestIndex

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.bestModel.transform(dataset)

    def copy(self, extra=None) -> "PairCrossValidatorModel":
        return self._copyValues(PairCrossValidatorModel(self.bestModel.copy(extra), self.avgMetrics, self.bestIndex), extra=extra)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class PairCrossValidator(Estimator):
    """Cross-validation of an anomaly detector over two datasets.

    Every fold trains on the rest of one dataset (legitimate rows) and validates on the other
    (mixed rows): on its own fold of it (``holdout='fold'``), or on all of it (``'full'``).

    Folds come from a hash of the row, or from ``fold_col``, whole numbers from 0 to ``folds`` - 1. Detectors that fit by additive
    summaries (``leave_out_limits``) and metrics that follow from counts take one scan of either dataset for
    all folds and parameter points, detectors of row windows one ordering of the rows; others are fitted and scored each on its own,
    a few at a time.

    As a stage of a pipeline, which fits on one dataset, give the other by ``validation``.
    """

    def __init__(self, estimator, param_maps=None, evaluator=None, folds: int = FOLDS, seed: int = SEED, holdout: str = "fold",
                 fold_col: str | None = None, validation: DataFrame | None = None):
        super().__init__()
        if holdout not in ("fold", "full"):
            raise ValueError("holdout must be 'fold' or 'full'")
        self.estimator, self.param_maps = estimator, param_maps or [{}]
        self.evaluator = evaluator or MulticlassClassificationEvaluator(metricName="f1")
        self.folds, self.seed, self.holdout, self.fold_col, self.validation = folds, seed, holdout, fold_col, validation

    def copy(self, extra=None) -> "PairCrossValidator":
        maps = [{**m, **(extra or {})} for m in self.param_maps]
        return PairCrossValidator(self.estimator.copy(), maps, self.evaluator.copy(), self.folds, self.seed, self.holdout,
                                  self.fold_col, self.validation)

    def _numbered(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_fold", F.col(self.fold_col).cast("int") if self.fold_col else hash_folds(df, self.folds, self.seed))

    def fit(self, training: DataFrame, validation: DataFrame | None = None) -> PairCrossValidatorModel:
        return self._select(training, self.validation if validation is None else validation)

    def _fit(self, dataset: DataFrame) -> PairCrossValidatorModel:
        return self._select(dataset, self.validation)

    def _select(self, training: DataFrame, validation: DataFrame | None) -> PairCrossValidatorModel:
        if validation is None:
            raise TypeError("fit needs a training and a validation dataset")
        a, b = self._numbered(training), self._numbered(validation)
        additive = (hasattr(self.estimator, "leave_out_limits") and isinstance(self.evaluator, MulticlassClassificationEvaluator)
                    and self.evaluator.getMetricName() in COUNTED_METRICS and not self.evaluator.isSet("weightCol"))
        if additive and hasattr(self.estimator, "judged"):
            metrics = self._from_windows(a, b) if self._windows_alike(b) else self._one_by_one(a, b)
        else:
            metrics = self._from_summaries(a, b) if additive else self._one_by_one(a, b)
        averages = [sum(m) / self.folds for m in metrics]
        # The first of equal points; differences of rounding are none.
        best = (max if self.evaluator.isLargerBetter() else min)(range(len(averages)), key=lambda i: round(averages[i], 12))
        return PairCrossValidatorModel(self.estimator.fit(training, self.param_maps[best]), averages, best)

    def _one_by_one(self, a: DataFrame, b: DataFrame) -> list[list[float]]:
        """Metrics by parameter point and fold, each model fitted and scored on its own."""

        def judge(point: tuple[int, int]) -> float:
            i, fold = point
            train = a.where(F.col("_fold") != fold).drop("_fold")
            check = (b if self.holdout == "full" else b.where(F.col("_fold") == fold)).drop("_fold")
            return self.evaluator.evaluate(self.estimator.fit(train, self.param_maps[i]).transform(check))

        points = [(i, fold) for i in range(len(self.param_maps)) for fold in range(self.folds)]
        found = side_by_side(a.sparkSession, judge, points)
        return [found[i * self.folds:(i + 1) * self.folds] for i in range(len(self.param_maps))]

    def _from_summaries(self, a: DataFrame, b: DataFrame) -> list[list[float]]:
        """The same metrics from one aggregate over either dataset."""
        limits = self.estimator.leave_out_limits(a, "_fold", self.folds, self.param_maps)
        label, features = F.col(self.evaluator.getLabelCol()), self.estimator.getFeaturesCol()
        values = b.select("_fold", label.cast("double").alias("_label"), vector_to_array(features).alias("_x"))
        d = len(limits[0][0][0])
        x = [F.get("_x", F.lit(i)) for i in range(d)]
        pairs = [(i, f) for i in range(len(self.param_maps)) for f in range(self.folds)]
        if self.holdout == "full":
            hits = [F.sum(outside(x, *limits[f][i])).alias(f"h{i}_{f}") for i, f in pairs]
            rows = values.groupBy("_label").agg(F.count(F.lit(1)).alias("n"), *hits).collect()
            counted = [(r["_label"], r["n"], i, f, int(r[f"h{i}_{f}"])) for r in rows for i, f in pairs]
        else:
            # A row is judged by the limits of its own fold.
            of = lambda i, side, k: F.get(F.array(*[F.lit(limits[f][i][side][k]) for f in range(self.folds)]), F.col("_fold"))
            hits = [F.sum(outside(x, [of(i, 0, k) for k in range(d)], [of(i, 1, k) for k in range(d)])).alias(f"h{i}")
                    for i in range(len(self.param_maps))]
            rows = values.groupBy("_label", "_fold").agg(F.count(F.lit(1)).alias("n"), *hits).collect()
            counted = [(r["_label"], r["n"], i, r["_fold"], int(r[f"h{i}"])) for r in rows for i in range(len(self.param_maps))]
        tables = {pair: {} for pair in pairs}
        for label_value, n, i, f, hit in counted:
            for said, number in ((1.0, hit), (0.0, n - hit)):
                if number:
                    tables[i, f][label_value, said] = number
        return self._metrics_of(tables)

    def _metrics_of(self, tables: dict) -> list[list[float]]:
        name = self.evaluator.getMetricName()
        return [[metric_of(tables[i, f], name) for f in range(self.folds)] for i in range(len(self.param_maps))]

    def _windows_alike(self, b: DataFrame) -> bool:
        """Whether all points order their rows and are judged by their own columns, so that the windows of folds can be counted together."""
        points = [self.estimator.copy(params) for params in self.param_maps]
        return all(p.getOrDefault("orderCols") and p.getLabelCol() == self.evaluator.getLabelCol() and p.getLabelCol() in b.columns
                   and p.getPredictionCol() == self.evaluator.getPredictionCol() for p in points)

    def _from_windows(self, a: DataFrame, b: DataFrame) -> list[list[float]]:
        """The same metrics of a detector of row windows: all folds from one ordering of the rows of either dataset."""
        limits = self.estimator.leave_out_limits(a, "_fold", self.folds, self.param_maps)
        tables = {(i, f): {} for i in range(len(self.param_maps)) for f in range(self.folds)}
        for group in self.estimator.alike(self.param_maps):
            named = {f: [(i * self.folds + f, *limits[f][i]) for i in group] for f in range(self.folds)}
            full = self.holdout == "full"
            judges = {0: [judge for of in named.values() for judge in of]} if full else named
            found = self.estimator.copy(self.param_maps[group[0]]).judged(b, None if full else "_fold", judges)
            for name, label, said, n in found:
                tables[divmod(name, self.folds)][label, float(said)] = n
        return self._metrics_of(tables)
