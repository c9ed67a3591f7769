"""Prediction metrics and metric tables."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Metric names in export order.
PREDICTION_METRICS = {
    "Test cases": "bigint",
    "Real negative": "bigint",
    "Real positive": "bigint",
    "Predicted negative": "bigint",
    "Predicted positive": "bigint",
    "Precision": "double",
    "Recall": "double",
    "F1 Score": "double",
    "Accuracy": "double",
}
STREAMING_METRICS = {
    "Batch id": "bigint",
    "Timestamp": "string",
    "Input rows": "bigint",
    "Input rows per second": "double",
    "Processed rows per second": "double",
    "Trigger execution": "bigint",
    "Query planning": "bigint",
    "Get batch": "bigint",
    "Get end offset": "bigint",
    "Set offset range": "bigint",
    "WAL commit": "bigint",
    "Add batch": "bigint",
    "Run continuous": "bigint",
}
RUN_METRICS = {
    "algorithm": "string",
    "accuracy": "double",
    "precision": "double",
    "recall": "double",
    "f1-score": "double",
    "auc": "double",
    "training time": "double",
    "dataset": "string",
    "hyperparameters": "string",
}


def metric_schema(names: dict[str, str]) -> T.StructType:
    kinds = {"bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in names.items()])


def ratio(a: Column, b: Column) -> Column:
    """a / b, and NaN for 0 / 0."""
    return F.when(b == 0, F.lit(float("nan"))).otherwise(a / b)


def confusion(label: str = "label", prediction: str = "prediction") -> dict[str, Column]:
    """The counts behind every metric, as aggregates of one pass."""
    real, said = F.col(label), F.col(prediction)
    return {
        "size": F.count(F.lit(1)),
        "rn": F.count_if(real == 0), "rp": F.count_if(real == 1),
        "pn": F.count_if(said == 0), "pp": F.count_if(said == 1),
        "tp": F.count_if((said == 1) & (real == 1)), "tn": F.count_if((said == 0) & (real == 0)),
        "fp": F.count_if((said == 1) & (real == 0)), "fn": F.count_if((said == 0) & (real == 1)),
    }


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.agg(*[c.alias(n) for n, c in confusion(label, prediction).items()])


def confusion_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row with the nine prediction metrics."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    values = [
        F.col("size"), F.col("rn"), F.col("rp"), F.col("pn"), F.col("pp"),
        ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2 * tp, 2 * tp + fp + fn),
        ratio(tp + tn, tp + tn + fp + fn),
    ]
    counts = confusion_counts(df, label, prediction)
    return counts.select(*[v.alias(n) for n, v in zip(PREDICTION_METRICS, values)])


def class_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy over all rows; precision, recall and F-measure of class 1, each 0 where undefined."""
    same = F.count_if(F.col(label) == F.col(prediction)).alias("same")
    c = df.agg(same, *[v.alias(n) for n, v in confusion(label, prediction).items()])
    zero = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    tp, pp, rp = F.col("tp"), F.col("pp"), F.col("rp")
    return c.select(
        ratio(F.col("same"), F.col("size")).alias("accuracy"),
        zero(tp, pp).alias("precision"), zero(tp, rp).alias("recall"),
        zero(2 * tp, pp + rp).alias("f1-score"),
    )


def area_under_roc(df: DataFrame, label: str = "label", raw: str = "rawPrediction") -> float:
    return BinaryClassificationEvaluator(labelCol=label, rawPredictionCol=raw, metricName="areaUnderROC").evaluate(df)


def weighted_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """f1, weightedPrecision, weightedRecall and accuracy over both classes, from one pass."""
    evaluator = MulticlassClassificationEvaluator(labelCol=label, predictionCol=prediction)
    names = ["f1", "weightedPrecision", "weightedRecall", "accuracy"]
    pairs = df.select(F.col(label).cast("double").alias(label), prediction).groupBy(label, prediction).count()
    # The evaluator reads the few distinct pairs with their counts as weights.
    pairs = pairs.withColumn("weight", F.col("count").cast("double")).cache()
    try:
        values = [evaluator.setWeightCol("weight").setMetricName(n).evaluate(pairs) for n in names]
    finally:
        pairs.unpersist()
    return df.sparkSession.createDataFrame([tuple(values)], ", ".join(f"{n} double" for n in names))


class MetricTable:
    """Named metrics with one row per run; values under other names are ignored."""

    def __init__(self, spark: SparkSession, names: dict[str, str]):
        self.spark = spark
        self.names = names
        self.table = spark.createDataFrame([], metric_schema(names))

    def add(self, values) -> "MetricTable":
        """Append a row given as a dict or as a DataFrame."""
        if isinstance(values, DataFrame):
            known = [c for c in values.columns if c in self.names]
            new = values.select(*known)
        else:
            known = {n: v for n, v in values.items() if n in self.names}
            row = tuple(known.get(n) for n in self.names)
            new = self.spark.createDataFrame([row], metric_schema(self.names))
        self.table = self.table.unionByName(new, allowMissingColumns=True)
        return self

    def get(self, name: str) -> DataFrame:
        return self.table.select(F.col(f"`{name}`"))

    def export(self, path: str, fmt: str = "csv") -> None:
        from flowspark.sources.writers import export_metrics

        export_metrics(self.table, path, fmt)
