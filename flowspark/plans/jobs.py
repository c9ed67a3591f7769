"""Whole jobs, composed of the operators."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession

from flowspark.operators import codec, metrics, models, tuning
from flowspark.operators.detect import MeanVarianceClassifier
from flowspark.sources import readers, writers
from flowspark.streaming import progress, sinks, windows


def _describe(model: Model) -> str:
    stages = getattr(model, "stages", None)
    return models.describe_params(stages[-1] if stages else model)


def _features(df: DataFrame, handle_invalid: str = "error") -> DataFrame:
    """Statistics flows as vectors; a null feature is an error unless the caller says otherwise."""
    return df if "features" in df.columns else codec.featurize_stats(df, handle_invalid=handle_invalid)


def train_and_evaluate(
    flows: DataFrame, algorithm: str, dataset: str = "", params: dict | None = None, grid: dict | None = None,
    folds: int = tuning.FOLDS, split_key: list[str] | None = None,
) -> dict:
    """Split, cross-validate and refit, score the held-out rows; returns the run metrics.

    ``folds=1`` fits the default point directly. ``split_key`` splits by a hash of those columns
    instead of at random.
    """
    data = _features(flows)
    if split_key:
        train, test = models.hash_split(data, split_key)
    else:
        train, test = models.random_split(data)
    train = train.select("features", "label").cache()
    est = models.estimator(algorithm, **(params or {}))
    try:
        if folds > 1:
            points = tuning.grid(est, grid) if grid else None
            fit = lambda: tuning.cross_validate(est, train, points, folds).bestModel
        else:
            fit = lambda: est.fit(train)
        model, training_time = models.timed(fit)
        return {"algorithm": models.TITLES[algorithm], "training time": training_time, "dataset": dataset,
                "hyperparameters": _describe(model)} | evaluate(model, test)
    finally:
        train.unpersist()


def evaluate(model: Model, test: DataFrame) -> dict:
    """Metrics of a model over test rows, scored once: kept until every metric has been read."""
    columns = ["label", "prediction"]
    scored = model.transform(test)
    has_raw = "rawPrediction" in scored.columns
    scored = scored.select(*columns, *(["rawPrediction"] if has_raw else [])).cache()
    try:
        _, test_time = models.timed(scored.count)
        row = metrics.class_metrics(scored).first().asDict()
        auc = metrics.area_under_roc(scored) if has_raw else None
    finally:
        scored.unpersist()
    return row | {"auc": auc, "test time": test_time}


def sweep(flows: DataFrame, algorithms=models.SUPERVISED, dataset: str = "", folds: int = tuning.FOLDS,
          params: dict | None = None, split_key=None) -> DataFrame:
    """Every algorithm on one dataset, one row of run metrics each; a few run at a time, so their times overlap."""
    data = _features(flows).cache()
    run = lambda a: train_and_evaluate(data, a, dataset, (params or {}).get(a), folds=folds, split_key=split_key)
    try:
        runs = tuning.side_by_side(SparkSession.getActiveSession(), run, list(algorithms))
    finally:
        data.unpersist()
    rows = [tuple(r[n] for n in metrics.RUN_METRICS) for r in runs]
    return flows.sparkSession.createDataFrame(rows, metrics.metric_schema(metrics.RUN_METRICS))


def anomaly_evaluate(legit: DataFrame, mixed: DataFrame, threshold: float = 1.0, dataset: str = "") -> dict:
    """Fit the band detector on legitimate rows, measure it on held-out mixed rows."""
    train, test = models.legit_attack_split(_features(legit), _features(mixed), seed=models.SEED)
    model, training_time = models.timed(lambda: MeanVarianceClassifier(threshold).fit(train))
    row = metrics.weighted_metrics(model.transform(test)).first()
    return {"algorithm": models.TITLES["mean_variance"], "accuracy": row["accuracy"],
            "precision": row["weightedPrecision"], "recall": row["weightedRecall"], "f1-score": row["f1"],
            "auc": None, "training time": training_time, "dataset": dataset,
            "hyperparameters": f"threshold={threshold}"}


def online_model(train: DataFrame, algorithm: str, pca_k: int | None = None, params: dict | None = None):
    """(model, function that prepares a frame or stream for it) with the online settings."""
    settings = models.ONLINE_SETTINGS.get(algorithm, {}) | (params or {})
    data = _features(train)
    if not pca_k:
        return models.train(algorithm, data, **settings), _features
    if algorithm == "neural_network":
        settings["layers"] = [pca_k, *settings["layers"][1:]]
    from pyspark.ml.feature import PCA

    pca = PCA(k=pca_k, inputCol="features", outputCol="pcaFeatures").fit(data)
    model = models.train(algorithm, pca.transform(data), features="pcaFeatures", **settings)
    return model, lambda df: pca.transform(_features(df))


def _score_and_measure(spark, model, prepared, out: str, timeout, metrics_path, progress_path, once) -> dict:
    with progress.recorded(spark) as reports:
        query = sinks.write_predictions_csv(windows.score_stream(model, prepared), out, once=once)
        sinks.run_bounded(query, timeout)
        reports.catch_up(query)
    result = metrics.confusion_metrics(readers.read_predictions(spark, out))
    batches = reports.metrics(spark, query)
    if metrics_path:
        writers.export_metrics(result, metrics_path)
    if progress_path:
        writers.export_metrics(batches, progress_path)
    return {"metrics": result, "progress": batches}


def score_files(
    spark: SparkSession, train: DataFrame, stream_dir: str, algorithm: str, out: str, pca_k: int | None = None,
    params: dict | None = None, timeout: float | None = None, metrics_path: str | None = None,
    progress_path: str | None = None, once: bool = False,
) -> dict:
    """Score flow files as they arrive, then measure what was written."""
    model, prepare = online_model(train, algorithm, pca_k, params)
    stream = prepare(readers.stream_flows(spark, stream_dir))
    return _score_and_measure(spark, model, stream, out, timeout, metrics_path, progress_path, once)


def score_payloads(
    spark: SparkSession, train: DataFrame, messages: DataFrame, algorithm: str, out: str, pca_k: int | None = None,
    params: dict | None = None, timeout: float | None = None, metrics_path: str | None = None,
    progress_path: str | None = None, once: bool = False,
) -> dict:
    """As :func:`score_files`, from a stream of flow messages."""
    model, prepare = online_model(train, algorithm, pca_k, params)
    stream = prepare(codec.parse_flow_payload(readers.payload_stream(messages)))
    return _score_and_measure(spark, model, stream, out, timeout, metrics_path, progress_path, once)


def scored_messages(train: DataFrame, messages: DataFrame, algorithm: str, params: dict | None = None) -> DataFrame:
    """Flow messages with date and prediction."""
    model, prepare = online_model(train, algorithm, params=params)
    flows = codec.parse_flow_payload(readers.payload_stream(messages))
    return codec.stamp_time(windows.score_stream(model, prepare(flows)))


def score_to_index(train: DataFrame, messages: DataFrame, algorithm: str, writer, checkpoint: str,
                   params: dict | None = None, once: bool = False):
    """Score flow messages and hand the documents to the writer of an index; returns the query."""
    return sinks.index_predictions(scored_messages(train, messages, algorithm, params), writer, checkpoint, once=once)


def score_low_latency(
    train: DataFrame, messages: DataFrame, algorithm: str, checkpoint: str, topic_format: str, topic_options: dict,
    topic_stream, writer, relay_checkpoint: str, params: dict | None = None, continuous: bool = True,
    once: bool = False, interval: str | None = None,
):
    """Score messages into a topic, and relay the topic into an index; returns both queries, which run side by side.

    ``topic_stream`` is a function giving the topic, which has to exist, as a stream of ``value`` strings. With ``once`` the first query
    ends with its input; ``sinks.run_together`` waits for it and lets the second one catch up. ``interval`` is
    the trigger of the second.
    """
    scored = scored_messages(train, messages, algorithm, params)
    second = sinks.relay(topic_stream(), writer, relay_checkpoint, interval)
    try:
        first = sinks.publish_predictions_json(scored, checkpoint, topic_format, continuous, once, **topic_options)
    except Exception:
        second.stop()
        raise
    return first, second


def publish_packet_flows(messages: DataFrame, writer, checkpoint: str, label=0, interval: str = sinks.FLOW_INTERVAL,
                         once: bool = False, **flow_options):
    """Packet messages to labelled aggregate-flow messages, one flow table per micro-batch."""
    packets = codec.parse_packet_payload(readers.payload_stream(messages))
    return sinks.publish_flows(packets, writer, checkpoint, label, interval, once, **flow_options)


def run_packet_flows(spark: SparkSession, messages: DataFrame, writer, checkpoint: str, label=0,
                     interval: str = sinks.FLOW_INTERVAL, timeout: float | None = None, progress_path: str | None = None,
                     once: bool = False, **flow_options) -> DataFrame:
    """:func:`publish_packet_flows` until it ends or for ``timeout`` seconds; returns the progress of every
    batch and exports it."""
    with progress.recorded(spark) as reports:
        query = publish_packet_flows(messages, writer, checkpoint, label, interval, once, **flow_options)
        sinks.run_bounded(query, timeout)
        reports.catch_up(query)
    batches = reports.metrics(spark, query)
    if progress_path:
        writers.export_metrics(batches, progress_path)
    return batches
