"""Edge cases of the operators, on small hand-made data."""

import json
import math
import threading
import time

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Observation
from pyspark.sql import functions as F

from flowspark import schemas, session
from flowspark.operators import aggflows, codec, detect, histograms, metrics, models, packets, rows, tuning
from flowspark.plans import jobs
from flowspark.sources import readers, writers
from flowspark.streaming import progress, sinks, windows


def values(spark, xs):
    return spark.createDataFrame([("f", float(x)) for x in xs], "feature string, value double")


def vectors(spark, table, labels=None):
    labels = labels or [0] * len(table)
    return spark.createDataFrame(
        [(i, Vectors.dense(v), y) for i, (v, y) in enumerate(zip(table, labels))],
        ["row_index", "features", "label"])


def test_payload_fields_past_the_end_and_broken_numbers_are_null(spark):
    df = spark.createDataFrame([('"10.0.0.1,x,10.0.0.2,80,6,3.0"',), ("",)], "value string")
    first, second = codec.parse_flow_payload(df).collect()
    assert (first.srcip, first.srcport, first.dstport, first.total_fpackets, first.label) == ("10.0.0.1", None, 80, 3, None)
    assert second.srcip == "" and second.dstip is None and len(second) == 46


def test_csv_keeps_the_place_of_nulls(spark):
    df = spark.createDataFrame([(1, None, "x")], "a int, b string, c string")
    assert codec.encode_flow_csv(df).first().value == "1,,x"


def test_frames_too_short_are_dropped_not_errors(spark):
    df = spark.createDataFrame([(0, 1.0, bytearray(b"")), (1, 1.0, bytearray(12) + b"\x08\x00"), (2, 1.0, None)], "seq int, ts double, frame binary")
    assert {r.verdict: r.frames for r in packets.count_frames(df).collect()} == {"not_ip": 1, "short_frame": 2}
    assert packets.decode_frames(df).count() == 0


def test_decoding_honours_ip_options(spark):
    ip = bytes([0x46, 0x10, 0, 60, 0, 0, 0, 0, 64, 17, 0, 0, 10, 0, 0, 1, 10, 0, 0, 2, 1, 1, 1, 1])
    udp = bytes([0x13, 0x88, 0, 53, 0, 36, 0, 0])
    df = spark.createDataFrame([(0, 2.5, bytearray(bytes(12) + b"\x08\x00" + ip + udp))], "seq int, ts double, frame binary")
    row = packets.decode_frames(df).first()
    assert (row.iphlen, row.srcport, row.dstport, row.prhlen, row.dscp, row.ts_us, row.flags) == (24, 5000, 53, 36, 4, 2_500_000, None)


def test_flag_modes(spark):
    df = spark.createDataFrame([(1,), (0,), (None,)], "x int")
    row = df.agg(aggflows.flag_count("x", "set").alias("s"), aggflows.flag_count("x", "nonnull").alias("n")).first()
    assert (row.s, row.n) == (1, 2)
    with pytest.raises(ValueError):
        aggflows.flag_count("x", "some")


def test_distinct_modes_agree(spark):
    df = spark.createDataFrame([(i % 7, i % 3) for i in range(50)], "a int, b int")
    got = [df.agg(*[c.alias(str(i)) for i, c in enumerate(aggflows.distinct_ports(F.col("a"), F.col("b"), m))]).first()
           for m in ("exact", "set", "approx")]
    assert [tuple(r) for r in got] == [(7, 3)] * 3


def test_maximum_has_its_own_bucket_and_constants_have_one(spark):
    assert {(r.bucket, r.n) for r in histograms.value_histogram(values(spark, [0, 1, 2, 3, 4]), 4, ["feature"]).collect()} == {(i, 1) for i in range(5)}
    assert [(r.bucket, r.n) for r in histograms.value_histogram(values(spark, [7, 7]), 4, ["feature"]).collect()] == [(0, 2)]
    even = histograms.even_histogram(values(spark, [0, 1, 2, 4]), 4, ["feature"]).orderBy("bucket").collect()
    assert [(r.lower, r.upper, r.n) for r in even] == [(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 4, 1)]
    flat = histograms.even_histogram(values(spark, [5, 5, 5]), 4, ["feature"]).collect()
    assert [(r.lower, r.upper, r.n) for r in flat] == [(5, 5, 3)]


def test_top_bucket_takes_the_first_on_ties(spark):
    hist = histograms.value_histogram(values(spark, [0, 0, 9, 9, 4]), 3, ["feature"])
    assert histograms.top_bucket(hist, ["feature"]).first().bucket == 0


def test_entropy_counts_shares_of_the_nominal_size(spark):
    got = histograms.entropy(values(spark, [1, 1]), 5, 4, ["feature"]).first().entropy
    assert got == pytest.approx(0.5)
    assert detect.run_entropies(np.array([[1.0], [1.0], [2.0], [2.0]]), 4, 5)[0, 0] == pytest.approx(1.0)


def test_rows_are_numbered_along_the_order(spark):
    df = spark.range(1000).select((999 - F.col("id")).alias("k"), (F.col("id") % 3).alias("v")).repartition(7)
    got = rows.number_rows(df, ["k"]).orderBy("k").collect()
    assert [r.row_index for r in got] == list(range(1000))


@pytest.mark.parametrize("ranges", [1, 2, 13])
def test_numbers_follow_spark_order_with_ties_and_nulls(spark, ranges):
    values = [None, float("nan"), 3.0, -1.0, 3.0, None, 2.5]
    rows_in = [(values[i % 7], f"s{i % 3}" if i % 5 else None, i) for i in range(400)] + [(3.0, "s0", 7)] * 30
    df = spark.createDataFrame(rows_in, "a double, b string, i int").repartition(6)
    got = rows.number_rows(df, ["a", "b"], ranges=ranges).orderBy("row_index").collect()
    assert [r.row_index for r in got] == list(range(430))
    want = df.orderBy("a", "b").collect()
    assert [(str(r.a), r.b) for r in got] == [(str(r.a), r.b) for r in want]
    again = rows.number_rows(df.repartition(3), ["a", "b"], ranges=ranges).orderBy("row_index").collect()
    assert [(str(r.a), r.b, r.i) for r in again] == [(str(r.a), r.b, r.i) for r in got]


def test_ties_of_the_order_are_cut(spark):
    df = spark.range(4000).select(F.lit(1).alias("k"), "id")
    cuts = rows.splitters(df, [F.col("k"), F.xxhash64("k", "id")], 8)
    assert len(cuts) == 7
    got = rows.number_rows(df, ["k"], ranges=8)
    assert sorted(r.row_index for r in got.select("row_index").collect()) == list(range(4000))
    # No stored copy: nothing but the input is read.
    assert "checkpoint" not in got._jdf.queryExecution().executedPlan().toString().lower()


def test_sliding_rows_cross_blocks_and_short_inputs_have_none(spark):
    df = spark.range(50).select(F.col("id").alias("row_index"), F.col("id").alias("x"))
    got = rows.sliding_rows(df, 4, ["x"], block_rows=5).orderBy("window_start").collect()
    assert [(r.window_start, r.x) for r in got] == [(i, list(range(i, i + 4))) for i in range(47)]
    assert rows.sliding_rows(df.limit(3), 4, ["x"]).count() == 0
    assert rows.tumbling_rows(df, 20).groupBy("window_id").count().orderBy("window_id").collect()[-1][1] == 10


def test_metrics_without_cases_are_nan(spark):
    empty = spark.createDataFrame([], "label int, prediction double")
    row = metrics.confusion_metrics(empty).first()
    assert row["Test cases"] == 0 and all(math.isnan(row[n]) for n in ("Precision", "Recall", "F1 Score", "Accuracy"))


def test_one_pass_equals_separate_counts(spark):
    df = spark.createDataFrame([(i % 2, float(i % 3 == 0)) for i in range(60)], "label int, prediction double")
    c = metrics.confusion_counts(df).first()
    assert c.tp == df.where("prediction = 1 AND label = 1").count() and c.rn == df.where("label = 0").count()
    w = metrics.weighted_metrics(df).first()
    assert w.f1 == pytest.approx(MulticlassClassificationEvaluator(metricName="f1").evaluate(df.withColumn("label", F.col("label").cast("double"))))


def test_metric_table_ignores_unknown_names(spark, tmp_path):
    table = metrics.MetricTable(spark, {"a": "double"}).add({"a": 1.0, "zzz": 2}).add({"a": 3.0})
    assert [r.a for r in table.get("a").collect()] == [1.0, 3.0]
    table.export(str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).columns == ["a"]
    with pytest.raises(ValueError):
        table.export(str(tmp_path / "n"), "xlsx")


def test_band_detector(spark, tmp_path):
    train = vectors(spark, [[1.0, 10.0], [3.0, 10.0]])
    model = detect.MeanVarianceClassifier(0.5).fit(train)
    assert model.limits == ([1.0, 10.0], [3.0, 10.0])
    got = model.transform(vectors(spark, [[1.0, 10.0], [3.1, 10.0], [float("nan"), 10.0]])).collect()
    assert [r.prediction for r in got] == [0.0, 1.0, 0.0]
    model.write().overwrite().save(str(tmp_path / "model"))
    assert detect.MeanVarianceModel.load(str(tmp_path / "model")).limits == model.limits
    for bad in (lambda: detect.MeanVarianceClassifier(-1.0), lambda: detect.MeanVarianceModel([1.0], []),
                lambda: detect.EntropyClassifier(windowSize=0)):
        with pytest.raises(ValueError):
            bad()


def test_entropy_detector(spark):
    data = vectors(spark, [[float(i % 4), 1.0] for i in range(40)], [i // 39 for i in range(40)])
    model = detect.EntropyClassifier(numFeatures=2, numRanges=3, windowSize=8, threshold=0.0).fit(data)
    assert model.limits[0] == pytest.approx([2.0, 0.0])
    scored = model.transform(data).orderBy("window_id").collect()
    assert [(r.first_row, r.last_row, r.label, r.prediction) for r in scored][-1] == (32, 39, 1, 0.0)
    wide = detect.EntropyModel([0.0, -1.0], [3.0, 1.0])._set(windowSize=8, numRanges=3, numFeatures_=2, orderCols=[])
    wide._set(featuresCol="features", labelCol="label", predictionCol="prediction")
    assert {r.prediction for r in wide.transform(data).collect()} == {0.0}
    assert {r.prediction for r in wide.setStrictReference(True).transform(data).collect()} == {1.0}
    with pytest.raises(ValueError):
        detect.EntropyClassifier(numFeatures=3, windowSize=8).fit(data)


def test_pair_cross_validation(spark):
    legit = vectors(spark, [[float(i % 5)] for i in range(60)])
    mixed = vectors(spark, [[float(i % 5 + 50 * (i % 2))] for i in range(60)], [i % 2 for i in range(60)])
    est = detect.MeanVarianceClassifier()
    cv = tuning.PairCrossValidator(est, tuning.grid(est, {"threshold": [0.0, 2.0]}), folds=3, holdout="full")
    model = cv.fit(legit, mixed)
    assert model.bestIndex == 1 and model.avgMetrics[1] == 1.0
    assert model.transform(mixed).where("prediction <> label").count() == 0
    with pytest.raises(TypeError):
        cv.fit(legit)


@pytest.mark.parametrize("holdout", ["fold", "full"])
@pytest.mark.parametrize("metric", tuning.COUNTED_METRICS)
def test_folds_from_summaries_equal_refitting(spark, holdout, metric):
    rng = np.random.default_rng(4)
    legit = vectors(spark, (rng.normal(size=(80, 3)) * [1, 1e-3, 50] + [0, 1e6, 3]).tolist())
    mixed = vectors(spark, (rng.normal(size=(90, 3)) * [2, 2e-3, 90] + [0, 1e6, 3]).tolist(), [i % 3 // 2 for i in range(90)])
    est = detect.MeanVarianceClassifier()
    evaluator = MulticlassClassificationEvaluator(metricName=metric)
    cv = tuning.PairCrossValidator(est, tuning.grid(est, {"threshold": [0.5, 1.0, 3.0]}), evaluator, folds=4, holdout=holdout)
    a, b = cv._numbered(legit), cv._numbered(mixed)
    assert a.select("_fold").distinct().count() == 4
    for got, want in zip(cv._from_summaries(a, b), cv._one_by_one(a, b), strict=True):
        assert got == pytest.approx(want, abs=1e-12)


def test_pair_cross_validation_copies_saves_and_joins_pipelines(spark, tmp_path):
    legit = vectors(spark, [[float(i % 5)] for i in range(60)])
    mixed = vectors(spark, [[float(i % 5 + 50 * (i % 2))] for i in range(60)], [i % 2 for i in range(60)])
    est = detect.MeanVarianceClassifier()
    cv = tuning.PairCrossValidator(est, tuning.grid(est, {"threshold": [0.0, 2.0]}), folds=3, holdout="full", validation=mixed)
    model = Pipeline(stages=[cv]).fit(legit).stages[0]
    assert model.avgMetrics == cv.copy().fit(legit).avgMetrics
    model.save(str(tmp_path / "model"))
    again = tuning.PairCrossValidatorModel.load(str(tmp_path / "model"))
    assert (again.avgMetrics, again.bestIndex, again.uid) == (model.avgMetrics, model.bestIndex, model.uid)
    for other in (again, model.copy()):
        assert other.transform(mixed).where("prediction <> label").count() == 0
        assert other.bestModel.limits == model.bestModel.limits


def test_splits(spark):
    df = spark.range(2000)
    a, b = models.hash_split(df, ["id"])
    again = models.hash_split(df.repartition(5), ["id"])[0]
    assert a.count() + b.count() == 2000 and 1300 < a.count() < 1500 and a.exceptAll(again).count() == 0


def test_naive_bayes_takes_negative_features(spark):
    data = vectors(spark, [[-1.0, float(i % 2)] for i in range(20)], [i % 2 for i in range(20)])
    assert models.train_naive_bayes(data).transform(data).where("prediction = label").count() == 20


def test_trees_beat_the_majority(spark):
    data = vectors(spark, [[float(i), 1.0] for i in range(100)], [int(i > 70) for i in range(100)])
    result = jobs.evaluate(models.train_decision_tree(data), data)
    assert result["accuracy"] > 0.7 and result["auc"] > 0.7


def messages_dir(spark, path, n, start=0):
    line = ["10.0.0.1", "1", "10.0.0.2", "80", "6"] + ["1"] * 40
    spark.createDataFrame([('"' + ",".join(line) + ',"',)] * n, "value string").coalesce(1).write.mode("append").text(path)


def test_restart_continues_from_the_checkpoint(spark, tmp_path):
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    for expected in (2, 5):
        messages_dir(spark, source, 2 if expected == 2 else 3)
        parsed = codec.parse_flow_payload(readers.payload_stream(readers.stream_text(spark, source)))
        scored = parsed.select(F.lit(0).alias("label"), F.lit(1.0).alias("prediction"))
        q = sinks.run_bounded(sinks.write_predictions_csv(scored, out, state, once=True))
        assert readers.read_predictions(spark, out).count() == expected
    batches = progress.progress_metrics(spark, q).collect()
    assert [b["Input rows"] for b in batches] == [3] and batches[0]["Trigger execution"] > 0


def test_bounded_run_and_listener(spark, tmp_path):
    with progress.recorded(spark) as reports:
        rate = spark.readStream.format("rate").option("rowsPerSecond", 5).load().select(F.col("value").cast("string"))
        q = sinks.relay(rate, writers.file_writer(str(tmp_path / "out"), "text"), str(tmp_path / "state"), "1 second")
        sinks.run_bounded(q, 6)
        assert not q.isActive
    assert {"Batch id", "Run continuous"} <= set(reports.metrics(spark, q).columns)


def test_progress_of_every_batch(spark, tmp_path):
    """More batches than a query remembers, and a second query beside it; runs of one query stay apart."""
    n = 110
    source = str(tmp_path / "in")
    spark.range(n).select(F.col("id").cast("string").alias("value")).repartitionByRange(n, "value").write.text(source)

    def copy(name, files):
        stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", files).text(source)
        return sinks.relay(stream, writers.file_writer(str(tmp_path / name), "text"), str(tmp_path / f"{name}-state"), once=True)

    with progress.recorded(spark) as reports:
        one = sinks.run_bounded(copy("a", 1))
        two = sinks.run_bounded(copy("b", n))
        for q in (one, two):
            reports.catch_up(q)
    rows = reports.metrics(spark, one).where(F.col("Input rows") > 0)
    assert rows.count() > 100 and rows.agg(F.sum("Input rows")).first()[0] == n
    assert reports.metrics(spark, two).agg(F.sum("Input rows")).first()[0] == n


def test_reports_of_runs_are_kept_apart():
    class Report:
        def __init__(self, query, run, rows):
            self.id, self.runId, self.batchId = query, run, 0
            self.json = json.dumps({"batchId": 0, "timestamp": "t", "numInputRows": rows})

    class Event:
        def __init__(self, *args):
            self.progress = Report(*args)

    listener = progress.ProgressListener()
    for args in (("q", "r1", 5), ("p", "r1", 7), ("q", "r2", 3), ("q", "r2", 4)):
        listener.onQueryProgress(Event(*args))
    assert [v[2] for v in listener.rows.values()] == [5, 7, 4]


def test_packet_flow_job_exports_its_progress(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "progress")
    line = ["10.0.0.1", "10.0.0.2", "6"] + ["1"] * 23
    spark.createDataFrame([('"' + ",".join(line) + ',"',)], "value string").write.text(source)
    batches = jobs.run_packet_flows(spark, readers.stream_text(spark, source), writers.file_writer(str(tmp_path / "out"), "text"),
                                    str(tmp_path / "state"), progress_path=out, once=True)
    assert batches.agg(F.sum("Input rows")).first()[0] == 1 and spark.read.option("header", True).csv(out).count() >= 1


def test_continuous_trigger(spark, tmp_path):
    rate = spark.readStream.format("rate").load().select(
        F.col("value").cast("string").alias("srcip"), *[F.lit(1).alias(c) for c in ("srcport", "dstport", "proto")],
        F.lit("x").alias("dstip"), F.lit("now").alias("date"), F.lit(0.0).alias("prediction"))
    q = sinks.publish_predictions_json(rate, str(tmp_path / "state"), "noop", continuous=True)
    sinks.run_bounded(q, 4)
    assert not q.isActive


def test_entropy_model_does_not_score_streams(spark):
    with pytest.raises(TypeError):
        windows.score_stream(detect.EntropyModel([0.0], [1.0]), spark.range(1))


def test_run_metrics_append(spark, tmp_path):
    path = str(tmp_path / "runs")
    for name in ("a", "b"):
        writers.save_run_metrics(spark, [{"algorithm": name, "accuracy": 1.0}], path)
    back = spark.read.parquet(path)
    assert back.count() == 2 and back.columns == list(metrics.RUN_METRICS)


def test_shared_dir_is_the_configured_one(spark):
    assert session.shared_dir(spark) == (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir())
    assert schemas.LABEL == "label"


def test_frames_are_counted_in_passing(spark, tmp_path):
    data = [(1, 0.0, b"\x00" * 60), (2, 0.0, b"\x01"), (3, 0.0, None)]
    df = spark.createDataFrame(data, "seq long, ts double, frame binary")
    seen = Observation("seen")
    assert packets.decode_frames(df, counts=seen).count() == 0
    assert {v: n for v, n in seen.get.items() if n} == {"not_ip": 2, "short_frame": 1}
    df.write.parquet(str(tmp_path / "in"))
    stream = packets.decode_frames(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), counts="frames")
    q = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(p.observedMetrics["frames"]["not_ip"] for p in q.recentProgress if "frames" in p.observedMetrics) == 2


def test_a_relay_runs_beside_the_query_it_follows(spark, tmp_path):
    source, topic = str(tmp_path / "in"), str(tmp_path / "topic")
    spark.range(12).select(F.col("id").cast("string").alias("value")).repartitionByRange(6, "value").write.text(source)
    spark.createDataFrame([], "value string").write.text(topic)
    seen = []
    slow = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(source)

    def publish(batch, number):
        batch.write.mode("append").text(topic)
        time.sleep(1)

    first = sinks.for_each_batch(slow, publish, str(tmp_path / "s1"), once=True)
    second = sinks.relay(readers.stream_text(spark, topic), lambda b, n: seen.append((first.isActive, b.count())), str(tmp_path / "s2"))
    sinks.run_together(first, second)
    assert any(active and n for active, n in seen) and sum(n for _, n in seen) == 12
    assert not first.isActive and not second.isActive


def test_an_error_of_either_query_stops_both(spark, tmp_path):
    def broken(batch, number):
        raise ValueError("no index")

    rate = spark.readStream.format("rate").load().selectExpr("CAST(value AS STRING) AS value")
    first = sinks.relay(rate, lambda b, n: None, str(tmp_path / "s1"), "1 second")
    second = sinks.relay(rate, broken, str(tmp_path / "s2"))
    with pytest.raises(Exception, match="no index"):
        sinks.run_together(first, second, timeout=60)
    assert not first.isActive and not second.isActive


def test_continuous_trigger_publishes(spark, tmp_path):
    rate = spark.readStream.format("rate").option("rowsPerSecond", 20).option("numPartitions", 1).load().selectExpr("CAST(value AS STRING) AS value")
    q = rate.writeStream.format("memory").queryName("continuous_rows").trigger(continuous=sinks.CONTINUOUS_INTERVAL).start()
    try:
        for _ in range(60):
            time.sleep(0.5)
            if spark.table("continuous_rows").count():
                break
        assert spark.table("continuous_rows").count() > 0
    finally:
        q.stop()


@pytest.mark.parametrize("algorithm", ["logistic_regression", "svm", "random_forest"])
def test_models_score_in_a_session_that_has_observed(spark, algorithm):
    rows_ = [(Vectors.dense([float(i % 7)]), float(i % 7 > 3)) for i in range(70)]
    data = spark.createDataFrame(rows_, ["features", "label"])
    seen = Observation("rows")
    data.observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 70
    model = models.train(algorithm, data)
    assert model.transform(data).where("prediction = label").count() == 70
    chosen = tuning.cross_validate(models.estimator(algorithm), data, folds=2)
    assert chosen.transform(data).where("prediction = label").count() == 70


def test_more_rows_are_numbered_and_windowed_in_more_tasks(spark, monkeypatch):
    values = [(i * 7919 % 3001, float(i % 11), float(i % 5)) for i in range(3000)]
    df = codec.featurize(spark.createDataFrame(values, "at long, a double, b double"), ["a", "b"])
    def run():
        model = detect.EntropyClassifier(2, 5, 20, 0.1, ["at"]).fit(df)
        return model.limits, sorted(map(str, model.transform(df).collect()))
    whole = run()
    monkeypatch.setattr(rows, "RANGE_ROWS", 100)
    monkeypatch.setattr(detect, "TASK_ROWS", 100)
    placed = rows.number_rows(df, ["at"])
    assert placed.rdd.getNumPartitions() == 30
    assert [r["at"] for r in placed.orderBy("row_index").collect()] == sorted(v[0] for v in values)
    assert rows.spread(placed, "at", 100).rdd.getNumPartitions() == 30
    assert run() == whole


def test_algorithms_of_a_sweep_run_side_by_side(spark, monkeypatch):
    met = threading.Barrier(2, timeout=20)

    def run(data, algorithm, dataset="", params=None, **options):
        met.wait()
        return dict.fromkeys(metrics.RUN_METRICS) | {"algorithm": algorithm}

    monkeypatch.setattr(jobs, "train_and_evaluate", run)
    table = spark.createDataFrame([(Vectors.dense([1.0]), 1.0)], ["features", "label"])
    assert [r["algorithm"] for r in jobs.sweep(table, ["svm", "decision_tree"]).collect()] == ["svm", "decision_tree"]


def test_folds_are_fitted_side_by_side_with_the_choice_of_spark(spark, monkeypatch):
    rows_ = [(Vectors.dense([float(i % 7), float(i % 3)]), float(i % 7 + i % 3 > 4)) for i in range(400)]
    data = spark.createDataFrame(rows_, ["features", "label"]).repartition(3).cache()
    est = models.estimator("decision_tree", seed=1)
    points = tuning.grid(est, {"maxDepth": [1, 4]})
    judge = MulticlassClassificationEvaluator(labelCol="label", metricName="f1")
    one_by_one = CrossValidator(estimator=est, estimatorParamMaps=points, evaluator=judge, numFolds=4, seed=tuning.SEED).fit(data)
    met, fit = threading.Barrier(2, timeout=20), type(est)._fit

    def together(self, dataset):
        if len(dataset.columns) > 2:
            met.wait()
        return fit(self, dataset)

    monkeypatch.setattr(type(est), "_fit", together)
    found = tuning.cross_validate(est, data, points, folds=4)
    assert found.avgMetrics == pytest.approx(one_by_one.avgMetrics) and found.avgMetrics[0] < found.avgMetrics[1]
    assert found.bestModel.toDebugString.split("\n", 1)[1] == one_by_one.bestModel.toDebugString.split("\n", 1)[1]
    assert found.getNumFolds() == 4 and found.getEstimatorParamMaps() == points
    data.unpersist()


def test_empty_fields_of_messages_cost_no_exceptions(spark):
    def seconds(field):
        lines = spark.range(0, 40_000, 1, 1).select(F.lit(",".join([field] * 26)).alias("value"), "id")
        lines = lines.select(F.concat("value", F.lit("")).alias("value")).repartition(1).cache()
        lines.count()
        parsed = codec.parse_packet_payload(lines)
        took = [models.timed(lambda: parsed.write.format("noop").mode("overwrite").save())[1] for _ in range(3)]
        lines.unpersist()
        return min(took)

    assert codec.parse_packet_payload(spark.createDataFrame([(", ,\t,7.0",)], ["value"])).first()[2:5] == (None, 7, None)
    assert seconds("") < 2 * seconds("1")


@pytest.mark.parametrize("holdout", ["fold", "full"])
def test_folds_of_row_windows_take_one_ordering_of_the_rows(spark, holdout, monkeypatch):
    rng = np.random.default_rng(5)
    # The order ties, folds have runs of rows of their own, and ranges hold a few windows each.
    table = [(int(at) // 3, int(at) // 40 % 3 if at % 2 else int(at) % 3, float(a), float(b), int(at) % 7 // 6)
             for at, a, b in zip(range(400), rng.integers(0, 9, 400), rng.normal(size=400), strict=True)]
    data = codec.featurize(spark.createDataFrame(table, "at int, fold int, a double, b double, label int"), ["a", "b"])
    est = detect.EntropyClassifier(2, 4, 7, 0.1, ["at"])
    points = tuning.grid(est, {"threshold": [0.0, 0.2], "windowSize": [7, 11]})
    cv = tuning.PairCrossValidator(est, points, folds=3, holdout=holdout, fold_col="fold")
    a, b = cv._numbered(data.where("label = 0")), cv._numbered(data)
    expected = cv._one_by_one(a, b)
    monkeypatch.setattr(rows, "RANGE_ROWS", 40)
    monkeypatch.setattr(detect, "RUNS", 16)
    cut, calls = rows.splitters, []
    monkeypatch.setattr(rows, "splitters", lambda *args: calls.append(1) or cut(*args))
    model = cv.fit(data.where("label = 0"), data)
    assert np.allclose(cv._from_windows(a, b), expected, rtol=0, atol=1e-12)
    assert model.avgMetrics == pytest.approx(np.mean(expected, axis=1).tolist(), abs=1e-12)
    # For either window size both datasets, and the best point: whatever the number of folds.
    assert len(calls) == 5 + 4


def test_runs_over_several_ranges_are_counted_once(spark, monkeypatch):
    values = np.random.default_rng(6).integers(0, 6, (130, 2)).astype(float)
    data = vectors(spark, values.tolist())
    monkeypatch.setattr(rows, "RANGE_ROWS", 4)  # shorter than a run
    with detect.leave_out_entropies(data, "features", 12, 5, ["row_index"]) as found:
        got = {(r["feature"], r["entropy"]): r["windows"] for r in found.collect()}
    want = {}
    for f, column in enumerate(detect.run_entropies(values, 12, 5).T):
        want |= {(f, e): n for e, n in zip(*(x.tolist() for x in np.unique(column, return_counts=True)), strict=True)}
    assert got == want
