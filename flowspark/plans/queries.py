"""Registered queries: every operator over the whole base tables, with its SQL where SQL can say it."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from flowspark import schemas
from flowspark.operators import (
    aggflows, codec, detect, flows, histograms, metrics, models, packets, rows, tuning,
)
from flowspark.plans import jobs
from flowspark.plans import oracle as O
from flowspark.session import scratch_dir
from flowspark.sources import fixtures, readers, writers
from flowspark.streaming import batches, progress, sinks, stateful, windows

QUERIES: dict = {}
ORACLES: dict = {}
FLOW_FEATURES = O.FEATURES
SMALL_BLOCKS = 512  # forces every key through many blocks
PIECE_ROWS = 16  # cuts most keys of the small tables into several pieces
BENCH_BLOCKS = 4096


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _packets(spark, sf):
    return fixtures.packets(spark, sf)


def _records(spark, sf):
    return fixtures.packet_records(_packets(spark, sf))


def _flows(spark, sf):
    """Labelled statistics flows."""
    return fixtures.labelled(flows.flow_stats(_packets(spark, sf)))


def _rounded(df: DataFrame, columns=schemas.AGG_MEANS, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns if c in df.columns})


def _measure_vectors(spark, sf):
    return codec.featurize(fixtures.measures(spark, sf), fixtures.MEASURES)


def _event_stream(spark, sf):
    table = spark.read.parquet(f"{sf}/events.parquet")
    # A file stream takes folders or patterns, not the name of one file.
    return spark.readStream.schema(table.schema).parquet(f"{sf}/events.parque[t]")


@contextmanager
def _state_partitions(spark):
    """A stateful stream keeps the number of partitions it starts with: no more than two per core."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 2 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _collect_stream(spark, stream, fmt="parquet"):
    """Run a stream to the end of its input; what it wrote, and the finished query."""
    out, state = scratch_dir(spark, "out"), scratch_dir(spark, "state")
    q = stream.writeStream.format(fmt).option("path", out).option("checkpointLocation", state)
    with _state_partitions(spark):
        q = sinks.run_bounded(q.trigger(availableNow=True).start())
    return out, state, q


def _flow_files(spark, sf):
    path = scratch_dir(spark, "flows")
    _flows(spark, sf).write.csv(path)
    return path


def _flow_table(spark, sf):
    """Labelled flows as jobs get them: a table of flow records."""
    return readers.read_flows(spark, _flow_files(spark, sf))


def _flow_messages(spark, sf):
    path = scratch_dir(spark, "messages")
    codec.encode_flow_message(_flows(spark, sf)).write.text(path)
    return path


_LABELLED = O.flow_query(f"SELECT {O.STATS}, CAST({O.LABEL} AS BIGINT) AS label FROM flows")
_UNLABELLED = O.flow_query(f"SELECT {O.STATS}, CAST(NULL AS BIGINT) AS label FROM flows")
_FLOW_KEYS = O.flow_query("SELECT srcip, srcport, dstip, dstport, proto FROM flows")
# What the mean/variance detector, fitted on all flows, says of each flow.
_BANDS = ", ".join(f"avg({c}) - 2.0 * var_samp({c}) AS low_{c}, avg({c}) + 2.0 * var_samp({c}) AS high_{c}" for c in schemas.STATS_FLOW.feature_cols)
_OUTSIDE = " OR ".join(f"{c} < low_{c} OR {c} > high_{c}" for c in schemas.STATS_FLOW.feature_cols)
_DETECTED = O.flow_query(
    f"SELECT srcip, srcport, dstip, dstport, proto, CASE WHEN {_OUTSIDE} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction "
    f"FROM flows, (SELECT {_BANDS} FROM flows)")
_AGG = f"WITH {O.RECORDS} SELECT {O.AGG_COLUMNS} FROM ({O.agg_flows()})"
_AGG_LABELLED = f"WITH {O.RECORDS} SELECT {O.AGG_COLUMNS}, CAST(0 AS BIGINT) AS label FROM ({O.agg_flows()})"
_PREDICTIONS = "p AS (SELECT toxic AS label, CAST(quality AS DOUBLE) AS prediction FROM labels)"
_CONFUSION = """c AS (SELECT count(*) AS size, count(*) FILTER (WHERE label = 0) AS rn, count(*) FILTER (WHERE label = 1) AS rp,
 count(*) FILTER (WHERE prediction = 0) AS pn, count(*) FILTER (WHERE prediction = 1) AS pp,
 count(*) FILTER (WHERE prediction = 1 AND label = 1) AS tp, count(*) FILTER (WHERE prediction = 0 AND label = 0) AS tn,
 count(*) FILTER (WHERE prediction = 1 AND label = 0) AS fp, count(*) FILTER (WHERE prediction = 0 AND label = 1) AS fn FROM p)"""
_PREDICTION_METRICS = f"""WITH {_PREDICTIONS}, {_CONFUSION}
SELECT size AS "Test cases", rn AS "Real negative", rp AS "Real positive", pn AS "Predicted negative", pp AS "Predicted positive",
 round(CASE WHEN tp + fp = 0 THEN 'nan'::DOUBLE ELSE tp / (tp + fp) END, 9) AS "Precision",
 round(CASE WHEN tp + fn = 0 THEN 'nan'::DOUBLE ELSE tp / (tp + fn) END, 9) AS "Recall",
 round(CASE WHEN 2 * tp + fp + fn = 0 THEN 'nan'::DOUBLE ELSE 2.0 * tp / (2 * tp + fp + fn) END, 9) AS "F1 Score",
 round((tp + tn) / (tp + tn + fp + fn), 9) AS "Accuracy" FROM c"""


# Sources and sinks

@query(_LABELLED)
def src1_read_flows(spark, sf):
    return readers.read_flows(spark, _flow_files(spark, sf))


@query(_LABELLED)
def src2_stream_flows(spark, sf):
    out, _, _ = _collect_stream(spark, readers.stream_flows(spark, _flow_files(spark, sf)))
    return spark.read.parquet(out)


@query(_UNLABELLED)
def src3_payload_stream(spark, sf):
    messages = readers.stream_text(spark, _flow_messages(spark, sf))
    out, _, _ = _collect_stream(spark, codec.parse_flow_payload(readers.payload_stream(messages)))
    return spark.read.parquet(out)


def _prediction_files(spark, sf):
    table = spark.read.parquet(f"{sf}/labels.parquet")
    stream = spark.readStream.schema(table.schema).parquet(f"{sf}/labels.parque[t]").select(
        F.col("toxic").cast("int").alias("label"), F.col("quality").cast("double").alias("prediction"))
    path = scratch_dir(spark, "predictions")
    sinks.run_bounded(sinks.write_predictions_csv(stream, path, once=True))
    return path


@query(_PREDICTION_METRICS)
def snk1_src4_predictions_csv(spark, sf):
    result = metrics.confusion_metrics(readers.read_predictions(spark, _prediction_files(spark, sf)))
    return _rounded(result, ("Precision", "Recall", "F1 Score", "Accuracy"), 9)


def _published(spark, sf, label, **options):
    """Packets of the stream's one micro-batch published as flow messages, parsed back."""
    path = scratch_dir(spark, "topic")
    stream = fixtures.packet_records(fixtures.packets_from_events(_event_stream(spark, sf)))
    q = sinks.publish_flows(
        stream, writers.file_writer(path, "text"), scratch_dir(spark, "state"), label, once=True, **options)
    sinks.run_bounded(q)
    messages = spark.read.option("recursiveFileLookup", True).text(path)
    return _rounded(codec.parse_fields(messages, schemas.AGG_FLOW.schema))


@query(_AGG_LABELLED)
def snk2_publish_flows(spark, sf):
    return _published(spark, sf, 0)


def _online(spark, sf):
    """Training flows and a stream of flow messages."""
    return _flow_table(spark, sf), readers.stream_text(spark, _flow_messages(spark, sf))


@query(_DETECTED)
def snk3_publish_predictions_json(spark, sf):
    path = scratch_dir(spark, "topic")
    scored = jobs.scored_messages(*_online(spark, sf), "mean_variance")
    sinks.run_bounded(sinks.publish_predictions_json(scored, scratch_dir(spark, "state"), once=True, path=path))
    layout = "srcip STRING, srcport BIGINT, dstip STRING, dstport BIGINT, proto BIGINT, date STRING, prediction DOUBLE"
    rows_ = spark.read.text(path).select(F.from_json("value", layout).alias("r")).select("r.*")
    return rows_.where(F.col("date").isNotNull()).drop("date")


def _indexed(spark, sf, algorithm):
    path = scratch_dir(spark, "index")
    q = jobs.score_to_index(*_online(spark, sf), algorithm, writers.file_writer(path), scratch_dir(spark, "state"), once=True)
    sinks.run_bounded(q)
    docs = spark.read.schema(
        "srcip STRING, srcport BIGINT, dstip STRING, dstport BIGINT, proto BIGINT, prediction DOUBLE"
    ).option("recursiveFileLookup", True).json(path)
    return docs.where(F.col("prediction").isin(0.0, 1.0))


@query(_DETECTED)
def snk4_index_predictions(spark, sf):
    return _indexed(spark, sf, "mean_variance")


@query(O.flow_query(
    "SELECT srcip || ',' || srcport || ',' || dstip || ',' || dstport || ',' || proto AS value FROM flows"))
def snk5_relay(spark, sf):
    first, path = scratch_dir(spark, "topic"), scratch_dir(spark, "index")
    codec.encode_flow_csv(_flows(spark, sf), list(schemas.STATS_FLOW.key_cols)).write.text(first)
    q = sinks.relay(readers.stream_text(spark, first), writers.file_writer(path, "text"), scratch_dir(spark, "state"), once=True)
    sinks.run_bounded(q)
    return spark.read.option("recursiveFileLookup", True).text(path)


@query()
def snk6_save_run_metrics(spark, sf):
    path = scratch_dir(spark, "runs")
    run = jobs.train_and_evaluate(_flow_table(spark, sf), "decision_tree", sf.rstrip("/").rpartition("/")[2])
    writers.save_run_metrics(spark, [run], path)
    return spark.read.parquet(path)


@query(_PREDICTION_METRICS)
def snk7_export_metrics_csv(spark, sf):
    path = scratch_dir(spark, "metrics")
    table = metrics.MetricTable(spark, metrics.PREDICTION_METRICS)
    table.add(metrics.confusion_metrics(fixtures.label_predictions(spark, sf))).export(path)
    back = spark.read.option("header", True).schema(metrics.metric_schema(metrics.PREDICTION_METRICS)).csv(path)
    return _rounded(back, ("Precision", "Recall", "F1 Score", "Accuracy"), 9)


_CSV_LINE = " || ',' || ".join(FLOW_FEATURES)


@query(O.flow_query(f"SELECT {_CSV_LINE} || ',live' AS value FROM flows"))
def snk8_append_flow_text(spark, sf):
    path = scratch_dir(spark, "lines")
    writers.append_flow_text(flows.flow_stats(_packets(spark, sf)), path, "live")
    return spark.read.text(path)


# Projections and codecs

@query(_UNLABELLED)
def prj1_parse_flow_payload(spark, sf):
    return codec.parse_flow_payload(codec.encode_flow_message(_flows(spark, sf)))


_RECORD_COLUMNS = ", ".join(schemas.PACKET_COLUMNS)


@query(f"WITH {O.RECORDS} SELECT seq, {_RECORD_COLUMNS} FROM records")
def prj2_parse_packet_payload(spark, sf):
    core = _packets(spark, sf)
    records = fixtures.packet_records(core, keep=("seq",))
    messages = codec.encode_flow_csv(records, schemas.PACKET_COLUMNS, keep=("seq",))
    return codec.parse_packet_payload(messages, keep=("seq",))


@query(O.flow_query(f"SELECT {_CSV_LINE} || ',' || {O.LABEL} AS value FROM flows"))
def prj3_encode_flow_csv(spark, sf):
    return codec.encode_flow_csv(_flows(spark, sf))


@query(O.flow_query(
    """SELECT '{"srcip":"' || srcip || '","srcport":' || srcport || ',"dstip":"' || dstip || '","dstport":' || dstport
 || ',"proto":' || proto || ',"date":"' || duration || '","prediction":' || """ + O.LABEL + """ || '.0}' AS value FROM flows"""))
def prj4_encode_prediction_json(spark, sf):
    scored = _flows(spark, sf).withColumns({
        "date": F.col("duration").cast("string"), "prediction": F.col("label").cast("double")})
    return codec.encode_prediction_json(scored)


def _vector_sum(df, keep):
    total = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x)
    return df.select(*keep, F.size(vector_to_array("features")).alias("n"), F.round(total, 4).alias("total"))


@query(O.flow_query(f"SELECT srcip, dstip, proto, 40 AS n, round(CAST({' + '.join(FLOW_FEATURES[5:])} AS DOUBLE), 4) AS total FROM flows"))
def prj5_featurize_stats(spark, sf):
    return _vector_sum(codec.featurize_stats(_flows(spark, sf)), ("srcip", "dstip", "proto"))


@query(f"""WITH {O.RECORDS} SELECT srcaddr, dstaddr, 24 AS n, round({' + '.join(schemas.AGG_FLOW_COLUMNS[2:-1])}, 4) AS total
FROM ({O.agg_flows()})""")
def prj6_featurize_agg(spark, sf):
    rounded = _rounded(aggflows.packet_flows(_records(spark, sf)))
    return _vector_sum(codec.featurize_agg(rounded), ("srcaddr", "dstaddr"))


@query(f"WITH {O.RECORDS} SELECT {O.AGG_COLUMNS}, 1 AS label FROM ({O.agg_flows()})")
def prj7_set_label(spark, sf):
    return aggflows.set_label(_rounded(aggflows.packet_flows(_records(spark, sf))), 1)


@query(O.flow_query("SELECT srcip, srcport, dstip, dstport, proto, 26 AS date_chars FROM flows"))
def prj8_stamp_time(spark, sf):
    return codec.stamp_time(_flows(spark, sf)).select(
        *schemas.STATS_FLOW.key_cols, F.length("date").alias("date_chars"))


@query("SELECT toxic AS label, CAST(quality AS DOUBLE) AS prediction FROM labels")
def prj9_prediction_columns(spark, sf):
    return codec.prediction_columns(fixtures.label_predictions(spark, sf))


_FRAME_VERDICT = """CASE WHEN seq % 50 = 7 THEN 'not_ip' WHEN seq % 50 IN (8, 11) THEN 'short_frame' WHEN seq % 50 = 9 THEN 'not_ipv4'
 WHEN proto = 1 THEN 'other_protocol' WHEN seq % 50 = 10 THEN CASE WHEN proto = 6 THEN 'short_tcp' ELSE 'short_udp' END ELSE 'ok' END"""


@query(f"""WITH {O.PACKETS} SELECT seq, CAST(trunc((ts_us / 1000000.0::DOUBLE) * 1000000.0::DOUBLE) AS BIGINT) AS ts_us,
srcip, dstip, srcport, dstport, proto, len, iphlen, prhlen, dscp, ttl, flags FROM packets WHERE {_FRAME_VERDICT} = 'ok'""")
def prj10_decode_frames(spark, sf):
    return packets.decode_frames(fixtures.frames(_packets(spark, sf)))


# Filters

@query(f"WITH {O.PACKETS} SELECT seq, srcip, dstip, proto FROM packets WHERE proto = 17")
def flt1_by_protocol(spark, sf):
    return aggflows.by_protocol(_packets(spark, sf), schemas.UDP, "proto").select("seq", "srcip", "dstip", "proto")


@query(f"WITH {O.PACKETS} SELECT {_FRAME_VERDICT} AS verdict, count(*) AS frames FROM packets GROUP BY 1")
def flt2_count_frames(spark, sf):
    return packets.count_frames(fixtures.frames(_packets(spark, sf)))


@query(f"""WITH {O.PACKETS}, v AS (SELECT {_FRAME_VERDICT} AS verdict, srcip FROM packets WHERE seq >= 0)
SELECT verdict, CASE WHEN verdict = 'ok' THEN count(*) END AS kept, count(*) AS frames FROM v GROUP BY verdict""")
def flt2_counts_while_decoding(spark, sf):
    """Frames by verdict as observed by the very pass that keeps the decoded ones."""
    seen = Observation("frames")
    kept = packets.decode_frames(fixtures.frames(_packets(spark, sf)), counts=seen).agg(F.count(F.lit(1)).alias("n")).first()["n"]
    found = [(v, kept if v == "ok" else None, n) for v, n in seen.get.items() if n]
    return spark.createDataFrame(found, "verdict string, kept bigint, frames bigint")


@query(f"WITH {_PREDICTIONS}, {_CONFUSION} SELECT * FROM c")
def flt3_confusion_counts(spark, sf):
    return metrics.confusion_counts(fixtures.label_predictions(spark, sf))


_BAND = ([10.0, 1000.0, 0.02, 0.0], [45.0, 60000.0, 0.09, 0.07])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity < 10 OR l_quantity > 45
 OR l_extendedprice < 1000 OR l_extendedprice > 60000 OR l_discount < 0.02 OR l_discount > 0.09 OR l_tax < 0 OR l_tax > 0.07
 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction FROM lineitem""")
def flt4_band_predicate(spark, sf):
    verdict = detect.outside([F.col(c) for c in fixtures.MEASURES], *_BAND)
    return fixtures.measures(spark, sf).select(*fixtures.MEASURE_ORDER, verdict.alias("prediction"))


@query(O.flow_query("SELECT seq, ts_us FROM marked"))
def flt5_late_packets(spark, sf):
    keyed, key = flows.keyed_rows(_packets(spark, sf))
    return flows.drop_late(flows.newest_before(keyed, key)).select("seq", "ts_us")


# Aggregations

def _agg_query(protos, flags="set"):
    return f"WITH {O.RECORDS} SELECT {O.AGG_COLUMNS} FROM ({O.agg_flows(protos, flags)})"


@query(_agg_query((6,)))
def agg1_tcp_flows(spark, sf):
    return _rounded(aggflows.tcp_flows(_records(spark, sf)))


@query(_agg_query((17,)))
def agg2_udp_flows(spark, sf):
    return _rounded(aggflows.udp_flows(_records(spark, sf)))


@query(_agg_query((1,)))
def agg3_icmp_flows(spark, sf):
    return _rounded(aggflows.icmp_flows(_records(spark, sf)))


@query(_AGG)
def agg4_packet_flows(spark, sf):
    return _rounded(aggflows.packet_flows(_records(spark, sf)))


@query(_agg_query((6, 17, 1), "nonnull"))
def agg5_flags_present(spark, sf):
    return _rounded(aggflows.packet_flows(_records(spark, sf), flags="nonnull"))


@query(f"WITH {O.RECORDS} SELECT srcaddr, dstaddr, ip_proto, qtd_src_port, qtd_dst_port FROM ({O.agg_flows()})")
def agg6_distinct_ports(spark, sf):
    found = aggflows.packet_flows(_records(spark, sf), keep_proto=True)
    return found.select("srcaddr", "dstaddr", "ip_proto", "qtd_src_port", "qtd_dst_port")


@query(_PREDICTION_METRICS)
def agg7_confusion_metrics(spark, sf):
    result = metrics.confusion_metrics(fixtures.label_predictions(spark, sf))
    return _rounded(result, ("Precision", "Recall", "F1 Score", "Accuracy"), 9)


@query(f"""WITH {O.MEASURES}, l AS ({O.long_measures()})
SELECT feature, round(avg(value), 4) AS mean, round(var_samp(value), 2) AS variance FROM l GROUP BY feature""")
def agg8_feature_summary(spark, sf):
    summary = detect.feature_summary(fixtures.measures(spark, sf), fixtures.MEASURES)
    return summary.select("feature", F.round("mean", 4).alias("mean"), F.round("variance", 2).alias("variance"))


def _long(spark, sf):
    return histograms.unpivot(fixtures.measures(spark, sf), fixtures.MEASURES)


@query(f"""WITH {O.MEASURES}, l AS ({O.long_measures()}), {O.entropy_ctes(1, 10, "feature", "l")}
SELECT feature, bucket, n FROM ent_bucket""")
def agg9_value_histogram(spark, sf):
    return histograms.value_histogram(_long(spark, sf), 10, ["feature"], few_groups=True)


_EVEN = f"""{O.MEASURES}, l AS ({O.long_measures()}),
r AS (SELECT feature, min(value) AS low, max(value) AS high FROM l GROUP BY feature),
counted AS (SELECT feature, least(CAST(floor((value - low) / (high - low) * 12) AS INTEGER), 11) AS bucket, count(*) AS n
            FROM l JOIN r USING (feature) GROUP BY ALL),
even AS (SELECT feature, bucket, round(low + (bucket * (high - low)) / 12, 6) AS lower,
  round(CASE WHEN bucket = 11 THEN high ELSE low + ((bucket + 1) * (high - low)) / 12 END, 6) AS upper, coalesce(n, 0) AS n
  FROM (SELECT r.*, CAST(unnest(range(12)) AS INTEGER) AS bucket FROM r) LEFT JOIN counted USING (feature, bucket))"""


@query(f"WITH {_EVEN} SELECT * FROM even")
def agg10_even_histogram(spark, sf):
    return _rounded(histograms.even_histogram(_long(spark, sf), 12, ["feature"], few_groups=True), ("lower", "upper"))


@query(f"WITH {_EVEN} SELECT * FROM even QUALIFY row_number() OVER (PARTITION BY feature ORDER BY n DESC, bucket) = 1")
def top1_most_frequent_bucket(spark, sf):
    hist = histograms.even_histogram(_long(spark, sf), 12, ["feature"], few_groups=True)
    return _rounded(histograms.top_bucket(hist, ["feature"]), ("lower", "upper"))


@query(f"""WITH {O.MEASURES}, w AS (SELECT *, row_index // 50 AS window_id FROM m),
l AS ({O.long_measures("window_id", "w")}), {O.entropy_ctes(50, 5, "window_id, feature", "l")}
SELECT window_id, feature, round(entropy, 9) AS entropy FROM ent""")
def agg11_entropy(spark, sf):
    placed = rows.tumbling_rows(fixtures.measures(spark, sf), 50, fixtures.TOTAL_ORDER)
    cells = histograms.unpivot(placed, fixtures.MEASURES, ["window_id"])
    return _rounded(histograms.entropy(cells, 5, 50, ["window_id", "feature"]), ("entropy",), 9)


@query(f"""WITH {_PREDICTIONS}, {_CONFUSION} SELECT round((tp + tn) / size, 9) AS accuracy,
round(CASE WHEN pp = 0 THEN 0 ELSE tp / pp END, 9) AS precision, round(CASE WHEN rp = 0 THEN 0 ELSE tp / rp END, 9) AS recall,
round(CASE WHEN pp + rp = 0 THEN 0 ELSE 2.0 * tp / (pp + rp) END, 9) AS "f1-score" FROM c""")
def agg12_class_metrics(spark, sf):
    result = metrics.class_metrics(fixtures.label_predictions(spark, sf))
    return _rounded(result, result.columns, 9)


def _one_row(spark, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"`{n}` double" for n in values))


@query(f"""WITH {_PREDICTIONS}, v AS (SELECT prediction, count(*) FILTER (WHERE label = 1) AS pos,
count(*) FILTER (WHERE label = 0) AS neg FROM p GROUP BY prediction),
s AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY prediction ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM v)
SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 9) AS auc FROM s""")
def agg13_area_under_roc(spark, sf):
    scored = fixtures.label_predictions(spark, sf)
    return _one_row(spark, auc=round(metrics.area_under_roc(scored, raw="prediction"), 9))


@query(f"""WITH {_PREDICTIONS}, cls AS (SELECT unnest([0, 1]) AS k),
s AS (SELECT k, count(*) FILTER (WHERE label = k) AS support, count(*) FILTER (WHERE prediction = k) AS said,
 count(*) FILTER (WHERE label = k AND prediction = k) AS hit, count(*) AS n FROM p, cls GROUP BY k),
q AS (SELECT *, CASE WHEN said = 0 THEN 0 ELSE hit / said END AS pr, CASE WHEN support = 0 THEN 0 ELSE hit / support END AS re FROM s)
SELECT round(sum(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END * support / n), 9) AS f1,
 round(sum(pr * support / n), 9) AS "weightedPrecision", round(sum(re * support / n), 9) AS "weightedRecall",
 round(sum(hit) / any_value(n), 9) AS accuracy FROM q""")
def agg14_weighted_metrics(spark, sf):
    result = metrics.weighted_metrics(fixtures.label_predictions(spark, sf))
    return _rounded(result, result.columns, 9)


# Flow statistics

@query(O.flow_query("SELECT seq, k_ip1, k_port1, k_ip2, k_port2, proto FROM keyed"))
def flw1_flow_key(spark, sf):
    keyed = flows.flow_key(_packets(spark, sf)).where(F.col("proto").isin(schemas.TCP, schemas.UDP))
    return keyed.select("seq", *flows.KEY)


@query(O.flow_query("SELECT seq, flow_seq FROM dirs"))
def flw2_split_flows_timeout(spark, sf):
    return flows.assign_flows(_packets(spark, sf)).select("seq", "flow_seq")


def _tracked(spark, sf, **options):
    return flows.flow_table(_packets(spark, sf), tcp_close=True, **options)


_TCP_FLOWS = O.flow_query(
    "SELECT srcip, srcport, dstip, dstport, flow_seq, total_fpackets, total_bpackets, end_reason FROM flows WHERE proto = 6",
    tcp_close=True)


@query(_TCP_FLOWS)
def flw3_split_flows_tcp(spark, sf):
    return _tracked(spark, sf).where(F.col("proto") == schemas.TCP).select(
        "srcip", "srcport", "dstip", "dstport", "flow_seq", "total_fpackets", "total_bpackets", "end_reason")


@query(_TCP_FLOWS)
def flw3_split_flows_tcp_in_blocks(spark, sf):
    return _tracked(spark, sf, block_rows=SMALL_BLOCKS).where(F.col("proto") == schemas.TCP).select(
        "srcip", "srcport", "dstip", "dstport", "flow_seq", "total_fpackets", "total_bpackets", "end_reason")


def _portless(spark, sf):
    """Packets, some hosts' without ports."""
    hidden = F.col("srcip").isin(*O.PORTLESS) | F.col("dstip").isin(*O.PORTLESS)
    return _packets(spark, sf).withColumns({c: F.when(~hidden, F.col(c)) for c in ("srcport", "dstport")})


_PORTLESS_STATS = O.portless_flow_query(f"SELECT {O.STATS} FROM flows")
_PORTLESS_TCP = O.portless_flow_query(
    "SELECT srcip, srcport, dstip, dstport, flow_seq, total_fpackets, total_bpackets, end_reason FROM flows WHERE proto = 6",
    tcp_close=True)


@query(_PORTLESS_STATS)
def flw19_flow_stats_null_ports(spark, sf):
    return flows.flow_stats(_portless(spark, sf))


@query(_PORTLESS_STATS)
def flw19_flow_stats_null_ports_in_blocks(spark, sf):
    return flows.flow_stats(_portless(spark, sf), block_rows=SMALL_BLOCKS)


@query(_PORTLESS_TCP)
def flw3_split_flows_tcp_null_ports(spark, sf):
    return flows.flow_table(_portless(spark, sf), tcp_close=True).where(F.col("proto") == schemas.TCP).select(
        "srcip", "srcport", "dstip", "dstport", "flow_seq", "total_fpackets", "total_bpackets", "end_reason")


@query(_PORTLESS_TCP)
def flw3_split_flows_tcp_null_ports_in_blocks(spark, sf):
    found = flows.flow_table(_portless(spark, sf), tcp_close=True, block_rows=SMALL_BLOCKS)
    return found.where(F.col("proto") == schemas.TCP).select(
        "srcip", "srcport", "dstip", "dstport", "flow_seq", "total_fpackets", "total_bpackets", "end_reason")


@query(O.flow_query("SELECT seq, flow_seq, hit AS valid_hit, closes FROM marked WHERE proto = 6", tcp_close=True))
def flw4_tcp_state(spark, sf):
    keyed, key = flows.keyed_rows(_packets(spark, sf))
    marked = flows.along_blocks(flows.mark_runs(flows.mark_tcp_rows(keyed, key), key), key)
    return marked.where(F.col("proto") == schemas.TCP).select("seq", "flow_seq", "valid_hit", "closes")


@query(O.flow_query("SELECT seq, CASE WHEN fwd THEN 'f' ELSE 'b' END AS direction FROM dirs"))
def flw5_direction(spark, sf):
    return flows.assign_flows(_packets(spark, sf), block_rows=SMALL_BLOCKS).select("seq", "direction")


@query(O.flow_query("SELECT seq, flow_seq, burst_seq, gap FROM dirs"))
def flw6_bursts(spark, sf):
    return flows.assign_flows(_packets(spark, sf), block_rows=SMALL_BLOCKS).select("seq", "flow_seq", "burst_seq", "gap")


def _part(name, columns, **options):
    """A query for some columns of the flow statistics, with the flow's key."""
    columns = ["srcip", "srcport", "dstip", "dstport", "proto", *columns.split()]

    def run(spark, sf):
        return flows.flow_table(_packets(spark, sf), **options).select(*columns)

    run.__name__ = name
    query(O.flow_query(f"SELECT {', '.join(columns)} FROM flows"))(run)


_part("flw7_totals", "total_fpackets total_fvolume total_bpackets total_bvolume")
_part("flw8_packet_lengths", "min_fpktl mean_fpktl max_fpktl std_fpktl min_bpktl mean_bpktl max_bpktl std_bpktl")
_part("flw9_inter_arrival", "min_fiat mean_fiat max_fiat std_fiat min_biat mean_biat max_biat std_biat")
_part("flw10_duration", "duration")
_part("flw11_active", "min_active mean_active max_active std_active")
_part("flw12_idle", "min_idle mean_idle max_idle std_idle")
_part("flw13_sub_flows", "sflow_fpackets sflow_fbytes sflow_bpackets sflow_bbytes")
_part("flw14_flag_counts", "fpsh_cnt bpsh_cnt furg_cnt burg_cnt")
_part("flw15_integer_std", "std_fpktl std_bpktl std_fiat std_biat std_active std_idle")
_part("flw16_header_lengths", "total_fhlen total_bhlen")
_part("flw17_dscp", "dscp")


@query(O.flow_query("SELECT srcip, srcport, dstip, dstport, proto, flow_seq, valid FROM flows", tcp_close=True))
def flw18_valid(spark, sf):
    return _tracked(spark, sf).select(*schemas.STATS_FLOW.key_cols, "flow_seq", "valid")


@query(O.flow_query(f"SELECT {O.STATS} FROM flows"))
def flw19_flow_stats(spark, sf):
    return flows.flow_stats(_packets(spark, sf))


@query(O.flow_query(f"SELECT {O.STATS} FROM flows"))
def flw19_flow_stats_in_blocks(spark, sf):
    return flows.flow_stats(_packets(spark, sf), block_rows=SMALL_BLOCKS)


@query(O.flow_query(f"SELECT {O.STATS} FROM flows", tcp_close=True))
def flw19_flow_stats_tcp_close(spark, sf):
    return flows.flow_stats(_packets(spark, sf), tcp_close=True)


@query(O.flow_query(f"SELECT {O.STATS} FROM flows"))
def flw19_flow_stats_blocks_4096(spark, sf):
    return flows.flow_stats(_packets(spark, sf), block_rows=BENCH_BLOCKS)


@query(O.flow_query(f"SELECT {O.STATS} FROM flows", tcp_close=True))
def flw19_flow_stats_tcp_close_blocks_4096(spark, sf):
    return flows.flow_stats(_packets(spark, sf), tcp_close=True, block_rows=BENCH_BLOCKS)


@query(O.flow_query(f"SELECT {O.STATS} FROM flows", tcp_close=True))
def flw19_flow_stats_tcp_close_in_blocks(spark, sf):
    return flows.flow_stats(_packets(spark, sf), tcp_close=True, block_rows=PIECE_ROWS)


@query(O.flow_query(f"SELECT {O.STATS} FROM flows WHERE end_reason = 'open' AND valid", tcp_close=True))
def flw20_emit_open(spark, sf):
    return flows.flow_stats(_packets(spark, sf), tcp_close=True, policy="open", valid_only=True)


@query(O.flow_query(f"SELECT {O.STATS}, k_window FROM flows", window=True))
def flw21_capture_window(spark, sf):
    found = flows.flow_table(_packets(spark, sf), window_us=flows.CAPTURE_US)
    return found.select(*FLOW_FEATURES, "k_window")


_EXPIRY = 1704067200000000 + 3_600_000_000


@query(O.flow_query(f"SELECT srcip, srcport, dstip, dstport, proto, flow_seq, last_ts FROM flows WHERE {_EXPIRY} - last_ts <= 600000000"))
def flw22_expire_idle(spark, sf):
    found = flows.expire_idle(flows.flow_table(_packets(spark, sf)), _EXPIRY)
    return found.select(*schemas.STATS_FLOW.key_cols, "flow_seq", "last_ts")


# Row windows and set operations

@query(f"""WITH {O.MEASURES}, w AS (SELECT row_index - 19 AS window_start, count(*) OVER f AS n, min(l_quantity) OVER f AS low,
max(l_quantity) OVER f AS high, sum(l_quantity) OVER f AS total FROM m WINDOW f AS (ORDER BY row_index ROWS 19 PRECEDING))
SELECT * FROM w WHERE window_start >= 0""")
def win1_sliding_rows(spark, sf):
    runs = rows.sliding_rows(fixtures.measures(spark, sf), 20, ["l_quantity"], fixtures.TOTAL_ORDER, block_rows=4096)
    q = F.col("l_quantity")
    return runs.select(
        "window_start", F.size(q).cast("bigint").alias("n"), F.array_min(q).alias("low"), F.array_max(q).alias("high"),
        F.aggregate(q, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(f"""WITH {O.MEASURES} SELECT row_index // 1000 AS window_id, count(*) AS n, sum(l_quantity) AS total, min(l_orderkey) AS first_order,
max(l_orderkey) AS last_order FROM m GROUP BY 1""")
def win2_tumbling_rows(spark, sf):
    placed = rows.tumbling_rows(fixtures.measures(spark, sf), 1000, fixtures.TOTAL_ORDER)
    return placed.groupBy("window_id").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("total"), F.min("l_orderkey").alias("first_order"),
        F.max("l_orderkey").alias("last_order"))


@query(_AGG)
def set1_union_flows(spark, sf):
    return _rounded(aggflows.union_flows(_records(spark, sf)))


# Scalar functions

@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(log2(l_extendedprice), 9) AS bits FROM lineitem")
def fun1_log2(spark, sf):
    return fixtures.measures(spark, sf).select(
        *fixtures.MEASURE_ORDER, F.round(histograms.log2(F.col("l_extendedprice")), 9).alias("bits"))


@query("""SELECT event_id, string_split(replace(props, '"', ''), ':')[1] AS first_part,
 string_split(replace(props, '"', ''), ':')[9] AS past_end FROM events""")
def fun2_split_fields(spark, sf):
    parts = F.split(F.replace("props", F.lit('"'), F.lit("")), ":")
    return spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id", F.get(parts, F.lit(0)).alias("first_part"), F.get(parts, F.lit(8)).alias("past_end"))


@query(f"WITH {O.PACKETS} SELECT seq, flags & 18 = 18 AS synack, flags & 4 = 4 AS rst FROM packets WHERE proto = 6")
def fun3_flag_test(spark, sf):
    tcp = aggflows.by_protocol(_packets(spark, sf), schemas.TCP, "proto")
    return tcp.select("seq", flows.has_flag(flows.SYN | flows.ACK).alias("synack"), flows.has_flag(flows.RST).alias("rst"))


@query(f"WITH {O.PACKETS} SELECT seq, srcip, dstip, len, dscp, iphlen FROM packets WHERE seq % 50 NOT IN (7, 8, 9, 11)")
def fun4_fun5_octets(spark, sf):
    return packets.ip_header(fixtures.frames(_packets(spark, sf))).where("seq % 50 NOT IN (7, 8, 9, 11)")


@query(f"WITH {O.PACKETS} SELECT seq, CAST(trunc((ts_us / 1000000.0::DOUBLE) * 1000000.0::DOUBLE) AS BIGINT) AS ts_us FROM packets")
def fun6_micros(spark, sf):
    return _packets(spark, sf).select("seq", packets.micros(F.col("ts_us") / 1_000_000).alias("ts_us"))


@query("""SELECT event_id, CAST(user_id AS VARCHAR) || ',' || event_type || ',' AS line,
 '{"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS doc FROM events""")
def fun7_text_and_json(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("nothing", F.lit(None).cast("string"))
    line = codec.encode_flow_csv(events, ["user_id", "event_type", "nothing"], keep=("event_id", "user_id", "event_type"))
    return line.select("event_id", F.col("value").alias("line"), F.to_json(F.struct("user_id", "event_type")).alias("doc"))


# Machine learning

def _supervised(name, algorithm, **params):
    def run(spark, sf):
        result = jobs.train_and_evaluate(
            _flow_table(spark, sf), algorithm, params=params, folds=1, split_key=["srcip", "dstip", "duration"])
        return _one_row(spark, **{c: result[c] for c in ("accuracy", "precision", "recall", "f1-score")})

    run.__name__ = name
    query()(run)


_supervised("ml1_decision_tree", "decision_tree", **models.ONLINE_SETTINGS["decision_tree"])
_supervised("ml2_random_forest", "random_forest", **models.ONLINE_SETTINGS["random_forest"], seed=models.SEED)
_supervised("ml3_gradient_boosted_tree", "gradient_boosted_tree", seed=models.SEED)
_supervised("ml4_logistic_regression", "logistic_regression", **models.ONLINE_SETTINGS["logistic_regression"])
_supervised("ml5_naive_bayes", "naive_bayes")
_supervised("ml6_neural_network", "neural_network", **models.ONLINE_SETTINGS["neural_network"])
_supervised("ml7_svm", "svm", **models.ONLINE_SETTINGS["svm"])

_MV_LIMITS = f"""{O.MEASURES}, l AS ({O.long_measures("", "(SELECT * FROM m WHERE label = 0)")}),
lim AS (SELECT feature, avg(value) - 2.0 * var_samp(value) AS lower, avg(value) + 2.0 * var_samp(value) AS upper FROM l GROUP BY feature)"""


@query(f"WITH {_MV_LIMITS} SELECT feature, round(lower, 2) AS lower, round(upper, 2) AS upper FROM lim")
def ml8_mean_variance_fit(spark, sf):
    legit = fixtures.measures(spark, sf).where("label = 0")
    return _rounded(detect.mean_variance_limits(legit, fixtures.MEASURES, 2.0), ("lower", "upper"), 2)


_MV_OUT = " OR ".join(
    f"{c} < (SELECT lower FROM lim WHERE feature = '{c}') OR {c} > (SELECT upper FROM lim WHERE feature = '{c}')"
    for c in fixtures.MEASURES)


@query(f"""WITH {_MV_LIMITS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, label,
CASE WHEN {_MV_OUT} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction FROM m""")
def ml9_mean_variance_score(spark, sf):
    data = _measure_vectors(spark, sf)
    model = detect.MeanVarianceClassifier(2.0).fit(data.where("label = 0"))
    return model.transform(data).select(*fixtures.MEASURE_ORDER, "label", "prediction")


def _entropy_model(spark, sf, data, order=()):
    """Without order columns the detector takes the row numbers it finds."""
    return detect.EntropyClassifier(
        numFeatures=4, numRanges=5, windowSize=20, threshold=0.1, orderCols=order).fit(data)


_ENTROPY_LIMITS = O.entropy_limit_ctes(20, 5, 0.1)


@query(f"WITH {_ENTROPY_LIMITS} SELECT nr AS feature, round(lower, 9) AS lower, round(upper, 9) AS upper FROM limits")
def ml10_entropy_fit(spark, sf):
    lower, upper = _entropy_model(spark, sf, _measure_vectors(spark, sf), fixtures.TOTAL_ORDER).limits
    found = [(i, lo, up) for i, (lo, up) in enumerate(zip(lower, upper))]
    return _rounded(spark.createDataFrame(found, "feature int, lower double, upper double"), ("lower", "upper"), 9)


@query(f"""WITH {_ENTROPY_LIMITS}, tw AS (SELECT *, row_index // 20 AS w FROM m), tlong AS ({O.long_measures("w", "tw")}),
{O.entropy_ctes(20, 5, "w, nr", "tlong", "scored")},
verdict AS (SELECT w, max(CASE WHEN entropy < lower OR entropy > upper THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS prediction
  FROM scored JOIN limits USING (nr) GROUP BY w)
SELECT w AS window_id, min(row_index) AS first_row, max(row_index) AS last_row, max(label) AS label, any_value(prediction) AS prediction
FROM tw JOIN verdict USING (w) GROUP BY w""")
def ml11_entropy_score(spark, sf):
    # Numbered once, for fit and score alike.
    data = rows.number_rows(_measure_vectors(spark, sf), fixtures.TOTAL_ORDER)
    scored = _entropy_model(spark, sf, data).transform(data)
    return scored.select("window_id", "first_row", "last_row", "label", "prediction")


@query()
def ml12_pca(spark, sf):
    data = _measure_vectors(spark, sf)
    (reduced,) = models.reduce_features(data, 2)
    return reduced.select(*fixtures.MEASURE_ORDER, F.size(vector_to_array("pcaFeatures")).alias("k"))


@query()
def ml13_random_split(spark, sf):
    train, test = models.random_split(fixtures.measures(spark, sf))
    return train.agg(F.count("*").alias("rows")).union(test.agg(F.count("*").alias("rows")))


@query("SELECT count(*) AS n FROM lineitem")
def ml13_hash_split(spark, sf):
    key = fixtures.MEASURE_ORDER
    train, test = models.hash_split(fixtures.measures(spark, sf), key)
    return train.select("l_orderkey").union(test.select("l_orderkey")).agg(F.count("*").alias("n"))


_KEY_SQL = ", ".join(fixtures.MEASURE_ORDER)
_PART_SQL = f"(('0x' || substr(md5(concat_ws('|', '{models.SEED}', {_KEY_SQL})), 1, 8))::BIGINT % {models.PARTS})"
_CUT = int(models.TRAIN_SHARE * models.PARTS)


@query(f"SELECT {_KEY_SQL}, {_PART_SQL} < {_CUT} AS train FROM lineitem")
def ml13_portable_split(spark, sf):
    """Which rows go where, by a hash that SQL repeats."""
    key = fixtures.MEASURE_ORDER
    train, test = models.hash_split(fixtures.measures(spark, sf), key, part=models.portable_part(key))
    return train.select(*key, F.lit(True).alias("train")).unionByName(test.select(*key, F.lit(False).alias("train")))


@query()
def ml14_legit_attack_split(spark, sf):
    data = fixtures.measures(spark, sf)
    train, test = models.legit_attack_split(data.where("label = 0"), data, seed=models.SEED)
    return train.agg(F.count("*").alias("rows")).union(test.agg(F.count("*").alias("rows")))


@query(f"""WITH {O.MEASURES} SELECT {_KEY_SQL}, true AS train FROM m WHERE label = 0 AND {_PART_SQL} < {_CUT}
UNION ALL SELECT {_KEY_SQL}, false FROM m WHERE {_PART_SQL} >= {_CUT}""")
def ml14_portable_legit_attack_split(spark, sf):
    key = fixtures.MEASURE_ORDER
    data = fixtures.measures(spark, sf)
    train, test = models.legit_attack_split(data.where("label = 0"), data, key=key)
    return train.select(*key, F.lit(True).alias("train")).unionByName(test.select(*key, F.lit(False).alias("train")))


@query()
def ml15_cross_validation(spark, sf):
    data = codec.featurize_stats(_flow_table(spark, sf)).select("features", "label").cache()
    est = models.estimator("decision_tree")
    model = tuning.cross_validate(est, data, tuning.grid(est, {"maxDepth": [3, 6]}))
    data.unpersist()
    return spark.createDataFrame([(float(m),) for m in model.avgMetrics], "f1 double")


CV_FOLDS = 10
#: Folds by whole numbers, so that any SQL engine draws the same.
_FOLD_SQL = "((l_orderkey * 7919 + l_linenumber * 104729 + l_partkey) % 10)"


def _fold():
    return F.expr(_FOLD_SQL).cast("int")


def _pair_cv(spark, sf, est, holdout, points):
    data = _measure_vectors(spark, sf).withColumn("fold", _fold())
    model = tuning.PairCrossValidator(est, points, holdout=holdout, folds=CV_FOLDS, fold_col="fold").fit(data.where("label = 0"), data)
    return spark.createDataFrame([(i, m, i == model.bestIndex) for i, m in enumerate(model.avgMetrics)],
                                 "point int, f1 double, best boolean")


def _pair_cv_sql(points, holdout):
    names = O.MEASURE_NAMES
    moments = ", ".join(f"avg(a.{c}) AS mean_{c}, var_samp(a.{c}) AS var_{c}" for c in names)
    wide = " OR ".join(f"d.{c} < mean_{c} - t * var_{c} OR d.{c} > mean_{c} + t * var_{c}" for c in names)
    values = ", ".join(f"({i}, {t}::DOUBLE)" for i, t in enumerate(points))
    return f"""WITH {O.MEASURES}, d AS (SELECT *, {_FOLD_SQL} AS fold FROM m), folds AS (SELECT range AS f FROM range({CV_FOLDS})),
fits AS (SELECT f, {moments} FROM folds JOIN d a ON a.fold <> f AND a.label = 0 GROUP BY f), points(point, t) AS (VALUES {values}),
judged AS (SELECT point, f, label, CASE WHEN {wide} THEN 1 ELSE 0 END AS said FROM fits, points, d WHERE {"TRUE" if holdout == "full" else "d.fold = f"}),
c AS (SELECT point, f, label, count(*) AS real, count(*) FILTER (WHERE said = label) AS hits FROM judged GROUP BY ALL),
s AS (SELECT point, f, said AS label, count(*) AS n FROM judged GROUP BY ALL),
each AS (SELECT c.point, c.f, real, 2.0 * hits / (real + coalesce(n, 0)) AS f1 FROM c LEFT JOIN s USING (point, f, label)),
per_fold AS (SELECT point, f, sum(f1 * real) / sum(real) AS f1 FROM each GROUP BY ALL),
means AS (SELECT point, sum(f1) / {CV_FOLDS} AS f1 FROM per_fold GROUP BY point)
SELECT point::INTEGER AS point, round(f1, 9) AS f1, point = first_value(point) OVER (ORDER BY round(f1, 12) DESC, point) AS best FROM means"""


@query(_pair_cv_sql([1.0, 2.0], "full"))
def ml16_pair_cross_validation(spark, sf):
    est = detect.MeanVarianceClassifier()
    return _rounded(_pair_cv(spark, sf, est, "full", tuning.grid(est, {"threshold": [1.0, 2.0]})), ("f1",), 9)


@query(_pair_cv_sql([0.01, 0.02, 0.1], "fold"))
def ml16_pair_cross_validation_own_fold(spark, sf):
    est = detect.MeanVarianceClassifier()
    return _rounded(_pair_cv(spark, sf, est, "fold", tuning.grid(est, {"threshold": [0.01, 0.02, 0.1]})), ("f1",), 9)


@query()
def ml17_pair_cross_validation_entropy(spark, sf):
    est = detect.EntropyClassifier(4, 5, 20, 0.1, fixtures.TOTAL_ORDER)
    return _pair_cv(spark, sf, est, "fold", tuning.grid(est, {"threshold": [0.1]}))


@query()
def ml20_algorithm_sweep(spark, sf):
    return jobs.sweep(_flow_table(spark, sf), params=models.ONLINE_SETTINGS).select("algorithm", "accuracy", "f1-score")


# Streaming

@query()
def str1_score_stream(spark, sf):
    files = _flow_files(spark, sf)
    model, prepare = jobs.online_model(readers.read_flows(spark, files), "decision_tree")
    scored = windows.score_stream(model, prepare(readers.stream_flows(spark, files)))
    out, _, _ = _collect_stream(spark, codec.prediction_columns(scored))
    return spark.read.parquet(out)


@query(f"WITH {O.RECORDS} SELECT {O.AGG_COLUMNS}, CAST(1 AS BIGINT) AS label FROM ({O.agg_flows(flags='nonnull')})")
def str2_micro_batch_flows(spark, sf):
    """The micro-batch is the flow window."""
    return _published(spark, sf, 1, flags="nonnull")


_WINDOWED = f"""WITH {O.RECORDS}, windowed AS (SELECT *, make_timestamp(ts_us - ts_us % 5000000) AS window_start FROM records)
SELECT window_start, ip_proto, {O.AGG_COLUMNS} FROM ({O.agg_flows(source="windowed", extra="window_start")})"""


@query(_WINDOWED)
def str4_windowed_flows(spark, sf):
    records = fixtures.packet_records(_packets(spark, sf), keep=("ts_us",))
    found = windows.windowed_flows(records.withColumn("ts", F.timestamp_micros("ts_us")))
    return _rounded(found.drop("window_end")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(f"""SELECT * FROM ({_WINDOWED}) WHERE window_start + INTERVAL 5 SECOND <=
(WITH {O.PACKETS} SELECT make_timestamp((max(ts_us) // 1000) * 1000) - INTERVAL 10 SECOND FROM packets)""")
def str4_windowed_flows_stream(spark, sf):
    """Windows the watermark has closed when the stream's input ends."""
    core = fixtures.packets_from_events(_event_stream(spark, sf))
    records = fixtures.packet_records(core, keep=("ts_us",)).withColumn("ts", F.timestamp_micros("ts_us"))
    out, _, _ = _collect_stream(spark, windows.windowed_flows(records))
    found = spark.read.parquet(out).drop("window_end")
    return _rounded(found).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _tracked_stream(spark, sf):
    with stateful.rocksdb(spark):
        out, state, _ = _collect_stream(
            spark, stateful.track_flows(fixtures.packets_from_events(_event_stream(spark, sf))))
        return spark.read.parquet(out), stateful.open_flows(spark, state)


@query(O.flow_query(f"SELECT {O.STATS}, valid FROM flows", tcp_close=True))
def str5_stateful_flows(spark, sf):
    finished, still_open = _tracked_stream(spark, sf)
    return finished.unionByName(still_open).select(*FLOW_FEATURES, "valid")


REPLAYED_BATCHES = 20


@query(O.flow_query(f"SELECT {O.STATS}, valid FROM flows", tcp_close=True))
def str5_flows_over_micro_batches(spark, sf):
    """The packets replayed in order as 20 micro-batches; small blocks, so that keys are cut inside of them as well. The clocks
    of hosts lie hours apart, so there is no watermark: it would drop packets."""
    packets = _packets(spark, sf)
    files = batches.ordered_files(packets, REPLAYED_BATCHES)
    stream = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 1).parquet(files)
    found = batches.FlowStream(spark, scratch_dir(spark, "flows"), delay_us=None, block_rows=SMALL_BLOCKS)
    sinks.run_bounded(found.start(stream, availableNow=True))
    return found.finished().unionByName(found.still_open()).select(*FLOW_FEATURES, "valid")


_WATERMARK = "(SELECT (max(ts_us) // 1000 - 600000) FROM packets WHERE proto IN (6, 17))"


@query(O.flow_query(f"""SELECT srcip, srcport, dstip, dstport, proto, flow_seq FROM flows WHERE end_reason = 'open'
AND (last_ts + 600000000) // 1000 + 1 > {_WATERMARK}""", tcp_close=True))
def str7_idle_expiry(spark, sf):
    """Flows still open: the others idle at the final watermark have expired."""
    _, still_open = _tracked_stream(spark, sf)
    return still_open.select(*schemas.STATS_FLOW.key_cols, "flow_seq")


@query()
def str10_progress_metrics(spark, sf):
    files = _flow_files(spark, sf)
    with progress.recorded(spark) as reports:
        _, _, q = _collect_stream(spark, readers.stream_flows(spark, files))
        reports.catch_up(q)
    return reports.metrics(spark, q)


@query(O.flow_query('SELECT count(*) AS "Input rows" FROM flows'))
def str10_progress_input_rows(spark, sf):
    files = _flow_files(spark, sf)
    with progress.recorded(spark) as reports:
        _, _, q = _collect_stream(spark, readers.stream_flows(spark, files))
        reports.catch_up(q)
    return reports.metrics(spark, q).agg(F.sum("Input rows").alias("Input rows"))


def _chained(spark, sf, algorithm):
    topic, index = scratch_dir(spark, "topic"), scratch_dir(spark, "index")
    train, messages = _online(spark, sf)
    spark.createDataFrame([], "value string").write.text(topic)  # a topic that exists and is empty
    first, second = jobs.score_low_latency(
        train, messages, algorithm, scratch_dir(spark, "state"), "text", {"path": topic},
        lambda: readers.stream_text(spark, topic), writers.file_writer(index, "text"), scratch_dir(spark, "state"),
        continuous=False, once=True)
    sinks.run_together(first, second)
    layout = "srcip STRING, srcport BIGINT, dstip STRING, dstport BIGINT, proto BIGINT, prediction DOUBLE"
    found = spark.read.option("recursiveFileLookup", True).text(index)
    return found.select(F.from_json("value", layout).alias("r")).select("r.*")


@query(_DETECTED)
def str11_chained_queries(spark, sf):
    return _chained(spark, sf, "mean_variance")


# Jobs

@query()
def job1_train_and_evaluate(spark, sf):
    run = jobs.train_and_evaluate(_flow_table(spark, sf), "logistic_regression", sf)
    return _one_row(spark, **{c: run[c] for c in ("accuracy", "precision", "recall", "f1-score", "auc")})


@query()
def job2_anomaly_evaluate(spark, sf):
    data = _measure_vectors(spark, sf)
    run = jobs.anomaly_evaluate(data.where("label = 0"), data)
    return _one_row(spark, **{c: run[c] for c in ("accuracy", "precision", "recall", "f1-score")})


@query()
def job3_score_files(spark, sf):
    files = _flow_files(spark, sf)
    return jobs.score_files(spark, readers.read_flows(spark, files), files, "decision_tree",
                            scratch_dir(spark, "scored"), pca_k=5, once=True)["metrics"]


@query(O.flow_query('SELECT count(*) AS "Test cases" FROM flows'))
def job4_score_payloads(spark, sf):
    train, messages = _online(spark, sf)
    result = jobs.score_payloads(spark, train, messages, "logistic_regression", scratch_dir(spark, "scored"), once=True)
    return result["metrics"].select("Test cases")


@query(_FLOW_KEYS)
def job5_score_to_index(spark, sf):
    return _indexed(spark, sf, "decision_tree").drop("prediction")


@query(_FLOW_KEYS)
def job6_score_low_latency(spark, sf):
    return _chained(spark, sf, "svm").drop("prediction")


@query(_AGG_LABELLED)
def job7_publish_packet_flows(spark, sf):
    topic, path = scratch_dir(spark, "topic"), scratch_dir(spark, "flows")
    codec.encode_flow_csv(_records(spark, sf)).write.text(topic)
    q = jobs.publish_packet_flows(readers.stream_text(spark, topic), writers.file_writer(path, "text"),
                                  scratch_dir(spark, "state"), once=True)
    sinks.run_bounded(q)
    messages = spark.read.option("recursiveFileLookup", True).text(path)
    return _rounded(codec.parse_fields(messages, schemas.AGG_FLOW.schema))
