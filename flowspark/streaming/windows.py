"""Stateless scoring and event-time windows on streams."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.operators import aggflows
from flowspark.operators.detect import EntropyModel
from flowspark.streaming.sinks import FLOW_INTERVAL


def score_stream(model: Model, stream: DataFrame) -> DataFrame:
    """Score a stream with a static model; rows are scored one by one."""
    if isinstance(model, EntropyModel):
        raise TypeError("the entropy model judges windows of rows, which a stream does not number")
    return model.transform(stream)


def windowed_flows(
    packets: DataFrame, time_col: str = "ts", width: str = FLOW_INTERVAL, delay: str = "10 seconds",
    flags: str = "set",
) -> DataFrame:
    """Aggregate flows per tumbling event-time window, for batch and stream alike.

    Packets up to ``delay`` late still count. Ports are kept as sets, in a table as in a stream, which has no distinct counts: at
    most 65,536 values of a flow, merged before the shuffle, where distinct counts would expand each packet three times.
    """
    time = F.col(time_col).cast("timestamp")
    return (
        packets.withColumn("_time", time).withWatermark("_time", delay)
        .where(F.col("ip_proto").isin(aggflows.TCP, aggflows.UDP, aggflows.ICMP))
        .groupBy(F.window("_time", width).alias("window"), F.col("ip_srcaddr").alias("srcaddr"),
                 F.col("ip_dstaddr").alias("dstaddr"), "ip_proto")
        .agg(*aggflows.flow_aggregates(flags, "set"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                "ip_proto", *aggflows.FLOW_COLUMNS)
    )
