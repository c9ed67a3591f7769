"""Streaming sinks. Every function starts a query and returns it."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowspark.operators import aggflows, codec

# Flow interval of the packet job and checkpoint interval of the low-latency job.
FLOW_INTERVAL = "5 seconds"
CONTINUOUS_INTERVAL = "1000 milliseconds"


def _trigger(writer, interval: str | None, once: bool):
    if once:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=interval) if interval else writer


def write_predictions_csv(
    stream: DataFrame, path: str, checkpoint: str | None = None, interval: str | None = None, once: bool = False,
) -> StreamingQuery:
    """(label, prediction) appended as CSV files; the checkpoint lies beside the data, not in it."""
    writer = (
        codec.prediction_columns(stream).writeStream.outputMode("append").format("csv")
        .option("path", path).option("checkpointLocation", checkpoint or f"{path.rstrip('/')}_checkpoints")
    )
    return _trigger(writer, interval, once).start()


def for_each_batch(stream: DataFrame, writer, checkpoint: str, interval: str | None = None, once: bool = False) -> StreamingQuery:
    query = stream.writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint)
    return _trigger(query, interval, once).start()


def publish_flows(
    packets: DataFrame, writer, checkpoint: str, label=0, interval: str = FLOW_INTERVAL, once: bool = False,
    **flow_options,
) -> StreamingQuery:
    """Packets of each micro-batch as aggregate flows, labelled, encoded and handed to the writer."""

    def convert(batch: DataFrame, batch_id: int) -> None:
        flows = aggflows.set_label(aggflows.packet_flows(batch, **flow_options), label)
        writer(codec.encode_flow_csv(flows), batch_id)

    return for_each_batch(packets, convert, checkpoint, interval, once)


def publish_predictions_json(
    stream: DataFrame, checkpoint: str, fmt: str = "text", continuous: bool = False, once: bool = False, **options
) -> StreamingQuery:
    """5-tuple, date and prediction as JSON strings into a topic, or any sink of ``value`` strings."""
    writer = (
        codec.encode_prediction_json(stream).writeStream.format(fmt).options(**options)
        .option("checkpointLocation", checkpoint)
    )
    if continuous:
        writer = writer.trigger(continuous=CONTINUOUS_INTERVAL)
    return _trigger(writer, None, once).start()


def index_predictions(stream: DataFrame, writer, checkpoint: str, interval: str | None = None, once: bool = False) -> StreamingQuery:
    """(5-tuple, date, label, prediction) documents handed to the writer of an index."""
    documents = codec.prediction_columns(stream, with_key=True)
    return for_each_batch(documents, writer, checkpoint, interval, once)


def relay(stream: DataFrame, writer, checkpoint: str, interval: str | None = None, once: bool = False) -> StreamingQuery:
    """The ``value`` strings of one stream copied to another sink."""
    return for_each_batch(stream.select(F.col("value").cast("string")), writer, checkpoint, interval, once)


def run_bounded(query: StreamingQuery, timeout: float | None = None) -> StreamingQuery:
    """Wait for the end of a query, at most ``timeout`` seconds, then stop it; errors are raised."""
    query.awaitTermination(timeout) if timeout is not None else query.awaitTermination()
    if query.isActive:
        query.stop()
    return query


def run_together(source: StreamingQuery, *followers: StreamingQuery, timeout: float | None = None, drain: bool = True,
                 poll: float = 0.2) -> None:
    """Let queries run side by side until the first one ends, at most ``timeout`` seconds, then stop the others.

    With ``drain`` the followers first handle, one after the other, what has reached them until then. An error of any query
    stops all of them and is raised.
    """
    queries = (source, *followers)
    ends = None if timeout is None else time.monotonic() + timeout
    try:
        while source.isActive and (ends is None or time.monotonic() < ends):
            source.awaitTermination(poll)  # raises an error of its own
            for query in followers:
                if not query.isActive:
                    query.awaitTermination()
                    raise RuntimeError(f"query {query.name or query.id} ended before the one that it follows")
        if source.isActive:
            source.stop()
        source.awaitTermination()
        for query in followers:
            if drain:
                query.processAllAvailable()
    finally:
        for query in queries:
            if query.isActive:
                query.stop()
