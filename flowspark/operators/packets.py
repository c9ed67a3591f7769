"""Raw Ethernet frames to packet rows, with native byte expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from flowspark.functions.octets import dotted_quad, field, word
from flowspark.schemas import CORE_PACKET, TCP, UDP

# Where the fields lie. Ethernet header 14 bytes, IPv4 EtherType, shortest header
# of each protocol.
ETHERNET = 14
IPV4 = "0800"
SHORTEST_FRAME = 34
VERDICTS = ("ok", "not_ip", "short_frame", "not_ipv4", "short_tcp", "short_udp", "other_protocol")
SHORTEST = {TCP: 20, UDP: 8}
HEAD_BYTES = ETHERNET + 60 + 20  # longest IP header and the fixed TCP header


def _once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns computed once per row. Expressions of a projection are copied into the filters and
    columns that use them, which multiplies the code of byte fields; a generator of one row is not
    copied into anything."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def inspect_frames(df: DataFrame, frame: str = "frame") -> DataFrame:
    """Add ``verdict``: ``ok`` or why the frame is not a TCP or UDP packet over IPv4. A null frame is a
    short one."""
    head = _once(df, {"_head": F.hex(F.substring(F.col(frame), 1, HEAD_BYTES)), "_size": F.length(frame)})
    fields = _once(head, {
        # Version, header length, service and total length; time to live and protocol.
        "_start": word("_head", ETHERNET, 4), "_middle": word("_head", ETHERNET + 8, 2),
    }).withColumns({"_iphlen": field("_start", 24, 4) * 4, "_proto": field("_middle", 0, 8)})
    payload = F.col("_size") - ETHERNET - F.col("_iphlen")
    is_ipv4 = F.substring("_head", 2 * 12 + 1, 4) == IPV4
    tcp, udp = F.col("_proto") == TCP, F.col("_proto") == UDP
    verdict = (
        F.when(F.col("_size").isNull(), "short_frame")
        .when(~is_ipv4, "not_ip")
        .when(F.col("_size") < SHORTEST_FRAME, "short_frame")
        .when(field("_start", 28, 4) != 4, "not_ipv4")
        .when(tcp, F.when(payload < SHORTEST[TCP], "short_tcp").otherwise("ok"))
        .when(udp, F.when(payload < SHORTEST[UDP], "short_udp").otherwise("ok"))
        .otherwise("other_protocol")
    )
    return fields.withColumn("verdict", verdict)


def count_frames(df: DataFrame, frame: str = "frame") -> DataFrame:
    """Frames per verdict: what the frame filter drops, and why."""
    return inspect_frames(df, frame).groupBy("verdict").agg(F.count(F.lit(1)).alias("frames"))


def micros(seconds: Column) -> Column:
    """Seconds to whole microseconds, truncated."""
    return (seconds * 1_000_000).cast("bigint")


def _ip_fields() -> dict[str, Column]:
    """Fields past the end of a frame are null."""
    def inside(end, value):
        return F.when(F.col("_size") >= ETHERNET + end, value)

    return {
        "srcip": inside(16, dotted_quad(word("_head", ETHERNET + 12, 4))),
        "dstip": inside(20, dotted_quad(word("_head", ETHERNET + 16, 4))),
        "len": inside(4, field("_start", 0, 16)), "iphlen": inside(1, F.col("_iphlen")).cast("int"),
        "dscp": inside(2, field("_start", 18, 6)), "ttl": inside(9, field("_middle", 8, 8)),
    }


def ip_header(df: DataFrame, frame: str = "frame", keep=("seq",)) -> DataFrame:
    """IP header fields of frames taken to be IPv4, whatever they carry."""
    fields = _ip_fields()
    return inspect_frames(df, frame).select(
        *keep, *[fields[c].alias(c) for c in ("srcip", "dstip", "len", "dscp", "iphlen")])


def observed(inspected: DataFrame, counts: Observation | str) -> DataFrame:
    """Count frames by verdict in passing: the counts are in the observation after an action, or, under a name, in the
    progress of every micro-batch (``observedMetrics``)."""
    return inspected.observe(counts, *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])


def decode_frames(
    df: DataFrame, frame: str = "frame", ts: str = "ts", keep=("seq",), counts: Observation | str | None = None,
) -> DataFrame:
    """Packet rows of the frames that carry TCP or UDP over IPv4; ``ts`` in seconds. ``counts`` observes what is
    dropped and why, without a second scan."""
    at = F.col("_iphlen") + ETHERNET
    inspected = inspect_frames(df, frame)
    if counts is not None:
        inspected = observed(inspected, counts)
    ok = _once(inspected.where(F.col("verdict") == "ok"), {
        # Both ports; then the UDP length, or the TCP header length and flags.
        "_ports": word("_head", at, 4),
        "_detail": word("_head", F.when(F.col("_proto") == TCP, at + 12).otherwise(at + 4), 2),
    })
    tcp = F.col("_proto") == TCP
    fields = _ip_fields() | {
        "ts_us": micros(F.col(ts)),
        "srcport": field("_ports", 16, 16), "dstport": field("_ports", 0, 16), "proto": F.col("_proto").cast("int"),
        "prhlen": F.when(tcp, field("_detail", 12, 4) * 4).otherwise(F.col("_detail")),
        "flags": F.when(tcp, field("_detail", 0, 6)).cast("int"),
    }
    order = [c for c in CORE_PACKET.names if c in fields]
    return ok.select(*keep, *[fields[c].alias(c) for c in order])
