"""Packets grouped by address pair and protocol into aggregate flow records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark import schemas
from flowspark.schemas import ICMP, TCP, UDP

# Counter columns and the packet flag each one counts.
TCP_FLAG_COUNTS = {
    "qtd_fin_flag": "tcp_flagfin",
    "qtd_syn_flag": "tcp_flagsyn",
    "qtd_psh_flag": "tcp_flagpsh",
    "qtd_ack_flag": "tcp_flagack",
    "qtd_urg_flag": "tcp_flagurg",
    "qtd_rst_flag": "tcp_flagrst",
    "qtd_ece_flag": "tcp_flagecn",
    "qtd_cwr_flag": "tcp_flagcwr",
}
IP_FLAG_COUNTS = {"qtd_do_not_frag": "ip_flagdf", "qtd_more_frag": "ip_flagmf"}

# Fixed value: the header length reported for every UDP flow.
UDP_HEADER = 8

FLOW_COLUMNS = [c for c in schemas.AGG_FLOW_COLUMNS if c != schemas.LABEL]


def by_protocol(df: DataFrame, proto: int, column: str = "ip_proto") -> DataFrame:
    return df.where(F.col(column) == proto)


def flag_count(column: str, flags: str = "set", when: Column | None = None) -> Column:
    """Packets carrying a flag.

    ``flags='set'`` counts the value 1; ``flags='nonnull'`` counts any value present, a 0 included.
    """
    value = F.col(column)
    if flags == "set":
        hit = value == 1
    elif flags == "nonnull":
        hit = value.isNotNull()
    else:
        raise ValueError(f"flags must be 'set' or 'nonnull', not {flags!r}")
    return F.count_if(hit if when is None else hit & when)


def distinct_ports(src: Column, dst: Column, mode: str = "exact") -> tuple[Column, Column]:
    """Distinct source and destination ports of a group.

    ``exact`` plans a two-phase distinct aggregate, pre-aggregated before the shuffle; ``set``
    suits streams, where distinct aggregates are not allowed (ports are 16 bits, so a set holds
    at most 65,536 values); ``approx`` trades exactness for constant state.
    """
    if mode == "exact":
        return F.countDistinct(src), F.countDistinct(dst)
    if mode == "set":
        size = lambda c: F.size(F.collect_set(c)).cast("bigint")
        return size(src), size(dst)
    if mode == "approx":
        return F.approx_count_distinct(src), F.approx_count_distinct(dst)
    raise ValueError(f"unknown distinct mode {mode!r}")


def flow_aggregates(flags: str = "set", distinct: str = "exact") -> list[Column]:
    """The 24 features of an aggregate flow, for groups that hold one protocol each."""
    proto = F.col("ip_proto")
    tcp, udp, icmp = proto == TCP, proto == UDP, proto == ICMP

    def mean(cases: dict) -> Column:
        """Average of the column that belongs to each protocol; 0 where a protocol has none."""
        pick = F.lit(0)
        for number, column in cases.items():
            value = F.lit(column) if isinstance(column, int) else F.col(column)
            pick = F.when(proto == number, value).otherwise(pick)
        return F.avg(pick)

    ports = distinct_ports(
        F.when(tcp, F.col("tcp_srcport")).when(udp, F.col("udp_srcport")),
        F.when(tcp, F.col("tcp_dstport")).when(udp, F.col("udp_dstport")),
        distinct,
    )
    zero = F.max(F.lit(0).cast("bigint"))
    features = {
        "qtd_pkt_tcp": F.count_if(tcp),
        "qtd_src_port": ports[0],
        "qtd_dst_port": ports[1],
        "qtd_pkt_udp": F.count_if(udp),
        "qtd_pkt_icmp": F.count_if(icmp),
        "qtd_pkt_ip": F.count(F.lit(1)),
        "qtd_tos": zero,
        "ttl_m": mean({TCP: "ip_ttl", ICMP: "ip_ttl"}),
        "header_len_m": mean({TCP: "tcp_hdrlen", UDP: UDP_HEADER, ICMP: "ip_hdrlen"}),
        "packet_len_m": mean({TCP: "tcp_pktlen", UDP: "udp_len", ICMP: "ip_pktlen"}),
        "fragment_offset_m": F.avg("ip_fragoffset"),
        "offset_m": zero,
        "qtd_t_icmp": F.count(F.when(icmp, F.col("icmp_type"))),
        "qtd_cdg_icmp": F.count(F.when(icmp, F.col("icmp_code"))),
    }
    features |= {out: flag_count(c, flags, tcp) for out, c in TCP_FLAG_COUNTS.items()}
    features |= {out: flag_count(c, flags) for out, c in IP_FLAG_COUNTS.items()}
    return [features[c].alias(c) for c in FLOW_COLUMNS if c in features]


def packet_flows(
    packets: DataFrame, *, tcp: bool = True, udp: bool = True, icmp: bool = True,
    flags: str = "set", distinct: str = "exact", keep_proto: bool = False,
) -> DataFrame:
    """One flow per source, destination and protocol, in a single grouped pass."""
    wanted = [n for n, on in ((TCP, tcp), (UDP, udp), (ICMP, icmp)) if on]
    flows = (
        packets.where(F.col("ip_proto").isin(wanted))
        .groupBy(
            F.col("ip_srcaddr").alias("srcaddr"), F.col("ip_dstaddr").alias("dstaddr"), "ip_proto"
        )
        .agg(*flow_aggregates(flags, distinct))
    )
    return flows.select(*(["ip_proto"] if keep_proto else []), *FLOW_COLUMNS)


def tcp_flows(packets: DataFrame, **options) -> DataFrame:
    return packet_flows(packets, udp=False, icmp=False, **options)


def udp_flows(packets: DataFrame, **options) -> DataFrame:
    return packet_flows(packets, tcp=False, icmp=False, **options)


def icmp_flows(packets: DataFrame, **options) -> DataFrame:
    return packet_flows(packets, tcp=False, udp=False, **options)


def union_flows(packets: DataFrame, **options) -> DataFrame:
    """The three protocol results stacked by position; equal to :func:`packet_flows`."""
    return (
        tcp_flows(packets, **options)
        .union(udp_flows(packets, **options))
        .union(icmp_flows(packets, **options))
    )


def set_label(df: DataFrame, value, column: str = schemas.LABEL) -> DataFrame:
    return df.withColumn(column, F.lit(value))
