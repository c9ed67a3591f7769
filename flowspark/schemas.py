"""Record layouts shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# The column names of the external record formats, in file order.
PACKET_COLUMNS = """
    ip_srcaddr ip_dstaddr ip_proto ip_ttl ip_flagdf ip_flagmf ip_fragoffset ip_hdrlen ip_pktlen
    tcp_srcport tcp_dstport tcp_flagack tcp_flagcwr tcp_flagecn tcp_flagfin tcp_flagpsh tcp_flagrst
    tcp_flagsyn tcp_flagurg tcp_hdrlen tcp_pktlen
    udp_srcport udp_dstport udp_len icmp_type icmp_code
""".split()

AGG_FLOW_COLUMNS = """
    srcaddr dstaddr qtd_pkt_tcp qtd_src_port qtd_dst_port qtd_fin_flag qtd_syn_flag qtd_psh_flag
    qtd_ack_flag qtd_urg_flag qtd_pkt_udp qtd_pkt_icmp qtd_pkt_ip qtd_tos ttl_m header_len_m
    packet_len_m qtd_do_not_frag qtd_more_frag fragment_offset_m qtd_rst_flag qtd_ece_flag
    qtd_cwr_flag offset_m qtd_t_icmp qtd_cdg_icmp label
""".split()

STATS_FLOW_COLUMNS = """
    srcip srcport dstip dstport proto
    total_fpackets total_fvolume total_bpackets total_bvolume
    min_fpktl mean_fpktl max_fpktl std_fpktl
    min_bpktl mean_bpktl max_bpktl std_bpktl
    min_fiat mean_fiat max_fiat std_fiat
    min_biat mean_biat max_biat std_biat
    duration
    min_active mean_active max_active std_active
    min_idle mean_idle max_idle std_idle
    sflow_fpackets sflow_fbytes sflow_bpackets sflow_bbytes
    fpsh_cnt bpsh_cnt furg_cnt burg_cnt
    total_fhlen total_bhlen dscp label
""".split()

# Columns that hold averages, and the protocol numbers.
AGG_MEANS = ("ttl_m", "header_len_m", "packet_len_m", "fragment_offset_m")
TCP, UDP, ICMP = 6, 17, 1

LABEL = "label"


def _struct(names, strings, doubles=(), number=T.LongType()):
    def kind(name):
        if name in strings:
            return T.StringType()
        return T.DoubleType() if name in doubles else number

    return T.StructType([T.StructField(n, kind(n)) for n in names])


PACKET = _struct(PACKET_COLUMNS, ("ip_srcaddr", "ip_dstaddr"), number=T.IntegerType())

# One row per packet in arrival order; what the flow builder reads.
CORE_PACKET = _struct(
    "seq ts_us srcip dstip srcport dstport proto len iphlen prhlen dscp ttl flags".split(),
    ("srcip", "dstip"),
)

PREDICTION = T.StructType([
    T.StructField("label", T.IntegerType()), T.StructField("prediction", T.DoubleType()),
])


@dataclass(frozen=True)
class FlowSchema:
    """A flow record: its columns, which of them identify the flow, and the label."""

    schema: T.StructType
    key_cols: tuple
    label_col: str = LABEL

    @property
    def names(self):
        return self.schema.names

    @property
    def feature_cols(self):
        skip = set(self.key_cols) | {self.label_col}
        return [n for n in self.schema.names if n not in skip]


AGG_FLOW = FlowSchema(
    _struct(AGG_FLOW_COLUMNS, ("srcaddr", "dstaddr"), AGG_MEANS), ("srcaddr", "dstaddr")
)
STATS_FLOW = FlowSchema(
    _struct(STATS_FLOW_COLUMNS, ("srcip", "dstip")),
    ("srcip", "srcport", "dstip", "dstport", "proto"),
)
