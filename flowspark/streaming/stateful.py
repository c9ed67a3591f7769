"""Statistics flows on a stream: the rules of the batch flow builder, one packet at a time.

State per flow key is one open flow: a fixed number of counters, however long the flow lives.
"""

from __future__ import annotations

from array import array
from contextlib import contextmanager
from decimal import Decimal
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from flowspark import schemas
from flowspark.operators import tcp
from flowspark.operators.flows import FLOW_TIMEOUT_US, IDLE_US, KEY, NULLS, PSH, URG, keyed_rows
from flowspark.schemas import TCP

FEATURES = [c for c in schemas.STATS_FLOW_COLUMNS if c != schemas.LABEL]
# Value series of a flow, each kept as count, total, squares, low and high.
SERIES = ("f_len", "b_len", "f_iat", "b_iat", "active", "idle")
PARTS = ("n", "total", "squares", "low", "high")
SCALARS = (
    "flow_seq", "first_side", "first_ts", "last_ts", "burst_ts", "f_last", "b_last", "mode", "valid", "dscp",
    "f_psh", "b_psh", "f_urg", "b_urg", "f_hlen", "b_hlen",
)
UNKNOWN = -1  # length of headers that are not known, and whether a TCP flow is valid that has no others
UNSEEN = -1  # no packet of a direction yet in this burst

COUNTERS = [*SCALARS, *[f"{s}_{p}" for s in SERIES for p in PARTS]]
STATE = T.StructType([
    T.StructField(c, T.DecimalType(38, 0) if c.endswith("_squares") else T.LongType()) for c in COUNTERS
])
OUTPUT = T.StructType(
    [T.StructField(c, T.StringType() if c in ("srcip", "dstip") else T.LongType()) for c in FEATURES]
    + [T.StructField("flow_seq", T.LongType()), T.StructField("last_ts", T.LongType()),
       T.StructField("end_reason", T.StringType()), T.StructField("valid", T.BooleanType())]
)
STATE_KEY = [*KEY, NULLS]
PACKET_FIELDS = ["seq", "ts_us", "side", "len", "hlen", "dscp", "symbol"]
ORDERED_ROWS = 4096  # packets that are Python objects at a time


def _observe(flow: dict, series: str, value: int) -> None:
    low = flow[f"{series}_low"]
    flow[f"{series}_n"] += 1
    flow[f"{series}_total"] += value
    flow[f"{series}_squares"] += value * value
    flow[f"{series}_high"] = max(flow[f"{series}_high"], value)
    flow[f"{series}_low"] = value if low == 0 else min(low, value)


def _mean(flow, series, empty=0):
    n = flow[f"{series}_n"]
    return flow[f"{series}_total"] // n if n else empty


def _std(flow, series):
    n, total = flow[f"{series}_n"], flow[f"{series}_total"]
    if n < 2:
        return 0
    # The rule of the batch: the root in floating point, cut to a whole number.
    return int(sqrt((flow[f"{series}_squares"] - total * total // n) // (n - 1)))


def _count_packet(flow: dict, is_tcp: bool, p: dict) -> str:
    d = "f" if p["side"] == flow["first_side"] else "b"
    _observe(flow, f"{d}_len", p["len"])
    flow[f"{d}_hlen"] += max(p["hlen"], 0)
    if is_tcp:
        flow[f"{d}_psh"] += p["symbol"] & PSH == PSH
        flow[f"{d}_urg"] += p["symbol"] & URG == URG
    flow[f"{d}_last"] = flow["last_ts"] = p["ts_us"]
    return d


def open_flow(is_tcp: bool, p: dict) -> dict:
    """A new flow with its first packet."""
    flow = dict.fromkeys(COUNTERS, 0)
    flow |= {
        "flow_seq": p["seq"], "first_side": p["side"], "first_ts": p["ts_us"], "burst_ts": p["ts_us"],
        "b_last": UNSEEN, "dscp": p["dscp"], "mode": tcp.OPENED[p["symbol"]] if is_tcp else tcp.NO_FLOW,
    }
    if is_tcp and p["hlen"] == UNKNOWN:
        flow["valid"] = UNKNOWN
    _count_packet(flow, is_tcp, p)
    return flow


def add_packet(flow: dict, is_tcp: bool, p: dict, timeout_us: int, idle_us: int) -> int:
    """Add a packet to the open flow; returns what happened to it (``tcp.STARTS``: not its flow)."""
    ts, gap = p["ts_us"], p["ts_us"] - flow["last_ts"]
    if gap > timeout_us:
        return tcp.STARTS
    if gap < 0:
        return tcp.LATE
    if gap > idle_us:
        _observe(flow, "idle", gap)
        _observe(flow, "active", flow["last_ts"] - flow["burst_ts"])
        flow |= {"burst_ts": ts, "f_last": UNSEEN, "b_last": UNSEEN}
    d = "f" if p["side"] == flow["first_side"] else "b"
    since = flow[f"{d}_last"]
    if since != UNSEEN:
        _observe(flow, f"{d}_iat", ts - since)
    elif d == "b" and flow["dscp"] == 0:
        flow["dscp"] = p["dscp"]
    _count_packet(flow, is_tcp, p)
    if not is_tcp:
        flow["valid"] = int(flow["b_len_n"] > 0)
        return tcp.JOINS
    if p["hlen"] != UNKNOWN:
        flow["valid"] = max(flow["valid"], int(flow["mode"] in tcp.TALKING and p["len"] > p["hlen"]))
    flow["mode"] = tcp.NEXT[flow["mode"]][p["symbol"]]
    return tcp.CLOSES if flow["mode"] in tcp.SHUT else tcp.JOINS


def flow_record(key: tuple, flow: dict, end_reason: str) -> dict:
    """The output row of a flow; its last burst counts as active time."""
    flow = dict(flow)
    _observe(flow, "active", flow["last_ts"] - flow["burst_ts"])
    ip1, port1, ip2, port2, proto = key[:5]
    if len(key) > 5:  # stand-ins of nulls, and which parts were null
        ip1, port1, ip2, port2 = (None if key[5] >> i & 1 else x for i, x in enumerate((ip1, port1, ip2, port2)))
    ends = (ip1, port1, ip2, port2) if flow["first_side"] == 0 else (ip2, port2, ip1, port1)
    row = dict(zip(("srcip", "srcport", "dstip", "dstport"), ends), proto=proto)
    bursts = flow["active_n"]
    for d in "fb":
        n, volume = flow[f"{d}_len_n"], flow[f"{d}_len_total"]
        row |= {f"total_{d}packets": n, f"total_{d}volume": volume,
                f"sflow_{d}packets": n // bursts, f"sflow_{d}bytes": volume // bursts,
                f"{d}psh_cnt": flow[f"{d}_psh"], f"{d}urg_cnt": flow[f"{d}_urg"],
                f"total_{d}hlen": flow[f"{d}_hlen"]}
    for name, series, empty in (("fpktl", "f_len", 0), ("bpktl", "b_len", -1), ("fiat", "f_iat", 0),
                                ("biat", "b_iat", 0), ("active", "active", 0), ("idle", "idle", 0)):
        row |= {f"min_{name}": flow[f"{series}_low"], f"mean_{name}": _mean(flow, series, empty),
                f"max_{name}": flow[f"{series}_high"], f"std_{name}": _std(flow, series)}
    row |= {"duration": flow["last_ts"] - flow["first_ts"], "dscp": flow["dscp"], "flow_seq": flow["flow_seq"],
            "last_ts": flow["last_ts"], "end_reason": end_reason, "valid": None if flow["valid"] == UNKNOWN else bool(flow["valid"])}
    return row


def pack(flow: dict) -> tuple:
    return tuple(Decimal(int(flow[c])) if c.endswith("_squares") else int(flow[c]) for c in COUNTERS)


def unpack(values) -> dict:
    return {c: int(v) for c, v in zip(COUNTERS, values)}


def in_order(rows):
    """The packets of one key by ``seq``, kept as plain numbers until their turn comes."""
    first, numbers = len(STATE_KEY), array("q")
    last = first + len(PACKET_FIELDS)
    for row in rows:
        numbers.extend(row[first:last])
    packets = np.frombuffer(numbers, np.int64).reshape(-1, len(PACKET_FIELDS))
    order = np.argsort(packets[:, 0], kind="stable")
    for at in range(0, len(order), ORDERED_ROWS):
        for values in packets[order[at:at + ORDERED_ROWS]].tolist():
            yield dict(zip(PACKET_FIELDS, values))


class FlowTracker(StatefulProcessor):
    """Keeps the open flow of a key; a flow leaves on TCP close, on a packet after the timeout, or
    when the watermark passes the timeout. Rows, not frames, go in and out: Spark packs the rows of many keys into a
    batch, while every frame would be a batch of its own."""

    def __init__(self, timeout_us: int, idle_us: int, tcp_close: bool):
        self.timeout_us, self.idle_us, self.tcp_close = timeout_us, idle_us, tcp_close

    def init(self, handle) -> None:
        self.handle = handle
        self.flow = handle.getValueState("flow", STATE)

    def _expire_at(self, flow):
        return (flow["last_ts"] + self.timeout_us) // 1000 + 1

    def _record(self, key, flow, end_reason):
        record = flow_record(key, flow, end_reason)
        return Row(**{c: record[c] for c in OUTPUT.names})

    def handleInputRows(self, key, rows, timerValues):
        # The rows of one key in one micro-batch; the trigger limits bound them.
        is_tcp = int(key[4]) == TCP
        flow = unpack(self.flow.get()) if self.flow.exists() else None
        if flow:
            self.handle.deleteTimer(self._expire_at(flow))
        out = []
        for p in in_order(rows):
            if flow is None:
                flow = open_flow(is_tcp, p)
                continue
            event = add_packet(flow, is_tcp, p, self.timeout_us, self.idle_us)
            if event == tcp.STARTS:
                out.append(self._record(key, flow, "timeout"))
                flow = open_flow(is_tcp, p)
            elif event == tcp.CLOSES and self.tcp_close:
                out.append(self._record(key, flow, "tcp_closed"))
                flow = None
        if flow:
            self.flow.update(pack(flow))
            self.handle.registerTimer(self._expire_at(flow))
        else:
            self.flow.clear()
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.flow.get()
        if held is None:
            return iter(())
        self.flow.clear()
        return iter([self._record(key, unpack(held), "timeout")])

    def close(self) -> None:
        pass


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """Arbitrary state needs the RocksDB store. A query keeps the store it was started with, so start it inside; the
    session's own setting comes back afterwards."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def stream_rows(packets: DataFrame) -> DataFrame:
    """Core packets of a stream as the tracker reads them: the key and side of the batch, nulls as there."""
    rows, _ = keyed_rows(packets)
    return rows.select(
        *STATE_KEY, "seq", "ts_us", F.col("side").cast("bigint").alias("side"), "len", F.coalesce("hlen", F.lit(UNKNOWN).cast("bigint")).alias("hlen"),
        "dscp", tcp.symbol().alias("symbol"), F.timestamp_micros("ts_us").alias("event_time"))


def track_flows(
    packets: DataFrame, *, timeout_us: int = FLOW_TIMEOUT_US, idle_us: int = IDLE_US, tcp_close: bool = True,
    delay: str = "10 minutes",
) -> DataFrame:
    """Finished flows of a packet stream; ``delay`` bounds how far packets of the whole stream may
    lag, late packets of a flow are ignored by the flow itself. Start it inside ``rocksdb(spark)``.

    A task holds the rows that one key has in a micro-batch; ``batches.FlowStream`` splits them."""
    rows = stream_rows(packets).withWatermark("event_time", delay)
    return rows.groupBy(*STATE_KEY).transformWithState(
        statefulProcessor=FlowTracker(timeout_us, idle_us, tcp_close), outputStructType=OUTPUT,
        outputMode="Append", timeMode="EventTime",
    )


def open_flows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Flows still open when a stream stopped, read from its state."""
    state = spark.read.format("statestore").option("stateVarName", "flow").load(checkpoint)

    def finish(batches):
        for pdf in batches:
            rows = [flow_record(tuple(r[:6]), unpack(r[6:]), "open") for r in pdf.itertuples(index=False, name=None)]
            yield pd.DataFrame([[r[f.name] for f in OUTPUT] for r in rows], columns=OUTPUT.names)

    flat = state.select(*[f"key.{k}" for k in STATE_KEY], *[f"value.{c}" for c in COUNTERS])
    return flat.mapInPandas(finish, OUTPUT)
