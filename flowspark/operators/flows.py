"""Packets to bidirectional flows with statistics.

A flow key may hold a large share of all packets, so nothing here sorts or folds a whole key in
one task. Every key is cut into blocks of consecutive ``seq`` values (at most ``block_rows`` rows
each); rows are windowed inside a block, and only one small summary row per (key, block) travels
along the key to carry state from block to block. Inside a block, rows collapse into segments (the
part of one burst that lies in one block), split by the side of the key they come from. Which side
is "forward" depends on the flow's first packet and is settled at flow level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark import schemas
from flowspark.functions import exact
from flowspark.schemas import TCP, UDP
from flowspark.session import dealt, parts_for

# Flow timeout, idle threshold and capture buffer in microseconds; TCP flag bits.
FLOW_TIMEOUT_US = 600_000_000
IDLE_US = 1_000_000
CAPTURE_US = 2_000_000
FIN, SYN, RST, PSH, ACK, URG = 0x01, 0x02, 0x04, 0x08, 0x10, 0x20

BLOCK_ROWS = 1 << 20
TASK_ROWS = 1 << 17  # packets whose segments a task builds: rows of some hundred columns
KEY = ["k_ip1", "k_port1", "k_ip2", "k_port2", "proto"]
#: Inside, null key parts are '' or -1 and this column has a bit for each of the four, so that joins,
#: windows and folds all compare them alike.
NULLS = "k_null"
HELD = -1  # block of what was held from earlier rows
CARRIED = -1  # carry group of the segments that touch a block edge
SIDES = (0, 1)

BEFORE = (Window.unboundedPreceding, -1)
UP_TO = (Window.unboundedPreceding, 0)


def has_flag(mask: int, column: str = "flags") -> Column:
    """Whether all bits of the mask are set."""
    return F.col(column).bitwiseAND(F.lit(mask)) == mask


def flow_key(packets: DataFrame) -> DataFrame:
    """Add the normalised 5-tuple: ends swapped where the destination address sorts first."""
    return packets.withColumn("swapped", F.expr("dstip < srcip")).selectExpr(
        *packets.columns,
        "CASE WHEN swapped THEN dstip ELSE srcip END AS k_ip1",
        "CASE WHEN swapped THEN dstport ELSE srcport END AS k_port1",
        "CASE WHEN swapped THEN srcip ELSE dstip END AS k_ip2",
        "CASE WHEN swapped THEN srcport ELSE dstport END AS k_port2",
    )


def filled_key(rows: DataFrame) -> DataFrame:
    """Key parts without nulls, and which of them were null."""
    empty = {"k_ip1": "''", "k_port1": "-1", "k_ip2": "''", "k_port2": "-1"}
    nulls = " + ".join(f"CASE WHEN {c} IS NULL THEN {1 << i} ELSE 0 END" for i, c in enumerate(empty))
    return rows.withColumn(NULLS, F.expr(nulls)).withColumns(
        {c: F.expr(f"coalesce({c}, {value})") for c, value in empty.items()})


def _part(name: str) -> str:
    """A key part as it came, null included."""
    return f"CASE WHEN {NULLS} & {1 << KEY.index(name)} = 0 THEN {name} END"


def restored_key(rows: DataFrame) -> DataFrame:
    """Undo :func:`filled_key`."""
    return rows.withColumns({c: F.expr(_part(c)) for c in KEY[:4]}).drop(NULLS)


def capture_window(packets: DataFrame, width_us: int = CAPTURE_US) -> DataFrame:
    """Add the start of the tumbling capture buffer a packet falls into."""
    return packets.withColumn("k_window", F.col("ts_us") - F.pmod(F.col("ts_us"), F.lit(width_us)))


def keyed_rows(packets: DataFrame, block_rows: int = BLOCK_ROWS, window_us: int | None = None):
    """Rows of TCP and UDP packets with key, side and block; returns (rows, key columns)."""
    rows = filled_key(flow_key(packets.where(F.col("proto").isin(TCP, UDP))))
    key = [*KEY, NULLS]
    if window_us:
        rows, key = capture_window(rows, window_us), key + ["k_window"]
    rows = rows.selectExpr(
        *key, "CASE WHEN coalesce(srcip, '') = k_ip1 THEN 0 ELSE 1 END AS side", f"seq div {block_rows} AS block",
        "seq", "ts_us", "CAST(len AS BIGINT) AS len", "CAST(iphlen + prhlen AS BIGINT) AS hlen",
        "coalesce(CAST(dscp AS BIGINT), 0) AS dscp", "coalesce(flags, 0) AS flags",
    )
    return rows, key


def key_blocks(
    rows: DataFrame, key: list[str], block_rows: int = BLOCK_ROWS, held: DataFrame | None = None,
) -> DataFrame:
    """(key, block, carry_ts, n_before, n_key) from one aggregate: the newest time and the number of rows of the
    key before the block, and its rows in all. Only blocks with something before them, and all blocks of keys with more
    than ``block_rows`` rows: few rows, as most keys live in one block. ``held`` has the time (``last_ts``) of keys whose
    flow began before these rows."""
    along = Window.partitionBy(*key).orderBy("block").rowsBetween(*BEFORE)
    counted = rows.groupBy(*key, "block").agg(F.max("ts_us").alias("top"), F.count(F.lit(1)).alias("n"))
    if held is not None:
        counted = counted.unionByName(held.select(
            *key, F.lit(HELD).cast("bigint").alias("block"), F.col("last_ts").alias("top"), F.lit(0).cast("bigint").alias("n")))
    return (
        counted.select(*key, "block", F.max("top").over(along).alias("carry_ts"),
                F.coalesce(F.sum("n").over(along), F.lit(0)).alias("n_before"),
                F.sum("n").over(Window.partitionBy(*key)).alias("n_key"))
        .where(F.col("carry_ts").isNotNull() | (F.col("n_key") > block_rows))
    )


def newest_before(rows: DataFrame, key: list[str], blocks: DataFrame | None = None) -> DataFrame:
    """Add ``prev_ts``: the newest packet time of the key over all earlier rows."""
    blocks = key_blocks(rows, key) if blocks is None else blocks
    inside = Window.partitionBy(*key, "block").orderBy("seq").rowsBetween(*BEFORE)
    return (
        rows.join(blocks.select(*key, "block", "carry_ts"), [*key, "block"], "left")
        .withColumn("prev_ts", F.greatest(F.max("ts_us").over(inside), F.col("carry_ts")))
        .drop("carry_ts")
    )


def drop_late(rows: DataFrame) -> DataFrame:
    """Drop packets older than the newest earlier packet of their key.

    Kept packets have non-decreasing times, so the newest earlier packet is the last kept one.
    """
    return rows.where(F.col("prev_ts").isNull() | (F.col("ts_us") >= F.col("prev_ts")))


def mark_gaps(
    rows: DataFrame, key: list[str], timeout_us: int, idle_us: int, blocks: DataFrame | None = None,
) -> DataFrame:
    """Late rows dropped; gap to the last kept packet; where flows and bursts start."""
    return gaps(newest_before(rows, key, blocks), timeout_us, idle_us)


def gaps(rows: DataFrame, timeout_us: int, idle_us: int) -> DataFrame:
    """:func:`mark_gaps` for rows with ``prev_ts``."""
    gap = F.col("ts_us") - F.col("prev_ts")
    starts = F.col("prev_ts").isNull() | (gap > timeout_us)
    return (
        drop_late(rows)
        .withColumns({"flow_start": starts, "gap": F.when(~starts, gap)})
        .withColumn("burst_start", F.col("flow_start") | (F.col("gap") > idle_us))
        .drop("prev_ts")
    )


def mark_runs(rows: DataFrame, key: list[str]) -> DataFrame:
    """Add the start of the flow and burst a row belongs to, null where it began in an earlier
    block, and the gap to the previous packet of the same side inside the burst."""
    order = Window.partitionBy(*key, "block").orderBy("seq")
    here = F.struct("seq", "ts_us")

    def last_of(side):
        return F.last(F.when(F.col("side") == side, here), ignorenulls=True)

    rows = rows.select(
        "*",
        F.max(F.when(F.col("flow_start"), F.col("seq"))).over(order.rowsBetween(*UP_TO)).alias("l_flow"),
        F.max(F.when(F.col("burst_start"), F.col("seq"))).over(order.rowsBetween(*UP_TO)).alias("l_burst"),
        *[last_of(s).over(order.rowsBetween(*BEFORE)).alias(f"last{s}") for s in SIDES],
        F.max("seq").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("block_end"),
    )
    last = F.when(F.col("side") == 0, F.col("last0")).otherwise(F.col("last1"))
    same_burst = F.col("l_burst").isNull() | (last["seq"] >= F.col("l_burst"))
    return rows.withColumn("iat", F.when(same_burst, F.col("ts_us") - last["ts_us"])).drop("last0", "last1")


def along_blocks(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows of :func:`mark_runs` with the flow and burst they belong to (``flow_seq``, ``burst_seq``) and the side that opened
    the flow (``first_side``), in whichever block these began."""
    inside = Window.partitionBy(*key, "block").orderBy("seq").rowsBetween(*UP_TO)
    rows = rows.withColumn("open_side", F.last(F.when(F.col("flow_start"), F.col("side")), ignorenulls=True).over(inside))
    along = Window.partitionBy(*key).orderBy("block").rowsBetween(*BEFORE)
    edges = rows.groupBy(*key, "block").agg(
        F.max("l_flow").alias("flow"), F.max("l_burst").alias("burst"),
        F.max_by("open_side", F.when(F.col("flow_start"), F.col("seq"))).alias("side"),
    )
    carry = edges.select(
        *key, "block", F.max("flow").over(along).alias("c_flow"), F.max("burst").over(along).alias("c_burst"),
        F.last("side", ignorenulls=True).over(along).alias("c_side"),
    ).where(F.col("c_flow").isNotNull())
    return rows.join(carry, [*key, "block"], "left").withColumns({
        "flow_seq": F.coalesce("l_flow", "c_flow"), "burst_seq": F.coalesce("l_burst", "c_burst"),
        "first_side": F.coalesce("open_side", "c_side"),
    }).drop("open_side", "c_flow", "c_burst", "c_side")


# Measures of one side of one segment, by how they merge.
SUMS = ["n", "vol", "vol2", "hlen", "psh", "urg", "iat_n", "iat_sum", "iat_hh", "iat_hl", "iat_ll"]
MAXS = ["len_max", "len_state", "iat_max", "iat_level", "last_ts", "last_seq"]
MINS = ["first_ts", "first_seq"]
FLAGS = ["valid_hit", "closes"]
# What a row that stands for past bursts knows of them: counts, sums, squares and extremes of active and idle times. The
# lowest active time restarts after a zero, whose burst is p_active_top.
PAST_TYPES = {f"p_{c}": "DECIMAL(38,0)" if c.endswith("2") else "BIGINT" for c in (
    "active_n", "active_sum", "active2", "active_max", "active_top", "active_low", "idle_n", "idle_sum", "idle2",
    "idle_max", "idle_min")}
PAST = list(PAST_TYPES)
# Minima restart after a zero. Their state is the position (seq) of the latest zero and the lowest
# value since. For lengths both are one decimal, (position + 1) * LEN_SPAN + what the length lacks to
# LEN_SPAN - 1: the greatest state has the latest zero and, among equals, the lowest length. It holds
# every bigint position and any length below LEN_SPAN.
LEN_SPAN = 10**12
_SPAN = f"CAST({LEN_SPAN} AS DECIMAL(13,0))"
# The lowest length of a state, and the state of what is merged from the latest zero and the lowest length since.
LOW_LEN = f"nullif({LEN_SPAN - 1} - CAST(s@_len_state % {_SPAN} AS BIGINT), {LEN_SPAN - 1})"
LEN_STATE = (f"CAST((CAST(len_top@ AS DECIMAL(20,0)) + 1) * {_SPAN} + CASE WHEN len_low@ IS NULL THEN 0 ELSE {LEN_SPAN - 1} - len_low@ END"
             " AS DECIMAL(38,0)) AS s@_len_state")


def _window(columns: list[str], order: str = "", frame: str = "") -> str:
    return f"OVER (PARTITION BY {', '.join(columns)} {order and 'ORDER BY ' + order} {frame})"


def _both(template: str) -> list[str]:
    """A column expression for either side; ``@`` stands for the side number."""
    return [template.replace("@", str(side)) for side in SIDES]


def segments(rows: DataFrame, key: list[str], keep_end: bool = False) -> DataFrame:
    """One row per burst and block, with the measures of either side as s0_*, s1_* columns. ``keep_end`` keeps the last
    row of the block, too.

    Grouped by the block first, so both aggregations run where the rows already are.
    """
    so_far = _window([*key, "block"], "seq", "ROWS UNBOUNDED PRECEDING")
    zeros = [
        f"max(CASE WHEN {v} = 0 AND side = {s} THEN seq END) {so_far} AS {v}_zero{s}"
        for v in ("len", "iat") for s in SIDES
    ]
    flags = [c for c in FLAGS if c in rows.columns]
    seg = [*key, "block", "l_flow", "l_burst"]
    leveled = rows.selectExpr("*", *zeros).selectExpr(
        *rows.columns,
        "CASE side WHEN 0 THEN iat_zero0 ELSE iat_zero1 END AS iat_level",
        "CAST((CAST(coalesce(CASE side WHEN 0 THEN len_zero0 ELSE len_zero1 END, -1L) AS DECIMAL(20,0)) + 1)"
        f" * {_SPAN} + CASE WHEN len = 0 THEN 0 ELSE {LEN_SPAN - 1} - len END AS DECIMAL(38,0)) AS len_state",
        *[f"{part} AS iat_{name}" for name, part in exact.square_limbs("iat").items()],
    )
    e = F.expr
    by_side = leveled.groupBy(*seg, "side", "iat_level").agg(
        e("count(1) AS n"), e("sum(len) AS vol"), e("sum(len * len) AS vol2"), e("sum(hlen) AS hlen"),
        e(f"count_if(proto = {TCP} AND flags & {PSH} = {PSH}) AS psh"),
        e(f"count_if(proto = {TCP} AND flags & {URG} = {URG}) AS urg"),
        e("count(iat) AS iat_n"), e("sum(iat) AS iat_sum"),
        e("sum(iat_hh) AS iat_hh"), e("sum(iat_hl) AS iat_hl"), e("sum(iat_ll) AS iat_ll"),
        e("max(len) AS len_max"), e("max(len_state) AS len_state"), e("max(iat) AS iat_max"),
        e("min(nullif(iat, 0)) AS iat_low"),
        e("max(ts_us) AS last_ts"), e("max(seq) AS last_seq"), e("min(ts_us) AS first_ts"),
        e("min(seq) AS first_seq"), e("min_by(dscp, seq) AS first_dscp"), e("max(gap) AS gap"),
        *[e(f"max({c}) AS {c}") for c in flags],
        *[e("max_by(mode, seq) AS mode"), e("max(seq) AS mode_seq")] * ("mode" in rows.columns),
        *[e("max(block_end) AS block_end")] * keep_end,
    )
    sided = [
        f"{fn}(CASE WHEN side = @ THEN {c} END) AS s@_{c}"
        for fn, names in (("sum", SUMS), ("max", MAXS), ("min", MINS)) for c in names
    ]
    sided.append("max_by(iat_low, CASE WHEN side = @ THEN coalesce(iat_level, -1) END) AS s@_iat_low")
    sided.append("min_by(first_dscp, CASE WHEN side = @ THEN first_seq END) AS s@_first_dscp")
    return by_side.groupBy(*seg).agg(
        *[e(x) for template in sided for x in _both(template)],
        e("min(first_ts) AS first_ts"), e("max(last_ts) AS last_ts"), e("max(last_seq) AS last_seq"),
        e("min(first_seq) AS first_seq"), e("min_by(first_dscp, first_seq) AS first_dscp"),
        # Only the packet that opens a burst inside a flow has waited through an idle gap.
        e("max(CASE WHEN l_burst <> coalesce(l_flow, -1) THEN gap END) AS idle"),
        *[e(f"max({c}) AS {c}") for c in flags],
        *[e("max_by(mode, mode_seq) AS mode")] * ("mode" in rows.columns),
        *[e("max(block_end) AS block_end")] * keep_end,
    )


def merge_inside(segs: DataFrame, key: list[str]) -> DataFrame:
    """The bursts of a flow that lie inside a block as one row with their past (``p_*`` columns); segments that continue
    an earlier block or end one stay as they are. Most flows shrink to a few rows where their packets already are,
    before anything wide is sorted, walked or shuffled. ``segs`` have the last row of their block (``block_end``)."""
    e = F.expr
    run = [*key, "block", "l_flow", "inside", "own"]
    of_run = _window(run)
    segs = segs.selectExpr("*", "l_flow IS NOT NULL AND last_seq < block_end AS inside").selectExpr(
        "*", "CASE WHEN NOT inside THEN l_burst END AS own", "CASE WHEN inside THEN last_ts - first_ts END AS active",
        "CASE WHEN inside THEN idle END AS rest",
    ).selectExpr(
        "*", f"max(CASE WHEN active = 0 THEN l_burst END) {of_run} AS active_top",
        *_both(f"max(s@_len_state div {_SPAN} - 1) {of_run} AS len_top@"),
        *_both(f"max(s@_iat_level) {of_run} AS iat_top@"),
    )
    sides = [f"sum(s@_{c}) AS s@_{c}" for c in SUMS]
    sides += [f"max(s@_{c}) AS s@_{c}" for c in ("len_max", "iat_max", "iat_level", "last_ts", "last_seq")]
    sides += [f"min(s@_{c}) AS s@_{c}" for c in MINS]
    sides += [
        "max(len_top@) AS len_top@", f"min(CASE WHEN s@_last_seq >= len_top@ THEN {LOW_LEN} END) AS len_low@",
        "min(CASE WHEN iat_top@ IS NULL OR s@_last_seq >= iat_top@ THEN s@_iat_low END) AS s@_iat_low",
        # Only the first that is not 0 counts; a run comes before or after the other segments of its flow as a whole.
        "min_by(s@_first_dscp, CASE WHEN s@_first_dscp <> 0 THEN s@_first_seq END) AS s@_first_dscp",
    ]
    square = lambda c: f"CAST({exact.decimal(c, 18)} * {exact.decimal(c, 18)} AS DECIMAL(38,0))"
    past = {
        "active_n": "sum(CASE WHEN inside THEN 1 END)", "active_sum": "sum(active)", "active2": f"sum({square('active')})",
        "active_max": "max(active)", "active_top": "max(active_top)",
        "active_low": "min(CASE WHEN l_burst > coalesce(active_top, -1) THEN active END)",
        "idle_n": "sum(CASE WHEN inside THEN CASE WHEN idle IS NULL THEN 0 ELSE 1 END END)", "idle_sum": "sum(rest)",
        "idle2": f"sum({square('rest')})", "idle_max": "max(rest)", "idle_min": "min(rest)",
    }
    merged = segs.groupBy(*run).agg(
        *[e(x) for template in sides for x in _both(template)],
        e("min(l_burst) AS l_burst"), e("min(first_ts) AS first_ts"), e("max(last_ts) AS last_ts"),
        e("max(last_seq) AS last_seq"), e("min(first_seq) AS first_seq"), e("min_by(first_dscp, first_seq) AS first_dscp"),
        e("max(CASE WHEN NOT inside THEN idle END) AS idle"),
        *[e(f"max({c}) AS {c}") for c in FLAGS if c in segs.columns],
        *[e("max_by(mode, last_seq) AS mode")] * ("mode" in segs.columns),
        *[e(f"CAST({past[c[2:]]} AS {kind}) AS {c}") for c, kind in PAST_TYPES.items()],
    )
    return merged.selectExpr("*", *_both(LEN_STATE)).drop("inside", "own", *_both("len_top@"), *_both("len_low@"))


def settle_segments(segs: DataFrame, key: list[str], parts: int | None = None) -> DataFrame:
    """Give every segment its flow and burst, and close the gaps across block edges.

    Only segments that continue an earlier block, or end one, take part in the walk along the key
    (at most one per block plus the bursts of flows that cross an edge); the others are spread.
    """
    block = _window([*key, "block"])
    segs = segs.selectExpr(
        "*", f"max(l_flow) {block} AS block_flow", f"max(last_seq) {block} AS block_end"
    ).selectExpr(
        "*", f"CASE WHEN l_flow IS NULL OR last_seq = block_end THEN {CARRIED} ELSE block END AS carry_group"
    )
    before = _window([*key, "carry_group"], "first_seq", "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
    # Flows start in the order of rows, so a later one is a greater one of all: no frame has to be folded anew for each row.
    whole = _window([*key, "carry_group"], "first_seq", "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING")
    last = "last_value(CASE WHEN s@_n > 0 THEN struct(s@_last_seq AS seq, s@_last_ts AS ts) END, true)"
    segs = dealt(segs, parts, *key, "carry_group").selectExpr(
        "*", f"max(l_flow) {before} AS c_flow", f"max(l_burst) {before} AS c_burst",
        f"max(l_flow) {whole} AS next_flow", *_both(f"{last} {before} AS c_last@"),
    ).selectExpr(
        "*", "coalesce(l_flow, c_flow) AS flow_seq", "coalesce(l_burst, c_burst) AS burst_seq"
    ).selectExpr(
        "*",
        "coalesce(next_flow > flow_seq, false) OR coalesce(block_flow > flow_seq, false) AS followed",
        *_both("coalesce(l_burst IS NULL AND c_last@.seq >= burst_seq, false) AS running@"),
    ).selectExpr(
        "*",
        *_both("CASE WHEN running@ AND s@_n > 0 THEN s@_first_ts - c_last@.ts END AS edge@"),
        # The first packet of this side in its burst may set the dscp.
        *_both("CASE WHEN NOT running@ AND s@_first_dscp <> 0 THEN s@_first_seq END AS s@_dscp_seq"),
    )
    flags = [c for c in FLAGS if c in segs.columns]
    same = ["n", "vol", "vol2", "hlen", "psh", "urg", "len_max", "len_state", "last_seq", "last_ts", "first_seq",
            "first_dscp", "dscp_seq"]
    fixed = [f"s@_{c}" for c in same] + [
        "s@_iat_n + CASE WHEN edge@ IS NULL THEN 0 ELSE 1 END AS s@_iat_n",
        "coalesce(s@_iat_sum, 0) + coalesce(edge@, 0) AS s@_iat_sum",
        "greatest(s@_iat_max, edge@) AS s@_iat_max",
        # An edge gap comes before the gaps of its segment: a zero among those makes it void.
        "CASE WHEN s@_iat_level IS NULL AND edge@ = 0 THEN s@_first_seq"
        " ELSE s@_iat_level END AS s@_iat_level",
        "CASE WHEN s@_iat_level IS NULL AND edge@ <> 0 THEN least(s@_iat_low, edge@)"
        " ELSE s@_iat_low END AS s@_iat_low",
    ] + [
        f"coalesce(s@_iat_{name}, 0) + coalesce({part}, 0) AS s@_iat_{name}"
        for name, part in exact.square_limbs("edge@").items()
    ]
    return segs.selectExpr(
        *key, "flow_seq", "burst_seq", "first_seq", "first_dscp", "first_ts", "last_ts", "idle", "followed",
        *flags, *["mode"] * ("mode" in segs.columns), *[c for c in PAST if c in segs.columns],
        *[x for template in fixed for x in _both(template)],
    )


def flow_rows(segs: DataFrame, key: list[str], parts: int | None = None) -> DataFrame:
    """Merge settled segments into one row per flow, still with sides instead of directions. Rows may stand for
    several bursts of a flow (``p_*`` columns, see ``merge_inside`` and ``resume``)."""
    e = F.expr
    flow = [*key, "flow_seq"]
    whole_flow = _window(flow)
    flags = [c for c in FLAGS if c in segs.columns]
    segs = dealt(segs, parts, *flow).selectExpr(
        "*",
        *_both(f"max(s@_len_state div {_SPAN} - 1) {whole_flow} AS len_top@"),
        *_both(f"max(s@_iat_level) {whole_flow} AS iat_top@"),
    )
    sides = [f"sum(s@_{c}) AS s@_{c}" for c in ("n", "vol", "hlen", "psh", "urg", "iat_n", "iat_sum")] + [
        f"sum({exact.decimal('s@_vol2', 28)}) AS s@_vol2",
        f"sum({exact.join_limbs('s@_iat_hh', 's@_iat_hl', 's@_iat_ll')}) AS s@_iat2",
        "max(s@_len_max) AS s@_len_max", "max(s@_iat_max) AS s@_iat_max", "min(s@_dscp_seq) AS s@_dscp_seq",
        "min_by(s@_first_dscp, s@_dscp_seq) AS s@_dscp",
        f"min(CASE WHEN s@_last_seq >= len_top@ THEN {LOW_LEN} END) AS s@_len_min",
        "min(CASE WHEN iat_top@ IS NULL OR s@_last_seq >= iat_top@ THEN s@_iat_low END) AS s@_iat_min",
    ]
    bursts = segs.groupBy(*flow, "burst_seq").agg(
        *[e(x) for template in sides for x in _both(template)],
        e("max(last_ts) - min(first_ts) AS active"), e("max(idle) AS idle"),
        e("min(first_ts) AS first_ts"), e("max(last_ts) AS last_ts"), e("max(followed) AS followed"),
        e("max(CASE WHEN first_seq = flow_seq THEN CASE WHEN s0_first_seq = first_seq THEN 0 ELSE 1 END END)"
          " AS first_side"),
        e("max(CASE WHEN first_seq = flow_seq AND first_dscp <> 0 THEN first_dscp END) AS open_dscp"),
        *[e(f"max({c}) AS {c}") for c in flags],
        *[e(f"max({c}) AS {c}") for c in PAST if c in segs.columns],
    )
    if PAST[0] in segs.columns:
        bursts = bursts.selectExpr(*[c for c in bursts.columns if c not in ("active", "idle")],
                                   *[f"CASE WHEN p_active_n IS NULL THEN {c} END AS {c}" for c in ("active", "idle")])
    else:
        bursts = bursts.selectExpr("*", *[f"CAST(NULL AS {PAST_TYPES[c]}) AS {c}" for c in PAST])
    bursts = bursts.selectExpr("*", f"max(CASE WHEN active = 0 THEN burst_seq ELSE p_active_top END) {whole_flow} AS active_top")
    totals = [f"sum(s@_{c}) AS s@_{c}" for c in
              ("n", "vol", "hlen", "psh", "urg", "iat_n", "iat_sum", "vol2", "iat2")]
    totals += [f"max(s@_{c}) AS s@_{c}" for c in ("len_max", "iat_max")]
    totals += [f"min(s@_{c}) AS s@_{c}" for c in ("len_min", "iat_min")]
    totals.append("min_by(s@_dscp, s@_dscp_seq) AS s@_dscp")
    square = lambda c, past: f"sum(coalesce({past}, CAST({exact.decimal(c, 18)} * {exact.decimal(c, 18)} AS DECIMAL(38,0))))"
    return bursts.groupBy(*flow).agg(
        *[e(x) for template in totals for x in _both(template)],
        e("min(first_ts) AS first_ts"), e("max(last_ts) AS last_ts"), e("max(followed) AS followed"),
        e("max(first_side) AS first_side"), e("max(open_dscp) AS open_dscp"),
        e("sum(coalesce(p_active_n, 1)) AS active_n"), e("sum(coalesce(p_active_sum, active)) AS active_sum"),
        e(f"{square('active', 'p_active2')} AS active2"), e("max(coalesce(p_active_max, active)) AS active_max"),
        e("min(CASE WHEN p_active_n IS NULL THEN CASE WHEN burst_seq > coalesce(active_top, -1) THEN active END"
          " WHEN active_top <=> p_active_top OR burst_seq > active_top THEN p_active_low END) AS active_min"),
        e("sum(coalesce(p_idle_n, CASE WHEN idle IS NULL THEN 0 ELSE 1 END)) AS idle_n"), e("sum(coalesce(p_idle_sum, idle)) AS idle_sum"),
        e(f"{square('idle', 'p_idle2')} AS idle2"), e("max(coalesce(p_idle_max, idle)) AS idle_max"),
        e("min(coalesce(p_idle_min, idle)) AS idle_min"),
        *[e(f"max({c}) AS {c}") for c in flags],
    )


def flow_columns(flows: DataFrame) -> DataFrame:
    """Turn sides into directions and finish the 45 output columns.

    Measures take their final names at once: the optimizer derives constraints for every renaming,
    and their number multiplies with the columns renamed.
    """
    def pick(a, b, name):
        return f"CASE WHEN first_side = 0 THEN {a} ELSE {b} END AS {name}"

    final = {"n": "total_@packets", "vol": "total_@volume", "hlen": "total_@hlen", "psh": "@psh_cnt",
             "urg": "@urg_cnt", "len_max": "max_@pktl", "len_min": "min_@pktl", "iat_max": "max_@iat",
             "iat_min": "min_@iat", "iat_n": "@iat_n", "iat_sum": "@iat_sum", "vol2": "@vol2", "iat2": "@iat2"}
    tcp_close = "closes" in flows.columns
    window = ["k_window"] if "k_window" in flows.columns else []
    directed = flows.selectExpr(
        *window, "CAST(proto AS BIGINT) AS proto", "flow_seq", "last_ts", "last_ts - first_ts AS duration", "followed",
        *(FLAGS if tcp_close else [f"false AS {c}" for c in FLAGS]),
        *[pick(_part(a), _part(b), name) for a, b, name in (
            ("k_ip1", "k_ip2", "srcip"), ("k_port1", "k_port2", "srcport"),
            ("k_ip2", "k_ip1", "dstip"), ("k_port2", "k_port1", "dstport"))],
        # A flow's first packet comes before any of the other side.
        "coalesce(open_dscp, CASE WHEN first_side = 0 THEN s1_dscp ELSE s0_dscp END, 0) AS dscp",
        *[pick(f"coalesce(s{int(d == 'b')}_{c}, 0)", f"coalesce(s{int(d == 'f')}_{c}, 0)", name.replace("@", d))
          for c, name in final.items() for d in "fb"],
        "active_n", "active_sum", "active2", "active_max AS max_active", "coalesce(active_min, 0) AS min_active",
        *[f"coalesce(idle{c}, 0) AS idle{c}" for c in ("_n", "_sum", "2")],
        "coalesce(idle_max, 0) AS max_idle", "coalesce(idle_min, 0) AS min_idle",
    )
    spreads = {
        "std_fpktl": ("fvol2", "total_fvolume", "total_fpackets"),
        "std_bpktl": ("bvol2", "total_bvolume", "total_bpackets"),
        "std_fiat": ("fiat2", "fiat_sum", "fiat_n"), "std_biat": ("biat2", "biat_sum", "biat_n"),
        "std_active": ("active2", "active_sum", "active_n"), "std_idle": ("idle2", "idle_sum", "idle_n"),
    }
    done = exact.add_int_std(directed, spreads)
    mean = lambda total, n: f"{total} div greatest({n}, 1)"
    cols = {f"mean_{name}": mean(f"{name}_sum", f"{name}_n") for name in ("fiat", "biat", "active", "idle")}
    for d in "fb":
        packets, volume = f"total_{d}packets", f"total_{d}volume"
        cols |= {
            f"mean_{d}pktl": f"CASE WHEN {packets} > 0 THEN {mean(volume, packets)} ELSE -1L END",
            f"sflow_{d}packets": f"{packets} div active_n", f"sflow_{d}bytes": f"{volume} div active_n",
        }
    names = [c for c in schemas.STATS_FLOW_COLUMNS if c != schemas.LABEL]
    return done.selectExpr(
        *[f"{cols[c]} AS {c}" if c in cols else c for c in names],
        *window, "flow_seq", "last_ts",
        "CASE WHEN closes THEN 'tcp_closed' WHEN followed THEN 'timeout' ELSE 'open' END AS end_reason",
        f"CASE WHEN proto = {UDP} THEN total_bpackets > 0 ELSE valid_hit END AS valid",
    )


def mark_tcp_rows(
    rows: DataFrame, key: list[str], timeout_us: int = FLOW_TIMEOUT_US, idle_us: int = IDLE_US,
    block_rows: int = BLOCK_ROWS, held: DataFrame | None = None,
) -> DataFrame:
    """As :func:`mark_gaps`, with TCP flows also ending at connection close; blocks follow the own rows of each key. With ``held`` (key, last_ts, mode), flows
    go on from there, and rows have the mode of their connection after them."""
    from flowspark.operators.tcp import pieces, track_connections

    is_tcp, never = F.col("proto") == TCP, F.lit(False)
    talk, other = rows.where(is_tcp), rows.where(~is_tcp)
    of = (None, None) if held is None else (held.where(is_tcp), held.where(~is_tcp))
    tcp = track_connections(talk, key_blocks(talk, key, block_rows, of[0]), key, timeout_us, idle_us, block_rows, of[0])
    marks = {"valid_hit": never, "closes": never} | ({} if held is None else {"mode": F.lit(0).cast("bigint")})
    other = pieces(other, key_blocks(other, key, block_rows, of[1]), key, block_rows)
    other = other.drop("block", "several").withColumnRenamed("piece", "block").withColumn("prev_ts", F.greatest(
        F.max("ts_us").over(Window.partitionBy(*key, "block").orderBy("seq").rowsBetween(*BEFORE)), F.col("carry_ts")))
    other = gaps(other.drop("carry_ts"), timeout_us, idle_us)
    return tcp.unionByName(other.withColumns(marks))


def flow_table(
    packets: DataFrame, *, tcp_close: bool = False, timeout_us: int = FLOW_TIMEOUT_US,
    idle_us: int = IDLE_US, window_us: int | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Flow statistics with bookkeeping columns (flow_seq, last_ts, end_reason, valid).

    ``tcp_close`` also ends TCP flows at connection close, ``window_us`` restarts all flows at
    every capture buffer.
    """
    rows, key = keyed_rows(packets, block_rows, window_us)
    parts = parts_for(rows, rows.count(), TASK_ROWS)
    if tcp_close:
        marked = dealt(mark_tcp_rows(rows, key, timeout_us, idle_us, block_rows), parts, *key, "block")
    else:
        marked = mark_gaps(dealt(rows, parts, *key, "block"), key, timeout_us, idle_us, key_blocks(rows, key))
    segs = settle_segments(merge_inside(segments(mark_runs(marked, key), key, keep_end=True), key), key, parts)
    return flow_columns(flow_rows(segs, key, parts))


def emit(flows: DataFrame, policy: str = "all", valid_only: bool = False) -> DataFrame:
    """Choose which flows leave: ``all`` of them or only those still ``open``."""
    if policy not in ("all", "open"):
        raise ValueError(f"policy must be 'all' or 'open', not {policy!r}")
    if policy == "open":
        flows = flows.where(F.col("end_reason") == "open")
    return flows.where("valid") if valid_only else flows


def flow_stats(packets: DataFrame, *, policy: str = "all", valid_only: bool = False, **options) -> DataFrame:
    """The 45 statistics columns of every flow."""
    names = [c for c in schemas.STATS_FLOW_COLUMNS if c != schemas.LABEL]
    return emit(flow_table(packets, **options), policy, valid_only).select(*names)


def expire_idle(flows: DataFrame, time_us: int, timeout_us: int = FLOW_TIMEOUT_US) -> DataFrame:
    """Flows not idle for longer than the timeout at the given time."""
    return flows.where(F.lit(time_us) - F.col("last_ts") <= timeout_us)


def assign_flows(
    packets: DataFrame, *, timeout_us: int = FLOW_TIMEOUT_US, idle_us: int = IDLE_US,
    window_us: int | None = None, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Kept packets with their flow (seq of its first packet), burst and direction."""
    rows, key = keyed_rows(packets, block_rows, window_us)
    rows = along_blocks(mark_runs(mark_gaps(rows, key, timeout_us, idle_us), key), key)
    return restored_key(rows).select(
        *[k for k in key if k != NULLS], "seq", "ts_us", "len", "gap", "side", "flow_seq", "burst_seq",
        F.when(F.col("side") == F.col("first_side"), "f").otherwise("b").alias("direction"),
    )
