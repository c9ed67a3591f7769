"""Plain SQL over the base tables that gives the same rows as the registered queries.

Building blocks are CTE texts; a query text is a chain of them and a final SELECT.
"""

from __future__ import annotations

from flowspark import schemas

K = "k_ip1, k_port1, k_ip2, k_port2, proto"
FEATURES = [c for c in schemas.STATS_FLOW_COLUMNS if c != schemas.LABEL]

PACKETS = """
b AS (SELECT event_id AS e, user_id AS u, event_type AS et, epoch_us(ts) AS us,
             CAST(round(value*100) AS BIGINT) AS cents FROM events),
k AS (SELECT *, CASE u%3 WHEN 0 THEN 100000 WHEN 1 THEN 20000 ELSE 200 END AS squeeze,
             CASE WHEN u%10<6 THEN 6 WHEN u%10<9 THEN 17 ELSE 1 END AS proto,
             cents%5<3 AS fwd,
             CASE WHEN u%4=0 THEN 40+cents%100 ELSE 40+cents%1461 END AS len FROM b),
packets AS (
SELECT e AS seq,
       1704067200000000 + (us-1704067200000000)//squeeze - CASE WHEN e%97=0 THEN 3000000 ELSE 0 END AS ts_us,
       CASE WHEN fwd THEN '10.0.'||(u//256)||'.'||(u%256) ELSE '192.168.0.'||(u%7) END AS srcip,
       CASE WHEN fwd THEN '192.168.0.'||(u%7) ELSE '10.0.'||(u//256)||'.'||(u%256) END AS dstip,
       CASE WHEN proto=1 THEN NULL WHEN fwd THEN 1024+u ELSE 80 END AS srcport,
       CASE WHEN proto=1 THEN NULL WHEN fwd THEN 80 ELSE 1024+u END AS dstport,
       proto, len, 20 AS iphlen,
       CASE proto WHEN 6 THEN 20+4*(e%4) WHEN 17 THEN len-20 ELSE 8 END AS prhlen,
       (cents%4)*8 AS dscp, 32+cents%97 AS ttl,
       CASE WHEN proto<>6 THEN NULL
            WHEN et='signup'   THEN (CASE WHEN fwd THEN 2 ELSE 18 END)
            WHEN et='purchase' THEN 24
            WHEN et='error'    THEN (CASE WHEN cents%4=0 THEN 4 ELSE 48 END)
            WHEN cents%3=0     THEN 17 ELSE 16 END AS flags,
       cents, fwd
FROM k)"""


def _bit(mask):
    return f"CASE WHEN (flags & {mask}) = {mask} THEN 1 END"


def _only(proto, expr):
    return f"CASE WHEN proto = {proto} THEN {expr} END"


_RECORD = {
    "ip_srcaddr": "srcip", "ip_dstaddr": "dstip", "ip_proto": "proto", "ip_ttl": "ttl",
    "ip_flagdf": "CASE WHEN cents%2=0 THEN 1 END", "ip_flagmf": "CASE WHEN cents%19=0 THEN 1 END",
    "ip_fragoffset": "CASE WHEN cents%19=0 THEN cents%8 ELSE 0 END", "ip_hdrlen": "iphlen", "ip_pktlen": "len",
    "tcp_srcport": _only(6, "srcport"), "tcp_dstport": _only(6, "dstport"),
    "tcp_flagack": _bit(16), "tcp_flagcwr": _only(6, "CASE WHEN cents%13=0 THEN 0 WHEN cents%17=0 THEN 1 END"),
    "tcp_flagecn": _only(6, "CASE WHEN cents%11=0 THEN 1 END"), "tcp_flagfin": _bit(1), "tcp_flagpsh": _bit(8),
    "tcp_flagrst": _bit(4), "tcp_flagsyn": _bit(2), "tcp_flagurg": _bit(32),
    "tcp_hdrlen": _only(6, "prhlen"), "tcp_pktlen": _only(6, "len-iphlen"),
    "udp_srcport": _only(17, "srcport"), "udp_dstport": _only(17, "dstport"), "udp_len": _only(17, "len-20"),
    "icmp_type": _only(1, "CASE WHEN fwd THEN 8 ELSE 0 END"),
    "icmp_code": _only(1, "CASE WHEN cents%5=4 THEN NULL ELSE 0 END"),
}
RECORDS = PACKETS + ",\nrecords AS (SELECT seq, ts_us, " + ", ".join(
    f"{e} AS {c}" if c in ("ip_srcaddr", "ip_dstaddr") else f"CAST({e} AS INTEGER) AS {c}"
    for c, e in _RECORD.items()) + " FROM packets)"


def agg_flows(protos=(6, 17, 1), flags="set", source="records", extra=""):
    """Aggregate flows of some protocols, as one SELECT per protocol stacked on each other."""
    count = (lambda c: f"count({c})") if flags == "nonnull" else (lambda c: f"count(*) FILTER (WHERE {c} = 1)")
    shared = {
        "qtd_pkt_ip": "count(*)", "qtd_do_not_frag": count("ip_flagdf"), "qtd_more_frag": count("ip_flagmf"),
        "fragment_offset_m": "avg(ip_fragoffset)",
    }
    own = {
        6: {"qtd_pkt_tcp": "count(*)", "qtd_src_port": "count(DISTINCT tcp_srcport)",
            "qtd_dst_port": "count(DISTINCT tcp_dstport)", "ttl_m": "avg(ip_ttl)",
            "header_len_m": "avg(tcp_hdrlen)", "packet_len_m": "avg(tcp_pktlen)",
            "qtd_fin_flag": count("tcp_flagfin"), "qtd_syn_flag": count("tcp_flagsyn"),
            "qtd_psh_flag": count("tcp_flagpsh"), "qtd_ack_flag": count("tcp_flagack"),
            "qtd_urg_flag": count("tcp_flagurg"), "qtd_rst_flag": count("tcp_flagrst"),
            "qtd_ece_flag": count("tcp_flagecn"), "qtd_cwr_flag": count("tcp_flagcwr")},
        17: {"qtd_pkt_udp": "count(*)", "qtd_src_port": "count(DISTINCT udp_srcport)",
             "qtd_dst_port": "count(DISTINCT udp_dstport)", "header_len_m": "8.0", "packet_len_m": "avg(udp_len)"},
        1: {"qtd_pkt_icmp": "count(*)", "ttl_m": "avg(ip_ttl)", "header_len_m": "avg(ip_hdrlen)",
            "packet_len_m": "avg(ip_pktlen)", "qtd_t_icmp": "count(icmp_type)", "qtd_cdg_icmp": "count(icmp_code)"},
    }
    group = f"ip_srcaddr, ip_dstaddr{', ' + extra if extra else ''}"
    parts = []
    for proto in protos:
        cols = ["ip_srcaddr AS srcaddr", "ip_dstaddr AS dstaddr"] + ([extra] if extra else []) + [f"{proto} AS ip_proto"]
        for c in schemas.AGG_FLOW_COLUMNS[2:-1]:
            e = own[proto].get(c) or shared.get(c) or "0"
            cols.append(f"round(CAST({e} AS DOUBLE), 6) AS {c}" if c in schemas.AGG_MEANS else f"CAST({e} AS BIGINT) AS {c}")
        parts.append(f"SELECT {', '.join(cols)} FROM {source} WHERE ip_proto = {proto} GROUP BY {group}")
    return " UNION ALL ".join(parts)


AGG_COLUMNS = ", ".join(schemas.AGG_FLOW_COLUMNS[:-1])

KEYED = """
keyed AS (SELECT *, CASE WHEN srcip = k_ip1 THEN 0 ELSE 1 END AS side, iphlen + prhlen AS hlen FROM (
SELECT *, CASE WHEN dstip < srcip THEN dstip ELSE srcip END AS k_ip1,
          CASE WHEN dstip < srcip THEN dstport ELSE srcport END AS k_port1,
          CASE WHEN dstip < srcip THEN srcip ELSE dstip END AS k_ip2,
          CASE WHEN dstip < srcip THEN srcport ELSE dstport END AS k_port2,
          CAST(ts_us - ts_us % 2000000 AS BIGINT) AS k_window
FROM packets WHERE proto IN (6, 17)))"""

_COMMON = "k_ip1, k_port1, k_ip2, k_port2, proto, k_window, side, seq, ts_us, len, hlen, dscp, flags"


def _by_timeout(name, source, key):
    return f"""
{name}_late AS (SELECT *, max(ts_us) OVER (PARTITION BY {key} ORDER BY seq
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM {source}),
{name}_gap AS (SELECT *, CASE WHEN ts_us - prev > 600000000 THEN NULL ELSE ts_us - prev END AS gap
               FROM {name}_late WHERE prev IS NULL OR ts_us >= prev),
{name} AS (SELECT {_COMMON}, gap, max(CASE WHEN gap IS NULL THEN seq END) OVER (PARTITION BY {key} ORDER BY seq)
           AS flow_seq, false AS hit, false AS closes FROM {name}_gap)"""


def _next(state, own):
    return (f"CASE WHEN p.flags & 4 = 4 THEN 5 WHEN p.flags & 1 = 1 AND {own} THEN 4"
            f" WHEN {state} = 0 AND p.flags & 2 = 2 AND {own} THEN 1"
            f" WHEN {state} = 1 AND p.flags & 18 = 18 AND NOT ({own}) THEN 2"
            f" WHEN {state} = 2 AND p.flags & 16 = 16 AND {own} THEN 3"
            f" WHEN {state} = 4 AND p.flags & 16 = 16 AND NOT ({own}) THEN 5 ELSE {state} END")


def _by_close(name, source, key):
    """One recursion step per packet of a key; event 0 late, 1 starts a flow, 2 joins, 3 closes it."""
    first_c, first_s = _next("0", "true"), _next("0", "false")
    same = " AND ".join(f"p.{c.strip()} = f.{c.strip()}" for c in key.split(","))
    fresh = "(NOT f.is_open OR p.ts_us - f.last_ts > 600000000)"
    late = f"(NOT {fresh} AND p.ts_us < f.last_ts)"
    nc, ns = _next("f.c", "p.side = f.fs"), _next("f.s", "p.side <> f.fs")
    common = ", ".join("p." + c.strip() for c in _COMMON.split(","))
    return f"""
{name}_rows AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY seq) AS rn FROM {source} WHERE proto = 6),
{name}_fold AS (
SELECT {common}, rn, true AS is_open, side AS fs, {first_c} AS c, {first_s} AS s, ts_us AS last_ts, seq AS flow_seq,
       1 AS event, CAST(NULL AS BIGINT) AS gap, false AS hit FROM {name}_rows p WHERE rn = 1
UNION ALL
SELECT {common}, p.rn,
       CASE WHEN {fresh} THEN true WHEN {late} THEN f.is_open ELSE NOT ({nc} = 5 AND {ns} = 5) END,
       CASE WHEN {fresh} THEN p.side ELSE f.fs END,
       CASE WHEN {fresh} THEN {first_c} WHEN {late} THEN f.c ELSE {nc} END,
       CASE WHEN {fresh} THEN {first_s} WHEN {late} THEN f.s ELSE {ns} END,
       CASE WHEN {late} THEN f.last_ts ELSE p.ts_us END,
       CASE WHEN {fresh} THEN p.seq ELSE f.flow_seq END,
       CASE WHEN {fresh} THEN 1 WHEN {late} THEN 0 WHEN {nc} = 5 AND {ns} = 5 THEN 3 ELSE 2 END,
       CASE WHEN {fresh} THEN NULL ELSE p.ts_us - f.last_ts END,
       NOT {fresh} AND NOT {late} AND f.c = 3 AND p.len > p.hlen
FROM {name}_fold f JOIN {name}_rows p ON {same} AND p.rn = f.rn + 1),
{name}_tcp AS (SELECT {_COMMON}, gap, flow_seq, hit, event = 3 AS closes FROM {name}_fold WHERE event <> 0),
{name}_other AS (SELECT * FROM {source} WHERE proto <> 6),
{_by_timeout(name + "_udp", name + "_other", key)},
{name} AS (SELECT * FROM {name}_tcp UNION ALL SELECT * FROM {name}_udp)"""


def _std(squares, total, n):
    return (f"CASE WHEN {n} > 1 THEN CAST(floor(sqrt(CAST((({squares}) - (CAST({total} AS HUGEINT) * {total}) // {n})"
            f" // ({n} - 1) AS DOUBLE))) AS BIGINT) ELSE 0 END")


def flow_ctes(tcp_close=False, window=False):
    """CTEs from packets to ``flows`` (45 columns and bookkeeping); also ``dirs``, one row per kept packet."""
    key = K + (", k_window" if window else "")
    flow = f"{key}, flow_seq"
    marked = (_by_close if tcp_close else _by_timeout)("marked", "keyed", key)
    series = []
    for d, cond in (("f", "fwd"), ("b", "NOT fwd")):
        on = f"FILTER (WHERE {cond})"
        series.append(f"""
 count(*) {on} AS {d}n, coalesce(sum(len) {on}, 0) AS {d}v, coalesce(sum(CAST(len AS HUGEINT) * len) {on}, 0) AS {d}v2,
 coalesce(min(len) FILTER (WHERE {cond} AND seq > coalesce(zl, -1)), 0) AS {d}lmin, coalesce(max(len) {on}, 0) AS {d}lmax,
 count(iat) {on} AS {d}in, coalesce(sum(iat) {on}, 0) AS {d}is, coalesce(sum(CAST(iat AS HUGEINT) * iat) {on}, 0) AS {d}i2,
 coalesce(min(iat) FILTER (WHERE {cond} AND seq > coalesce(zi, -1)), 0) AS {d}imin, coalesce(max(iat) {on}, 0) AS {d}imax,
 count(*) FILTER (WHERE {cond} AND proto = 6 AND flags & 8 = 8) AS {d}psh,
 count(*) FILTER (WHERE {cond} AND proto = 6 AND flags & 32 = 32) AS {d}urg, coalesce(sum(hlen) {on}, 0) AS {d}h""")
    out = ["srcip", "srcport", "dstip", "dstport", "proto"]
    for d in "fb":
        out += [f"{d}n AS total_{d}packets", f"{d}v AS total_{d}volume", f"{d}lmin AS min_{d}pktl",
                f"CASE WHEN {d}n > 0 THEN {d}v // {d}n ELSE -1 END AS mean_{d}pktl", f"{d}lmax AS max_{d}pktl",
                f"{_std(d + 'v2', d + 'v', d + 'n')} AS std_{d}pktl", f"{d}imin AS min_{d}iat",
                f"{d}is // greatest({d}in, 1) AS mean_{d}iat", f"{d}imax AS max_{d}iat",
                f"{_std(d + 'i2', d + 'is', d + 'in')} AS std_{d}iat",
                f"{d}n // nb AS sflow_{d}packets", f"{d}v // nb AS sflow_{d}bytes",
                f"{d}psh AS {d}psh_cnt", f"{d}urg AS {d}urg_cnt", f"{d}h AS total_{d}hlen"]
    out += ["last_ts - first_ts AS duration", "amin AS min_active", "asum // nb AS mean_active", "amax AS max_active",
            f"{_std('a2', 'asum', 'nb')} AS std_active", "imin AS min_idle", "isum // greatest(inn, 1) AS mean_idle",
            "imax AS max_idle", f"{_std('i2', 'isum', 'inn')} AS std_idle", "coalesce(dscp, 0) AS dscp"]
    cast = []
    for expr in out:
        name = expr.rpartition(" AS ")[2]
        body = expr[: -len(" AS " + name)] if " AS " + name in expr else expr
        cast.append(f"{body} AS {name}" if name in ("srcip", "dstip") else f"CAST({body} AS BIGINT) AS {name}")
    return f"""{KEYED},
{marked},
bursts AS (SELECT *, max(CASE WHEN gap IS NULL OR gap > 1000000 THEN seq END)
             OVER (PARTITION BY {flow} ORDER BY seq) AS burst_seq,
             first_value(side) OVER (PARTITION BY {flow} ORDER BY seq) AS fside FROM marked),
dirs AS (SELECT *, side = fside AS fwd,
           ts_us - lag(ts_us) OVER (PARTITION BY {flow}, burst_seq, side ORDER BY seq) AS iat FROM bursts),
zeros AS (SELECT *, max(CASE WHEN len = 0 THEN seq END) OVER (PARTITION BY {flow}, fwd) AS zl,
            max(CASE WHEN iat = 0 THEN seq END) OVER (PARTITION BY {flow}, fwd) AS zi,
            row_number() OVER (PARTITION BY {flow}, burst_seq, side ORDER BY seq) AS nth FROM dirs),
acts AS (SELECT {flow}, burst_seq, max(ts_us) - min(ts_us) AS active, max(CASE WHEN seq = burst_seq THEN gap END) AS idle
         FROM dirs GROUP BY {flow}, burst_seq),
acts0 AS (SELECT *, max(CASE WHEN active = 0 THEN burst_seq END) OVER (PARTITION BY {flow}) AS za FROM acts),
actf AS (SELECT {flow}, count(*) AS nb, sum(active) AS asum, sum(CAST(active AS HUGEINT) * active) AS a2, max(active) AS amax,
           coalesce(min(active) FILTER (WHERE burst_seq > coalesce(za, -1)), 0) AS amin, count(idle) AS inn,
           coalesce(sum(idle), 0) AS isum, coalesce(sum(CAST(idle AS HUGEINT) * idle), 0) AS i2,
           coalesce(min(idle), 0) AS imin, coalesce(max(idle), 0) AS imax FROM acts0 GROUP BY {flow}),
sums AS (SELECT {flow}, any_value(fside) AS fs, min(ts_us) AS first_ts, max(ts_us) AS last_ts, bool_or(hit) AS hit,
           bool_or(closes) AS closes,
           arg_min(dscp, seq) FILTER (WHERE dscp <> 0 AND (seq = flow_seq OR (NOT fwd AND nth = 1))) AS dscp,
           {",".join(series)} FROM zeros GROUP BY {flow}),
ends AS (SELECT sums.*, max(flow_seq) OVER (PARTITION BY {key}) AS last_flow,
           CASE WHEN fs = 0 THEN k_ip1 ELSE k_ip2 END AS srcip, CASE WHEN fs = 0 THEN k_port1 ELSE k_port2 END AS srcport,
           CASE WHEN fs = 0 THEN k_ip2 ELSE k_ip1 END AS dstip, CASE WHEN fs = 0 THEN k_port2 ELSE k_port1 END AS dstport
         FROM sums),
flows AS (SELECT {", ".join(cast)}, flow_seq, last_ts{", k_window" if window else ""},
            CASE WHEN closes THEN 'tcp_closed' WHEN flow_seq < last_flow THEN 'timeout' ELSE 'open' END AS end_reason,
            CASE WHEN proto = 17 THEN bn > 0 ELSE hit END AS valid
          FROM ends JOIN actf USING ({flow}))"""


def flow_query(select, tcp_close=False, window=False):
    return f"WITH RECURSIVE {PACKETS},\n{flow_ctes(tcp_close, window)}\n{select}"


#: Hosts whose ports a capture did not see. Inside, -1 stands for null: SQL joins do not match nulls.
PORTLESS = ("192.168.0.3", "192.168.0.5")
_PORTLESS = ", ".join(f"'{ip}'" for ip in PORTLESS)
PORTLESS_PACKETS = PACKETS.replace("packets AS (", "seen AS (") + f""",
packets AS (SELECT * REPLACE (
  CASE WHEN srcip IN ({_PORTLESS}) OR dstip IN ({_PORTLESS}) THEN -1 ELSE srcport END AS srcport,
  CASE WHEN srcip IN ({_PORTLESS}) OR dstip IN ({_PORTLESS}) THEN -1 ELSE dstport END AS dstport) FROM seen)"""


def portless_flow_query(select, tcp_close=False):
    """As :func:`flow_query` with null ports at some hosts; ``select`` reads ``flows``."""
    flows = "SELECT * REPLACE (nullif(srcport, -1) AS srcport, nullif(dstport, -1) AS dstport) FROM flows"
    return (f"WITH RECURSIVE {PORTLESS_PACKETS},\n{flow_ctes(tcp_close)},\nportless AS ({flows})\n"
            + select.replace("FROM flows", "FROM portless"))


LABEL = ("CASE WHEN CAST(string_split(CASE WHEN srcip LIKE '10.0.%' THEN srcip ELSE dstip END, '.')[4] AS INTEGER) % 4 = 0"
         " THEN 1 ELSE 0 END")
STATS = ", ".join(FEATURES)

MEASURES = """
m AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS row_index,
             l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
             CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem)"""
MEASURE_NAMES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def long_measures(keep="", source="m"):
    """(keep..., feature, value), one branch per feature."""
    keep = keep and keep + ", "
    return " UNION ALL ".join(
        f"SELECT {keep}'{c}' AS feature, {i} AS nr, {c} AS value FROM {source}" for i, c in enumerate(MEASURE_NAMES))


def entropy_ctes(n, ranges, group, source, name="ent"):
    """Entropy per ``group`` of a long table ``source`` (group..., value) over shares of n."""
    return f"""
{name}_range AS (SELECT *, min(value) OVER (PARTITION BY {group}) AS low, max(value) OVER (PARTITION BY {group}) AS high FROM {source}),
{name}_bucket AS (SELECT {group}, CASE WHEN high = low THEN 0 ELSE CAST(floor((value - low) / (high - low) * {ranges}) AS INTEGER) END AS bucket,
               count(*) AS n FROM {name}_range GROUP BY ALL),
{name} AS (SELECT {group}, round(-sum((n / {n}.0) * log2(n / {n}.0)), 12) + 0.0 AS entropy FROM {name}_bucket GROUP BY {group})"""


def entropy_limit_ctes(n, ranges, threshold):
    """``limits`` of the entropy detector over all runs of n rows of ``m``."""
    return f"""{MEASURES},
wins AS (SELECT a.row_index AS w, b.* EXCLUDE (row_index) FROM m a JOIN m b
         ON b.row_index BETWEEN a.row_index AND a.row_index + {n - 1}
         WHERE a.row_index + {n - 1} < (SELECT count(*) FROM m)),
winlong AS ({long_measures("w", "wins")}),
{entropy_ctes(n, ranges, "w, feature, nr", "winlong")},
spans AS (SELECT nr, min(entropy) AS low, max(entropy) AS high FROM ent GROUP BY nr),
hist AS (SELECT nr, low, high, CASE WHEN high = low THEN 0 ELSE least(CAST(floor((entropy - low) / (high - low) * {ranges}) AS INTEGER), {ranges - 1}) END AS bucket,
         count(*) AS n FROM ent JOIN spans USING (nr) GROUP BY ALL),
tops AS (SELECT nr, low, high, bucket FROM hist QUALIFY row_number() OVER (PARTITION BY nr ORDER BY n DESC, bucket) = 1),
limits AS (SELECT nr, low + (bucket * (high - low)) / {ranges} - {threshold} AS lower,
           CASE WHEN bucket = {ranges - 1} OR high = low THEN high ELSE low + ((bucket + 1) * (high - low)) / {ranges} END + {threshold} AS upper FROM tops)"""
