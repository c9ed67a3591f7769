"""Flow rules: hand-made packet lists, and random ones against SQL and the streaming state."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from flowspark import schemas
from flowspark.operators import flows, tcp
from flowspark.plans import oracle
from flowspark.session import scratch_dir
from flowspark.streaming import batches, stateful

FEATURES = oracle.FEATURES
CORE = "seq bigint, ts_us bigint, srcip string, dstip string, srcport bigint, dstport bigint, proto int, len bigint, iphlen int, prhlen bigint, dscp bigint, ttl bigint, flags int"
C, S = ("10.0.0.1", 5000), ("10.0.0.2", 80)
T0 = 1_000_000_000_000


def packet(seq, ts, forward=True, proto=17, size=100, dscp=0, flags=0, client=C, server=S, prhlen=8):
    a, b = (client, server) if forward else (server, client)
    return (seq, T0 + ts, a[0], b[0], a[1], b[1], proto, size, 20, prhlen, dscp, 64, flags if proto == 6 else None)


def frame(spark, packets):
    return spark.createDataFrame(packets, CORE)


def table(spark, packets, **options):
    rows = flows.flow_table(frame(spark, packets), **options).orderBy("flow_seq").collect()
    return [r.asDict() for r in rows]


def one(spark, packets, **options):
    (row,) = table(spark, packets, **options)
    return row


def test_idle_threshold_is_strict(spark):
    row = one(spark, [packet(0, 0), packet(1, 1_000_000), packet(2, 2_000_001)])
    assert (row["max_idle"], row["min_idle"], row["mean_active"], row["max_active"]) == (1_000_001, 1_000_001, 500_000, 1_000_000)


def test_timeout_is_strict(spark):
    rows = table(spark, [packet(0, 0), packet(1, 600_000_000), packet(2, 1_200_000_001)])
    assert [(r["total_fpackets"], r["end_reason"]) for r in rows] == [(2, "timeout"), (1, "open")]
    assert rows[1]["max_idle"] == 0


def test_zero_gap_resets_the_minimum(spark):
    row = one(spark, [packet(i, t) for i, t in enumerate((0, 10, 10, 17, 40))])
    assert (row["min_fiat"], row["max_fiat"], row["mean_fiat"]) == (7, 23, 10)
    row = one(spark, [packet(i, t) for i, t in enumerate((0, 10, 10))])
    assert row["min_fiat"] == 0


def test_one_sided_flow(spark):
    row = one(spark, [packet(0, 0, size=60)])
    assert (row["mean_bpktl"], row["min_bpktl"], row["std_fpktl"], row["duration"], row["valid"]) == (-1, 0, 0, 0, False)


def test_server_speaks_first(spark):
    row = one(spark, [packet(0, 0, forward=False), packet(1, 5)])
    assert (row["srcip"], row["srcport"], row["total_fpackets"], row["total_bpackets"], row["valid"]) == (S[0], S[1], 1, 1, True)


def test_late_packets_are_ignored(spark):
    row = one(spark, [packet(0, 100), packet(1, 50), packet(2, 120)])
    assert (row["total_fpackets"], row["duration"]) == (2, 20)


def test_equal_addresses_are_all_forward(spark):
    a, b = ("10.0.0.9", 1), ("10.0.0.9", 2)
    rows = table(spark, [packet(0, 0, client=a, server=b), packet(1, 5, forward=False, client=a, server=b)])
    assert [(r["srcport"], r["total_fpackets"], r["total_bpackets"]) for r in rows] == [(1, 1, 0), (2, 1, 0)]


def test_dscp_of_a_later_burst(spark):
    quiet = [packet(0, 0), packet(1, 10, forward=False)]
    second = [packet(2, 5_000_000), packet(3, 5_000_010, forward=False, dscp=9), packet(4, 5_000_020, forward=False, dscp=7)]
    assert one(spark, quiet + second)["dscp"] == 9
    late = [packet(2, 5_000_000, forward=False), packet(3, 5_000_010, forward=False, dscp=7)]
    assert one(spark, quiet + late)["dscp"] == 0


def test_udp_header_length_is_the_length_field(spark):
    assert one(spark, [packet(0, 0, prhlen=80)])["total_fhlen"] == 100


def tcp_packet(seq, ts, flags, forward=True, size=40):
    return packet(seq, ts, forward, proto=6, size=size, flags=flags, prhlen=20)


def test_first_packet_reset_closes_at_the_second(spark):
    rows = table(spark, [tcp_packet(0, 0, 4), tcp_packet(1, 1, 16), tcp_packet(2, 2, 16)], tcp_close=True)
    assert [(r["total_fpackets"], r["end_reason"]) for r in rows] == [(2, "tcp_closed"), (1, "open")]


def test_handshake_data_and_close(spark):
    talk = [tcp_packet(0, 0, 2), tcp_packet(1, 1, 18, False), tcp_packet(2, 2, 16), tcp_packet(3, 3, 24, size=500),
            tcp_packet(4, 4, 17), tcp_packet(5, 5, 16, False), tcp_packet(6, 6, 17, False), tcp_packet(7, 7, 16)]
    rows = table(spark, talk + [tcp_packet(8, 8, 2)], tcp_close=True)
    assert [(r["flow_seq"], r["end_reason"], r["valid"]) for r in rows] == [(0, "tcp_closed", True), (8, "open", False)]


def test_fin_after_closed_reopens_the_side():
    assert tcp.next_state(tcp.CLOSED, 1, own=True) == tcp.FIN_SEEN
    assert tcp.next_state(tcp.CLOSED, 1, own=False) == tcp.CLOSED
    assert tcp.next_state(tcp.ESTABLISHED, 4 | 1, own=True) == tcp.CLOSED


def test_transitions():
    steps = [(tcp.START, 2, True, tcp.SYN_SEEN), (tcp.START, 2, False, tcp.START), (tcp.SYN_SEEN, 18, False, tcp.SYNACK),
             (tcp.SYN_SEEN, 16, False, tcp.SYN_SEEN), (tcp.SYNACK, 16, True, tcp.ESTABLISHED),
             (tcp.FIN_SEEN, 16, False, tcp.CLOSED), (tcp.FIN_SEEN, 16, True, tcp.FIN_SEEN)]
    for state, flags, own, after in steps:
        assert tcp.next_state(state, flags, own) == after


def test_emit_and_expire(spark):
    data = [packet(0, 0), packet(1, 700_000_000), packet(2, 0, client=("10.0.0.7", 1))]
    found = flows.flow_table(frame(spark, data))
    assert flows.emit(found, "open").count() == 2 and flows.emit(found).count() == 3
    assert flows.expire_idle(found, T0 + 700_000_001).count() == 1
    with pytest.raises(ValueError):
        flows.emit(found, "none")


def test_large_gaps_square_exactly(spark):
    gaps = [599_999_999, 1, 599_999_998, 2] * 20
    times = [0]
    for g in gaps:
        times.append(times[-1] + g)
    packets = [packet(i, t) for i, t in enumerate(times)]
    n, total = len([g for g in gaps if g > 1_000_000]), sum(g for g in gaps if g > 1_000_000)
    row = one(spark, packets)
    squares = sum(g * g for g in gaps if g > 1_000_000)
    assert row["std_idle"] == int(math.sqrt((squares - total * total // n) // (n - 1)))


def random_packets(seed, n=260):
    """Few keys, many ties, late packets, zero lengths, all flag combinations that matter."""
    r = random.Random(seed)
    clocks, out = {}, []
    for seq in range(n):
        pair, proto = r.randrange(3), r.choice((6, 6, 17))
        step = r.choice((0, 0, 1, 5, 900_000, 1_000_000, 1_000_001, 3_000_000, 600_000_000, 600_000_001))
        clock = clocks[pair, proto] = clocks.get((pair, proto), 0) + step
        ts = clock - (r.choice((0, 0, 0, 0, 2, 2_000_000)) if r.random() < 0.2 else 0)
        flags = r.choice((2, 18, 16, 16, 24, 17, 17, 4, 48)) if proto == 6 else 0
        a, b = ("10.0.0.1", "10.0.0.2") if pair < 2 else ("10.0.0.3", "10.0.0.3")
        client, server = (a, 1000 + pair), (b, 80)
        out.append(packet(seq, ts, r.random() < 0.6, proto, r.choice((0, 40, 41, 60, 1500)), r.choice((0, 0, 8, 24)),
                          flags, client, server, 20))
    return out


def by_sql(packets, **options):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE packets ({CORE})")
    con.executemany("INSERT INTO packets VALUES (?,?,?,?,?,?,?,?,?,?,?,?,?)", packets)
    sql = f"WITH RECURSIVE {oracle.flow_ctes(**options).lstrip()} SELECT {', '.join(FEATURES)}, end_reason, valid FROM flows"
    return sorted(map(str, con.sql(sql).fetchall()))


def by_state(packets, tcp_close):
    """The streaming state machine, driven without a stream."""
    open_flows, out = {}, []
    for p in packets:
        seq, ts, src, dst, sport, dport, proto, size, iphlen, prhlen, dscp, _, flags = p
        swap = dst < src
        key = (dst, dport, src, sport, proto) if swap else (src, sport, dst, dport, proto)
        side = 0 if src == key[0] else 1
        row = dict(seq=seq, ts_us=ts, side=side, len=size, hlen=iphlen + prhlen, dscp=dscp, symbol=64 * side + (flags or 0))
        is_tcp, flow = proto == 6, open_flows.get(key)
        if flow is None:
            open_flows[key] = stateful.open_flow(is_tcp, row)
            continue
        event = stateful.add_packet(flow, is_tcp, row, flows.FLOW_TIMEOUT_US, flows.IDLE_US)
        if event == tcp.STARTS:
            out.append(stateful.flow_record(key, flow, "timeout"))
            open_flows[key] = stateful.open_flow(is_tcp, row)
        elif event == tcp.CLOSES and tcp_close:
            out.append(stateful.flow_record(key, open_flows.pop(key), "tcp_closed"))
    out += [stateful.flow_record(k, f, "open") for k, f in open_flows.items()]
    return sorted(str(tuple(r[c] for c in (*FEATURES, "end_reason", "valid"))) for r in out)


def spark_rows(spark, packets, **options):
    rows = flows.flow_table(frame(spark, packets), **options).select(*FEATURES, "end_reason", "valid").collect()
    return [tuple(r) for r in rows]


def by_spark(spark, packets, **options):
    return sorted(map(str, spark_rows(spark, packets, **options)))


@pytest.mark.parametrize("seed", range(3))
def test_random_packets_with_tcp_close(spark, seed):
    packets = random_packets(seed)
    want = by_sql(packets, tcp_close=True)
    assert by_state(packets, True) == want
    assert by_spark(spark, packets, tcp_close=True) == want
    assert by_spark(spark, packets, tcp_close=True, block_rows=7) == want


@pytest.mark.parametrize("seed", range(3, 6))
def test_random_packets_with_timeout(spark, seed):
    packets = random_packets(seed)
    want = by_sql(packets)
    assert by_spark(spark, packets) == want
    assert by_spark(spark, packets, block_rows=5) == want


def test_random_packets_with_capture_window(spark):
    packets = random_packets(9)
    assert by_spark(spark, packets, window_us=flows.CAPTURE_US, block_rows=11) == by_sql(packets, window=True)


def test_null_ports_are_values(spark):
    """Flows of keys with null parts do not depend on the block size, and no flow is lost."""
    def ports(p, value):
        return (*p[:4], value, value, *p[6:]) if p[2] == "10.0.0.3" else p

    packets = random_packets(11)
    for options in ({}, {"tcp_close": True}):
        unseen = [ports(p, None) for p in packets]
        whole = spark_rows(spark, unseen, **options)
        marked = [tuple(None if i in (1, 3) and x == 9999 else x for i, x in enumerate(row))
                  for row in spark_rows(spark, [ports(p, 9999) for p in packets], **options)]
        assert sorted(map(str, whole)) == sorted(map(str, marked))
        assert sorted(map(str, whole)) == sorted(map(str, spark_rows(spark, unseen, block_rows=5, **options)))
    seen, other = tcp_packet(0, 0, 2), tcp_packet(1, 1, 2)
    for options in ({}, {"tcp_close": True}):
        assert flows.flow_stats(frame(spark, [seen, (*other[:4], None, None, *other[6:])]), **options).count() == 2


@pytest.mark.parametrize("offset", [2**46, 2**55, 2**62])
def test_large_sequence_numbers(spark, offset):
    packets = random_packets(12)
    want = by_spark(spark, packets, tcp_close=True)
    assert by_spark(spark, [(p[0] + offset, *p[1:]) for p in packets], tcp_close=True) == want


def test_large_lengths(spark):
    row = one(spark, [packet(0, 0, size=200_000), packet(1, 5, size=150_000)])
    assert (row["min_fpktl"], row["max_fpktl"]) == (150_000, 200_000)


def test_one_key_holding_most_rows_is_spread(spark):
    hot = [packet(i, 10 * i) for i in range(2000)]
    rows, key = flows.keyed_rows(frame(spark, hot), block_rows=100)
    assert rows.groupBy(*key, "block").count().agg(F.max("count")).first()[0] == 100
    row = one(spark, hot, block_rows=100)
    assert (row["total_fpackets"], row["mean_fiat"], row["max_fiat"]) == (2000, 10, 10)


def cut(spark, packets, block_rows):
    rows, key = flows.keyed_rows(frame(spark, packets), block_rows)
    rows = rows.withColumns({"symbol": tcp.symbol(), "has_data": F.col("len") > F.col("hlen")})
    return tcp.pieces(rows, flows.key_blocks(rows, key, block_rows), key, block_rows), key


def test_pieces_follow_a_keys_own_count(spark):
    lasting = [tcp_packet(1000 * i, i, 16) for i in range(60)]
    hot = [packet(7 * i + 1, i, proto=6, flags=16, prhlen=20, client=("10.0.0.8", 1)) for i in range(2000)]
    cutted, key = cut(spark, lasting + hot, 100)
    by = {r["k_ip1"]: r for r in cutted.groupBy("k_ip1").agg(
        F.count_distinct("piece").alias("pieces"), F.count_distinct("block").alias("blocks"), F.max("several").alias("several")).collect()}
    # The lasting key has a row in each of 60 blocks, and one piece; the hot one has pieces of 100 to 200 rows.
    assert (by["10.0.0.1"]["pieces"], by["10.0.0.1"]["blocks"], by["10.0.0.1"]["several"]) == (1, 60, False)
    sizes = [r["count"] for r in cutted.where("several").groupBy("piece").count().collect()]
    assert by["10.0.0.2"]["several"] and sum(sizes) == 2000 and max(sizes) <= 200 and len(sizes) >= 10
    states = tcp.start_states(cutted, key, flows.FLOW_TIMEOUT_US).collect()
    assert {r.k_ip2 for r in states} == {"10.0.0.8"} and len(states) == len(sizes)


@pytest.mark.parametrize("closing", [16, 4])
def test_a_clock_far_ahead_does_not_stop_the_cutting(spark, closing):
    """One packet from the far future, which either stays the newest of its flow or closes it."""
    talk = []
    for i in range(60):
        talk += [(10 * i, 2, True), (10 * i + 1, 18, False), (10 * i + 2, 16, True), (10 * i + 3, 24, True), (10 * i + 4, 17, True),
                 (10 * i + 5, 16, False), (10 * i + 6, 17, False), (10 * i + 7, 16, True)]
    packets = [tcp_packet(i, 1_000 * ts, flags, forward) for i, (ts, flags, forward) in enumerate(talk)]
    ahead = packet(len(packets), 10**12, proto=6, flags=closing, prhlen=20)
    more = [(p[0] + len(packets) + 1, p[1] + 700_000, *p[2:]) for p in packets]
    packets = [*packets, ahead, *more]
    assert by_spark(spark, packets, tcp_close=True, block_rows=20) == by_sql(packets, tcp_close=True)
    cutted, key = cut(spark, packets, 20)
    later = tcp.start_states(cutted, key, flows.FLOW_TIMEOUT_US).where(F.col("piece") > 30).count()
    assert later > 10


def follow(packets, mode, last, timeout):
    for ts, symbol in packets:
        mode, last, _ = tcp.step(mode, last, ts, symbol, timeout)
    return mode, last


@pytest.mark.parametrize("seed", range(5))
def test_summaries_answer_for_every_state_handed_over(seed):
    rng = random.Random(seed)
    for _ in range(150):
        clock, packets = 0, []
        for _ in range(rng.randint(1, 25)):
            clock += rng.choice([0, 0, 1, 5, 50, 600, 601, 700])
            ts = clock + rng.choice([0, 0, 0, 0, -3, -60, -700, rng.choice([0, 2000])])
            packets.append((ts, 64 * rng.randrange(2) + rng.choice([2, 18, 16, 16, 16, 24, 17, 4, 0])))
        newest = rng.choice([-10, 0, 40, 800, 3000, 10**9])
        piece = tcp.Piece(newest, 600)
        for p in packets:
            piece.add(*p)
        summary = tuple(piece.summary())
        for _ in range(40):
            mode = rng.randrange(tcp.MODES)
            last = min(newest, rng.choice([t for t, _ in packets] + [rng.randint(-800, 3000)]) + rng.choice([0, 1, -1, -600, -601]))
            want, got = follow(packets, mode, last, 600), tcp.after_piece(mode, last, summary, 600)
            assert got == want or got[0] == want[0] == tcp.NO_FLOW


def test_summaries_stay_small_under_a_clock_far_ahead():
    rng = random.Random(1)
    piece = tcp.Piece(10**12, 600)
    for i in range(20_000):
        piece.add(i, 64 * rng.randrange(2) + rng.choice([16, 24, 16, 24, 17, 2, 18]))
    assert len(piece._runs) < 200 and len(piece._states) <= 2 * tcp.MODES


def test_schema_sizes():
    assert len(schemas.PACKET_COLUMNS) == 26 and len(schemas.AGG_FLOW.feature_cols) == 24
    assert len(schemas.STATS_FLOW.names) == 46 and len(schemas.STATS_FLOW.feature_cols) == 40


def streamed(spark, packets, size, block_rows=flows.BLOCK_ROWS, again=False):
    """Flows of a stream of micro-batches of ``size`` packets."""
    found = batches.FlowStream(spark, scratch_dir(spark, "flows"), delay_us=10**15, block_rows=block_rows)
    for i in range(0, len(packets), size):
        found(frame(spark, packets[i:i + size]), i // size)
        if again:  # as after a failure
            found(frame(spark, packets[i:i + size]), i // size)
    names = [*FEATURES, "end_reason", "valid"]
    return sorted(str(tuple(r)) for df in (found.finished(), found.still_open()) for r in df.select(*names).collect())


@pytest.mark.parametrize("seed, size, block_rows", [(0, 90, 1 << 20), (1, 130, 7)])
def test_micro_batches_give_the_flows_of_the_batch(spark, seed, size, block_rows):
    packets = random_packets(seed)
    assert streamed(spark, packets, size, block_rows, again=seed == 0) == by_sql(packets, tcp_close=True)


def test_nulls_are_the_same_in_micro_batches(spark):
    def hidden(p):
        source = None if p[2] == "10.0.0.1" and p[0] % 2 else p[2]
        return (*p[:2], source, p[3], *((None, None) if p[2] == "10.0.0.3" else p[4:6]), *p[6:8],
                None if p[0] % 7 == 0 else p[8], p[9], None if p[0] % 3 else p[10], *p[11:])

    packets = [hidden(p) for p in random_packets(21, 120)]
    assert streamed(spark, packets, 60) == by_spark(spark, packets, tcp_close=True)
    # The tracker reads them alike.
    rows = stateful.stream_rows(frame(spark, packets)).orderBy("seq").collect()
    open_now, out = {}, []
    for r in rows:
        key, p = tuple(r[:6]), {c: r[c] for c in stateful.PACKET_FIELDS}
        flow = open_now.get(key)
        event = tcp.JOINS if flow is None else stateful.add_packet(flow, key[4] == 6, p, flows.FLOW_TIMEOUT_US, flows.IDLE_US)
        if flow is None or event == tcp.STARTS:
            out += [stateful.flow_record(key, flow, "timeout")] if flow else []
            open_now[key] = stateful.open_flow(key[4] == 6, p)
        elif event == tcp.CLOSES:
            out.append(stateful.flow_record(key, open_now.pop(key), "tcp_closed"))
    out += [stateful.flow_record(k, f, "open") for k, f in open_now.items()]
    got = sorted(str(tuple(r[c] for c in (*FEATURES, "end_reason", "valid"))) for r in out)
    assert got == by_spark(spark, packets, tcp_close=True)


def test_idle_flows_leave_with_the_watermark(spark):
    found = batches.FlowStream(spark, scratch_dir(spark, "flows"), delay_us=1_000_000)
    found(frame(spark, [packet(0, 0), packet(1, 5, client=("10.0.0.7", 1))]), 0)
    found(frame(spark, [packet(2, 700_000_000)]), 1)
    assert [(r.srcip, r.end_reason) for r in found.finished().orderBy("flow_seq").collect()] == [
        ("10.0.0.1", "timeout"), ("10.0.0.7", "timeout")]
    assert [r.flow_seq for r in found.still_open().collect()] == [2]
    # A packet older than the watermark is dropped, an empty micro-batch changes nothing.
    found(frame(spark, [packet(3, 10, client=("10.0.0.9", 1))]), 2)
    found(frame(spark, []), 3)
    assert found.still_open().count() == 1 and found.finished().count() == 2


@pytest.mark.parametrize("options", [{}, {"tcp_close": True}, {"window_us": flows.CAPTURE_US}])
def test_tasks_get_no_more_rows_when_tables_grow(spark, monkeypatch, options):
    draw = random.Random(7)
    core = frame(spark, [packet(
        i, i * 300_000, draw.random() < 0.5, draw.choice((6, 17)), draw.randrange(40, 900), flags=draw.choice((2, 16, 17, 18)),
        client=(f"10.0.0.{draw.randrange(9)}", 5000)) for i in range(300)])
    found = lambda: flows.flow_table(core, block_rows=64, **options)
    whole = sorted(map(str, found().collect()))
    monkeypatch.setattr(flows, "TASK_ROWS", 20)
    assert found().rdd.getNumPartitions() == 15
    assert sorted(map(str, found().collect())) == whole


class _State:
    """The state of one key, with its timers."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_a_key_without_a_finished_flow_gives_no_batch():
    # A frame for every key, mostly an empty one, cost more than its packets.
    key = ("10.0.0.1", 1025, "192.168.0.1", 80, 17, 0)
    packet = lambda seq, ts: (*key, seq, ts, seq % 2, 100, 28, 0, 0, None)
    tracker, state = stateful.FlowTracker(1_000_000, 1_000, True), _State()
    tracker.init(state)
    assert list(tracker.handleInputRows(key, iter([packet(2, 500), packet(1, 100)]), None)) == []
    assert len(state.timers) == 1
    ended = list(tracker.handleInputRows(key, iter([packet(3, 2_000_000)]), None))
    assert [(r.flow_seq, r.last_ts, r.total_fpackets, r.total_bpackets, r.end_reason, r.valid) for r in ended] == [
        (1, 500, 1, 1, "timeout", True)]
    assert [(r.flow_seq, r.valid) for r in tracker.handleExpiredTimer(key, None, None)] == [(3, False)]
    assert list(tracker.handleExpiredTimer(key, None, None)) == []


def bursty(seed, n):
    """One key, mostly short bursts of one or a few packets: many without length, gap or duration, so that minima restart
    at different places of a block."""
    rng, ts, out = random.Random(seed), 0, []
    for seq in range(n):
        ts += rng.choice((0, 0, 7, 30, 400_000, 1_000_001, 1_500_000, 2_000_000, 2_000_000, *[700_000_000] * (seq % 97 == 5)))
        out.append(packet(seq, ts, rng.random() < 0.6, size=rng.choice((0, 40, 60, 90, 1500)), dscp=rng.choice((0, 0, 8))))
    return out


@pytest.mark.parametrize("seed, block_rows", [(1, 10), (2, 23), (3, 64), (4, 1000)])
def test_bursts_inside_a_block_are_merged_before_the_walk(spark, seed, block_rows):
    packets = bursty(seed, 300)
    assert by_spark(spark, packets, block_rows=block_rows) == by_sql(packets)
    rows, key = flows.keyed_rows(frame(spark, packets), block_rows)
    marked = flows.mark_runs(flows.mark_gaps(rows, key, flows.FLOW_TIMEOUT_US, flows.IDLE_US, flows.key_blocks(rows, key)), key)
    segs = flows.segments(marked, key, keep_end=True).cache()
    merged = flows.merge_inside(segs, key).cache()
    # Of each flow in a block one row, besides the bursts that continue the block before or end this one.
    touching = segs.where("l_flow IS NULL OR last_seq = block_end").count()
    inside = segs.where("l_flow IS NOT NULL AND last_seq < block_end")
    assert merged.count() == touching + inside.select("block", "l_flow").distinct().count() < segs.count()
    assert merged.agg(F.sum("p_active_n")).first()[0] == inside.count()


def test_connections_over_block_edges_keep_their_flow(spark, tmp_path):
    # Blocks are 1,048,576 sequence numbers long: the first flow begins before an edge, the second has no packet of its own block.
    names = "event_id long, ts string, user_id long, event_type string, value double, props string"
    at = [(1 << 20) - 2, (1 << 20) - 1, 1 << 20, (1 << 20) + 1, (1 << 21) + 5, (1 << 21) + 6]
    day = "2024-01-{:02d} 00:00:00"
    rows = [(seq, day.format(d), user, "view", 0.5, None)
            for user, shift in ((3, 0), (4, 10)) for seq, d in zip((s + shift for s in at), (1, 1, 1, 1, 1, 20), strict=True)]
    spark.createDataFrame(rows, names).withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    found = entry.queries()["flw4_tcp_state"](spark, str(tmp_path))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        expected = con.execute(entry.oracle_sql()["flw4_tcp_state"]).fetchall()
    assert len(expected) == 12
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)


@pytest.mark.parametrize("proto", [6, 17])
def test_a_key_of_few_rows_is_one_block_of_a_micro_batch(spark, proto):
    # Others come between: its sequence numbers lie in 60 blocks. All gaps but the last end a burst.
    lasting = [packet(1000 * i, 2_000_000 * min(i, 58), proto=proto, flags=16, prhlen=20) for i in range(60)]
    settled, key = batches.resume(frame(spark, lasting), None, block_rows=100)
    rows = sorted(settled.collect(), key=lambda r: r["first_ts"])
    assert [(r["s0_n"], r["p_active_n"]) for r in rows] == [(58, 58), (2, None)]
    (row,) = batches.open_flows(batches.held_state(settled, key), key).collect()
    assert (row["total_fpackets"], row["max_idle"], row["mean_active"]) == (60, 2_000_000, 0)
