"""TCP connection tracking: where flows end because the connection closed.

The end of a flow depends on every packet before it, so packets of a key are folded in order. The
fold streams over sorted partitions in constant memory. A key with more rows than a block is cut
into pieces of its own rows that fold in parallel: connection tracking is a finite automaton, so a
piece can be summarised as "start state -> end state" for all start states, the summaries are
chained along the key (one row per piece), and each piece is then folded from its true start state.

A state is a mode and the time of the last packet, and packets older than that are late. Cuts fall
anywhere, also behind a packet whose clock is far ahead: a summary answers for every time that may be handed
over (see ``Piece``).
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.operators.flows import ACK, FIN, HELD, RST, SYN

# The connection states of either side.
STATES = ("start", "syn", "synack", "established", "fin", "closed")
START, SYN_SEEN, SYNACK, ESTABLISHED, FIN_SEEN, CLOSED = range(6)

NO_FLOW = 0  # mode 0: no open flow; otherwise 1 + 36 * first side + 6 * client state + server state
MODES = 1 + 2 * 36
SYMBOLS = 2 * 64  # 64 * side + flags
LATE, STARTS, JOINS, CLOSES = range(4)


def next_state(state: int, flags: int, own: bool) -> int:
    """State of one side after a packet; ``own`` when the packet travels in that side's direction."""
    if flags & RST:
        return CLOSED
    if flags & FIN and own:
        return FIN_SEEN
    if state == START and flags & SYN and own:
        return SYN_SEEN
    if state == SYN_SEEN and flags & SYN and flags & ACK and not own:
        return SYNACK
    if state == SYNACK and flags & ACK and own:
        return ESTABLISHED
    if state == FIN_SEEN and flags & ACK and not own:
        return CLOSED
    return state


def mode_of(first_side: int, client: int, server: int) -> int:
    return 1 + 36 * first_side + 6 * client + server


def parts_of(mode: int) -> tuple[int, int, int]:
    first_side, rest = divmod(mode - 1, 36)
    return first_side, rest // 6, rest % 6


def _after(first_side, client, server, symbol):
    side, flags = divmod(symbol, 64)
    forward = side == first_side
    return mode_of(first_side, next_state(client, flags, forward), next_state(server, flags, not forward))


OPENED = [_after(s // 64, START, START, s) for s in range(SYMBOLS)]
NEXT = [None] + [[_after(*parts_of(m), s) for s in range(SYMBOLS)] for m in range(1, MODES)]
SHUT = {mode_of(side, CLOSED, CLOSED) for side in (0, 1)}
TALKING = {m for m in range(1, MODES) if parts_of(m)[1] == ESTABLISHED}


def step(mode: int, last: int, ts: int, symbol: int, timeout_us: int) -> tuple[int, int, int]:
    """One packet: (mode after, time of the last packet after, what happened to the packet)."""
    if mode == NO_FLOW or ts - last > timeout_us:
        return OPENED[symbol], ts, STARTS
    if ts < last:
        return mode, last, LATE
    after = NEXT[mode][symbol]
    if after in SHUT:
        return NO_FLOW, ts, CLOSES
    return after, ts, JOINS


def _heads(batch: pa.RecordBatch, columns: list[str], previous: tuple | None):
    """Indexes at which a new group begins, and the last row's group."""
    n = batch.num_rows
    cols = [batch.column(batch.schema.get_field_index(c)) for c in columns]
    change = None
    for c in cols:
        differs = pc.not_equal(c.slice(1), c.slice(0, n - 1))
        change = differs if change is None else pc.or_(change, differs)
    first = tuple(c[0].as_py() for c in cols)
    heads = [0] if first != previous else []
    heads += [i + 1 for i in pc.indices_nonzero(change).to_pylist()]
    return heads, tuple(c[n - 1].as_py() for c in cols)


def _lists(batch: pa.RecordBatch, *columns: str):
    return [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]


def fold_fn(group: list[str], timeout_us: int, idle_us: int, with_mode: bool = False):
    """mapInArrow function over rows sorted by group and seq; adds the flow marks, drops late rows.

    A group may begin with a row that holds the state handed over to it instead of a packet. ``with_mode`` adds
    the mode after each packet.
    """

    def fold(batches):
        previous, mode, last = None, NO_FLOW, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            heads, previous = _heads(batch, group, previous)
            heads = set(heads)
            keep, gaps, starts, hits, closes, modes = [], [], [], [], [], []
            columns = _lists(batch, "ts_us", "symbol", "has_data", "start_mode", "start_last")
            for i, (ts, symbol, data, start_mode, start_last) in enumerate(zip(*columns)):
                if i in heads:
                    mode, last = NO_FLOW, 0
                if start_mode is not None:
                    mode, last = start_mode, start_last
                    continue
                before, since = mode, ts - last
                mode, last, event = step(mode, last, ts, symbol, timeout_us)
                if event == LATE:
                    continue
                keep.append(i)
                opens = event == STARTS
                starts.append(opens)
                gaps.append(None if opens else since)
                hits.append(data and not opens and before in TALKING)
                closes.append(event == CLOSES)
                modes.append(mode)
            out = batch.take(pa.array(keep, pa.int32())).drop_columns(
                ["symbol", "has_data", "start_mode", "start_last"])
            bools = pa.bool_()
            burst = [o or g > idle_us for o, g in zip(starts, gaps)]
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array(gaps, pa.int64()), pa.array(starts, bools), pa.array(burst, bools),
                 pa.array(hits, bools), pa.array(closes, bools), *[pa.array(modes, pa.int64())] * with_mode],
                names=[*out.schema.names, "gap", "flow_start", "burst_start", "valid_hit", "closes", *["mode"] * with_mode],
            )

    return fold


class Piece:
    """What a piece of a key does to any state handed over to it.

    A state (mode, time of the last packet) is late for packets until one is at least as new. That is a
    packet newer than all before it in the piece, a record. So the outcome depends on the
    mode and on which record the time reaches first, and records with the same outcomes are one run. Times handed over are
    those of earlier packets: once a record is as new as all of them (``newest``), later ones start nothing.

    Whatever has begun is followed as distinct states, equal ones together: at each record all of them
    have the same time, so there are no more than modes. Runs whose outcomes have become equal are merged
    as their number grows, so that a clock that runs far ahead costs time for its key, but neither the cutting nor the memory.
    """

    def __init__(self, newest: int | None, timeout_us: int):
        self._newest, self._timeout = newest, timeout_us
        self.first_ts, self._top = None, None
        self._states: list[tuple[int, int]] = []
        self._start = 0
        self._uppers: list[int] = []
        self._runs: list[list[int]] = []
        self._gaps: list[list[int]] = []
        self._compact_at = 16

    def add(self, ts: int, symbol: int) -> None:
        if self._states:
            self._states = [step(m, at, ts, symbol, self._timeout)[:2] for m, at in self._states]
            if len(set(self._states)) < len(self._states):
                self._join()
        if self.first_ts is None:
            self.first_ts = ts
            self._states = [(OPENED[symbol], ts)]
            self._open(ts, symbol)
        elif ts > self._top:
            if self._newest is not None and self._top < self._newest:
                self._open(ts, symbol)
            self._top = ts

    def _open(self, ts: int, symbol: int) -> None:
        """A record: every mode may begin here."""
        place = {m: i for i, (m, at) in enumerate(self._states) if at == ts}

        def of(mode: int) -> int:
            if mode not in place:
                place[mode] = len(self._states)
                self._states.append((mode, ts))
            return place[mode]

        if self._top is not None and ts - self._top > self._timeout:
            self._gaps.append([self._top, ts, of(OPENED[symbol])])
        # A packet that opens a flow does not close it, whatever its flags.
        run = [of(NO_FLOW if NEXT[m][symbol] in SHUT else NEXT[m][symbol]) for m in range(1, MODES)]
        if self._runs and self._runs[-1] == run:
            self._uppers[-1] = ts
        else:
            self._uppers.append(ts)
            self._runs.append(run)
        self._top = ts
        if len(self._runs) >= self._compact_at:
            self._compact()

    def _join(self) -> None:
        """Equal states become one."""
        place: dict[tuple[int, int], int] = {}
        to = [place.setdefault(s, len(place)) for s in self._states]
        self._states, self._start = list(place), to[self._start]
        self._runs = [[to[i] for i in run] for run in self._runs]
        for gap in self._gaps:
            gap[2] = to[gap[2]]

    def _compact(self) -> None:
        keep = [i for i, run in enumerate(self._runs) if i + 1 == len(self._runs) or run != self._runs[i + 1]]
        self._uppers, self._runs = [self._uppers[i] for i in keep], [self._runs[i] for i in keep]
        self._compact_at = 2 * len(keep) + 16

    def summary(self) -> list:
        self._compact()
        return [self.first_ts, self._start, self._uppers, [i for run in self._runs for i in run],
                *([g[k] for g in self._gaps] for k in range(3)), [m for m, _ in self._states], [at for _, at in self._states]]


#: Columns of a summary, in the order of ``Piece.summary``.
SUMMARY = [("first_ts", T.LongType())] + [("start", T.LongType())] + [
    (c, T.ArrayType(T.LongType())) for c in ("uppers", "picks", "gap_low", "gap_ts", "gap_pick", "modes", "lasts")]


def after_piece(mode: int, last: int, summary: tuple, timeout_us: int) -> tuple[int, int]:
    """The state after a piece that is entered with a state."""
    first_ts, start, uppers, picks, gap_low, gap_ts, gap_pick, modes, lasts = summary
    if mode == NO_FLOW or first_ts - last > timeout_us:
        return modes[start], lasts[start]
    run = bisect_left(uppers, last)
    if run == len(uppers):
        return mode, last  # all of it is late
    gap = bisect_left(gap_ts, last)
    if gap < len(gap_ts) and gap_low[gap] < last < gap_ts[gap] - timeout_us:
        pick = gap_pick[gap]
    else:
        pick = picks[run * (MODES - 1) + mode - 1]
    return modes[pick], lasts[pick]


def summary_fn(group: list[str], schema: pa.Schema, timeout_us: int):
    """mapInArrow function over rows sorted by group and seq: a summary of each piece."""

    def summarise(batches):
        previous, piece = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            done, before = [], previous
            heads, previous = _heads(batch, group, previous)
            heads = set(heads)
            names = _lists(batch, *group)
            for i, (ts, symbol, newest) in enumerate(zip(*_lists(batch, "ts_us", "symbol", "carry_ts"))):
                if i in heads:
                    if piece is not None:
                        done.append([*before, *piece.summary()])
                    before = tuple(c[i] for c in names)
                    piece = Piece(newest, timeout_us)
                piece.add(ts, symbol)
            yield _batch(done, schema)
        if piece is not None:
            yield _batch([[*previous, *piece.summary()]], schema)

    return summarise


def _batch(rows, schema):
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def chain_fn(key: list[str], schema: pa.Schema, timeout_us: int):
    """mapInArrow function over piece summaries sorted along the key: start state of each piece."""

    def chain(batches):
        previous, mode, last = None, NO_FLOW, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            heads, previous = _heads(batch, key, previous)
            heads, out = set(heads), []
            names = _lists(batch, *key, "piece")
            for i, summary in enumerate(zip(*_lists(batch, *[c for c, _ in SUMMARY]))):
                if i in heads:
                    mode, last = NO_FLOW, 0
                if names[-1][i] != HELD:
                    out.append([c[i] for c in names] + [mode, last])
                mode, last = after_piece(mode, last, summary, timeout_us)
            yield _batch(out, schema)

    return chain


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def start_states(rows: DataFrame, key: list[str], timeout_us: int, held: DataFrame | None = None) -> DataFrame:
    """(key, piece) -> state handed over, for every piece of the keys that have several, and for the first piece of
    those that hold a state (key, last_ts, mode) from before."""
    group = [*key, "piece"]
    several = rows.where("several").select(*group, "seq", "ts_us", "symbol", "carry_ts")
    names = [several.schema[c] for c in group]
    summary = T.StructType([*names, *(T.StructField(c, kind) for c, kind in SUMMARY)])
    starts = T.StructType(list(names)).add("start_mode", T.LongType()).add("start_last", T.LongType())
    summaries = (
        several.repartition(*group).sortWithinPartitions(*group, "seq")
        .mapInArrow(summary_fn(group, _arrow_schema(summary), timeout_us), summary)
    )
    if held is not None:
        # A piece of its own that leads to the held state, whatever stood before.
        none = F.array().cast("array<bigint>")
        at = {"first_ts": F.col("last_ts"), "start": F.lit(0).cast("bigint"), "modes": F.array("mode"), "lasts": F.array("last_ts")}
        summaries = summaries.unionByName(held.select(
            *key, F.lit(HELD).cast(rows.schema["piece"].dataType).alias("piece"), *[at.get(c, none).alias(c) for c, _ in SUMMARY]))
    chained = (
        summaries.repartition(*key).sortWithinPartitions(*group)
        .mapInArrow(chain_fn(key, _arrow_schema(starts), timeout_us), starts)
    )
    if held is None:
        return chained
    # The first piece of several gets the same state twice, which changes nothing.
    return chained.unionByName(held.select(
        *key, F.lit(0).cast(rows.schema["piece"].dataType).alias("piece"), F.col("mode").alias("start_mode"), F.col("last_ts").alias("start_last")))


def symbol() -> Column:
    """A packet as the automaton sees it: its side and its six flag bits."""
    return (F.col("side") * 64 + F.col("flags").bitwiseAND(F.lit(63))).cast("bigint")


def pieces(rows: DataFrame, blocks: DataFrame, key: list[str], block_rows: int) -> DataFrame:
    """Add ``piece`` and ``several``, whether the key has more than one. ``blocks`` as from ``flows.key_blocks``: a key of
    ``block_rows`` rows or fewer is one piece, however long it lasts, and is never summarised; others are cut
    after about as many of their own rows."""
    several = F.coalesce(F.col("n_key") > block_rows, F.lit(False))
    return rows.join(blocks, [*key, "block"], "left").withColumns({
        "several": several, "piece": F.when(several, F.expr(f"n_before div {block_rows}")).otherwise(F.lit(0).cast("bigint")),
    }).drop("n_before", "n_key")


def track_connections(
    rows: DataFrame, blocks: DataFrame, key: list[str], timeout_us: int, idle_us: int, block_rows: int,
    held: DataFrame | None = None,
) -> DataFrame:
    """TCP rows with gap, flow_start, burst_start, valid_hit and closes; late rows dropped. Their block is their piece from here
    on: a key of few rows is in one block, however many others come between."""
    group = [*key, "piece"]
    rows = rows.withColumns({"symbol": symbol(), "has_data": F.col("len") > F.col("hlen")})
    rows = pieces(rows, blocks, key, block_rows)
    # States travel among the rows, not by a join: the rows are shuffled once for the fold. A state
    # has no seq, so it sorts before the packets of its piece.
    starts = start_states(rows, key, timeout_us, held)
    rows = rows.drop("several", "carry_ts").unionByName(starts, allowMissingColumns=True)
    dropped = ("symbol", "has_data", "start_mode", "start_last")
    out = T.StructType([f for f in rows.schema.fields if f.name not in dropped])
    out.add("gap", T.LongType())
    for name in ("flow_start", "burst_start", "valid_hit", "closes"):
        out.add(name, T.BooleanType())
    if held is not None:
        out.add("mode", T.LongType())
    return (
        rows.repartition(*group).sortWithinPartitions(*group, "seq")
        .mapInArrow(fold_fn(group, timeout_us, idle_us, held is not None), out)
        .drop("block").withColumnRenamed("piece", "block")
    )
