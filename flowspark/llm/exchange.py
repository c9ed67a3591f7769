"""Exchange of compressed keys: which keys of a block occur in other blocks, too?

A block is a run of one input partition's rows, of bounded size. It sends its sorted distinct keys
to their owners, Golomb coded; an owner answers each block with a bitmap over the keys it sent. A
key that fills a third of all rows is sent once per block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm import golomb
from flowspark.llm.common import checked_broadcast, shuffle_partitions, written

#: Bits of a key. Two different keys of n fall together with chance n / 2^48, which later checks undo.
KEY_BITS = 48
#: Keys an owner holds at most, on average.
OWNER_KEYS = 1 << 22
MOST_OWNERS = 1 << 15
#: A block closes at so many keys.
BLOCK_KEYS = 1 << 20
#: What a block sends to an owner, and keeps: the coded keys, the least id of each, and by key the ids, rows
#: and places behind it (``runs`` of them).
CELL = "block long, owner int, n int, k int, code binary, least binary, runs binary, rows binary, places binary"
_CELL_SCHEMA = pa.schema([("block", pa.int64()), ("owner", pa.int32()), ("n", pa.int32()), ("k", pa.int32()),
                          *[(c, pa.binary()) for c in ("code", "least", "runs", "rows", "places")]])


def owners_for(spark: SparkSession, keys: int, held: int = OWNER_KEYS) -> int:
    return min(MOST_OWNERS, max(shuffle_partitions(spark), -(-keys // held)))


def owner_base(owner: int, owners: int, bits: int = KEY_BITS) -> int:
    """The least key of an owner."""
    return -(-(owner << bits) // owners)


def cells(keys: np.ndarray, owners: int, bits: int = KEY_BITS):
    """Cut sorted distinct keys into (owner, from, to, k, code)."""
    bases = np.array([owner_base(o, owners, bits) for o in range(owners + 1)], np.uint64)
    cuts = np.searchsorted(keys, bases)
    for owner in np.flatnonzero(np.diff(cuts)):
        a, b = int(cuts[owner]), int(cuts[owner + 1])
        k, code = golomb.encode(keys[a:b], int(bases[owner]))
        yield int(owner), a, b, k, code


def answers(sent: DataFrame, owners: int, bits: int = KEY_BITS, least: bool = False) -> DataFrame:
    """From rows (block, owner, n, k, code): (block, owner, bits), a bit for each key that another block
    sent as well. With ``least`` the rows also hold the least id the block has for each key (int64),
    and the bit says that another block has a smaller one."""

    def own(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        base = owner_base(rows[0]["owner"], owners, bits)
        keys = np.concatenate([golomb.decode(r["code"], r["n"], r["k"], base) for r in rows])
        if least:
            ids = np.concatenate([np.frombuffer(r["least"], np.int64) for r in rows])
            order = np.lexsort((ids, keys))
            first = np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]) != 0)
            smallest = np.repeat(ids[order[first]], np.diff(np.append(first, len(order))))
            flags = np.empty(len(keys), bool)
            flags[order] = ids[order] > smallest
        else:
            every = np.sort(keys)
            flags = np.isin(keys, every[1:][every[1:] == every[:-1]])
        cuts = np.cumsum([0, *(r["n"] for r in rows)])
        return pa.table({
            "block": pa.array([r["block"] for r in rows], pa.int64()),
            "owner": pa.array([r["owner"] for r in rows], pa.int32()),
            "bits": pa.array([golomb.pack(flags[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()),
        })

    columns = ["block", "owner", "n", "k", "code", *["least"] * least]
    return sent.select(*columns).groupBy("owner").applyInArrow(own, "block long, owner int, bits binary")


class Block:
    """Keys of a run of rows, until they are sent: (key, id, row, place) arrays. Without ``places``, only the
    ids behind each key are kept."""

    def __init__(self, owners: int, bits: int, places: bool = True):
        self._owners, self._bits, self._held, self.size, self._sent = owners, bits, [], 0, 0
        self._places = places
        self._task = TaskContext.get().partitionId()

    def add(self, keys: np.ndarray, doc: int, row: int, places: np.ndarray) -> None:
        self._held.append((keys, np.full(len(keys), doc), np.full(len(keys), row), places))
        self.size += len(keys)

    def flush(self) -> pa.RecordBatch:
        keys, ids, rows, places = (np.concatenate(x) for x in zip(*self._held, strict=True))
        self._held, self.size = [], 0
        order = np.lexsort((ids, keys))
        keys, ids, rows, places = keys[order], ids[order], rows[order], places[order]
        distinct, first, runs = np.unique(keys, return_index=True, return_counts=True)
        ends, out = np.append(first, len(keys)), []
        for owner, a, b, k, code in cells(distinct, self._owners, self._bits):
            here = slice(int(ends[a]), int(ends[b]))
            out.append({
                "block": (self._task << 24) + self._sent, "owner": owner, "n": b - a, "k": k, "code": code,
                "least": ids[first[a:b]].astype(np.int64).tobytes(), "runs": runs[a:b].astype(np.uint32).tobytes(),
                "rows": (np.stack([ids[here], rows[here]]) if self._places else ids[here]).astype(np.int64).tobytes(),
                "places": places[here].astype(np.int32).tobytes() if self._places else None,
            })
        self._sent += 1
        return pa.RecordBatch.from_pylist(out, _CELL_SCHEMA)


def with_bits(sent: DataFrame, owners: int, bits: int, least: bool) -> DataFrame:
    """The cells with their owners' answers: small answers go to the cells, others meet them in a shuffle."""
    answered = written(answers(sent, owners, bits, least), "answers")
    size = answered.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("bits")).alias("bytes")).first()
    return sent.join(checked_broadcast(answered, size["n"] * 48 + (size["bytes"] or 0), 1), ["block", "owner"])
