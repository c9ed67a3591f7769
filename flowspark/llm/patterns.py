"""Packing by patterns: how often each mix of few lengths is used comes from non-negative least squares."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.common import map_rows, text_of, written
from flowspark.llm.encoders import word_encoder

WINDOW = 4096
#: Patterns are enumerated over so many classes of lengths, of at most so many documents each.
CLASSES, PATTERN_DOCS = 64, 5
#: Short documents fit in anywhere, so that a misfit of theirs costs less than one of long ones.
SHORT, SHORT_WEIGHT = 1 / 16, 0.09
#: Rows that are numbered together.
PART_ROWS = 1 << 18
#: Texts that are encoded together.
ENCODED = 256


def patterns(classes: int = CLASSES, most: int = PATTERN_DOCS) -> np.ndarray:
    """Every way to fill ``classes`` units by 1 to ``most`` documents of 1 to ``classes`` units: rows of
    falling sizes, 0 where there are fewer documents."""
    rows: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], left: int) -> None:
        if left == 0:
            rows.append(head + (0,) * (most - len(head)))
            return
        slots = most - len(head)
        for size in range(min(left, head[-1] if head else left), 0, -1):
            if size * slots < left:
                break
            extend((*head, size), left - size)

    extend((), classes)
    return np.array(rows, np.int64)


def nnls(rows: np.ndarray, wanted: np.ndarray, weights: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 that makes ``weights * (A x - wanted)`` small in the sense of least squares, where column p of
    A counts the classes in ``rows[p]``. The active-set method: the column with the steepest descent joins,
    and columns that would turn negative leave."""
    n, x = len(wanted), np.zeros(len(rows))
    padded = np.zeros(n + 1)
    target = weights * wanted
    passive: list[int] = []

    def columns(which: list[int]) -> np.ndarray:
        out = np.zeros((n + 1, len(which)))
        for slot in range(rows.shape[1]):
            np.add.at(out, (rows[which, slot], np.arange(len(which))), 1.0)
        return out[1:] * weights[:, None]

    scale = max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(rounds):
        rest = target - (columns(passive) @ x[passive] if passive else 0)
        padded[1:] = weights * rest
        slope = padded[rows].sum(axis=1)
        slope[passive] = 0
        best = int(slope.argmax())
        if slope[best] <= 1e-9 * scale:
            break
        passive.append(best)
        while passive:
            fit = np.linalg.lstsq(columns(passive), target, rcond=None)[0]
            if fit.min() > 0:
                x[passive] = fit
                break
            now = x[passive]
            falling = fit <= 0
            step = (now[falling] / np.maximum(now[falling] - fit[falling], 1e-300)).min()
            x[passive] = np.maximum(now + step * (fit - now), 0)
            gone = {p for p, f in zip(passive, fit, strict=True) if f <= 0 and x[p] <= 1e-9 * scale}
            if not gone:
                gone = {passive[int(fit.argmin())]}
            x[list(gone)] = 0
            passive = [p for p in passive if p not in gone]
        if best not in passive and slope[best] <= 1e-6 * scale:
            break
    return x


class Plan:
    """Which rank of each length goes where: ``runs`` of equal sequences, found from a histogram alone."""

    def __init__(self, histogram: dict[int, int], window: int = WINDOW):
        self.window, self.sequences = window, 0
        self.fitted = 0
        self._left = np.zeros(window + 1, np.int64)
        for length, count in histogram.items():
            self._left[length] = count
        self._given = np.zeros(window + 1, np.int64)
        self._runs: list[tuple[int, int, int, int, int]] = []
        unit = -(-window // CLASSES)
        of = -(-np.arange(window + 1) // unit)
        by_class = np.bincount(of, self._left, CLASSES + 1)[1:]
        ways = patterns()
        weights = np.where(np.arange(1, CLASSES + 1) <= CLASSES * SHORT, SHORT_WEIGHT, 1.0)
        repeats = np.floor(nnls(ways, by_class.astype(float), weights)).astype(np.int64)
        # Long documents first: what is short serves best at the end.
        for p in np.flatnonzero(repeats):
            self._repeat([int(c) for c in ways[p] if c], int(repeats[p]), unit)
        self.fitted = self.sequences
        while self._left.any():
            self._place(self._filled([]), None)

    def _longest(self, most: int, taken: list[int], least: int = 1) -> int:
        """The longest length of ``least`` to ``most`` that is left, beside those taken; 0 if there is none."""
        for length in np.flatnonzero(self._left[least:most + 1])[::-1] + least:
            if self._left[length] > taken.count(int(length)):
                return int(length)
        return 0

    def _filled(self, lengths: list[int]) -> list[int]:
        """With the longest that still fits, again and again."""
        room = self.window - sum(lengths)
        while room and (length := self._longest(room, lengths)):
            lengths.append(length)
            room -= length
        return lengths

    def _repeat(self, classes: list[int], repeats: int, unit: int) -> None:
        """Sequences of a pattern: all but the shortest from their classes, then the longest that fit."""
        while repeats > 0:
            lengths: list[int] = []
            for c in classes[:-1]:
                room = min(c * unit, self.window - sum(lengths))
                length = self._longest(room, lengths, (c - 1) * unit + 1)
                if not length:
                    return
                lengths.append(length)
            repeats -= self._place(self._filled(lengths), repeats)

    def _place(self, lengths: list[int], most: int | None) -> int:
        """Use the same lengths as often as they last, ``most`` times at most."""
        distinct = set(lengths)
        n = int(min(self._left[x] // lengths.count(x) for x in distinct))
        n = n if most is None else min(n, most)
        offset = 0
        for length in lengths:
            self._runs.append((length, int(self._given[length]), self.sequences, offset, n))
            self._given[length] += n
            self._left[length] -= n
            offset += length
        self.sequences += n
        return n

    def table(self) -> np.ndarray:
        """Rows (length, first rank, first sequence, offset), by length and first rank."""
        runs = np.array([r[:4] for r in self._runs], np.int64).reshape(-1, 4)
        return runs[np.lexsort((runs[:, 1], runs[:, 0]))]


def pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of whole texts; what is longer than a window is cut into windows."""

    def start():
        enc, end = word_encoder(tokenizer), np.uint32(end_id).astype("<u4").tobytes()

        def step(ids, texts):
            out = [[] for _ in range(5)]
            for first in range(0, len(ids), ENCODED):
                some = slice(first, first + ENCODED)
                for i, data in zip(ids[some], enc.data(texts[some]), strict=True):
                    data += end
                    for piece, at in enumerate(range(0, len(data), 4 * window)):
                        part = data[at:at + 4 * window]
                        for column, value in zip(out, (i, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            column.append(value)
            return out

        return step

    return map_rows(text_of(docs, id_col, text_col), start,
                    "doc_id long, piece int, start long, length long, ids_crc32 long",
                    {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()})


def pattern_pack(
    docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pack whole texts into few sequences of at most ``window`` tokens; a row per piece.

    Returns doc_id, piece, start, length, ids_crc32 (of the piece's ids as little-endian 32-bit numbers),
    sequence_id and offset. Only documents longer than a window are cut.

    The histogram of lengths, at most ``window`` numbers whatever the table holds, is all the driver sees.
    Patterns of up to five documents that fill a window are enumerated over 64 classes of lengths; how
    often each is used is fitted to the histogram by non-negative least squares and rounded down. A
    pattern's repeats take the longest documents left in its classes, and what fits best as the last one;
    residuals are packed by the longest that fits. Equal sequences are one run, so the plan has a few
    runs per length. Documents of a length are numbered in parts of bounded size, shifted by the counts of the parts
    before, and find their place by their number.

    Null or empty texts are the closing id alone; null ids are kept; rows repeating an id are packed one by one; other
    columns are ignored. An empty table gives no rows.
    """
    cut = written(pieces(docs, tokenizer, window, end_id, id_col, text_col), "pieces")
    parts = max(1, -(-cut.count() // PART_ROWS))
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    sizes = written(dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = Plan(histogram, window).table()

    before = sizes.withColumn("before", F.sum("n").over(
        Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(own)).join(
        before.select("length", "part", F.coalesce("before", F.lit(0)).alias("before")), ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") - 1 + F.col("before")).cast("long").alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Lengths and ranks as one number; both are exact in 64 bits.
        most = 1 << 48
        keys = runs[:, 0] * most + runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length * most + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(runs[at, 2] + rank - runs[at, 1]), pa.array(runs[at, 3])],
                [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
