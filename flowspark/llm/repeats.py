"""Repeated passages: winnowed anchors as seeds, extended to windows, joined to maximal repeats."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm import exchange, golomb
from flowspark.llm.common import slices, text_of, written
from flowspark.llm.minhash import WordHashes, shingles

#: Words of a window (the length threshold) and of an anchor.
WINDOW, ANCHOR = 13, 5
#: Windows' keys: two different windows of n fall together with chance n / 2^63.
WINDOW_BITS = 63
#: A block of the exchange closes at so many keys, some hundred bytes each while it is sorted and sent.
BLOCK_KEYS = 1 << 19
#: Keys an owner holds on average, some hundred bytes each while it answers.
OWNER_KEYS = 1 << 20
#: Bytes of text for each anchor: about a fifth of the words begin one.
ANCHOR_BYTES = 25


def anchors(hashes: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """For each window of words the key and place of its anchor: the run of ``anchor`` words in it with the
    least hash, the first of equals. Equal windows have equal anchors, wherever they stand."""
    if len(hashes) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = shingles(hashes, anchor)
    view = np.lib.stride_tricks.sliding_window_view(grams, window - anchor + 1)
    at = view.argmin(axis=1) + np.arange(len(view))
    return grams[at] >> np.uint64(64 - exchange.KEY_BITS), at


def _anchor_cells(texts: DataFrame, owners: int, window: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, block = WordHashes(), exchange.Block(owners, exchange.KEY_BITS)
        for batch in slices(batches):
            for i, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                keys = np.unique(anchors(hashes(text.encode().split()), window, anchor)[0])
                if len(keys):
                    block.add(keys, i, 0, np.zeros(len(keys), np.int64))
                if block.size >= BLOCK_KEYS:
                    yield block.flush()
        if block.size:
            yield block.flush()

    return texts.mapInArrow(run, exchange.CELL)


def _by(ids: np.ndarray, values: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """A row per id with its values, as bytes."""
    order = np.argsort(ids, kind="stable")
    distinct, first = np.unique(ids[order], return_index=True)
    parts = np.split(values[order], first[1:]) if len(distinct) else []
    return pa.RecordBatch.from_arrays(
        [pa.array(distinct, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names)


def _seeds(cells: DataFrame, owners: int) -> DataFrame:
    """(id, keys): the anchors a document shares with another, as little-endian 64-bit numbers, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for r in batch.to_pylist():
                runs = np.frombuffer(r["runs"], np.uint32)
                of = np.frombuffer(r["rows"], np.int64)[:int(runs.sum())]
                # Ids are sorted within a key: several documents if the last differs from the least.
                last = of[np.cumsum(runs) - 1]
                shared = golomb.unpack(r["bits"], r["n"]) | (last > np.frombuffer(r["least"], np.int64))
                code = golomb.decode(r["code"], r["n"], r["k"], exchange.owner_base(r["owner"], owners))
                here = np.repeat(shared, runs)
                ids.append(of[here])
                keys.append(np.repeat(code, runs)[here])
            yield _by(np.concatenate(ids), np.concatenate(keys), ["id", "keys"])

    return cells.mapInArrow(run, "id long, keys binary")


def _candidates(texts: DataFrame, seeds: DataFrame, window: int, anchor: int) -> DataFrame:
    """Rows with their candidate windows: (row, id, text, starts); text and starts are null without any, and
    n_words and digest are set then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, row = WordHashes(), TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            out = []
            for i, text, parts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words, starts = text.encode().split(), None
                if parts:
                    keys, _ = anchors(hashes(words), window, anchor)
                    starts = np.flatnonzero(np.isin(keys, np.frombuffer(b"".join(parts), np.uint64)))
                some = starts is not None and len(starts) > 0
                out.append({
                    "row": row, "id": i, "text": text if some else None,
                    "starts": starts.astype(np.int32).tobytes() if some else None, "n_words": len(words),
                    "digest": None if some else sha256(b" ".join(words)).hexdigest(),
                })
                row += 1
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("text", pa.string()), ("starts", pa.binary()),
                        ("n_words", pa.int64()), ("digest", pa.string())])
    gathered = seeds.groupBy("id").agg(F.collect_list("keys").alias("parts"))
    return texts.join(gathered, "id", "left").select("id", "text", "parts").mapInArrow(
        run, "row long, id long, text string, starts binary, n_words long, digest string")


def _window_cells(candidates: DataFrame, owners: int, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, block = WordHashes(), exchange.Block(owners, WINDOW_BITS)
        for batch in slices(batches):
            for row, i, text, starts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                starts = np.frombuffer(starts, np.int32)
                keys = shingles(hashes(text.encode().split()), window)[starts] >> np.uint64(64 - WINDOW_BITS)
                block.add(keys, i, row, starts)
                if block.size >= BLOCK_KEYS:
                    yield block.flush()
        if block.size:
            yield block.flush()

    return candidates.select("row", "id", "text", "starts").mapInArrow(run, exchange.CELL)


def _covered(cells: DataFrame) -> DataFrame:
    """(row, starts): windows that also start in a document with a smaller id, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for r in batch.to_pylist():
                runs = np.frombuffer(r["runs"], np.uint32)
                ids, rows = np.frombuffer(r["rows"], np.int64).reshape(2, -1)
                elsewhere = np.repeat(golomb.unpack(r["bits"], r["n"]), runs)
                gone = elsewhere | (ids > np.repeat(np.frombuffer(r["least"], np.int64), runs))
                found.append(rows[gone])
                places.append(np.frombuffer(r["places"], np.int32)[gone])
            yield _by(np.concatenate(found), np.concatenate(places), ["row", "starts"])

    return cells.mapInArrow(run, "row long, starts binary")


def spans_of(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal runs of words covered by windows, (from, to), to exclusive."""
    starts = np.sort(starts)
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > window) + 1
    return [(int(s[0]), int(s[-1]) + window) for s in np.split(starts, cut)]


def repeats(
    docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Passages of at least ``window`` words that also stand in a document with a smaller id.

    Returns one row per row: doc_id, n_words, n_removed, spans (maximal runs of repeated words, from and to,
    to exclusive) and kept_sha256 of the other words, joined by blanks. Words are parts between white
    space, unchanged; windows are judged on the input.

    Seeds: every window has a winnowed anchor, a run of ``anchor`` words; documents exchange their anchors'
    sorted keys, Golomb coded, and learn which ones another document has, too. Extension: in documents
    with such seeds each window around a shared anchor is a candidate, on both sides as far as anchors go
    on being shared. Candidates exchange a key of all their words together with their least id, and
    windows held by a smaller id are joined to maximal spans. A key crosses the exchange once per block,
    however many documents hold it. All texts are shuffled once, to their seeds; those with candidates
    are stored and shuffled once more.

    Null texts have no words; texts below ``window`` words lose nothing. Rows without an id neither lose
    words nor count. Rows repeating an id are one document. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = text_of(docs, id_col, text_col).withColumn("id", F.col("id").cast("long"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    owners = exchange.owners_for(spark, size // ANCHOR_BYTES, OWNER_KEYS)
    cells = written(_anchor_cells(texts.where(F.col("id").isNotNull()), owners, window, anchor), "anchors")
    seeds = _seeds(exchange.with_bits(cells, owners, exchange.KEY_BITS, False), owners)
    found = written(_candidates(texts, seeds, window, anchor), "candidates")
    some = found.where(F.col("starts").isNotNull())
    # Every word of a copy may begin a window, so there may be many more of these than of anchors.
    windows = some.agg(F.sum(F.length("starts"))).first()[0] or 0
    owners = exchange.owners_for(spark, windows // 4, OWNER_KEYS)
    cells = written(_window_cells(some, owners, window), "windows")
    covered = _covered(exchange.with_bits(cells, owners, WINDOW_BITS, True)).groupBy("row").agg(
        F.collect_list("starts").alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for i, text, parts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = text.encode().split()
                spans = spans_of(np.frombuffer(b"".join(parts or []), np.int32).astype(np.int64), window)
                kept, at = [], 0
                for a, b in spans:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                out.append({"doc_id": i, "n_words": len(words), "n_removed": len(words) - len(kept),
                            "spans": [{"from": a, "to": b} for a, b in spans],
                            "kept_sha256": sha256(b" ".join(kept)).hexdigest()})
            yield pa.RecordBatch.from_pylist(out, schema)

    span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", span),
                        ("kept_sha256", pa.string())])
    kind = "array<struct<`from`: long, `to`: long>>"
    changed = some.select("row", "id", "text").join(covered, "row", "left").select("id", "text", "parts").mapInArrow(
        run, f"doc_id long, n_words long, n_removed long, spans {kind}, kept_sha256 string")
    same = found.where(F.col("starts").isNull()).select(
        F.col("id").alias("doc_id"), "n_words", F.lit(0).cast("long").alias("n_removed"),
        F.array().cast(kind).alias("spans"), F.col("digest").alias("kept_sha256"))
    return changed.unionByName(same)
