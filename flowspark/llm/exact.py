"""Exact duplicates by an exchange of Golomb-coded fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm import exchange, golomb
from flowspark.llm.common import SPACE, checked_broadcast, join_hot, text_of, written

BLOCK_ROWS = 1 << 18
_CELL = ("block long, owner int, n int, k int, code binary, ids binary, digests binary, runs binary")


def normalised(text):
    return F.regexp_replace(text, f"[{SPACE}]+", " ")


def _publish(docs: DataFrame, owners: int, block_rows: int) -> DataFrame:
    """One row per block and owner: the coded keys, and in their order the ids and digests of the
    rows behind each key (``runs`` of them). A digest is followed by a byte that says whether there is an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, blocks, held = TaskContext.get().partitionId(), 0, []

        def flush():
            ids = np.concatenate([h[0] for h in held])
            digests = np.concatenate([np.frombuffer(b"".join(h[1] for h in held), np.uint8).reshape(-1, 32),
                                      np.concatenate([h[2] for h in held])[:, None]], axis=1)
            keys = digests[:, :6].astype(np.uint64) @ (np.uint64(1) << np.arange(40, -1, -8, dtype=np.uint64))
            order = np.argsort(keys, kind="stable")
            distinct, first, runs = np.unique(keys[order], return_index=True, return_counts=True)
            first = np.append(first, len(order))
            rows = []
            for owner, a, b, k, code in exchange.cells(distinct, owners):
                here = order[first[a]:first[b]]
                rows.append({
                    "block": (task << 24) + blocks, "owner": owner, "n": b - a, "k": k, "code": code,
                    "ids": ids[here].tobytes(), "digests": digests[here].tobytes(),
                    "runs": runs[a:b].astype(np.uint32).tobytes(),
                })
            return pa.RecordBatch.from_pylist(rows, schema)

        for batch in batches:
            if batch.num_rows:
                ids = batch.column(0)
                held.append((ids.fill_null(0).to_numpy(), b"".join(batch.column(1).to_pylist()),
                             ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)))
            if sum(len(h[0]) for h in held) >= block_rows:
                yield flush()
                held.clear()
                blocks += 1
        if held:
            yield flush()

    schema = pa.schema([("block", pa.int64()), ("owner", pa.int32()), ("n", pa.int32()), ("k", pa.int32()),
                        *[(c, pa.binary()) for c in ("code", "ids", "digests", "runs")]])
    return docs.mapInArrow(run, _CELL)


def _marked(cells: DataFrame) -> DataFrame:
    """(id, digest, suspect) of every row, from cells with the owners' bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                runs = np.frombuffer(row["runs"], np.uint32)
                suspect = golomb.unpack(row["bits"], row["n"]) | (runs > 1)
                digests = row["digests"]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.frombuffer(row["ids"], np.int64), mask=np.frombuffer(digests, np.uint8)[32::33] == 0),
                    pa.array([digests[i:i + 32] for i in range(0, len(digests), 33)], pa.binary()),
                    pa.array(np.repeat(suspect, runs)),
                ], ["id", "digest", "suspect"])

    return cells.mapInArrow(run, "id long, digest binary, suspect boolean")


def exact_duplicates(
    docs: DataFrame, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Groups of texts that are identical after replacing each run of white space by one blank.

    Returns one row per input row: doc_id, keep_id (the least id of the group), group_size, kept,
    text_sha256 of the normalised text.

    Blocks of an input partition send their sorted fingerprints (48 bits of the digest), coded, to
    owners and get duplicate bitmaps back; only texts with a marked fingerprint are shuffled, grouped
    by their own bytes and combined before the shuffle, so a hot text moves once per task. Suspect ids
    are broadcast if their counted size is small, else joined by a shuffle.

    A null text is empty; empty texts are equal. Rows without an id count in their group and are returned; keep_id is
    the least id there is (null if none), and whether they are kept is unknown (null).
    Rows repeating an id count as rows of their own; both stay if theirs is the least id. Other columns
    are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = text_of(docs, id_col, text_col).select(
        F.col("id").cast("long").alias("id"), normalised(F.col("text")).alias("norm"))
    digest = F.unhex(F.sha2("norm", 256))
    owners = exchange.owners_for(spark, docs.count())
    cells = written(_publish(texts.select("id", digest.alias("digest")), owners, block_rows), "fingerprints")
    bits = exchange.answers(cells, owners)
    marked = written(_marked(cells.join(bits, ["block", "owner"]).select("n", "ids", "digests", "runs", "bits")),
                     "marked")
    suspects = marked.where("suspect").select("id")
    size = marked.where("suspect").count()
    side = checked_broadcast(suspects.where("id IS NOT NULL"), size, 16)
    # Rows without an id are few or all alike; those that are no suspects are alone in their group.
    named = texts.where("id IS NOT NULL").join(side, "id", "left_semi").unionByName(texts.where("id IS NULL"))
    groups = written(
        named.groupBy(digest.alias("digest"), "norm")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("digest", "keep_id", "group_size"), "groups")
    alone = marked.where(~F.col("suspect")).select(
        "id", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    members = join_hot(marked.where("suspect").select("id", "digest"), groups, ["digest"], "group_size", size).select(
        "id", "digest", "keep_id", "group_size")
    return alone.unionByName(members).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("id") == F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
