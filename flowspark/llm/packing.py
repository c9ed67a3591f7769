"""Packing: a window is filled with a document's nearest unused neighbours by BM25."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import shuffle_partitions, text_of
from flowspark.llm.encoders import encoder

WINDOW = 1024
#: A shard of the index holds so many documents or tokens, whichever comes first.
SHARD_DOCS, SHARD_TOKENS = 2048, 1 << 22
#: The usual constants of the score.
K1, B = 1.2, 0.75
#: A term in more than this share of a shard's documents has a dense row; seeds scored at a time.
DENSE, SEEDS = 1 / 8, 32


class Shard:
    """Inverted index over the token ids of a shard's documents: BM25 weights by term and document.

    Postings of rare terms are lists, those of frequent ones dense rows, so that a group of seeds is
    scored for all of its terms by a matrix product and by adding up lists.
    """

    def __init__(self, tokens: list[np.ndarray]):
        lengths = np.array([len(t) for t in tokens], np.float64)
        pairs = [np.unique(t, return_counts=True) for t in tokens]
        terms = np.concatenate([p[0] for p in pairs]).astype(np.int64)
        counts = np.concatenate([p[1] for p in pairs]).astype(np.float64)
        docs = np.repeat(np.arange(len(tokens)), [len(p[0]) for p in pairs])
        order = np.argsort(terms, kind="stable")
        _, first, df = np.unique(terms[order], return_index=True, return_counts=True)
        self._n, self._docs = len(tokens), docs[order]
        idf = np.log1p((self._n - df + 0.5) / (df + 0.5))
        counts, norm = counts[order], K1 * (1 - B + B * lengths / max(1.0, lengths.mean()))
        self._weight = np.repeat(idf, df) * counts * (K1 + 1) / (counts + norm[self._docs])

        dense = df > max(1, self._n * DENSE)
        place = np.cumsum(dense) - 1
        self._dense = np.zeros((int(dense.sum()), self._n))
        of = np.repeat(np.arange(len(df)), df)
        here = dense[of]
        self._dense[place[of[here]], self._docs[here]] = self._weight[here]
        # Each document's terms: rows of the dense part, or starts and lengths of lists that others are in, too.
        term = np.empty(len(order), np.int64)
        term[order] = of
        self._rows, self._lists = [], []
        for own in np.split(term, np.cumsum([len(p[0]) for p in pairs])[:-1]):
            self._rows.append(place[own[dense[own]]])
            rare = own[~dense[own] & (df[own] > 1)]
            self._lists.append((first[rare], df[rare]))

    def scores(self, seeds) -> np.ndarray:
        """BM25 of every document for all terms of each seed: seeds x documents."""
        asked = np.zeros((len(seeds), len(self._dense)))
        for i, doc in enumerate(seeds):
            asked[i, self._rows[doc]] = 1.0
        out = asked @ self._dense
        for i, doc in enumerate(seeds):
            first, size = self._lists[doc]
            if len(first):
                at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
                out[i] += np.bincount(self._docs[at], self._weight[at], self._n)
        return out


def fill(tokens: list[np.ndarray], window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(sequence, doc, start, length, offset) of a shard's pieces; every sequence but the last is full.

    A document's full windows come first, each a sequence of its own. What is left of it is then the
    seed of a sequence or a neighbour in one: the first unused rest is the seed, and unused rests
    follow by falling BM25 for all terms of the seed's text (then in order) until the window is full;
    the last one is cut to fit and its remainder stays for later.
    """
    sequence = 0
    start = np.zeros(len(tokens), np.int64)
    for doc, ids in enumerate(tokens):
        for _ in range(len(ids) // window):
            yield sequence, doc, int(start[doc]), window, 0
            start[doc] += window
            sequence += 1
    left = np.array([len(t) for t in tokens]) - start
    shard, unused, known = Shard(tokens), left > 0, {}
    for seed in range(len(tokens)):
        while unused[seed]:
            used, nearest, at = 0, None, 0
            doc = seed
            while True:
                length = int(min(left[doc], window - used))
                yield sequence, doc, int(start[doc]), length, used
                used += length
                start[doc] += length
                left[doc] -= length
                unused[doc] = left[doc] > 0
                if used == window:
                    break
                if nearest is None:
                    if seed not in known:
                        group = [seed, *(seed + 1 + np.flatnonzero(unused[seed + 1:])[:SEEDS - 1]).tolist()]
                        known = dict(zip(group, shard.scores(group), strict=True))
                    nearest = np.flatnonzero(unused)
                    nearest = nearest[np.argsort(-known[seed][nearest], kind="stable")]
                while at < len(nearest) and not unused[nearest[at]]:
                    at += 1
                if at == len(nearest):
                    break
                doc = int(nearest[at])
            sequence += 1


def pack(
    docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 0, shard_docs: int = SHARD_DOCS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pack whole texts into sequences of at most ``window`` tokens; a row per piece.

    Returns doc_id, start, length, ids_crc32 (of the piece's ids as little-endian 32-bit numbers),
    doc_tokens (with the closing ``end_id``), sequence_id and offset. Each id of each document lies in
    exactly one piece; a shard's sequences are full, except its last one.

    Rows are dealt out evenly and each task builds one shard of the inverted index after the other:
    memory is bounded by a shard, and neighbours come from the seed's shard. A document larger than a
    shard is a shard of its own.

    Null or empty texts are the closing id alone; null ids are kept; rows repeating an id are packed one
    by one; other columns are ignored.
    """
    n = shuffle_partitions(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, base = encoder(tokenizer), TaskContext.get().partitionId() << 40
        ids, tokens, held, shards = [], [], 0, 0

        def packed():
            out = [[] for _ in names]
            data = [t.tobytes() for t in tokens]
            for sequence, doc, start, length, offset in fill(tokens, window):
                row = (ids[doc], start, length, zlib.crc32(data[doc][4 * start:4 * (start + length)]), len(tokens[doc]),
                       base + (shards << 24) + sequence, offset)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

        for batch in batches:
            for i, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                encoded = np.append(enc.ids(text), np.uint32(end_id)).astype("<u4")
                if tokens and (len(tokens) >= shard_docs or held + len(encoded) > SHARD_TOKENS):
                    yield packed()
                    ids, tokens, held, shards = [], [], 0, shards + 1
                ids.append(i)
                tokens.append(encoded)
                held += len(encoded)
        if tokens:
            yield packed()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    # By the text's hash, so that a repeated run deals the same rows to the same tasks; salted by id, as a
    # text may have many copies.
    dealt = text_of(docs, id_col, text_col).repartition(n, F.xxhash64("id", "text"))
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in names))
