"""Token counts by overlap resynchronisation."""

from __future__ import annotations

import pyarrow as pa
import numpy as np
from pyspark.sql import DataFrame

from flowspark.llm.common import map_rows, text_of
from flowspark.llm.encoders import encoder

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 1 << 8


def _stable(text: str, low: int, high: int) -> int | None:
    """The last place in [low, high) where every encoding of the text must start a new token: a blank
    behind a visible ASCII character."""
    for at in range(high - 1, low - 1, -1):
        if text[at] in " \n\t" and "!" <= text[at - 1] <= "~":
            return at
    return None


def _starts(ids: np.ndarray, enc) -> np.ndarray:
    return np.cumsum(enc.lengths[ids]) - enc.lengths[ids]


def spliced(text: str, enc, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
    """Yield the ids of ``text`` in runs, from overlapping chunks, and how often an overlap was widened.

    A chunk's encoding is true up to a stable boundary well inside it, and the next chunk's is true
    from that boundary on, if both have a token starting there: the rules never look back, and the
    characters they look ahead to lie before the chunk's end. Where the overlap has no such common
    boundary it is doubled, up to the whole chunk; then the chunk itself grows.
    """
    n, at, end = len(text), 0, min(len(text), chunk)
    ids, first = enc.ids(text[:end]), 0
    starts = _starts(ids, enc)
    while end < n:
        width, found, widened = overlap, None, 0
        while found is None:
            low = max(at + 1, end - width)
            place = _stable(text, low, end - enc.guard)
            if place is not None:
                next_end = min(n, low + chunk)
                following = enc.ids(text[low:next_end])
                theirs = _starts(following, enc)
                mine = int(np.searchsorted(starts, len(text[first:place].encode())))
                other = int(np.searchsorted(theirs, len(text[low:place].encode())))
                agree = (mine < len(starts) and other < len(theirs)
                         and starts[mine] == len(text[first:place].encode())
                         and theirs[other] == len(text[low:place].encode()))
                if agree and next_end > end:
                    found = place
                    break
            widened += 1
            if low == at + 1:  # no boundary in the whole chunk
                break
            width *= 2
        if found is None:
            end = min(n, end + (end - at))
            ids, first = enc.ids(text[at:end]), at
            starts = _starts(ids, enc)
            yield np.empty(0, np.uint32), widened
            continue
        begin = int(np.searchsorted(starts, len(text[first:at].encode())))
        yield ids[begin:mine], widened
        at, first, end, ids, starts = found, low, next_end, following, theirs
    yield ids[int(np.searchsorted(starts, len(text[first:at].encode()))):], 0


def count_tokens(
    docs: DataFrame, tokenizer: str, limit: int = 1024, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Tokens of every whole text as the library of the file gives them.

    Returns doc_id, n_bytes, n_tokens, over_limit, n_chunks and n_widened (overlaps that had to grow).
    Texts up to ``chunk`` characters are encoded whole; longer ones in overlapping chunks that are
    spliced at proven boundaries, so the encoder's memory is bounded by the chunk. One pass, no
    shuffle. Null or empty text: 0 bytes and tokens. A null id stays null, repeated rows are counted
    one by one, other columns are ignored. Files whose rules aren't known to be splittable
    (sentencepiece, other models) are encoded whole.
    """

    def start():
        enc = encoder(tokenizer)

        def step(ids, texts):
            out = ([], [], [], [], [], [])
            for i, text in zip(ids, texts, strict=True):
                chunks = widened = 0
                if len(text) > chunk and enc.can_splice(text):
                    tokens = 0
                    for run, more in spliced(text, enc, chunk, overlap):
                        tokens, widened, chunks = tokens + len(run), widened + more, chunks + 1
                else:
                    tokens, chunks = len(enc.ids(text)), 1
                row = (i, len(text.encode()), tokens, tokens > limit, chunks, widened)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out

        return step

    return map_rows(
        text_of(docs, id_col, text_col), start,
        "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks long, n_widened long",
        {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_tokens": pa.int64(), "over_limit": pa.bool_(),
         "n_chunks": pa.int64(), "n_widened": pa.int64()},
    )
