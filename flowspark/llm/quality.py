"""Quality rules: counts of words and repetition, then compression bands."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import map_rows, text_of

#: Bytes per compressed byte: (texts of at least so many bytes, least ratio, greatest ratio). Running
#: prose lies between 1.1 (a line) and 3 (a book); headers weigh on short texts, so these get no floor.
TEXT_BANDS = ((0, 0.0, 2.8), (256, 1.1, 3.2), (1024, 1.25, 3.6), (4096, 1.35, 4.2), (65536, 1.4, 5.0))
#: The band of a chunk, and the share of chunked bytes that may lie outside it.
CHUNK_BYTES, CHUNK_BAND, CHUNK_SHARE = 4096, (1.25, 4.0), 0.25
#: A last chunk shorter than this is judged with the whole text only.
LEAST_CHUNK = 1024
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
_BLANKS, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words found twice or more, first occurrences included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    # Ranks of ever longer windows: equal ranks are equal windows.
    ranks, width = ids, 1
    while width < window:
        step = min(width, window - width)
        low = ranks[:len(ranks) - step]
        pairs = low * (int(ranks.max()) + 1) + ranks[step:]
        width += step
        distinct, ranks, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(distinct) == len(pairs) and width <= window:
            return 0  # no shorter window repeats
    starts = np.flatnonzero(counts[ranks] > 1)
    if not len(starts):
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def base_counts(text: str, data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = data.split()
    seen, repeats = set(), 0
    for line in data.split(b"\n"):
        if line.strip(_BLANKS):
            repeats += line in seen
            seen.add(line)
    blanks = len(data) - len(data.translate(None, _BLANKS))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    return len(words), len(text) - blanks, symbols, repeats, repeated_words(words)


def band_verdict(data: bytes, squeeze, text_bands=TEXT_BANDS, chunk_bytes=CHUNK_BYTES, chunk_band=CHUNK_BAND,
                 chunk_share=CHUNK_SHARE) -> tuple[float, float, str]:
    """Ratio of the whole text, share of chunked bytes outside the band, and what is wrong (or '')."""
    if not data:
        return 0.0, 0.0, ""
    ratio = len(data) / len(squeeze(data))
    _, least, most = [b for b in text_bands if len(data) >= b[0]][-1]
    outside = total = 0
    for at in range(0, len(data), chunk_bytes):
        chunk = data[at:at + chunk_bytes]
        if len(chunk) >= LEAST_CHUNK:
            total += len(chunk)
            outside += len(chunk) * (not chunk_band[0] <= len(chunk) / len(squeeze(chunk)) <= chunk_band[1])
    share = outside / total if total else 0.0
    wrong = "repetitive" if ratio > most else "incompressible" if ratio < least else "chunks" if share > chunk_share else ""
    return ratio, share, wrong


def quality_report(
    docs: DataFrame, level: int = 3, text_bands=TEXT_BANDS, chunk_bytes: int = CHUNK_BYTES, chunk_band=CHUNK_BAND,
    chunk_share: float = CHUNK_SHARE, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Counts and verdict of every whole text, in one pass without a shuffle.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio,
    outside_share, reason, kept. A text fails the base rules with under 20 words or with over 30 % of
    its words in repeated 8-word windows. Else its zstandard ratios decide: of the whole text within
    the band for its length, and of fixed chunks, of which at most ``chunk_share`` (by bytes) may lie
    outside ``chunk_band``. High ratios are repetition, low ones are noise or encoded data.

    A null or empty text has no words and fails. A null id stays null; repeated rows are judged one by
    one; other columns are ignored.
    """

    def start():
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=level).compress

        def step(ids, texts):
            rows = []
            for i, text in zip(ids, texts, strict=True):
                data = text.encode()
                counts = base_counts(text, data)
                failed = counts[0] < LEAST_WORDS or 100 * counts[4] > MOST_REPEATED * counts[0]
                ratio, share, wrong = band_verdict(data, squeeze, text_bands, chunk_bytes, chunk_band, chunk_share)
                wrong = ("words" if counts[0] < LEAST_WORDS else "repeats") if failed else wrong
                rows.append((i, *counts, failed, ratio, share, wrong, not wrong))
            return list(zip(*rows, strict=True)) if rows else [[]] * 11

        return step

    longs = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    types = dict.fromkeys(longs, pa.int64()) | {
        "base_failed": pa.bool_(), "ratio": pa.float64(), "outside_share": pa.float64(), "reason": pa.string(),
        "kept": pa.bool_()}
    schema = ", ".join(f"{c} long" for c in longs) + (
        ", base_failed boolean, ratio double, outside_share double, reason string, kept boolean")
    return map_rows(text_of(docs, id_col, text_col), start, schema, types)


def passing(docs: DataFrame, text_col: str = "text", level: int = 3) -> DataFrame:
    """The rows of ``docs`` whose text passes all rules with the default bands, columns unchanged."""

    def start():
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=level).compress

        def good(text: str | None) -> bool:
            data = (text or "").encode()
            n, _, _, _, repeats = base_counts(text or "", data)
            return not (n < LEAST_WORDS or 100 * repeats > MOST_REPEATED * n) and not band_verdict(data, squeeze)[2]

        return good

    at = docs.columns.index(text_col)

    def run(batches):
        good = start()
        for batch in batches:
            yield batch.filter(pa.array([good(t) for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
