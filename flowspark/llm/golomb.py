"""Golomb-Rice codes of sorted keys, and bitmaps, vectorised."""

from __future__ import annotations

import numpy as np


def encode(keys: np.ndarray, base: int) -> tuple[int, bytes]:
    """Sorted distinct keys (uint64, at least one) as gaps from ``base``: quotients in unary, then the
    remainders of ``k`` bits. Returns k and the code."""
    gaps = np.diff(keys, prepend=np.uint64(base))
    gaps[1:] -= np.uint64(1)
    k = max(0, int(gaps.mean()).bit_length() - 1)
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    if not k:
        return k, np.packbits(unary).tobytes()
    places = np.arange(k - 1, -1, -1, dtype=np.uint64)
    rests = ((gaps[:, None] >> places) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(unary).tobytes() + np.packbits(rests.ravel()).tobytes()


def decode(code: bytes, n: int, k: int, base: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    # The first n ones end the n quotients; later ones belong to remainders.
    ends = np.flatnonzero(bits)[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        first = (int(ends[-1]) // 8 + 1) * 8
        rests = bits[first:first + n * k].reshape(n, k)
        weights = np.uint64(1) << np.arange(k - 1, -1, -1, dtype=np.uint64)
        gaps |= (rests * weights).sum(axis=1, dtype=np.uint64)
    gaps[1:] += np.uint64(1)
    return np.uint64(base) + np.cumsum(gaps, dtype=np.uint64)


def pack(flags: np.ndarray) -> bytes:
    return np.packbits(flags.astype(np.uint8)).tobytes()


def unpack(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
