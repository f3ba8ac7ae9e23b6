"""Hashed byte n-grams of many texts at once."""

from __future__ import annotations

import numpy as np

MIX = np.uint32(2654435761)


def gram_codes(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """A bucket below 2**bits for the n-gram that begins at each byte but the last n-1."""
    if len(data) < n:
        return np.zeros(0, np.uint32)
    code = np.full(len(data) - n + 1, n, np.uint32)
    for i in range(n):
        code *= np.uint32(257)
        code += data[i : len(data) - n + 1 + i]
    code *= MIX
    return code >> np.uint32(32 - bits)


def gram_counts(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """A row of counts over 2**bits buckets for each text; n-grams don't reach over a text's end."""
    m, width = len(offsets) - 1, 1 << bits
    out = np.zeros((m, width), np.float32)
    owner = np.repeat(np.arange(m, dtype=np.int64) * width, np.diff(offsets))
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    for n in sizes:
        code = gram_codes(data, n, bits)
        keep = left[: len(code)] >= n
        out += np.bincount(owner[: len(code)][keep] + code[keep], minlength=m * width).reshape(m, width).astype(np.float32)
    return out
