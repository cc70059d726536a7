"""Byte n-grams of whole batches of texts, as hashed 64-bit keys in numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

from .pretokens import batches_by_size

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Digits, punctuation and control characters become blanks; letters and all non-ASCII bytes stay.
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


class Batch:
    """Texts, lower-cased and reduced to letters, joined in one buffer; each is framed by blanks."""

    def __init__(self, texts: Sequence[str | None]):
        parts = [(t or "").lower().encode("utf-8", "replace").translate(_LETTERS) for t in texts]
        self.bytes = np.frombuffer(b" " + b" ".join(parts) + b" " + bytes(8), np.uint8).astype(np.uint64)
        self.lens = np.fromiter(map(len, parts), np.int64, len(parts))
        self.begins = np.cumsum(self.lens + 1) - self.lens  # of the texts, without the blank before
        self.texts = len(parts)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashed n-grams, text of each); the blanks around a text count as part of it."""
        width = np.maximum(self.lens + 2 - n + 1, 0) * (self.lens > 0)
        total = int(width.sum())
        owner = np.repeat(np.arange(self.texts), width)
        at = np.arange(total) - np.repeat(np.cumsum(width) - width, width) + np.repeat(self.begins - 1, width)
        key = self.bytes[: len(self.bytes) - n + 1].copy()
        for k in range(1, n):
            key |= self.bytes[k : len(self.bytes) - n + 1 + k] << np.uint64(8 * k)
        key = (key + np.uint64(n)) * _MIX
        key ^= key >> np.uint64(29)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        return key[at], owner


def batches(texts: Sequence[str | None], most: int = 500_000) -> Iterator[tuple[int, int, Batch]]:
    """Batches of bounded size; a longer text stands alone."""
    for a, b in batches_by_size([t or "" for t in texts], most):
        yield a, b, Batch(texts[a:b])
