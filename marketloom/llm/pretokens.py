"""Vectorised split of texts into the pieces of the public byte-level BPE pattern.

The pattern (fixed value, ``public_tokenizers.PATTERN``)::

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

is evaluated for a whole batch of texts at once: every code point is mapped to a class through a
table, and the starts of the pieces follow from comparisons of neighbouring classes.  The result
equals ``regex.findall`` text by text (see ``tests/llm/test_tokens.py``).
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import regex

LETTER, NUMBER, OTHER, SPACE, BLANK, EDGE = 0, 1, 2, 3, 4, 5


@functools.cache
def class_table() -> np.ndarray:
    """Class of each code point: letter, number, white space, the blank U+0020, or other."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for low in range(0, len(table), 8192):  # block by block, so that few characters exist at a time
        block = "".join(chr(c) for c in range(low, min(low + 8192, len(table))) if not 0xD800 <= c <= 0xDFFF)
        for name, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
            for m in regex.finditer(name, block):
                table[[ord(c) for c in m.group()]] = value
    table[0x20] = BLANK
    return table


def split_batch(texts: Sequence[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """Split all texts: (joined text, start of each piece, end of each piece, pieces per text).

    The joined text holds one separator character after each text; no piece contains it.
    """
    joined = "\n".join(texts) + "\n"
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    edges = np.cumsum(lens + 1) - 1
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    cls = class_table()[code]
    cls[edges] = EDGE
    n = len(cls)
    white = (cls == SPACE) | (cls == BLANK)
    start = np.empty(n, bool)
    start[0] = True
    prev, cur = cls[:-1], cls[1:]
    solid = ~white
    # a run of one class is one piece; white runs differ only in that both white classes belong together
    start[1:] = np.where(white[1:], solid[:-1], prev != cur)
    # a blank before a solid character belongs to the piece that follows it
    joins = (prev == BLANK) & solid[1:] & (cur != EDGE)
    start[1:][joins] = False
    # the last of several white characters before a solid character stands apart
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & solid[1:] & (cls[1:] != EDGE)
    start |= last
    # contractions begin at an apostrophe that starts a piece
    quote = np.flatnonzero((code == 0x27) & start & (cls == OTHER))
    if len(quote):
        pad = np.concatenate([code, np.zeros(2, np.uint32)])
        a, b = pad[quote + 1], pad[quote + 2]
        one = np.isin(a, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
        two = ((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))
        one, two = quote[one], quote[two]
        start[one + 1] = False
        start[one + 2] = True
        start[two + 1] = False
        start[two + 2] = False
        start[two + 3] = True
    start[edges] = True
    at = np.flatnonzero(start)
    ends = np.append(at[1:], n)
    keep = cls[at] != EDGE
    at, ends = at[keep], ends[keep]
    upto = np.searchsorted(at, edges)
    return joined, at, ends, np.diff(upto, prepend=0)


def pieces(texts: Sequence[str]) -> Iterator[list[str]]:
    """The pieces of each text, in order."""
    joined, at, ends, counts = split_batch(texts)
    flat = [joined[a:b] for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
    done = 0
    for k in counts.tolist():
        yield flat[done : done + k]
        done += k


def batches_by_size(texts: Sequence[str], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` characters together; a longer text stands alone."""
    begin = size = 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > most:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)
