"""Fill-in-the-middle transformation over a sparse checkpoint index (operator 13).

A text is read once, block by block, to count its units; during that count every ``STEP`` units the byte offset and the
code-point offset are recorded.  Each cut is then found by a binary search of these checkpoints and a short scan
from the one before it, so no list of all units exists and the text is never decoded.  Units are code points
(``char``), words with the white space before them (``word``; white space at the end is a unit of its own) or lines
with their line feed (``line``).

The cuts and the form come from the sha256 of ``seed:key`` as hex: with h1 to h4 its first four groups of eight digits, the
prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units and the middle after the larger; h3 % 100 decides
whether the text is transformed, h4 % 100 whether the suffix comes first.  So a lost task gives the same rows again.

Defined results: a null text is the empty text, and an empty text is ``plain``, as is one that holds a marker; a null key
counts as the empty string; rows are independent, so ties and repeated rows do not matter; an empty table gives an empty
table; other columns pass through (one that is called like the result as ``_<name>``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import worker_memory
from .tables import with_result

#: Units between two checkpoints, and bytes that are looked at together.
STEP, BLOCK = 512, 1 << 16
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
MADE = StructType(
    [StructField("form", StringType()), StructField("n", LongType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())]
)
_MADE_ARROW = pa.struct([("form", pa.string()), ("n", pa.int64()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
#: ASCII white space, by byte.
_WHITE = np.array([c in (9, 10, 11, 12, 13, 32) for c in range(256)])


def _leads(data: np.ndarray) -> np.ndarray:
    """Whether each byte is the first of a code point."""
    return (data & 0xC0) != 0x80


def _chars(data: np.ndarray, before: int) -> np.ndarray:
    return _leads(data)


def _words(data: np.ndarray, before: int) -> np.ndarray:
    start = white = _WHITE[data]
    return start & ~np.append(_WHITE[before], white[:-1])


def _lines(data: np.ndarray, before: int) -> np.ndarray:
    return np.append(before == 10, data[:-1] == 10)


#: Where units begin in a block of bytes, given the byte before the block; the first byte of a text begins one in any case.
UNITS: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {"char": _chars, "word": _words, "line": _lines}


class Checkpoints:
    """The units of a text: how many there are, and the byte and code-point offsets of every ``step``-th."""

    def __init__(self, text: bytes, unit: str = "char", step: int = STEP):
        self.data, self.begins, self.step = np.frombuffer(text, np.uint8), UNITS[unit], step
        units, byte_at, char_at = [], [], []
        self.n = self.chars = 0
        for begin, starts, leads in self._blocks(0, BLOCK):
            at = np.flatnonzero(starts)
            skip = -self.n % step
            due = at[skip::step]
            if len(due):
                units.append(np.arange(self.n + skip, self.n + len(at), step))
                byte_at.append(begin + due)
                char_at.append(self.chars - 1 + np.cumsum(leads)[due])
            self.n += len(at)
            self.chars += int(np.count_nonzero(leads))
        self.units, self.byte_at, self.char_at = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (units, byte_at, char_at))

    def _blocks(self, begin: int, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(offset, unit starts, code-point starts) of the blocks from ``begin`` on."""
        for a in range(begin, len(self.data), size):
            part = self.data[a : a + size]
            starts = self.begins(part, int(self.data[a - 1]) if a else 0)
            if a == 0:
                starts[0] = True
            yield a, starts, _leads(part)

    def cut(self, units: int) -> tuple[int, int]:
        """(byte offset, code-point offset) of the place after so many units, of which there are ``n``."""
        if units == self.n:
            return len(self.data), self.chars
        k = int(np.searchsorted(self.units, units, "right")) - 1
        left, chars = units - int(self.units[k]), int(self.char_at[k])
        for begin, starts, leads in self._blocks(int(self.byte_at[k]), 4 * self.step):
            at = np.flatnonzero(starts)
            if left < len(at):
                to = int(at[left])
                return begin + to, chars + int(np.count_nonzero(leads[:to]))
            left -= len(at)
            chars += int(np.count_nonzero(leads))
        raise ValueError(f"a text of {self.n} units has no cut after {units}")


def rearranged(text: bytes, h: tuple[int, int, int, int], *, unit: str, plain_percent: int, spm_percent: int) -> tuple[str, int, int | None, int | None, bytes]:
    """(form, units, code points of the prefix, of the middle, output) of one text, under its four hash values."""
    index = Checkpoints(text, unit)
    n = index.n
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if not n or h[2] % 100 >= 100 - plain_percent or any(m in text for m in marks):
        return PLAIN, n, None, None, text
    (a, to), (b, upto) = map(index.cut, sorted((h[0] % (n + 1), h[1] % (n + 1))))
    p, s, m = (mark + part for mark, part in zip(marks, (text[:a], text[b:], text[a:b]), strict=True))
    spm = h[3] % 100 < spm_percent
    return SPM if spm else PSM, n, to, upto - to, s + p + m if spm else p + s + m


def fill_in_middle(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    seed: int = 1,
    unit: str = "char",
    plain_percent: int = 10,
    spm_percent: int = 20,
    into: str = "fim",
) -> DataFrame:
    """``docs`` with a struct of form, n, prefix_chars, middle_chars and output.

    ``prefix_chars`` and ``middle_chars`` are code points whatever the unit, null if plain; ``n`` counts units.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")

    @F.arrow_udf(MADE)
    @worker_memory.tidied
    def transform(rows: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, hashes in rows:
            made = []
            for begin in range(0, len(texts), 512):  # so that few texts exist twice
                data = texts.slice(begin, 512).cast(pa.large_binary()).to_pylist()
                groups = [tuple(int(x[i : i + 8], 16) for i in range(0, 32, 8)) for x in hashes.slice(begin, 512).to_pylist()]
                parts = [rearranged(t or b"", h, unit=unit, plain_percent=plain_percent, spm_percent=spm_percent) for t, h in zip(data, groups, strict=True)]
                columns = [pa.array([x[k] for x in parts], f.type) for k, f in enumerate(_MADE_ARROW.fields[:-1])]
                output = pa.array([x[-1] for x in parts], pa.binary()).cast(pa.string())
                made.append(pa.StructArray.from_arrays([*columns, output], fields=_MADE_ARROW.fields))
            yield pa.concat_arrays(made) if made else pa.array([], _MADE_ARROW)

    named = F.concat(F.lit(f"{seed}:"), F.coalesce(docs[f"`{key}`"].cast("string"), F.lit("")))
    hashes = F.sha2(named.cast("binary"), 256)
    return with_result(docs, into, transform.asNondeterministic()(docs[f"`{text}`"], hashes))  # so that no filter runs it again


def restored(output: Column, form: Column) -> Column:
    """The exact text that an output was made from.

    A transformed text holds no marker, so each marker is where it is first found.
    """
    p, s, m = (F.instr(output, mark) for mark in (PREFIX, SUFFIX, MIDDLE))
    upto = lambda begin, end: F.substr(output, begin + len(PREFIX), end - begin - len(PREFIX))
    rest = F.substr(output, m + len(MIDDLE))
    return (
        F.when(form == PSM, F.concat(upto(p, s), rest, upto(s, m)))
        .when(form == SPM, F.concat(upto(p, m), rest, upto(s, p)))
        .otherwise(output)
    )
