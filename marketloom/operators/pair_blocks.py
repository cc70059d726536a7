"""Statistics of all pairs of series, worked out by pairs of blocks of series.

Every series travels as two arrays to the units (pairs of blocks) it takes part in, so what is shuffled grows
with the number of series times the number of blocks, of which there are no more than ``MOST_BLOCKS`` unless blocks would exceed ``MOST_SERIES``; pairs
of rows never meet in a join.  Where series have all of the newest dates, these alone travel, and a unit works out a tile of pairs at once by
products of matrices (``pair_tiles``).  It aligns the other pairs on their common dates, takes the wanted statistics of a chunk of pairs at once in
NumPy and hands them on before the next chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut_lineage
from .pair_tiles import Tile, half_lives, lookbacks

#: Series of a block, about, at least; a unit holds two blocks.
BLOCK = 64
#: Blocks up to which their number grows (it is what a series is shuffled times), and series of a block beyond which it grows again.
MOST_BLOCKS, MOST_SERIES = 16, 8192
#: Tasks a unit, so that few units meet in one, and tasks in all.
TASKS, MOST_TASKS = 3, 2000
#: Rows and columns of a tile of pairs with the same dates, and values of a chunk of other pairs.
TILE = 64, 256
CHUNK = 200_000
NUMBERS = ("beta", "alpha", "cor", "phi", "adf_t", "kss_t", "diff_r", "la", "lb", "s", "z", "first_z", "life_z", "life_gap")


def _slope(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    xc = x - x.mean(axis=1, keepdims=True)
    return (xc * (y - y.mean(axis=1, keepdims=True))).sum(axis=1) / (xc * xc).sum(axis=1)


def _correlation(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    xc, yc = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
    return (xc * yc).sum(axis=1) / np.sqrt((xc * xc).sum(axis=1) * (yc * yc).sum(axis=1))


def _t_of_first(y: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """t statistic of the first of two regressors without intercept; NaN where they are collinear."""
    m = lambda a, b: (a * b).sum(axis=1)
    s11, s22, s12, t1, t2 = m(x1, x1), m(x2, x2), m(x1, x2), m(x1, y), m(x2, y)
    det = s11 * s22 - s12 * s12
    det[det == 0] = np.nan
    b1, b2 = (s22 * t1 - s12 * t2) / det, (s11 * t2 - s12 * t1) / det
    return b1 / np.sqrt((m(y, y) - b1 * t1 - b2 * t2) / (y.shape[1] - 2) * s22 / det)


def trailing_z(s: np.ndarray, at: int, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(z, distance from the mean) of the values at a place, over the n[row] values that end there."""
    back = at - np.arange(s.shape[1])
    inside = (back >= 0) & (back < n[:, None])
    size = np.where(n > 1, n, np.nan)
    mean = (s * inside).sum(axis=1) / size
    gap = s[:, at] - mean
    deviation = np.sqrt((((s - mean[:, None]) * inside) ** 2).sum(axis=1) / (size - 1))
    return gap / np.where(deviation == 0, np.nan, deviation), gap


def rolling_z(s: np.ndarray, window: int) -> np.ndarray:
    """z of each value over the ``window`` values that end there, by running sums; NaN before that and where they are constant."""
    z = np.full(s.shape, np.nan)
    c = s - s.mean(axis=1, keepdims=True)
    sums, squares = (np.cumsum(np.pad(x, ((0, 0), (1, 0))), axis=1) for x in (c, c * c))
    mean = (sums[:, window:] - sums[:, :-window]) / window
    square = (squares[:, window:] - squares[:, :-window]) / window
    variance = square - mean * mean
    # where running sums have lost their digits, the frame itself tells
    i, j = np.nonzero(~(variance > 1e-6 * squares[:, -1:] / s.shape[1]))
    if len(i):
        frames = np.lib.stride_tricks.sliding_window_view(s, window, axis=1)[i, j]
        variance[i, j], mean[i, j] = np.where(np.ptp(frames, axis=1) == 0, 0.0, frames.var(axis=1)), frames.mean(axis=1) - s.mean(axis=1)[i]
    deviation = np.sqrt(variance * (window / (window - 1)))
    z[:, window - 1 :] = (c[:, window - 1 :] - mean) / np.where(deviation == 0, np.nan, deviation)
    return z


def statistics(la: np.ndarray, lb: np.ndarray, window: int, wanted: frozenset[str] | None = None) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(numbers, z of each date, place of the first entry or 0) of aligned pairs, a row each; with ``wanted`` only these of ``NUMBERS``, and z and first for "zs" and "first_entry"."""
    has = lambda *names: wanted is None or not wanted.isdisjoint(names)
    beta = _slope(la, lb)
    alpha = la.mean(axis=1) - beta * lb.mean(axis=1)
    s = la - alpha[:, None] - beta[:, None] * lb
    numbers = {"beta": beta, "alpha": alpha, "la": la[:, -1], "lb": lb[:, -1], "s": s[:, -1]}
    z, first = np.empty((len(s), 0)), np.zeros(len(s), np.int64)
    if has("cor"):
        numbers["cor"] = _correlation(la, lb)
    if has("diff_r"):
        numbers["diff_r"] = _correlation(np.diff(la, axis=1), np.diff(lb, axis=1))
    if has("phi", "life_z", "life_gap"):
        numbers["phi"] = _slope(s[:, 1:], s[:, :-1])
    if has("life_z", "life_gap"):
        numbers["life_z"], numbers["life_gap"] = trailing_z(s, s.shape[1] - 1, lookbacks(half_lives(numbers["phi"]), s.shape[1]))
    if has("adf_t"):
        ds = np.diff(s, axis=1)
        numbers["adf_t"] = _t_of_first(ds[:, 1:], s[:, 1:-1], ds[:, :-1])
    if has("kss_t"):
        spread = s.std(axis=1)
        v = (s - s.mean(axis=1, keepdims=True)) / np.where(spread == 0, np.nan, spread)[:, None]
        dv = np.diff(v, axis=1)
        numbers["kss_t"] = _t_of_first(dv[:, 1:], v[:, 1:-1] ** 3, dv[:, :-1])
    if has("z", "zs", "first_z", "first_entry"):
        z = rolling_z(s, window)
        enters = np.zeros(s.shape, bool)
        enters[:, 1:] = (np.abs(z[:, :-1]) < 2) & (np.abs(z[:, 1:]) >= 2)
        first = np.where(enters.any(axis=1), enters.argmax(axis=1) + 1, 0)
        numbers["z"] = z[:, -1]
        numbers["first_z"] = np.where(first > 0, z[np.arange(len(s)), first - 1], np.nan)
    return numbers, z, first


def _unit_table(names: pa.Array, p: np.ndarray, q: np.ndarray, n: int, numbers: dict[str, np.ndarray], schema: pa.Schema, dates: np.ndarray | None = None, zs: np.ndarray | None = None) -> pa.Table:
    """A row for each pair p, q of n dates with its numbers; what isn't finite is null."""

    def finite(x: np.ndarray) -> pa.Array:
        known = np.isfinite(x)
        return pa.array(x, pa.float64()) if known.all() else pa.array(x, pa.float64(), mask=~known)

    of = {"a": lambda: names.take(pa.array(p)), "b": lambda: names.take(pa.array(q)), "n": lambda: pa.array(np.full(len(p), n, np.int64))}
    of["first_entry"] = lambda: pa.array(numbers["first_entry"], pa.int64(), mask=numbers["first_entry"] == 0)
    offsets = lambda: pa.array(np.arange(len(p) + 1, dtype=np.int32) * np.int32(n))
    of["d"] = lambda: pa.ListArray.from_arrays(offsets(), pa.array(np.broadcast_to(dates, (len(p), n)).reshape(-1), pa.int32()).cast(pa.date32()))
    of["zs"] = lambda: pa.ListArray.from_arrays(offsets(), finite(zs.reshape(-1)))
    return pa.table({f.name: of[f.name]() if f.name in of else finite(numbers[f.name]) for f in schema}, schema)


def _aligned_table(names: pa.Array, dates: np.ndarray, a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, window: int, schema: pa.Schema) -> pa.Table:
    """The statistics of the pairs p, q whose aligned values are a and b, on ``dates`` (a row each, or one for all)."""
    with np.errstate(all="ignore"):
        numbers, z, first = statistics(a, b, window, frozenset(schema.names))
    return _unit_table(names, p, q, a.shape[1], numbers | {"first_entry": first}, schema, dates, z)


def pair_statistics(
    closes: DataFrame, *, formation: int, least: int | None = None, window: int = 20, series: bool = False, columns: tuple[str, ...] | None = None
) -> DataFrame:
    """(a, b, statistics) of all pairs a < b of tickers with at least ``least`` (else ``formation``) common dates; the last ``formation`` count.

    ``closes`` has ticker, d and x (log close, not null); a ticker's repeated dates count once.  Columns: beta, alpha, cor of the regression
    of a on b; phi, adf_t, kss_t of its residuals; diff_r of first differences; la, lb, s and z (over ``window`` dates) of the
    last date; first_entry (place of the first |z| >= 2 after one below, from 1) and first_z; with ``series`` also the
    dates and their z; life_z and life_gap are z and the distance from the mean over the lookback that the pair's half-life asks for; n is the number
    of common dates that count.  What can't be told (a constant series, say) is null.  An empty table gives an empty table.  With ``columns`` only these
    are worked out.
    """
    kind = closes.schema["ticker"].dataType.simpleString()
    least = least or formation
    days = closes.where("x IS NOT NULL").groupBy("ticker", F.to_date("d").alias("d")).agg(F.max("x").alias("x"))
    rows = days.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct(F.unix_date("d").alias("d"), "x"))).alias("v")).where(F.size("v") >= least)
    rows = cut_lineage(rows.select("ticker", F.col("v.d").alias("on"), F.col("v.x").alias("x")))
    newest = F.expr(f"slice(on, -least({formation}, size(on)), {formation})")
    count, first, last = rows.agg(F.count(F.lit(1)), F.min(newest), F.max(newest)).first()
    common = np.array(first, np.int64) if first is not None and first == last and len(first) == formation else None
    if common is not None:  # all pairs have these dates, so no others count
        rows = rows.select("ticker", F.lit(None).cast("array<int>").alias("on"), F.expr(f"slice(x, -{formation}, {formation})").alias("x"))
    blocks = max(1, min(-(-count // BLOCK), max(MOST_BLOCKS, -(-count // MOST_SERIES))))
    own = F.pmod(F.xxhash64("ticker"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = rows.select("ticker", "on", "x", own.alias("own"), other.alias("other")).select(
        F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "ticker", "on", "x"
    )

    def unit(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("ticker")
        names, at = t.column("ticker").combine_chunks(), t.column("own").to_numpy()
        on, values = t.column("on").combine_chunks(), t.column("x").combine_chunks().flatten().to_numpy()
        if common is not None:
            dates, x = common, values.reshape(len(names), formation)
        else:
            owner = np.repeat(np.arange(len(names)), on.value_lengths().to_numpy())
            dates, place = np.unique(on.flatten().to_numpy(), return_inverse=True)
            x = np.full((len(names), len(dates)), np.nan)
            x[owner, place] = values
            del owner, place
        del t, on, values
        newest = x[:, -formation:]
        whole = ~np.isnan(newest).any(axis=1) if newest.shape[1] == formation else np.zeros(len(names), bool)
        same = key[0].as_py() == key[1].as_py()
        step = max(1, CHUNK // max(1, len(dates)))
        ours, theirs = np.flatnonzero(at == at[0]), np.flatnonzero(at != at[0])
        theirs = ours if same else theirs
        tiled = whole & (not series)  # a list of z a pair needs its spread
        held, held_pairs = [], 0
        for made, p, q in chain(tiles(names, newest, tiled, ours, theirs), others(tiled, ours, theirs)):
            yield from made
            held.append((p, q))
            held_pairs += len(p)
            if held_pairs >= step:
                yield from chunks(names, dates, x, whole, held, step)
                held, held_pairs = [], 0
        yield from chunks(names, dates, x, whole, held, step)

    def tiles(names: pa.Array, x: np.ndarray, tiled: np.ndarray, ours: np.ndarray, theirs: np.ndarray) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
        """(rows, pairs left as unsure) of each tile of pairs of tiled series."""
        for low, high in [(ours, theirs)] if ours is theirs else [(ours, theirs), (theirs, ours)]:  # a comes before b
            low, high = low[tiled[low]], high[tiled[high]]
            for k in range(0, len(low), TILE[0]):
                some = low[k : k + TILE[0]]
                for begin in range(int(np.searchsorted(high, some[0], "right")), len(high), TILE[1]):
                    partners = high[begin : begin + TILE[1]]
                    # tiles of one size, as the last digits of a product of matrices can depend on its size
                    rows, columns = (np.pad(at, (0, size - len(at)), mode="edge") for at, size in zip((some, partners), TILE, strict=True))
                    pairs = rows[:, None] < columns
                    pairs[len(some) :], pairs[:, len(partners) :] = False, False
                    with np.errstate(all="ignore"):
                        tile = Tile(x[rows], x[columns], window, wanted)
                        if entries:
                            tile.first_entries(pairs, window)
                    i, j = np.nonzero(pairs & ~tile.unsure)
                    u, v = np.nonzero(pairs & tile.unsure)
                    flat = slice(None) if len(i) == pairs.size else (i, j)
                    numbers = {n: np.ascontiguousarray(m[flat]).reshape(-1) for n, m in tile.numbers.items() if n in wanted}
                    yield _unit_table(names, rows[i], columns[j], formation, numbers, schema).to_batches(), rows[u], columns[v]

    def others(tiled: np.ndarray, ours: np.ndarray, theirs: np.ndarray) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
        """The pairs outside tiles, by the series of ours."""
        for i in ours:
            partners = theirs[theirs > i] if ours is theirs else theirs
            partners = partners[~tiled[partners]] if tiled[i] else partners
            if len(partners):
                yield [], np.minimum(i, partners), np.maximum(i, partners)

    def chunks(names: pa.Array, dates: np.ndarray, x: np.ndarray, whole: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]], step: int) -> Iterator[pa.RecordBatch]:
        if held:
            p, q = (np.concatenate(c) for c in zip(*held, strict=True))
            for begin in range(0, len(p), step):
                yield from chunk(names, dates, x, whole, p[begin : begin + step], q[begin : begin + step])

    def chunk(names: pa.Array, dates: np.ndarray, x: np.ndarray, whole: np.ndarray, p: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The pairs p, q of series; those with all newest dates need no alignment."""
        easy = whole[p] & whole[q]
        if easy.any():
            a, b = (x[c[easy], len(dates) - formation :] for c in (p, q))
            yield from _aligned_table(names, dates[-formation:], a, b, p[easy], q[easy], window, schema).to_batches()
        p, q = p[~easy], q[~easy]
        if not len(p):
            return
        both = ~np.isnan(x[p] + x[q])
        last = both & (np.cumsum(both[:, ::-1], axis=1)[:, ::-1] <= formation)
        size_of = last.sum(axis=1)
        for size in np.unique(size_of[size_of >= least]).tolist():
            r = size_of == size
            on = np.broadcast_to(dates, last[r].shape)[last[r]].reshape(-1, size)
            a, b = (x[c[r]][last[r]].reshape(-1, size) for c in (p, q))
            yield from _aligned_table(names, on, a, b, p[r], q[r], window, schema).to_batches()

    arrow_kind = pa.string() if kind == "string" else pa.int64() if kind == "bigint" else pa.int32()
    made = [("a", arrow_kind), ("b", arrow_kind), *[(n, pa.float64()) for n in NUMBERS], ("first_entry", pa.int64()), ("n", pa.int64())]
    made += [("d", pa.list_(pa.date32())), ("zs", pa.list_(pa.float64()))] if series else []
    schema = pa.schema([(n, t) for n, t in made if columns is None or n in ("a", "b", *columns)])
    wanted = frozenset(schema.names)
    entries = not wanted.isdisjoint(("first_entry", "first_z"))
    ddl = {"a": kind, "b": kind, "first_entry": "long", "n": "long", "d": "array<date>", "zs": "array<double>"}
    # a unit has much work and little data, so units aren't put together by size: nearly each is a task
    return dealt.repartition(min(MOST_TASKS, TASKS * blocks * (blocks + 1) // 2), "low", "high").groupBy("low", "high").applyInArrow(unit, ", ".join(f"{n} {ddl.get(n, 'double')}" for n in schema.names))
